"""Smaller operators of the inventory: scans, labels, arrays, sets and gates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenframe.plans.registry import query
from lumenframe.plans.relational import numbered
from lumenframe.plans.tables import EDITS_SQL, PIXELS_SQL, edits, photos, pixels, table


@query("""SELECT c_name AS name, n_name AS nation, r_name AS collection, c_mktsegment AS text FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
WHERE r_name = (SELECT min(r_name) FROM region) AND c_mktsegment IS NOT NULL""")
def src1_catalogue_scan(spark, d):
    t = lambda n: table(spark, d, n)
    wanted = t("region").agg(F.min("r_name").alias("r_name"))
    r = t("region").join(F.broadcast(wanted), "r_name")  # one row
    j = t("customer").where(F.col("c_mktsegment").isNotNull()).join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(r, F.col("r_regionkey") == F.col("n_regionkey"))
    return j.select(F.col("c_name").alias("name"), F.col("n_name").alias("nation"), F.col("r_name").alias("collection"), F.col("c_mktsegment").alias("text"))


@query("SELECT n_name AS name, max(n_nationkey) AS id FROM nation WHERE n_name IS NOT NULL GROUP BY 1")
def src4_name_to_id(spark, d):
    """Of a repeated name the last id holds."""
    return table(spark, d, "nation").where(F.col("n_name").isNotNull()).groupBy(F.col("n_name").alias("name")).agg(F.max("n_nationkey").alias("id"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'tag' || event_id % 5 END AS subject FROM events")
def js2_first_subject(spark, d):
    tags = F.when(F.col("event_id") % 2 == 0, F.to_json(F.struct(F.array(F.concat(F.lit("tag"), (F.col("event_id") % 5).cast("string"))).alias("subjects")))).otherwise(F.lit('{"subjects":[]}'))
    return table(spark, d, "events").select("event_id", F.get_json_object(tags, "$.subjects[0]").alias("subject"))


@query("SELECT o_orderkey AS id, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN 'version' END, CASE WHEN o_orderkey % 5 = 0 THEN 'choice' END) AS start FROM orders")
def js6_starting_edit(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("id"), F.coalesce(F.when(k % 3 == 0, "version"), F.when(k % 5 == 0, "choice")).alias("start"))


@query("SELECT event_id, c_custkey AS project FROM events JOIN customer ON c_custkey = TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)")
def j10_join_by_json_key(spark, d):
    e = table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("project"))
    return e.join(table(spark, d, "customer").select(F.col("c_custkey").alias("project")), "project")


@query("""WITH l AS (SELECT o_custkey, o_totalprice > 150000 AS dear, max(o_orderkey) AS label FROM orders GROUP BY ALL)
SELECT o_orderkey AS id, label FROM orders LEFT JOIN l USING (o_custkey) WHERE l.dear = (o_totalprice > 150000)""")
def j15_export_labels(spark, d):
    """Exports get the last label among versions of the same canonical edit."""
    o = table(spark, d, "orders").withColumn("edit", F.to_json(F.struct((F.col("o_totalprice") > 150000).alias("dear"))))
    last = o.groupBy("o_custkey", "edit").agg(F.max("o_orderkey").alias("label"))
    return o.join(last, ["o_custkey", "edit"], "left").select(F.col("o_orderkey").alias("id"), "label")


@query(f"WITH {EDITS_SQL} SELECT photo, array_to_string(list(expert ORDER BY expert, edit), ',') AS experts FROM edits WHERE NOT excluded GROUP BY photo")
def a25_group_in_order(spark, d):
    g = edits(spark, d).where("not excluded").groupBy("photo").agg(F.array_sort(F.collect_list(F.struct("expert", "edit"))).alias("x"))
    return g.select("photo", F.array_join(F.transform("x", lambda x: x["expert"].cast("string")), ",").alias("experts"))


@query(f"""WITH {EDITS_SQL}, g AS (SELECT photo, count(DISTINCT expert) AS n, max(fit_error) - min(fit_error) AS spread FROM edits GROUP BY photo)
SELECT count(*) FILTER (n < 7) AS incomplete, count(*) FILTER (n = 7 AND spread > 0) AS used, round(avg(spread) FILTER (n = 7 AND spread > 0), 3) AS mean FROM g""")
def a30_expert_scales(spark, d):
    g = edits(spark, d).groupBy("photo").agg(F.countDistinct("expert").alias("n"), (F.max("fit_error") - F.min("fit_error")).alias("spread"))
    used = (F.col("n") == 7) & (F.col("spread") > 0)
    return g.agg(F.count_if(F.col("n") < 7).alias("incomplete"), F.count_if(used).alias("used"), F.round(F.avg(F.when(used, F.col("spread"))), 3).alias("mean"))


@query("SELECT user_id, round(sum(value) / greatest(1e-9, epoch(max(ts)) - epoch(min(ts))), 9) AS rate FROM events GROUP BY user_id")
def a33_throughput(spark, d):
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    return table(spark, d, "events").groupBy("user_id").agg(F.round(F.sum("value") / F.greatest(F.lit(1e-9), seconds(F.max("ts")) - seconds(F.min("ts"))), 9).alias("rate"))


@query("SELECT p_type AS licence, count(*) AS n FROM part GROUP BY 1")
def a35_licence_counts(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_type").alias("licence")).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey AS id, len(list_distinct(list(l_returnflag))) AS sources FROM lineitem GROUP BY 1")
def a17_distinct_in_list(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.size(F.array_distinct(F.collect_list("l_returnflag"))).cast("long").alias("sources"))


@query("""WITH s AS (SELECT o_custkey AS k, o_orderdate AS t, o_orderkey AS i, o_totalprice AS v FROM orders), r AS (SELECT k, max(v) OVER (PARTITION BY k ORDER BY t, i ROWS UNBOUNDED PRECEDING) - v AS back FROM s)
SELECT k, round(max(back), 2) AS reversal FROM r GROUP BY k""")
def w8_largest_reversal(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    o = table(spark, d, "orders").withColumn("back", F.max("o_totalprice").over(w) - F.col("o_totalprice"))
    return o.groupBy(F.col("o_custkey").alias("k")).agg(F.round(F.max("back"), 2).alias("reversal"))


@query("""SELECT l_orderkey AS k, CAST(floor((1 - product(1 - l_discount)) * 1e6 + 0.3141592653) AS BIGINT) AS covered FROM lineitem GROUP BY 1""")
def w9_cumulative_fractions(spark, d):
    """y grows by the fraction of the room that remains; in millionths, cut where no product of cents can lie."""
    g = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list("l_discount").alias("f"))
    return g.select("k", F.floor(F.aggregate("f", F.lit(0.0), lambda y, f: y + (1 - y) * f) * 1e6 + 0.3141592653).alias("covered"))


@query("SELECT o_custkey AS k, o_orderkey AS i, round(o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 2) AS step FROM orders")
def w10_steps(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("i"), F.round(F.col("o_totalprice") - F.lag("o_totalprice").over(w), 2).alias("step"))


@query("SELECT vec_id AS photo, array_to_string(list_transform(list_slice(list_sort(list_transform(list_zip(CAST(embedding AS DOUBLE[]), range(64)), lambda z: (-abs(z[1]), z[2]))), 1, 3), lambda z: z[2]::VARCHAR), ',') AS places FROM embeddings")
def t7_top_by_size(spark, d):
    pairs = F.transform("vector", lambda x, i: F.struct((-F.abs(x)).alias("a"), i.alias("i")))
    return photos(spark, d).select("photo", F.array_join(F.transform(F.slice(F.array_sort(pairs), 1, 3), lambda x: x["i"].cast("string")), ",").alias("places"))


@query(f"WITH {EDITS_SQL} SELECT photo, arg_min(edit, (fit_error, expert, edit)) AS best, arg_max(edit, (fit_error, -expert, -edit)) AS worst FROM edits GROUP BY photo")
def t10_argmin_argmax(spark, d):
    return edits(spark, d).groupBy("photo").agg(F.min_by("edit", F.struct("fit_error", "expert", "edit")).alias("best"), F.max_by("edit", F.struct(F.col("fit_error"), -F.col("expert"), -F.col("edit"))).alias("worst"))


@query("SELECT (SELECT count(*) FROM part) + (SELECT count(*) FROM supplier) AS rows, (SELECT count(*) FROM (SELECT p_partkey FROM part UNION SELECT s_suppkey FROM supplier)) AS names")
def s2_union_overlap(spark, d):
    u = table(spark, d, "part").select(F.col("p_partkey").alias("k")).unionAll(table(spark, d, "supplier").select("s_suppkey"))
    return u.agg(F.count("*").alias("rows"), F.countDistinct("k").alias("names"))


@query("""SELECT doc_id, CASE WHEN len(v) = 1 THEN v[1] END AS word FROM (SELECT doc_id, list_sort(list_distinct(list_intersect(string_split(lower(text), ' '), ['the', 'die', 'les', 'los']))) AS v FROM documents)""")
def s6_single_vocabulary_word(spark, d):
    v = F.array_intersect(F.split(F.lower("text"), " "), F.array(*map(F.lit, ("the", "die", "les", "los"))))
    return table(spark, d, "documents").select("doc_id", F.when(F.size(v) == 1, F.get(v, F.lit(0))).alias("word"))


@query("SELECT c_custkey AS k, c_custkey * 7 % 100 < 20 AS held_out FROM customer WHERE c_custkey % 13 <> 0")
def o8_split_membership(spark, d):
    return table(spark, d, "customer").where("c_custkey % 13 <> 0").select(F.col("c_custkey").alias("k"), (F.col("c_custkey") * 7 % 100 < 20).alias("held_out"))


@query("SELECT c_custkey AS k FROM customer WHERE c_custkey % 13 <> 0 ORDER BY sha256('7|' || c_custkey), c_custkey LIMIT 50")
def o7_seeded_sample(spark, d):
    """A sample without replacement in the order of a seeded hash; exclusions go first."""
    c = table(spark, d, "customer").where("c_custkey % 13 <> 0").select(F.col("c_custkey").alias("k"))
    return c.orderBy(F.sha2(F.concat(F.lit("7|"), F.col("k").cast("string")), 256), "k").limit(50)


@query(f"WITH {PIXELS_SQL} SELECT image, place, round(g + (g * 1023 - least(1022, floor(g * 1023))) * 0, 6) AS v FROM pixels")
def p7_table_lookup(spark, d):
    """Interpolation in the identity table gives the value back."""
    from lumenframe.functions.colour import lookup

    return pixels(spark, d).select("image", "place", F.round(lookup(F.col("g"), [i / 1023 for i in range(1024)]), 6).alias("v"))


@query("SELECT l_orderkey AS k, l_linenumber AS n, CASE WHEN l_discount <= 1.0 / 32 THEN round(l_discount / 16, 8) ELSE round(pow(l_discount, 1.8), 8) END AS linear FROM lineitem")
def p14_romm_decode(spark, d):
    x = F.col("l_discount")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.round(F.when(x <= 1 / 32, x / 16).otherwise(F.pow(x, F.lit(1.8))), 8).alias("linear"))


@query("SELECT l_orderkey, count(*) AS n, bool_and(ok) AS rising FROM (SELECT l_orderkey, l_quantity > coalesce(lag(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_linenumber, l_extendedprice), -1) AS ok FROM lineitem) GROUP BY 1")
def ar2_rising_points(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("l_quantity")).alias("x"))
    gaps = F.zip_with(F.slice("x", 2, F.size("x")), F.slice("x", 1, F.size("x") - 1), lambda b, a: b - a)
    return g.select("l_orderkey", "n", F.when(F.size("x") < 2, True).otherwise(F.forall(gaps, lambda v: v > 0)).alias("rising"))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN 'empty' WHEN n_chars > 3000 THEN 'too large' WHEN lang NOT IN ('en', 'de') THEN 'type' END AS refused FROM documents")
def st12_upload_rules(spark, d):
    refused = F.when(F.col("doc_id") % 4 == 0, "empty").when(F.col("n_chars") > 3000, "too large").when(~F.col("lang").isin("en", "de"), "type")
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), refused.alias("refused"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN '.png' WHEN 1 THEN '.webp' WHEN 2 THEN '.tif' ELSE '.jpg' END AS ext FROM pages")
def st11_extension(spark, d):
    from lumenframe.functions.text import extension

    kind = F.get(F.array(*map(F.lit, ("image/PNG", "Image/webp", "image/tiff", "image/jpeg"))), (F.col("page_id") % 4).cast("int"))
    return table(spark, d, "pages").select("page_id", extension(kind).alias("ext"))


@query("SELECT name, NOT (name LIKE 'fp-%' OR name LIKE 'probe-%' OR name LIKE '%-fp-%') AS same_space FROM (SELECT CASE p_partkey % 4 WHEN 0 THEN 'fp-x' WHEN 1 THEN 'probe-518' WHEN 2 THEN 'mmr-fp-1' ELSE 'average' END || p_partkey AS name FROM part)")
def x16_same_space(spark, d):
    name = F.concat(F.get(F.array(*map(F.lit, ("fp-x", "probe-518", "mmr-fp-1", "average"))), (F.col("p_partkey") % 4).cast("int")), F.col("p_partkey").cast("string"))
    return table(spark, d, "part").select(name.alias("name"), (~name.rlike("^(fp-|probe-)|-fp-")).alias("same_space"))


@query("SELECT k, i FROM (SELECT p_partkey AS k, row_number() OVER (ORDER BY p_partkey) - 1 AS i FROM part)")
def w2_global_numbering(spark, d):
    return numbered(table(spark, d, "part").select(F.col("p_partkey").alias("k")), "k").select("k", "i")


@query("SELECT c_custkey AS k, CASE WHEN trim(c_name) = '' OR length(trim(c_name)) > 200 THEN NULL ELSE trim(c_name) END AS name FROM customer")
def x27_clean_name(spark, d):
    t = F.trim("c_name")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.when((t != "") & (F.length(t) <= 200), t).alias("name"))


@query("""SELECT e.event_id, max(p.ts) AS seen FROM events e LEFT JOIN events p ON p.user_id = e.user_id AND p.event_type = 'view' AND p.ts <= e.ts WHERE e.event_type = 'purchase' GROUP BY 1""")
def ext_asof_join(spark, d):
    """The last view before each purchase, by one running maximum (extension)."""
    e = table(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy(F.col("ts"), F.col("event_type") != "view").rowsBetween(Window.unboundedPreceding, 0)
    return e.withColumn("seen", F.max(F.when(F.col("event_type") == "view", F.col("ts"))).over(w)).where("event_type = 'purchase'").select("event_id", "seen")
