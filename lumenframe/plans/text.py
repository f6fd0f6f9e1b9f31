"""Catalogue text, JSON documents, recipes and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.functions import recipes, text
from lumenframe.operators.distinct import by_distinct
from lumenframe.plans.registry import query
from lumenframe.plans.tables import table

_CATALOGUE_SQL = """cat AS (SELECT doc_id, 'Exposure = ' || (doc_id % 7) || '.5, Clarity2012 = ' || CASE WHEN doc_id % 4 = 0 THEN '-999999' WHEN doc_id % 4 = 1 THEN '12' ELSE '0' END || ', ToneCurveName = "' || CASE WHEN doc_id % 3 = 0 THEN 'Medium Contrast' ELSE 'Linear' END
 || '"' || CASE WHEN doc_id % 5 = 0 THEN ', ConvertToGrayscale = true' WHEN doc_id % 5 = 1 THEN ', CropTop = 0.1' WHEN doc_id % 5 = 2 THEN ', PaintBasedCorrections = { }' ELSE '' END || ', Exposure = ' || (doc_id % 3) AS raw FROM documents)"""


def _catalogue(spark, d):
    i = F.col("doc_id")
    s = lambda x: (x).cast("string")
    raw = F.concat(
        F.lit("Exposure = "), s(i % 7), F.lit(".5, Clarity2012 = "), F.when(i % 4 == 0, "-999999").when(i % 4 == 1, "12").otherwise("0"), F.lit(', ToneCurveName = "'), F.when(i % 3 == 0, "Medium Contrast").otherwise("Linear"), F.lit('"'),
        F.when(i % 5 == 0, ", ConvertToGrayscale = true").when(i % 5 == 1, ", CropTop = 0.1").when(i % 5 == 2, ", PaintBasedCorrections = { }").otherwise(""), F.lit(", Exposure = "), s(i % 3),
    )
    return table(spark, d, "documents").select("doc_id", raw.alias("raw"))


@query(f"WITH {_CATALOGUE_SQL} SELECT doc_id, (doc_id % 3)::VARCHAR AS exposure, CASE WHEN doc_id % 3 = 0 THEN 'Medium Contrast' ELSE 'Linear' END AS curve FROM cat")
def st1_settings(spark, d):
    c = _catalogue(spark, d).withColumn("m", text.settings_map(F.col("raw")))
    return c.select("doc_id", F.element_at("m", "Exposure").alias("exposure"), text.unquoted(F.element_at("m", "ToneCurveName")).alias("curve"))


@query(f"WITH {_CATALOGUE_SQL} SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'grayscale' WHEN doc_id % 5 = 2 THEN 'local' WHEN doc_id % 5 = 1 THEN 'crop' WHEN doc_id % 11 = 0 THEN 'rotated' END AS reason FROM cat")
def f4_exclusion_reason(spark, d):
    return _catalogue(spark, d).select("doc_id", text.exclusion_reason(text.settings_map(F.col("raw")), F.col("raw"), F.col("doc_id") % 11 == 0).alias("reason"))


@query(f"WITH {_CATALOGUE_SQL} SELECT doc_id, array_to_string(list_filter([CASE WHEN doc_id % 4 = 1 THEN 'clarity' END, CASE WHEN doc_id % 3 = 0 THEN 'medium-contrast-curve' END], lambda x: x IS NOT NULL), '|') AS notes FROM cat")
def f5_notes(spark, d):
    return _catalogue(spark, d).select("doc_id", F.array_join(text.notes(text.settings_map(F.col("raw"))), "|").alias("notes"))


@query(f"""WITH {_CATALOGUE_SQL}, kv AS (SELECT doc_id, unnest(regexp_extract_all(raw, '(\\w+)\\s*=\\s*("[^"]*"|-?[\\d.]+|true|false)', 1)) AS k, unnest(regexp_extract_all(raw, '(\\w+)\\s*=\\s*("[^"]*"|-?[\\d.]+|true|false)', 2)) AS v FROM cat)
SELECT k, count(*) AS n, min(TRY_CAST(v AS DOUBLE)) AS lo, max(TRY_CAST(v AS DOUBLE)) AS hi, round(avg(TRY_CAST(v AS DOUBLE)), 4) AS mean FROM kv GROUP BY k""")
def a20_key_frequency(spark, d):
    keys, values = (F.regexp_extract_all("raw", F.lit(text.SETTING), F.lit(i)) for i in (1, 2))
    kv = _catalogue(spark, d).select(F.explode(F.arrays_zip(keys.alias("k"), values.alias("v"))).alias("x")).select("x.k", F.col("x.v").try_cast("double").alias("v"))
    return kv.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.round(F.avg("v"), 4).alias("mean"))


@query("SELECT source AS word, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, word LIMIT 10")
def a21_keyword_frequency(spark, d):
    return table(spark, d, "documents").groupBy(F.col("source").alias("word")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "word").limit(10)


@query("""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(replace(text, 'a', chr(1072)), '[\\p{L}]+')) AS word FROM documents)
SELECT doc_id, count(*) AS n FROM w WHERE regexp_matches(word, '\\p{Cyrillic}') AND regexp_matches(word, '\\p{Latin}') GROUP BY doc_id""")
def st13_mixed_script_words(spark, d):
    """Words with Cyrillic and Latin letters; the texts get a Cyrillic letter for each a, so there are some."""
    words = F.regexp_extract_all(F.replace(F.col("text"), F.lit("a"), F.lit("а")), F.lit(r"(\p{L}+)"), F.lit(1))
    mixed = F.filter(words, lambda w: w.rlike(r"\p{IsCyrillic}") & w.rlike(r"\p{IsLatin}"))
    return table(spark, d, "documents").select("doc_id", F.size(mixed).cast("long").alias("n")).where("n > 0")


@query("SELECT page_id, replace(url_encode('a b/' || url), '%2F', '/') AS path FROM pages")
def st7_path_quoting(spark, d):
    return table(spark, d, "pages").select("page_id", text.path_quoted(F.concat(F.lit("a b/"), F.col("url"))).alias("path"))


@query("""SELECT page_id, CASE WHEN stem = '' THEN 'Untitled 2026-01-02' ELSE left(stem, 120) END AS name
FROM (SELECT page_id, trim(regexp_replace(regexp_extract(split_part(url, '?', 1), '([^/\\\\]*)$', 1), '\\.[^.]*$', '')) AS stem FROM pages)""")
def st10_project_name(spark, d):
    return table(spark, d, "pages").select("page_id", text.project_name(F.split_part("url", F.lit("?"), F.lit(1)), F.to_date(F.lit("2026-01-02"))).alias("name"))


@query("SELECT doc_id, 'corpus/' || source || '/after512-' || lang || '.png' AS key, 'fit:' || lang AS step FROM documents")
def st8_key_templates(spark, d):
    return table(spark, d, "documents").select("doc_id", F.format_string("corpus/%s/after512-%s.png", "source", "lang").alias("key"), F.concat(F.lit("fit:"), F.col("lang")).alias("step"))


@query("SELECT p_partkey AS k, round(CASE WHEN p_size % 5 = 0 THEN 0 ELSE 1e6 / (p_size * 100) - 1e6 / 5000 END, 6) AS shift FROM part")
def m2_mired_shift(spark, d):
    kelvin = F.when(F.col("p_size") % 5 == 0, 0.0).otherwise(F.col("p_size") * 100.0)
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.round(text.mired_shift(kelvin, F.lit(5000.0)), 6).alias("shift"))


@query("""SELECT p_partkey AS k, CAST(CASE WHEN 512.0 / greatest(w, h) >= 1 THEN w ELSE greatest(1, round_even(w * (512.0::DOUBLE / greatest(w, h)), 0)) END AS INTEGER) AS width, CAST(CASE WHEN 512.0 / greatest(w, h) >= 1 THEN h ELSE greatest(1, round_even(h * (512.0::DOUBLE / greatest(w, h)), 0)) END AS INTEGER) AS height
FROM (SELECT p_partkey, p_size * 64 AS w, 1024 AS h FROM part)""")
def m4_target_size(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), text.fitted_size((F.col("p_size") * 64).cast("int"), F.lit(1024), 512).alias("s"))
    return p.select("k", "s.width", "s.height")


@query("SELECT p_partkey AS k, least(1000.0::DOUBLE, greatest(-1000.0::DOUBLE, p_retailprice)) AS v FROM part")
def m1_clip(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.least(F.lit(1000.0), F.greatest(F.lit(-1000.0), F.col("p_retailprice"))).alias("v"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def js1_json_field(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("SELECT event_id, event_id % 3 <> 0 AS parsed FROM events")
def js3_tolerant_json(spark, d):
    text_ = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("{"), F.col("props"))).otherwise(F.col("props"))
    return table(spark, d, "events").select("event_id", F.try_parse_json(text_).isNotNull().alias("parsed"))


_CHOICES = """log AS (SELECT event_id, event_id % 4 AS index, CASE WHEN event_id % 5 = 0 THEN 2 ELSE 1 END AS version FROM events)"""


@query(f"WITH {_CHOICES} SELECT event_id, CASE WHEN version = 1 AND index < 3 THEN 'r' || index END AS recipe FROM log")
def js4_chosen_recipe(spark, d):
    log = F.to_json(F.struct(F.when(F.col("event_id") % 5 == 0, 2).otherwise(1).alias("log"), (F.col("event_id") % 4).alias("chosen_index"), F.array(*[F.lit(f"r{i}") for i in range(3)]).alias("suggestions")))
    e = table(spark, d, "events").select("event_id", F.from_json(log, "log int, chosen_index int, suggestions array<string>").alias("x"))
    return e.select("event_id", F.when((F.col("x.log") == 1) & (F.col("x.chosen_index") >= 0), F.get("x.suggestions", F.col("x.chosen_index"))).alias("recipe"))


@query("""SELECT event_id, '{"log":1,"chosen_index":' || CASE WHEN event_id % 4 = 3 THEN 'null' ELSE (event_id % 4)::VARCHAR END || ',"suggestions":["a","b"]}' AS log, CASE WHEN event_id % 4 = 3 THEN 'Rejected' ELSE 'Accepted' END AS outcome FROM events""")
def js5_choice_log(spark, d):
    index = F.when(F.col("event_id") % 4 != 3, F.col("event_id") % 4)
    log = F.to_json(F.struct(F.lit(1).alias("log"), index.alias("chosen_index"), F.array(F.lit("a"), F.lit("b")).alias("suggestions")), {"ignoreNullFields": "false"})
    return table(spark, d, "events").select("event_id", log.alias("log"), F.when(index.isNull(), "Rejected").otherwise("Accepted").alias("outcome"))


def _recipes(spark, d):
    q = F.col("l_quantity").cast("int")
    one = F.format_string('{"schema":%d,"tone":{"exposure":%.1f,"contrast":%d}%s}', F.when(q % 10 == 0, 2).otherwise(1), (q % 12).cast("double"), q * 3, F.when(q % 7 == 0, ',"extra":1').when(q % 7 == 1, ',"tone_curve":{"points":[[0,0],[0.5,0.4],[1,1]]}').when(q % 7 == 2, ',"tone_curve":{"points":[[0,0],[0.5,0.4],[0.5,1]]}').otherwise(""))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", q.alias("q"), one.alias("recipe"))


@query("SELECT l_orderkey, l_linenumber, q, q % 10 <> 0 AND q % 12 <= 5 AND q * 3 <= 100 AND q % 7 NOT IN (0, 2) AS valid FROM (SELECT l_orderkey, l_linenumber, CAST(trunc(l_quantity) AS INTEGER) AS q FROM lineitem)")
def js8_recipe_valid(spark, d):
    return by_distinct(_recipes(spark, d), "recipe", {"valid": recipes.valid(F.col("recipe"))}).select("l_orderkey", "l_linenumber", "q", "valid")


@query("""SELECT DISTINCT q, '{"schema":' || CASE WHEN q % 10 = 0 THEN 2 ELSE 1 END || ',"white_balance":{"temperature":0.0,"tint":0.0},"tone":{"exposure":' || (q % 12) || '.0,"contrast":' || (q * 3) || '.0,"highlights":0.0,"shadows":0.0,"whites":0.0,"blacks":0.0},"color":{"saturation":0.0,"vibrance":0.0},"tone_curve":{"points":[[0.0,0.0],' || CASE q % 7 WHEN 1 THEN '[0.5,0.4],[1.0,1.0]' WHEN 2 THEN '[0.5,0.4],[0.5,1.0]' ELSE '[1.0,1.0]' END || ']}}' AS canonical
FROM (SELECT CAST(trunc(l_quantity) AS INTEGER) AS q FROM lineitem)""")
def js7_canonical_recipe(spark, d):
    # equal texts meet before they are parsed
    return _recipes(spark, d).select("q", "recipe").distinct().select("q", recipes.canonical(F.col("recipe")).alias("canonical")).distinct()


#: The curve through (0.5, 0.4) has secants 0.8 and 1.2 and tangents 0.8, 1 and 1.2.
_CURVE_OFF = ("0.5 * 0.8 * 0.125 + 0.4 * 0.5 - 0.5 * 1.0 * 0.125 - 0.25", "0.4 - 0.5", "0.4 * 0.5 + 0.5 * 1.0 * 0.125 + 0.5 - 0.5 * 1.2 * 0.125 - 0.75")


@query(f"SELECT DISTINCT q, round((q % 12) / 5.0 + q * 3 / 100.0 + CASE q % 7 WHEN 1 THEN {' + '.join(_CURVE_OFF)} WHEN 2 THEN NULL ELSE 0 END, 6) AS total FROM (SELECT CAST(trunc(l_quantity) AS INTEGER) AS q FROM lineitem)")
def v6_recipe_components(spark, d):
    total = F.aggregate(recipes.components(F.col("recipe")), F.lit(0.0), lambda s, x: s + x)
    return _recipes(spark, d).select("q", "recipe").distinct().select("q", F.round(total, 6).alias("total")).distinct()


@query("SELECT l_orderkey, l_linenumber, printf('%+.2f', l_discount) AS signed, left(l_linestatus || l_returnflag, 1) AS cut FROM lineitem")
def st14_signed_numbers(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.format_string("%+.2f", "l_discount").alias("signed"), F.substring(F.concat("l_linestatus", "l_returnflag"), 1, 1).alias("cut"))
