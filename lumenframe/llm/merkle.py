"""Merkle manifest of a dataset: a tree of digests for each group of rows, and one over the groups.

Everything is SQL functions. Leaves get their places by a range partitioning that is written
once, with counts before each range, so no task holds a whole group. Blocks of FAN ** levels
consecutive nodes are gathered as ordered arrays and collapsed there, level by level, with
sequence, transform and slice; the blocks' roots are the nodes of the next round, until each
group is left with one. Paths then come down the same way: a block's siblings are worked out
inside its arrays, and each block meets its own path from above, one row to one.

A node's digest is H, the lower-case hex SHA-256 of its children's hex digests laid end to end.
Levels are collapsed while a group has more than one node, so a group of one has no level.

Defined results: a null in any column is written `-`; a null group is one of its own and comes
first; null keys come first in their group; rows with equal keys are ordered by their leaves,
and wholly repeated rows each have a leaf; an empty table has no rows and no root; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cluster import prepared, small_or_shuffled, written

FAN = 16
#: Levels that one block collapses: FAN ** LEVELS nodes to a block.
LEVELS = 2
#: Rows up to which the table of ranges (one row for each range and group in it) is broadcast.
BROADCAST_RANGES = 100_000
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def encoded(value: Column) -> Column:
    """`-`, or the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(columns: tuple[str, ...] = COLUMNS, **instead: Column) -> Column:
    """A row's leaf, with other values in place of some columns."""
    return digest(*[encoded(instead.get(c, F.col(c))) for c in columns])


def in_order(nodes: DataFrame) -> DataFrame:
    """nodes (g, k, digest, load) with place, from 0 by k and digest in each g, and total, the nodes of g."""
    rows = nodes.withColumn("salt", F.monotonically_increasing_id())
    order = ["g", "k", "digest", "salt"]  # the salt lets equal rows, which can change places, fall into several ranges
    ranged = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("salt").withColumn("id", F.monotonically_increasing_id()), "leaves")
    part, at = F.shiftright("id", 33), F.col("id").bitwiseAND((1 << 33) - 1)
    ranged = ranged.select("g", "digest", "load", part.alias("part"), at.alias("at"))
    group = Window.partitionBy("g")
    counts = ranged.groupBy("g", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = counts.select("g", "part", (F.sum("n").over(group.orderBy("part")) - F.col("n") - F.col("first")).alias("shift"), F.sum("n").over(group).alias("total"))
    before = written(before, "ranges")
    return ranged.join(small_or_shuffled(before, BROADCAST_RANGES), ["g", "part"]).select("g", (F.col("at") + F.col("shift")).alias("place"), "total", "digest", "load")


def _run(nodes: Column, i: Column) -> Column:
    return F.slice(nodes, i * FAN + 1, FAN)


def _siblings(nodes: Column, at: Column) -> Column:
    """The digests left and right of node number at in its run."""
    inside = (at % FAN).cast("int")
    first = (at - inside).cast("int")
    return F.struct(F.array_join(F.slice(nodes, first + 1, inside), "").alias("left"), F.array_join(F.slice(nodes, first + inside + 2, FAN - 1 - inside), "").alias("right"))


def _places(nodes: Column) -> Column:
    return F.sequence(F.lit(0), (F.size(nodes) - 1).cast("int"))


def _collapsed(nodes: Column) -> Column:
    """The next level: the digest of each run."""
    runs = F.sequence(F.lit(0), (F.ceil(F.size(nodes) / FAN) - 1).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(_run(nodes, i), ""), 256))


def _blocks(nodes: DataFrame, levels: int) -> DataFrame:
    """Blocks of nodes (g, place, total, digest, load): g, block, total, loads, and the arrays l0 to l{levels} with the last a single root."""
    width = FAN**levels
    gathered = nodes.groupBy("g", F.floor(F.col("place") / width).alias("block"), "total").agg(F.sort_array(F.collect_list(F.struct("place", "digest", "load"))).alias("x"))
    out = gathered.select("g", "block", "total", F.col("x.load").alias("loads"), F.col("x.digest").alias("l0"))
    for j in range(levels):
        out = out.withColumn(f"l{j + 1}", F.when(_active(j, width), _collapsed(F.col(f"l{j}"))).otherwise(F.col(f"l{j}")))
    return out


def _active(j: int, width: int) -> Column:
    """Whether level j of a block is collapsed: always in a group of several blocks, else while nodes remain."""
    return (F.col("total") > width) | (F.size(f"l{j}") > 1)


def climb(nodes: DataFrame, levels: int = LEVELS) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of each round, and the root of each group (g, root)."""
    width, rounds, roots = FAN**levels, [], None
    while True:
        blocks = written(_blocks(nodes, levels), "blocks")
        rounds.append(blocks)
        root = F.col(f"l{levels}")[0]
        done = blocks.where(F.col("total") <= width).select("g", root.alias("root"))
        roots = done if roots is None else roots.unionByName(done)
        more = blocks.where(F.col("total") > width)
        if not more.limit(1).count():
            return rounds, roots
        nodes = more.select("g", F.col("block").alias("place"), F.ceil(F.col("total") / width).alias("total"), root.alias("digest"), F.lit(None).cast("int").alias("load"))


def _down(blocks: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """g, place, digest, load, top and the whole path of each node, from the path and top of each block."""
    width = FAN**levels
    met = blocks.join(above.withColumnRenamed("place", "block"), ["g", "block"])

    def path(i: Column) -> Column:
        """Siblings of run i at the levels above its own nodes, in this block and above it."""
        own = [F.when(_active(j, width), _siblings(F.col(f"l{j}"), F.floor(i / FAN ** (j - 1)))) for j in range(1, levels)]
        return F.concat(F.filter(F.array(*own), lambda x: x.isNotNull()), "path") if own else F.col("path")

    runs = F.transform(_places(F.col("l1")), lambda i: F.struct(i.alias("i"), _run(F.col("loads"), i).alias("loads"), _run(F.col("l0"), i).alias("nodes"), path(i).alias("path")))
    each = met.select("g", "block", "top", _active(0, width).alias("active"), F.explode(runs).alias("r"))
    inside = F.transform(_places(F.col("r.nodes")), lambda p: F.struct((F.col("block") * width + F.col("r.i") * FAN + p).alias("place"), F.col("r.nodes")[p].alias("digest"), F.col("r.loads")[p].alias("load"), _siblings(F.col("r.nodes"), p).alias("own")))
    out = each.select("g", "top", "active", F.col("r.path").alias("path"), F.explode(inside).alias("n"))
    return out.select("g", "n.place", "n.digest", "n.load", "top", F.when(F.col("active"), F.concat(F.array("n.own"), "path")).otherwise(F.col("path")).alias("path"))


def descend(rounds: list[DataFrame], above: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The nodes of the first round with their paths; above: g, path and top of each group."""
    found = None
    for blocks in reversed(rounds):
        ended = blocks.where(F.col("total") <= FAN**levels).select("g")
        start = ended.join(above, "g").select("g", F.lit(0).cast("long").alias("place"), "path", "top")
        found = _down(blocks, start if found is None else start.unionByName(found.select("g", "place", "path", "top")), levels)
    return found


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "source", leaf: Column | None = None, levels: int = LEVELS, **carried: Column) -> DataFrame:
    """For each row its key, leaf, subroot, root, path (from the leaf up: the siblings left and right of each level), and the carried columns."""
    prepared(docs.sparkSession)
    group_key = F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit(""))  # null first
    load = F.struct(F.col(key).alias(key), *[c.alias(name) for name, c in carried.items()])
    leaves = docs.select(group_key.alias("g"), F.col(key).alias("k"), (leaf_of() if leaf is None else leaf).alias("digest"), load.alias("load"))
    rounds, subroots = climb(in_order(leaves), levels)
    subroots = written(subroots, "subroots")
    # the same again over the groups, as one group of its own
    tree, top = climb(in_order(subroots.select(F.lit("").alias("g"), F.col("g").alias("k"), F.col("root").alias("digest"), F.col("g").alias("load"))), levels)
    root = top.first()
    no_path = F.array().cast("array<struct<left: string, right: string>>")
    above = descend(tree, top.select("g", no_path.alias("path"), F.col("root").alias("top")), levels).select(F.col("load").alias("g"), "path", F.col("digest").alias("top"))
    found = descend(rounds, written(above, "group-paths"), levels)
    return found.select("load.*", F.col("digest").alias("leaf"), F.col("top").alias("subroot"), F.lit(root.root if root else None).cast("string").alias("root"), "path")


def proof() -> Column:
    """H of a path's siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform("path", lambda x: F.concat(x["left"], x["right"])), ""), 256)


def folded(leaf: Column) -> Column:
    """The root that a leaf and a path give."""
    return F.aggregate("path", leaf, lambda below, x: digest(x["left"], below, x["right"]))


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """Every document's proof, folded from a leaf recomputed after a fifth of the texts were lower-cased."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    chosen = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    tampered = F.when(chosen, leaf_of(text=F.translate("text", upper, upper.lower())))
    rows = manifest(docs, tampered=tampered).withColumn("folded_root", folded(F.coalesce("tampered", "leaf")))
    return rows.select("doc_id", "leaf", "subroot", "root", proof().alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
