"""The evaluation of arms: each chooses suggestions for every photo of a query set, and every choice is scored.

Arms are data: a name, how candidates are chosen, how many neighbours the pool holds, and which
part of the fingerprint tells them apart. Their choices form one table (arm, query, edit, place),
which is scored once: joins on the photo and the edit, pairs only among a photo's few suggestions
and its few experts.

Defined results: a photo without a pair of experts has no scale and no row; an arm that chooses
nothing for a photo has a row there with no closeness and an undecided hit; a ratio without a
positive scale is null.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.vectors import euclidean

from . import selection
from .evaluation import ratio
from .ranking import distributions, quantiles

RANDOM_SEED = 20260913


@dataclass(frozen=True)
class Arm:
    name: str
    choose: Callable[[DataFrame], DataFrame] | None
    neighbours: int = 50
    #: First place and length of the part of the fingerprint that is compared; all of it without one.
    ruler: tuple[int, int] | None = None
    note: str = ""


#: Arms whose choice needs more than a pool: one fixed edit, and the photo's own edits.
AVERAGE, ORACLE = Arm("average", None, note="floor: one edit for all"), Arm("oracle", None, note="ceiling: the photo's own edits")


def arms(part: tuple[int, int], rest: tuple[int, int]) -> dict[str, Arm]:
    """The arms by name; part and rest are the two blocks of a fingerprint."""
    mmr = lambda weight: lambda pool: selection.marginal_relevance(pool, weight=weight)
    return {
        a.name: a
        for a in (
            Arm("top", selection.top, note="baseline: the nearest"),
            Arm("top-per-scene", lambda pool: selection.top(pool, one_per_photo=True), note="baseline: one edit of a scene"),
            Arm("top-per-scene-bestfit", lambda pool: selection.top(pool, one_per_photo=True, best_fit=True), note="one edit of a scene, the best fit"),
            Arm("random", lambda pool: selection.random_choice(pool, seed=RANDOM_SEED), note="floor: three at random"),
            AVERAGE,
            *(Arm(f"mmr-{w}", mmr(w)) for w in (0.3, 0.5, 0.7)),
            Arm("kmeans", selection.grouped, note="three groups, the best of each"),
            Arm("mmr-0.5-k20", mmr(0.5), neighbours=20),
            Arm("mmr-0.5-k100", mmr(0.5), neighbours=100),
            ORACLE,
            Arm("fp-recipe", mmr(0.5), ruler=part, note="compared by the recipe's numbers alone"),
            Arm("fp-statistics", mmr(0.5), ruler=rest, note="compared by the colour statistics alone"),
            Arm("kmeans-fp-recipe", selection.grouped, ruler=part, note="groups by the recipe's numbers alone"),
        )
    }


def choices(chosen_arms: list[Arm], pools: dict[int, DataFrame], queries: DataFrame, own: DataFrame, average: int) -> DataFrame:
    """arm, query, edit, place; pools by number of neighbours; own: query, edit, place of the photos' own edits."""
    parts = []
    for arm in chosen_arms:
        if arm.name == AVERAGE.name:
            got = selection.always(queries, average)
        elif arm.name == ORACLE.name:
            got = own.where(F.col("place") <= 3).select("query", "edit", "place")
        else:
            pool = pools[arm.neighbours]
            if arm.ruler:
                pool = pool.withColumn("fingerprint", F.slice("fingerprint", arm.ruler[0] + 1, arm.ruler[1]))
            got = arm.choose(pool)
        parts.append(got.select(F.lit(arm.name).alias("arm"), "query", "edit", F.col("place").cast("int").alias("place")))
    return reduce(DataFrame.unionAll, parts)


def _spread(items: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """keys and the distance of every pair of a group; groups are a photo's few suggestions or experts."""
    one = items.select(*keys, F.col(order).alias("_a"), F.col(value).alias("_x"))
    two = items.select(*keys, F.col(order).alias("_b"), F.col(value).alias("_y"))
    return one.join(two, keys).where("_a < _b").select(*keys, euclidean(F.col("_x"), F.col("_y")).alias("away"))


def expert_scales(experts: DataFrame) -> DataFrame:
    """query, mean and median difference of its experts' colours, and mean distance of their fingerprints."""
    colours, prints = (_spread(experts, ["query"], "expert", c) for c in ("colour", "fingerprint"))
    means = colours.groupBy("query").agg(F.avg("away").alias("human_mean"))
    medians = quantiles(colours, "query", "away", {"threshold": 0.5})
    return means.join(medians, "query").join(prints.groupBy("query").agg(F.avg("away").alias("fingerprint_mean")), "query")


def score(chosen: DataFrame, known: DataFrame, experts: DataFrame, pool_sizes: DataFrame, arm_names: list[str]) -> DataFrame:
    """One row for each arm and photo that has a scale.

    known: edit, photo, fingerprint and colour of every edit that can be chosen; experts: query,
    expert, fingerprint, colour of a photo's own edits, one of each expert; pool_sizes: arm,
    query, pool_size.
    """
    scales = expert_scales(experts)
    every = scales.select("query").withColumn("arm", F.explode(F.array(*map(F.lit, arm_names))))
    items = chosen.join(known, "edit")
    keys = ["arm", "query"]
    counts = items.groupBy(*keys).agg(F.count("*").alias("suggestions"), F.count_distinct("photo").alias("sources"))
    rendered, prints = (_spread(items, keys, "place", c).groupBy(*keys).agg(F.avg("away").alias(name)) for c, name in (("colour", "diversity_rendered"), ("fingerprint", "diversity_fingerprint")))
    beside = items.select(*keys, F.col("colour").alias("_c"), F.col("fingerprint").alias("_f")).join(experts, "query")
    close = beside.groupBy(*keys).agg(F.min(euclidean(F.col("_c"), F.col("colour"))).alias("closeness"), F.min(euclidean(F.col("_f"), F.col("fingerprint"))).alias("closeness_recipe"))
    out = every
    for part in (pool_sizes, counts, rendered, prints, close):
        out = out.join(part, keys, "left")
    out = out.join(scales, "query")
    return out.select(
        *keys, F.coalesce("pool_size", F.lit(0)).alias("pool_size"), F.coalesce("suggestions", F.lit(0)).alias("suggestions"), "sources", "diversity_rendered", "diversity_fingerprint",
        ratio(F.col("diversity_rendered"), F.col("human_mean")).alias("diversity_ratio"), ratio(F.col("diversity_fingerprint"), F.col("fingerprint_mean")).alias("fingerprint_ratio"),
        "closeness", "closeness_recipe", "threshold", (F.col("closeness") < F.col("threshold")).alias("hit"),
    )


#: What is reported of the scores of an arm, the gap between the two ratios with it.
MEASURES = ("closeness", "closeness_recipe", "diversity_rendered", "diversity_ratio", "diversity_fingerprint", "fingerprint_ratio", "pool_size", "suggestions", "sources")


def measures() -> dict[str, Column]:
    return {m: F.col(m) for m in MEASURES} | {"diversity_gap": F.col("fingerprint_ratio") - F.col("diversity_ratio")}


def aggregated(scores: DataFrame, group: str = "arm") -> DataFrame:
    """group, measure, count, p10, median, mean, p90: nine distributions and the gap, from one ranking pass."""
    return distributions(scores, group, measures())


def hit_rates(scores: DataFrame, group: str = "arm") -> DataFrame:
    """group, photographs, decided, hit_rate among the decided."""
    return scores.groupBy(group).agg(F.count("*").alias("photographs"), F.count("hit").alias("decided"), F.round(F.avg(F.col("hit").cast("double")), 6).alias("hit_rate"))


def hit_curves(scores: DataFrame, group: str = "arm", step: float = 0.5, steps: int = 40) -> DataFrame:
    """group, threshold, rate of closeness strictly below it, for every threshold; counts of a step first, running sums over the few steps."""
    at = F.least(F.floor(F.col("closeness") / step) + 1, F.lit(steps + 1))
    counts = scores.where(F.col("closeness").isNotNull()).groupBy(group, at.alias("at")).agg(F.count("*").alias("n"))
    whole = counts.groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct("at", "n"))).alias("by_step"), F.sum("n").alias("total"))
    below = lambda i: F.aggregate(F.sequence(F.lit(1), i), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(F.try_element_at("by_step", x.cast("long")), F.lit(0)))
    each = whole.select(group, "total", F.explode(F.transform(F.sequence(F.lit(1), F.lit(steps)), lambda i: F.struct((i * step).alias("threshold"), below(i).alias("n")))).alias("x"))
    return each.select(group, "x.threshold", F.round(F.col("x.n") / F.col("total"), 6).alias("rate"))
