"""One ranking from several differently-scaled scores, by normal scores of empirical percentiles.

Each score is replaced by its percentile within its group and score name, ties sharing the average, and mapped through the inverse normal distribution; items
are ordered by the weighted mean. Only the order within each score matters, so no score counts more for having larger numbers.

Percentiles are taken without gathering a group anywhere: rows are folded to (group, score, value, count), range-partitioned by that order, counted per partition, and
shifted by the counts of the partitions before. A group or a tie may span all rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorevine.runtime import cut, discard

#: Items of a knock-out round: a bound on what one task folds of a group.
FOLD = 512


def percentiles(scores: DataFrame, group: list[str], value: str) -> DataFrame:
    """``(group..., value, below, ties, total)``: for each distinct value of a group the rows below it, the rows with it, and all rows.

    Nulls form a value below all others. NaN ranks with null, as neither says anything; infinities are ordinary values.
    """
    clean = F.when(F.isnan(value), None).otherwise(F.col(value))
    counts = scores.select(*group, clean.alias(value)).groupBy(*group, value).agg(F.count("*").alias("ties"))
    order = [*[F.col(g).asc_nulls_first() for g in group], F.col(value).asc_nulls_first()]
    ranged = cut(counts.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    per = ranged.groupBy(*group, "_part").agg(F.sum("ties").alias("_n"))
    spread = Window.partitionBy(*group).orderBy("_part")
    per = per.select(*group, "_part", (F.sum("_n").over(spread) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy(*group)).alias("total"))
    inside = Window.partitionBy(*group, "_part").orderBy(F.col(value).asc_nulls_first())
    local = ranged.withColumn("_upto", F.sum("ties").over(inside))
    same = reduce(lambda a, b: a & b, [local[g].eqNullSafe(per[g]) for g in group], local["_part"] == per["_part"])
    joined = local.join(per, same)
    return joined.select(*[local[g] for g in group], local[value], (per["_before"] + local["_upto"] - local["ties"]).alias("below"), local["ties"], per["total"])


# The published coefficients of P. Acklam's rational approximation to the normal quantile.
QUANTILE = (
    [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00],
    [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01],
    [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00],
    [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00],
)


def inverse_normal(p: Column) -> Column:
    """Quantiles of the standard normal distribution for ``0 < p < 1``, accurate to about 1e-9."""
    a, b, c, d = QUANTILE

    def poly(x: Column, k: list[float]) -> Column:
        return reduce(lambda acc, y: acc * x + F.lit(y), k[1:], F.lit(k[0]))

    q = p - F.lit(0.5)
    middle = poly(q * q, a) * q / poly(q * q, [*b, 1.0])
    low = F.sqrt(F.lit(-2.0) * F.log(p))
    high = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - p))
    return F.when(p < 0.02425, poly(low, c) / poly(low, [*d, 1.0])).when(p > 1 - 0.02425, -poly(high, c) / poly(high, [*d, 1.0])).otherwise(middle)


def fused(wide: DataFrame, group: str, item: str, scores: list[str], weights: dict[str, float] | None = None) -> DataFrame:
    """``wide`` with ``z_<score>`` for every score and ``fused``, their weighted mean, within each ``group``.

    ``wide`` has one row per group and item and a number (or null, which ranks lowest, level with NaN) for each score. Percentile: rows below plus half of the
    ties, over all rows. Ranking by ``fused`` descending, then item, is total. Other columns pass through.
    """
    rows = cut(wide.withColumn("_row", F.monotonically_increasing_id()), "rows")
    stacked = rows.select(F.col(group).alias("_g"), "_row", F.explode(F.array(*[F.struct(F.lit(i).alias("_s"), F.col(s).cast("double").alias("_v")) for i, s in enumerate(scores)])).alias("_x"))
    stacked = stacked.select("_g", "_row", "_x._s", F.when(F.isnan("_x._v"), None).otherwise(F.col("_x._v")).alias("_v"))
    # all scores are ranked in one pass, each within its own group and name
    table = percentiles(stacked, ["_g", "_s"], "_v")
    p = (F.col("below") + F.col("ties") / 2) / F.col("total")
    z = table.select(F.col("_g").alias("_zg"), F.col("_s").alias("_zs"), F.col("_v").alias("_zv"), inverse_normal(p).alias("_z"))
    placed = stacked.join(z, (stacked["_s"] == z["_zs"]) & stacked["_g"].eqNullSafe(z["_zg"]) & stacked["_v"].eqNullSafe(z["_zv"]))
    again = placed.groupBy("_row").agg(*[F.max(F.when(F.col("_s") == i, F.col("_z"))).alias(f"z_{s}") for i, s in enumerate(scores)])
    out = rows.join(again, "_row").drop("_row")
    weights = weights or {s: 1.0 for s in scores}
    total = sum(weights[s] for s in scores)
    # rounded, so that the order of adding makes no difference between ties
    return out.withColumn("fused", F.round(reduce(lambda a, b: a + b, [F.col(f"z_{s}") * F.lit(float(weights[s])) for s in scores]) / F.lit(float(total)), 9))


def ranked(scored: DataFrame, group: str, item: str) -> DataFrame:
    """``scored`` with ``rank`` 1, 2, ... by ``fused`` descending, then ``item``; counted in the same distributed way as percentiles."""
    order = [F.col(group).asc_nulls_first(), F.col("fused").desc(), F.col(item).asc_nulls_first()]
    ranged = cut(scored.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranked")
    per = ranged.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    per = per.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), (F.sum("_n").over(Window.partitionBy(group).orderBy("_part")) - F.col("_n")).alias("_before"))
    local = ranged.withColumn("_local", F.row_number().over(Window.partitionBy(group, "_part").orderBy(F.col("fused").desc(), F.col(item).asc_nulls_first())))
    joined = local.join(per, local[group].eqNullSafe(per["_g"]) & (local["_part"] == per["_p"]))
    return joined.withColumn("rank", F.col("_before") + F.col("_local")).drop("_g", "_p", "_part", "_before", "_local")


def _beats(a: Column, b: Column, scores: list[str]) -> Column:
    """How many more scores rate ``a`` above ``b`` than below; negative when below."""
    return reduce(lambda x, y: x + y, [F.signum(F.coalesce(a[f"z_{s}"], F.lit(0.0)) - F.coalesce(b[f"z_{s}"], F.lit(0.0))) for s in scores])


def leaders(scored: DataFrame, group: str, item: str, scores: list[str]) -> DataFrame:
    """``(group, item)``: the item that stands higher than every other one of its group in more scores than it stands lower, if there is one.

    The head of the fused ranking is compared with all others first; most groups end there. In the others the candidate comes from a knock-out in the order of the ranking, neighbours first, each round keeping the
    winner of every ``FOLD`` items; an item that beats all others wins every round it is in, so it is the one left. It is then compared with all others exactly. A group with one item is led by it.
    """
    row = F.struct(F.col(item).alias("item"), *[F.col(f"z_{s}") for s in scores])
    order = cut(ranked(scored, group, item).select(F.col(group).alias("g"), F.col("rank").alias("r"), row.alias("x")), "order")
    heads = cut(_leading(order, order.where("r = 1").select("g", F.col("x").alias("best")), scores), "heads")
    left = order.join(heads.where("leads").select(F.col("g").alias("h")), F.col("g").eqNullSafe(F.col("h")), "left_anti")
    rest = left = cut(left, "rest")
    while True:
        step = left.groupBy("g", F.floor((F.col("r") - 1) / FOLD).alias("f")).agg(F.sort_array(F.collect_list(F.struct("r", "x"))).alias("xs"))
        champion = F.aggregate(F.slice("xs", 2, FOLD), F.get("xs", F.lit(0))["x"], lambda best, y: F.when(_beats(y["x"], best, scores) > 0, y["x"]).otherwise(best))
        last, left = left, cut(step.select("g", (F.col("f") + 1).alias("r"), champion.alias("x")), "round")
        if last is not rest:
            discard(last)
        if not left.where("r > 1").limit(1).count():
            break
    found = heads.unionByName(_leading(rest, left.select("g", F.col("x").alias("best")), scores))
    return found.where("leads").select(F.col("g").alias(group), F.col("best")["item"].alias(item))


def _leading(order: DataFrame, best: DataFrame, scores: list[str]) -> DataFrame:
    """``best(g, best)`` with ``leads``: whether the candidate beats all others of its group in ``order(g, x)``."""
    named = best.withColumnRenamed("g", "bg")
    duel = order.join(named, order["g"].eqNullSafe(named["bg"]))
    lost = duel.groupBy("g").agg(F.min(F.when(~F.col("x")["item"].eqNullSafe(F.col("best")["item"]), _beats(F.col("best"), F.col("x"), scores))).alias("least"))
    return best.join(lost.withColumnRenamed("g", "lg"), F.col("g").eqNullSafe(F.col("lg"))).select("g", "best", F.coalesce(F.col("least") > 0, F.lit(True)).alias("leads"))


def search_scores(hits: DataFrame, notes: DataFrame, lists: list[str]) -> DataFrame:
    """One row per query and note with its best finite score of each list, and its clamped importance.

    A null id or query is no note; notes that are unknown have importance 0.
    """
    finite = ~F.isnan("score") & (F.abs("score") != float("inf"))
    usable = hits.where(F.col("query_id").isNotNull() & F.col("id").isNotNull() & F.col("list_name").isNotNull()).where(F.col("list_name").isin(lists))
    best = usable.groupBy("query_id", "id").agg(*[F.max(F.when((F.col("list_name") == n) & finite, F.col("score"))).alias(n) for n in lists])
    importance = notes.where(F.col("id").isNotNull()).groupBy("id").agg(F.max(F.greatest(F.lit(0), F.least(F.lit(10), F.coalesce("importance", F.lit(0))))).alias("importance"))
    return best.join(importance, "id", "left").select("query_id", "id", *lists, F.coalesce("importance", F.lit(0)).cast("double").alias("importance"))
