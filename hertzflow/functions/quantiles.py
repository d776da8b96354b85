"""Exact quantiles whose memory does not grow with a group."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import group_side, stage

BUCKETS = 1024
FEW = 4096


def _bucket(low: Column, high: Column) -> Column:
    """Which of ``BUCKETS`` slices between two finite values a value lies in; infinities and NaN have their own."""
    v = F.col("_v")
    share = F.floor((v - low) / (high - low) * BUCKETS)
    inner = F.when(v == high, BUCKETS - 1).otherwise(F.least(F.greatest(F.coalesce(share, F.lit(0)), F.lit(0)), F.lit(BUCKETS - 1)))
    outer = F.when(F.isnan(v), BUCKETS + 1).when(v == float("inf"), BUCKETS).when(v == float("-inf"), -1)
    return F.coalesce(outer, F.when(high > low, inner).otherwise(0)).cast("int")


def _beside_groups(rows: DataFrame, groups: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows with columns of their group; null is a group like any other."""
    if not by:
        one = groups.select(*columns).first()
        return rows.withColumns({c: F.lit(one[c]) for c in columns}) if one else rows.where("false").withColumns({c: F.lit(None) for c in columns})
    names = [f"_g{i}" for i in range(len(by))]
    held = groups.select(*[F.col(c).alias(n) for c, n in zip(by, names)], *columns)
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(by, names)])
    return rows.join(group_side(held, "quantile-groups"), same).drop(*names)


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, alphas: Sequence[float]) -> DataFrame:
    """(by, alpha, quantile) with linear interpolation between neighbouring ranks.

    Nothing is ordered. Each group's range of values is cut into ``BUCKETS`` slices that are
    counted with map-side sums; the slices that hold the wanted ranks are the ranges of the next
    pass, until they hold one value or at most ``FEW`` rows, and only such a handful is ranked.
    A pass divides what is left by the number of slices, so 10^12 rows take three.
    """
    alphas = sorted({float(a) for a in alphas})
    rows = stage(df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v")), "quantile-values")
    finite = F.when(~F.isnan("_v") & (F.abs("_v") < float("inf")), F.col("_v"))
    groups = rows.groupBy(*by).agg(F.count("*").alias("_size"), F.min(finite).alias("_low"), F.max(finite).alias("_high"))
    groups = stage(groups.where("_size > 0").withColumn("_group", F.monotonically_increasing_id()), "quantile-groups")
    placed = _beside_groups(rows, groups, by, ["_group"]).select("_group", "_v")

    at = F.col("alpha") * (F.col("_size") - 1)
    ends = F.explode(F.array_distinct(F.array(F.floor(at), F.ceil(at)))).alias("_rank")
    wanted = groups.select("_group", "_size", F.explode(F.array(*map(F.lit, alphas))).alias("alpha")).select("_group", ends).distinct()
    # A range: part of a group's values, the rows below it, and the ranks that are looked for in it.
    ranges = groups.select("_group", F.col("_group").alias("_range"), "_low", "_high", F.lit(0).cast("bigint").alias("_below"))
    ranges = ranges.join(wanted.groupBy("_group").agg(F.collect_list("_rank").alias("_ranks")), "_group")
    found, first = [], True
    while True:
        inside = placed.join(group_side(ranges, "quantile-ranges"), "_group")
        if not first:
            inside = inside.where(F.col("_v").between(F.col("_low"), F.col("_high")))
        cells = inside.groupBy("_group", "_range", "_below", "_ranks", _bucket(F.col("_low"), F.col("_high")).alias("_bucket"))
        counted = cells.agg(F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        counted = counted.withColumn("_upto", F.col("_below") + F.sum("_n").over(Window.partitionBy("_range").orderBy("_bucket"))).withColumn("_below", F.col("_upto") - F.col("_n"))
        held = F.filter("_ranks", lambda k: (k >= F.col("_below")) & (k < F.col("_upto")))
        hits = stage(counted.withColumn("_ranks", held).where(F.size("_ranks") > 0).drop("_range", "_upto"), "quantile-hits")
        one = (F.col("_low") == F.col("_high")) | (F.isnan("_low") & F.isnan("_high"))
        found.append(hits.where(one).select("_group", F.explode("_ranks").alias("_rank"), F.col("_low").alias("_value")))
        open_ = hits.where(~one).withColumn("_range", F.monotonically_increasing_id())
        small = open_.where(F.col("_n") <= FEW).drop("_n", "_bucket")
        found.append(_ranked(placed, small))
        ranges, first = stage(open_.where(F.col("_n") > FEW).drop("_n", "_bucket"), "quantile-open"), False
        if ranges.isEmpty():
            break
    values = stage(reduce(DataFrame.unionByName, found), "quantile-ranks")
    levels = groups.select(*by, "_group", "_size", F.explode(F.array(*map(F.lit, alphas))).alias("alpha"))
    both = levels.withColumn("_at", at).join(values, "_group").where((F.col("_rank") == F.floor("_at")) | (F.col("_rank") == F.ceil("_at")))
    low = F.max(F.when(F.col("_rank") == F.floor("_at"), F.col("_value")))
    high = F.max(F.when(F.col("_rank") == F.ceil("_at"), F.col("_value")))
    part = F.first(F.col("_at") - F.floor("_at"))
    picked = both.groupBy(*by, "_group", "alpha").agg(low.alias("_low"), high.alias("_high"), part.alias("_part"))
    between = F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_part")
    return picked.select(*by, "alpha", F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(between).alias("quantile"))


def _ranked(placed: DataFrame, small: DataFrame) -> DataFrame:
    """The wanted ranks of ranges of few rows."""
    inside = placed.join(group_side(small, "quantile-small"), "_group").where(F.col("_v").between(F.col("_low"), F.col("_high")))
    order = Window.partitionBy("_range").orderBy("_v")
    ranked = inside.withColumn("_rank", F.col("_below") + F.row_number().over(order) - 1)
    return ranked.where(F.array_contains("_ranks", F.col("_rank"))).select("_group", "_rank", F.col("_v").alias("_value"))
