"""Filters, ordering, splits and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..settings import DEFAULTS


def renewable_ratio(wind: str = "wind_speed", capacity=DEFAULTS.wind_capacity_mw, demand=DEFAULTS.demand_mw) -> Column:
    return F.col(wind) * capacity / demand


def calendar_parts(ts: str) -> dict[str, Column]:
    return {"hour": F.hour(ts), "minute": F.minute(ts)}


def split_label(ts: str, split, end, calibration: tuple | None = None) -> Column:
    """``train`` before the split, ``test`` up to ``end``, null after it.

    With a calibration range, its rows leave the training set.
    """
    label = F.when(F.col(ts) < F.lit(split), "train").when(F.col(ts) < F.lit(end), "test")
    if calibration:
        held = (F.col(ts) >= F.lit(calibration[0])) & (F.col(ts) < F.lit(calibration[1]))
        label = F.when(held, "calibration").otherwise(label)
    return label


def day_slice(df: DataFrame, ts: str, day) -> DataFrame:
    """Rows of one date, as a range on the raw column so that it is pushed down."""
    start = F.lit(day).cast("date").cast("timestamp")
    return df.where((F.col(ts) >= start) & (F.col(ts) < start + F.expr("interval 1 day")))


def available_days(df: DataFrame, ts: str) -> DataFrame:
    return df.select(F.to_date(ts).alias("day")).distinct().orderBy("day")


def time_of_day(ts: str, start_minute: int, end_minute: int) -> Column:
    """Minute of the day within [start, end]."""
    return (F.hour(ts) * 60 + F.minute(ts)).between(start_minute, end_minute)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the first by ``order``. The rank limit runs before the shuffle."""
    first = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(first)).where("_rank = 1").drop("_rank")


def _draw(key: Sequence[str], seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in key]))


def seeded_sample(df: DataFrame, key: Sequence[str], size: int, seed: int) -> DataFrame:
    """``size`` rows without replacement, the same ones for the same seed."""
    return df.orderBy(_draw(key, seed), *key).limit(size)


def seeded_sample_per_group(df: DataFrame, group: Sequence[str], key: Sequence[str], size: int, seed: int) -> DataFrame:
    drawn = df.withColumn("_draw", _draw(key, seed))
    ranked = drawn.withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy("_draw", *key)))
    return ranked.where(F.col("_rank") <= size).drop("_rank", "_draw")
