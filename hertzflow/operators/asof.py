"""Joins in time: backward as-of, nearest row, equi attach."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import group_side, stage
from .layout import order_rows

MAX_BROADCAST_BYTES = 64 << 20
MAX_BROADCAST_ROWS = 200_000
MAX_ROWS_PER_BUCKET = 64

_FIXED_WIDTH = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: str,
    *,
    by: Sequence[str] = (),
    right_on: str | None = None,
    tie: Sequence[str] = (),
    left_tie: Sequence[str] = (),
    tolerance_seconds: float | None = None,
    strategy: str = "auto",
) -> DataFrame:
    """Give each left row the last right row with ``right_on <= on``; else nulls.

    ``broadcast`` turns each right row into the interval it is valid for and
    joins on time buckets, so the left side is not shuffled; it is taken only
    after rows, bytes and rows per bucket of the right side have been measured.
    ``sorted`` orders both sides together and carries the last right row along.
    ``tie`` orders right rows of one instant, ahead of their other columns, so that
    both ways take the same row; ``left_tie`` makes left rows unique. A null in ``on``
    or in a ``by`` key matches nothing.
    """
    right_on = right_on or on
    clash = (set(left.columns) & set(right.columns)) - {on, right_on, *by}
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    if strategy not in ("auto", "broadcast", "sorted"):
        raise ValueError(f"unknown strategy: {strategy}")
    if strategy != "sorted":
        right = stage(right, "asof-right")
        if right.isEmpty():
            return _unmatched(left, right, right_on, by)
        intervals = _bounded_intervals(right, right_on, by, tie)
        if intervals is not None:
            return _interval_join(left, intervals, on, by, tolerance_seconds)
        if strategy == "broadcast":
            raise ValueError("the right side is too large or too dense to broadcast")
    return _sorted_join(left, right, on, right_on, by, tie, left_tie, tolerance_seconds)


def _unmatched(left, right, right_on, by):
    values = [f for f in right.schema.fields if f.name not in by and f.name != right_on]
    return left.select(*left.columns, *[F.lit(None).cast(f.dataType).alias(f.name) for f in values])


def _tie_columns(right: DataFrame, right_on: str, by: Sequence[str], tie: Sequence[str]) -> list[str]:
    """What decides between right rows of one instant: ``tie``, then all other columns that have an order."""
    others = [f for f in right.schema.fields if f.name not in (*by, *tie, right_on)]
    return [*tie, *(f.name for f in others if isinstance(f.dataType, (*_FIXED_WIDTH, T.StringType, T.BinaryType)))]


def _row_bytes(df: DataFrame):
    """Bytes of a row as a column, or None where the width has no cheap measure."""
    size = F.lit(16)
    for field in df.schema.fields:
        if isinstance(field.dataType, T.StringType):
            size = size + F.coalesce(F.octet_length(field.name), F.lit(0)) + 16
        elif isinstance(field.dataType, _FIXED_WIDTH):
            size = size + 8
        else:
            return None
    return size


def _bounded_intervals(right, right_on, by, tie):
    """Right rows as bucketed validity intervals, if they are proven small."""
    size = _row_bytes(right)
    if size is None:
        return None
    at = F.unix_micros(F.col(right_on).cast("timestamp"))
    for c in (right_on, *by):
        right = right.where(F.col(c).isNotNull())
    right = right.withColumn("_from", at)
    groups = F.count_distinct(F.struct(*by)) if by else F.lit(1)
    n, low, high, n_bytes, groups = right.agg(F.count("*"), F.min("_from"), F.max("_from"), F.sum(size), groups).first()
    if n == 0 or n > MAX_BROADCAST_ROWS or n_bytes > MAX_BROADCAST_BYTES:
        return None
    # Buckets no finer than the mean gap. An interval covers the buckets up to the next
    # start, so a group adds at most its rows and the number of buckets: about 2 n in all.
    width = max(1, (high - low) * groups // n + 1)
    last_bucket = high // width
    # A bucket holds the rows that start in it and one that reaches into it.
    starts = right.groupBy(*by, F.expr(f"_from div {width}")).count()
    if starts.agg(F.max("count")).first()[0] >= MAX_ROWS_PER_BUCKET:
        return None

    in_group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    ties = _tie_columns(right.drop("_from"), right_on, by, tie)
    latest = Window.partitionBy(*by, "_from").orderBy(*[F.col(c).desc() for c in ties] or [F.lit(0)])
    rows = right.withColumn("_rank", F.row_number().over(latest)).where("_rank = 1").drop("_rank", right_on)
    rows = rows.withColumn("_until", F.lead("_from").over(in_group.orderBy("_from")))
    rows = rows.withColumn(
        "_bucket",
        F.explode(F.expr(f"sequence(_from div {width}, coalesce(_until div {width}, {last_bucket}L))")),
    )
    return rows, width, last_bucket


def _interval_join(left, intervals, on, by, tolerance_seconds):
    rows, width, last_bucket = intervals
    keys = [f"_by_{c}" for c in by]
    rows = rows.withColumnsRenamed(dict(zip(by, keys)))
    at = F.unix_micros(F.col(on).cast("timestamp"))
    bucket = F.least(F.expr(f"_at div {width}"), F.lit(last_bucket))
    left = left.withColumn("_at", at).withColumn("_left_bucket", bucket)
    match = (
        (F.col("_left_bucket") == F.col("_bucket"))
        & (F.col("_at") >= F.col("_from"))
        & (F.col("_until").isNull() | (F.col("_at") < F.col("_until")))
    )
    for column, key in zip(by, keys):
        match = match & (F.col(column) == F.col(key))
    if tolerance_seconds is not None:
        match = match & (F.col("_at") - F.col("_from") <= int(tolerance_seconds * 1_000_000))
    joined = left.join(F.broadcast(rows), match, "left")
    return joined.drop("_at", "_left_bucket", "_bucket", "_from", "_until", *keys)


def _sorted_join(left, right, on, right_on, by, tie, left_tie, tolerance_seconds):
    values = [c for c in right.columns if c not in by and c != right_on]
    ties = [F.col(c) for c in _tie_columns(right, right_on, by, tie)] or [F.lit(0)]
    payload = F.struct(F.col(right_on).cast("timestamp").alias("_right_at"), *values)
    right_rows = right.where(F.col(right_on).isNotNull()).select(
        *by,
        F.col(right_on).cast("timestamp").alias("_at"),
        F.lit(0).alias("_side"),
        F.struct(*[t.alias(f"t{i}") for i, t in enumerate(ties)]).alias("_right_tie"),
        payload.alias("_right"),
    )
    left_rows = left.select(
        *by,
        F.col(on).cast("timestamp").alias("_at"),
        F.lit(1).alias("_side"),
        F.struct(*[F.col(c) for c in left_tie] or [F.lit(0)]).alias("_left_tie"),
        F.struct(*left.columns).alias("_left"),
    )
    both = right_rows.unionByName(left_rows, allowMissingColumns=True)
    ordered = order_rows(both, list(by), ["_at", "_side", "_right_tie", "_left_tie"])
    carried = ordered.running({"_match": ("last", F.col("_right"))}).where("_side = 1")
    match = F.col("_match")
    for c in by:
        match = F.when(F.col(f"_left.{c}").isNotNull(), match)
    if tolerance_seconds is not None:
        gap = F.unix_micros("_at") - F.unix_micros("_match._right_at")
        match = F.when(gap <= int(tolerance_seconds * 1_000_000), match)
    return carried.select("_left.*", match.alias("_match")).select(
        *left.columns, *[F.col(f"_match.{c}").alias(c) for c in values]
    )


def attach(left: DataFrame, right: DataFrame, on: Sequence[str], fill: dict | None = None) -> DataFrame:
    """Equi left join with defaults for rows without a match."""
    joined = left.join(right, list(on), "left")
    return joined.fillna(fill) if fill else joined


def nearest_row(
    df: DataFrame,
    targets: DataFrame,
    on: str,
    target_on: str,
    by: Sequence[str],
    key: Sequence[str],
    series: Sequence[str] = (),
    tie: Sequence[str] = (),
) -> DataFrame:
    """The row of ``df`` closest in time to each target of the same ``by`` value.

    One result per (key, series); the earlier row wins a tie. Partial ``min_by``
    runs before the shuffle, so a hot day is reduced where it is read.
    """
    gap = F.abs(F.unix_micros(F.col(on)) - F.unix_micros(F.col(target_on)))
    pairs = df.join(group_side(targets, "targets"), list(by))
    best = F.min_by(F.struct(*df.columns), F.struct(gap, on, *tie)).alias("_best")
    group = [*key, target_on, *[c for c in series if c not in key]]
    out = pairs.groupBy(*group).agg(best)
    rest = [F.col(f"_best.{c}").alias(c) for c in df.columns if c not in group]
    return out.select(*group, *rest)
