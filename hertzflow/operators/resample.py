"""Upsampling with time-weighted linear interpolation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .asof import asof_join
from .layout import POS, OrderedRows, order_rows

_BLOCK = 3600


def fill_linear(
    df: DataFrame, series: Sequence[str], ts: str, values: Sequence[str], tie: Sequence[str] = ()
) -> DataFrame:
    """Fill null values on the line between their non-null neighbours.

    Leading nulls stay null; trailing ones repeat the last value.
    """
    return _filled(order_rows(df, series, [ts, *tie]), ts, values).df.select(*df.columns)


def _filled(ordered: OrderedRows, ts: str, values: Sequence[str]) -> OrderedRows:
    kept = ordered.df.columns
    at = F.unix_micros(ts)
    knot = {v: F.when(F.col(v).isNotNull(), F.struct(at.alias("at"), F.col(v).cast("double").alias("v"))) for v in values}
    ahead = ordered.running({f"_next_{v}": ("last", knot[v]) for v in values}, backward=True)
    both = ordered.with_df(ahead).running({f"_prev_{v}": ("last", knot[v]) for v in values})
    filled = {}
    for v in values:
        p, n = f"_prev_{v}", f"_next_{v}"
        # Between two samples of one instant the earlier one holds.
        slope = F.coalesce(F.try_divide(F.col(f"{n}.v") - F.col(f"{p}.v"), F.col(f"{n}.at") - F.col(f"{p}.at")), F.lit(0.0))
        line = F.col(f"{p}.v") + slope * (at - F.col(f"{p}.at"))
        filled[v] = F.when(F.col(v).isNotNull(), F.col(v).cast("double")).otherwise(
            F.when(F.col(n).isNull(), F.col(f"{p}.v")).otherwise(line)
        )
    return ordered.with_df(both.withColumns(filled).select(*kept))


def _knots(df, series, ts, values, fill_nulls) -> DataFrame:
    """Samples with their time in microseconds and the sample after."""
    ordered = order_rows(df.select(*series, ts, *values), series, [ts])
    if fill_nulls:
        ordered = _filled(ordered, ts, values)
    frames = ordered.framed(after=1)
    rows = frames.rows.withColumn("_knot_at", F.unix_micros(ts)).withColumn("_knot_next", F.lead("_knot_at").over(frames.window))
    rows = rows.withColumns({f"_next_{v}": F.lead(v).over(frames.window) for v in values})
    return frames.trim(rows).drop(POS)


def _on_line(value: str, elapsed) -> Column:
    """The value ``elapsed`` microseconds after a knot; the knot itself where none follows."""
    share = F.coalesce(F.try_divide(elapsed, F.col("_knot_next") - F.col("_knot_at")), F.lit(0.0))
    line = F.col(value) + (F.col(f"_next_{value}") - F.col(value)) * share
    return F.when((elapsed == 0) | F.col("_knot_next").isNull(), F.col(value).cast("double")).otherwise(line)


def upsample_linear(
    df: DataFrame,
    series: Sequence[str],
    ts: str,
    values: Sequence[str],
    *,
    step_seconds: int = 1,
    fill_nulls: bool = True,
) -> DataFrame:
    """Rows every ``step_seconds`` between the first and last sample of a series.

    Timestamps are to be unique within a series. A long gap is exploded in
    blocks, so no array grows with it.
    """
    knots = _knots(df, series, ts, values, fill_nulls)
    step = step_seconds * 1_000_000
    # Steps of this gap; the last sample of the series is emitted once.
    steps = F.expr(f"coalesce((_knot_next - _knot_at - 1) div {step}, 0L)")
    blocks = knots.withColumn("_last_step", steps).withColumn(
        "_block", F.explode(F.expr(f"sequence(0L, _last_step div {_BLOCK})"))
    )
    # Few bytes of samples become many rows: spread them by number, not by size.
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grid = blocks.repartition(partitions, *series, ts, "_block").withColumn(
        "_step",
        F.explode(
            F.expr(f"sequence(_block * {_BLOCK}, least(_block * {_BLOCK} + {_BLOCK - 1}, _last_step))")
        ),
    )
    elapsed = F.col("_step") * step
    return grid.select(
        *series,
        F.timestamp_micros(F.col("_knot_at") + elapsed).alias(ts),
        *[_on_line(v, elapsed).alias(v) for v in values],
    )


def asof_interpolated(
    left: DataFrame,
    slow: DataFrame,
    on: str,
    values: Sequence[str],
    *,
    by: Sequence[str] = (),
    slow_on: str | None = None,
    step_seconds: int = 1,
    fill_nulls: bool = True,
    left_tie: Sequence[str] = (),
    strategy: str = "auto",
) -> DataFrame:
    """What a backward as-of join on the upsampled slow series gives, without upsampling.

    Each left row meets the sample before it, which knows the sample after, and
    is placed on the line between them at its own grid step.
    """
    slow_on = slow_on or on
    knots = _knots(slow, list(by), slow_on, values, fill_nulls)
    if slow_on == on:
        knots = knots.withColumnRenamed(on, "_knot_ts")
        slow_on = "_knot_ts"
    joined = asof_join(left, knots, on, by=by, right_on=slow_on, left_tie=left_tie, strategy=strategy)
    step = step_seconds * 1_000_000
    elapsed = F.expr(f"(unix_micros(`{on}`) - _knot_at) div {step}") * step
    return joined.select(*left.columns, *[_on_line(v, elapsed).alias(v) for v in values])
