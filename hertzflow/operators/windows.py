"""Row-frame features. All frames count rows, not seconds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..settings import DEFAULTS
from ..storage import group_side
from .layout import CHUNK, POS, Frames, OrderedRows


def first_difference(frames: Frames, value: str) -> Column:
    return F.col(value) - F.lag(value).over(frames.window)


def smoothed_rate(frames: Frames, diff: str, rows: int = DEFAULTS.rocof_rows) -> Column:
    """Mean of the first differences over the trailing rows; 0 where there is none."""
    return F.coalesce(F.avg(diff).over(frames.over(-(rows - 1), 0)), F.lit(0.0))


def rolling_volatility(frames: Frames, value: str, rows: int) -> Column:
    """Sample deviation over a full window of ``rows``; 0 until it is full."""
    frame = frames.over(-(rows - 1), 0)
    full = F.count(value).over(frame) == rows
    return F.when(full, F.stddev_samp(value).over(frame)).otherwise(F.lit(0.0))


def volatility_steps(
    frames: Frames, value: str, rows: Sequence[int] = DEFAULTS.volatility_rows
) -> list[dict[str, Column]]:
    """Rolling volatilities of several lengths, as columns to add step by step.

    If the shortest length divides the others, its moments are taken once and a
    longer window merges those of its blocks, which lie at fixed lags. A sliding
    frame is evaluated anew for each row, so this costs the shortest frame only.
    """
    base = min(rows)
    if any(k % base for k in rows):
        return [{}, {}, {f"volatility_{k}s": rolling_volatility(frames, value, k) for k in rows}]
    frame = frames.over(-(base - 1), 0)
    full = F.count(value).over(frame) == base
    moments = {
        "_mean_0": F.when(full, F.avg(value).over(frame)),
        "_var_0": F.when(full, F.var_samp(value).over(frame)),
    }
    # Named once: every use of a window expression would be a window column of its own.
    blocks = range(1, max(rows) // base)
    before = {f"_{m}_{i}": F.lag(f"_{m}_0", base * i).over(frames.window) for m in ("mean", "var") for i in blocks}

    def merged(k: int) -> Column:
        count = k // base
        # Relative to the newest mean, so that a constant signal gives exactly 0.
        shift = [F.col(f"_mean_{i}") - F.col("_mean_0") for i in range(1, count)]
        centre = sum(shift, F.lit(0.0)) / count
        spread = sum(((d - centre) * (d - centre) for d in shift), centre * centre)
        squares = sum((F.col(f"_var_{i}") for i in range(1, count)), F.col("_var_0")) * (base - 1) + spread * base
        return F.coalesce(F.sqrt(squares / (k - 1)), F.lit(0.0))

    return [moments, before, {f"volatility_{k}s": merged(k) for k in rows}]


def lagged(frames: Frames, value: str, rows: int, fill: float = DEFAULTS.lag_fill) -> Column:
    return F.coalesce(F.lag(value, rows).over(frames.window), F.lit(fill))


def led(frames: Frames, value: str, rows: int = DEFAULTS.horizon_rows) -> Column:
    return F.lead(value, rows).over(frames.window)


def instability_label(
    future: str | Column, low: float = DEFAULTS.unstable_low, high: float = DEFAULTS.unstable_high
) -> Column:
    future = F.col(future) if isinstance(future, str) else future
    return F.when((future > high) | (future < low), 1).otherwise(0).cast("tinyint")


def trailing_sequence(frames: Frames, columns: Sequence[str], rows: int = DEFAULTS.sequence_rows) -> Column:
    """The last ``rows`` rows as an array, oldest first; null until complete."""
    item = F.struct(*columns) if len(columns) > 1 else F.col(columns[0])
    seen = F.collect_list(item).over(frames.over(-(rows - 1), 0))
    return F.when(F.size(seen) == rows, seen)


def sequences(
    ordered: OrderedRows,
    columns: Sequence[str],
    rows: int = DEFAULTS.sequence_rows,
    label: str | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Complete trailing sequences per row. With ``label``, also the label of the
    next row, for training; rows without one are dropped then. A sequence is many
    times as wide as its row: ``partitions`` bounds what one task holds of them
    where they are kept."""
    frames = ordered.framed(before=rows - 1, after=1 if label else 0)
    chunked = frames.rows.repartition(partitions, CHUNK, *ordered.series) if partitions else frames.rows
    out = chunked.withColumn("sequence", trailing_sequence(frames, columns, rows))
    if label:
        out = out.withColumn("next_label", F.lead(label).over(frames.window))
    out = frames.trim(out).where(F.col("sequence").isNotNull())
    return out.where(F.col("next_label").isNotNull()) if label else out


def countdown(
    frames: Frames, value: str, threshold: float = DEFAULTS.unstable_low, rows: int = DEFAULTS.countdown_rows
) -> Column:
    """Rows until the first value below the threshold within the next ``rows`` rows."""
    below = F.when(F.col(value) < threshold, F.col(POS))
    return F.min(below).over(frames.over(0, rows - 1)) - F.col(POS)


def countdown_rows(
    ordered: OrderedRows, value: str, threshold: float = DEFAULTS.unstable_low, rows: int = DEFAULTS.countdown_rows, name: str = "countdown"
) -> DataFrame:
    """``countdown`` for long frames: the next low row is carried from behind, so the work per row
    does not grow with ``rows``."""
    found = ordered.running({"_next": ("min", F.when(F.col(value) < threshold, F.col(POS)))}, backward=True)
    ahead = F.col("_next") - F.col(POS)
    return found.withColumn(name, F.when(ahead < rows, ahead)).drop("_next")


def context_slices(ordered: OrderedRows, focus: DataFrame, key: str, before: int, after: int) -> DataFrame:
    """The rows around each focus row. ``focus`` holds series columns, position and ``key``.

    Each focus row asks for its positions by number, so this is an equi join.
    """
    wanted = focus.select(
        *ordered.series,
        key,
        F.col(POS).alias("_focus"),
        F.explode(F.expr(f"sequence({POS} - {before}, {POS} + {after})")).alias(POS),
    )
    joined = ordered.df.join(wanted, [*ordered.series, POS])
    return joined.withColumn("offset", F.col(POS) - F.col("_focus")).drop("_focus")


def clean_and_fill(ordered: OrderedRows, column: str, default: float = 0.0) -> DataFrame:
    """Infinities and NaN to null, then forward fill, backward fill, default."""
    c = F.col(column)
    finite = F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)
    cleaned = ordered.with_df(ordered.df.withColumn(column, finite))
    # After a forward fill only the rows before the first value are empty.
    known = F.when(F.col(column).isNotNull(), F.col(POS))
    first = cleaned.df.groupBy(*ordered.series).agg(F.min_by(column, known).alias("_filled"))
    filled = cleaned.running({"_filled": ("last", F.col(column))}, initial=first)
    return filled.withColumn(column, F.coalesce("_filled", F.lit(default))).drop("_filled")


def every_nth(numbered: OrderedRows, parts: int = 60, number: str = "row_number") -> DataFrame:
    """Thin each series to about ``parts`` rows: every n-th row from its first."""
    size = numbered.df.groupBy(*numbered.series).agg(F.count("*").alias("_size"))
    keyed = numbered.df.join(group_side(size, "series-sizes"), list(numbered.series)) if numbered.series else None
    if keyed is None:
        keyed = numbered.df.withColumn("_size", F.lit(numbered.total))
    step = F.greatest(F.lit(1), F.expr(f"_size div {parts}"))
    return keyed.where((F.col(number) - 1) % step == 0).drop("_size")


def first_alert(df: DataFrame, group: Sequence[str], alert: Column, score: str, order: Sequence[str]) -> DataFrame:
    """Per group the first alerting row, or else the row with the lowest score."""
    row = F.struct(*[c for c in df.columns if c not in group])
    when = F.struct(*order)
    out = df.groupBy(*group).agg(
        F.coalesce(
            F.min_by(row, F.when(alert, when)), F.min_by(row, F.struct(score, *order))
        ).alias("_row"),
        F.coalesce(F.max(alert), F.lit(False)).alias("alerted"),
    )
    return out.select(*group, "alerted", "_row.*")


def nadir(df: DataFrame, group: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """Per group the earliest row with the lowest value."""
    row = F.struct(*[c for c in df.columns if c not in group])
    lowest = F.min_by(row, F.when(F.col(value).isNotNull(), F.struct(value, *order)))
    return df.groupBy(*group).agg(lowest.alias("_row")).select(*group, "_row.*")


def advance_warning(
    df: DataFrame, group: Sequence[str], ts: str, value: str, alert: Column, threshold: float, order: Sequence[str]
) -> DataFrame:
    """Seconds from the first alert to the first breach and to the nadir."""
    seconds = F.unix_micros(ts) / 1_000_000
    out = df.groupBy(*group).agg(
        F.min(F.when(alert, F.col(ts))).alias("alert_at"),
        F.min(F.when(F.col(value) < threshold, F.col(ts))).alias("breach_at"),
        F.min_by(ts, F.struct(value, *order)).alias("nadir_at"),
    )
    def gap(end: str) -> Column:
        return (F.unix_micros(end) - F.unix_micros("alert_at")) / 1_000_000
    return out.withColumn("warning_to_breach_s", gap("breach_at")).withColumn("warning_to_nadir_s", gap("nadir_at"))


def breach_episodes(ordered: OrderedRows, ts: str, value: str, threshold: float = DEFAULTS.unstable_low) -> DataFrame:
    """Runs of consecutive rows below the threshold, one row per run.

    Rows of a run share the number of rows seen so far that are not below.
    """
    low = F.coalesce(F.col(value) < threshold, F.lit(False))
    rows = ordered.df.select(*ordered.series, POS, ts, value, low.alias("_low"))
    runs = ordered.with_df(rows).running({"_run": ("sum", (~F.col("_low")).cast("bigint"))}).where("_low")
    return (
        runs.groupBy(*ordered.series, "_run")
        .agg(
            F.min(ts).alias("start_at"),
            F.max(ts).alias("end_at"),
            F.count("*").alias("breach_rows"),
            F.min(value).alias("lowest"),
        )
        .drop("_run")
    )


def feature_steps(frames: Frames, value: str = "grid_frequency", settings=DEFAULTS) -> list[dict[str, Column]]:
    """The row-frame features as columns to add step by step, over one sort.

    Names with a leading underscore are intermediate.
    """
    moments, before, volatilities = volatility_steps(frames, value, settings.volatility_rows)
    return [
        {
            "_diff": first_difference(frames, value),
            "target_freq_next": led(frames, value, settings.horizon_rows),
            **{f"lag_{k}s": lagged(frames, value, k, settings.lag_fill) for k in settings.lag_rows},
            **moments,
        },
        {"rocof": smoothed_rate(frames, "_diff", settings.rocof_rows), **before},
        {
            **volatilities,
            "target_is_unstable": instability_label(
                "target_freq_next", settings.unstable_low, settings.unstable_high
            ),
        },
    ]


def add_steps(rows: DataFrame, steps: Sequence[Mapping[str, Column]]) -> DataFrame:
    """Add columns step by step and drop the intermediate ones."""
    for step in steps:
        rows = rows.withColumns(dict(step)) if step else rows
    return rows.drop(*[c for step in steps for c in step if c.startswith("_")])
