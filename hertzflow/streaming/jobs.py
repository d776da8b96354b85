"""Live counterparts of the batch operators, on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.metrics import day_summary
from ..operators.asof import asof_join
from ..operators.layout import POS, order_rows
from ..operators.windows import add_steps, feature_steps
from ..settings import DEFAULTS
from ..storage import group_side, stage, work_path


END_MARK = "9999-12-31 00:00:00"


def read_folder(spark: SparkSession, path: str, schema, pattern: str | None = None, max_files: int | None = None) -> DataFrame:
    """Parquet files as they land; ``max_files`` bounds a micro-batch."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def ingest(stream: DataFrame, ts: str, keys: Sequence[str], delay: str = "30 seconds") -> DataFrame:
    """Accept lateness up to ``delay`` and drop repeats of a key within it."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def window_summary(
    stream: DataFrame,
    ts: str,
    by: Sequence[str],
    value: str,
    *,
    threshold: float = DEFAULTS.unstable_low,
    size: str = "10 seconds",
    slide: str | None = None,
    delay: str = "30 seconds",
) -> DataFrame:
    """Key figures and volatility per tumbling or sliding window; partial sums meet before the shuffle."""
    columns = {**day_summary(value, threshold), "volatility": F.stddev_samp(value)}
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    grouped = stream.withWatermark(ts, delay).groupBy(window, *by)
    out = grouped.agg(*[c.alias(n) for n, c in columns.items()])
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *by, *columns)


def breach_sessions(
    stream: DataFrame, ts: str, by: Sequence[str], value: str, *, threshold: float = DEFAULTS.unstable_low,
    gap: str = "60 seconds", delay: str = "30 seconds",
) -> DataFrame:
    """Breaching rows no further apart than ``gap`` form one session."""
    low = stream.withWatermark(ts, delay).where(F.col(value) < threshold)
    out = low.groupBy(F.session_window(ts, gap), *by).agg(
        F.count("*").alias("breach_rows"), F.min(value).alias("lowest")
    )
    return out.select(
        F.col("session_window.start").alias("session_start"),
        F.col("session_window.end").alias("session_end"),
        *by,
        "breach_rows",
        "lowest",
    )


def drain_sessions(
    stream: DataFrame, ts: str, by: Sequence[str], value: str, label: str = "sessions", *, path: str | None = None,
    timeout: int | None = None, **rule
) -> DataFrame:
    """All breach sessions of the landed input, closed by the stream itself.

    The stream is first drained as usual. Then an end mark lands in a second source, a row far
    in the future: the watermark passes every session that is still open, and the same query,
    resumed from its checkpoint, emits them. The mark itself stays an open session of its own.
    """
    spark = stream.sparkSession
    path = path or work_path(spark, label)
    marks = f"{path}/marks"
    spark.createDataFrame([], stream.schema).write.mode("ignore").parquet(marks)
    both = stream.unionByName(spark.readStream.schema(stream.schema).parquet(marks))
    sessions = breach_sessions(both, ts, by, value, **rule)
    drain(sessions, label, timeout=timeout, path=f"{path}/out")
    mark = {ts: F.lit(END_MARK).cast(stream.schema[ts].dataType), value: F.lit(float("-inf")).cast(stream.schema[value].dataType)}
    row = [mark.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in stream.schema.fields]
    spark.range(1).select(*row).write.mode("append").parquet(marks)
    return drain(sessions, label, timeout=timeout, path=f"{path}/out")


def with_open_sessions(closed: DataFrame, rows: DataFrame, ts: str, by: Sequence[str], value: str, **rule) -> DataFrame:
    """The sessions a stream has closed, and those still open at the end of its landed ``rows``."""
    # Written first: a join right on top of session windows takes their start for a
    # partitioning that the merged windows no longer have.
    every = stage(breach_sessions(rows, ts, by, value, **rule), "sessions")
    return closed.unionByName(every.join(closed.select("session_start", *by), ["session_start", *by], "left_anti"))


def drain_asof(
    stream: DataFrame,
    slow: Callable[[], DataFrame],
    ts: str,
    slow_ts: str,
    label: str = "attached",
    *,
    by: Sequence[str] = (),
    tie: Sequence[str] = (),
    timeout: int | None = None,
    path: str | None = None,
) -> DataFrame:
    """Give each live row the last slow row at or before it, however old that is.

    ``slow`` reads the slow series as it has landed when a micro-batch begins; the batch as-of
    join then takes the place of a state per key, so a missing hour is carried on, of two rows
    of one instant ``tie`` decides, and a large slow side is ordered instead of broadcast. A row
    is joined once: slow rows that land after its micro-batch do not change it.
    """
    spark = stream.sparkSession
    joined: list = []

    def attached(batch: DataFrame) -> DataFrame:
        rows = asof_join(batch, slow(), ts, by=by, right_on=slow_ts, tie=tie)
        rows = rows.drop(slow_ts) if slow_ts != ts else rows
        joined[:] = [rows.schema]
        return rows

    root = drain_batches(stream, label, attached, timeout=timeout, path=path)
    rows = spark.read.schema(joined[0]) if joined else spark.read
    return rows.parquet(root).drop("batch_id")


def attach_slow(stream: DataFrame, slow: DataFrame, ts: str, slow_ts: str, unit: str = "hour") -> DataFrame:
    """Give each live row the slow row of its hour or day."""
    keyed = stream.withColumn("_slot", F.date_trunc(unit, ts))
    slow = slow.withColumn("_slot", F.date_trunc(unit, slow_ts)).drop(slow_ts)
    return keyed.join(slow, "_slot", "left").drop("_slot")


def row_features(
    stream: DataFrame, series: str, ts: str, tie: str, value: str, settings=DEFAULTS
) -> DataFrame:
    """Rate, volatility and lags over trailing rows of a live series.

    State is the last rows of a series, at most the longest frame. Rows of a
    micro-batch are put in order; a row older than the last one already counted
    is passed on with ``late`` set and without features, as its frame is gone.
    All rows of a series in a micro-batch meet in one worker, so micro-batches must
    be bounded; ``drain_row_features`` has no such limit.
    """
    lags, spans, rate_rows = settings.lag_rows, settings.volatility_rows, settings.rocof_rows
    keep = max(*lags, *spans, rate_rows + 1)
    names = ["rocof", *[f"volatility_{k}s" for k in spans], *[f"lag_{k}s" for k in lags]]
    schema = f"{series} string, {ts} timestamp, {tie} bigint, {value} double, late boolean, " + ", ".join(
        f"{n} double" for n in names
    )

    def features(values: np.ndarray, known: int) -> dict[str, np.ndarray]:
        n = len(values)
        diff = pd.Series(values).diff()
        out = {"rocof": diff.rolling(rate_rows, min_periods=1).mean().fillna(0.0).to_numpy()[known:]}
        for k in spans:
            full = np.zeros(n)
            if n >= k:
                full[k - 1 :] = np.lib.stride_tricks.sliding_window_view(values, k).std(axis=1, ddof=1)
            # As in batch: 0 where the window holds a null.
            out[f"volatility_{k}s"] = np.nan_to_num(full[known:])
        for k in lags:
            lagged = np.full(n, settings.lag_fill)
            lagged[k:] = values[:-k] if k < n else values[:0]
            lagged[np.isnan(lagged)] = settings.lag_fill
            out[f"lag_{k}s"] = lagged[known:]
        return out

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        history, last = (list(state.get[0]), tuple(state.get[1:])) if state.exists else ([], (-1, -1))
        rows = pd.concat(list(batches)).sort_values([ts, tie], ignore_index=True)
        at = rows[ts].astype("datetime64[us]").astype("int64")
        late = (at < last[0]) | ((at == last[0]) & (rows[tie] <= last[1]))
        fresh = rows[~late]
        out = rows[[series, ts, tie, value]].assign(late=late, **{n: np.nan for n in names})
        if len(fresh):
            values = np.concatenate([np.asarray(history, dtype=float), fresh[value].to_numpy(dtype=float)])
            for name, column in features(values, len(history)).items():
                out.loc[~late, name] = column
            state.update((values[-keep:].tolist(), int(at[~late].iloc[-1]), int(fresh[tie].iloc[-1])))
        yield out

    slim = stream.select(series, ts, tie, value)
    return slim.groupBy(series).applyInPandasWithState(
        step, schema, "history array<double>, last_at bigint, last_tie bigint", "append", GroupStateTimeout.NoTimeout
    )


def drain_row_features(
    stream: DataFrame,
    series: str,
    ts: str,
    tie: str,
    value: str,
    label: str = "features",
    settings=DEFAULTS,
    *,
    timeout: int | None = None,
    path: str | None = None,
) -> DataFrame:
    """``row_features`` of all available input as a table, for micro-batches of any size.

    Each micro-batch is put behind the last rows of every series, a small table, and
    goes through the ordered layout and the batch features, so a long series is split
    like any other run of rows. A batch reads the state the one before has left and
    writes the other of two, so a repeated batch gives the same. Rows without time or
    tie have no place in the order and count as late.
    """
    spark = stream.sparkSession
    path = path or work_path(spark, label)
    keep = max(*settings.lag_rows, *settings.volatility_rows, settings.rocof_rows + 1)
    names = ["rocof", *[f"volatility_{k}s" for k in settings.volatility_rows], *[f"lag_{k}s" for k in settings.lag_rows]]
    columns = [series, ts, tie, value]
    schema = stream.select(F.col(series), F.col(ts), F.col(tie).cast("bigint"), F.col(value).cast("double")).schema
    place = F.struct(F.col(ts).alias("at"), F.col(tie).alias("tie"))

    def features(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        rows = batch.select(F.col(series), F.col(ts), F.col(tie).cast("bigint"), F.col(value).cast("double"))
        before = f"{path}/state/{(batch_id - 1) % 2}"
        state = session.read.schema(schema).parquet(before) if batch_id else session.createDataFrame([], schema)
        last = group_side(state.groupBy(F.col(series).alias("_series")).agg(F.max(place).alias("_last")), "last-rows")
        placed = rows.join(last, F.col(series).eqNullSafe(F.col("_series")), "left")
        past = F.col(ts).isNull() | F.col(tie).isNull() | F.coalesce(place <= F.col("_last"), F.lit(False))
        marked = placed.withColumn("late", past).select(*columns, "late")
        known = state.withColumn("late", F.lit(None).cast("boolean"))
        fresh = marked.where(~F.col("late")).unionByName(known)
        ordered = order_rows(fresh, [series], [ts, tie, value], path=f"{path}/ordered")
        frames = ordered.framed(before=keep)
        found = frames.trim(add_steps(frames.rows, feature_steps(frames, value, settings)))
        out = found.where(F.col("late").isNotNull()).select(*columns, "late", *names)
        late = marked.where("late").select(*columns, "late", *[F.lit(None).cast("double").alias(n) for n in names])
        out.unionByName(late).write.mode("overwrite").parquet(f"{path}/table/batch_id={batch_id}")
        newest = F.row_number().over(Window.partitionBy(series).orderBy(F.col(POS).desc()))
        ends = ordered.df.withColumn("_back", newest).where(F.col("_back") <= keep).select(*columns)
        ends.write.mode("overwrite").parquet(f"{path}/state/{batch_id % 2}")

    query = (
        stream.writeStream.foreachBatch(features)
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    _finish(query, timeout)
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields]
    whole = ", ".join([*kinds, "late boolean", *[f"{n} double" for n in names], "batch_id bigint"])
    return spark.read.schema(whole).parquet(f"{path}/table").drop("batch_id")


def drain(stream: DataFrame, label: str, *, timeout: int | None = None, path: str | None = None) -> DataFrame:
    """Append all available input to a Parquet table and return the table."""
    spark = stream.sparkSession
    path = path or work_path(spark, label)
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{path}/table")
        .option("checkpointLocation", f"{path}/checkpoint")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    _finish(query, timeout)
    return spark.read.schema(stream.schema).parquet(f"{path}/table")


def drain_batches(
    stream: DataFrame,
    label: str,
    write: Callable[[DataFrame], DataFrame] | None = None,
    *,
    mode: str = "append",
    timeout: int | None = None,
    path: str | None = None,
) -> str:
    """Write each micro-batch, transformed by ``write``, to its own folder; return the root.

    A repeated batch replaces its folder, so a restart writes nothing twice.
    """
    path = path or work_path(stream.sparkSession, label)

    def sink(batch: DataFrame, batch_id: int) -> None:
        rows = write(batch) if write else batch
        rows.write.mode("overwrite").parquet(f"{path}/table/batch_id={batch_id}")

    query = (
        stream.writeStream.foreachBatch(sink)
        .option("checkpointLocation", f"{path}/checkpoint")
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
    _finish(query, timeout)
    return f"{path}/table"


def latest(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The last written version of each key of a table of updates."""
    rows = spark.read.option("basePath", path).parquet(path)
    values = [c for c in rows.columns if c not in (*keys, "batch_id")]
    newest = F.max_by(F.struct(*values), "batch_id").alias("_v")
    return rows.groupBy(*keys).agg(newest).select(*keys, "_v.*")


def _finish(query, timeout: int | None) -> None:
    """Wait for the query; only a caller that sets a limit has it stopped there."""
    if timeout is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout):
        query.stop()
        raise TimeoutError(f"stream did not finish within {timeout} s")
