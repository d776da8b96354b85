"""Queries for the streaming jobs: the events file as a stream, drained with what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from hertzflow.functions.alerts import dual_trigger
from hertzflow.models.quantile import grid_key
from hertzflow.streaming import jobs

from .base import SIGNAL_SQL, THRESHOLD, W, hourly, out, query, r, table
from .learn import _LED_SQL, grouped
from .measures import _DECISION_SQL
from .windows import _vol_sql

_Y = "grid_frequency"


def live_signal(spark, sf):
    schema = table(spark, sf, "events").schema
    raw = jobs.read_folder(spark, sf, schema, pattern="events.parquet")
    return raw.select(
        F.col("event_type").alias("series"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        "event_id",
        (50.0 + (F.col("value") - 50.0) / 200.0).alias(_Y),
    )


@query(
    "t1_live_ingest",
    "WITH " + SIGNAL_SQL + f"SELECT event_id, series, timestamp, {r(_Y, _Y)} FROM sig",
)
def t1(spark, sf):
    return out(jobs.drain(jobs.ingest(live_signal(spark, sf), "timestamp", ["event_id"]), "ingest"))


def _kpi_sql(select, source):
    return (
        "WITH "
        + SIGNAL_SQL
        + f""", {source} SELECT {select}, series, {r(f'min({_Y})', 'min_value')}, {r(f'max({_Y})', 'max_value')},
    {r(f'avg({_Y})', 'mean_value')}, count(*) FILTER (WHERE {_Y} < 49.8) AS breach_rows, {r(f'stddev_samp({_Y})', 'volatility')}
    FROM k GROUP BY 1, 2, 3"""
    )


@query(
    "t2_tumbling_summary",
    _kpi_sql(
        "b AS window_start, b + INTERVAL 10 SECOND AS window_end",
        "k AS (SELECT *, time_bucket(INTERVAL 10 SECOND, timestamp) AS b FROM sig)",
    ),
)
def t2(spark, sf):
    stream = jobs.window_summary(live_signal(spark, sf), "timestamp", ["series"], _Y)
    path = jobs.drain_batches(stream, "summary", mode="update")
    return out(jobs.latest(spark, path, ["window_start", "window_end", "series"]))


@query(
    "t2_sliding_summary",
    _kpi_sql(
        "b AS window_start, b + INTERVAL 60 MINUTE AS window_end",
        """k AS (SELECT *, time_bucket(INTERVAL 15 MINUTE, timestamp) - to_minutes(CAST(15 * i AS BIGINT)) AS b
        FROM sig, generate_series(0, 3) g(i))""",
    ),
)
def t2_sliding(spark, sf):
    stream = jobs.window_summary(
        live_signal(spark, sf), "timestamp", ["series"], _Y, size="60 minutes", slide="15 minutes"
    )
    path = jobs.drain_batches(stream, "summary", mode="update")
    return out(jobs.latest(spark, path, ["window_start", "window_end", "series"]))


@query(
    "t3_live_features",
    _DECISION_SQL
    + f""", fl AS (SELECT *, {_vol_sql(30)} AS v30, {_vol_sql(60)} AS v60, coalesce(lag({_Y}, 1) OVER ({W}), 50.0) AS lag_1s,
      coalesce(lag({_Y}, 5) OVER ({W}), 50.0) AS lag_5s, coalesce(lag({_Y}, 60) OVER ({W}), 50.0) AS lag_60s FROM f2)
    SELECT event_id, series, timestamp, {r(_Y, _Y)}, false AS late, {r('rocof', 'rocof')}, {r('v10', 'volatility_10s')},
      {r('v30', 'volatility_30s')}, {r('v60', 'volatility_60s')}, {r('lag_1s', 'lag_1s')}, {r('lag_5s', 'lag_5s')},
      {r('lag_60s', 'lag_60s')}, (lag_1s - 0.1 < 49.8 OR {_Y} < 49.8) AS alert FROM fl""",
)
def t3(spark, sf):
    rows = jobs.drain_row_features(live_signal(spark, sf), "series", "timestamp", "event_id", _Y)
    return out(rows.withColumn("alert", dual_trigger(F.col("lag_1s") - 0.1, _Y, THRESHOLD)))


@query(
    "t4_breach_sessions",
    "WITH "
    + SIGNAL_SQL
    + f""", b AS (SELECT * FROM sig WHERE {_Y} < 49.8),
    c AS (SELECT *, CASE WHEN timestamp - lag(timestamp) OVER ({W}) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM b),
    i AS (SELECT *, sum(s) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM c)
    SELECT series, min(timestamp) AS session_start, max(timestamp) + INTERVAL 30 MINUTE AS session_end,
      count(*) AS breach_rows, {r(f'min({_Y})', 'lowest')} FROM i GROUP BY series, n""",
)
def t4(spark, sf):
    """Every session comes out of the stream; an end mark closes those open at the end of the input."""
    return out(jobs.drain_sessions(live_signal(spark, sf), "timestamp", ["series"], _Y, gap="30 minutes"))


_GAPPED = "hour(h) % 5 <> 2"


@query(
    "t5_live_asof",
    "WITH "
    + SIGNAL_SQL
    + f""", slow AS (SELECT h AS at, wind_speed, 1 AS k FROM hourly WHERE {_GAPPED}
      UNION ALL SELECT h + INTERVAL 20 MINUTE, wind_speed + 1.0, 2 FROM hourly WHERE hour(h) % 3 = 0 AND {_GAPPED})
    SELECT s.event_id, s.series, s.timestamp, {r(f's.{_Y}', _Y)}, {r('slow.wind_speed', 'wind_speed')}
    FROM sig s ASOF LEFT JOIN slow ON s.timestamp >= slow.at""",
)
def t5_live(spark, sf):
    """Hours are missing from the slow series and some have two rows; each live row takes the last one."""

    def slow():
        rows = hourly(spark, sf).select(F.col("timestamp").alias("at"), "wind_speed")
        rows = rows.where(F.hour("at") % 5 != 2)
        more = rows.where(F.hour("at") % 3 == 0).select(F.expr("at + INTERVAL 20 MINUTE").alias("at"), F.col("wind_speed") + 1.0)
        return rows.union(more)

    return out(jobs.drain_asof(live_signal(spark, sf), slow, "timestamp", "at"))


@query(
    "t5_attach_slow",
    "WITH "
    + SIGNAL_SQL
    + f"""SELECT s.event_id, s.series, s.timestamp, {r(f's.{_Y}', _Y)}, {r('h.wind_speed', 'wind_speed')},
    {r('h.solar_radiation', 'solar_radiation')} FROM sig s LEFT JOIN hourly h ON CAST(date_trunc('hour', s.timestamp) AS TIMESTAMP) = h.h""",
)
def t5(spark, sf):
    slow = hourly(spark, sf).withColumnRenamed("timestamp", "slow_at")
    return out(jobs.drain(jobs.attach_slow(live_signal(spark, sf), slow, "timestamp", "slow_at"), "attached"))


@query(
    "t6_batch_scoring",
    _LED_SQL
    + f"""SELECT event_id, {r('coalesce(tr.lower, lo)', 'lower')}, {r('coalesce(tr.upper, hi)', 'upper')},
    (coalesce(tr.lower, lo) < 49.8 OR {_Y} < 49.8) AS alert FROM t LEFT JOIN tr ON t.cell = tr.cell, al""",
)
def t6(spark, sf):
    _, model = grouped(spark, sf)

    def scored(batch):
        rows = model.transform(batch.withColumn("cell", grid_key(_Y, 0.1)))
        return rows.withColumn("alert", dual_trigger("lower", _Y, THRESHOLD)).select("event_id", "lower", "upper", "alert")

    path = jobs.drain_batches(live_signal(spark, sf), "scored", scored)
    return out(spark.read.parquet(path).drop("batch_id"))
