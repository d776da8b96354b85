"""Registry of the checked queries, and the tables they share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hertzflow.operators.asof import asof_join
from hertzflow.operators.layout import Frames, OrderedRows, order_rows

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
DECIMALS = 7
THRESHOLD = 49.8


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


# Results are compared as rounded numbers. Means of decimals often lie halfway between
# two roundings, where the last bit of a sum would decide, so both sides are moved by
# this share of a rounding step first.
_SHIFT = 0.37


def r(expr: str, name: str, decimals: int = DECIMALS) -> str:
    """SQL for a rounded column without a negative zero."""
    rounded = f"round({expr} + {_SHIFT * 10**-decimals:.{decimals + 2}f}, {decimals})"
    return f"CASE WHEN {rounded} = 0 THEN 0.0 ELSE {rounded} END AS {name}"


def rounded(column: Column, decimals: int = DECIMALS) -> Column:
    """The same in Spark."""
    return F.round(column + _SHIFT * 10**-decimals, decimals)


def out(df: DataFrame, *columns: str, decimals: int = DECIMALS) -> DataFrame:
    """Result columns with rounded doubles and zone-free timestamps."""
    df = df.select(*columns) if columns else df
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType):
            c = rounded(c, decimals)
        elif isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as sensor series, one per event type."""
    k = F.get_json_object("props", "$.k").cast("double")
    return events(spark, sf_dir).select(
        F.col("event_type").alias("series"),
        F.col("ts").alias("timestamp"),
        "event_id",
        (50.0 + (F.col("value") - 50.0) / 200.0).alias("grid_frequency"),
        (k % 100 / 100).alias("probability"),
    )


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.date_trunc("hour", "ts").alias("timestamp")
    return events(spark, sf_dir).groupBy(hour).agg(
        (F.avg("value") / 5).alias("wind_speed"),
        F.avg(F.when(F.col("event_type") == "view", F.col("value"))).alias("solar_radiation"),
    )


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_trunc("day", "ts").alias("timestamp")
    return events(spark, sf_dir).groupBy(day).agg(F.count("*").alias("inertia_cost"))


_LAID_OUT: dict[tuple[str, str], OrderedRows] = {}


def laid_out(spark: SparkSession, sf_dir: str) -> OrderedRows:
    """The merged series in (series, time) order: written once per session, then read
    by every query on it, as a table of an analytics job would be."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _LAID_OUT:
        merged = asof_join(signal(spark, sf_dir), hourly(spark, sf_dir), "timestamp")
        merged = asof_join(merged, daily(spark, sf_dir), "timestamp")
        _LAID_OUT[key] = order_rows(merged, ["series"], ["timestamp", "event_id"])
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return _LAID_OUT[key]


def scored_columns(frames: Frames):
    """A band around the previous value, as an SQL-expressible stand-in for a model."""
    before = F.lag("grid_frequency").over(frames.window)
    return {"lower": before - 0.1, "upper": before + 0.1}


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = laid_out(spark, sf_dir).framed(before=1)
    rows = frames.trim(frames.rows.withColumns(scored_columns(frames)))
    return rows.where(F.col("lower").isNotNull())


# ---- the same tables as SQL ------------------------------------------------------

SIGNAL_SQL = """
sig AS (
  SELECT event_type AS series, ts AS timestamp, event_id,
         50.0 + (value - 50.0) / 200.0 AS grid_frequency,
         (CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS DOUBLE) % 100) / 100 AS probability
  FROM events
),
hourly AS (
  SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS h, avg(value) / 5 AS wind_speed,
         avg(CASE WHEN event_type = 'view' THEN value END) AS solar_radiation
  FROM events GROUP BY 1
),
daily AS (
  SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS d, count(*) AS inertia_cost FROM events GROUP BY 1
)
"""

BASE_SQL = (
    "WITH "
    + SIGNAL_SQL
    + """,
base AS (
  SELECT s.*, hourly.wind_speed, hourly.solar_radiation, daily.inertia_cost
  FROM sig s
  ASOF LEFT JOIN hourly ON s.timestamp >= hourly.h
  ASOF LEFT JOIN daily ON s.timestamp >= daily.d
)
"""
)

SCORED_SQL = (
    BASE_SQL
    + """,
banded AS (
  SELECT *, lag(grid_frequency) OVER (PARTITION BY series ORDER BY timestamp, event_id) - 0.1 AS lower,
         lag(grid_frequency) OVER (PARTITION BY series ORDER BY timestamp, event_id) + 0.1 AS upper
  FROM base
),
scored AS (SELECT * FROM banded WHERE lower IS NOT NULL)
"""
)

W = "PARTITION BY series ORDER BY timestamp, event_id"
