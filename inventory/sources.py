"""Queries for sources, validation and sinks."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from hertzflow.sources import readers, sinks, validate
from hertzflow.storage import work_path, work_root

from .base import events, hourly, out, query, r, signal, table

_START, _END = datetime(2024, 1, 5), datetime(2024, 1, 20)


@query(
    "s1_filtered_scan",
    "SELECT event_id, ts, value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'",
)
def s1(spark, sf):
    return readers.between(table(spark, sf, "events").select("event_id", "ts", "value"), "ts", _START, _END)


@query("s2_json_envelope", "SELECT event_id, event_type, value FROM events")
def s2(spark, sf):
    """Responses of at most 500 records each, as the raw service answers, unwrapped again."""
    record = F.struct("event_id", "event_type", "value")
    pages = events(spark, sf).groupBy(F.expr("event_id div 500")).agg(F.collect_list(record).alias("records"))
    response = F.to_json(F.struct(F.lit(True).alias("success"), F.struct("records").alias("result")))
    schema = "success boolean, result struct<records: array<struct<event_id: bigint, event_type: string, value: double>>>"
    parsed = pages.select(F.from_json(response, schema).alias("r")).select("r.*")
    return readers.unwrap_envelope(parsed)


@query(
    "s3_month_coverage",
    """
    WITH wanted AS (
      SELECT strftime(m, '%Y-%m') AS month
      FROM generate_series(TIMESTAMP '1991-06-01', TIMESTAMP '1999-03-01', INTERVAL 1 MONTH) t(m)
    ), have AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS month FROM orders)
    SELECT w.month, h.month IS NOT NULL AS present FROM wanted w LEFT JOIN have h ON w.month = h.month
    """,
)
def s3(spark, sf):
    months = table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    return readers.month_coverage(months, "1991-06-15", "1999-03-10")


@query(
    "s4_multi_part_union",
    """
    SELECT event_id, ts, value FROM events WHERE ts < TIMESTAMP '2024-01-11'
    UNION ALL SELECT event_id, ts, value FROM events WHERE ts >= TIMESTAMP '2024-01-11' AND ts < TIMESTAMP '2024-01-21'
    UNION ALL SELECT event_id, ts, value FROM events WHERE ts >= TIMESTAMP '2024-01-21'
    """,
)
def s4(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "ts", "value")
    a, b = (F.lit(d).cast("timestamp_ntz") for d in ("2024-01-11", "2024-01-21"))
    t = F.col("ts")
    return readers.union_parts([rows.where(t < a), rows.where((t >= a) & (t < b)), rows.where(t >= b)])


@query(
    "s5_offset_timestamp",
    "SELECT event_id, CAST(date_trunc('second', ts) AS TIMESTAMP) AS timestamp, value AS grid_frequency FROM events",
)
def s5(spark, sf):
    text = F.concat(F.date_format(F.col("ts") + F.expr("interval 1 hour"), "yyyy-MM-dd HH:mm:ss"), F.lit(" +0100"))
    raw = events(spark, sf).select("event_id", text.alias("dtm"), F.col("value").alias("f"))
    return out(
        raw.select("event_id", readers.offset_timestamp("dtm").alias("timestamp"), F.col("f").alias("grid_frequency"))
    )


@query("s6_iso_day", "SELECT event_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS timestamp FROM events")
def s6(spark, sf):
    raw = events(spark, sf).select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("Settlement Date"))
    return out(raw.select("event_id", readers.iso_day("Settlement Date").alias("timestamp")))


@query(
    "s7_settlement_time",
    """
    SELECT event_id, CASE WHEN event_type = 'error' THEN CAST(date_trunc('day', ts) AS TIMESTAMP)
      ELSE CAST(date_trunc('day', ts) AS TIMESTAMP)
           + to_minutes(30 * (CAST(hour(ts) AS INTEGER) * 2 + CAST(minute(ts) AS INTEGER) // 30)) END AS timestamp
    FROM events
    """,
)
def s7(spark, sf):
    period = F.hour("ts") * 2 + F.floor(F.minute("ts") / 30) + 1
    raw = events(spark, sf).select(
        "event_id",
        F.date_trunc("day", "ts").alias("day"),
        F.when(F.col("event_type") != "error", period).alias("period"),
    )
    return out(raw.select("event_id", readers.settlement_time("day", "period").alias("timestamp")))


@query(
    "s8_schema_report",
    """
    SELECT 'event_id' AS column_name, 'bigint' AS expected, 'bigint' AS found, 'ok' AS verdict, CAST(0 AS BIGINT) AS lost_values
    UNION ALL SELECT 'value', 'int', 'double', 'cast', count(*) FILTER (WHERE value IS NOT NULL AND try_cast(value AS INTEGER) IS NULL) FROM events
    UNION ALL SELECT 'props', 'double', 'string', 'cast', count(*) FILTER (WHERE props IS NOT NULL AND try_cast(props AS DOUBLE) IS NULL) FROM events
    """,
)
def s8(spark, sf):
    _, report = validate.safe_cast(
        table(spark, sf, "events"), {"event_id": "bigint", "value": "int", "props": "double"}
    )
    return report


@query(
    "s9_range_report",
    f"""
    WITH s AS (SELECT event_type AS series, 50.0 + (value - 50.0) / 200.0 AS f, value FROM events)
    SELECT series, 'grid_frequency' AS column_name, {r('min(f)', 'min_value')}, {r('max(f)', 'max_value')},
      count(*) FILTER (WHERE NOT (f > 40.0 AND f < 60.0)) AS bad_rows FROM s GROUP BY series
    UNION ALL
    SELECT series, 'temperature', min(value), max(value),
      count(*) FILTER (WHERE NOT (value > -50.0 AND value < 50.0)) FROM s GROUP BY series
    """,
)
def s9(spark, sf):
    rows = signal(spark, sf).withColumn("temperature", F.round((F.col("grid_frequency") - 50.0) * 200.0 + 50.0, 2))
    checks = {**validate.FREQUENCY_CHECKS, **validate.WEATHER_CHECKS}
    return out(validate.range_report(rows, checks, ["series"]))


@query(
    "s10_matched_columns",
    "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS timestamp_date, hour(ts) * 2 AS settlement_period, "
    "value AS system_inertia_mws FROM events",
)
def s10(spark, sf):
    raw = events(spark, sf).select(
        F.date_trunc("day", "ts").alias("Settlement Date"),
        (F.hour("ts") * 2).cast("bigint").alias("SETTLEMENT PERIOD"),
        F.col("value").alias("Outturn Inertia MW.s"),
    )
    return out(readers.rename_matched(raw))


@query(
    "s11_materialised_table",
    f"""SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS timestamp, {r('avg(value) / 5', 'wind_speed')},
    {r("avg(CASE WHEN event_type = 'view' THEN value END)", 'solar_radiation')} FROM events GROUP BY 1""",
)
def s11(spark, sf):
    root = f"{work_root(spark)}/materialised/{sf.strip('/').replace('/', '_')}"
    return out(sinks.materialised(spark, root, "2024-01-01", "2024-01-30", "hourly-1", lambda: hourly(spark, sf)))


@query(
    "s11_published_version",
    f"""SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS timestamp, {r('avg(value) / 5', 'wind_speed')},
    {r("avg(CASE WHEN event_type = 'view' THEN value END)", 'solar_radiation')} FROM events GROUP BY 1""",
)
def s11_published(spark, sf):
    """The version that readers find after a second one has failed halfway."""
    root = work_path(spark, "published")
    sinks.published(spark, root, "hourly-1", lambda path: hourly(spark, sf).write.parquet(f"{path}/hourly"))

    def fails(path):
        hourly(spark, sf).limit(1).write.parquet(f"{path}/hourly")
        raise InterruptedError("halfway")

    try:
        sinks.published(spark, root, "hourly-2", fails)
    except InterruptedError:
        pass
    return out(spark.read.parquet(f"{sinks.newest(spark, root)}/hourly"))


@query(
    "s12_csv_slice",
    "SELECT event_id, ts, value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-09' AND TIMESTAMP '2024-01-10'",
)
def s12(spark, sf):
    path = work_path(spark, "csv-slice")
    rows = table(spark, sf, "events").select("event_id", "ts", "value")
    sinks.write_csv_slice(rows, path, "ts", datetime(2024, 1, 9), datetime(2024, 1, 10))
    return readers.scan(spark, path, "event_id bigint, ts timestamp_ntz, value double", "csv")
