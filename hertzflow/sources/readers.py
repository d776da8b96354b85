"""Readers of landed raw series. All declare their schema; none infers one."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The layouts of the raw files.
FREQUENCY_RAW = "dtm string, f double"
WEATHER_RAW = (
    "timestamp timestamp, temperature double, precipitation double, rain double, snowfall double, "
    "wind_speed double, wind_gusts double, solar_radiation double"
)
COST_RAW = "`Settlement Date` string, Cost bigint"
INERTIA_RAW = "`Settlement Date` string, `Settlement Period` int, `Inertia MW.s` double"
OFFSET_FORMAT = "yyyy-MM-dd HH:mm:ss xx"
ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss"


def scan(spark: SparkSession, path: str | Sequence[str], schema: str, fmt: str = "parquet", **options) -> DataFrame:
    """Typed scan of one or many paths; many paths are one union."""
    if fmt == "csv":
        options = {"header": True, **options}
    return spark.read.schema(schema).format(fmt).options(**options).load(path)


def between(df: DataFrame, column: str, start, end) -> DataFrame:
    """Rows within [start, end], both ends included, as one predicate on the raw column."""
    kind = df.schema[column].dataType
    return df.where(F.col(column).between(F.lit(start).cast(kind), F.lit(end).cast(kind)))


def union_parts(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def unwrap_envelope(df: DataFrame, records: str = "result.records", success: str = "success") -> DataFrame:
    """Rows of the record array of each successful response."""
    return df.where(F.col(success)).select(F.explode(records).alias("_r")).select("_r.*")


def read_envelope(spark: SparkSession, path: str, record_schema: str) -> DataFrame:
    schema = f"success boolean, result struct<records: array<struct<{record_schema}>>>"
    return unwrap_envelope(spark.read.schema(schema).option("multiLine", True).json(path))


def offset_timestamp(column: str, fmt: str = OFFSET_FORMAT) -> Column:
    """Text with a zone offset to an instant."""
    return F.to_timestamp(column, fmt)


def iso_day(column: str) -> Column:
    """ISO text to midnight of its day."""
    return F.date_trunc("day", F.to_timestamp(column, ISO_FORMAT))


def settlement_time(day: str | Column, period: str | Column) -> Column:
    """Start of a half-hour settlement period counted from 1; the day itself if there is none."""
    day = F.col(day) if isinstance(day, str) else day
    period = F.col(period) if isinstance(period, str) else period
    return F.coalesce(F.timestamp_add("MINUTE", ((period.cast("bigint") - 1) * 30).cast("int"), day), day)


def months(spark: SparkSession, start: str, end: str) -> DataFrame:
    """The calendar months ('yyyy-MM') a date range touches."""
    steps = F.expr(
        f"explode(sequence(trunc(date'{start}', 'MM'), trunc(date'{end}', 'MM'), interval 1 month))"
    )
    return spark.range(1).select(steps.alias("_m")).select(F.date_format("_m", "yyyy-MM").alias("month"))


def month_coverage(present: DataFrame, start: str, end: str) -> DataFrame:
    """For each month of a range, whether ``present`` (column ``month``) has it."""
    wanted = months(present.sparkSession, start, end)
    have = present.select("month").distinct().withColumn("present", F.lit(True))
    return wanted.join(have, "month", "left").withColumn("present", F.coalesce("present", F.lit(False)))


def select_months(df: DataFrame, month: str, start: str, end: str) -> DataFrame:
    """Rows of the month partitions of a range; prunes directories of a partitioned table."""
    return df.where(F.col(month).between(start[:7], end[:7]))


def match_columns(columns: Sequence[str], rules: Mapping[str, Sequence[str]]) -> dict[str, str]:
    """Map raw names to canonical ones: a raw name matches if it contains every word.

    Rules are tried in order for each name. Two raw names for one canonical name
    are an error, not a silent choice.
    """
    found: dict[str, str] = {}
    for raw in columns:
        name = next((n for n, words in rules.items() if all(w in raw.lower() for w in words)), None)
        if name in found.values():
            raise ValueError(f"several columns match {name!r}")
        if name:
            found[raw] = name
    return found


# Words by which half-hourly columns are recognised.
SETTLEMENT_RULES = {
    "timestamp_date": ("settlement", "date"),
    "settlement_period": ("settlement", "period"),
    "system_inertia_mws": ("inertia",),
}


def rename_matched(df: DataFrame, rules: Mapping[str, Sequence[str]] = SETTLEMENT_RULES) -> DataFrame:
    return df.withColumnsRenamed(match_columns(df.columns, rules))


def day_range(start, end) -> tuple[dt.datetime, dt.datetime]:
    """The half-open range of instants of whole UTC days, both ``start`` and ``end`` included."""
    first, last = (dt.date.fromisoformat(str(x)[:10]) for x in (start, end))
    midnight = dt.time(tzinfo=dt.timezone.utc)
    return dt.datetime.combine(first, midnight), dt.datetime.combine(last + dt.timedelta(days=1), midnight)


def _during(df: DataFrame, start, end, beyond_hours: int = 0) -> DataFrame:
    low, high = day_range(start, end)
    return df.where((F.col("timestamp") >= F.lit(low)) & (F.col("timestamp") < F.lit(high + dt.timedelta(hours=beyond_hours))))


def _text_days(df: DataFrame, column: str, start, end) -> DataFrame:
    """Prune texts that begin with a date to the days around a range; offsets move an instant by a day at most."""
    low, high = day_range(start, end)
    return df.where(F.col(column).between(str(low.date() - dt.timedelta(days=1)), f"{high.date()}~"))


def read_frequency(spark: SparkSession, path, start, end, fmt: str = "parquet") -> DataFrame:
    raw = _text_days(scan(spark, path, FREQUENCY_RAW, fmt), "dtm", start, end)
    return _during(raw.select(offset_timestamp("dtm").alias("timestamp"), F.col("f").alias("grid_frequency")), start, end)


def read_weather(spark: SparkSession, path, start, end, fmt: str = "parquet", beyond_hours: int = 0) -> DataFrame:
    """Samples of the days; with ``beyond_hours`` also those after them that the last hour leans on."""
    return _during(scan(spark, path, WEATHER_RAW, fmt), start, end, beyond_hours)


def read_daily(spark: SparkSession, path, start, end, fmt: str = "parquet") -> DataFrame:
    raw = _text_days(scan(spark, path, COST_RAW, fmt), "Settlement Date", start, end)
    return _during(raw.select(iso_day("Settlement Date").alias("timestamp"), F.col("Cost").alias("inertia_cost")), start, end)


def read_settlement(spark: SparkSession, path, start, end, fmt: str = "parquet", schema: str = INERTIA_RAW) -> DataFrame:
    raw = _text_days(scan(spark, path, schema, fmt), "Settlement Date", start, end)
    named = rename_matched(raw)
    period = F.col("settlement_period") if "settlement_period" in named.columns else F.lit(None)
    at = settlement_time(iso_day("timestamp_date"), period)
    return _during(named.select(at.alias("timestamp"), F.col("system_inertia_mws").cast("double")), start, end)
