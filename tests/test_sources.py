import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from hertzflow.sources import readers, sinks, validate


def test_frequency_reader_parses_offsets_and_keeps_the_last_day(spark, tmp_path):
    rows = [("2019-08-01 00:30:00 +0100", 50.0), ("2019-08-02 23:59:59 +0000", 49.9), ("2019-08-03 00:00:00 +0000", 49.8)]
    spark.createDataFrame(rows, "dtm string, f double").write.parquet(f"{tmp_path}/f")
    got = readers.read_frequency(spark, f"{tmp_path}/f", "2019-08-01", "2019-08-02").orderBy("timestamp").collect()
    # The range is one of instants: half past midnight at +0100 is still the day before.
    assert [r.timestamp for r in got] == [dt.datetime(2019, 8, 2, 23, 59, 59)]
    got = readers.read_frequency(spark, f"{tmp_path}/f", "2019-07-31", "2019-08-02").orderBy("timestamp").collect()
    assert [r.timestamp for r in got] == [dt.datetime(2019, 7, 31, 23, 30), dt.datetime(2019, 8, 2, 23, 59, 59)]


def test_daily_and_settlement_readers(spark, tmp_path):
    spark.createDataFrame([("2019-08-01T00:00:00", 1500)], "`Settlement Date` string, Cost bigint").write.json(f"{tmp_path}/c")
    cost = readers.read_daily(spark, f"{tmp_path}/c", "2019-08-01", "2019-08-31", "json").first()
    assert (cost.timestamp, cost.inertia_cost) == (dt.datetime(2019, 8, 1), 1500)
    rows = [("2019-08-01T00:00:00", p, 10.0 * p) for p in (1, 2, 48)] + [("2019-08-02T00:00:00", None, 5.0)]
    spark.createDataFrame(rows, readers.INERTIA_RAW).write.parquet(f"{tmp_path}/i")
    got = readers.read_settlement(spark, f"{tmp_path}/i", "2019-08-01", "2019-08-02").orderBy("timestamp").collect()
    assert [(r.timestamp.hour, r.timestamp.minute) for r in got] == [(0, 0), (0, 30), (23, 30), (0, 0)]
    bare = spark.createDataFrame([("2019-08-03T00:00:00", 7.0)], "`Settlement Date` string, Inertia double")
    bare.write.parquet(f"{tmp_path}/b")
    alone = readers.read_settlement(
        spark, f"{tmp_path}/b", "2019-08-03", "2019-08-03", schema="`Settlement Date` string, Inertia double"
    ).first()
    assert alone.timestamp == dt.datetime(2019, 8, 3)


def test_weather_reader_pushes_the_range_down(spark, tmp_path, capsys):
    row = (dt.datetime(2019, 8, 1), *[1.0] * 7)
    spark.createDataFrame([row], readers.WEATHER_RAW).write.parquet(f"{tmp_path}/w")
    df = readers.read_weather(spark, f"{tmp_path}/w", "2019-07-01", "2019-08-02").select("timestamp", "wind_speed")
    assert df.count() == 1
    df.explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThanOrEqual(timestamp" in plan and "ReadSchema: struct<timestamp:timestamp,wind_speed:double>" in plan


def test_envelope_file(spark, tmp_path):
    good = {"success": True, "result": {"records": [{"dtm": "a", "f": 1.5}, {"dtm": "b", "f": 2.5}]}}
    (tmp_path / "a.json").write_text(json.dumps(good, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"success": False, "result": {"records": [{"dtm": "c", "f": 3.0}]}}))
    got = readers.read_envelope(spark, str(tmp_path), "dtm: string, f: double").orderBy("dtm").collect()
    assert [tuple(r) for r in got] == [("a", 1.5), ("b", 2.5)]


def test_two_matching_columns_are_an_error():
    assert readers.match_columns(["Settlement Date", "Other", "Inertia"], readers.SETTLEMENT_RULES) == {
        "Settlement Date": "timestamp_date",
        "Inertia": "system_inertia_mws",
    }
    with pytest.raises(ValueError, match="system_inertia_mws"):
        readers.match_columns(["Outturn Inertia", "Market Inertia MW"], readers.SETTLEMENT_RULES)


def test_month_selection_prunes_partitions(spark, tmp_path, capsys):
    df = spark.createDataFrame([("2019-07", 1), ("2019-08", 2), ("2019-09", 3)], "month string, v int")
    sinks.write_partitioned(df, f"{tmp_path}/m", ["month"])
    table = spark.read.schema("v int, month string").parquet(f"{tmp_path}/m")
    got = readers.select_months(table, "month", "2019-08-05", "2019-09-01")
    assert sorted(r.v for r in got.collect()) == [2, 3]
    got.explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(month" in plan
    cover = {r.month: r.present for r in readers.month_coverage(table, "2019-08-31", "2019-10-01").collect()}
    assert cover == {"2019-08": True, "2019-09": True, "2019-10": False}


def test_validation_casts_reports_and_keeps_rows(spark):
    df = spark.createDataFrame([("50.1", 1), ("x", 2), ("70", 3)], "grid_frequency string, k int")
    rows, schema, ranges = validate.validate(df, {"grid_frequency": "double", "k": "int"}, validate.FREQUENCY_CHECKS)
    assert [r.grid_frequency for r in rows.orderBy("k").collect()] == [50.1, None, 70.0]
    assert {r.column_name: (r.verdict, r.lost_values) for r in schema.collect()} == {"grid_frequency": ("cast", 1), "k": ("ok", 0)}
    r = ranges.first()
    assert (r.min_value, r.max_value, r.bad_rows) == (50.1, 70.0, 1)
    good, bad = validate.quarantine(rows, validate.FREQUENCY_CHECKS)
    assert good.count() == 2 and bad.count() == 1


def test_missing_column_is_reported_and_rows_pass(spark):
    df = spark.createDataFrame([("1",)], "a string")
    rows, report = validate.safe_cast(df, {"a": "int", "b": "double"})
    assert rows.schema["a"].dataType.simpleString() == "string"
    assert {r.column_name: r.verdict for r in report.collect()} == {"a": "cast", "b": "missing"}


def test_materialised_table_is_built_once_per_version(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    for version in ("v1", "v1", "v2"):
        assert sinks.materialised(spark, str(tmp_path), "a", "b", version, build).count() == 3
    assert len(built) == 2


def test_csv_slice_includes_both_ends(spark, tmp_path):
    days = [dt.datetime(2019, 8, d) for d in (8, 9, 10, 11)]
    df = spark.createDataFrame([(d,) for d in days], "ts timestamp")
    sinks.write_csv_slice(df, f"{tmp_path}/o", "ts", days[1], days[2])
    got = readers.scan(spark, f"{tmp_path}/o", "ts timestamp", "csv")
    assert sorted(r.ts for r in got.collect()) == days[1:3]
    assert spark.read.text(f"{tmp_path}/o").where(F.col("value") == "ts").count() >= 1
