import datetime as dt
import os
import pathlib
import shutil
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from hertzflow.operators.layout import order_rows
from hertzflow.plans.features import row_features
from hertzflow.streaming import jobs

SCHEMA = "series string, timestamp timestamp, event_id bigint, grid_frequency double"
START = dt.datetime(2024, 1, 1)


def land(spark, path, parts):
    """One file per part; a stream takes them in order of modification time."""
    folder = pathlib.Path(path)
    folder.mkdir(exist_ok=True)
    for rows in parts:
        made = folder.parent / f"made-{uuid.uuid4().hex}"
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(made))
        (part,) = made.glob("*.parquet")
        number = len(list(folder.iterdir()))
        target = folder / f"part-{number}.parquet"
        shutil.copy(part, target)
        os.utime(target, (1_700_000_000 + number, 1_700_000_000 + number))


def rows_of(n, series=("a", "b"), seed=0):
    rng = np.random.default_rng(seed)
    x = 50 + np.cumsum(rng.normal(0, 0.05, n))
    return [(series[i % len(series)], START + dt.timedelta(seconds=i), i, float(x[i])) for i in range(n)]


def stream(spark, path):
    return jobs.read_folder(spark, path, SCHEMA, max_files=1)


def test_live_features_equal_batch_over_several_batches(spark, tmp_path):
    rows = rows_of(400)
    shuffled = [rows[i : i + 100][::-1] for i in range(0, 400, 100)]
    land(spark, f"{tmp_path}/in", shuffled)
    live = jobs.drain(jobs.row_features(stream(spark, f"{tmp_path}/in"), "series", "timestamp", "event_id", "grid_frequency"), "t")
    batch = row_features(order_rows(spark.createDataFrame(rows, SCHEMA), ["series"], ["timestamp"], chunk_rows=50))
    a, b = (d.orderBy("event_id").toPandas() for d in (live, batch))
    assert len(a) == 400 and not a.late.any()
    for c in ("rocof", "volatility_10s", "volatility_30s", "volatility_60s", "lag_1s", "lag_5s", "lag_60s"):
        assert np.allclose(a[c], b[c], atol=1e-9), c


def test_late_rows_are_passed_on_without_features(spark, tmp_path):
    rows = rows_of(60, ("a",))
    land(spark, f"{tmp_path}/in", [rows[:20] + rows[40:], rows[20:40]])
    got = jobs.drain(
        jobs.row_features(stream(spark, f"{tmp_path}/in"), "series", "timestamp", "event_id", "grid_frequency"), "t"
    ).toPandas()
    assert len(got) == 60 and got.late.sum() == 20 and got[got.late].lag_1s.isna().all()
    assert set(got[got.late].event_id) == set(range(20, 40))


def test_ingest_drops_repeats(spark, tmp_path):
    rows = rows_of(50)
    land(spark, f"{tmp_path}/in", [rows[:30], rows[20:]])
    got = jobs.drain(jobs.ingest(stream(spark, f"{tmp_path}/in"), "timestamp", ["event_id"], "1 hour"), "t")
    assert got.count() == 50


def test_window_summary_keeps_the_last_version(spark, tmp_path):
    rows = rows_of(100)
    land(spark, f"{tmp_path}/in", [rows[:45], rows[45:]])
    path = jobs.drain_batches(
        jobs.window_summary(stream(spark, f"{tmp_path}/in"), "timestamp", ["series"], "grid_frequency"), "t", mode="update"
    )
    got = jobs.latest(spark, path, ["window_start", "window_end", "series"])
    want = (
        spark.createDataFrame(rows, SCHEMA)
        .groupBy(F.window("timestamp", "10 seconds"), "series")
        .agg(F.min("grid_frequency").alias("m"), F.count_if(F.col("grid_frequency") < 49.8).alias("b"))
    )
    a = sorted((r.window_start, r.series, r.min_value, r.breach_rows) for r in got.collect())
    b = sorted((r.window.start, r.series, r.m, r.b) for r in want.collect())
    assert a == b and len(a) == 20


def test_sessions_split_at_the_gap(spark, tmp_path):
    at = [0, 30, 200, 210, 2000]
    rows = [("a", START + dt.timedelta(seconds=s), s, 49.5) for s in at]
    land(spark, f"{tmp_path}/in", [rows])
    got = jobs.drain(jobs.breach_sessions(stream(spark, f"{tmp_path}/in"), "timestamp", ["series"], "grid_frequency"), "t")
    assert sorted(r.breach_rows for r in got.collect()) == [2, 2]


def test_restart_writes_nothing_twice(spark, tmp_path):
    rows = rows_of(40)
    land(spark, f"{tmp_path}/in", [rows[:20]])
    slow = spark.createDataFrame([(START, 7)], "at timestamp, cost int")
    def run():
        s = jobs.attach_slow(stream(spark, f"{tmp_path}/in"), slow, "timestamp", "at", "day")
        return jobs.drain_batches(s, "t", lambda b: b.withColumn("twice", F.col("cost") * 2), path=f"{tmp_path}/out")
    run()
    land(spark, f"{tmp_path}/in", [rows[20:]])
    got = spark.read.parquet(run())
    assert got.count() == 40 and got.where("twice = 14").count() == 40


def test_timeout_stops_the_query(spark, tmp_path):
    class Slow:
        def awaitTermination(self, _):
            return False

        def stop(self):
            self.stopped = True

    q = Slow()
    with pytest.raises(TimeoutError):
        jobs._finish(q, 1)
    assert q.stopped


def test_live_nulls_are_as_in_batch(spark, tmp_path):
    rows = [(s, t, i, None if i % 17 == 3 else v) for s, t, i, v in rows_of(300)]
    land(spark, f"{tmp_path}/in", [rows[i : i + 75] for i in range(0, 300, 75)])
    live = jobs.drain(jobs.row_features(stream(spark, f"{tmp_path}/in"), "series", "timestamp", "event_id", "grid_frequency"), "t")
    batch = row_features(order_rows(spark.createDataFrame(rows, SCHEMA), ["series"], ["timestamp"], chunk_rows=50))
    a, b = (d.orderBy("event_id").toPandas() for d in (live, batch))
    for c in ("rocof", "volatility_10s", "volatility_30s", "volatility_60s", "lag_1s", "lag_5s", "lag_60s"):
        assert np.allclose(a[c], b[c], atol=1e-9), c


def test_open_sessions_complete_the_closed_ones(spark, tmp_path):
    rows = [("a", START + dt.timedelta(seconds=s), i, 49.0) for i, s in enumerate([0, 10, 500, 1000, 1010])]
    land(spark, f"{tmp_path}/in", [rows[:3], rows[3:]])
    closed = jobs.drain(jobs.breach_sessions(stream(spark, f"{tmp_path}/in"), "timestamp", ["series"], "grid_frequency"), "t")
    got = jobs.with_open_sessions(closed, spark.createDataFrame(rows, SCHEMA), "timestamp", ["series"], "grid_frequency")
    assert sorted((r.session_start, r.breach_rows) for r in got.collect()) == [
        (START, 2), (START + dt.timedelta(seconds=500), 1), (START + dt.timedelta(seconds=1000), 2)
    ]


FEATURES = ("rocof", "volatility_10s", "volatility_30s", "volatility_60s", "lag_1s", "lag_5s", "lag_60s")


def drained(spark, tmp_path, **place):
    source = stream(spark, f"{tmp_path}/in")
    return jobs.drain_row_features(source, "series", "timestamp", "event_id", "grid_frequency", **place)


def test_drained_features_equal_batch_and_carry_absent_series(spark, tmp_path):
    rows = [(s, t, i, None if i % 23 == 3 else v) for s, t, i, v in rows_of(400)]
    # Series b is absent from the second batch.
    held = [x for x in rows[100:200] if x[0] == "b"]
    parts = [rows[:100][::-1], [x for x in rows[100:200] if x[0] == "a"], held + rows[200:300], rows[300:]]
    land(spark, f"{tmp_path}/in", parts)
    live = drained(spark, tmp_path)
    batch = row_features(order_rows(spark.createDataFrame(rows, SCHEMA), ["series"], ["timestamp"], chunk_rows=50))
    a, b = (d.orderBy("event_id").toPandas() for d in (live, batch))
    assert len(a) == 400 and not a.late.any()
    for c in FEATURES:
        assert np.allclose(a[c], b[c], atol=1e-9), c


def test_drained_late_rows_and_restart(spark, tmp_path):
    rows = rows_of(60, ("a",))
    land(spark, f"{tmp_path}/in", [rows[:20] + rows[40:], rows[20:40]])
    got = drained(spark, tmp_path, path=f"{tmp_path}/out").toPandas()
    assert len(got) == 60 and set(got[got.late].event_id) == set(range(20, 40)) and got[got.late].lag_1s.isna().all()
    more = rows_of(61, ("a",))[60:]
    land(spark, f"{tmp_path}/in", [more])
    again = drained(spark, tmp_path, path=f"{tmp_path}/out").toPandas()
    new = again[again.event_id == 60]
    assert len(again) == 61 and new.lag_1s.tolist() == [rows[59][3]]


def test_no_worker_of_the_live_features_gets_a_whole_series(spark, tmp_path, monkeypatch):
    from inventory import live

    def whole(*_, **__):
        raise AssertionError("the registered query gathers a series in one worker")

    monkeypatch.setattr(jobs, "row_features", whole)
    assert live.t3(spark, "/root/testdata/sf0.001").count() > 0


def test_the_stream_closes_its_own_sessions(spark, tmp_path):
    at = [0, 10, 500, 1000, 1010]
    rows = [("a", START + dt.timedelta(seconds=s), i, 49.0) for i, s in enumerate(at)] + [("b", START, 9, None)]
    land(spark, f"{tmp_path}/in", [rows[:2], rows[2:]])
    got = jobs.drain_sessions(stream(spark, f"{tmp_path}/in"), "timestamp", ["series"], "grid_frequency", path=f"{tmp_path}/s")
    assert sorted((r.series, r.session_start, r.breach_rows) for r in got.collect()) == [
        ("a", START, 2), ("a", START + dt.timedelta(seconds=500), 1), ("a", START + dt.timedelta(seconds=1000), 2)
    ]


def test_live_asof_equals_the_batch_join(spark, tmp_path):
    from hertzflow.operators.asof import asof_join

    rows = rows_of(200)
    land(spark, f"{tmp_path}/in", [rows[i : i + 40] for i in range(0, 200, 40)])
    # Gaps, two rows of one instant, and nothing before the first live rows.
    slow_rows = [(START + dt.timedelta(seconds=s), k, v) for s, k, v in ((20, 1, 1.0), (21, 1, 2.0), (21, 2, 3.0), (90, 1, 4.0))]
    slow = spark.createDataFrame(slow_rows, "at timestamp, k int, wind double")
    got = jobs.drain_asof(stream(spark, f"{tmp_path}/in"), lambda: slow, "timestamp", "at", tie=["k"])
    want = asof_join(spark.createDataFrame(rows, SCHEMA), slow, "timestamp", right_on="at", tie=["k"])
    a, b = (sorted((r.event_id, r.k, r.wind) for r in d.collect()) for d in (got, want))
    assert a == b and len(a) == 200 and {w for _, _, w in a} >= {None, 3.0, 4.0}
