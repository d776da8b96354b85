"""The whole job on small raw files."""

import datetime as dt

import numpy as np
import pytest

from hertzflow.plans.job import Periods, build, run, score_saved
from hertzflow.sources import readers

START = dt.datetime(2019, 8, 9)
SECONDS = 3 * 3600


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    rng = np.random.default_rng(1)
    x = 50 + 0.2 * np.sin(np.arange(SECONDS) / 300) + rng.normal(0, 0.01, SECONDS)
    rows = [((START + dt.timedelta(seconds=i)).strftime("%Y-%m-%d %H:%M:%S +0000"), float(v)) for i, v in enumerate(x)]
    spark.createDataFrame(rows, readers.FREQUENCY_RAW).write.parquet(f"{root}/frequency")
    hours = [(START + dt.timedelta(hours=h), *(float(h + k) for k in range(7))) for h in range(4)]
    spark.createDataFrame(hours, readers.WEATHER_RAW).write.parquet(f"{root}/weather")
    spark.createDataFrame([("2019-08-09T00:00:00", 1500)], readers.COST_RAW).write.parquet(f"{root}/inertia")
    return {n: f"{root}/{n}" for n in ("frequency", "weather", "inertia")}


def test_build_interpolates_and_carries(spark, raw):
    rows = build(spark, raw, "2019-08-09", "2019-08-10").df
    assert rows.count() == SECONDS - 10
    r = rows.where("timestamp = timestamp'2019-08-09 01:30:00'").first()
    assert r.temperature == pytest.approx(1.5) and r.wind_speed == pytest.approx(5.5) and r.inertia_cost == 1500


def test_the_end_date_is_whole_and_its_last_hour_is_on_the_line(spark, tmp_path):
    late = dt.datetime(2019, 8, 10, 22, 30)
    rows = [((late + dt.timedelta(seconds=i)).strftime("%Y-%m-%d %H:%M:%S +0000"), 50.0 + i % 7 / 100) for i in range(5390)]
    spark.createDataFrame(rows, readers.FREQUENCY_RAW).write.parquet(f"{tmp_path}/frequency")
    hours = [(dt.datetime(2019, 8, 10) + dt.timedelta(hours=h), *(float(h + k) for k in range(7))) for h in range(26)]
    spark.createDataFrame(hours, readers.WEATHER_RAW).write.parquet(f"{tmp_path}/weather")
    spark.createDataFrame([("2019-08-10T00:00:00", 1500)], readers.COST_RAW).write.parquet(f"{tmp_path}/inertia")
    raw = {n: f"{tmp_path}/{n}" for n in ("frequency", "weather", "inertia")}
    got = build(spark, raw, "2019-08-10", "2019-08-10").df
    r = got.where("timestamp = timestamp'2019-08-10 23:30:00'").first()
    assert r.temperature == pytest.approx(23.5)


@pytest.mark.parametrize("recalibrate", ["shift", "isotonic"])
def test_run(spark, raw, tmp_path, recalibrate):
    periods = Periods("2019-08-09 01:30:00", "2019-08-09 02:15:00", "2019-08-09 03:00:00")
    tables = run(
        spark, raw, str(tmp_path / "out"), "2019-08-09", "2019-08-10", periods,
        recalibrate=recalibrate, rounds=4, depth=5, learning_rate=0.2,
    )
    m = tables["metrics"].first()
    assert m.rows == 45 * 60 - 10
    assert m.mae_lower < 0.08 and m.mae_upper < 0.08
    if recalibrate == "shift":
        assert 0.6 < m.picp < 0.95
    assert tables["decisions"].where("status IS NULL OR trust < 0 OR trust > 100").count() == 0
    assert tables["days"].count() == 1 and tables["features"].count() == SECONDS - 10
    assert {r.source for r in tables["validation"].collect()} == {"frequency", "weather", "inertia"}
    assert tables["sequence"].count() == 45 * 60 - 10
    again = score_saved(spark, str(tmp_path / "out/models"), raw, "2019-08-09", "2019-08-09", (periods.test, periods.end))
    columns = ["timestamp", "lower", "upper", "probability", "status"]
    assert again["decisions"].select(columns).exceptAll(tables["decisions"].select(columns)).count() == 0
    assert again["sequence"].exceptAll(tables["sequence"]).count() == 0
    earlier = score_saved(spark, str(tmp_path / "out/models"), raw, "2019-08-09", "2019-08-09", ("2019-08-09", "2019-08-09 01:00:00"))
    assert earlier["metrics"].first().rows == 3600
    sliced = spark.read.option("header", True).csv(str(tmp_path / "out" / "test_slice"))
    assert sliced.count() == 45 * 60 - 10


def test_a_second_run_computes_nothing_and_a_failed_one_changes_nothing(spark, raw, tmp_path, monkeypatch):
    from hertzflow.plans import job

    periods = Periods("2019-08-09 01:30:00", "2019-08-09 02:15:00", "2019-08-09 03:00:00")
    args = (spark, raw, str(tmp_path / "out"), "2019-08-09", "2019-08-10")
    first = run(*args, periods, rounds=2, depth=3)

    def refuse(*_, **__):
        raise AssertionError("computed again")

    with monkeypatch.context() as m:
        for name in ("sources", "merge", "fit_bounds", "fit_sequence_monitor", "fit_instability_classifier", "conformal_bounds"):
            m.setattr(job, name, refuse)
        second = run(*args, periods, rounds=2, depth=3)
        for name in ("decisions", "features", "sequence"):
            assert second[name].inputFiles() == first[name].inputFiles()
        assert second["metrics"].collect() == first["metrics"].collect()
        # Another recalibration reuses the features, fails at its models, and leaves the others.
        with pytest.raises(AssertionError, match="computed again"):
            run(*args, periods, recalibrate="none", rounds=2, depth=3)
        third = run(*args, periods, rounds=2, depth=3)
        assert third["decisions"].inputFiles() == first["decisions"].inputFiles()
        with pytest.raises(AssertionError, match="computed again"):
            run(*args, periods, rounds=2, depth=3, reuse=False)
