import datetime as dt

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hertzflow.operators import windows
from hertzflow.operators.layout import POS, order_rows
from hertzflow.operators.swinging_door import door_pivots, ramp_rate, swinging_door
from hertzflow.plans.features import build_features, row_features
from hertzflow.settings import MODEL_FEATURES

START = dt.datetime(2019, 8, 9, 16, 50)


@pytest.fixture(scope="module")
def merged(spark):
    """200 rows at 1 Hz with all raw columns."""
    # The seeded series that the expected features are known for.
    rng = np.random.default_rng(42)
    n = 200
    pdf = pd.DataFrame(
        {
            "series": "grid",
            "timestamp": [START + dt.timedelta(seconds=i) for i in range(n)],
            "grid_frequency": 50 + 0.01 * np.cumsum(rng.normal(0, 0.02, n)),
            "wind_speed": 8 + rng.normal(0, 0.5, n),
            "solar_radiation": np.maximum(0, 200 + rng.normal(0, 20, n)),
            "inertia_cost": 1500,
            "temperature": 18 + rng.normal(0, 1, n),
        }
    )
    return spark.createDataFrame(pdf), pdf


@pytest.fixture(scope="module")
def built(merged):
    df = build_features(merged[0], ["series"], ["timestamp"]).df
    return df.orderBy("timestamp").toPandas()


def test_all_columns_no_nulls_and_ten_rows_fewer(built):
    assert set(MODEL_FEATURES) <= set(built.columns) and {"minute", "target_freq_next", "target_is_unstable"} <= set(built)
    assert len(built) == 190 and not built.isna().any().any()


def test_values_match_pandas(built, merged):
    f = merged[1].grid_frequency
    want = pd.DataFrame(
        {
            "rocof": f.diff().rolling(5, min_periods=1).mean().fillna(0),
            **{f"volatility_{k}s": f.rolling(k).std().fillna(0) for k in (10, 30, 60)},
            **{f"lag_{k}s": f.shift(k).fillna(50.0) for k in (1, 5, 60)},
            "target_freq_next": f.shift(-10),
            "renewable_penetration_ratio": merged[1].wind_speed * 3000 / 35000,
        }
    ).iloc[:190]
    for c in want:
        assert np.allclose(built[c], want[c], atol=1e-10), c


def test_rate_is_smoother_than_the_raw_difference(built):
    raw = built.grid_frequency.diff().dropna()
    assert built.rocof.std() < raw.std()


def test_ranges(built):
    assert (built[[c for c in built if c.startswith("volatility")]] >= 0).all().all()
    assert np.isfinite(built.wind_ramp_rate).all() and set(built.target_is_unstable) <= {0, 1}


def test_short_and_constant_series(spark):
    rows = [("flat", START + dt.timedelta(seconds=i), 49.9) for i in range(80)]
    rows += [("one", START, 50.1), *[("nine", START + dt.timedelta(seconds=i), 50.0 + i) for i in range(9)]]
    df = spark.createDataFrame(rows, "series string, timestamp timestamp, grid_frequency double")
    got = row_features(order_rows(df, ["series"], ["timestamp"], chunk_rows=16)).toPandas()
    flat = got[got.series == "flat"]
    assert (flat[["volatility_10s", "volatility_30s", "volatility_60s", "rocof"]] == 0).all().all()
    assert (got[got.series == "nine"].volatility_10s == 0).all()
    one = got[got.series == "one"].iloc[0]
    assert one.rocof == 0 and one.lag_1s == 50.0 and np.isnan(one.target_freq_next) and one.target_is_unstable == 0


def test_lengths_without_a_common_block(series_frame):
    frames = order_rows(series_frame, ["series"], ["ts", "id"], chunk_rows=40).framed(before=60)
    steps = windows.volatility_steps(frames, "x", (7, 30))
    got = frames.trim(windows.add_steps(frames.rows, steps)).orderBy(POS).toPandas()
    for k in (7, 30):
        want = got.groupby("series").x.transform(lambda s, k=k: s.rolling(k).std()).fillna(0)
        assert np.allclose(got[f"volatility_{k}s"], want, atol=1e-8)


def test_countdown_matches_brute_force(series_frame):
    frames = order_rows(series_frame, ["series"], ["ts", "id"], chunk_rows=50).framed(after=20)
    got = frames.trim(frames.rows.withColumn("c", windows.countdown(frames, "x", 49.8, 20))).orderBy(POS).toPandas()
    for _, g in got.groupby("series"):
        x = g.x.to_numpy()
        for i, c in enumerate(g.c):
            hits = [j for j in range(i, min(i + 20, len(x))) if x[j] < 49.8]
            assert (np.isnan(c) and not hits) or c == hits[0] - i


def test_sequences_end_at_the_row_and_label_follows(series_frame):
    ordered = order_rows(series_frame.drop("v"), ["series"], ["ts", "id"], chunk_rows=20)
    got = windows.sequences(ordered, ["x"], 5, label="id").orderBy(POS).collect()
    rows = series_frame.orderBy("series", "ts", "id").collect()
    by_id = {r.id: i for i, r in enumerate(rows)}
    assert len(got) == (700 - 5) + (95 - 5)
    for r in got[::37]:
        i = by_id[r.id]
        assert r.sequence == [q.x for q in rows[i - 4 : i + 1]] and r.next_label == rows[i + 1].id


def test_clean_and_fill(spark):
    inf, nan = float("inf"), float("nan")
    rows = [("a", i, v) for i, v in enumerate([None, inf, 1.0, nan, -inf, 2.0, None])] + [("b", 0, nan), ("b", 1, None)]
    df = spark.createDataFrame(rows, "series string, t int, v double")
    got = windows.clean_and_fill(order_rows(df, ["series"], ["t"], chunk_rows=2), "v").orderBy("series", "t").collect()
    assert [r.v for r in got] == [1.0, 1.0, 1.0, 1.0, 1.0, 2.0, 2.0, 0.0, 0.0]


def test_breach_episodes(spark):
    xs = [49.7, 49.6, 50.0, 49.5, 50.0, None, 49.1]
    df = spark.createDataFrame(
        [("a", START + dt.timedelta(seconds=i), x) for i, x in enumerate(xs)], "series string, ts timestamp, x double"
    )
    got = windows.breach_episodes(order_rows(df, ["series"], ["ts"], chunk_rows=2), "ts", "x").orderBy("start_at").collect()
    assert [(r.breach_rows, r.lowest) for r in got] == [(2, 49.6), (1, 49.5), (1, 49.1)]


def test_first_alert_falls_back_to_the_lowest_score(spark):
    rows = [("a", 1, 50.0), ("a", 2, 49.7), ("a", 3, 49.5), ("b", 1, 50.2), ("b", 2, 50.1)]
    df = spark.createDataFrame(rows, "g string, t int, lower double")
    got = windows.first_alert(df, ["g"], F.col("lower") < 49.8, "lower", ["t"]).collect()
    assert {r.g: (r.alerted, r.t) for r in got} == {"a": (True, 2), "b": (False, 2)}


# ---- swinging door ---------------------------------------------------------------


def test_door_small_inputs():
    assert door_pivots(np.array([]), np.array([]), 0.5).tolist() == []
    assert door_pivots(np.array([1.0]), np.array([3.0]), 0.5).tolist() == [True]
    assert door_pivots(np.array([1.0, 2.0]), np.array([3.0, 9.0]), 0.5).tolist() == [True, True]


def test_door_line_and_step():
    t = np.arange(20.0)
    assert door_pivots(t, 2 * t, 0.1).sum() == 2
    step = np.where(t < 10, 0.0, 5.0)
    kept = np.flatnonzero(door_pivots(t, step, 0.1))
    assert 9 in kept and 10 in kept and len(kept) <= 5


@settings(max_examples=200, deadline=None)
@given(
    st.lists(st.tuples(st.integers(1, 50), st.floats(-100, 100)), min_size=1, max_size=80), st.floats(0.01, 10.0)
)
def test_door_error_stays_within_width(points, width):
    t = np.cumsum([p[0] for p in points]).astype(float)
    v = np.array([p[1] for p in points])
    keep = door_pivots(t, v, width)
    line = np.interp(t, t[keep], v[keep])
    assert np.max(np.abs(line - v)) <= width + 1e-9


@pytest.mark.parametrize("segment", [10, 64, 100_000])
def test_door_segments_keep_the_bound_and_miss_no_slope(series_frame, segment):
    df = series_frame.dropDuplicates(["series", "ts"])
    ordered = order_rows(df, ["series"], ["ts", "id"], chunk_rows=50)
    points = swinging_door(ordered, "ts", "v", 1.0, segment).orderBy(POS).toPandas()
    assert points[POS].is_unique
    raw = ordered.df.where("v IS NOT NULL").orderBy(POS).toPandas()
    for name, g in raw.groupby("series"):
        p = points[points.series == name]
        t, tp = (x.ts.astype("int64").to_numpy(dtype=float) for x in (g, p))
        assert tp[0] == t[0] and tp[-1] == t[-1]
        assert np.max(np.abs(np.interp(t, tp, p.v) - g.v.to_numpy())) <= 1.0 + 1e-9
        assert p.slope.isna().sum() == 1
        want = np.diff(p.v) / (np.diff(p.ts.astype("datetime64[us]").astype("int64")) / 1e6)
        assert np.allclose(p.slope.to_numpy()[1:], want)


@pytest.mark.parametrize("segment", [4, 7, 64])
def test_door_is_that_of_the_whole_series_for_any_segment(spark, segment):
    rng = np.random.default_rng(3)
    walk = np.cumsum(rng.normal(0, 0.4, 150))
    flat = np.where(np.arange(60) < 45, 2.0, 9.0)
    at = {"walk": np.arange(150), "flat": np.arange(60), "ties": np.arange(60) // 3, "one": np.arange(1)}
    v = {"walk": walk, "flat": flat, "ties": walk[:60], "one": walk[:1]}
    rows = [(s, int(i), k, float(x)) for s in at for k, (i, x) in enumerate(zip(at[s], v[s]))]
    df = spark.createDataFrame(rows, "series string, at long, id long, v double").withColumn("ts", F.timestamp_seconds("at")).drop("at")
    points = swinging_door(order_rows(df, ["series"], ["ts", "id"], chunk_rows=50), "ts", "v", 1.0, segment)
    got = points.orderBy(POS).toPandas()
    for s in set(got.series):
        keep = door_pivots(at[s].astype(float), v[s], 1.0)
        p = got[got.series == s]
        assert p.v.tolist() == v[s][keep].tolist()
        gap = np.diff(at[s][keep])
        want = np.where(gap > 0, np.diff(v[s][keep]) / np.where(gap > 0, gap, 1), np.nan)
        assert np.allclose(p.slope.to_numpy()[1:], want, equal_nan=True) and np.isnan(p.slope.iloc[0])


@pytest.mark.parametrize("rows", [20, 300])
def test_countdown_from_behind(series_frame, rows):
    ordered = order_rows(series_frame, ["series"], ["ts", "id"], chunk_rows=50)
    frames = ordered.framed(after=rows)
    want = frames.trim(frames.rows.withColumn("c", windows.countdown(frames, "x", 49.8, rows))).orderBy(POS).toPandas()
    got = windows.countdown_rows(ordered, "x", 49.8, rows, "c").orderBy(POS).toPandas()
    assert want.c.equals(got.c) and got.c.notna().any()


def test_door_takes_one_round_on_flat_straight_and_noisy_series(spark, monkeypatch):
    from hertzflow.operators import swinging_door as door

    rng = np.random.default_rng(8)
    n = 360
    v = {"flat": np.full(n, 5.0), "line": 0.01 * np.arange(n), "noise": rng.normal(0, 2, n), "calm": rng.normal(0, 0.1, n)}
    rows = [(s, i, float(x)) for s, y in v.items() for i, x in enumerate(y)]
    df = spark.createDataFrame(rows, "series string, id long, v double").withColumn("ts", F.timestamp_seconds("id"))
    written = []
    keep = door.stage
    monkeypatch.setattr(door, "stage", lambda df, label: (written.append(label), keep(df, label))[1])
    for segment in (30, 120):
        written.clear()
        got = swinging_door(order_rows(df, ["series"], ["ts"], chunk_rows=50), "ts", "v", 1.0, segment).orderBy(POS).toPandas()
        assert written.count("door-states") == 1
        for s, y in v.items():
            assert got[got.series == s].v.tolist() == y[door_pivots(np.arange(n, dtype=float), y, 1.0)].tolist()


def test_ramp_rate_covers_every_row(series_frame):
    ordered = order_rows(series_frame, ["series"], ["ts", "id"], chunk_rows=50)
    for width in (None, 0.5):
        got = ramp_rate(ordered, "ts", "v", width).toPandas()
        assert len(got) == 798 and np.isfinite(got.ramp_rate).all()


def test_fill_linear_between_samples_of_one_instant(spark):
    from hertzflow.operators.resample import fill_linear

    rows = [("s", 0, 0, 1.0), ("s", 0, 1, None), ("s", 0, 2, 3.0), ("s", 10, 3, None), ("s", 20, 4, 5.0)]
    df = spark.createDataFrame(rows, "g string, at long, id long, x double").withColumn("t", F.timestamp_seconds("at")).drop("at")
    got = {r.id: r.x for r in fill_linear(df, ["g"], "t", ["x"], tie=["id"]).collect()}
    assert got == {0: 1.0, 1: 1.0, 2: 3.0, 3: 4.0, 4: 5.0}
