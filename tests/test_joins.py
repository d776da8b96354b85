import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hertzflow.operators import asof
from hertzflow.operators.resample import asof_interpolated, fill_linear, upsample_linear


def stamp(s):
    return dt.datetime(2020, 1, 1) + dt.timedelta(seconds=s)


@pytest.fixture(scope="module")
def sides(spark):
    rng = np.random.default_rng(3)
    left = pd.DataFrame(
        {"g": rng.choice(["a", "b", "c"], 400, p=[0.7, 0.2, 0.1]), "s": rng.integers(0, 3000, 400), "lid": range(400)}
    )
    right = pd.DataFrame({"g": rng.choice(["a", "b"], 150), "s": rng.integers(500, 2500, 150), "rid": range(150)})
    rows_l = [(r.g, stamp(int(r.s)), int(r.lid)) for r in left.itertuples()]
    rows_r = [(r.g, stamp(int(r.s)), int(r.rid)) for r in right.itertuples()]
    return (
        left,
        right,
        spark.createDataFrame(rows_l, "g string, ts timestamp, lid bigint"),
        spark.createDataFrame(rows_r, "g string, rts timestamp, rid bigint"),
    )


def brute(left, right, by_group, tolerance=None):
    want = {}
    for r in left.itertuples():
        c = right[(right.s <= r.s) & ((right.g == r.g) | (not by_group))]
        if tolerance is not None:
            c = c[r.s - c.s <= tolerance]
        want[r.lid] = None if c.empty else int(c.sort_values(["s", "rid"]).rid.iloc[-1])
    return want


@pytest.mark.parametrize("strategy", ["broadcast", "sorted"])
@pytest.mark.parametrize("by_group", [True, False])
@pytest.mark.parametrize("tolerance", [None, 20])
def test_asof_matches_brute_force(sides, strategy, by_group, tolerance):
    left, right, l, r = sides
    r = r if by_group else r.drop("g")
    got = asof.asof_join(
        l, r, "ts", right_on="rts", by=["g"] if by_group else [], tie=["rid"], left_tie=["lid"],
        tolerance_seconds=tolerance, strategy=strategy,
    )
    assert got.columns == ["g", "ts", "lid", "rid"]
    assert {x.lid: x.rid for x in got.collect()} == brute(left, right, by_group, tolerance)


def test_auto_falls_back_when_the_right_side_is_dense(sides, monkeypatch):
    left, right, l, r = sides
    monkeypatch.setattr(asof, "MAX_ROWS_PER_BUCKET", 1)
    with pytest.raises(ValueError, match="broadcast"):
        asof.asof_join(l, r, "ts", right_on="rts", by=["g"], tie=["rid"], strategy="broadcast")
    got = asof.asof_join(l, r, "ts", right_on="rts", by=["g"], tie=["rid"], left_tie=["lid"])
    assert {x.lid: x.rid for x in got.collect()} == brute(left, right, True)


def test_asof_with_an_empty_right_side(sides):
    _, _, l, r = sides
    got = asof.asof_join(l, r.where("rid < 0"), "ts", right_on="rts", by=["g"], tie=["rid"], left_tie=["lid"])
    assert got.where("rid IS NOT NULL").count() == 0 and got.count() == 400


def test_asof_rejects_columns_on_both_sides(sides):
    _, _, l, r = sides
    with pytest.raises(ValueError, match="lid"):
        asof.asof_join(l, r.withColumn("lid", F.lit(1)), "ts", right_on="rts", by=["g"])


def test_attach_fills_missing(spark):
    l = spark.createDataFrame([(1,), (2,)], "k int")
    r = spark.createDataFrame([(1, 4.0)], "k int, v double")
    assert sorted(map(tuple, asof.attach(l, r, ["k"], {"v": 0.0}).collect())) == [(1, 4.0), (2, 0.0)]


def test_upsample_interpolates_in_time_and_stops_at_the_last_sample(spark):
    rows = [("a", stamp(0), 0.0), ("a", stamp(4), 8.0), ("a", stamp(10_004), 8.0), ("b", stamp(5), 1.0)]
    df = spark.createDataFrame(rows, "series string, ts timestamp, v double")
    got = upsample_linear(df, ["series"], "ts", ["v"]).orderBy("series", "ts").collect()
    assert len(got) == 10_005 + 1
    assert [r.v for r in got[:6]] == [0.0, 2.0, 4.0, 6.0, 8.0, 8.0]
    assert [r.ts for r in got[:3]] == [stamp(0), stamp(1), stamp(2)]
    assert got[10_004].ts == stamp(10_004) and got[-1].series == "b"


def test_fill_linear_bridges_nulls(spark):
    values = [None, 1.0, None, None, 7.0, None]
    at = [0, 10, 20, 30, 70, 80]
    df = spark.createDataFrame([("a", stamp(s), v) for s, v in zip(at, values)], "series string, ts timestamp, v double")
    got = [r.v for r in fill_linear(df, ["series"], "ts", ["v"]).orderBy("ts").collect()]
    assert got == [None, 1.0, pytest.approx(2.0), pytest.approx(3.0), 7.0, 7.0]


def test_nearest_row_prefers_the_earlier_on_a_tie(spark):
    df = spark.createDataFrame([(stamp(0), 1), (stamp(10), 2), (stamp(30), 3)], "ts timestamp, id bigint")
    df = df.withColumn("day", F.to_date("ts"))
    targets = spark.createDataFrame([("x", stamp(5)), ("y", stamp(29))], "label string, at timestamp")
    targets = targets.withColumn("day", F.to_date("at"))
    got = asof.nearest_row(df, targets, "ts", "at", ["day"], ["label"])
    assert {r.label: r.id for r in got.collect()} == {"x": 1, "y": 3}


@pytest.mark.parametrize("strategy", ["broadcast", "sorted"])
def test_interpolated_asof_equals_upsampling_then_joining(spark, strategy):
    rng = np.random.default_rng(4)
    knots = [("a", stamp(int(s)), None if i in (3, 9) else float(i * i % 17)) for i, s in enumerate(np.cumsum(rng.integers(5, 90, 12)))]
    slow = spark.createDataFrame(knots, "g string, ts timestamp, v double")
    rows = [("a", stamp(0) + dt.timedelta(milliseconds=int(m)), i) for i, m in enumerate(rng.integers(0, 800_000, 300))]
    left = spark.createDataFrame(rows, "g string, ts timestamp, id bigint")
    grid = upsample_linear(slow, ["g"], "ts", ["v"])
    want = asof.asof_join(left, grid.withColumnRenamed("ts", "gts"), "ts", right_on="gts", by=["g"], left_tie=["id"])
    got = asof_interpolated(left, slow, "ts", ["v"], by=["g"], left_tie=["id"], strategy=strategy)
    a, b = ({r.id: r.v for r in d.collect()} for d in (got, want))
    assert a.keys() == b.keys() and sum(v is None for v in a.values()) > 0
    for k in a:
        assert (a[k] is None and b[k] is None) or a[k] == pytest.approx(b[k], abs=1e-9)


@pytest.mark.parametrize("strategy", ["auto", "broadcast", "sorted"])
def test_null_keys_ties_and_an_empty_right_side(spark, strategy):
    left = spark.createDataFrame([(1, "a", 10), (2, None, 20), (3, "b", None), (4, "b", 30)], "id long, k string, s long")
    right = spark.createDataFrame([("a", 5, 1), (None, 5, 9), ("b", 30, 2), ("b", 30, 3), ("b", None, 8)], "k string, s long, v long")
    at = lambda df: df.withColumn("t", F.timestamp_seconds("s")).drop("s")
    got = asof.asof_join(at(left), at(right), "t", by=["k"], left_tie=["id"], strategy=strategy)
    assert {r.id: r.v for r in got.collect()} == {1: 1, 2: None, 3: None, 4: 3}
    none = asof.asof_join(at(left), at(right).where("false"), "t", by=["k"], left_tie=["id"], strategy=strategy)
    assert sorted(r.id for r in none.where("v IS NULL").collect()) == [1, 2, 3, 4]
