"""Chunked windows and scans against plain windows over whole series."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from hertzflow.operators.layout import POS, order_rows, series_row_number

def plain():
    return Window.partitionBy("series").orderBy("ts", "id")


def laid(series_frame, chunk):
    return order_rows(series_frame, ["series"], ["ts", "id"], chunk_rows=chunk, partitions=6)


def same(a, b, keys=("series", "id")):
    a, b = a.orderBy(*keys).toPandas(), b.orderBy(*keys).toPandas()
    b = b[a.columns]
    assert len(a) == len(b)
    for c in a.columns:
        x, y = a[c], b[c]
        if x.dtype.kind == "f":
            assert ((x - y).abs().fillna(0) < 1e-9).all() and (x.isna() == y.isna()).all(), c
        else:
            assert ((x == y) | (x.isna() & y.isna())).all(), c


def test_positions_are_gap_free_and_ordered(series_frame):
    rows = laid(series_frame, 50)
    got = [r[POS] for r in rows.df.orderBy("series", "ts", "id").select(POS).collect()]
    assert got == list(range(rows.total)) and rows.total == series_frame.count()


@pytest.mark.parametrize("chunk", [1, 7, 64, 10_000])
def test_framed_equals_plain_window(series_frame, chunk):
    frames = laid(series_frame, chunk).framed(before=12, after=9)

    def columns(w):
        return {
            "lag": F.lag("x", 12).over(w),
            "lead": F.lead("x", 9).over(w),
            "mean": F.avg("x").over(w.rowsBetween(-11, 0)),
            "ahead": F.min("x").over(w.rowsBetween(0, 9)),
        }

    got = frames.trim(frames.rows.withColumns(columns(frames.window))).drop(POS)
    same(series_frame.withColumns(columns(plain())), got)


@pytest.mark.parametrize("chunk", [1, 7, 10_000])
@pytest.mark.parametrize("exclusive", [False, True])
@pytest.mark.parametrize("backward", [False, True])
def test_running_equals_plain_window(series_frame, chunk, exclusive, backward, monkeypatch):
    # Few enough totals per level that three levels are in use.
    monkeypatch.setattr("hertzflow.operators.layout.FAN_IN", 4)
    monkeypatch.setattr("hertzflow.operators.layout.TOP_LEVEL", 10)
    specs = {"l": ("last", F.col("v")), "s": ("sum", F.col("x")), "a": ("min", F.col("v")), "b": ("max", F.col("v"))}
    got = laid(series_frame, chunk).running(specs, backward=backward, exclusive=exclusive).drop(POS)
    order = [F.col("ts").desc(), F.col("id").desc()] if backward else ["ts", "id"]
    w = Window.partitionBy("series").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    want = series_frame.withColumns(
        {
            "l": F.last("v", ignorenulls=True).over(w),
            "s": F.sum("x").over(w),
            "a": F.min("v").over(w),
            "b": F.max("v").over(w),
        }
    )
    same(want, got)


def test_running_takes_initial_values(series_frame):
    rows = laid(series_frame, 7)
    start = rows.df.select("series").distinct().withColumn("l", F.lit(-1.0))
    got = rows.running({"l": ("last", F.col("v"))}, initial=start).drop(POS)
    w = plain().rowsBetween(Window.unboundedPreceding, 0)
    same(series_frame.withColumn("l", F.coalesce(F.last("v", ignorenulls=True).over(w), F.lit(-1.0))), got)


def test_carry_finds_the_last_point(series_frame):
    rows = laid(series_frame, 7)
    points = rows.df.where("id % 10 = 3").select("series", POS, F.col("x").alias("p"))
    w = plain().rowsBetween(Window.unboundedPreceding, 0)
    want = series_frame.withColumn("p", F.last(F.when(F.col("id") % 10 == 3, F.col("x")), ignorenulls=True).over(w))
    same(want, rows.carry(points, ["p"]).drop(POS))


def test_row_numbers_restart_per_series(series_frame):
    got = series_row_number(laid(series_frame, 7)).df.drop(POS)
    same(series_frame.withColumn("row_number", F.row_number().over(plain()).cast("bigint")), got)


def test_null_series_is_a_series(spark):
    df = spark.createDataFrame([(None, 1, 1.0), (None, 2, None), ("a", 1, None)], "series string, t int, v double")
    rows = order_rows(df, ["series"], ["t"], chunk_rows=1)
    got = {(r.series, r.t): r.l for r in rows.running({"l": ("last", F.col("v"))}).collect()}
    assert got == {(None, 1): 1.0, (None, 2): 1.0, ("a", 1): None}
