import numpy as np
import pytest
from pyspark.sql import functions as F

from hertzflow.functions import alerts, metrics
from hertzflow.functions.quantiles import exact_quantiles


def one(df, column):
    return df.agg(column.alias("m")).first().m


def frame(spark, **columns):
    names = list(columns)
    return spark.createDataFrame([tuple(map(float, r)) for r in zip(*columns.values())], ", ".join(f"{n} double" for n in names))


# ---- alerts ----------------------------------------------------------------------


# Published cases of the rules.
@pytest.mark.parametrize(
    "lower, monitor, expected",
    [
        (49.7, True, "INSTABILITY ALERT"),
        (49.9, False, "SYSTEM STABLE"),
        (49.8, False, "SYSTEM STABLE"),
        (49.7999, False, "HIGH MODEL UNCERTAINTY"),
        (49.7, False, "HIGH MODEL UNCERTAINTY"),
        (49.9, True, "HIGH MODEL UNCERTAINTY"),
    ],
)
def test_status(spark, lower, monitor, expected):
    df = spark.createDataFrame([(lower, 50.0, monitor)], "lower double, x double, m boolean")
    df = df.withColumn("a", alerts.dual_trigger("lower", "x", 49.8))
    assert df.select(alerts.status("a", "m").alias("s")).first().s == expected


def test_own_value_triggers_too(spark):
    df = spark.createDataFrame([(49.9, 49.7)], "lower double, x double")
    assert df.select(alerts.dual_trigger("lower", "x").alias("a")).first().a


def test_swing_uplift(spark):
    got = [r.u for r in spark.createDataFrame([(0.0,), (1000.0,), (2000.0,)], "p double").select(alerts.swing_uplift("p").alias("u")).collect()]
    assert got == [0.0, pytest.approx(50000 / 280000), pytest.approx(100000 / 280000)]


def test_required_power_lifts_the_bound_over_the_threshold(spark):
    df = spark.createDataFrame([(49.5,), (49.8,), (50.0,)], "lower double").withColumn("mw", alerts.required_mw("lower"))
    rows = df.withColumn("after", F.col("lower") + alerts.swing_uplift("mw")).collect()
    assert rows[0].after == pytest.approx(49.81) and rows[1].mw == 0 and rows[2].mw == 0


def test_trust(spark):
    cols = "a boolean, m boolean, v double, r double, p double, x double"
    rows = [
        (False, False, 0.0, 0.0, 0.0, 50.0),
        (True, False, 0.0, 0.0, 0.0, 50.0),
        (True, True, 0.05, -0.02, 0.5, 49.7),
        (True, True, 9.0, 9.0, 0.5, 40.0),
    ]
    got = spark.createDataFrame(rows, cols).select(alerts.trust_score("a", "m", "v", "r", "p", "x").alias("t")).collect()
    assert [r.t for r in got] == [100.0, 0.0, pytest.approx(100 - 10 - 3 - 20 - 15), pytest.approx(30.0)]


def test_bands(spark):
    df = spark.createDataFrame([(50.3,), (50.0,), (49.7,), (49.55,), (49.0,)], "x double")
    got = df.select(alerts.frequency_band("x"), alerts.frequency_zone("x")).collect()
    assert [r[0] for r in got] == ["amber", "green", "amber", "red", "red"]
    assert [r[1] for r in got] == ["high", "operational", "warning", "warning", "critical"]
    levels = spark.createDataFrame([(-1.0,), (0.3,), (0.5,), (2.0,)], "x double").withColumn("l", alerts.resilience_level("x"))
    assert [r[0] for r in levels.select(alerts.resilience_band("l")).collect()] == ["green", "green", "amber", "red"]


def test_scenarios_keep_every_row_and_level(spark):
    df = spark.createDataFrame([(49.7, 49.9, 50.0, 0.1), (49.9, 50.1, 50.0, 0.001)], "lo double, hi double, x double, ratio double")
    got = alerts.scenario_sweep(df, "lo", "hi", "x", "ratio").toPandas()
    assert len(got) == 2 * 51 and got.mw.max() == 5000 and got.ratio.min() == 0
    first = got[got.mw == 0].sort_values("lo")
    assert first.alert.tolist() == [True, False] and (got[got.mw == 5000].required_mw == 0).all()


# ---- metrics ---------------------------------------------------------------------


def test_pinball(spark):
    assert one(frame(spark, y=[50, 49], q=[50, 49]), metrics.pinball("y", "q", 0.1)) == 0
    over, under = frame(spark, y=[50], q=[50.1]), frame(spark, y=[50], q=[49.9])
    assert one(over, metrics.pinball("y", "q", 0.1)) > one(under, metrics.pinball("y", "q", 0.1))
    assert one(over, metrics.pinball("y", "q", 0.9)) < one(under, metrics.pinball("y", "q", 0.9))


@pytest.mark.parametrize("ys, share", [([50, 49.9, 50.1], 1.0), ([48, 51, 48.5], 0.0), ([50, 48], 0.5), ([49.5, 50.5], 1.0)])
def test_coverage(spark, ys, share):
    df = frame(spark, y=ys).withColumns({"lo": F.lit(49.5), "hi": F.lit(50.5)})
    assert one(df, metrics.interval_coverage("y", "lo", "hi")) == share


def test_width_and_calibration(spark):
    df = frame(spark, lo=[49.5, 49.6, 49.7], hi=[50.5, 50.4, 50.3])
    assert one(df, metrics.interval_width("lo", "hi")) == pytest.approx(0.8)
    ys = frame(spark, y=range(1, 11))
    assert one(ys, metrics.coverage_below("y", F.lit(1.5))) == 0.1
    assert one(ys, metrics.coverage_below("y", F.lit(1.0))) == 0.0
    assert one(ys, metrics.coverage_below("y", F.lit(100.0))) == 1.0


def test_rates_are_zero_safe(spark):
    df = spark.createDataFrame([(0, 0, 0, 5)], "tp int, fp int, fn int, tn int")
    got = df.select(*[c.alias(n) for n, c in metrics.classification_rates().items()]).first().asDict()
    assert got == {"precision": 0, "recall": 0, "f1": 0, "specificity": 1, "fpr": 0, "fnr": 0}


def test_auc_with_ties_and_single_class(spark):
    rng = np.random.default_rng(1)
    y, s = rng.integers(0, 2, 300), rng.integers(0, 12, 300) / 4
    df = spark.createDataFrame([("a", int(a), float(b)) for a, b in zip(y, s)] + [("b", 1, 0.5)], "g string, y int, s double")
    got = {r.g: r.auc for r in metrics.auc_roc(df, "y", "s", ["g"]).collect()}
    pos, neg = s[y == 1][:, None], s[y == 0][None, :]
    assert got["a"] == pytest.approx(((pos > neg) + 0.5 * (pos == neg)).mean()) and got["b"] is None
    points = metrics.roc_points(df.where("g = 'a'"), "y", "s").orderBy("threshold").collect()
    assert (points[0].fpr, points[0].tpr) == (1.0, 1.0) and len(points) == 12
    last = points[-1]
    assert last.tpr == pytest.approx((s[y == 1] >= s.max()).mean()) and last.fpr == pytest.approx((s[y == 0] >= s.max()).mean())


def test_class_weight_without_positives(spark):
    df = spark.createDataFrame([(0,), (0,)], "y int")
    assert one(df, metrics.class_weight("y")) == 1.0


def test_histogram_counts_like_numpy(spark):
    x = np.random.default_rng(2).normal(0, 1, 500)
    got = {r.bin: r.rows for r in metrics.histogram(frame(spark, x=x), "x", 20).collect()}
    want, _ = np.histogram(x, 20)
    assert [got.get(i, 0) for i in range(20)] == want.tolist()
    assert metrics.histogram(frame(spark, x=[3, 3]), "x", 5).first().rows == 2


def test_scaling_uses_training_rows_only(spark):
    df = frame(spark, x=[0, 5, 10, 20])
    got = metrics.min_max_scale(df.where("x <= 10"), df, ["x"]).orderBy("x").collect()
    assert [r.x_scaled for r in got] == [0.0, 0.5, 1.0, 2.0]


def test_small_groups_are_gated(spark):
    df = spark.createDataFrame([("a", 1.0)] * 9 + [("b", 1.0)] * 10, "g string, x double")
    got = metrics.aggregate(df, {"m": F.avg("x")}, ["g"], min_rows=10).collect()
    assert [r.g for r in got] == ["b"]


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(5)
    a = np.concatenate([rng.normal(0, 1, 301), np.full(200, 0.25)])
    rows = [("a", float(v)) for v in a] + [("b", 7.0), (None, 1.0), (None, 2.0), ("a", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {(r.g, r.alpha): r["quantile"] for r in exact_quantiles(df, ["g"], "v", [0.0, 0.1, 0.5, 0.9, 1.0]).collect()}
    for alpha in (0.0, 0.1, 0.5, 0.9, 1.0):
        assert got["a", alpha] == pytest.approx(np.quantile(a, alpha))
        assert got["b", alpha] == 7.0
    assert got[None, 0.5] == 1.5
