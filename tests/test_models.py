import numpy as np
import pytest
from pyspark.sql import functions as F

from hertzflow.functions import metrics
from hertzflow.models import attribution, calibrate, classify, quantile
from hertzflow.operators.layout import order_rows
from hertzflow.plans.evaluate import evaluate, score


@pytest.fixture(scope="module")
def noisy(spark):
    """y = step(a) + noise whose spread depends on a."""
    rng = np.random.default_rng(11)
    a, b = rng.uniform(0, 1, 3000), rng.uniform(0, 1, 3000)
    y = np.where(a > 0.5, 2.0, 0.0) + rng.normal(0, 1, 3000) * (0.1 + a)
    rows = [("s", i, float(p), float(q), float(v), int(v > 1)) for i, (p, q, v) in enumerate(zip(a, b, y))]
    return spark.createDataFrame(rows, "series string, t int, a double, b double, y double, c int").cache()


@pytest.fixture(scope="module")
def bounds(noisy):
    return [quantile.fit_quantile_boost(noisy, ["a", "b"], "y", q, rounds=8, depth=3, learning_rate=0.2, stage_every=3) for q in (0.1, 0.9)]


def test_boosted_quantiles_cover(noisy, bounds):
    rows = bounds[1].transform(bounds[0].transform(noisy, "lower"), "upper")
    got = evaluate(rows, "y", ts="t").first()
    assert abs(got.below_lower - 0.1) < 0.03 and abs(got.below_upper - 0.9) < 0.03 and abs(got.picp - 0.8) < 0.05
    flat = noisy.select(metrics.pinball("y", F.lit(float(np.quantile([r.y for r in noisy.collect()], 0.1))), 0.1)).first()[0]
    assert got.pinball_lower < 0.8 * flat
    share = dict(bounds[0].importances())
    assert share["a"] > share["b"] and sum(share.values()) == pytest.approx(100)


def test_permutation_importance_finds_the_used_feature(noisy, bounds):
    got = dict(
        quantile.permutation_importance(
            noisy, lambda d: bounds[0].transform(d, "q"), ["a", "b"], metrics.pinball("y", "q", 0.1), ["t"]
        )
    )
    assert got["a"] > 0.1 and abs(got["b"]) < 0.05


def test_saved_model_predicts_the_same(spark, noisy, bounds, tmp_path):
    bounds[0].save(spark, str(tmp_path / "m"))
    loaded = quantile.QuantileBoost.load(spark, str(tmp_path / "m"))
    both = loaded.transform(bounds[0].transform(noisy, "p"), "q")
    assert both.where("p <> q").count() == 0


def test_conformal_shift_reaches_the_level(noisy):
    rows = noisy.withColumn("q", F.col("a"))
    shift = quantile.conformal_shift(rows, "y", "q", 0.1)
    share = rows.select(metrics.coverage_below("y", F.col("q") + shift)).first()[0]
    assert share == pytest.approx(0.1, abs=0.001)
    per = quantile.conformal_shifts(rows, "y", "q", 0.1, ["c"])
    assert per.count() == 2


def test_isotonic_is_monotone_and_clips(noisy):
    model = calibrate.fit_isotonic(noisy, "a", "y")
    probe = noisy.sparkSession.createDataFrame([(float(x),) for x in np.linspace(-1, 2, 61)], "a double")
    got = [r.z for r in calibrate.apply_isotonic(model, probe, "a", "z").orderBy("a").collect()]
    assert all(x <= y + 1e-12 for x, y in zip(got, got[1:]))
    assert len(set(got[:20])) == 1 and len(set(got[-20:])) == 1


def test_grouped_quantiles_fall_back_to_all_rows(noisy):
    rows = noisy.withColumn("cell", quantile.grid_key("a", 0.25))
    model = quantile.fit_grouped_quantiles(rows.where("cell < 3"), ["cell"], "y", (0.1, 0.9), ("lower", "upper"))
    got = model.transform(rows)
    assert got.count() == 3000 and got.where("cell = 3 AND lower <> %r" % model.fallback[0]).count() == 0


@pytest.mark.parametrize("kind", ["gbt", "forest"])
def test_classifier(noisy, kind):
    model = classify.fit_instability_classifier(noisy, ["a", "b"], "c", kind=kind, rounds=5, depth=3)
    got = classify.classify(model, noisy, ["a", "b"])
    assert metrics.auc_roc(got, "c", "probability").first().auc > 0.9


def test_sequence_monitor(noisy):
    ordered = order_rows(noisy.withColumn("c", F.when(F.col("a") > 0.5, 1).otherwise(0)), ["series"], ["t"], chunk_rows=500)
    # The label of the next row is not predictable here: only shapes and ranges are checked.
    monitor = classify.fit_sequence_monitor(ordered, F.col("t") < 1500, ["a", "b"], "c", rows=4, hidden=4, iterations=5)
    got = monitor.transform(ordered, "p")
    assert got.count() == 3000 - 3 and got.where("p < 0 OR p > 1").count() == 0


def test_attribution_adds_up_to_the_linear_model(noisy):
    rows = noisy.withColumn("pred", 3 * F.col("a") - 2 * F.col("b") + 1)
    weights, means = attribution.surrogate_weights(rows, ["a", "b"], "pred")
    assert weights["a"] == pytest.approx(3, abs=1e-3) and weights["b"] == pytest.approx(-2, abs=1e-3)
    phi = attribution.contributions(weights, means)
    base = 3 * means["a"] - 2 * means["b"] + 1
    worst = rows.agg(F.max(F.abs(F.col("pred") - base - phi["a"] - phi["b"]))).first()[0]
    assert worst < 1e-3
    top = attribution.top_contributions(rows, ["t"], phi, 1).where("t = 0").first()
    assert top["rank"] == 1 and top.feature in ("a", "b")


def test_score_applies_shifts(noisy):
    got = score(noisy, lambda d: d.withColumns({"lower": F.col("a"), "upper": F.col("a")}), shifts=(-1.0, 2.0))
    assert got.where("abs(upper - lower - 3.0) > 1e-12").count() == 0


def test_rows_with_missing_features_stay(spark, noisy, bounds):
    holed = noisy.withColumn("a", F.when(F.col("t") % 5 > 0, F.col("a"))).withColumn(
        "b", F.when(F.col("t") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("b"))
    )
    want = noisy.where("t % 5 = 0 OR t % 7 = 0").count()
    got = bounds[0].transform(holed, "q")
    assert got.count() == 3000 and got.where("q IS NULL").count() == want
    with pytest.warns(UserWarning, match=f"{want} rows"):
        model = classify.fit_instability_classifier(holed, ["a", "b"], "c", rounds=2, depth=2)
    got = classify.classify(model, holed, ["a", "b"])
    assert got.count() == 3000 and got.where("probability IS NULL AND predicted IS NULL").count() == want


def test_empty_calibration_is_an_error(noisy):
    rows = noisy.withColumn("q", F.col("a")).where("false")
    with pytest.raises(ValueError, match="no calibration rows"):
        quantile.conformal_shift(rows, "y", "q", 0.1)
    with pytest.raises(ValueError, match="no calibration rows"):
        quantile.conformal_bounds(rows, "y", ("q", "q"), (0.1, 0.9))


def max_min(x, y):
    """Isotonic fit by its formula: the greatest, over begins, of the least mean to any end."""
    order = np.argsort(x)
    y = y[order]
    sums = np.concatenate([[0], np.cumsum(y)])
    return np.array([max(min((sums[b] - sums[a]) / (b - a) for b in range(i + 1, len(y) + 1)) for a in range(i + 1)) for i in range(len(y))])


@pytest.mark.parametrize("chunk,points", [(4096, 100_000), (8, 100_000), (4, 0)])
def test_isotonic_equals_the_formula_for_any_chunk(spark, monkeypatch, tmp_path, chunk, points):
    monkeypatch.setattr(calibrate, "CHUNK", chunk)
    monkeypatch.setattr(calibrate, "BROADCAST_POINTS", points)
    rng = np.random.default_rng(4)
    x = rng.permutation(120).astype(float)
    y = np.round(x / 60 + rng.normal(0, 0.7, 120), 2)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "a double, y double").repartition(4)
    model = calibrate.fit_isotonic(df, "a", "y")
    model.save(spark, f"{tmp_path}/map")
    model = calibrate.IsotonicMap.load(spark, f"{tmp_path}/map")
    probe = spark.createDataFrame([(float(v),) for v in np.arange(-2, 122, 0.5)] + [(None,)], "a double")
    got = {r.a: r.z for r in calibrate.apply_isotonic(model, probe, "a", "z").collect()}
    want = max_min(x, y)
    assert got.pop(None) is None
    for at, z in got.items():
        assert z == pytest.approx(np.interp(at, np.arange(120), want), abs=1e-9)
    # A map may replace its own input, and one without rows gives null.
    assert calibrate.apply_isotonic(model, probe, "a", "a").columns == ["a"]
    empty = calibrate.fit_isotonic(df.where("false"), "a", "y")
    assert calibrate.apply_isotonic(empty, probe, "a", "z").where("z IS NOT NULL").count() == 0


def test_compiled_trees_equal_the_trees(noisy, bounds):
    model = bounds[0]
    rows = quantile.assemble(noisy, model.features).withColumn("p", F.lit(model.base))
    for tree, values, rate in zip(model.trees, model.leaf_values, model.rates):
        rows = quantile._add_tree(rows, tree, values, rate, "p")
    both = model.transform(rows.drop("_features"), "q")
    assert both.where("p <> q OR q IS NULL").count() == 0
    plan = model.transform(noisy, "q")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") <= 1 and len(plan) < 20_000


@pytest.mark.parametrize("few,buckets", [(4096, 1024), (5, 4)])
def test_quantiles_by_counting(spark, monkeypatch, few, buckets):
    from hertzflow.functions import quantiles

    monkeypatch.setattr(quantiles, "FEW", few)
    monkeypatch.setattr(quantiles, "BUCKETS", buckets)
    rng = np.random.default_rng(9)
    values = {"a": rng.normal(0, 1, 400), None: np.repeat(2.5, 300), "b": np.concatenate([np.repeat(7.0, 200), rng.normal(0, 1e9, 50)]), "c": np.array([1e308, -1e308, 0.0])}
    rows = [(g, float(v)) for g, x in values.items() for v in x] + [("d", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    alphas = (0.0, 0.1, 0.5, 0.93, 1.0)
    got = {(r.g, r.alpha): r["quantile"] for r in quantiles.exact_quantiles(df, ["g"], "v", alphas).collect()}
    assert len(got) == 20
    for (g, a), q in got.items():
        if g != "c" or a in (0.0, 0.5, 1.0):
            assert q == pytest.approx(np.quantile(values[g], a), rel=1e-12, abs=1e-12)
    every = np.concatenate(list(values.values()))
    alone = {r.alpha: r["quantile"] for r in quantiles.exact_quantiles(df, [], "v", (0.1, 0.9)).collect()}
    assert alone == pytest.approx({a: np.quantile(every, a) for a in (0.1, 0.9)})
    odd = spark.createDataFrame([(float("inf"),), (float("-inf"),), (float("nan"),), (1.0,), (2.0,)], "v double")
    q = {r.alpha: r["quantile"] for r in quantiles.exact_quantiles(odd, [], "v", (0.0, 0.25, 0.5, 1.0)).collect()}
    assert q[0.0] == float("-inf") and q[0.25] == 1.0 and q[0.5] == 2.0 and np.isnan(q[1.0])
    assert quantiles.exact_quantiles(df.where("false"), [], "v", alphas).count() == 0


@pytest.mark.parametrize("depth", [1, 3, 5])
def test_grown_trees_are_those_of_the_library(spark, depth):
    """Cuts, leaves and importances of Spark ML's regression tree, from histograms of binned rows."""
    from pyspark.ml.regression import DecisionTreeRegressor

    from hertzflow.models import grow

    rng = np.random.default_rng(depth)
    few, many = rng.integers(0, 6, 4000).astype(float), rng.normal(0, 1, 4000)
    y = np.where(few > 2, many, -many) + rng.normal(0, 0.1, 4000)
    # The fourth feature cuts like the first, the third never; half of the second lies on one value.
    half = np.where(rng.uniform(0, 1, 4000) < 0.5, 0.0, many * many)
    rows = spark.createDataFrame([tuple(map(float, r)) for r in zip(many, half, np.ones(4000), many * 3, few, y)], "a double, b double, c double, d double, e double, y double")
    names = ["a", "b", "c", "d", "e"]
    cuts = grow.find_cuts(rows, names, 4000, 1)
    binned = grow.binned(rows.repartition(5), names, ["y"], cuts)
    got = grow.grow(binned, cuts, lambda x, y: y, depth=depth, least=20)
    vectors = quantile.assemble(rows, names)
    want = DecisionTreeRegressor(featuresCol="_features", labelCol="y", leafCol="_want", predictionCol="_p", maxDepth=depth, minInstancesPerNode=20, seed=1).fit(vectors)
    assert got.depth == want.depth == depth and len(got.leaves) == (want.numNodes + 1) // 2
    assert got.featureImportances.toArray() == pytest.approx(want.featureImportances.toArray(), abs=1e-9)
    assert got.transform(want.transform(vectors)).where("_leaf <> _want").count() == 0


def test_a_round_reads_rows_without_shuffling_or_keeping_them(spark, noisy, monkeypatch):
    """Rows are binned once; a level is one pass, and what it shuffles does not grow with the rows."""
    from hertzflow.models import grow

    seen = []
    real = grow._histograms

    def watched(rows, walk, goals, sides, nodes, k, bins):
        sums = real(rows, walk, goals, sides, nodes, k, bins)
        seen.append((nodes, sums[0].sum(), rows.schema.simpleString()))
        return sums

    monkeypatch.setattr(grow, "_histograms", watched)
    quantile.fit_quantile_boost(noisy, ["a", "b"], "y", 0.1, rounds=2, depth=3)
    assert len(seen) <= 6 and {nodes for nodes, _, _ in seen} <= {1, 2, 4}
    assert {schema for _, _, schema in seen} == {"struct<_x:binary,_y:binary,_at:binary>"}
    # The first level sees each row once for each feature.
    assert seen[0][1] == 2 * 3000


def test_missing_rows_to_fit_on_are_named(noisy):
    with pytest.raises(ValueError, match="no rows"):
        quantile.fit_quantile_boost(noisy.where("false"), ["a"], "y", 0.1, rounds=1)


def test_windows_kept_by_a_task_are_bounded(spark, noisy, monkeypatch):
    """What a task keeps of the flattened windows does not grow with the series."""
    ordered = order_rows(noisy, ["series"], ["t"], chunk_rows=50)
    kept = []
    real = classify.MultilayerPerceptronClassifier.fit
    monkeypatch.setattr(classify, "WINDOW_BYTES", 8 * 4 * 2 * 100)

    def fit(self, data, *args):
        kept.append(data.groupBy(F.spark_partition_id()).count().toPandas()["count"].tolist())
        return real(self, data, *args)

    monkeypatch.setattr(classify.MultilayerPerceptronClassifier, "fit", fit)
    monitor = classify.fit_sequence_monitor(ordered, F.col("t") < 2000, ["a", "b"], "c", rows=4, hidden=4, iterations=2)
    assert sum(kept[0]) == 2000 - 4 and max(kept[0]) <= 500 and len(kept[0]) > 8
    assert monitor.transform(ordered).count() == 3000 - 3
