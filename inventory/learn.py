"""Queries for models, recalibration, attribution and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from hertzflow.functions import metrics
from hertzflow.functions.quantiles import exact_quantiles
from hertzflow.models import attribution, calibrate, classify, quantile
from hertzflow.operators.layout import POS, OrderedRows
from hertzflow.operators.windows import led
from hertzflow.plans.evaluate import evaluate, score
from hertzflow.plans.features import build_features, decide
from hertzflow.plans.job import Pipeline
from hertzflow.settings import MODEL_FEATURES
from hertzflow.storage import stage, work_path

from .base import SCORED_SQL, SIGNAL_SQL, W, laid_out, out, query, r, rounded, scored, scored_columns
from .measures import _DECISION_SQL, decision_rows
from .windows import _vol_sql, door_sql

_Y = "grid_frequency"
_CAL, _SPLIT = "2024-01-16", "2024-01-21"
# The defaults of the library.
_ROUNDS, _DEPTH = 20, 5


def _at(day):
    return F.to_timestamp(F.lit(day))


def _train(df):
    return df.where(F.col("timestamp") < _at(_SPLIT))


def _test(df):
    return df.where(F.col("timestamp") >= _at(_SPLIT))


def _held_out(df):
    return df.where((F.col("timestamp") >= _at(_CAL)) & (F.col("timestamp") < _at(_SPLIT)))


_FEATURES: dict[tuple[str, str], OrderedRows] = {}
_BOOSTS: dict[tuple[str, str], tuple] = {}


def feature_table(spark, sf) -> OrderedRows:
    """The full feature table, written once per session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _FEATURES:
        merged = laid_out(spark, sf).df.drop(POS).dropna()
        built = build_features(merged, ["series"], ["timestamp", "event_id"])
        _FEATURES[key] = built.with_df(stage(built.df, "features"))
    return _FEATURES[key]


def boosts(spark, sf) -> tuple:
    """Lower and upper model, fitted before the calibration range."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _BOOSTS:
        train = feature_table(spark, sf).df.where(F.col("timestamp") < _at(_CAL))
        _BOOSTS[key] = tuple(
            quantile.fit_quantile_boost(
                train, MODEL_FEATURES, "target_freq_next", a, rounds=_ROUNDS, depth=_DEPTH, learning_rate=0.2
            )
            for a in (0.1, 0.9)
        )
    return _BOOSTS[key]


def _kept(models: dict, spark, sf, fit):
    """A model, fitted once per session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in models:
        models[key] = fit()
    return models[key]


_CLASSIFIERS: dict = {}
_SEQUENCES: dict = {}


def classifier(spark, sf):
    train = _train(feature_table(spark, sf).df)
    return _kept(
        _CLASSIFIERS, spark, sf,
        lambda: classify.fit_instability_classifier(train, MODEL_FEATURES, "target_is_unstable", rounds=_ROUNDS, depth=_DEPTH),
    )


def sequence_monitor(spark, sf):
    in_train = F.col("timestamp") < _at(_SPLIT)
    return _kept(
        _SEQUENCES, spark, sf,
        lambda: classify.fit_sequence_monitor(feature_table(spark, sf), in_train, MODEL_FEATURES, "target_is_unstable"),
    )


def predict_bounds(models):
    lower, upper = models
    return lambda df: upper.transform(lower.transform(df, "lower"), "upper")


_FEATURE_SQL = (
    door_sql(
        "SELECT * FROM base WHERE grid_frequency IS NOT NULL AND probability IS NOT NULL AND wind_speed IS NOT NULL "
        "AND solar_radiation IS NOT NULL AND inertia_cost IS NOT NULL"
    )
    + f""", s1 AS (SELECT *, {_Y} - lag({_Y}) OVER ({W}) AS diff, lead({_Y}, 10) OVER ({W}) AS target_freq_next,
      {_vol_sql(10)} AS volatility_10s, {_vol_sql(30)} AS volatility_30s, {_vol_sql(60)} AS volatility_60s,
      coalesce(lag({_Y}, 1) OVER ({W}), 50.0) AS lag_1s, coalesce(lag({_Y}, 5) OVER ({W}), 50.0) AS lag_5s,
      coalesce(lag({_Y}, 60) OVER ({W}), 50.0) AS lag_60s FROM ramped),
    feats AS (SELECT * EXCLUDE (ramp_rate, diff), ramp_rate AS wind_ramp_rate,
      coalesce(avg(diff) OVER ({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 0.0) AS rocof,
      CASE WHEN target_freq_next > 50.2 OR target_freq_next < 49.8 THEN 1 ELSE 0 END AS target_is_unstable,
      wind_speed * 3000.0 / 35000.0 AS renewable_penetration_ratio,
      hour(timestamp) AS hour, minute(timestamp) AS minute FROM s1 QUALIFY target_freq_next IS NOT NULL)
    """
)
_FEATURE_NUMBERS = [
    _Y, "probability", "wind_speed", "solar_radiation", "wind_ramp_rate", "target_freq_next", "lag_1s", "lag_5s", "lag_60s",
    "rocof", "volatility_10s", "volatility_30s", "volatility_60s", "renewable_penetration_ratio",
]


@query(
    "feature_table",
    _FEATURE_SQL
    + "SELECT series, timestamp, event_id, inertia_cost, CAST(target_is_unstable AS TINYINT) AS target_is_unstable, "
    + "CAST(hour AS INTEGER) AS hour, CAST(minute AS INTEGER) AS minute, "
    + ", ".join(r(c, c) for c in _FEATURE_NUMBERS)
    + " FROM feats",
)
def features(spark, sf):
    return out(feature_table(spark, sf).df.drop(POS))


@query("m1_quantile_boost")
def m1(spark, sf):
    rows = predict_bounds(boosts(spark, sf))(_test(feature_table(spark, sf).df))
    return rows.select("event_id", "target_freq_next", "lower", "upper")


_LED_SQL = (
    "WITH "
    + SIGNAL_SQL
    + f""", t AS (SELECT *, lead(grid_frequency, 10) OVER ({W}) AS y, CAST(floor(grid_frequency / 0.1) AS BIGINT) AS cell FROM sig),
    tr AS (SELECT cell, quantile_cont(y, 0.1) AS lower, quantile_cont(y, 0.9) AS upper FROM t
      WHERE timestamp < TIMESTAMP '{_SPLIT}' AND y IS NOT NULL GROUP BY cell),
    al AS (SELECT quantile_cont(y, 0.1) AS lo, quantile_cont(y, 0.9) AS hi FROM t WHERE timestamp < TIMESTAMP '{_SPLIT}' AND y IS NOT NULL)
"""
)


def grouped(spark, sf):
    """Rows with their target, and the grouped quantiles of the training rows."""
    frames = laid_out(spark, sf).framed(after=10)
    rows = frames.trim(frames.rows.withColumn("y", led(frames, _Y, 10)))
    rows = rows.where(F.col("y").isNotNull()).withColumn("cell", quantile.grid_key(_Y, 0.1))
    return rows, quantile.fit_grouped_quantiles(_train(rows), ["cell"], "y", (0.1, 0.9), ("lower", "upper"))


@query(
    "m2_grouped_quantiles",
    _LED_SQL
    + f"""SELECT event_id, {r('coalesce(tr.lower, lo)', 'lower')}, {r('coalesce(tr.upper, hi)', 'upper')}
    FROM t LEFT JOIN tr ON t.cell = tr.cell, al WHERE timestamp >= TIMESTAMP '{_SPLIT}' AND y IS NOT NULL""",
)
def m2(spark, sf):
    rows, model = grouped(spark, sf)
    return out(model.transform(_test(rows)), "event_id", "lower", "upper")


@query("m3_instability_classifier")
def m3(spark, sf):
    rows = feature_table(spark, sf).df
    return classify.classify(classifier(spark, sf), _test(rows), MODEL_FEATURES).select(
        "event_id", "target_is_unstable", "probability", "predicted"
    )


@query("m4_sequence_monitor")
def m4(spark, sf):
    ordered = feature_table(spark, sf)
    rows = _test(sequence_monitor(spark, sf).transform(ordered))
    return rows.select("event_id", "probability", (F.col("probability") > 0.5).alias("monitor"))


_PAV_SQL = (
    SCORED_SQL
    + f""", g AS (SELECT lower AS x, sum(grid_frequency) AS s, count(*) AS w, row_number() OVER (ORDER BY lower) AS n FROM scored
      WHERE timestamp >= TIMESTAMP '{_CAL}' AND timestamp < TIMESTAMP '{_SPLIT}' GROUP BY lower),
    c AS (SELECT *, sum(s) OVER (ORDER BY n) AS su, sum(w) OVER (ORDER BY n) AS wu FROM g),
    pairs AS (SELECT a.n AS a, b.n AS b, (b.su - a.su + a.s) / (b.wu - a.wu + a.w) AS mean FROM c a JOIN c b ON a.n <= b.n),
    least_ AS (SELECT a, b, min(mean) OVER (PARTITION BY a ORDER BY b DESC) AS m FROM pairs),
    fit AS (SELECT c.x, max(m) AS y FROM least_ JOIN c ON c.n = b GROUP BY c.x),
    t AS (SELECT event_id, lower FROM scored WHERE timestamp >= TIMESTAMP '{_SPLIT}'),
    l AS (SELECT t.*, fit.x AS x0, fit.y AS y0 FROM t ASOF LEFT JOIN fit ON t.lower >= fit.x),
    u AS (SELECT l.*, fit.x AS x1, fit.y AS y1 FROM l ASOF LEFT JOIN fit ON l.lower <= fit.x)
"""
)


@query(
    "m5_isotonic",
    _PAV_SQL
    + f"""SELECT event_id, {r('lower', 'lower')}, {r('CASE WHEN x1 IS NULL OR x0 = lower THEN y0 WHEN x0 IS NULL THEN y1 ELSE y0 + (y1 - y0) * (lower - x0) / (x1 - x0) END', 'calibrated')} FROM u""",
)
def m5(spark, sf):
    rows = scored(spark, sf)
    model = calibrate.fit_isotonic(_held_out(rows), "lower", _Y)
    return out(calibrate.apply_isotonic(model, _test(rows), "lower", "calibrated"), "event_id", "lower", "calibrated")


@query(
    "m6_conformal_shift",
    SCORED_SQL
    + f""", c AS (SELECT quantile_cont(grid_frequency - lower, 0.1) AS a, quantile_cont(grid_frequency - upper, 0.9) AS b
      FROM scored WHERE timestamp >= TIMESTAMP '{_CAL}' AND timestamp < TIMESTAMP '{_SPLIT}')
    SELECT event_id, {r('lower + a', 'lower')}, {r('upper + b', 'upper')} FROM scored, c WHERE timestamp >= TIMESTAMP '{_SPLIT}'""",
)
def m6(spark, sf):
    rows = scored(spark, sf)
    held = _held_out(rows)
    shifts = quantile.conformal_bounds(held, _Y, ("lower", "upper"), (0.1, 0.9))
    return out(score(_test(rows), lambda d: d, shifts=shifts), "event_id", "lower", "upper")


@query(
    "m6_conformal_by_series",
    SCORED_SQL
    + f"""SELECT series, {r('quantile_cont(grid_frequency - lower, 0.1)', 'shift')} FROM scored
    WHERE timestamp >= TIMESTAMP '{_CAL}' AND timestamp < TIMESTAMP '{_SPLIT}' GROUP BY series""",
)
def m6_series(spark, sf):
    return out(quantile.conformal_shifts(_held_out(scored(spark, sf)), _Y, "lower", 0.1, ["series"]))


_INPUTS = {"grid_frequency": "grid_frequency", "rocof": "rocof", "volatility_10s": "v10", "wind_speed": "wind_speed"}
_PHI_SQL = (
    _DECISION_SQL
    + ", m AS (SELECT "
    + ", ".join(f"regr_slope(lower, {c}) AS w_{f}, avg({c}) AS m_{f}" for f, c in _INPUTS.items())
    + " FROM dec), phi AS ("
    + " UNION ALL ".join(
        f"SELECT event_id, timestamp, '{f}' AS feature, w_{f} * ({c} - m_{f}) AS phi FROM dec, m" for f, c in _INPUTS.items()
    )
    + ")"
)


def _phi(spark, sf):
    rows = decision_rows(spark, sf)
    return rows, attribution.contributions(*attribution.marginal_weights(rows, list(_INPUTS), "lower"))


@query(
    "m7_top_attributions",
    _PHI_SQL
    + f""", k AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY abs(phi) DESC, feature) AS rank FROM phi)
    SELECT event_id, CAST(rank AS INTEGER) AS rank, feature, {r('phi', 'phi')} FROM k WHERE rank <= 3""",
)
def m7(spark, sf):
    rows, phi = _phi(spark, sf)
    return out(attribution.top_contributions(rows, ["event_id"], phi, 3))


@query(
    "m7_top_negative_driver",
    _PHI_SQL
    + """SELECT event_id, coalesce(arg_max(feature, abs(phi)) FILTER (WHERE phi < 0), 'None') AS driver FROM phi GROUP BY event_id""",
)
def m7_driver(spark, sf):
    rows, phi = _phi(spark, sf)
    return rows.select("event_id", attribution.top_negative_driver(phi).alias("driver"))


@query(
    "a18_attribution_shares",
    _PHI_SQL
    + f""", g AS (SELECT feature, hour(timestamp) // 8 AS part, avg(abs(phi)) AS p FROM phi GROUP BY 1, 2),
    s AS (SELECT feature, p / sum(p) OVER (PARTITION BY part) * 100 AS share FROM g)
    SELECT feature, {r('avg(share)', 'mean_share_pct')}, {r('stddev_pop(share)', 'share_spread')} FROM s GROUP BY feature""",
)
def a18(spark, sf):
    rows, phi = _phi(spark, sf)
    return out(attribution.attribution_shares(rows, phi, "timestamp"))


@query("m7_model_attribution")
def m7_model(spark, sf):
    """Attribution of the boosted lower bound through its linear surrogate."""
    rows = boosts(spark, sf)[0].transform(_test(feature_table(spark, sf).df), "lower")
    phi = attribution.contributions(*attribution.surrogate_weights(rows, MODEL_FEATURES, "lower"))
    return attribution.top_contributions(rows, ["event_id"], phi, 8)


@query("m8_feature_importance")
def m8(spark, sf):
    lower, upper = (dict(m.importances()) for m in boosts(spark, sf))
    rows = [(f, lower[f], upper[f], (lower[f] + upper[f]) / 2) for f in MODEL_FEATURES]
    return spark.createDataFrame(rows, "feature string, lower_pct double, upper_pct double, mean_pct double")


def _calibrated(spark, sf):
    predict = predict_bounds(boosts(spark, sf))
    rows = feature_table(spark, sf).df
    held = predict(_held_out(rows))
    maps = tuple(calibrate.fit_isotonic(held, q, "target_freq_next") for q in ("lower", "upper"))
    return score(_test(rows), predict, calibrators=maps)


@query("m9_evaluate_raw")
def m9(spark, sf):
    rows = score(feature_table(spark, sf).df, predict_bounds(boosts(spark, sf)))
    period = (_at(_SPLIT), _at("2024-02-01"))
    return evaluate(rows.withColumn("day", F.to_date("timestamp")), period=period, by=["day"], min_rows=10)


@query("m9_evaluate_calibrated")
def m9_calibrated(spark, sf):
    return evaluate(_calibrated(spark, sf).withColumn("day", F.to_date("timestamp")), by=["day"], min_rows=10)


@query("scored_decisions")
def scored_decisions(spark, sf):
    """The whole decision table: model bounds, alerts, status, trust, need and cost."""
    rows = decide(score(_test(feature_table(spark, sf).df), predict_bounds(boosts(spark, sf))))
    return rows.select("event_id", "lower", "upper", "alert", "monitor", "status", "conflict", "trust", "required_mw", "intervention_cost")


@query("d10_scenario_rescored")
def d10_rescored(spark, sf):
    """Every power level with bounds predicted anew from the lowered ratio."""
    from hertzflow.functions.alerts import scenario_sweep

    rows = score(_test(feature_table(spark, sf).df), predict_bounds(boosts(spark, sf)))
    again = predict_bounds(boosts(spark, sf))
    swept = scenario_sweep(
        rows.drop("lower", "upper"), "lower", "upper", _Y, "renewable_penetration_ratio", high_mw=5000, step_mw=100, rescore=again
    )
    return swept.groupBy("series", "mw").agg(F.count_if("alert").alias("alerts"), F.avg("required_mw").alias("mean_required_mw"))


@query("m1_rows_kept", "SELECT CAST(0 AS BIGINT) AS lost_rows, CAST(0 AS BIGINT) AS wrong_nulls")
def m1_rows_kept(spark, sf):
    """Rows with a missing feature stay, and have no prediction."""
    rows = feature_table(spark, sf).df
    holed = rows.withColumn("wind_speed", F.when(F.col("event_id") % 7 > 0, F.col("wind_speed")))
    got = boosts(spark, sf)[0].transform(holed, "lower")
    counts = got.agg(
        F.count("*").alias("n"), F.count_if(F.col("lower").isNull() != F.col("wind_speed").isNull()).alias("wrong_nulls")
    )
    return rows.agg(F.count("*").alias("all")).crossJoin(counts).select((F.col("all") - F.col("n")).alias("lost_rows"), "wrong_nulls")


@query(
    "s13_pipeline_reload",
    _LED_SQL + f"SELECT count(*) AS rows, CAST(0 AS BIGINT) AS differing FROM t WHERE timestamp >= TIMESTAMP '{_SPLIT}' AND y IS NOT NULL",
)
def s13_reload(spark, sf):
    """A quantile table gives the same numbers once saved and loaded."""
    path = work_path(spark, "pipeline")
    rows, model = grouped(spark, sf)
    model.save(spark, path)
    again = quantile.GroupedQuantiles.load(spark, path)
    key = ["event_id", "lower", "upper"]
    one, two = (m.transform(_test(rows)).select(key) for m in (model, again))
    both = one.join(two.toDF("event_id", "lower2", "upper2"), "event_id")
    same = F.col("lower").eqNullSafe(F.col("lower2")) & F.col("upper").eqNullSafe(F.col("upper2"))
    return both.agg(F.count("*").alias("rows"), F.count_if(~same).alias("differing"))


@query("s13_model_persistence")
def s13(spark, sf):
    """Predictions of a model that was saved and loaded."""
    path = work_path(spark, "model")
    boosts(spark, sf)[0].save(spark, path)
    model = quantile.QuantileBoost.load(spark, path)
    return model.transform(_test(feature_table(spark, sf).df), "lower").select("event_id", "lower")


# ---- what fitted models must fulfil, in numbers that SQL can give -----------------

# A target that the features decide, up to a tenth of what follows.
_CLEAR_SQL = f"lag_1s + CASE WHEN hour >= 12 THEN 0.4 ELSE 0.0 END + 0.1 * (target_freq_next - 50.0)"
_CLEAR_LABEL_SQL = "CASE WHEN lag_1s < 49.9 OR hour < 6 THEN 1 ELSE 0 END"
_TEST_SQL = f"timestamp >= TIMESTAMP '{_SPLIT}'"


_CLEAR: dict = {}


def clear_bounds(spark, sf):
    """Rows with that target, and both bounds fitted to it."""
    rows = feature_table(spark, sf).df.withColumn("clear", F.expr(_CLEAR_SQL))
    train = rows.where(F.col("timestamp") < _at(_CAL))
    fit = lambda: [quantile.fit_quantile_boost(train, MODEL_FEATURES, "clear", a) for a in (0.1, 0.9)]
    return rows, _kept(_CLEAR, spark, sf, fit)


@query(
    "m1_beats_flat_quantiles",
    _FEATURE_SQL
    + f""", c AS (SELECT timestamp, {_CLEAR_SQL} AS y FROM feats),
    q AS (SELECT quantile_cont(y, 0.1) AS a, quantile_cont(y, 0.9) AS b FROM c WHERE timestamp < TIMESTAMP '{_CAL}')
    SELECT count(*) AS rows, {r('avg(greatest(0.1 * (y - a), -0.9 * (y - a)))', 'flat_lower')},
      {r('avg(greatest(0.9 * (y - b), -0.1 * (y - b)))', 'flat_upper')}, CAST(0 AS BIGINT) AS without,
      true AS lower_halved, true AS upper_halved, true AS covers, true AS seldom_crosses FROM c, q WHERE {_TEST_SQL}""",
)
def m1_clear(spark, sf):
    """On a target the features decide, both bounds lose at most half of what the best constants lose."""
    rows, models = clear_bounds(spark, sf)
    train = rows.where(F.col("timestamp") < _at(_CAL))
    flat = {x.alpha: x["quantile"] for x in exact_quantiles(train, [], "clear", (0.1, 0.9)).collect()}
    got = predict_bounds(models)(_test(rows)).agg(
        F.count("*").alias("rows"),
        metrics.pinball("clear", F.lit(flat[0.1]), 0.1).alias("flat_lower"),
        metrics.pinball("clear", F.lit(flat[0.9]), 0.9).alias("flat_upper"),
        metrics.pinball("clear", "lower", 0.1).alias("_lower"),
        metrics.pinball("clear", "upper", 0.9).alias("_upper"),
        metrics.interval_coverage("clear", "lower", "upper").alias("_covered"),
        metrics.crossing_rate("lower", "upper").alias("_crossing"),
        F.count_if(F.col("lower").isNull() | F.col("upper").isNull()).alias("without"),
    )
    return out(
        got.select(
            "rows", "flat_lower", "flat_upper", "without",
            (F.col("_lower") <= F.col("flat_lower") / 2).alias("lower_halved"),
            (F.col("_upper") <= F.col("flat_upper") / 2).alias("upper_halved"),
            F.col("_covered").between(0.6, 0.98).alias("covers"),
            (F.col("_crossing") <= 0.05).alias("seldom_crosses"),
        )
    )


@query(
    "m3_finds_clear_label",
    _FEATURE_SQL
    + f""", c AS (SELECT *, {_CLEAR_LABEL_SQL} AS label FROM feats)
    SELECT count(*) AS rows, CAST(sum(label) AS BIGINT) AS positives, CAST(0 AS BIGINT) AS outside, true AS separates FROM c WHERE {_TEST_SQL}""",
)
def m3_clear(spark, sf):
    """Probabilities lie within 0 and 1, and order a label that the features decide."""
    rows = feature_table(spark, sf).df.withColumn("label", F.expr(_CLEAR_LABEL_SQL))
    model = classify.fit_instability_classifier(_train(rows), MODEL_FEATURES, "label")
    got = stage(classify.classify(model, _test(rows), MODEL_FEATURES), "clear-label")
    auc = metrics.auc_roc(got, "label", "probability")
    p = F.col("probability")
    counts = got.agg(
        F.count("*").alias("rows"), F.sum("label").cast("bigint").alias("positives"), F.count_if(~p.between(0, 1) | p.isNull()).alias("outside")
    )
    return counts.join(F.broadcast(auc.select((F.col("auc") >= 0.95).alias("separates"))), F.lit(True))


@query(
    "m4_scores_complete_windows",
    _FEATURE_SQL
    + f""", n AS (SELECT *, row_number() OVER ({W}) AS rn FROM feats)
    SELECT series, count(*) AS rows, CAST(0 AS BIGINT) AS outside FROM n WHERE rn >= 30 AND {_TEST_SQL} GROUP BY series""",
)
def m4_windows(spark, sf):
    """Exactly the rows that end a complete window have a probability."""
    rows = _test(sequence_monitor(spark, sf).transform(feature_table(spark, sf)))
    p = F.col("probability")
    return rows.groupBy("series").agg(F.count("*").alias("rows"), F.count_if(~p.between(0, 1) | p.isNull()).alias("outside"))


@query(
    "m7_model_attribution_ranks",
    _FEATURE_SQL + f"SELECT count(*) AS rows, 8 * count(*) AS parts, CAST(0 AS BIGINT) AS disordered FROM feats WHERE {_TEST_SQL}",
)
def m7_ranks(spark, sf):
    """Every row has its eight largest contributions, falling in size."""
    parts = m7_model(spark, sf).groupBy("event_id").agg(F.sort_array(F.collect_list(F.struct("rank", F.abs("phi").alias("size")))).alias("list"))
    step = F.transform("list", lambda x, i: (i == 0) | (F.get("list", i - 1)["size"] >= x["size"]))
    right = F.forall(step, lambda x: x) & (F.transform("list", lambda x: x["rank"]) == F.array(*[F.lit(k) for k in range(1, 9)]))
    return parts.agg(F.count("*").alias("rows"), F.sum(F.size("list")).cast("bigint").alias("parts"), F.count_if(~right).alias("disordered"))


@query(
    "m8_importance_shares",
    "SELECT CAST(13 AS BIGINT) AS features, 100.0 AS lower_pct, 100.0 AS upper_pct, CAST(0 AS BIGINT) AS negative FROM (SELECT count(*) FROM events)",
)
def m8_shares(spark, sf):
    """Importances are shares: none below zero, and a hundred percent together."""
    rows = m8(spark, sf)
    least = F.least("lower_pct", "upper_pct")
    return out(rows.agg(F.count("*").alias("features"), F.sum("lower_pct").alias("lower_pct"), F.sum("upper_pct").alias("upper_pct"), F.count_if(least < 0).alias("negative")))


@query(
    "m8_permutation_importance",
    _FEATURE_SQL + f"""SELECT unnest(['hour', 'lag_1s', 'renewable_penetration_ratio']) AS feature, unnest([true, true, false]) AS lower_matters,
      unnest([true, true, false]) AS upper_matters, rows FROM (SELECT count(*) AS rows FROM feats WHERE {_TEST_SQL})""",
)
def m8_permutation(spark, sf):
    """Of both bounds, those features cost accuracy when shuffled among rows that decide the target."""
    rows, models = clear_bounds(spark, sf)
    rows = _test(rows).drop(POS)
    names = ["hour", "lag_1s", "renewable_penetration_ratio"]
    rises = []
    for model, alpha in zip(models, (0.1, 0.9)):
        loss = metrics.pinball("clear", "guess", alpha)
        base = model.transform(rows, "guess").agg(loss).first()[0]
        found = quantile.permutation_importance(rows, lambda d, m=model: m.transform(d, "guess"), names, loss, ["event_id"])
        rises.append([bool(rise > base / 10) for _, rise in found])
    n = rows.count()
    return spark.createDataFrame(
        [(f, a, b, n) for f, a, b in zip(names, *rises)], "feature string, lower_matters boolean, upper_matters boolean, rows bigint"
    )


_BAND_METRICS = {
    "pinball_lower": "avg(greatest(0.1 * (y - lower), -0.9 * (y - lower)))",
    "pinball_upper": "avg(greatest(0.9 * (y - upper), -0.1 * (y - upper)))",
    "mae_lower": "avg(abs(y - lower))",
    "mae_upper": "avg(abs(y - upper))",
    "rmse_lower": "sqrt(avg((y - lower) * (y - lower)))",
    "rmse_upper": "sqrt(avg((y - upper) * (y - upper)))",
    "below_lower": "avg(CASE WHEN y < lower THEN 1.0 ELSE 0.0 END)",
    "below_upper": "avg(CASE WHEN y < upper THEN 1.0 ELSE 0.0 END)",
    "picp": "avg(CASE WHEN y BETWEEN lower AND upper THEN 1.0 ELSE 0.0 END)",
    "mpiw": "avg(upper - lower)",
    "crossing": "avg(CASE WHEN lower > upper THEN 1.0 ELSE 0.0 END)",
}


@query(
    "m9_evaluate_table",
    SCORED_SQL
    + f""", e AS (SELECT *, lead(grid_frequency, 10) OVER ({W}) AS y FROM scored)
    SELECT series, CAST(timestamp AS DATE) AS day, count(*) AS rows, {', '.join(r(sql, name) for name, sql in _BAND_METRICS.items())}
    FROM e WHERE y IS NOT NULL AND timestamp >= TIMESTAMP '{_CAL}' AND timestamp < TIMESTAMP '2024-01-26' GROUP BY 1, 2 HAVING count(*) >= 10""",
)
def m9_table(spark, sf):
    """The evaluation of a written table of predictions, per series and day of a period."""
    frames = laid_out(spark, sf).framed(before=1, after=10)
    columns = {**scored_columns(frames), "target_freq_next": led(frames, _Y, 10)}
    written = stage(frames.trim(frames.rows.withColumns(columns)).where(F.col("lower").isNotNull()), "predictions")
    rows = written.withColumn("day", F.to_date("timestamp"))
    return out(evaluate(rows, period=(_at(_CAL), _at("2024-01-26")), by=["series", "day"], min_rows=10))


_TRUST_SQL = """CASE WHEN alert <> monitor THEN 0.0 ELSE greatest(0.0, least(100.0, 100.0
      - CASE WHEN v10 > 0.015 THEN least(20.0, 200 * v10) ELSE 0.0 END
      - CASE WHEN abs(rocof) > 0.01 THEN least(15.0, 150 * abs(rocof)) ELSE 0.0 END
      - CASE WHEN 1 - 2 * abs(probability - 0.5) > 0.3 THEN 20 * (1 - 2 * abs(probability - 0.5)) ELSE 0.0 END
      - CASE WHEN abs(grid_frequency - 50.0) > 0.05 THEN least(15.0, 100 * abs(grid_frequency - 50.0)) ELSE 0.0 END)) END"""
_NEED_SQL = "CASE WHEN lower < 49.8 THEN (49.8 - lower + 0.01) * (2 * 4.0 * 35000.0) / 50.0 ELSE 0.0 END"


@query(
    "decision_table",
    _DECISION_SQL
    + f"""SELECT event_id, alert, monitor, CASE WHEN alert AND monitor THEN 'INSTABILITY ALERT'
      WHEN alert OR monitor THEN 'HIGH MODEL UNCERTAINTY' ELSE 'SYSTEM STABLE' END AS status, alert <> monitor AS conflict,
      {r(_TRUST_SQL, 'trust')}, {r('(lower + upper) / 2', 'midpoint')}, {r('upper - lower', 'band_width')},
      {r(_NEED_SQL, 'required_mw', 5)}, {r(f'({_NEED_SQL}) * coalesce(inertia_cost, 12.5)', 'intervention_cost', 3)},
      {r('(1 - least(1.0, greatest(0.0, ratio))) * 100', 'resilience')} FROM dec""",
)
def decision_table(spark, sf):
    """All decision columns of a scored table in one pass, on a band that SQL has too."""
    rows = decide(decision_rows(spark, sf))
    rows = rows.withColumns({"required_mw": rounded(F.col("required_mw"), 5), "intervention_cost": rounded(F.col("intervention_cost"), 3)})
    names = ["event_id", "alert", "monitor", "status", "conflict", "trust", "midpoint", "band_width", "resilience"]
    return out(rows.select(*names, "required_mw", "intervention_cost"))


@query(
    "s13_whole_pipeline_reload",
    _FEATURE_SQL + f"SELECT count(*) AS rows, CAST(0 AS BIGINT) AS differing FROM feats WHERE {_TEST_SQL}",
)
def s13_whole(spark, sf):
    """A saved and loaded pipeline (bounds, isotonic maps, both monitors) decides every row as the fitted one."""
    rows = feature_table(spark, sf).df
    held = stage(predict_bounds(boosts(spark, sf))(_held_out(rows)), "held-out")
    maps = tuple(calibrate.fit_isotonic(held, q, "target_freq_next") for q in ("lower", "upper"))
    fitted = Pipeline(boosts(spark, sf), classifier(spark, sf), sequence_monitor(spark, sf), None, maps)
    path = work_path(spark, "whole-pipeline")
    fitted.save(spark, path)
    again = Pipeline.load(spark, path)
    names = ["lower", "upper", "probability", "alert", "status", "trust", "required_mw"]
    one, two = (p.decisions(_test(rows)).select("event_id", F.struct(*names).alias(n)) for p, n in ((fitted, "a"), (again, "b")))
    both = one.join(two, "event_id")
    return both.agg(F.count("*").alias("rows"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("differing"))
