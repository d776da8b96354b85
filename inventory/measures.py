"""Queries for aggregates, metrics and decision rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from hertzflow.functions import alerts, metrics
from hertzflow.operators import windows
from hertzflow.operators.select import renewable_ratio
from hertzflow.plans.features import row_features

from .base import (
    BASE_SQL,
    SCORED_SQL,
    THRESHOLD,
    W,
    laid_out,
    out,
    query,
    r,
    rounded,
    scored,
    scored_columns,
)
from .windows import _vol_sql

_Y = "grid_frequency"
_ALPHAS = (0.1, 0.9)


def _by_series(spark, sf, cols, by=("series",), min_rows=0):
    return out(metrics.aggregate(scored(spark, sf), cols, list(by), min_rows))


def _pin(q, a):
    return f"avg(greatest({a} * (grid_frequency - {q}), ({a} - 1) * (grid_frequency - {q})))"


@query(
    "a1_pinball_loss",
    SCORED_SQL
    + f"SELECT series, {r(_pin('lower', 0.1), 'pinball_lower')}, {r(_pin('upper', 0.9), 'pinball_upper')} FROM scored GROUP BY series",
)
def a1(spark, sf):
    return _by_series(
        spark, sf, {"pinball_lower": metrics.pinball(_Y, "lower", 0.1), "pinball_upper": metrics.pinball(_Y, "upper", 0.9)}
    )


_PICP = "avg(CASE WHEN grid_frequency BETWEEN lower AND upper THEN 1.0 ELSE 0.0 END)"


@query("a2_interval_coverage", SCORED_SQL + f"SELECT series, {r(_PICP, 'picp')} FROM scored GROUP BY series")
def a2(spark, sf):
    return _by_series(spark, sf, {"picp": metrics.interval_coverage(_Y, "lower", "upper")})


@query("a3_interval_width", SCORED_SQL + f"SELECT series, {r('avg(upper - lower)', 'mpiw')} FROM scored GROUP BY series")
def a3(spark, sf):
    return _by_series(spark, sf, {"mpiw": metrics.interval_width("lower", "upper")})


def _below(q):
    return f"avg(CASE WHEN grid_frequency < {q} THEN 1.0 ELSE 0.0 END)"


@query(
    "a4_calibration_score",
    SCORED_SQL
    + f"SELECT series, {r(_below('lower'), 'below_lower')}, {r(_below('upper'), 'below_upper')} FROM scored GROUP BY series",
)
def a4(spark, sf):
    return _by_series(
        spark, sf, {"below_lower": metrics.coverage_below(_Y, "lower"), "below_upper": metrics.coverage_below(_Y, "upper")}
    )


@query(
    "a5_mae_rmse",
    SCORED_SQL
    + f"""SELECT series, {r('avg(abs(grid_frequency - lower))', 'mae')},
    {r('sqrt(avg((grid_frequency - lower) * (grid_frequency - lower)))', 'rmse')} FROM scored GROUP BY series""",
)
def a5(spark, sf):
    return _by_series(spark, sf, {"mae": metrics.mae(_Y, "lower"), "rmse": metrics.rmse(_Y, "lower")})


_CONFUSION_SQL = (
    SCORED_SQL
    + """, cm AS (SELECT series,
    count(*) FILTER (WHERE grid_frequency < 49.8 AND lower < 49.8) AS tp,
    count(*) FILTER (WHERE grid_frequency >= 49.8 AND lower < 49.8) AS fp,
    count(*) FILTER (WHERE grid_frequency < 49.8 AND lower >= 49.8) AS fn,
    count(*) FILTER (WHERE grid_frequency >= 49.8 AND lower >= 49.8) AS tn
    FROM scored GROUP BY series)
"""
)


def _confusion(spark, sf):
    cells = metrics.confusion(F.col(_Y) < THRESHOLD, F.col("lower") < THRESHOLD)
    return metrics.aggregate(scored(spark, sf), cells, ["series"])


@query("a6_confusion_matrix", _CONFUSION_SQL + "SELECT * FROM cm")
def a6(spark, sf):
    return _confusion(spark, sf)


def _q(a, b):
    return f"coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0.0)"


@query(
    "a7_classification_rates",
    _CONFUSION_SQL
    + f"""SELECT series, {r(_q('tp', 'tp + fp'), 'precision')}, {r(_q('tp', 'tp + fn'), 'recall')},
    {r(_q('2 * tp', '2 * tp + fp + fn'), 'f1')}, {r(_q('tn', 'tn + fp'), 'specificity')},
    {r(_q('fp', 'fp + tn'), 'fpr')}, {r(_q('fn', 'fn + tp'), 'fnr')} FROM cm""",
)
def a7(spark, sf):
    rates = metrics.classification_rates()
    return out(_confusion(spark, sf).select("series", *[c.alias(n) for n, c in rates.items()]))


def _labelled(spark, sf):
    return scored(spark, sf).select(
        "series", (F.col(_Y) < THRESHOLD).cast("int").alias("label"), (-F.col("lower")).alias("score")
    )


@query(
    "a8_auc_roc",
    SCORED_SQL
    + f""", l AS (SELECT series, CASE WHEN grid_frequency < 49.8 THEN 1 ELSE 0 END AS y, -lower AS s FROM scored),
    k AS (SELECT *, rank() OVER (PARTITION BY series ORDER BY s) + (count(*) OVER (PARTITION BY series, s) - 1) / 2.0 AS rk FROM l),
    t AS (SELECT series, CAST(sum(y) AS DOUBLE) AS p, CAST(sum(1 - y) AS DOUBLE) AS n,
      sum(CASE WHEN y = 1 THEN rk ELSE 0 END) AS rs FROM k GROUP BY series)
    SELECT series, {r('(rs - p * (p + 1) / 2) / nullif(p * n, 0)', 'auc')} FROM t""",
)
def a8(spark, sf):
    return out(metrics.auc_roc(_labelled(spark, sf), "label", "score", ["series"]))


@query(
    "a9_roc_points",
    SCORED_SQL
    + f""", l AS (SELECT series, CASE WHEN grid_frequency < 49.8 THEN 1 ELSE 0 END AS y, -lower AS s FROM scored),
    g AS (SELECT series, s, sum(y) AS p, sum(1 - y) AS n FROM l GROUP BY 1, 2),
    c AS (SELECT series, s, sum(p) OVER (PARTITION BY series ORDER BY s DESC) AS tp, sum(n) OVER (PARTITION BY series ORDER BY s DESC) AS fp,
      sum(p) OVER (PARTITION BY series) AS ap, sum(n) OVER (PARTITION BY series) AS an FROM g)
    SELECT series, {r('s', 'threshold')}, {r('CAST(fp AS DOUBLE) / an', 'fpr')}, {r('CAST(tp AS DOUBLE) / ap', 'tpr')} FROM c""",
)
def a9(spark, sf):
    return out(metrics.roc_points(_labelled(spark, sf), "label", "score", ["series"]))


@query(
    "a10_class_weight",
    BASE_SQL
    + f"""SELECT series, {r('''CAST(count(*) FILTER (WHERE grid_frequency >= 49.8) AS DOUBLE)
      / nullif(count(*) FILTER (WHERE grid_frequency < 49.8), 0)''', 'weight')} FROM base GROUP BY series""",
)
def a10(spark, sf):
    rows = laid_out(spark, sf).df.withColumn("label", (F.col(_Y) < THRESHOLD).cast("int"))
    return out(rows.groupBy("series").agg(metrics.class_weight("label").alias("weight")))


@query(
    "a11_day_kpis",
    BASE_SQL
    + f"""SELECT series, CAST(timestamp AS DATE) AS day, {r('min(grid_frequency)', 'min_value')}, {r('max(grid_frequency)', 'max_value')},
    {r('avg(grid_frequency)', 'mean_value')}, count(*) FILTER (WHERE grid_frequency < 49.8) AS breach_rows FROM base GROUP BY 1, 2""",
)
def a11(spark, sf):
    rows = laid_out(spark, sf).df.withColumn("day", F.to_date("timestamp"))
    return out(metrics.aggregate(rows, metrics.day_summary(_Y, THRESHOLD), ["series", "day"]))


@query(
    "a12_sample_size_gate",
    SCORED_SQL
    + f"""SELECT series, CAST(timestamp AS DATE) AS day, {r(_pin('lower', 0.1), 'pinball_lower')} FROM scored
    GROUP BY 1, 2 HAVING count(*) >= 10""",
)
def a12(spark, sf):
    rows = scored(spark, sf).withColumn("day", F.to_date("timestamp"))
    cols = {"pinball_lower": metrics.pinball(_Y, "lower", 0.1)}
    return out(metrics.aggregate(rows, cols, ["series", "day"], min_rows=10))


@query(
    "a13_residual_histogram",
    SCORED_SQL
    + f""", e AS (SELECT series, grid_frequency - lower AS e FROM scored),
    m AS (SELECT series, min(e) AS lo, max(e) AS hi FROM e GROUP BY series),
    b AS (SELECT series, lo, hi, CAST(least(99, coalesce(floor((e - lo) / nullif((hi - lo) / 100, 0.0)), 0)) AS INTEGER) AS bin
      FROM e JOIN m USING (series))
    SELECT series, bin, {r('lo + bin * (hi - lo) / 100', 'bin_start')}, count(*) AS rows FROM b GROUP BY series, bin, lo, hi""",
)
def a13(spark, sf):
    rows = scored(spark, sf).select("series", (F.col(_Y) - F.col("lower")).alias("residual"))
    return out(metrics.histogram(rows, "residual", 100, ["series"]))


_LEVELS = (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95)


@query(
    "a14_reliability_table",
    SCORED_SQL
    + " UNION ALL ".join(
        f"SELECT series, CAST({a} AS DOUBLE) AS alpha, {r(_below(f'(lower + 0.1 + ({a} - 0.5) * 0.8)'), 'observed')} FROM scored GROUP BY series"
        for a in _LEVELS
    ),
)
def a14(spark, sf):
    rows = scored(spark, sf).withColumns(
        {f"q{i}": F.col("lower") + 0.1 + (F.lit(a) - 0.5) * 0.8 for i, a in enumerate(_LEVELS)}
    )
    return out(metrics.reliability(rows, _Y, {a: f"q{i}" for i, a in enumerate(_LEVELS)}, ["series"]))


_CROSSED = "50.1 - (upper - 50.1)"


@query(
    "a15_crossing_rate",
    SCORED_SQL
    + f"SELECT series, {r(f'avg(CASE WHEN lower > {_CROSSED} THEN 1.0 ELSE 0.0 END)', 'crossing')} FROM scored GROUP BY series",
)
def a15(spark, sf):
    """Lower bound against an upper bound mirrored at 50.1, which does cross."""
    mirrored = 50.1 - (F.col("upper") - 50.1)
    return _by_series(spark, sf, {"crossing": metrics.crossing_rate("lower", mirrored)})


@query(
    "a16_period_comparison",
    SCORED_SQL
    + f""", p AS (SELECT timestamp < TIMESTAMP '2024-01-16' AS early, {_PICP} AS picp, avg(upper - lower) AS mpiw,
      {_pin('lower', 0.1)} AS pinball_lower FROM scored GROUP BY 1),
    m AS (SELECT early, unnest(['picp', 'mpiw', 'pinball_lower']) AS metric,
      unnest([CAST(picp AS DOUBLE), mpiw, pinball_lower]) AS v FROM p)
    SELECT a.metric, {r('a.v', 'first')}, {r('b.v', 'second')}, {r('(b.v - a.v) / nullif(a.v, 0) * 100', 'change_pct', 6)}
    FROM m a JOIN m b ON a.metric = b.metric AND a.early AND NOT b.early""",
)
def a16(spark, sf):
    rows = scored(spark, sf).withColumn(
        "period", F.when(F.col("timestamp") < F.to_timestamp(F.lit("2024-01-16")), "early").otherwise("late")
    )
    cols = {
        "picp": metrics.interval_coverage(_Y, "lower", "upper"),
        "mpiw": metrics.interval_width("lower", "upper"),
        "pinball_lower": metrics.pinball(_Y, "lower", 0.1),
    }
    table = metrics.period_comparison(rows, "period", "early", "late", cols)
    return out(table.withColumn("change_pct", rounded(F.col("change_pct"), 6)))


@query(
    "a17_normalise_by_max",
    BASE_SQL
    + f"""SELECT event_id, {r('abs(grid_frequency) / max(abs(grid_frequency)) OVER (PARTITION BY series)', 'grid_frequency_norm')},
    {r('coalesce(abs(wind_speed) / max(abs(wind_speed)) OVER (PARTITION BY series), 0.0)', 'wind_speed_norm')} FROM base""",
)
def a17(spark, sf):
    rows = metrics.normalise_by_max(laid_out(spark, sf).df, [_Y, "wind_speed"], ["series"])
    return out(rows, "event_id", "grid_frequency_norm", "wind_speed_norm")


_TRAIN = "timestamp < TIMESTAMP '2024-01-21'"


@query(
    "a19_min_max_scaling",
    BASE_SQL
    + f""", m AS (SELECT min(grid_frequency) AS a, max(grid_frequency) AS b, min(wind_speed) AS c, max(wind_speed) AS d FROM base WHERE {_TRAIN})
    SELECT event_id, {r('(grid_frequency - a) / (b - a)', 'grid_frequency_scaled')}, {r('(wind_speed - c) / (d - c)', 'wind_speed_scaled')}
    FROM base, m""",
)
def a19(spark, sf):
    rows = laid_out(spark, sf).df
    train = rows.where(F.col("timestamp") < F.to_timestamp(F.lit("2024-01-21")))
    scaled = metrics.min_max_scale(train, rows, [_Y, "wind_speed"])
    return out(scaled, "event_id", "grid_frequency_scaled", "wind_speed_scaled")


@query(
    "a20_alert_precision",
    SCORED_SQL
    + """SELECT series, CAST(timestamp AS DATE) AS day, count(*) FILTER (WHERE lower < 49.8) AS alerts,
    count(*) FILTER (WHERE lower < 49.8 AND grid_frequency < 49.8) AS correct_alerts FROM scored GROUP BY 1, 2""",
)
def a20(spark, sf):
    rows = scored(spark, sf).withColumn("day", F.to_date("timestamp"))
    cols = metrics.alert_precision(F.col("lower") < THRESHOLD, F.col(_Y) < THRESHOLD)
    return metrics.aggregate(rows, cols, ["series", "day"])


@query(
    "a_interval_evaluation",
    SCORED_SQL
    + f"""SELECT CAST(timestamp AS DATE) AS day, count(*) AS rows, {r(_pin('lower', 0.1), 'pinball_lower')}, {r(_pin('upper', 0.9), 'pinball_upper')},
    {r('avg(abs(grid_frequency - lower))', 'mae_lower')}, {r('avg(abs(grid_frequency - upper))', 'mae_upper')},
    {r('sqrt(avg((grid_frequency - lower) * (grid_frequency - lower)))', 'rmse_lower')},
    {r('sqrt(avg((grid_frequency - upper) * (grid_frequency - upper)))', 'rmse_upper')},
    {r(_below('lower'), 'below_lower')}, {r(_below('upper'), 'below_upper')}, {r(_PICP, 'picp')}, {r('avg(upper - lower)', 'mpiw')},
    {r('avg(CASE WHEN lower > upper THEN 1.0 ELSE 0.0 END)', 'crossing')} FROM scored GROUP BY 1""",
)
def a_all(spark, sf):
    rows = scored(spark, sf).withColumn("day", F.to_date("timestamp"))
    return out(metrics.aggregate(rows, metrics.interval_metrics(_Y, "lower", "upper", _ALPHAS), ["day"]))


# ---- decision rules --------------------------------------------------------------

_DECISION_SQL = (
    SCORED_SQL
    + f""", f1 AS (SELECT *, grid_frequency - lag(grid_frequency) OVER ({W}) AS diff, {_vol_sql(10)} AS v10,
      lag(grid_frequency) OVER ({W}) AS prev, wind_speed * 3000.0 / 35000.0 AS ratio FROM base),
    f2 AS (SELECT *, coalesce(avg(diff) OVER ({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 0.0) AS rocof,
      prev - 0.1 AS lower, prev + 0.1 AS upper FROM f1),
    dec AS (SELECT *, (lower < 49.8 OR grid_frequency < 49.8) AS alert, probability > 0.5 AS monitor
      FROM f2 WHERE prev IS NOT NULL)
"""
)


def decision_rows(spark, sf):
    """Band, features and both monitors per row, behind one shuffle."""
    frames = laid_out(spark, sf).framed(before=10)
    w = windows
    rows = frames.rows.withColumns(
        {
            "_diff": w.first_difference(frames, _Y),
            "volatility_10s": w.rolling_volatility(frames, _Y, 10),
            **scored_columns(frames),
        }
    ).withColumn("rocof", w.smoothed_rate(frames, "_diff"))
    rows = frames.trim(rows).where(F.col("lower").isNotNull())
    return rows.withColumn("renewable_penetration_ratio", renewable_ratio()).withColumns(
        {"alert": alerts.dual_trigger("lower", _Y, THRESHOLD), "monitor": alerts.monitor_alert("probability")}
    )


@query("d1_dual_trigger", _DECISION_SQL + "SELECT event_id, alert FROM dec")
def d1(spark, sf):
    return decision_rows(spark, sf).select("event_id", "alert")


@query(
    "d2_status_matrix",
    _DECISION_SQL
    + """SELECT event_id, CASE WHEN alert AND monitor THEN 'INSTABILITY ALERT'
    WHEN alert OR monitor THEN 'HIGH MODEL UNCERTAINTY' ELSE 'SYSTEM STABLE' END AS status FROM dec""",
)
def d2(spark, sf):
    return decision_rows(spark, sf).select("event_id", alerts.status("alert", "monitor").alias("status"))


@query("d3_model_conflict", _DECISION_SQL + "SELECT event_id, alert <> monitor AS conflict FROM dec")
def d3(spark, sf):
    return decision_rows(spark, sf).select("event_id", alerts.conflict("alert", "monitor").alias("conflict"))


@query(
    "d4_trust_score",
    _DECISION_SQL
    + f"""SELECT event_id, {r('''CASE WHEN alert <> monitor THEN 0.0 ELSE greatest(0.0, least(100.0, 100.0
      - CASE WHEN v10 > 0.015 THEN least(20.0, 200 * v10) ELSE 0.0 END
      - CASE WHEN abs(rocof) > 0.01 THEN least(15.0, 150 * abs(rocof)) ELSE 0.0 END
      - CASE WHEN 1 - 2 * abs(probability - 0.5) > 0.3 THEN 20 * (1 - 2 * abs(probability - 0.5)) ELSE 0.0 END
      - CASE WHEN abs(grid_frequency - 50.0) > 0.05 THEN least(15.0, 100 * abs(grid_frequency - 50.0)) ELSE 0.0 END)) END''', 'trust')}
    FROM dec""",
)
def d4(spark, sf):
    trust = alerts.trust_score("alert", "monitor", "volatility_10s", "rocof", "probability", _Y)
    return out(decision_rows(spark, sf).select("event_id", trust.alias("trust")))


@query(
    "d5_severity_bands",
    _DECISION_SQL
    + """SELECT event_id,
    CASE WHEN grid_frequency BETWEEN 49.8 AND 50.2 THEN 'green' WHEN grid_frequency >= 49.6 THEN 'amber' ELSE 'red' END AS frequency_band,
    CASE WHEN grid_frequency > 50.2 THEN 'high' WHEN grid_frequency >= 49.8 THEN 'operational'
      WHEN grid_frequency >= 49.5 THEN 'warning' ELSE 'critical' END AS frequency_zone,
    CASE WHEN abs(round(rocof, 9)) > 0.02 THEN 'red' WHEN abs(round(rocof, 9)) > 0.005 THEN 'amber' ELSE 'green' END AS rocof_band,
    CASE WHEN round(lower, 9) < 49.8 THEN 'red' WHEN round(lower, 9) < 49.85 THEN 'amber' ELSE 'green' END AS bound_band FROM dec""",
)
def d5(spark, sf):
    # Both sides round before the comparison: sums of decimals sit on the cut points.
    return decision_rows(spark, sf).select(
        "event_id",
        alerts.frequency_band(_Y).alias("frequency_band"),
        alerts.frequency_zone(_Y).alias("frequency_zone"),
        alerts.rocof_band(F.round("rocof", 9)).alias("rocof_band"),
        alerts.bound_band(F.round("lower", 9)).alias("bound_band"),
    )


@query(
    "d6_resilience_level",
    _DECISION_SQL
    + f""", lv AS (SELECT event_id, (1 - least(1.0, greatest(0.0, ratio))) * 100 AS level FROM dec)
    SELECT event_id, {r('level', 'level')}, CASE WHEN level > 60 THEN 'green' WHEN level > 30 THEN 'amber' ELSE 'red' END AS band FROM lv""",
)
def d6(spark, sf):
    rows = decision_rows(spark, sf).withColumn("level", alerts.resilience_level("renewable_penetration_ratio"))
    return out(rows.withColumn("band", alerts.resilience_band("level")), "event_id", "level", "band")


@query(
    "d7_swing_uplift",
    f"SELECT event_id, {r('value * 50.0 / (2 * 4.0 * 35000.0)', 'uplift')} FROM events",
)
def d7(spark, sf):
    from .base import events

    return out(events(spark, sf).select("event_id", alerts.swing_uplift("value").alias("uplift")))


_NEED = "CASE WHEN lower < 49.8 THEN (49.8 - lower + 0.01) * (2 * 4.0 * 35000.0) / 50.0 ELSE 0.0 END"


@query("d8_required_mw", _DECISION_SQL + f"SELECT event_id, {r(_NEED, 'required_mw', 6)} FROM dec")
def d8(spark, sf):
    need = rounded(alerts.required_mw("lower"), 6)
    return out(decision_rows(spark, sf).select("event_id", need.alias("required_mw")))


@query(
    "d9_intervention_cost",
    _DECISION_SQL + f"SELECT event_id, {r(f'({_NEED}) * coalesce(inertia_cost, 12.5)', 'cost', 4)} FROM dec",
)
def d9(spark, sf):
    cost = alerts.intervention_cost(alerts.required_mw("lower"), "inertia_cost")
    return out(decision_rows(spark, sf).select("event_id", rounded(cost, 4).alias("cost")))


@query(
    "d10_scenario_sweep",
    _DECISION_SQL
    + f""", sw AS (SELECT series, mw, greatest(0.0, ratio - mw / 35000.0) AS ratio, lower + mw * 50.0 / 280000.0 AS lower,
      upper + mw * 50.0 / 280000.0 AS upper, grid_frequency FROM dec, generate_series(0, 5000, 100) g(mw)),
    rq AS (SELECT *, CASE WHEN round(lower, 9) < 49.8 THEN (49.8 - round(lower, 9) + 0.01) * 280000.0 / 50.0 ELSE 0.0 END AS need FROM sw)
    SELECT series, CAST(mw AS INTEGER) AS mw, count(*) FILTER (WHERE round(lower, 9) < 49.8 OR grid_frequency < 49.8) AS alerts,
      {r('avg(need)', 'mean_required_mw', 5)}, {r('avg(ratio)', 'mean_ratio')} FROM rq GROUP BY 1, 2""",
)
def d10(spark, sf):
    rows = alerts.scenario_sweep(
        decision_rows(spark, sf).drop("alert"), "lower", "upper", _Y, "renewable_penetration_ratio", THRESHOLD
    ).withColumn("lower", F.round("lower", 9))
    swept = rows.groupBy("series", "mw").agg(
        F.count_if(alerts.dual_trigger("lower", _Y, THRESHOLD)).alias("alerts"),
        rounded(F.avg(alerts.required_mw("lower", THRESHOLD)), 5).alias("mean_required_mw"),
        F.avg("renewable_penetration_ratio").alias("mean_ratio"),
    )
    return out(swept)


@query(
    "d11_band_shape",
    SCORED_SQL + f"SELECT event_id, {r('(lower + upper) / 2', 'midpoint')}, {r('upper - lower', 'band_width')} FROM scored",
)
def d11(spark, sf):
    rows = scored(spark, sf)
    width = (F.col("upper") - F.col("lower")).alias("band_width")
    return out(rows.select("event_id", alerts.midpoint("lower", "upper").alias("midpoint"), width))


@query(
    "d12_safety_surface",
    _DECISION_SQL
    + f""", c AS (SELECT CAST(greatest(0, least(49, round(ratio / 1.0 * 49))) AS INTEGER) AS ratio_cell,
      CAST(greatest(0, least(49, round(v10 / 0.05 * 49))) AS INTEGER) AS volatility_cell FROM dec)
    SELECT ratio_cell, volatility_cell, count(*) AS rows,
      {r('50.0 - 0.8 * (ratio_cell / 49.0) - 20.0 * (volatility_cell * 0.05 / 49)', 'nadir')} FROM c GROUP BY 1, 2""",
)
def d12(spark, sf):
    return out(alerts.safety_surface(decision_rows(spark, sf), "renewable_penetration_ratio", "volatility_10s"))


@query(
    "flagship",
    _DECISION_SQL
    + f""", fl AS (SELECT *, {_vol_sql(30)} AS v30, {_vol_sql(60)} AS v60, coalesce(lag(grid_frequency, 1) OVER ({W}), 50.0) AS lag_1s,
      coalesce(lag(grid_frequency, 5) OVER ({W}), 50.0) AS lag_5s, coalesce(lag(grid_frequency, 60) OVER ({W}), 50.0) AS lag_60s,
      lead(grid_frequency, 10) OVER ({W}) AS y FROM f2)
    SELECT event_id, series, timestamp, {r('grid_frequency', 'grid_frequency')}, {r('wind_speed', 'wind_speed')}, inertia_cost,
      {r('rocof', 'rocof')}, {r('v10', 'volatility_10s')}, {r('v30', 'volatility_30s')}, {r('v60', 'volatility_60s')},
      {r('lag_1s', 'lag_1s')}, {r('lag_5s', 'lag_5s')}, {r('lag_60s', 'lag_60s')}, {r('y', 'target_freq_next')},
      CAST(CASE WHEN y > 50.2 OR y < 49.8 THEN 1 ELSE 0 END AS TINYINT) AS target_is_unstable,
      (lag_1s - 0.1 < 49.8 OR grid_frequency < 49.8) AS alert
    FROM fl WHERE y IS NOT NULL""",
)
def flagship(spark, sf):
    """As-of merge, all row-frame features, targets and the alert."""
    rows = row_features(laid_out(spark, sf)).where(F.col("target_freq_next").isNotNull())
    rows = rows.withColumn("alert", alerts.dual_trigger(F.col("lag_1s") - 0.1, _Y, THRESHOLD))
    return out(
        rows,
        *["event_id", "series", "timestamp", _Y, "wind_speed", "inertia_cost", "rocof", "volatility_10s"],
        *["volatility_30s", "volatility_60s", "lag_1s", "lag_5s", "lag_60s", "target_freq_next", "target_is_unstable", "alert"],
    )


