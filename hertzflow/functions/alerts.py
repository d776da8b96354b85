"""Alert and decision rules as column expressions over a scored table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..settings import DEFAULTS

# The three outcomes of two monitors.
BOTH = "INSTABILITY ALERT"
ONE = "HIGH MODEL UNCERTAINTY"
NONE = "SYSTEM STABLE"


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dual_trigger(lower, value, threshold: float = DEFAULTS.unstable_low) -> Column:
    """The predicted lower bound or the value itself is below the threshold."""
    return (_c(lower) < threshold) | (_c(value) < threshold)


def monitor_alert(probability, cut: float = 0.5) -> Column:
    return _c(probability) > cut


def status(alert, monitor) -> Column:
    a, m = _c(alert), _c(monitor)
    return F.when(a & m, BOTH).when(a | m, ONE).otherwise(NONE)


def conflict(alert, monitor) -> Column:
    return _c(alert) != _c(monitor)


def trust_score(alert, monitor, volatility, rocof, probability, value) -> Column:
    """100 less penalties for volatility, fast change, an undecided monitor and
    distance from nominal; 0 when the monitors disagree."""
    v, r, p, x = _c(volatility), F.abs(_c(rocof)), _c(probability), _c(value)
    undecided = 1 - 2 * F.abs(p - 0.5)
    distance = F.abs(x - DEFAULTS.nominal_hz)

    def penalty(when: Column, size: Column) -> Column:
        return F.when(when, size).otherwise(0.0)

    # Limits, weights and caps of the penalties.
    score = (
        100.0
        - penalty(v > 0.015, F.least(F.lit(20.0), 200 * v))
        - penalty(r > 0.01, F.least(F.lit(15.0), 150 * r))
        - penalty(undecided > 0.3, 20 * undecided)
        - penalty(distance > 0.05, F.least(F.lit(15.0), 100 * distance))
    )
    return F.when(conflict(alert, monitor), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)))


# Fixed values below: the limits of bands, zones and levels.


def frequency_band(value) -> Column:
    x = _c(value)
    return F.when(x.between(49.8, 50.2), "green").when(x >= 49.6, "amber").otherwise("red")


def frequency_zone(value) -> Column:
    x = _c(value)
    return F.when(x > 50.2, "high").when(x >= 49.8, "operational").when(x >= 49.5, "warning").otherwise("critical")


def rocof_band(rocof) -> Column:
    r = F.abs(_c(rocof))
    return F.when(r > 0.02, "red").when(r > 0.005, "amber").otherwise("green")


def bound_band(lower, threshold: float = DEFAULTS.unstable_low) -> Column:
    x = _c(lower)
    return F.when(x < threshold, "red").when(x < threshold + 0.05, "amber").otherwise("green")


def resilience_level(ratio) -> Column:
    return (1 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), _c(ratio)))) * 100


def resilience_band(level) -> Column:
    x = _c(level)
    return F.when(x > 60, "green").when(x > 30, "amber").otherwise("red")


def swing_uplift(power_mw, settings=DEFAULTS) -> Column:
    """Frequency gained by injecting power, from the swing equation."""
    return _c(power_mw) * settings.nominal_hz / (2 * settings.inertia_h * settings.system_mw)


def required_mw(lower, threshold: float = DEFAULTS.unstable_low, settings=DEFAULTS) -> Column:
    """Power that lifts the lower bound just above the threshold."""
    x = _c(lower)
    need = (threshold - x + 0.01) * (2 * settings.inertia_h * settings.system_mw) / settings.nominal_hz
    return F.when(x < threshold, need).otherwise(0.0)


def intervention_cost(power_mw, unit_cost, default: float = DEFAULTS.default_inertia_cost) -> Column:
    return _c(power_mw) * F.coalesce(_c(unit_cost), F.lit(default))


def midpoint(lower, upper) -> Column:
    return (_c(lower) + _c(upper)) / 2


def safety_nadir(ratio, volatility) -> Column:
    """Illustrative proxy of the lowest frequency a disturbance would cause."""
    return DEFAULTS.nominal_hz - 0.8 * _c(ratio) - 20.0 * _c(volatility)


def safety_surface(df: DataFrame, ratio: str, volatility: str, cells: int = 50, max_volatility: float = 0.05) -> DataFrame:
    """Rows and proxy nadir per cell of the (ratio, volatility) plane.

    Cells are spaced like ``cells`` grid points over [0, 1] and [0, max_volatility];
    rows beyond the edge count in the edge cell.
    """
    last = cells - 1

    def cell(x, high):
        return F.greatest(F.lit(0), F.least(F.lit(last), F.round(F.col(x) / high * last))).cast("int")

    out = df.groupBy(cell(ratio, 1.0).alias("ratio_cell"), cell(volatility, max_volatility).alias("volatility_cell")).agg(
        F.count("*").alias("rows")
    )
    r, v = F.col("ratio_cell") / last, F.col("volatility_cell") * max_volatility / last
    return out.withColumn("nadir", safety_nadir(r, v))


def scenario_levels(df: DataFrame, high_mw: int = 5000, step_mw: int = 100) -> DataFrame:
    """One copy of each row per power level; the fan-out is fixed by the levels."""
    return df.withColumn("mw", F.explode(F.sequence(F.lit(0), F.lit(high_mw), F.lit(step_mw))))


def scenario_sweep(
    df: DataFrame,
    lower: str,
    upper: str,
    value: str,
    ratio: str,
    threshold: float = DEFAULTS.unstable_low,
    high_mw: int = 5000,
    step_mw: int = 100,
    rescore=None,
) -> DataFrame:
    """Alerts and remaining need of every row at every power level.

    ``rescore`` may recompute the bounds from the lowered ratio, for models that use it.
    """
    rows = scenario_levels(df, high_mw, step_mw).withColumn(
        ratio, F.greatest(F.lit(0.0), F.col(ratio) - F.col("mw") / DEFAULTS.system_mw)
    )
    if rescore:
        rows = rescore(rows)
    rows = rows.withColumn("uplift", swing_uplift("mw")).withColumns(
        {lower: F.col(lower) + swing_uplift("mw"), upper: F.col(upper) + swing_uplift("mw")}
    )
    return rows.withColumn("alert", dual_trigger(lower, value, threshold)).withColumn(
        "required_mw", required_mw(lower, threshold)
    )
