"""From raw series to the feature table and the scored table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import alerts
from ..operators.asof import asof_join
from ..operators.layout import OrderedRows, order_rows
from ..operators.select import calendar_parts, renewable_ratio
from ..operators.swinging_door import ramp_rate
from ..operators.windows import add_steps, feature_steps
from ..settings import DEFAULTS


def merge_series(
    fast: DataFrame, hourly: DataFrame, daily: DataFrame, ts: str = "timestamp", left_tie: Sequence[str] = ()
) -> DataFrame:
    """Give each fast row the hourly and daily rows valid at it; drop incomplete rows."""
    merged = asof_join(fast, hourly, ts, left_tie=left_tie)
    merged = asof_join(merged, daily, ts, left_tie=left_tie)
    return merged.dropna()


def row_features(ordered: OrderedRows, value: str = "grid_frequency", settings=DEFAULTS) -> DataFrame:
    """All row-frame features and targets behind a single shuffle and sort."""
    back = max(*settings.volatility_rows, *settings.lag_rows, settings.rocof_rows + 1)
    frames = ordered.framed(before=back, after=settings.horizon_rows)
    return frames.trim(add_steps(frames.rows, feature_steps(frames, value, settings)))


def build_features(
    merged: DataFrame,
    series: Sequence[str],
    order: Sequence[str],
    ts: str = "timestamp",
    settings=DEFAULTS,
    door_width: float | None = DEFAULTS.door_width,
) -> OrderedRows:
    """The feature table: ramp rate, row features, ratio and calendar; complete rows only."""
    ordered = order_rows(merged, series, order)
    ramped = ordered.with_df(ramp_rate(ordered, ts, "wind_speed", door_width, "wind_ramp_rate"))
    rows = row_features(ramped, settings=settings).withColumn("renewable_penetration_ratio", renewable_ratio())
    return ordered.with_df(rows.withColumns(calendar_parts(ts)).dropna())


def decide(
    scored: DataFrame,
    threshold: float = DEFAULTS.unstable_low,
    *,
    lower: str = "lower",
    upper: str = "upper",
    value: str = "grid_frequency",
    probability: str = "probability",
) -> DataFrame:
    """All decision columns of a scored table: alerts, status, trust, need and cost."""
    monitor = alerts.monitor_alert(probability)
    first = {
        "alert": alerts.dual_trigger(lower, value, threshold),
        "monitor": monitor,
        "midpoint": alerts.midpoint(lower, upper),
        "band_width": F.col(upper) - F.col(lower),
        "required_mw": alerts.required_mw(lower, threshold),
        "resilience": alerts.resilience_level("renewable_penetration_ratio"),
        "frequency_band": alerts.frequency_band(value),
        "rocof_band": alerts.rocof_band("rocof"),
    }
    second = {
        "status": alerts.status("alert", "monitor"),
        "conflict": alerts.conflict("alert", "monitor"),
        "trust": alerts.trust_score("alert", "monitor", "volatility_10s", "rocof", probability, value),
        "intervention_cost": alerts.intervention_cost("required_mw", "inertia_cost"),
    }
    return scored.withColumns(first).withColumns(second)
