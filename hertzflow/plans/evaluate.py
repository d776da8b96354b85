"""Scoring and evaluation over any period."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import aggregate, interval_metrics
from ..models.calibrate import apply_isotonic
from ..settings import DEFAULTS


def score(
    df: DataFrame,
    predict: Callable[[DataFrame], DataFrame],
    *,
    calibrators: tuple | None = None,
    shifts: tuple[float, float] | None = None,
    lower: str = "lower",
    upper: str = "upper",
) -> DataFrame:
    """Predict both bounds, then recalibrate them by isotonic maps or by shifts."""
    rows = predict(df)
    if calibrators:
        for model, column in zip(calibrators, (lower, upper)):
            rows = apply_isotonic(model, rows, column, column)
    if shifts:
        rows = rows.withColumns({c: F.col(c) + F.lit(s) for c, s in zip((lower, upper), shifts)})
    return rows


def evaluate(
    scored: DataFrame,
    target: str = "target_freq_next",
    *,
    ts: str = "timestamp",
    period: tuple | None = None,
    by: Sequence[str] = (),
    min_rows: int = 0,
    lower: str = "lower",
    upper: str = "upper",
    alphas: tuple[float, float] = DEFAULTS.alphas,
) -> DataFrame:
    """All band metrics of a half-open period, optionally per group, in one aggregate."""
    rows = scored.where(F.col(target).isNotNull())
    if period:
        rows = rows.where((F.col(ts) >= F.lit(period[0])) & (F.col(ts) < F.lit(period[1])))
    return aggregate(rows, interval_metrics(target, lower, upper, alphas), by, min_rows)
