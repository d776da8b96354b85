"""Defaults of the library. Every operator takes them as arguments."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # They decide results and must not drift.
    horizon_rows: int = 10
    door_width: float = 0.5
    lag_rows: tuple[int, ...] = (1, 5, 60)
    lag_fill: float = 50.0
    volatility_rows: tuple[int, ...] = (10, 30, 60)
    rocof_rows: int = 5
    unstable_low: float = 49.8
    unstable_high: float = 50.2
    wind_capacity_mw: float = 3000.0
    demand_mw: float = 35000.0
    alphas: tuple[float, float] = (0.1, 0.9)
    sequence_rows: int = 30
    inertia_h: float = 4.0
    nominal_hz: float = 50.0
    system_mw: float = 35000.0
    countdown_rows: int = 300
    default_inertia_cost: float = 12.5


DEFAULTS = Settings()

# The model inputs, in order.
MODEL_FEATURES = [
    "grid_frequency",
    "rocof",
    "volatility_10s",
    "volatility_30s",
    "volatility_60s",
    "wind_speed",
    "wind_ramp_rate",
    "solar_radiation",
    "hour",
    "renewable_penetration_ratio",
    "lag_1s",
    "lag_5s",
    "lag_60s",
]
