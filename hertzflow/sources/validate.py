"""Schema and range checks that report instead of failing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Predicates a good value satisfies.
FREQUENCY_CHECKS = {"grid_frequency": "grid_frequency > 40.0 AND grid_frequency < 60.0"}
WEATHER_CHECKS = {
    "temperature": "temperature > -50.0 AND temperature < 50.0",
    "wind_speed": "wind_speed >= 0.0",
    "solar_radiation": "solar_radiation >= 0.0",
}
COST_CHECKS = {"inertia_cost": "inertia_cost >= 0"}
INERTIA_CHECKS = {"system_inertia_mws": "system_inertia_mws >= 0"}


def schema_report(df: DataFrame, expected: Mapping[str, str]) -> list[tuple[str, str, str, str]]:
    """(column, expected, found, verdict) with verdict ok, cast or missing."""
    found = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    out = []
    for name, kind in expected.items():
        have = found.get(name)
        verdict = "missing" if have is None else "ok" if have == kind else "cast"
        out.append((name, kind, have or "", verdict))
    return out


def safe_cast(df: DataFrame, expected: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """Cast columns of another type, and report per column how many values did not survive.

    A missing column stops the casting, as later columns may depend on it; the
    report says so and the rows pass through.
    """
    report = schema_report(df, expected)
    to_cast = [] if any(r[3] == "missing" for r in report) else [(n, k) for n, k, _, v in report if v == "cast"]
    cast = df.withColumns({n: F.col(n).try_cast(k) for n, k in to_cast})
    lost = {n: F.count_if(F.col(n).isNotNull() & F.col(n).try_cast(k).isNull()) for n, k in to_cast}
    rows = [
        F.struct(
            F.lit(n).alias("column_name"),
            F.lit(k).alias("expected"),
            F.lit(have).alias("found"),
            F.lit(v).alias("verdict"),
            (F.col(f"_lost_{n}") if n in lost else F.lit(0).cast("bigint")).alias("lost_values"),
        )
        for n, k, have, v in report
    ]
    totals = df.agg(F.count("*").alias("_n"), *[c.alias(f"_lost_{n}") for n, c in lost.items()])
    return cast, totals.select(F.inline(F.array(*rows)))


def range_report(df: DataFrame, checks: Mapping[str, str], by: Sequence[str] = ()) -> DataFrame:
    """Minimum, maximum and number of bad values per checked column, from one pass."""
    present = [c for c in checks if c in df.columns]
    aggs = []
    for c in present:
        aggs += [
            F.min(F.col(c).cast("double")).alias(f"_min_{c}"),
            F.max(F.col(c).cast("double")).alias(f"_max_{c}"),
            F.count_if(~F.expr(checks[c])).alias(f"_bad_{c}"),
        ]
    rows = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.col(f"_min_{c}").alias("min_value"),
            F.col(f"_max_{c}").alias("max_value"),
            F.col(f"_bad_{c}").alias("bad_rows"),
        )
        for c in present
    ]
    return df.groupBy(*by).agg(*aggs).select(*by, F.inline(F.array(*rows)))


def quarantine(df: DataFrame, checks: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """Split rows into those passing every check and the rest. Nulls pass."""
    ok = F.lit(True)
    for c, predicate in checks.items():
        if c in df.columns:
            ok = ok & F.coalesce(F.expr(predicate), F.lit(True))
    return df.where(ok), df.where(~ok)


def validate(df: DataFrame, expected: Mapping[str, str], checks: Mapping[str, str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cast rows, schema report, range report. Nothing is dropped."""
    cast, schema = safe_cast(df, expected)
    return cast, schema, range_report(cast, checks)
