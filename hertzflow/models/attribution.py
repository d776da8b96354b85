"""Additive attribution of predictions to features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantile import assemble, complete_rows


def marginal_weights(df: DataFrame, features: Sequence[str], target: str) -> tuple[dict, dict]:
    """Slope of the target on each feature alone, and the feature means, in one pass."""
    row = df.agg(
        *[F.regr_slope(F.col(target), F.col(f)).alias(f"w{i}") for i, f in enumerate(features)],
        *[F.avg(f).alias(f"m{i}") for i, f in enumerate(features)],
    ).first()
    weights = {f: row[f"w{i}"] or 0.0 for i, f in enumerate(features)}
    return weights, {f: row[f"m{i}"] or 0.0 for i, f in enumerate(features)}


def surrogate_weights(df: DataFrame, features: Sequence[str], prediction: str) -> tuple[dict, dict]:
    """Weights of a linear surrogate of a model's predictions, and the feature means."""
    df = complete_rows(df, features, prediction)
    rows = assemble(df, features).select("_features", F.col(prediction).alias("_y"))
    fit = LinearRegression(featuresCol="_features", labelCol="_y", regParam=1e-6).fit(rows)
    means = df.agg(*[F.avg(f) for f in features]).first()
    return dict(zip(features, map(float, fit.coefficients))), dict(zip(features, map(float, means)))


def contributions(weights: Mapping[str, float], means: Mapping[str, float]) -> dict[str, Column]:
    """w * (x - mean) per feature: exact for a linear model."""
    return {f: F.lit(float(w)) * (F.col(f) - F.lit(float(means[f]))) for f, w in weights.items()}


def ranked(phi: Mapping[str, Column]) -> Column:
    """All contributions of a row as an array, largest magnitude first."""
    items = F.array(
        *[
            F.struct((-F.abs(c)).alias("order"), F.lit(f).alias("feature"), c.alias("phi"))
            for f, c in sorted(phi.items())
        ]
    )
    return F.array_sort(items)


def top_contributions(df: DataFrame, key: Sequence[str], phi: Mapping[str, Column], k: int = 8) -> DataFrame:
    """(key, rank, feature, phi) of the ``k`` largest contributions, ranked within the row: no shuffle."""
    rows = df.select(*key, F.posexplode(F.slice(ranked(phi), 1, k)).alias("_i", "_c"))
    return rows.select(*key, (F.col("_i") + 1).alias("rank"), F.col("_c.feature").alias("feature"), F.col("_c.phi").alias("phi"))


def top_negative_driver(phi: Mapping[str, Column], k: int = 8) -> Column:
    """The largest of the top contributions that lowers the prediction, or 'None'."""
    lowering = F.filter(F.slice(ranked(phi), 1, k), lambda c: c["phi"] < 0)
    return F.coalesce(F.get(lowering, 0)["feature"], F.lit("None"))


def attribution_shares(df: DataFrame, phi: Mapping[str, Column], ts: str, hours: int = 8) -> DataFrame:
    """Mean |contribution| per feature and part of the day as a share, and its spread over the parts.

    Rows are reduced to one per day part before features become rows.
    """
    part = F.floor(F.hour(ts) / hours).cast("int").alias("day_part")
    names = list(phi)
    means = df.groupBy(part).agg(*[F.avg(F.abs(phi[f])).alias(f"_p{i}") for i, f in enumerate(names)])
    total = sum((F.col(f"_p{i}") for i in range(1, len(names))), F.col("_p0"))
    rows = [
        F.struct(
            F.lit(f).alias("feature"),
            F.coalesce(F.col(f"_p{i}") / F.nullif(total, F.lit(0.0)) * 100, F.lit(0.0)).alias("share_pct"),
        )
        for i, f in enumerate(names)
    ]
    return (
        means.select(F.inline(F.array(*rows)))
        .groupBy("feature")
        .agg(F.avg("share_pct").alias("mean_share_pct"), F.stddev_pop("share_pct").alias("share_spread"))
    )
