"""Isotonic recalibration of predictions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.layout import POS, order_rows
from ..storage import stage

CHUNK = 4096
BROADCAST_POINTS = 100_000
_BLOCK = "lo double, hi double, y double, w double"


def pool(y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pool adjacent violators: the begin, mean and weight of each block of a non-decreasing fit."""
    first, mean, weight = [], [], []
    for i, (value, mass) in enumerate(zip(y.tolist(), w.tolist(), strict=True)):
        at = i
        while mean and mean[-1] >= value:
            both = weight[-1] + mass
            value, mass, at = (mean.pop() * weight.pop() + value * mass) / both, both, first.pop()
        first.append(at)
        mean.append(value)
        weight.append(mass)
    return np.array(first, np.int64), np.array(mean), np.array(weight)


def _pooled(key, table):
    table = table.sort_by("lo")
    lo, hi, y, w = (table.column(c).to_numpy() for c in ("lo", "hi", "y", "w"))
    first, mean, weight = pool(y, w)
    last = np.append(first[1:], len(y)) - 1
    return pa.table({"lo": lo[first], "hi": hi[last], "y": mean, "w": weight})


@dataclass(frozen=True)
class IsotonicMap:
    """A monotone map: ``points`` (x, y) are the ends of its blocks, straight between them, flat beyond."""

    points: DataFrame

    def save(self, spark: SparkSession, path: str) -> None:
        self.points.write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> IsotonicMap:
        return cls(spark.read.schema("x double, y double").parquet(path))

    def transform(self, df: DataFrame, prediction: str, out: str) -> DataFrame:
        """Add the mapped ``prediction``; null stays null, and so does every row of a map without points.

        Up to ``BROADCAST_POINTS`` points are broadcast; beyond that rows and points are ordered
        together, and the points on both sides are carried to each row.
        """
        if self.points.count() <= BROADCAST_POINTS:
            return self._looked_up(df, prediction, out)
        return self._carried(df, prediction, out)

    def _looked_up(self, df: DataFrame, prediction: str, out: str) -> DataFrame:
        held = self.points.orderBy("x").toPandas()
        sent = df.sparkSession.sparkContext.broadcast((held["x"].to_numpy(), held["y"].to_numpy()))

        @F.pandas_udf("double")
        def mapped(at: pd.Series) -> pd.Series:
            x, y = sent.value
            found = np.interp(at.to_numpy(dtype=float), x, y) if len(x) else np.full(len(at), np.nan)
            return pd.Series(found).where(at.notna().to_numpy())

        return df.withColumn(out, mapped(F.col(prediction).cast("double")))

    def _carried(self, df: DataFrame, prediction: str, out: str) -> DataFrame:
        names = df.columns
        point = F.struct(F.col("x").alias("x"), F.col("y").alias("y"))
        marks = self.points.select(F.col("x").alias("_at"), point.alias("_point"))
        rows = df.withColumn("_at", F.col(prediction).cast("double")).withColumn("_row", F.monotonically_increasing_id())
        both = order_rows(rows.unionByName(marks, allowMissingColumns=True), [], ["_at", "_row"])
        below = both.running({"_below": ("last", F.col("_point"))})
        kept = both.with_df(stage(below, "points-below"))
        found = kept.running({"_above": ("last", F.col("_point"))}, backward=True).where(F.col("_row").isNotNull())
        low, high, at = F.col("_below"), F.col("_above"), F.col("_at")
        between = low["y"] + (high["y"] - low["y"]) * (at - low["x"]) / (high["x"] - low["x"])
        inner = F.when(high.isNull() | (low["x"] == at), low["y"]).when(low.isNull() | (high["x"] == at), high["y"]).otherwise(between)
        columns = [F.when(at.isNotNull(), inner).alias(out) if c == out else F.col(c) for c in dict.fromkeys([*names, out])]
        return found.select(*columns)


def fit_isotonic(df: DataFrame, prediction: str, label: str, resolution: float | None = None) -> IsotonicMap:
    """Monotone map from predictions to labels, flat beyond the seen range.

    Labels are averaged per prediction first, which leaves the fit unchanged and lets equal
    predictions meet. Predictions are then ordered, and chunks of ``CHUNK`` neighbours pooled in
    parallel; the blocks that are left are numbered anew and pooled again in chunks shifted by
    half, until no block lies above its right neighbour. Pooling in any order gives the same
    fit, every round shrinks what still violates by the size of a chunk, and no task sees more
    than a chunk. ``resolution`` puts predictions on a grid first, which changes the fit.
    The fit is one of conditional means: for true quantile levels use ``conformal_shift``.
    """
    at = F.col(prediction).cast("double")
    if resolution:
        at = F.round(at / resolution) * resolution
    means = (
        df.where(F.col(label).isNotNull() & F.col(prediction).isNotNull())
        .groupBy(at.alias("lo"))
        .agg(F.avg(F.col(label).cast("double")).alias("y"), F.count("*").cast("double").alias("w"))
    )
    blocks, shift = means.select("lo", F.col("lo").alias("hi"), "y", "w"), 0
    while True:
        ordered = order_rows(blocks, [], ["lo"])
        frames = ordered.framed(before=1)
        steps = frames.trim(frames.rows.withColumn("_before", F.lag("y").over(frames.window)))
        if steps.where(F.col("_before") >= F.col("y")).isEmpty():
            break
        chunk = F.expr(f"({POS} + {shift}) div {CHUNK}").alias("_chunk")
        grouped = ordered.df.select("lo", "hi", "y", "w", chunk).groupBy("_chunk")
        blocks, shift = stage(grouped.applyInArrow(_pooled, _BLOCK), "isotonic-blocks"), CHUNK // 2 - shift
    ends = F.explode(F.array_distinct(F.array("lo", "hi"))).alias("x")
    return IsotonicMap(stage(ordered.df.select(ends, "y"), "isotonic-map"))


def apply_isotonic(model: IsotonicMap, df: DataFrame, prediction: str, out: str) -> DataFrame:
    return model.transform(df, prediction, out)
