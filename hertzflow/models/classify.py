"""Instability classifiers: class-weighted trees and a sequence monitor."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import (
    GBTClassifier,
    MultilayerPerceptronClassificationModel,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metrics import class_weight
from ..operators.layout import OrderedRows
from ..operators.windows import sequences
from ..settings import DEFAULTS
from .quantile import assemble, complete, complete_rows


def fit_instability_classifier(
    train: DataFrame, features: Sequence[str], label: str, *, kind: str = "gbt", rounds: int = 20, depth: int = 5, seed: int = 42
):
    """Trees with positives weighted by the class ratio."""
    weight = train.agg(class_weight(label)).first()[0]
    train = complete_rows(train, features, label)
    rows = assemble(train, features).select(
        "_features", F.col(label).cast("double").alias("_y"), F.when(F.col(label) == 1, weight).otherwise(1.0).alias("_w")
    )
    shared = dict(featuresCol="_features", labelCol="_y", weightCol="_w", maxDepth=depth, seed=seed)
    if kind == "gbt":
        return GBTClassifier(maxIter=rounds, stepSize=0.1, **shared).fit(rows)
    if kind == "forest":
        return RandomForestClassifier(numTrees=rounds, **shared).fit(rows)
    raise ValueError(f"unknown kind: {kind}")


def classify(model, df: DataFrame, features: Sequence[str], probability: str = "probability") -> DataFrame:
    """Add probability and class to every row; both are null where a feature is null or NaN."""
    kept = [c for c in df.columns if c not in ("prediction", "probability", "rawPrediction", probability)]
    rows = model.transform(assemble(df.select(*kept), features))
    return rows.withColumn("_p", vector_to_array("probability")[1]).select(
        *kept,
        F.when(complete(features), F.col("_p")).alias(probability),
        F.when(complete(features), F.col("prediction").cast("int")).alias("predicted"),
    )


# The network keeps its flattened windows for all iterations; a task holds about this much of them.
WINDOW_BYTES = 64 << 20
_MONITOR = "features array<string>, rows int, lows array<double>, widths array<double>"


@dataclass(frozen=True)
class SequenceMonitor:
    """Probability of instability from the last rows of a series."""

    model: MultilayerPerceptronClassificationModel
    features: tuple[str, ...]
    rows: int
    lows: tuple[float, ...]
    widths: tuple[float, ...]

    def save(self, spark: SparkSession, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/network")
        row = (list(self.features), self.rows, list(self.lows), list(self.widths))
        spark.createDataFrame([row], _MONITOR).write.mode("overwrite").json(f"{path}/scaling")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SequenceMonitor:
        row = spark.read.schema(_MONITOR).json(f"{path}/scaling").first()
        network = MultilayerPerceptronClassificationModel.load(f"{path}/network")
        return cls(network, tuple(row.features), row.rows, tuple(row.lows), tuple(row.widths))

    def transform(self, ordered: OrderedRows, probability: str = "probability") -> DataFrame:
        """Score every row whose window is complete; the window ends at the row itself."""
        scaled = ordered.with_df(ordered.df.withColumns(_scaled(self.features, self.lows, self.widths)))
        seq = sequences(scaled, [f"_s_{f}" for f in self.features], self.rows)
        kept = [c for c in ordered.df.columns if c != probability]
        rows = self.model.transform(seq.withColumn("_features", _flat("sequence", self.features, self.rows)))
        return rows.withColumn("_p", vector_to_array("_probability")[1]).select(*kept, F.col("_p").alias(probability))


def _scaled(features, lows, widths) -> dict[str, Column]:
    return {f"_s_{f}": (F.col(f) - lo) / w for f, lo, w in zip(features, lows, widths)}


def _flat(column: str, features: Sequence[str], rows: int) -> Column:
    """A window as one vector. Incomplete windows are filtered out, but the optimiser
    may evaluate this first, so they give zeros rather than fail."""
    names = [f"_s_{f}" for f in features]
    flat = F.flatten(F.transform(column, lambda s: F.array(*[s[n].cast("double") for n in names])))
    return array_to_vector(F.coalesce(flat, F.array_repeat(F.lit(0.0), rows * len(names))))


def _window_tasks(ordered: OrderedRows, width: int) -> int | None:
    """How many tasks hold the windows of all rows; None where one could hold them all."""
    tasks = -(-8 * width * ordered.total // WINDOW_BYTES)
    return max(tasks, ordered.df.sparkSession.sparkContext.defaultParallelism) if tasks > 1 else None


def fit_sequence_monitor(
    ordered: OrderedRows,
    in_train: Column,
    features: Sequence[str],
    label: str,
    *,
    rows: int = DEFAULTS.sequence_rows,
    hidden: int = 50,
    iterations: int = 20,
    seed: int = 42,
) -> SequenceMonitor:
    """A feed-forward network over flattened windows scaled on the training rows.

    It takes the place of a recurrent network and is a different model. A flattened
    window is ``rows`` times as wide as its row, and the shuffle sizes its tasks by
    the rows, so long series are dealt by the size of their windows.
    """
    train = ordered.with_df(ordered.df.where(in_train))
    span = train.df.agg(*[g(f) for f in features for g in (F.min, F.max)]).first()
    lows = tuple(float(span[2 * i]) for i in range(len(features)))
    widths = tuple(float(span[2 * i + 1]) - lo or 1.0 for i, lo in enumerate(lows))
    scaled = train.with_df(train.df.withColumns(_scaled(features, lows, widths)))
    seq = sequences(scaled, [f"_s_{f}" for f in features], rows, label, _window_tasks(ordered, rows * len(features)))
    data = seq.select(_flat("sequence", features, rows).alias("_features"), F.col("next_label").cast("double").alias("_y"))
    network = MultilayerPerceptronClassifier(
        featuresCol="_features",
        labelCol="_y",
        probabilityCol="_probability",
        rawPredictionCol="_raw",
        predictionCol="_predicted",
        layers=[rows * len(features), hidden, 2],
        maxIter=iterations,
        seed=seed,
    )
    return SequenceMonitor(network.fit(data), tuple(features), rows, lows, widths)
