"""Quantile models: boosted trees, grouped quantiles, shift recalibration."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import astuple, dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles
from ..operators.layout import order_rows
from ..storage import group_side, stage
from .grow import CUT_ROWS, LEAF, GrownTree, binned, blocks, find_cuts, grow, packed
from .trees import FlatTrees, compiled, predicted

_VECTOR = "_features"
_NODES = "feature array<int>, threshold array<double>, left array<int>, right array<int>, gain array<double>, depth int, features int"
_SAVED = (
    "features array<string>, alpha double, base double, rates array<double>, leaf_values array<array<double>>, "
    f"trees array<struct<{', '.join(c.replace(' ', ': ') for c in _NODES.split(', '))}>>"
)
_GROUPED = "cells array<string>, names array<string>, fallback array<double>"


@dataclass
class QuantileBoost:
    """Additive model of one conditional quantile."""

    features: list[str]
    alpha: float
    base: float
    rates: list[float] = field(default_factory=list)
    trees: list[GrownTree | DecisionTreeRegressionModel] = field(default_factory=list)
    leaf_values: list[list[float]] = field(default_factory=list)

    def transform(self, df: DataFrame, prediction: str) -> DataFrame:
        """Add the prediction to every row; it is null where a feature is null or NaN."""
        flat = compiled(self.trees, self.leaf_values, self.rates)
        return df.withColumn(prediction, F.when(complete(self.features), predicted(flat, self.base, self.features)))

    def importances(self) -> list[tuple[str, float]]:
        """Mean gain share of each feature over the trees, in percent."""
        grown = [t.featureImportances.toArray() for t in self.trees if t.depth > 0]
        mean = sum(grown) / len(grown) if grown else [0.0] * len(self.features)
        return [(f, 100.0 * float(v)) for f, v in zip(self.features, mean)]

    def save(self, spark: SparkSession, path: str) -> None:
        grown = all(isinstance(t, GrownTree) for t in self.trees)
        nodes = [astuple(t) for t in self.trees] if grown else None
        row = (self.features, self.alpha, self.base, self.rates, self.leaf_values, nodes)
        for i, tree in enumerate(() if grown else self.trees):
            tree.write().overwrite().save(f"{path}/trees/{i:04d}")
        # Written last: a folder with it holds a complete model.
        spark.createDataFrame([row], _SAVED).write.mode("overwrite").json(f"{path}/model")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> QuantileBoost:
        row = spark.read.schema(_SAVED).json(f"{path}/model").first()
        if row.trees is not None:
            trees = [GrownTree(**{c: list(v) if isinstance(v, list) else v for c, v in t.asDict().items()}) for t in row.trees]
        else:
            # Saved before trees were kept with the model.
            trees = [DecisionTreeRegressionModel.load(f"{path}/trees/{i:04d}") for i in range(len(row.leaf_values))]
        leaves = [list(v) for v in row.leaf_values]
        return cls(list(row.features), row.alpha, row.base, list(row.rates), trees, leaves)


def complete(features: Sequence[str]) -> Column:
    """Whether a row has all features, neither null nor NaN."""
    sound = [F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double")) for f in features]
    return reduce(lambda a, b: a & b, sound, F.lit(True))


def assemble(df: DataFrame, features: Sequence[str], vector: str = _VECTOR) -> DataFrame:
    """Features as one vector on every row; the caller decides about incomplete ones."""
    return VectorAssembler(inputCols=list(features), outputCol=vector, handleInvalid="keep").transform(df)


def complete_rows(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Rows to fit on. Rows without the label or a feature are left out and their number is told."""
    usable = complete(features) & F.col(label).isNotNull()
    missing = df.where(~usable).count()
    if missing:
        warnings.warn(f"{missing} rows without {label} or a feature are left out of the fit", stacklevel=3)
    return df.where(usable)


def _add_tree(rows, tree, values, rate, prediction):
    kept = rows.columns
    step = F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col(LEAF).cast("int") + 1)
    out = tree.transform(rows).withColumn(prediction, F.col(prediction) + rate * step)
    return out.select(*kept)


def fit_quantile_boost(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    alpha: float,
    *,
    rounds: int = 20,
    depth: int = 5,
    learning_rate: float = 0.1,
    seed: int = 42,
    stage_every: int = 5,
) -> QuantileBoost:
    """Boosting for the pinball loss on distributed trees.

    The first tree is grown on the labels and taken in full, so that the model
    starts near the conditional quantile; each later one is grown on the sign of
    the residuals, which sees spread but not distance, and added at the learning
    rate. Leaves are set to the quantile of their residuals, a mergeable sketch
    per leaf. Only histograms and leaf values reach the driver. Features are binned
    once (``grow``); running predictions are written out every few rounds, so a
    lost executor repeats a few rounds at most.
    """
    names = [f"_x{i}" for i in range(len(features))]
    usable = complete_rows(df, features, label)
    columns = [F.col(f).cast("double").alias(n) for f, n in zip(features, names)]
    rows = stage(usable.select(*columns, F.col(label).cast("double").alias("_y")), "boost")
    size, base = rows.agg(F.count("*"), F.percentile_approx("_y", alpha, 10_000)).first()
    if not size:
        raise ValueError(f"there are no rows with {label} and all features")
    model = QuantileBoost(list(features), alpha, base)
    cuts = find_cuts(rows, names, size, seed)
    rows = stage(binned(rows.withColumn("_at", F.lit(base)), names, ["_y", "_at"], cuts), "boost")
    # Trees grown since the running predictions were written, on bin numbers.
    recent: list[FlatTrees] = []
    for i in range(rounds):
        rate = learning_rate if i else 1.0
        # Cuts of small nodes often tie but for rounding. Where all rows choose the candidates, goals are
        # added up row by row, so that ties fall as in Spark ML; larger tables draw candidates and count.
        sides = (alpha - 1.0, alpha) if i and size > CUT_ROWS else None
        tree = grow(rows, cuts, _goals(recent, alpha if i else None, bool(sides)), depth=depth, least=20, sides=sides)
        leaves = tree.flat(range(len(tree.leaves)), cuts)
        refit = rows.mapInArrow(_errors(len(features), recent, leaves), f"{LEAF} int, _error double")
        refit = refit.groupBy(LEAF).agg(F.percentile_approx("_error", alpha, 10_000).alias("v"))
        found = {int(r[LEAF]): r.v for r in refit.collect()}
        values = [found.get(leaf, 0.0) for leaf in range(max(found) + 1)]
        model.trees.append(tree)
        model.leaf_values.append(values)
        model.rates.append(rate)
        recent = [*recent, tree.flat([rate * v for v in values], cuts)]
        if (i + 1) % stage_every == 0 and i + 1 < rounds:
            rows, recent = stage(rows.mapInArrow(_moved(len(features), recent, rows.columns), rows.schema), "boost"), []
    return model


def _running(x: np.ndarray, at: np.ndarray, recent: Sequence[FlatTrees]) -> np.ndarray:
    """Running predictions of a block with the trees grown since they were written."""
    for flat in recent:
        at = flat.add_to(at, x)
    return at


def _goals(recent: Sequence[FlatTrees], alpha: float | None, counted: bool):
    """What a tree explains: the labels, or with ``alpha`` the side of the running prediction they lie on."""

    def goals(x, y, at):
        if alpha is None:
            return y
        above = y > _running(x, at, recent)
        return above if counted else np.where(above, alpha, alpha - 1.0)

    return goals


def _errors(k: int, recent: Sequence[FlatTrees], leaves: FlatTrees):
    def errors(batches):
        for x, y, at in blocks(batches, k):
            leaf = leaves.add_to(np.zeros(len(x)), x).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(y - _running(x, at, recent))], names=[LEAF, "_error"])

    return errors


def _moved(k: int, recent: Sequence[FlatTrees], names: Sequence[str]):
    def moved(batches):
        for x, y, at in blocks(batches, k):
            yield packed(names, x, y, _running(x, at, recent))

    return moved


def permutation_importance(
    df: DataFrame, predict, features: Sequence[str], loss: Column, key: Sequence[str], seed: int = 42
) -> list[tuple[str, float]]:
    """Rise of ``loss``, an aggregate over predicted rows, when a feature is shuffled among rows.

    Rows are put in a pseudo-random order once; each takes the feature of the row
    before it, which shuffles all rows without gathering any.
    """
    draw = F.xxhash64(F.lit(seed), *key)
    frames = order_rows(df.withColumn("_draw", draw), [], ["_draw", *key]).framed(before=1)
    moved = {f"_moved_{f}": F.coalesce(F.lag(f).over(frames.window), F.col(f)) for f in features}
    rows = stage(frames.trim(frames.rows.withColumns(moved)), "permuted")
    base = predict(rows).agg(loss).first()[0]
    return [(f, predict(rows.withColumn(f, F.col(f"_moved_{f}"))).agg(loss).first()[0] - base) for f in features]


def grid_key(column: str, step: float) -> Column:
    """Cell number of a value on a grid."""
    return F.floor(F.col(column) / step).cast("bigint")


@dataclass(frozen=True)
class GroupedQuantiles:
    """Quantiles of the label per cell of quantised features."""

    table: DataFrame
    cells: tuple[str, ...]
    names: tuple[str, ...]
    fallback: tuple[float, ...]

    def save(self, spark: SparkSession, path: str) -> None:
        self.table.write.mode("overwrite").parquet(f"{path}/table")
        row = (list(self.cells), list(self.names), list(self.fallback))
        spark.createDataFrame([row], _GROUPED).write.mode("overwrite").json(f"{path}/model")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> GroupedQuantiles:
        row = spark.read.schema(_GROUPED).json(f"{path}/model").first()
        return cls(spark.read.parquet(f"{path}/table"), tuple(row.cells), tuple(row.names), tuple(row.fallback))

    def transform(self, df: DataFrame) -> DataFrame:
        scored = df.join(group_side(self.table, "grouped-quantiles"), list(self.cells), "left")
        return scored.withColumns({n: F.coalesce(n, F.lit(v)) for n, v in zip(self.names, self.fallback)})


def fit_grouped_quantiles(
    df: DataFrame, cells: Sequence[str], label: str, alphas: Sequence[float], names: Sequence[str]
) -> GroupedQuantiles:
    long = exact_quantiles(df, cells, label, alphas)
    picks = [F.max(F.when(F.col("alpha") == a, F.col("quantile"))).alias(n) for a, n in zip(alphas, names)]
    table = stage(long.groupBy(*cells).agg(*picks), "grouped-quantiles")
    overall = {r.alpha: r["quantile"] for r in exact_quantiles(df, [], label, alphas).collect()}
    return GroupedQuantiles(table, tuple(cells), tuple(names), tuple(overall[a] for a in alphas))


def conformal_shift(calibration: DataFrame, label: str, prediction: str, alpha: float) -> float:
    """The shift after which ``alpha`` of the held-out labels lie below the prediction."""
    errors = calibration.select((F.col(label) - F.col(prediction)).alias("_error"))
    found = exact_quantiles(errors, [], "_error", [alpha]).first()
    if found is None:
        raise ValueError("there are no calibration rows with a label and a prediction")
    return found["quantile"]


def conformal_bounds(
    calibration: DataFrame, label: str, bounds: Sequence[str], alphas: Sequence[float]
) -> tuple[float, ...]:
    """The shift of each bound to its own level, with the errors of all bounds ordered together."""
    each = [F.struct(F.lit(i).alias("_bound"), (F.col(label) - F.col(q)).alias("_error")) for i, q in enumerate(bounds)]
    errors = calibration.select(F.inline(F.array(*each)))
    found = {(r._bound, r.alpha): r["quantile"] for r in exact_quantiles(errors, ["_bound"], "_error", alphas).collect()}
    if any((i, float(a)) not in found for i, a in enumerate(alphas)):
        raise ValueError("there are no calibration rows with a label and a prediction")
    return tuple(found[i, float(a)] for i, a in enumerate(alphas))


def conformal_shifts(
    calibration: DataFrame, label: str, prediction: str, alpha: float, by: Sequence[str], name: str = "shift"
) -> DataFrame:
    """The same per group, as a table to join."""
    errors = calibration.select(*by, (F.col(label) - F.col(prediction)).alias("_error"))
    return exact_quantiles(errors, by, "_error", [alpha]).select(*by, F.col("quantile").alias(name))
