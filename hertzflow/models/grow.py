"""Regression trees grown on binned features, one small histogram per level.

Features become bin numbers once, in blocks of rows. A level of a tree is one pass: tasks count rows
and add up goals per open node, feature and bin, Spark sums these counts, and the driver, which sees at most
``2 ** depth`` nodes times features times ``BINS`` of them, takes the cut with the largest fall in
variance. Nothing is cached and no row is shuffled. Cuts, their candidates, ties and early leaves
are those of Spark ML's regression tree.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .trees import FlatTrees

BINS = 32
# Candidate cuts are quantiles of this many rows, drawn at random from larger tables.
CUT_ROWS = 10_000
LEAF = "_leaf"
_HISTOGRAM = "cell int, n double, s double, q double"
_EPSILON = 2.0**-52


@dataclass(frozen=True)
class GrownTree:
    """Nodes in preorder: ``feature`` (-1 at a leaf), ``threshold``, children ``left`` and ``right``
    (a leaf's own number), and ``gain``, the fall in variance times the rows."""

    feature: list[int]
    threshold: list[float]
    left: list[int]
    right: list[int]
    gain: list[float]
    depth: int
    features: int

    @property
    def leaves(self) -> list[int]:
        return [i for i, f in enumerate(self.feature) if f < 0]

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802 - as the trees of Spark ML name it
        total = np.zeros(self.features)
        for f, gain in zip(self.feature, self.gain, strict=True):
            if f >= 0:
                total[f] += gain
        return Vectors.dense(total / total.sum() if total.sum() > 0 else total)

    def flat(self, values: Sequence[float], cuts: Sequence[np.ndarray] | None = None) -> FlatTrees:
        """The tree with the values its leaves add, left to right; with ``cuts``, on bin numbers."""
        at = self.threshold
        if cuts is not None:
            at = [float(np.searchsorted(cuts[f], t)) if f >= 0 else 0.0 for f, t in zip(self.feature, at, strict=True)]
        adds = np.zeros(len(self.feature))
        # Values are listed up to the last leaf that any row reached.
        for leaf, value in zip(self.leaves, values):
            adds[leaf] = value
        ints = (np.array(a, np.int64) for a in (self.feature, self.left, self.right))
        feature, left, right = ints
        return FlatTrees(feature, np.array(at, float), left, right, adds, np.array([0]), np.array([self.depth]))

    def transform(self, df: DataFrame, vector: str = "_features") -> DataFrame:
        """Add the number of each row's leaf, from left to right."""
        x, number = vector_to_array(vector), {node: i for i, node in enumerate(self.leaves)}

        def leaf(node: int) -> Column:
            if self.feature[node] < 0:
                return F.lit(number[node])
            goes_left = x[self.feature[node]] <= self.threshold[node]
            return F.when(goes_left, leaf(self.left[node])).otherwise(leaf(self.right[node]))

        return df.withColumn(LEAF, leaf(0).cast("double"))


def cut_points(values: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Candidate cuts: between all neighbouring values if they are few, else between those nearest to equal shares."""
    distinct, counts = np.unique(values, return_counts=True)
    middles = (distinct[:-1] + distinct[1:]) / 2
    if len(middles) < bins:
        return middles
    stride, upto, chosen = len(values) / bins, np.cumsum(counts).tolist(), []
    target = stride
    for i in range(1, len(distinct)):
        if abs(upto[i - 1] - target) < abs(upto[i] - target):
            chosen.append(middles[i - 1])
            target += stride
    return np.array(chosen)


def find_cuts(df: DataFrame, features: Sequence[str], rows: int, seed: int) -> list[np.ndarray]:
    """Candidate cuts of each feature, from at most about ``CUT_ROWS`` rows."""
    drawn = df.select(*features)
    drawn = drawn.sample(CUT_ROWS / rows, seed) if rows > CUT_ROWS else drawn
    table = drawn.toArrow()
    bins = max(min(BINS, rows), 1)
    return [cut_points(np.asarray(table.column(i).to_numpy(), float), bins) for i in range(len(features))]


def binned(df: DataFrame, features: Sequence[str], others: Sequence[str], cuts: Sequence[np.ndarray]) -> DataFrame:
    """Blocks of rows: bin numbers of the features, row by row, as ``_x`` beside ``others``, which are doubles.

    A row of the result holds the rows of one Arrow batch, since a pass over single
    rows would spend its time on handing them to Python.
    """
    k = len(features)

    def cut(batches):
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(k + len(others))]
            x = np.column_stack([np.searchsorted(c, v).astype(np.int8) for c, v in zip(cuts, columns)])
            yield packed(names, x, *columns[k:])

    names = ["_x", *others]
    return df.select(*features, *others).mapInArrow(cut, ", ".join(f"{c} binary" for c in names))


def packed(names: Sequence[str], *arrays: np.ndarray) -> pa.RecordBatch:
    """One block."""
    return pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in arrays], names=list(names))


def blocks(batches, k: int):
    """(bin numbers, other columns ...) of each block of ``k`` features."""
    for batch in batches:
        for i in range(batch.num_rows):
            x, *others = (batch.column(j)[i].as_buffer() for j in range(batch.num_columns))
            yield np.frombuffer(x, np.int8).reshape(-1, k), *(np.frombuffer(o) for o in others)


@dataclass
class _Node:
    """A node while its tree grows; ``slot`` numbers the open nodes of a level."""

    slot: int = -1
    feature: int = -1
    cut: int = 0
    gain: float = 0.0
    mean: float = 0.0
    impurity: float | None = None
    children: tuple[_Node, _Node] | None = None


def _listed(root: _Node) -> list[_Node]:
    """Nodes in preorder."""
    found, waiting = [], [root]
    while waiting:
        node = waiting.pop()
        found.append(node)
        if node.children:
            waiting += [node.children[1], node.children[0]]
    return found


def _walk(root: _Node) -> FlatTrees:
    """The tree so far; a leaf's value is its slot."""
    nodes = _listed(root)
    place = {id(n): i for i, n in enumerate(nodes)}
    left = np.array([place[id(n.children[0])] if n.children else i for i, n in enumerate(nodes)], np.int64)
    right = np.array([place[id(n.children[1])] if n.children else i for i, n in enumerate(nodes)], np.int64)
    feature = np.array([n.feature for n in nodes], np.int64)
    arrays = (feature, np.array([n.cut for n in nodes], float), left, right, np.array([n.slot for n in nodes], float))
    return FlatTrees(*arrays, np.array([0]), np.array([_depth(root)]))


def _depth(node: _Node) -> int:
    return 1 + max(map(_depth, node.children)) if node.children else 0


def _variance(n, s, q):
    return (q - s * s / n) / n


def _best_cut(n: np.ndarray, s: np.ndarray, q: np.ndarray, cuts: Sequence[np.ndarray], least: int, before: float | None):
    """(gain, feature, bin, left, right) of the first largest fall in variance of one node of variance ``before``; arrays are features by bins."""
    best = (0.0, -1, 0, None, None)
    for f, points in enumerate(cuts):
        if not len(points):
            continue
        upto = [np.cumsum(a[f]) for a in (n, s, q)]
        left, whole = [a[: len(points)] for a in upto], [a[-1] for a in upto]
        right = [w - a for w, a in zip(whole, left, strict=True)]
        if before is None:
            before = _variance(*(a[0] + b[0] for a, b in zip(left, right, strict=True)))
        sound = (left[0] >= least) & (right[0] >= least)
        if not sound.any():
            continue
        with np.errstate(divide="ignore", invalid="ignore"):
            gains = before - left[0] / whole[0] * _variance(*left) - right[0] / whole[0] * _variance(*right)
        gains = np.where(sound, gains, -np.inf)
        at = int(np.argmax(gains))
        if gains[at] > best[0]:
            best = (float(gains[at]), f, at, [float(a[at]) for a in left], [float(a[at]) for a in right])
    return best


def grow(rows: DataFrame, cuts: Sequence[np.ndarray], goals, *, depth: int, least: int, sides: tuple[float, float] | None = None) -> GrownTree:
    """One tree on ``binned`` rows; ``goals(x, *others)`` gives what the tree is to explain of a
    block: numbers, or with ``sides`` whether a row has the second of these two."""
    k, bins = len(cuts), max([len(c) for c in cuts], default=0) + 1
    root = _Node(slot=0)
    level = [root]
    for _ in range(depth):
        if not level:
            break
        sums = _histograms(rows, _walk(root), goals, sides, len(level), k, bins)
        following = []
        for node in level:
            n, s, q = (a[node.slot] for a in sums)
            node.slot = -1
            gain, feature, at, left, right = _best_cut(n, s, q, cuts, least, node.impurity)
            if feature < 0:
                continue
            node.feature, node.cut, node.gain = feature, at, gain * float(n[feature].sum())
            node.children = tuple(_Node(mean=side[1] / side[0], impurity=_variance(*side)) for side in (left, right))
            # A side whose goals are all equal stays a leaf.
            following += [c for c in node.children if abs(c.impurity) >= _EPSILON]
        for slot, node in enumerate(following):
            node.slot = slot
        level = following
    _merge(root)
    nodes = _listed(root)
    place = {id(n): i for i, n in enumerate(nodes)}
    children = [[place[id(n.children[j])] if n.children else i for i, n in enumerate(nodes)] for j in (0, 1)]
    thresholds = [float(cuts[n.feature][n.cut]) if n.children else 0.0 for n in nodes]
    return GrownTree([n.feature for n in nodes], thresholds, *children, [n.gain for n in nodes], _depth(root), k)


def _merge(node: _Node) -> None:
    """Two leaves of one mean become one."""
    if not node.children:
        return
    for child in node.children:
        _merge(child)
    left, right = node.children
    if not left.children and not right.children and left.mean == right.mean:
        node.children, node.feature, node.cut, node.gain = None, -1, 0, 0.0


def _histograms(rows: DataFrame, walk: FlatTrees, goals, sides, nodes: int, k: int, bins: int):
    """Rows, goals and squared goals per open node, feature and bin."""

    def count(batches):
        size = nodes * k * bins
        n, s, q = (np.zeros((nodes, k, bins)) for _ in range(3))
        column = np.arange(k, dtype=np.int64) * bins
        for x, *others in blocks(batches, k):
            goal = goals(x, *others)
            slot = walk.add_to(np.zeros(len(x)), x).astype(np.int64)
            if (slot < 0).any():
                held = slot >= 0
                x, goal, slot = x[held], goal[held], slot[held]
            if sides:
                # Two goals are counted, not added up.
                first = slot * (2 * bins) + goal * bins
                for f in range(k):
                    both = np.bincount(first + x[:, f], minlength=2 * nodes * bins).reshape(nodes, 2, bins)
                    n[:, f] += both.sum(axis=1)
                    s[:, f] += both[:, 1]
                continue
            cell = (x + (slot * (k * bins))[:, None] + column).ravel()
            goal = np.repeat(goal, k)
            n += np.bincount(cell, minlength=size).reshape(n.shape)
            s += np.bincount(cell, goal, minlength=size).reshape(n.shape)
            q += np.bincount(cell, goal * goal, minlength=size).reshape(n.shape)
        n, s, q = n.ravel(), s.ravel(), q.ravel()
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), *(pa.array(a[seen]) for a in (n, s, q))], names=["cell", "n", "s", "q"])

    # In the order of the tasks, so that features that cut the rows alike add up to the same bits and tie.
    part = F.struct(F.spark_partition_id().alias("task"), "n", "s", "q").alias("part")
    parts = rows.mapInArrow(count, _HISTOGRAM).select("cell", part).groupBy("cell").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    table = parts.select("cell", *[F.aggregate(f"parts.{c}", F.lit(0.0), lambda a, x: a + x).alias(c) for c in ("n", "s", "q")]).toArrow()
    found = [np.zeros(nodes * k * bins) for _ in range(3)]
    for a, name in zip(found, ("n", "s", "q"), strict=True):
        a[table.column("cell").to_numpy()] = table.column(name).to_numpy()
    n, s, q = (a.reshape(nodes, k, bins) for a in found)
    if sides:
        low, high = sides
        s, q = s * high + (n - s) * low, s * high * high + (n - s) * low * low
    return [n, s, q]
