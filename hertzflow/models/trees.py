"""Decision trees compiled to flat arrays, walked for many rows at once."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = re.compile(r"If \(feature (\d+) <= (.+)\)$")


@dataclass(frozen=True)
class FlatTrees:
    """Nodes of all trees one after the other: ``feature`` (-1 at a leaf), ``threshold``, ``left``,
    ``right`` and the ``value`` a leaf adds; ``roots`` and ``depths`` of the trees."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depths: np.ndarray

    def add_to(self, start: np.ndarray, x: np.ndarray) -> np.ndarray:
        """``start`` plus what each row's leaves add, tree by tree; ``x`` has a row per row."""
        total, each = start.astype(float), np.arange(len(x))
        for root, depth in zip(self.roots.tolist(), self.depths.tolist(), strict=True):
            node = np.full(len(x), root)
            for _ in range(depth):
                # A leaf points at itself on both sides.
                goes_left = x[each, np.maximum(self.feature[node], 0)] <= self.threshold[node]
                node = np.where(goes_left, self.left[node], self.right[node])
            total = total + self.value[node]
        return total


def compiled(trees: Sequence, leaf_values: Sequence[Sequence[float]], rates: Sequence[float]) -> FlatTrees:
    """The trees of a model on continuous features (``GrownTree`` or Spark ML's), with their leaves' values times the rates.

    Leaves are numbered from left to right, as trees name them in their leaf column.
    """
    feature, threshold, left, right, value, roots, depths = [], [], [], [], [], [], []

    def node(split=None, adds=0.0) -> int:
        at = len(feature)
        feature.append(split[0] if split else -1)
        threshold.append(split[1] if split else 0.0)
        left.append(at)
        right.append(at)
        value.append(adds)
        return at

    for tree, values, rate in zip(trees, leaf_values, rates, strict=True):
        roots.append(len(feature))
        depths.append(tree.depth)
        if not hasattr(tree, "toDebugString"):
            flat = tree.flat([rate * v for v in values])
            left += (flat.left + len(feature)).tolist()
            right += (flat.right + len(feature)).tolist()
            feature += flat.feature.tolist()
            threshold += flat.threshold.tolist()
            value += flat.value.tolist()
            continue
        open_, leaf, waits = [], 0, False
        for line in tree.toDebugString.splitlines()[1:]:
            text = line.strip()
            if not text:
                continue
            if text.startswith("Else"):
                waits = True
                continue
            split = _SPLIT.match(text)
            if split:
                at = node((int(split[1]), float(split[2])))
            else:
                # Values are listed up to the last leaf that any row reached.
                at, leaf = node(adds=rate * values[leaf] if leaf < len(values) else 0.0), leaf + 1
            if open_:
                side = right if waits else left
                side[open_[-1]] = at
                if waits:
                    open_.pop()
            waits = False
            if split:
                open_.append(at)
    arrays = (np.array(a, kind) for a, kind in ((feature, np.int64), (threshold, float), (left, np.int64), (right, np.int64), (value, float)))
    return FlatTrees(*arrays, np.array(roots, np.int64), np.array(depths, np.int64))


def predicted(flat: FlatTrees, base: float, features: Sequence[str]) -> Column:
    """``base`` plus the trees, as one expression whatever their number."""

    @F.pandas_udf("double")
    def walk(*columns: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(dtype=float, na_value=np.nan) for c in columns])
        return pd.Series(flat.add_to(np.full(len(x), base), x))

    return walk(*[F.col(f).cast("double") for f in features])
