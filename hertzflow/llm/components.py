"""Connected components of links, by alternating large and small stars.

Each round makes every node point at a smaller neighbour of its neighbourhood, so the
links shrink towards stars around the smallest node of each component. Partitions are
first reduced to spanning stars on their own. Minima are pre-aggregated before the
shuffle, and the joins on a node with very many links can be split by AQE. Every round
is a written table; no link or component passes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stage
from .batches import tidy

BATCH_LINKS = 1_000_000


class Forest:
    """Union-find whose roots are the smallest members."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != top:
            parent[x] = top
            x = up
        return top

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def stars(self) -> pd.DataFrame:
        nodes = list(self.parent)
        return pd.DataFrame({"a": nodes, "b": [self.root(x) for x in nodes]}, dtype="int64")


def spanning_stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The links (a, b) of a partition as stars with the same components."""
    forest = Forest()
    for pdf in batches:
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
            forest.join(a, b)
        if len(forest.parent) > BATCH_LINKS:
            yield forest.stars()
            forest = Forest()
    yield forest.stars()


def _large(links: DataFrame) -> DataFrame:
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    joined = links.join(least, "a")
    out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(joined.select("a", "m"))
    return out.where(F.col("a") != F.col("b")).distinct()


def links_of(frame: DataFrame, rows: Callable) -> DataFrame:
    """The links that ``rows`` finds in batches of ``frame``, as stars of each task, in one pass."""
    return frame.mapInPandas(tidy(lambda batches: spanning_stars(rows(batches))), "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in the links (a, b); a component is named by its smallest node."""
    current = stage(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b"), "links")
    before = None
    while True:
        state = current.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if state == before or state[0] == 0:
            break
        before = state
        current = stage(_small(_large(current).where("a <> b").distinct()), "links")
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        current.select("b", "b").distinct()
    )
