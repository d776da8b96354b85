"""Mixing sources to target weights by balanced sampling with the cube method.

A document's size is its number of words. Sources, in code point order with null last,
weigh 1, 2, 3, repeating; a source's target is its share by weight of all words, stopped at
``MOST`` times what it has, with the excess dealt to the others by weight until none is
above. Each document of a source is then taken ``floor(target / size of the source)`` times,
and once more with the fraction as its probability.

Which documents get that once more is drawn by the cube method. A flight moves the vector of
probabilities in steps: within three undecided documents the null space of the constraints
(total of words, total of documents) is one direction, and both ends of the way along it have
one more document decided at 0 or 1; which end is drawn so that every document keeps its
probability. Constraints hold exactly throughout. Flights run independently in blocks of at
most ``BLOCK`` documents of one source, hundreds of short lanes of a block in lockstep, and
leave at most ``LANDING`` documents each; those of many blocks form the blocks of the next
level. In the last level a source is one block, and its few documents left, the landing
problem, are decided by the subset that comes closest to both totals, found among all of them.

What moves: only id, source and size of a document. Rows are ordered once within their
source by a hash, so blocks are cut by position: a source with a third of all rows, or many
rows of one id, is split like any other. The number of levels follows from the number of
rows (two up to 262,144, five up to 5 x 10^11). Source totals are joined after a count.

Defined results: a null text has size 0, as has one without words; such documents are taken
0 times. Null sources are one source, the last. Null ids and repeated rows are documents of
their own; equal rows (id and size) may swap places. Reruns agree. An empty table stays
empty. A source without words has target 0. Other columns of the table are not read, but for
those named in ``others``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.layout import POS, order_rows
from ..storage import group_side, stage
from .batches import with_columns
from .words import BLANK

MOST = 3
WEIGHTS = 3
BLOCK, LANDING, LANE = 2048, 12, 64
FAN_IN = 128
SURE = 1e-9


def count_words(texts: pa.Array) -> np.ndarray:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text, on the bytes of the whole array."""
    held = pc.fill_null(texts, "").cast(pa.binary())
    ends = np.frombuffer(held.buffers()[1], np.int32)[held.offset : held.offset + len(held) + 1].astype(np.int64)
    if not len(held) or ends[0] == ends[-1]:
        return np.zeros(len(held), np.int64)
    inside = ~BLANK[np.frombuffer(held.buffers()[2], np.uint8)[ends[0] : ends[-1]]]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    # The first byte of a text follows no other byte.
    first = (ends[:-1] - ends[0])[np.diff(ends) > 0]
    begins[first] = inside[first]
    total = np.concatenate([[0], np.cumsum(begins)])
    return total[ends[1:] - ends[0]] - total[ends[:-1] - ends[0]]


def targets(sizes: DataFrame, source: str = "source", size: str = "size", most: int = MOST, weights: int = WEIGHTS) -> DataFrame:
    """Rank, size and target of each source, in words."""
    totals = sizes.groupBy(F.col(source).alias("source")).agg(F.sum(size).cast("bigint").alias("source_size"))
    ordered = order_rows(totals.withColumn("_last", F.col("source").isNull()), [], ["_last", "source"]).df
    ranked = ordered.select("source", F.col(POS).alias("rank"), "source_size", (F.col(POS) % weights + 1).alias("weight"))
    total, shared = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    level, stopped = (total / shared if shared else 0.0), -1
    # Newton's steps on a concave function of the level: each stops more sources, the last none.
    while shared:
        over = F.col("weight") * F.lit(level) >= most * F.col("source_size")
        n, held, left = ranked.agg(
            F.count(F.when(over, 1)), F.sum(F.when(over, most * F.col("source_size"))), F.sum(F.when(~over, F.col("weight")))
        ).first()
        if n == stopped or not left:
            break
        level, stopped = (total - (held or 0)) / left, n
    target = F.least(F.col("weight") * F.lit(float(level)), (most * F.col("source_size")).cast("double"))
    return ranked.withColumn("target", target)


def fly(p: np.ndarray, size: np.ndarray, rng: np.random.Generator, landing: int = LANDING) -> np.ndarray:
    """The flight: at most ``landing``, two or more, probabilities stay between 0 and 1, both totals stay."""
    p, size = p.astype(np.float64), size.astype(np.float64)
    while True:
        open_ = np.flatnonzero((p > 0) & (p < 1))
        if len(open_) <= LANE:
            break
        # Lanes leave two units each: enough of them for the landing to choose among.
        lanes = max(-(-len(open_) // LANE), landing // 2)
        steps = -(-len(open_) // lanes)
        at = np.full(lanes * steps, -1)
        at[: len(open_)] = open_
        _fly_lanes(p, size, at.reshape(steps, lanes).T, rng)
    while len(open_ := np.flatnonzero((p > 0) & (p < 1))) > max(landing, 2):
        p[open_[:3]] = _moved(p[open_[None, :3]], size[open_[None, :3]], rng)[0]
    return p


def _fly_lanes(p, size, at, rng) -> None:
    """Lanes (rows of ``at``, -1 beyond their end) fly side by side until two units each are left."""
    window, following = at[:, :3].copy(), np.full(len(at), 3)
    while True:
        while True:
            empty = (window < 0) & (following < at.shape[1])[:, None]
            lanes = np.flatnonzero(empty.any(1))
            if not len(lanes):
                break
            window[lanes, empty[lanes].argmax(1)] = at[lanes, following[lanes]]
            following[lanes] += 1
        full = np.flatnonzero((window >= 0).all(1))
        if not len(full):
            return
        units = window[full]
        moved = _moved(p[units], size[units], rng)
        p[units] = moved
        window[full] = np.where((moved > 0) & (moved < 1), units, -1)


def _moved(p: np.ndarray, size: np.ndarray, rng) -> np.ndarray:
    """One step of each row of three units, to either end of its way through the cube."""
    u = np.stack([size[:, 1] - size[:, 2], size[:, 2] - size[:, 0], size[:, 0] - size[:, 1]], axis=1)
    top = np.abs(u).max(1, keepdims=True)
    u = np.where(top > 0, u / np.maximum(top, 1), [[1.0, -1.0, 0.0]])
    with np.errstate(divide="ignore"):
        ahead = np.where(u > 0, (1 - p) / u, np.where(u < 0, p / -u, np.inf))
        back = np.where(u > 0, p / u, np.where(u < 0, (1 - p) / -u, np.inf))
    far, near = ahead.min(1), back.min(1)
    forward = rng.random(len(p)) * (far + near) < near
    out = p + np.where(forward, far, -near)[:, None] * u
    # The unit that ends the way is at its end exactly.
    stop = np.where(forward, ahead.argmin(1), back.argmin(1))
    each = np.arange(len(p))
    out[each, stop] = np.where((u[each, stop] > 0) == forward, 1.0, 0.0)
    out[out < SURE] = 0.0
    out[out > 1 - SURE] = 1.0
    return out


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The subset of the undecided units whose words, then number, come closest to what is left."""
    open_ = np.flatnonzero((p > 0) & (p < 1))
    if not len(open_):
        return p
    chosen = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_)) & 1).astype(np.float64)
    words = np.abs(chosen @ size[open_] - p[open_] @ size[open_])
    number = np.abs(chosen.sum(1) - p[open_].sum())
    out = p.copy()
    out[open_] = chosen[np.lexsort([number, words])[0]]
    return out


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", others: tuple[str, ...] = (), most: int = MOST, seed: int = 17) -> DataFrame:
    """Size, source totals, ``repeats`` and ``taken`` words of each document."""
    names = [F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("_text")]
    sized = with_columns(docs.select(*names, *others), "_text", "size bigint", lambda texts: [pa.array(count_words(texts))])
    sizes = stage(sized.drop("_text").withColumn("_n", F.monotonically_increasing_id()), "sizes")
    sources = group_side(targets(sizes, most=most).drop("weight").withColumnRenamed("source", "_source"), "sources")
    rows = sizes.join(sources, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("_ratio", ratio).withColumn("repeats", F.floor("_ratio").cast("bigint"))
    rows = rows.withColumn("_p", F.col("_ratio") - F.col("repeats")).drop("_ratio")
    rows = rows.withColumn("_p", F.expr(f"CASE WHEN _p < {SURE} THEN 0D WHEN _p > 1 - {SURE} THEN 1D ELSE _p END"))
    rows = rows.withColumn("_key", F.xxhash64(F.lit(seed), "doc_id", "size"))
    ordered = order_rows(rows, ["rank"], ["_key", "doc_id", "size", "_n"])
    left, decided, span, level = ordered.df.drop("_key", "_n"), [], BLOCK, 0
    schema = left.schema
    undecided = (F.col("_p") > 0) & (F.col("_p") < 1)
    while True:
        decided.append(left.where(~undecided))
        last = span >= ordered.total
        run = _flight(schema, seed, level, last)
        groups = left.where(undecided).withColumn("_block", F.expr(f"{POS} div {span}")).groupBy("rank", "_block")
        left = stage(groups.applyInArrow(run, schema), "flight")
        if last:
            break
        span, level = span * FAN_IN, level + 1
    rows = left
    for part in decided:
        rows = rows.unionByName(part)
    repeats = F.col("repeats") + F.col("_p").cast("bigint")
    taken = (repeats * F.col("size")).alias("taken")
    return rows.select("doc_id", "source", *others, "size", "source_size", "target", repeats.alias("repeats"), taken)


def _flight(schema, seed: int, level: int, last: bool):
    names = schema.names

    def run(key, block):
        block = block.sort_by(POS)
        p, size = (block.column(c).to_numpy() for c in ("_p", "size"))
        # The generator's seed is the block's place, so reruns draw the same.
        p = fly(p, size, np.random.default_rng([seed, level, *(int(k.as_py()) for k in key)]))
        if last:
            p = land(p, size.astype(np.float64))
        return block.set_column(block.column_names.index("_p"), "_p", pa.array(p)).select(names)

    return run
