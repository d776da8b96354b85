"""Embedding near-duplicates by cross-polytope hashing.

A vector is rotated by three rounds of random signs and a fast Hadamard transform; its
hash is the axis it lies nearest to, with sign. A bucket of a table joins ``hashes`` such
axes, and a vector enters its ``PROBES`` best buckets of every table, so near vectors meet
although their nearest axes differ. Every pair that meets is verified by its cosine in
double precision; a pair that meets several times counts in its first bucket only, which
each row can tell from the bucket codes it carries.

Equal vectors are merged ahead of everything and count by their number; a merged vector has
a number of its own, so ids may repeat, be null or have 64 bits. The number of hashes
follows the number of vectors of a label and length, so buckets of unrelated vectors stay
small and no label changes what is found in another.
Buckets are measured: those with one vector leave, those beyond ``BLOCK_ROWS`` are dealt
into blocks and compared block by block, so no task holds more than two blocks. Tasks
return sums of links per vector and a spanning forest of the links, never pairs.

Only vectors of one label and one length are compared; a null label links with nothing,
nor does a vector that is null, empty, zero, or holds a null or non-finite component. Tiny
and huge vectors are scaled by a power of two first. Rows that repeat a vec_id are counted
each, and a null one is kept: it has the least id of its component, null if it is alone.
Only id, vector and label are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import group_side, stage
from .batches import tidy
from .components import components

THRESHOLD = 0.93
PROBES = 4
# Tables by number of hashes of a bucket; measured recall at the threshold is above 0.99
# for 64 and 100 components.
TABLES = {1: 3, 2: 5, 3: 8, 4: 12}
BUCKET_LOAD = 16
BLOCK_ROWS = 2048
SMALL = 48
SEED = 97


def hadamard(x: np.ndarray) -> np.ndarray:
    """Transform of the rows; their length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        pair = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def codes(unit: np.ndarray, tables: int, hashes: int, probes: int = PROBES) -> np.ndarray:
    """Bucket codes (vector, table, probe) of unit vectors."""
    n, dim = unit.shape
    d = max(2, 1 << (dim - 1).bit_length())
    padded = np.zeros((n, d))
    padded[:, :dim] = unit
    rng = np.random.default_rng(SEED)
    near = min(probes, 2 * d)
    out = np.empty((n, tables, probes), np.int32)
    for t in range(tables):
        code, loss = np.zeros((n, 1), np.int64), np.zeros((n, 1))
        for _ in range(hashes):
            y = padded
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], d))
            both = np.concatenate([y, -y], axis=1)
            best = np.argpartition(-both, near - 1, axis=1)[:, :near]
            value = np.take_along_axis(both, best, axis=1)
            # How much further the bucket's axis is than the nearest one.
            lost = (value.max(1, keepdims=True) - value) ** 2
            code = (code[:, :, None] * (2 * d) + best[:, None, :]).reshape(n, -1)
            loss = (loss[:, :, None] + lost[:, None, :]).reshape(n, -1)
            keep = np.argsort(loss, axis=1, kind="stable")[:, :probes]
            code, loss = np.take_along_axis(code, keep, axis=1), np.take_along_axis(loss, keep, axis=1)
        out[:, t] = np.sort(np.pad(code, ((0, 0), (0, probes - code.shape[1])), mode="edge"), axis=1)
    return out


def _unit(vectors: list[bytes]) -> np.ndarray:
    x = np.stack([np.frombuffer(v, np.float64) for v in vectors])
    # Exact, and keeps squares of tiny and huge components within range.
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _signed(tables: dict[int, int]):
    def rows(batches):
        for pdf in batches:
            sizes = pdf["vector"].map(len).to_numpy()
            raw = [np.asarray(v, np.float64) for v in pdf["vector"]]
            pdf = pdf.assign(vector=[v.tobytes() for v in raw])
            for size, hashes in sorted(set(zip(sizes.tolist(), pdf["hashes"].tolist(), strict=True))):
                part = pdf[(sizes == size) & (pdf["hashes"] == hashes).to_numpy()]
                got = codes(_unit(part["vector"].tolist()), tables[hashes], hashes)
                distinct = [[(t, int(c)) for t in range(tables[hashes]) for c in np.unique(row[t])] for row in got]
                buckets = [[t << 32 | c for t, c in row] for row in distinct]
                yield part.assign(codes=[g.tobytes() for g in got], buckets=buckets, dim=int(size))[
                    ["vec_id", "label", "weight", "dim", "vector", "codes", "buckets"]
                ]

    return rows


def _first_meeting(mine: np.ndarray, other: np.ndarray, table: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Whether (table, code) is the first bucket in which each pair meets."""
    same = mine[:, :, :, None] == other[:, :, None, :]
    met = same.any((2, 3))
    first = met.argmax(1)
    each = np.arange(len(mine))
    least = np.where(same[each, first].any(2), mine[each, first], np.int32(2**31 - 1)).min(1)
    return (first == table) & (least == code)


def _pairs_of_small(group: np.ndarray, unit: np.ndarray, threshold: float):
    """Linked pairs within runs of equal ``group``."""
    left, right, k = [], [], 1
    while True:
        a = np.flatnonzero(group[k:] == group[:-k]) if k < len(group) else np.empty(0, np.int64)
        if not len(a):
            break
        hit = a[np.einsum("ij,ij->i", unit[a], unit[a + k]) >= threshold]
        left.append(hit)
        right.append(hit + k)
        k += 1
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, np.int64),) * 2


def _stars(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest member that each of ``n`` rows reaches by the pairs."""
    top = np.arange(n)
    while True:
        new = top.copy()
        np.minimum.at(new, a, top[b])
        np.minimum.at(new, b, top[a])
        new = new[new]
        if (new == top).all():
            return top
        top = new


def _linked(threshold: float):
    def sums(pdf, a, b):
        """Links that count here and the forest of all links found."""
        ids, weight = pdf["vec_id"].to_numpy(), pdf["weight"].to_numpy()
        code = np.stack([np.frombuffer(c, np.int32) for c in pdf["codes"]]).reshape(len(pdf), -1, PROBES)
        bucket = pdf["bucket"].to_numpy()
        links = np.zeros(len(pdf), np.int64)
        for lo in range(0, len(a), 50_000):
            x, y = a[lo : lo + 50_000], b[lo : lo + 50_000]
            first = _first_meeting(code[x], code[y], bucket[x] >> 32, bucket[x] & 0xFFFFFFFF)
            np.add.at(links, x[first], weight[y[first]])
            np.add.at(links, y[first], weight[x[first]])
        top = _stars(a, b, len(pdf))
        some, tied = np.flatnonzero(links), np.flatnonzero(top != np.arange(len(pdf)))
        found = pd.DataFrame({"vec_id": ids[some], "links": links[some], "other": pd.array([None] * len(some), "Int64")})
        forest = pd.DataFrame({"vec_id": ids[tied], "links": 0, "other": pd.array(ids[top[tied]], "Int64")})
        return pd.concat([found, forest])

    def rows(batches):
        keys = ["label", "dim", "bucket", "i", "j"]
        held = None

        def work(pdf):
            pdf = pdf.reset_index(drop=True)
            change = np.ones(len(pdf), bool)
            change[1:] = (pdf[keys].to_numpy()[1:] != pdf[keys].to_numpy()[:-1]).any(1)
            group = np.cumsum(change)
            size = np.bincount(group)[group]
            within = (pdf["i"] == pdf["j"]).to_numpy()
            small = np.flatnonzero((size <= SMALL) & within & (size > 1))
            # Vectors of one length whose labels have equal numbers of tables.
            kind = pdf["dim"].to_numpy()[small].astype(np.int64) << 32 | pdf["codes"].iloc[small].map(len).to_numpy(np.int64)
            for one in np.unique(kind):
                part = small[kind == one]
                unit = _unit(pdf["vector"].iloc[part].tolist())
                a, b = _pairs_of_small(group[part], unit, threshold)
                used, place = np.unique(np.concatenate([a, b]), return_inverse=True)
                if len(a):
                    yield sums(pdf.iloc[part[used]].reset_index(drop=True), place[: len(a)], place[len(a) :])
            large = np.flatnonzero(((size > SMALL) | ~within) & (size > 1))
            for g in np.unique(group[large]):
                part = pdf.iloc[np.flatnonzero(group == g)].reset_index(drop=True)
                unit = _unit(part["vector"].tolist())
                left = np.flatnonzero((part["block"] == part["i"]).to_numpy())
                right = left if within[np.flatnonzero(group == g)[0]] else np.flatnonzero((part["block"] == part["j"]).to_numpy())
                if not len(left) or not len(right):
                    continue
                hit = unit[left] @ unit[right].T >= threshold
                if right is left:
                    hit = np.triu(hit, 1)
                x, y = np.nonzero(hit)
                if len(x):
                    yield sums(part, left[x], right[y])

        for pdf in batches:
            if not len(pdf):
                continue
            pdf = pd.concat([held, pdf], ignore_index=True) if held is not None else pdf
            last = (pdf[keys].to_numpy() == pdf[keys].to_numpy()[-1]).all(1)
            held = pdf[last]
            if not last.all():
                yield from work(pdf[~last])
        if held is not None:
            yield from work(held)

    return rows


def _chosen_hashes(n: Column, dim: Column) -> Column:
    """As few hashes of a bucket as keep its load down, by the number of vectors of a label and length."""
    axes = F.lit(2.0) * F.greatest(F.lit(2.0), F.pow(F.lit(2.0), F.ceil(F.log2(dim))))
    total, more = F.lit(1), F.lit(True)
    for hashes in range(1, max(TABLES)):
        more = more & (F.pow(axes, F.lit(hashes + 1)) < 1 << 31) & (n * PROBES > BUCKET_LOAD * F.pow(axes, F.lit(hashes)))
        total = total + more.cast("int")
    return total


def near_duplicates(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    threshold: float = THRESHOLD,
    hashes: int | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Per row: vec_id, n_links, component_id and kept (whether it stands for its component)."""
    rows = vectors.select(
        F.col(vec_id).cast("bigint").alias("vec_id"),
        F.col(vector).cast("array<double>").alias("vector"),
        F.col(label).cast("string").alias("label"),
    )
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = F.forall("vector", sound) & F.exists("vector", lambda x: x != 0) & F.col("label").isNotNull()
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    groups = rows.where("usable").groupBy("label", "vector").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"))
    # Numbers are given once, in the write.
    groups = stage(groups.withColumn("vec_id", F.monotonically_increasing_id()), "distinct-vectors")
    groups = groups.withColumn("dim", F.size("vector"))
    sizes = groups.groupBy("label", "dim").agg(F.count("*").alias("n"))
    chosen = _chosen_hashes(F.col("n"), F.col("dim")) if hashes is None else F.lit(hashes)
    sized = groups.join(group_side(sizes.select("label", "dim", chosen.alias("hashes")), "label-hashes"), ["label", "dim"])
    signed = sized.select("vec_id", "label", "weight", "vector", "hashes").mapInPandas(
        tidy(_signed(TABLES)),
        "vec_id bigint, label string, weight bigint, dim int, vector binary, codes binary, buckets array<bigint>",
    )
    signed = stage(signed, "bucket-codes")
    entries = signed.withColumn("bucket", F.explode("buckets")).drop("buckets")
    key = ["label", "dim", "bucket"]
    sizes = entries.groupBy(*key).agg(F.ceil(F.count("*") / block_rows).alias("blocks"), F.count("*").alias("n"))
    placed = entries.join(sizes.where("n > 1").drop("n"), key)
    placed = placed.withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other", "blocks")
    met = placed.repartition(*key, "i", "j").sortWithinPartitions(*key, "i", "j", "vec_id")
    found = stage(met.mapInPandas(tidy(_linked(threshold)), "vec_id bigint, links bigint, other bigint"), "vector-links")
    links = found.where("other IS NULL").groupBy("vec_id").agg(F.sum("links").alias("links"))
    classes = components(found.where("other IS NOT NULL").select(F.col("vec_id").alias("a"), F.col("other").alias("b")))

    known = groups.join(links, "vec_id", "left").join(classes.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    known = known.select(
        "label",
        "vector",
        "least",
        (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("component", "vec_id").alias("component"),
    )
    named = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(named, "component").drop("component", "least")
    whole = rows.join(known, ["label", "vector"], "left")
    component = F.when(F.col("usable"), F.col("component_id")).otherwise(F.col("vec_id"))
    return whole.select(
        "vec_id",
        F.when(F.col("usable"), F.col("n_links")).otherwise(0).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
