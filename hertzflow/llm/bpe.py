"""Byte-level BPE encoding and decoding.

A text is cut by the vocabulary's pattern; each distinct piece of a batch is encoded
once. Pieces of similar length form a padded numpy matrix in which every row merges
its leftmost pair of minimum rank per round: ranks come from a hashed pair table,
only the two pairs beside a merge are looked up again, and each round compacts the
matrix by one column and drops finished rows.

Rows are independent, so there is no shuffle, and the vocabulary (a fixed file, sent as
one block of bytes, once per session) is the only broadcast. One pass encodes and decodes;
it works on about a megabyte of text at a time. Null and empty texts have no tokens. Texts
are never cut: a long one is encoded in runs of pieces, and a piece beyond ``LONG_PIECE``
bytes is merged with a heap, which needs no matrix. Rows that repeat an id are encoded
each; ids of any kind and null pass through. New columns replace ones of their names.
"""

from __future__ import annotations

import base64
import heapq
import itertools
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import with_columns

NONE = np.int64(1 << 40)
LONG_PIECE = 512
RUN_PIECES = 100_000
MATRIX_CELLS = 1 << 17
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Vocabulary:
    """Ranks of a byte-level BPE, and the pattern that cuts texts into pieces."""

    tokens: tuple[bytes, ...]
    pattern: str

    @classmethod
    def read(cls, path: str, pattern: str) -> Vocabulary:
        """A rank file: a base64 token and its rank per line. Read on the driver; its size is fixed."""
        with open(path, "rb") as lines:
            ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
        return cls(tuple(ranks[i] for i in range(len(ranks))), pattern)

    def packed(self) -> dict:
        """Plain values that a worker without this package can read."""
        size = np.fromiter(map(len, self.tokens), np.int32, len(self.tokens))
        return {"bytes": b"".join(self.tokens), "size": size.tobytes(), "pattern": self.pattern}

    def shared(self, spark: SparkSession):
        """The broadcast of ``packed``, made once per application."""
        context = spark.sparkContext
        held = _SHARED.get(self)
        if held is None or held[0] != context.applicationId:
            _SHARED[self] = held = (context.applicationId, context.broadcast(self.packed()))
        return held[1]

    @cached_property
    def ends(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(np.fromiter(map(len, self.tokens), np.int64, len(self.tokens)))])

    @cached_property
    def joined(self) -> np.ndarray:
        return np.frombuffer(b"".join(self.tokens), np.uint8)

    @cached_property
    def ranks(self) -> dict[bytes, int]:
        return {token: i for i, token in enumerate(self.tokens)}

    @cached_property
    def byte_ids(self) -> np.ndarray:
        return np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)

    @cached_property
    def split(self):
        return regex.compile(self.pattern)

    @cached_property
    def pair_table(self) -> tuple[np.ndarray, np.ndarray, int]:
        """Open-addressed table of every pair of tokens that is a token itself."""
        ranks = self.ranks
        keys, merged = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    merged.append(rank)
        bits = max(4, int(len(keys) * 3).bit_length())
        table, values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE)
        keys, merged = np.array(keys, np.int64), np.array(merged, np.int64)
        slot = _slots(keys, bits)
        while len(keys):
            free = table[slot] < 0
            first = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)[1]
            first = first[free[first]]
            table[slot[first]], values[slot[first]] = keys[first], merged[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, merged, slot = keys[rest], merged[rest], (slot[rest] + 1) & ((1 << bits) - 1)
        return table, values, bits

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merged pair, NONE where there is none or either side is padding (-1)."""
        table, values, bits = self.pair_table
        out = np.full(left.shape, NONE)
        at = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        key = left.ravel()[at] << 32 | right.ravel()[at]
        slot, flat = _slots(key, bits), out.ravel()
        while len(at):
            there = table[slot]
            hit = there == key
            flat[at[hit]] = values[slot[hit]]
            on = ~hit & (there >= 0)
            at, key, slot = at[on], key[on], (slot[on] + 1) & ((1 << bits) - 1)
        return flat.reshape(left.shape)


#: Vocabularies by their broadcast, on the driver.
_SHARED: dict[Vocabulary, tuple] = {}


def unpacked(held: dict) -> Vocabulary:
    """The vocabulary of a broadcast, built once and kept with the broadcast's value."""
    if "built" not in held:
        ends = np.cumsum(np.frombuffer(held["size"], np.int32)).tolist()
        raw = held["bytes"]
        held["built"] = Vocabulary(tuple(raw[a:b] for a, b in zip([0, *ends], ends, strict=False)), held["pattern"])
    return held["built"]


def _slots(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys.astype(np.uint64) * _MIX) >> np.uint64(64 - bits)).astype(np.int64)


def _merge_matrix(vocabulary: Vocabulary, pieces: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces one after the other, and how many each has."""
    raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    ids = np.where(np.arange(width) < size[:, None], vocabulary.byte_ids[raw], -1)
    rank = vocabulary.pair_ranks(ids[:, :-1], ids[:, 1:])
    out, rows = np.full(ids.shape, -1, np.int64), np.arange(len(ids))
    while True:
        at = rank.argmin(1) if rank.shape[1] else np.zeros(len(rows), np.int64)
        best = rank[np.arange(len(rows)), at] if rank.shape[1] else np.full(len(rows), NONE)
        live = best < NONE
        out[rows[~live], : ids.shape[1]] = ids[~live]
        if not live.any():
            break
        ids, rank, rows, at, best = ids[live], rank[live], rows[live], at[live], best[live]
        each = np.arange(len(rows))
        ids[each, at] = best
        keep = np.ones(ids.shape, bool)
        keep[each, at + 1] = False
        ids = ids[keep].reshape(len(rows), -1)
        keep = np.ones(rank.shape, bool)
        keep[each, at] = False
        rank = rank[keep].reshape(len(rows), -1)
        for shift in (-1, 0):
            j = at + shift
            ok = (j >= 0) & (j < rank.shape[1])
            rank[each[ok], j[ok]] = vocabulary.pair_ranks(ids[each[ok], j[ok]], ids[each[ok], j[ok] + 1])
    return out[out >= 0], (out >= 0).sum(1)


def _merge_long(vocabulary: Vocabulary, piece: bytes) -> list[int]:
    """The same merges for one long piece, with a heap over a linked list."""
    ids = vocabulary.byte_ids[np.frombuffer(piece, np.uint8)]
    first = vocabulary.pair_ranks(ids[:-1], ids[1:])
    ids, n = ids.tolist(), len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(int(first[i]), i, ids[i], ids[i + 1]) for i in np.flatnonzero(first < NONE)]
    heapq.heapify(heap)
    tokens, ranks = vocabulary.tokens, vocabulary.ranks
    while heap:
        rank, i, left, right = heapq.heappop(heap)
        j = after[i]
        if ids[i] != left or j >= n or ids[j] != right:
            continue
        ids[i], ids[j], after[i] = rank, -1, after[j]
        if after[i] < n:
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < n and (new := ranks.get(tokens[ids[a]] + tokens[ids[b]])) is not None:
                heapq.heappush(heap, (new, a, ids[a], ids[b]))
    return [i for i in ids if i >= 0]


def encode_pieces(vocabulary: Vocabulary, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the distinct pieces one after the other, and where each begins (one more entry than pieces)."""
    raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
    found: dict[int, np.ndarray] = {}
    size = np.ones(len(raw), np.int64)
    whole = np.fromiter((vocabulary.ranks.get(p, -1) for p in raw), np.int64, len(raw))
    rest = np.flatnonzero(whole < 0)
    lengths = np.fromiter((len(raw[i]) for i in rest), np.int64, len(rest))
    for i in rest[lengths > LONG_PIECE]:
        found[i] = np.array(_merge_long(vocabulary, raw[i]), np.int64)
        size[i] = len(found[i])
    buckets = np.where(lengths <= 16, lengths, 1 << np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64))
    runs = []
    for width in np.unique(buckets[lengths <= LONG_PIECE]).tolist():
        chosen = rest[(buckets == width) & (lengths <= LONG_PIECE)]
        step = max(1, MATRIX_CELLS // width)
        for lo in range(0, len(chosen), step):
            part = chosen[lo : lo + step]
            ids, count = _merge_matrix(vocabulary, [raw[i] for i in part], width)
            size[part] = count
            runs.append((part, ids, count))
    start = np.concatenate([[0], np.cumsum(size)])
    flat = np.empty(start[-1], np.int64)
    done = np.flatnonzero(whole >= 0)
    flat[start[done]] = whole[done]
    for part, ids, count in runs:
        inner = np.arange(len(ids)) - np.repeat(np.cumsum(count) - count, count)
        flat[np.repeat(start[part], count) + inner] = ids
    for i, ids in found.items():
        flat[start[i] : start[i + 1]] = ids
    return flat, start


def encode_texts(vocabulary: Vocabulary, texts) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit integers."""
    out: list[list[bytes]] = []
    words: list[str] = []
    runs: list[tuple[int, int]] = []

    def flush():
        if not words:
            return
        codes, distinct = pd.factorize(np.array(words, dtype=object))
        flat, start = encode_pieces(vocabulary, distinct.tolist())
        first, count = start[codes], np.diff(start)[codes]
        ends = np.cumsum(count)
        ids = flat[np.arange(ends[-1]) + np.repeat(first - ends + count, count)].astype("<u4")
        pos = word = 0
        for row, n in runs:
            word += n
            out[row].append(ids[pos : ends[word - 1]].tobytes())
            pos = ends[word - 1]
        words.clear()
        runs.clear()

    for row, text in enumerate(texts):
        out.append([])
        if not text:
            continue
        if len(text) <= RUN_PIECES:
            found = vocabulary.split.findall(text)
            words.extend(found)
            runs.append((row, len(found)))
        else:
            pieces = (m.group() for m in vocabulary.split.finditer(text))
            while part := list(itertools.islice(pieces, RUN_PIECES)):
                words.extend(part)
                runs.append((row, len(part)))
                flush()
        if len(words) >= RUN_PIECES:
            flush()
    flush()
    return [b"".join(parts) for parts in out]


def decode_ids(vocabulary: Vocabulary, ids: bytes) -> bytes:
    """The bytes of all ids, gathered at once; runs bound the index arrays."""
    ids, ends, out = np.frombuffer(ids, "<u4"), vocabulary.ends, []
    for lo in range(0, len(ids), RUN_PIECES):
        part = ids[lo : lo + RUN_PIECES].astype(np.int64)
        size = ends[part + 1] - ends[part]
        last = np.cumsum(size)
        out.append(vocabulary.joined[np.arange(last[-1]) + np.repeat(ends[part] - last + size, size)].tobytes())
    return b"".join(out)


def encode(df: DataFrame, vocabulary: Vocabulary, text: str = "text", out: str = "token_ids", decoded: str | None = None) -> DataFrame:
    """Add the ids of ``text`` as binary: little-endian unsigned 32-bit integers.

    With ``decoded``, the bytes that these ids stand for are added in the same pass.
    """
    shared = vocabulary.shared(df.sparkSession)

    def ids(texts):
        words = unpacked(shared.value)
        found = encode_texts(words, texts.to_pylist())
        back = [] if decoded is None else [pa.array([decode_ids(words, x) for x in found], pa.binary())]
        return [pa.array(found, pa.binary()), *back]

    return with_columns(df, text, f"`{out}` binary" + (f", `{decoded}` binary" if decoded else ""), ids)


def decode(df: DataFrame, vocabulary: Vocabulary, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Add the bytes that the ids stand for. Null ids give no bytes."""
    shared = vocabulary.shared(df.sparkSession)

    def joined(column):
        words = unpacked(shared.value)
        return [pa.array([decode_ids(words, x or b"") for x in column.to_pylist()], pa.binary())]

    return with_columns(df, ids, f"`{out}` binary", joined)


def token_count(ids: str = "token_ids") -> Column:
    return (F.octet_length(F.col(ids)) / 4).cast("bigint")
