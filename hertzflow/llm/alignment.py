"""Alignment of two tokenizers' tokens over the same bytes.

Texts are encoded by tokenizer A (a ``tokenizers`` file) as space + text and by tokenizer B (a
``sentencepiece`` model, which adds that space itself). Byte offsets where a token of each
ends cut both sequences into groups; the two tokens that end there are linked. How often two
ids are linked in the whole corpus gives each link a count, and tells which of the A ids
linked with a B id is its best.

**Fragments.** The tokens that end in a byte range form a fragment: an open prefix (the tail
of a group that began earlier, up to the first common end), closed groups, and an open suffix
(tokens of a group that ends later). Fragments compose associatively: where both sides have a
common end, suffix and next prefix close into one group; where one has none, its tokens join
the other's open end. A document up to ``CHUNK`` bytes is one range and is done where it lies.
A longer one is cut into ranges of ``CHUNK`` characters, wherever they end; each range is
encoded by another task, with the text on both sides up to the next place where neither
tokenizer can merge across (a single blank between two non-blanks), and ranges are composed
in a tree of ``FAN_IN`` over Spark tasks. Only open ends go up the tree: closed groups stay
rows of their own, and one ordered pass hashes them, piece by piece.

**Counts.** Two tokens that end together have bytes of which one's are the end of the
other's, so the vocabularies alone bound the number of id pairs (``pair_bound``: 324,302 for
the two public files, whatever the corpus). Tasks count their links before they are summed;
the summed pairs, a table of that proven size, are broadcast.

What moves: chunks and open ends of long documents, pair counts per task. Links are written
once, four bytes each. Segments between such blanks are encoded once per task while they are
held (``POOL`` of them).

Defined results: texts that are null or empty, or whose joined token bytes differ from space
+ text under either tokenizer, have no tokens; all their numbers are 0 and the digest is ''.
Special tokens' strings are plain text. Rows are told apart by their place, so null, repeated
and 64-bit ids stay as they are. A text whose place without a safe blank is longer than
``CONTEXT`` is cut at its end instead. Only the named columns of the table are read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..storage import stage
from .batches import byte_slices, release, with_columns

CHUNK = 1 << 16
CONTEXT = 1 << 13
FAN_IN = 16
POOL = 300_000
BLOCK = 4000
LINK_BYTES = 4 << 20
CUT = re.compile(r"(?<=\S) (?=\S)")
BLANK_PIECE = "▁"


@dataclass(frozen=True)
class Tokenizers:
    """Two tokenizer files, as they are sent to tasks."""

    first: str
    second: bytes

    @classmethod
    def read(cls, first: str, second: str) -> Tokenizers:
        with open(first, encoding="utf-8") as a, open(second, "rb") as b:
            return cls(a.read(), b.read())


def byte_characters() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes as: printable ones are themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def vocabularies(a: tokenizers.Tokenizer, b: sentencepiece.SentencePieceProcessor) -> tuple[list[bytes], list[bytes]]:
    """The bytes of each id."""
    table = byte_characters()
    first = [b"".join(bytes([table[c]]) if c in table else c.encode() for c in a.id_to_token(i) or "") for i in range(a.get_vocab_size())]
    second = []
    for i in range(b.get_piece_size()):
        piece = b.id_to_piece(i)
        second.append(bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace(BLANK_PIECE, " ").encode())
    return first, second


def pair_bound(first: list[bytes], second: list[bytes]) -> int:
    """How many id pairs can end together at all: one's bytes are the end of the other's."""
    in_first, in_second = Counter(first), Counter(second)
    bound = sum(in_second[x[k:]] for x in first for k in range(len(x)))
    return bound + sum(in_first[x[k:]] for x in second for k in range(1, len(x)))


@dataclass(frozen=True)
class Tokens:
    """Ids of both sides, their ends, and where both end: indices into either side."""

    a: np.ndarray
    b: np.ndarray
    a_end: np.ndarray
    b_end: np.ndarray
    a_cut: np.ndarray
    b_cut: np.ndarray


class Aligner:
    """The tokenizers of a task, with the segments they have encoded."""

    def __init__(self, files: dict):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = tokenizers.Tokenizer.from_str(files["first"])
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=files["second"])
        self.a_bytes, self.b_bytes = vocabularies(self.a, self.b)
        self.a_size = np.fromiter(map(len, self.a_bytes), np.int64, len(self.a_bytes))
        self.b_size = np.fromiter(map(len, self.b_bytes), np.int64, len(self.b_bytes))
        # What each id is written as inside a group and at the end of its side of a group.
        self.words = [f"{i}{end}" for i in range(len(self.a_bytes)) for end in ",|"]
        self.b_words = len(self.words)
        self.words += [f"{i}{end}" for i in range(len(self.b_bytes)) for end in ",;"]
        self.code = np.uint32 if len(self.a_bytes) * len(self.b_bytes) < 1 << 32 else np.uint64
        self._clear()

    def _clear(self):
        self.place: dict[str, int] = {}
        self.good = np.empty(0, bool)
        self.ids = [np.empty(0, np.int32), np.empty(0, np.int32)]
        self.start = [np.zeros(1, np.int64), np.zeros(1, np.int64)]

    def _learn(self, segments: list[str]) -> None:
        """Encode segments that are not held yet.

        Neither tokenizer merges across a blank between two non-blanks, so segments without
        blanks at their ends are encoded joined, in blocks; a block whose bytes do not come
        back, and all other segments, are encoded one by one.
        """
        edged = [s[0].isspace() or s[-1].isspace() for s in segments]
        plain = [s for s, x in zip(segments, edged, strict=True) if not x]
        blocks = [plain[lo : lo + BLOCK] for lo in range(0, len(plain), BLOCK)]
        alone = [s for s, x in zip(segments, edged, strict=True) if x]
        for block, first, second in zip(blocks, *self._both([" ".join(x) for x in blocks]), strict=True):
            ends = np.cumsum(np.fromiter((len(s.encode()) + 1 for s in block), np.int64, len(block)))
            if self._comes_back(" ".join(block), first, second):
                self._keep(block, np.ones(len(block), bool), *((ids, np.searchsorted(np.cumsum(size[ids]), ends) + 1) for ids, size in ((first, self.a_size), (second, self.b_size))))
            else:
                alone += block
        if alone:
            both = self._both(alone)
            good = np.fromiter(map(self._comes_back, alone, *both), bool, len(alone))
            self._keep(alone, good, *((np.concatenate(x), np.cumsum(np.fromiter(map(len, x), np.int64, len(x)))) for x in both))

    def _both(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        first = self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        second = self.b.encode(texts, num_threads=1)
        return [np.array(x.ids, np.int32) for x in first], [np.array(x, np.int32) for x in second]

    def _comes_back(self, text: str, first: np.ndarray, second: np.ndarray) -> bool:
        raw = b" " + text.encode()
        return all(b"".join(map(v.__getitem__, x.tolist())) == raw for v, x in ((self.a_bytes, first), (self.b_bytes, second)))

    def _keep(self, segments: list[str], good: np.ndarray, *sides: tuple[np.ndarray, np.ndarray]) -> None:
        n = len(self.place)
        self.place.update(zip(segments, range(n, n + len(segments)), strict=True))
        self.good = np.concatenate([self.good, good])
        for side, (ids, ends) in enumerate(sides):
            self.ids[side] = np.concatenate([self.ids[side], ids])
            self.start[side] = np.concatenate([self.start[side], self.start[side][-1] + ends])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, Tokens, np.ndarray, np.ndarray]:
        """Which texts have tokens; these texts' tokens, one after the other; where each text's
        tokens begin on either side (one more entry than texts)."""
        parts = [CUT.split(t) if t else [] for t in texts]
        count = np.fromiter(map(len, parts), np.int64, len(parts))
        codes, distinct = pd.factorize(np.array([s for p in parts for s in p] or [""], dtype=object))
        codes = codes[: int(count.sum())]
        segments = distinct.tolist() if len(codes) else []
        new = [s for s in segments if s not in self.place]
        if len(self.place) + len(new) > POOL:
            self._clear()
            new = segments
        if new:
            self._learn(new)
        at = np.fromiter(map(self.place.__getitem__, segments), np.int64, len(segments))[codes]
        text = np.repeat(np.arange(len(texts)), count)
        valid = (count > 0) & (np.bincount(text, ~self.good[at], minlength=len(texts)) == 0)
        at, text = at[valid[text]], text[valid[text]]
        sides, begins = [], []
        for side in (0, 1):
            first, size = self.start[side][at], np.diff(self.start[side])[at]
            ends = np.cumsum(size)
            total = int(ends[-1]) if len(ends) else 0
            sides.append(self.ids[side][np.arange(total) + np.repeat(first - ends + size, size)].astype(np.int64))
            begins.append(np.concatenate([[0], np.cumsum(np.bincount(text, size, minlength=len(texts)).astype(np.int64))]))
        return valid, self.aligned(*sides), *begins

    def aligned(self, a: np.ndarray, b: np.ndarray, a_from: int = 0, b_from: int = 0) -> Tokens:
        a_end, b_end = a_from + np.cumsum(self.a_size[a]), b_from + np.cumsum(self.b_size[b])
        at = np.searchsorted(b_end, a_end)
        common = np.zeros(len(a), bool)
        inside = at < len(b_end)
        common[inside] = b_end[at[inside]] == a_end[inside]
        a_cut = np.flatnonzero(common)
        return Tokens(a, b, a_end, b_end, a_cut, at[a_cut])

    def links(self, t: Tokens) -> np.ndarray:
        """One code per linked pair, in order."""
        return (t.a[t.a_cut] * len(self.b_bytes) + t.b[t.b_cut]).astype(self.code)

    def written(self, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """Indices into ``words`` of all closed groups in order, and where each group ends."""
        n_a = t.a_cut[-1] + 1 if len(t.a_cut) else 0
        n_b = t.b_cut[-1] + 1 if len(t.b_cut) else 0
        out = np.empty(n_a + n_b, np.int64)
        a_last, b_last = np.zeros(n_a, np.int64), np.zeros(n_b, np.int64)
        a_last[t.a_cut], b_last[t.b_cut] = 1, 1
        a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
        b_before = np.concatenate([[0], t.b_cut + 1])
        out[np.arange(n_a) + b_before[a_group]] = 2 * t.a[:n_a] + a_last
        out[np.arange(n_b) + t.a_cut[b_group] + 1] = self.b_words + 2 * t.b[:n_b] + b_last
        return out, t.a_cut + t.b_cut + 2

    def text(self, words: np.ndarray) -> bytes:
        return "".join(map(self.words.__getitem__, words.tolist())).encode()


def aligner(held: dict) -> Aligner:
    """The aligner of a broadcast's files, built once per worker."""
    if "built" not in held:
        held["built"] = Aligner(held)
    return held["built"]


def chunks(text: str, size: int = CHUNK, context: int = CONTEXT) -> Iterator[tuple[str, int, int]]:
    """Ranges of a long text: the text to encode, the bytes of space + that text before the range, and in it."""

    def safe(at: int) -> bool:
        return 0 < at < len(text) - 1 and text[at] == " " and not text[at - 1].isspace() and not text[at + 1].isspace()

    def before(at: int) -> int:
        floor, cut = max(0, at - context), at
        while cut >= floor and not safe(cut):
            cut = text.rfind(" ", floor, cut)
            if cut < 0:
                break
        return cut if cut >= floor and safe(cut) else (0 if at <= context else -1)

    def after(at: int) -> int:
        cut = at
        while cut < len(text) and not safe(cut):
            cut = text.find(" ", cut + 1)
            if cut < 0:
                return len(text)
        return min(cut, len(text))

    begin = left = 0
    while begin < len(text):
        end = begin + size
        following = end
        if end < len(text):
            following, right = before(end), after(end)
            if following < 0 or right - following > context:
                end = following = right
        if end >= len(text):
            end = right = following = len(text)
        # Space + body is what lies from ``left`` on: the safe blank itself, or the added one.
        body = text[left + 1 if left else 0 : right]
        skip = len(text[left:begin].encode()) + (1 if begin and not left else 0)
        take = len(text[begin:end].encode()) + (0 if begin else 1)
        yield body, skip, take
        begin, left = end, following


_RANGES = "_row bigint, _chunk int, _chunks int, _body string, _skip bigint, _take bigint"
_FOUND = "n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, _links binary"
_OPEN = "_row bigint, _chunk int, _at int, _cut boolean, pa array<int>, pb array<int>, sa array<int>, sb array<int>, _text binary"


def align(docs: DataFrame, files: Tokenizers, doc_id: str = "doc_id", text: str = "text", others: tuple[str, ...] = ()) -> DataFrame:
    """Per document: numbers of tokens, groups and links, the links' counts, and the digest of its groups."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast({"first": files.first, "second": files.second})
    named = docs.select(F.col(doc_id).alias("doc_id"), *others, F.col(text).alias("_text"))
    rows = stage(_encoded(named, shared), "aligned")
    whole = rows.where(F.col("_chunk").isNull())
    long = stage(_fragments(rows.where(F.col("_chunk").isNotNull()), shared), "fragments")
    # A range without tokens takes them from its whole document, before links are counted.
    bad = long.where(~F.col("_good")).select("_row").distinct()
    counts = _pair_counts(whole.select("_links").union(long.join(bad, "_row", "left_anti").select("_links")), shared)
    best = spark.sparkContext.broadcast(counts)

    def scored(column: pa.Array):
        links, size = _codes(column, aligner(shared.value).code)
        held = best.value
        # Links of documents without tokens may be unknown; these documents' numbers are 0 in the end.
        at = np.minimum(np.searchsorted(held["code"], links), max(len(held["code"]) - 1, 0))
        row = np.repeat(np.arange(len(size)), size)
        if not len(held["code"]):
            return [pa.array(np.zeros(len(size), np.int64))] * 2
        count = np.bincount(row, held["best"][at], minlength=len(size)).astype(np.int64)
        # Counts add up as integers: sums of floats would lose digits.
        total = np.concatenate([[0], np.cumsum(held["n"][at])])
        ends = np.concatenate([[0], np.cumsum(size)])
        return [pa.array(count), pa.array(total[ends[1:]] - total[ends[:-1]])]

    def with_counts(df: DataFrame) -> DataFrame:
        return with_columns(df, "_links", "n_best bigint, count_sum bigint", scored).drop("_links")

    keys = ["doc_id", *others]
    numbers = ["n_a", "n_b", "n_groups", "n_best", "count_sum"]
    short = with_counts(whole.select(*keys, "n_a", "n_b", "n_groups", "groups_sha256", "_links"))
    pieces = with_counts(long.select("_row", "_good", "n_a", "n_b", "n_groups", "_links"))
    totals = pieces.groupBy("_row").agg(F.min("_good").alias("_good"), *[F.sum(c).alias(c) for c in numbers])
    first = rows.where(F.col("_chunk") == 0).select(*keys, "_row")
    joined = first.join(totals, "_row").join(_digests(long), "_row", "left")
    zero = [F.when(F.col("_good"), F.col(c)).otherwise(F.lit(0)).cast("bigint").alias(c) for c in numbers]
    digest = F.when(F.col("_good"), F.col("_digest")).otherwise(F.lit("")).alias("groups_sha256")
    both = short.select(*keys, *numbers, "groups_sha256").unionByName(joined.select(*keys, *zero, digest))
    return both.withColumn("n_links", F.col("n_groups"))


def _encoded(named: DataFrame, shared) -> DataFrame:
    """Whole results of documents up to ``CHUNK`` bytes, and the ranges of longer ones."""
    rest = [f for f in named.schema.fields if f.name != "_text"]
    made = [*StructType.fromDDL(_RANGES).fields, *StructType.fromDDL(_FOUND).fields]
    schema = StructType([*(StructField(f.name, f.dataType, True) for f in rest), *made])
    names = [f.name for f in rest]
    size, context = CHUNK, CONTEXT

    def run(batches):
        task, held, n = TaskContext.get().partitionId(), aligner(shared.value), 0
        for part in byte_slices(batches, "_text"):
            texts = part.column("_text").to_pylist()
            is_long = (pc.fill_null(pc.binary_length(part.column("_text")), 0).to_numpy(zero_copy_only=False) > size).tolist()
            short = [i for i, x in enumerate(is_long) if not x]
            valid, tokens, a_from, b_from = held.encode([texts[i] for i in short])
            words, ends = held.written(tokens)
            links = held.links(tokens)
            cut = np.searchsorted(tokens.a_cut, a_from)
            begins = np.concatenate([[0], ends])[cut]
            digests = [hashlib.sha256(held.text(words[x:y])[:-1]).hexdigest() if y > x else "" for x, y in zip(begins, begins[1:], strict=False)]
            packed = [links[x:y].tobytes() for x, y in zip(cut, cut[1:], strict=False)]
            none = [None] * len(short)
            arrays = [c.take(pa.array(short, pa.int64())) for c in (part.column(x) for x in names)]
            arrays += [pa.array(none, t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())]
            arrays += [pa.array(np.diff(a_from)), pa.array(np.diff(b_from)), pa.array(np.diff(cut)), pa.array(digests, pa.string()), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)
            for i in np.flatnonzero(is_long).tolist():
                row, n = (task << 33) + n, n + 1
                total = sum(1 for _ in chunks(texts[i], size, context))
                for k, (body, skip, take) in enumerate(chunks(texts[i], size, context)):
                    own = [part.column(x).take(pa.array([i if k == 0 else None], pa.int64())) for x in names]
                    own += [pa.array([v], t) for v, t in ((row, pa.int64()), (k, pa.int32()), (total, pa.int32()), (body, pa.string()), (skip, pa.int64()), (take, pa.int64()))]
                    own += [pa.array([None], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())]
                    yield pa.RecordBatch.from_arrays(own, names=schema.names)

    return named.mapInArrow(run, schema)


def _fragments(ranges: DataFrame, shared) -> DataFrame:
    """The fragment of each range, with its links and the text of its closed groups."""
    made = _OPEN + ", _chunks int, _good boolean, n_a bigint, n_b bigint, n_groups bigint, _links binary"
    schema = StructType.fromDDL(made)

    def run(batches):
        held = aligner(shared.value)
        for part in byte_slices(batches, "_body"):
            for r in part.to_pylist():
                yield pa.RecordBatch.from_pylist([one(held, r)], schema=arrow)
        release()

    def one(held: Aligner, r: dict) -> dict:
        out = {"_row": r["_row"], "_chunk": r["_chunk"], "_at": r["_chunk"], "_chunks": r["_chunks"], "_cut": False, "_good": False}
        out |= {"pa": [], "pb": [], "sa": [], "sb": [], "_text": b"", "n_a": 0, "n_b": 0, "n_groups": 0, "_links": b""}
        valid, t, _, _ = held.encode([r["_body"]])
        if not valid[0]:
            return out
        lo, hi = r["_skip"], r["_skip"] + r["_take"]
        a, b = ((e > lo) & (e <= hi) for e in (t.a_end, t.b_end))
        a_from, b_from = (int(e[e <= lo][-1]) if (e <= lo).any() else 0 for e in (t.a_end, t.b_end))
        t = held.aligned(t.a[a], t.b[b], a_from, b_from)
        out |= {"_good": True, "n_a": len(t.a), "n_b": len(t.b), "n_groups": len(t.a_cut), "_links": held.links(t).tobytes()}
        if not len(t.a_cut):
            return out | {"pa": t.a.tolist(), "pb": t.b.tolist()}
        words, ends = held.written(t)
        out |= {"_cut": True, "_text": held.text(words[ends[0] :])}
        out |= {"pa": t.a[: t.a_cut[0] + 1].tolist(), "pb": t.b[: t.b_cut[0] + 1].tolist()}
        return out | {"sa": t.a[t.a_cut[-1] + 1 :].tolist(), "sb": t.b[t.b_cut[-1] + 1 :].tolist()}

    arrow = pa.schema(
        [("_row", pa.int64()), ("_chunk", pa.int32()), ("_at", pa.int32()), ("_cut", pa.bool_())]
        + [(c, pa.list_(pa.int32())) for c in ("pa", "pb", "sa", "sb")]
        + [("_text", pa.binary()), ("_chunks", pa.int32()), ("_good", pa.bool_())]
        + [(c, pa.int64()) for c in ("n_a", "n_b", "n_groups")]
        + [("_links", pa.binary())]
    )
    cells = ranges.select("_row", "_chunk", "_chunks", "_body", "_skip", "_take")
    return cells.repartition("_row", "_chunk").mapInArrow(run, schema)


def compose(left: dict, right: dict) -> tuple[dict, tuple[int, list, list] | None]:
    """Two neighbouring fragments as one, and the group that closes between them, with the range it ends in."""
    if left["_cut"] and right["_cut"]:
        bridge = right["_at"], left["sa"] + right["pa"], left["sb"] + right["pb"]
        return left | {"sa": right["sa"], "sb": right["sb"]}, bridge
    if left["_cut"]:
        return left | {"sa": left["sa"] + right["pa"], "sb": left["sb"] + right["pb"]}, None
    return right | {"_chunk": left["_chunk"], "pa": left["pa"] + right["pa"], "pb": left["pb"] + right["pb"]}, None


def _written(a: list[int], b: list[int]) -> bytes:
    return (",".join(map(str, a)) + "|" + ",".join(map(str, b)) + ";").encode()


def _digests(fragments: DataFrame) -> DataFrame:
    """The digest of each long document's groups: fragments composed in a tree, groups hashed in order."""
    schema = StructType.fromDDL(_OPEN)
    names = schema.names
    arrow = pa.schema(
        [("_row", pa.int64()), ("_chunk", pa.int32()), ("_at", pa.int32()), ("_cut", pa.bool_())]
        + [(c, pa.list_(pa.int32())) for c in ("pa", "pb", "sa", "sb")]
        + [("_text", pa.binary())]
    )

    def composed(key, table):
        parts = sorted(table.select(names).to_pylist(), key=lambda r: r["_chunk"])
        whole, closed = parts[0], []
        for part in parts[1:]:
            whole, bridge = compose(whole, part)
            if bridge:
                closed.append({"_row": whole["_row"], "_at": bridge[0], "_text": _written(*bridge[1:])})
        return pa.Table.from_pylist([whole, *closed], schema=arrow)

    most = fragments.agg(F.max("_chunks")).first()[0] or 1
    level = fragments.select(*[c for c in names if c != "_text"], F.lit(None).cast("binary").alias("_text"))
    closed = fragments.where("_cut").select("_row", "_at", F.lit(1).alias("_part"), "_text")
    span = FAN_IN
    while True:
        groups = level.withColumn("_up", F.expr(f"_chunk div {span}")).groupBy("_row", "_up")
        both = stage(groups.applyInArrow(composed, schema), "composed")
        closed = closed.unionByName(both.where(F.col("_text").isNotNull()).select("_row", "_at", F.lit(0).alias("_part"), "_text"))
        level = both.where(F.col("_text").isNull())
        if span >= most:
            break
        span *= FAN_IN
    # A document begins at a common end, so its prefix is its first group.
    ids = [F.array_join(F.col(c).cast("array<string>"), ",") for c in ("pa", "pb")]
    opening = F.concat(ids[0], F.lit("|"), ids[1], F.lit(";")).cast("binary")
    closed = closed.unionByName(level.where("_cut").select("_row", "_at", F.lit(0).alias("_part"), opening.alias("_text")))

    def hashed(batches):
        row, state, last = None, None, b""
        for batch in batches:
            found = []
            for r, text in zip(batch.column("_row").to_pylist(), batch.column("_text").to_pylist(), strict=True):
                if r != row:
                    if row is not None:
                        found.append((row, state.hexdigest()))
                    row, state, last = r, hashlib.sha256(), b""
                if text:
                    # The separator behind the last group is not part of the digest.
                    state.update(last)
                    state.update(text[:-1])
                    last = text[-1:]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.string())], names=["_row", "_digest"])
        if row is not None:
            yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([state.hexdigest()], pa.string())], names=["_row", "_digest"])

    ordered = closed.repartition("_row").sortWithinPartitions("_row", "_at", "_part")
    return ordered.select("_row", "_text").mapInArrow(hashed, "_row bigint, _digest string")


def _codes(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """All links of an array of rows, and how many each row has."""
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) // np.dtype(kind).itemsize
    if not size.sum():
        return np.empty(0, kind), size
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].copy().view(kind), size


def _pair_counts(links: DataFrame, shared) -> dict:
    """Codes of all linked pairs in order, how often each is linked, and whether none of its B id is more often."""

    def counted(batches):
        held = aligner(shared.value)
        codes, n = np.empty(0, held.code), np.empty(0, np.int64)
        for part in byte_slices(batches, "_links", LINK_BYTES):
            found, times = np.unique(_codes(part.column(0), held.code)[0], return_counts=True)
            codes, place = np.unique(np.concatenate([codes, found]), return_inverse=True)
            n = np.bincount(place, np.concatenate([n, times]), minlength=len(codes)).astype(np.int64)
        b = codes.astype(np.int64) % len(held.b_bytes)
        yield pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64)), pa.array(b), pa.array(n)], names=["code", "b", "n"])

    tasks = links.where(F.octet_length("_links") > 0).mapInArrow(counted, "code bigint, b bigint, n bigint")
    counts = stage(tasks.groupBy("code", "b").agg(F.sum("n").alias("n")), "pair-counts")
    top = counts.groupBy("b").agg(F.max("n").alias("_top"))
    # At most ``pair_bound`` rows, whatever the corpus.
    found = counts.join(F.broadcast(top), "b").select("code", "n", (F.col("n") == F.col("_top")).alias("best")).toArrow()
    code, n, best = (found.column(c).to_numpy() for c in ("code", "n", "best"))
    order = np.argsort(code)
    return {"code": code[order], "n": n[order], "best": best[order]}
