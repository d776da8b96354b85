"""Interpolated modified Kneser-Ney model of word pairs, counted and applied in Spark.

Texts are read once into batches of hashed words, a written table bucketed by batch. All
counting is then an exchange of packed requests and answers with shards:

1. A batch sends its distinct word pairs, sorted by hash, with their training counts. The
   shard of a hash range adds them up, stores the totals as sorted hash arrays in a file
   of the task that is memory-mapped, and answers each batch's pairs by binary search in
   it, in the order they came, so an answer needs no keys. The first batch that brings a
   pair owns it; shards also return how many pairs occur 1, 2, 3 and 4 times.
2. A batch counts, over the pairs it owns, what the model needs of their words: pairs that
   begin with a word by count class, and pairs that end with it. Words go through a second
   exchange of the same kind together with their own counts.
3. Every batch then holds the model's numbers for its own words and pairs and scores its
   texts.

A frequent word or pair is one entry per batch in any exchange, and shards are ranges of
hashes, so no key is hot. The number of shards follows the number of tokens; the driver
holds sums only. Answers meet their batch in its bucket, so texts are not shuffled at all.

Tokens are words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, then one end per text. Null and
empty texts have the end alone. Null ids are kept. Long texts are cut between batches; a
part is read on from the last word of the part before, and a text's sums are added up. Rows that repeat an id are each a text: they are counted and scored each.
Without any training text all tokens are equally likely. Only id, text and the training
mark are read. Words and pairs are told apart by 64-bit hashes.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stage, work_path
from .words import mix, runs, word_hashes

BATCH_CHARS = 4_000_000
SHARD_TOKENS = 500_000
BEGIN, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_C = np.uint64(0x9E3779B97F4A7C15)
_BATCH = "batch bigint, doc_id binary, text_row binary, part binary, context binary, tokens binary, words binary, ids binary"
CLASSES = 4
_SPACE = " \t\n\r\x0b\x0c"


# ---- batches ---------------------------------------------------------------------


def _batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per some texts: ids, numbers of texts, words before a part, and which of them are null, word counts, distinct words, word numbers.

    The sign of a word count says whether the text is for training; bits of ``part`` say
    whether it is the beginning and whether the end of a text, and whether its id is null.
    Ids come as text: a column of numbers with a null would come as floats.
    """
    task, made, nth = TaskContext.get().partitionId(), 0, 0
    held, size = [], 0

    def row():
        nonlocal made, held, size
        hashes, start = word_hashes([h[1] for h in held])
        # The words before later parts of a text are words of the batch too.
        before = [h[6] for h in held if h[6] is not None]
        codes, words = pd.factorize(np.concatenate([hashes, np.array(before, np.uint64)]))
        order = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        n = np.diff(start)
        context = np.full(len(held), -1, np.int32)
        context[[h[6] is not None for h in held]] = rank[codes[len(hashes) :]]
        made += 1
        out = {
            "batch": task << 32 | made,
            "doc_id": np.array([h[0] or 0 for h in held], np.int64).tobytes(),
            "part": np.array([h[2] | h[3] << 1 | h[4] << 2 | (h[0] is None) << 3 for h in held], np.int8).tobytes(),
            "text_row": np.array([h[5] for h in held], np.int64).tobytes(),
            "context": context.tobytes(),
            "tokens": n.astype(np.int32).tobytes(),
            "words": np.asarray(words, np.uint64)[order].tobytes(),
            "ids": rank[codes[: len(hashes)]].astype(np.int32).tobytes(),
        }
        held, size = [], 0
        return pd.DataFrame([out])

    for pdf in batches:
        for doc, text, trains in zip(pdf["id"].tolist(), pdf["text"], pdf["trains"].tolist(), strict=True):
            doc, text, at, before = None if doc is None else int(doc), text or "", 0, None
            nth += 1
            while True:
                end = min(at + BATCH_CHARS, len(text))
                while end < len(text) and text[end] not in _SPACE:
                    end += 1
                held.append((doc, text[at:end], at == 0, end == len(text), bool(trains), task << 32 | nth, before))
                if end < len(text):
                    before = _last_word(text, at, end, before)
                size += end - at
                if size >= BATCH_CHARS:
                    yield row()
                at = end
                if at == len(text):
                    break
    if held:
        yield row()


def _last_word(text: str, at: int, end: int, before):
    """Hash of the last word of a part; ``before`` if it has none."""
    while end > at and text[end - 1] in _SPACE:
        end -= 1
    start = end
    while start > at and text[start - 1] not in _SPACE:
        start -= 1
    return word_hashes([text[start:end]])[0][0] if start < end else before


class Batch:
    """A batch unpacked: its words with begin and end, and the words and pairs of its tokens."""

    def __init__(self, row):
        self.id = row.batch
        self.doc = np.frombuffer(row.doc_id, np.int64)
        self.row = np.frombuffer(row.text_row, np.int64)
        context = np.frombuffer(row.context, np.int32).astype(np.int64)
        part = np.frombuffer(row.part, np.int8)
        begins, ends, self.trains, self.null = ((part & bit) > 0 for bit in (1, 2, 4, 8))
        n = np.frombuffer(row.tokens, np.int32).astype(np.int64)
        words = np.frombuffer(row.words, np.uint64)
        ids = np.frombuffer(row.ids, np.int32).astype(np.int64)
        self.words = np.concatenate([words, [BEGIN, END]])
        begin, end = len(words), len(words) + 1
        # A text that goes on in another part is read on there from its last word.
        length = n + ends
        self.start = np.concatenate([[0], np.cumsum(length)])
        self.text = np.repeat(np.arange(len(n)), length)
        last = np.empty(self.start[-1], np.int64)
        is_end = np.zeros(self.start[-1], bool)
        is_end[self.start[1:][ends] - 1] = True
        last[~is_end], last[is_end] = ids, end
        first = np.empty_like(last)
        first[1:] = last[:-1]
        first[self.start[:-1][length > 0]] = np.where(context < 0, begin, context)[length > 0]
        self.token, self.before, self.begins, self.ends = last, first, begins, ends
        key = mix(self.words[first] * _C + self.words[last])
        self.pairs, place, self.pair_of = np.unique(key, return_index=True, return_inverse=True)
        self.pair_first, self.pair_last = first[place], last[place]
        self.taught = self.trains[self.text]

    def pair_counts(self) -> np.ndarray:
        return np.bincount(self.pair_of[self.taught], minlength=len(self.pairs)).astype(np.int64)

    def word_counts(self) -> np.ndarray:
        """Training counts of words; for the begin mark, of what follows it."""
        counts = np.bincount(self.token[self.taught], minlength=len(self.words)).astype(np.int64)
        counts[-2] = int((self.taught & (self.before == len(self.words) - 2)).sum())
        return counts


def _rows(pdf: pd.DataFrame) -> Iterator:
    return pdf.itertuples(index=False)


# ---- exchange with shards --------------------------------------------------------


def _shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _requests(batch: int, hashes: np.ndarray, counts: np.ndarray, shards: int) -> pd.DataFrame:
    """Sorted hashes cut into shards; ``counts`` has a row per counted quantity."""
    shard = _shard(hashes, shards)
    cut = np.flatnonzero(np.concatenate([[True], np.diff(shard) != 0])) if len(shard) else np.empty(0, np.int64)
    stop = np.concatenate([cut[1:], [len(shard)]]).astype(np.int64)
    return pd.DataFrame(
        {
            "shard": shard[cut],
            "batch": batch,
            "hashes": [hashes[a:b].tobytes() for a, b in zip(cut, stop, strict=False)],
            "counts": [_packed(counts[:, a:b]) for a, b in zip(cut, stop, strict=False)],
        }
    )


class ShardFile:
    """Sorted hashes and their totals in a file of this task, memory-mapped."""

    def __init__(self, hashes: np.ndarray, totals: np.ndarray):
        handle, self.path = tempfile.mkstemp(suffix=".shard")
        with os.fdopen(handle, "wb") as out:
            out.write(hashes.tobytes())
            out.write(totals.astype(np.int64).tobytes())
        n, kinds = len(hashes), len(totals)
        self.hashes = np.memmap(self.path, np.uint64, "r", 0, (n,))
        self.totals = np.memmap(self.path, np.int64, "r", 8 * n, (kinds, n))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.hashes, hashes)

    def close(self) -> None:
        del self.hashes, self.totals
        os.unlink(self.path)


def _answers(kinds: int, own: bool):
    """Totals per request in its order. With ``own`` the first batch that counted an entry
    gets the negative total, as its owner."""

    def rows(batches):
        for run in runs(batches, ["shard"]):
            asked = [np.frombuffer(x, np.uint64) for x in run["hashes"]]
            counts = [_numbers(x, kinds) for x in run["counts"]]
            hashes, inverse = np.unique(np.concatenate(asked), return_inverse=True)
            every = np.concatenate(counts, axis=1)
            totals = np.stack([np.bincount(inverse, weights=c, minlength=len(hashes)) for c in every]).astype(np.int64)
            shard = ShardFile(hashes, totals)
            free = totals[0] > 0
            answers = []
            for h, c in zip(asked, counts, strict=True):
                at = shard.find(h)
                got = np.array(shard.totals[:, at])
                if own:
                    mine = free[at] & (c[0] > 0)
                    free[at[mine]] = False
                    got[0, mine] *= -1
                answers.append(_packed(got))
            shard.close()
            sums = _sums(hashes, totals)
            yield pd.DataFrame({"batch": run["batch"].to_numpy(), "shard": run["shard"].to_numpy(), "totals": answers}).assign(
                sums=[sums.tolist()] + [None] * (len(run) - 1)
            )

    return rows


def _sums(hashes: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Of the last kind: how many entries have it at 1, 2, 3, 4, and its sum and number.
    Then the sum and number of the first kind. The begin mark is no token."""
    known = totals[:, hashes != BEGIN]
    last, first = known[-1], known[0]
    classes = [int((last == k).sum()) for k in range(1, CLASSES + 1)]
    return np.array([*classes, last.sum(), (last > 0).sum(), first.sum(), (first > 0).sum()], np.int64)


_ANSWERS = "batch bigint, shard bigint, totals binary, sums array<bigint>"


def _exchange(requests: DataFrame, kinds: int, own: bool, label: str) -> tuple[DataFrame, np.ndarray]:
    sent = requests.repartition("shard").sortWithinPartitions("shard", "batch")
    answers = stage(sent.mapInPandas(_answers(kinds, own), _ANSWERS), label)
    # Eight numbers per shard, added up.
    row = answers.where("sums IS NOT NULL").select(*(F.sum(F.col("sums")[k]) for k in range(8))).first()
    return answers.select("batch", "shard", "totals"), np.array([x or 0 for x in row], np.float64)


def _collected(answers: DataFrame, name: str) -> DataFrame:
    return answers.groupBy("batch").agg(F.collect_list(F.struct("shard", "totals")).alias(name))


def _unpack(answers, kinds: int) -> np.ndarray:
    """The totals of a batch, in the order of its sorted hashes."""
    pairs = sorted((tuple(a.values()) if isinstance(a, dict) else tuple(a)) for a in answers)
    return np.concatenate([_numbers(t, kinds) for _, t in pairs], axis=1)


def _packed(numbers: np.ndarray) -> bytes:
    """A width byte, then the numbers in the smallest of three widths."""
    most = int(np.abs(numbers).max(initial=0))
    width = next(w for w in (1, 4, 8) if most < 1 << (8 * w - 1))
    return bytes([width]) + numbers.astype(f"<i{width}").tobytes()


def _numbers(raw: bytes, kinds: int) -> np.ndarray:
    return np.frombuffer(raw, f"<i{raw[0]}", offset=1).reshape(kinds, -1).astype(np.int64)


# ---- the model -------------------------------------------------------------------


def discounts(classes: np.ndarray) -> np.ndarray:
    """Discounts of entries counted 0, 1, 2 and more times, from how many occur 1 to 4 times."""
    n1, n2, n3, n4 = classes[:4]
    if min(n1, n2, n3) <= 0:
        return np.array([0.0, 0.5, 0.75, 0.9])
    y = n1 / (n1 + 2 * n2)
    d = [k - (k + 1) * y * b / a for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return np.array([0.0, *(min(max(x, 0.05), 0.95 * k) for k, x in zip((1, 2, 3), d, strict=True))])


def probabilities(pair_total, context, begins, word_pairs, known, pair_d, word_d, totals):
    """p(word | word before) by interpolation.

    ``context``: training count of the word before; ``begins``: pairs it begins, by count
    class 1, 2, 3+; ``word_pairs``: pairs that end with the word; ``totals``: pairs in all,
    and words by number of pairs 1, 2, 3+, and distinct words.
    """
    pairs, by_class, distinct = totals
    if pairs:
        rest = (word_d[1:] * by_class).sum() / pairs
        low = np.maximum(word_pairs - word_d[np.minimum(word_pairs, 3)], 0) / pairs + rest / (distinct + 1)
    else:
        low = np.full(len(known), 1.0 / (distinct + 1))
    seen = context > 0
    safe = np.maximum(context, 1)
    high = np.maximum(pair_total - pair_d[np.minimum(pair_total, 3)], 0) / safe
    weight = np.where(seen, (pair_d[1:] * begins.T).sum(1) / safe, 1.0)
    return np.where(seen, high, 0.0) + weight * low


def score(docs: DataFrame, trains: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, trains, n_tokens, n_known, train_tokens, base_score, score.

    ``trains`` marks the rows to learn from; null is no. ``score`` is the log10 probability
    of the text; ``base_score`` that of single words with one half added to every count.
    """
    spark = docs.sparkSession
    source = docs.select(
        F.col(doc_id).cast("bigint").cast("string").alias("id"), F.col(text).alias("text"), F.coalesce(trains, F.lit(False)).alias("trains")
    )
    name = f"hertzflow_batches_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    written = source.mapInPandas(_batches, _BATCH).write.bucketBy(buckets, "batch").sortBy("batch")
    written.option("compression", "zstd").option("path", work_path(spark, "batches")).saveAsTable(name)
    batches = spark.table(name)
    tokens = batches.select(F.sum(F.octet_length("ids") / 4)).first()[0] or 0
    shards = int(tokens // SHARD_TOKENS) + 1

    def pair_requests(parts):
        for pdf in parts:
            for row in _rows(pdf):
                b = Batch(row)
                yield _requests(b.id, b.pairs, b.pair_counts()[None], shards)

    request = "shard bigint, batch bigint, hashes binary, counts binary"
    pairs, pair_sums = _exchange(batches.mapInPandas(pair_requests, request), 1, True, "pair-answers")
    pair_d = discounts(pair_sums[:4])

    def word_requests(parts):
        for pdf in parts:
            for row in _rows(pdf):
                b = Batch(row)
                total = _unpack(row.pair_answers, 1)[0]
                owned = total < 0
                counts = [b.word_counts()]
                size = np.minimum(-total, 3)
                for k in (1, 2, 3):
                    counts.append(np.bincount(b.pair_first[owned & (size == k)], minlength=len(b.words)))
                counts.append(np.bincount(b.pair_last[owned], minlength=len(b.words)))
                order = np.argsort(b.words)
                yield _requests(b.id, b.words[order], np.stack(counts)[:, order], shards)

    with_pairs = batches.join(_collected(pairs, "pair_answers"), "batch")
    words, word_sums = _exchange(with_pairs.mapInPandas(word_requests, request), 5, False, "word-answers")
    m1, m2, m3, m4, all_pairs, _, n_all, distinct = word_sums
    word_d = discounts(np.array([m1, m2, m3, m4]))
    with_pair_ends = word_sums[5]
    by_class = np.array([m1, m2, max(with_pair_ends - m1 - m2, 0)])

    def scored(parts):
        for pdf in parts:
            for row in _rows(pdf):
                b = Batch(row)
                total = np.abs(_unpack(row.pair_answers, 1)[0])
                order = np.argsort(b.words)
                numbers = np.empty((5, len(b.words)), np.int64)
                numbers[:, order] = _unpack(row.word_answers, 5)
                count = numbers[0][b.token]
                p = probabilities(
                    total[b.pair_of],
                    numbers[0][b.before],
                    numbers[1:4][:, b.before],
                    numbers[4][b.token],
                    count > 0,
                    pair_d,
                    word_d,
                    (all_pairs, by_class, distinct),
                )
                base = np.log10((count + 0.5) / (n_all + 0.5 * (distinct + 1)))
                sums = lambda x: np.bincount(b.text, weights=x, minlength=len(b.doc))  # noqa: E731, B023
                yield pd.DataFrame(
                    {
                        "text_row": b.row,
                        "doc_id": pd.arrays.IntegerArray(b.doc.copy(), b.null),
                        "whole": b.begins & b.ends,
                        "trains": b.trains,
                        "n_tokens": np.diff(b.start),
                        "n_known": sums(count > 0).astype(np.int64),
                        "base_score": sums(base),
                        "score": sums(np.log10(p)),
                    }
                )

    both = with_pairs.join(_collected(words, "word_answers"), "batch")
    schema = "text_row bigint, doc_id bigint, whole boolean, trains boolean, n_tokens bigint, n_known bigint, base_score double, score double"
    parts = stage(both.mapInPandas(scored, schema), "scores")
    spark.sql(f"DROP TABLE {name}")
    # Only the parts of texts that were cut meet again, each text for itself.
    cut = parts.where(~F.col("whole")).groupBy("text_row", "trains").agg(
        F.max("doc_id").alias("doc_id"),
        *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")),
    )
    columns = ["doc_id", "trains", "n_tokens", "n_known", "base_score", "score"]
    out = parts.where("whole").select(*columns).unionByName(cut.select(*columns))
    return out.withColumn("train_tokens", F.lit(int(n_all)).cast("bigint"))
