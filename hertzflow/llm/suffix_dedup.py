"""Removal of repeated byte strings with suffix arrays.

A byte is removed if a ``length``-byte string that covers it also starts earlier, at a
smaller (doc_id, byte offset). Strings lie within one document and are judged on the
input. No position is sampled away: every window of ``length`` bytes is decided.

1. Each window belongs to its anchor, the 32-gram of least hash inside it. Windows with
   equal bytes have equal anchors at equal places, so they can only meet under the same
   anchor. Neighbouring windows of one anchor form a context, some 130 bytes long.
2. Contexts are shuffled by anchor as fixed-size rows without their bytes. Of equal ones,
   within a task and again after the shuffle, only the first stays; the windows of the
   others repeat by that. Anchors with one context left are done.
3. The other contexts, where repeats begin and end, are cut out of their documents and
   form shards. A shard is sorted by Larsson-Sadakane refinement up to ``length`` bytes,
   neighbours get their common prefix by Kasai's bound, and of each run of common windows
   all but the first are removed.
4. An anchor with more contexts than ``shard_rows`` is dealt over several shards. These
   hand their distinct windows on in sorted order; blocks of one range of window hashes
   are merged by binary search, which finds what starts earlier in another shard.
5. Spans are gathered per document and cut out of its bytes.

Nothing is broadcast. A frequent passage is one row per task and anchor; a frequent
anchor with many contexts is split as in 4. Null and empty texts have no bytes. Long
texts are read in slices that overlap by a window. Where ids are null or repeat, rows are
ordered by id (null first), then a hash of the text; rows of one id with other texts are
other documents, and rows equal in both are one document, reported each. Only id, text and ``others`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..storage import stage
from .batches import byte_slices, limit_batches, map_slices, tidy
from .rows import ROW, own_rows
from .words import BYTE_VALUES, mix, runs

LENGTH = 100
GRAM = 32
PLACE_BITS = 23
SLICE_BYTES = 1 << 21
CHUNK_BYTES = 1 << 21
SHARD_ROWS = 8192
RANGES = 256
_CONTEXT = "anchor bigint, body bigint, doc_id bigint, at bigint, shape int"


# ---- suffix arrays ---------------------------------------------------------------


def suffix_array(raw: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of all suffixes by their first ``depth`` bytes, and each one's group start in it.

    Larsson-Sadakane refinement: groups that are equal so far are sorted by the group of
    the suffix that begins where the compared bytes end; sorted ones are left alone.
    """
    n = len(raw)
    padded = np.concatenate([raw, np.zeros(7, np.uint8)]).astype(np.uint64)
    first = np.minimum(n - np.arange(n), 7).astype(np.uint64)
    for k in range(7):
        first |= padded[k : k + n] << np.uint64(56 - 8 * k)
    order = np.argsort(first, kind="stable")
    key = first[order]
    fresh = np.concatenate([[True], key[1:] != key[:-1]]) if n else np.empty(0, bool)
    place = np.arange(n)
    group = np.empty(n, np.int64)
    group[order] = np.maximum.accumulate(np.where(fresh, place, 0)) if n else 0
    done = 7
    while done < depth:
        alone = fresh & np.concatenate([fresh[1:], [True]])
        left = np.flatnonzero(~alone)
        if not len(left):
            break
        step = min(done, depth - done)
        at = order[left]
        beyond = at + step
        key = group[at] * (n + 1) + np.where(beyond < n, group[np.minimum(beyond, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        order[left], key = at[by], key[by]
        fresh[left] = np.concatenate([[True], key[1:] != key[:-1]])
        group[order[left]] = np.maximum.accumulate(np.where(fresh[left], left, 0))
        done += step
    return order, group


def common_prefixes(raw: np.ndarray, order: np.ndarray, group: np.ndarray, limit: int, lane: int = 64) -> np.ndarray:
    """Bytes that each suffix shares with the one before it in ``order``, up to ``limit``,
    which is at most the depth that was sorted by.

    Kasai's bound, a suffix shares at least one byte less than the one before it in the
    text, is used in lanes: all positions of equal remainder go at once. It holds where
    the suffix before differed within the sorted depth; within a group all bytes agree.
    """
    n = len(raw)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    together = (before >= 0) & (group == group[before])
    shared = np.zeros(n, np.int64)
    for k in range(min(lane, n)):
        at = np.arange(k, n, lane)
        last = shared[at - 1] if k else np.zeros(len(at), np.int64)
        got = np.where(last < limit, np.maximum(last - 1, 0), 0)
        other = before[at]
        got[other < 0] = 0
        got[together[at]] = limit
        on = np.flatnonzero((other >= 0) & ~together[at])
        while len(on):
            a, b = at[on] + got[on], other[on] + got[on]
            same = (a < n) & (b < n) & (got[on] < limit)
            same &= padded[np.minimum(a, n)] == padded[np.minimum(b, n)]
            on = on[same]
            got[on] += 1
        shared[at] = got
    return shared


# ---- contexts --------------------------------------------------------------------


def _grams(raw: np.ndarray) -> np.ndarray:
    """Hashes of the GRAM bytes from each position on (the last ones are of no use)."""
    h, power, size = mix(BYTE_VALUES[raw]), 0xD1342543DE82EF95, 1
    while size < GRAM:
        h[:-size] = h[:-size] * np.uint64(power) + h[size:]
        power, size = power * power % (1 << 64), size * 2
    return mix(h)


def _least(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of the ``width`` entries from each position on."""
    key, size = key.copy(), 1
    while size * 2 <= width:
        key[:-size] = np.minimum(key[:-size], key[size:])
        size *= 2
    if width > size:
        key[: -(width - size)] = np.minimum(key[: -(width - size)], key[width - size :])
    return key


def contexts(raw: np.ndarray, valid: np.ndarray, length: int):
    """(anchor hash, body hash, first window, shape) of the contexts; ``valid`` marks window starts."""
    begin = np.flatnonzero(valid)
    if not len(begin):
        none = np.empty(0, np.int64)
        return none, none, none, none
    grams = _grams(raw)
    low = np.uint64((1 << PLACE_BITS) - 1)
    least = _least((grams & ~low) | np.arange(len(raw), dtype=np.uint64), length - GRAM + 1)
    anchor = (least[begin] & low).astype(np.int64)
    cut = np.flatnonzero(np.concatenate([[True], (np.diff(anchor) != 0) | (np.diff(begin) != 1)]))
    first, last = begin[cut], begin[np.concatenate([cut[1:], [len(begin)]]) - 1]
    anchor = anchor[cut]
    end = last + length - GRAM
    body = np.zeros(len(cut), np.uint64)
    for k in range(0, 2 * length - GRAM, GRAM):
        body = mix(body * np.uint64(0xD1342543DE82EF95) + grams[np.minimum(first + k, end)])
    return grams[anchor].view(np.int64), body.view(np.int64), first, (anchor - first) * 1024 + (last - first)


def _windows(shape):
    return shape % 1024


def merged(doc, begin, end):
    """Unions of overlapping or touching spans of each document."""
    if not len(doc):
        return doc, begin, end
    by = np.lexsort((begin, doc))
    doc, begin, end = doc[by], begin[by], end[by]
    new = np.concatenate([[True], doc[1:] != doc[:-1]])
    # Ends count on within a document only: shift each document beyond the one before.
    shift = np.cumsum(new) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + shift)
    cut = np.flatnonzero(np.concatenate([[True], (begin + shift)[1:] > reach[:-1]]))
    stop = np.concatenate([cut[1:], [len(doc)]]) - 1
    return doc[cut], begin[cut], (reach - shift)[stop]


def _span_frame(doc, begin, end) -> pd.DataFrame:
    """Spans travel as context rows of shape -1."""
    doc, begin, end = merged(np.asarray(doc), np.asarray(begin), np.asarray(end))
    spread = mix(doc.astype(np.uint64) + np.uint64(1)).view(np.int64)
    return pd.DataFrame({"anchor": spread, "body": end, "doc_id": doc, "at": begin, "shape": np.int32(-1)})


def _first_contexts(length: int):
    """Contexts of each document, of equal ones in a slice the first; spans of the others."""

    def slice_rows(docs, offsets, parts, whole):
        raw = np.frombuffer(b"".join(parts), np.uint8)
        size = np.array([len(p) for p in parts])
        stop = np.cumsum(size)
        row = np.repeat(np.arange(len(parts)), size)
        place = np.arange(len(raw)) - np.repeat(stop - size, size)
        # A slice that is not the last of its text leaves the windows of its overlap to the next.
        limit = np.where(whole, size - length + 1, size - length)
        anchor, body, first, shape = contexts(raw, place < limit[row], length)
        doc, at = docs[row[first]], offsets[row[first]] + place[first]
        by = np.lexsort((at, doc))
        key = mix(mix(anchor[by].view(np.uint64)) + body[by].view(np.uint64) + shape[by].astype(np.uint64))
        codes, _ = pd.factorize(key)
        lead = np.unique(codes, return_index=True)[1]
        keep = by[lead]
        yield pd.DataFrame(
            {"anchor": anchor[keep], "body": body[keep], "doc_id": doc[keep], "at": at[keep], "shape": shape[keep].astype(np.int32)}
        )
        # A row of a repeated doc_id is the same occurrence, not a later one.
        first_of = by[lead[codes]]
        gone = by[(doc[by] != doc[first_of]) | (at[by] != at[first_of])]
        yield _span_frame(doc[gone], at[gone], at[gone] + _windows(shape[gone]) + length)

    def rows(batches):
        docs, offsets, parts, whole, held = [], [], [], [], 0
        for pdf in batches:
            for doc, text in zip(pdf["doc_id"].tolist(), pdf["text"], strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                if len(raw) < length:
                    continue
                for lo in range(0, len(raw) - length + 1, SLICE_BYTES):
                    part = raw[lo : lo + SLICE_BYTES + length]
                    docs.append(doc)
                    offsets.append(lo)
                    parts.append(part)
                    whole.append(lo + len(part) >= len(raw))
                    held += len(part)
                    if held >= SLICE_BYTES:
                        yield from slice_rows(np.array(docs), np.array(offsets), parts, np.array(whole))
                        docs, offsets, parts, whole, held = [], [], [], [], 0
        if parts:
            yield from slice_rows(np.array(docs), np.array(offsets), parts, np.array(whole))

    return rows


def _distinct_contexts(length: int, shard_rows: int):
    """Of a partition sorted by (anchor, shape, body, doc_id, at): spans of the repeated
    contexts, and the first ones of anchors with more than one, numbered into shards."""

    def rows(batches):
        last = None  # the last row seen, how many firsts its anchor had, and a first not yet passed on
        firsts, pending = 0, None
        for pdf in batches:
            if not len(pdf):
                continue
            spans = pdf["shape"].to_numpy() < 0
            if spans.any():
                part = pdf[spans]
                yield pd.DataFrame({"doc_id": part["doc_id"], "at": part["at"], "stop": part["body"], "shard": -1, "anchor": 0, "shape": 0})
                pdf = pdf[~spans]
                if not len(pdf):
                    continue
            a, s, b, d, t = (pdf[c].to_numpy() for c in ("anchor", "shape", "body", "doc_id", "at"))
            pa, ps, pb, pd_, pt = (np.concatenate([[last[k] if last else 0], x[:-1]]) for k, x in enumerate((a, s, b, d, t)))
            new_anchor, again = a != pa, (d == pd_) & (t == pt)
            if last is None:
                new_anchor[0] = True
            first = new_anchor | (s != ps) | (b != pb)
            again &= ~first
            gone = ~first & ~again
            doc, begin, end = merged(d[gone], t[gone], t[gone] + _windows(s[gone]) + length)
            yield pd.DataFrame({"doc_id": doc, "at": begin, "stop": end, "shard": -1, "anchor": 0, "shape": 0})

            # Number the firsts of each anchor, going on from the batch before.
            segment = np.cumsum(new_anchor)
            count = np.cumsum(first)
            base = np.concatenate([[-firsts], (count - first)[new_anchor]]) if not new_anchor[0] else (count - first)[new_anchor]
            number = count - base[segment - (1 if new_anchor[0] else 0)] - 1
            total = np.bincount(segment, weights=first, minlength=segment[-1] + 1).astype(np.int64)
            if not new_anchor[0]:
                total[0] += firsts
            several = total[segment] >= 2
            out = first & several
            frame = {"doc_id": d[out], "at": t[out], "stop": 0, "shard": number[out] // shard_rows, "anchor": a[out], "shape": s[out]}
            yield pd.DataFrame(frame)
            if pending is not None:
                if not new_anchor[0] and total[0] >= 2:
                    yield pending
                    pending = None
                elif new_anchor[0] or segment[-1] > 0:
                    pending = None
            if total[-1] == 1 and first[segment == segment[-1]].any():
                k = np.flatnonzero(first)[-1]
                pending = pd.DataFrame({"doc_id": d[k : k + 1], "at": t[k : k + 1], "stop": 0, "shard": 0, "anchor": a[k : k + 1], "shape": s[k : k + 1]})
            firsts = int(total[-1])
            last = (a[-1], s[-1], b[-1], d[-1], t[-1])

    return rows


def _cut_contexts(length: int):
    def rows(batches):
        for pdf in batches:
            part = pd.DataFrame({c: np.concatenate(pdf[c].to_list()) for c in ("anchor", "shard", "at", "shape")})
            counts = pdf["anchor"].map(len).to_numpy()
            part.insert(2, "doc_id", np.repeat(pdf["doc_id"].to_numpy(), counts))
            stop = part["at"].to_numpy() + _windows(part["shape"].to_numpy()) + length
            pieces = []
            for text, begin, end in zip(pdf["text"], pdf["at"], np.split(stop, np.cumsum(counts)[:-1]), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                pieces += [raw[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
            yield part.assign(bytes=pieces)

    return rows


# ---- shards ----------------------------------------------------------------------


def _repeated(parts: list[bytes], doc: np.ndarray, at: np.ndarray, length: int):
    """Per window of the parts: its part, offset in it, whether it is the first of its
    run, and the order of the runs."""
    raw = np.frombuffer(b"".join(parts), np.uint8)
    size = np.array([len(p) for p in parts])
    stop = np.cumsum(size)
    order, group = suffix_array(raw, length)
    shared = common_prefixes(raw, order, group, length)
    part = np.repeat(np.arange(len(parts)), size)
    inner = np.arange(len(raw)) - (stop - size)[part]
    is_window = inner <= (size - length)[part]
    # Only windows stay; what two of them share is the least of all between them, and
    # windows that share ``length`` bytes have only such suffixes between them.
    run = np.cumsum(shared[order] < length)
    chosen = is_window[order]
    window, run = order[chosen], run[chosen]
    doc_w, at_w = doc[part[window]], at[part[window]] + inner[window]
    by = np.lexsort((at_w, doc_w, run))
    window, run, doc_w, at_w = window[by], run[by], doc_w[by], at_w[by]
    head = np.concatenate([[True], run[1:] != run[:-1]])
    lead = np.flatnonzero(head)[np.cumsum(head) - 1]
    first = (doc_w == doc_w[lead]) & (at_w == at_w[lead])
    return raw, window, part[window], doc_w, at_w, head, first


def _shard_rows(length: int, shard_rows: int):
    """Spans of the windows that start earlier in the shard, and the distinct windows of
    shards whose anchor may be in others too, as sorted blocks by range of their hash."""

    def chunk(held):
        part = pd.concat(held, ignore_index=True)
        doc, at = part["doc_id"].to_numpy(), part["at"].to_numpy()
        raw, window, source, doc_w, at_w, head, first = _repeated(part["bytes"].tolist(), doc, at, length)
        doc_s, begin, end = merged(doc_w[~first], at_w[~first], at_w[~first] + length)
        yield pd.DataFrame({"doc_id": doc_s, "at": begin, "stop": end, "anchor": 0, "range": -1, "shard": 0, "keys": None, "owners": None})
        counts = part.groupby(["anchor", "shard"])["doc_id"].transform("size").to_numpy()
        shared = (part["shard"].to_numpy() > 0) | (counts >= shard_rows)
        if not shared.any():
            return
        chosen = np.flatnonzero(head & shared[source])
        text = raw[window[chosen][:, None] + np.arange(length)]
        hashed = np.zeros(len(chosen), np.uint64)
        for k in range(length):
            hashed = mix(hashed + text[:, k])
        range_ = (hashed % np.uint64(RANGES)).astype(np.int64)
        anchor, shard = part["anchor"].to_numpy()[source[chosen]], part["shard"].to_numpy()[source[chosen]]
        keys = np.hstack([text, np.ones((len(chosen), 1), np.uint8)]).view(f"S{length + 1}").ravel()
        owners = np.stack([doc_w[chosen], at_w[chosen]], axis=1)
        by = np.lexsort((keys, range_, shard, anchor))
        same = lambda x: x[by][1:] == x[by][:-1]
        cut = np.flatnonzero(np.concatenate([[True], ~(same(anchor) & same(shard) & same(range_))]))
        for lo, hi in zip(cut, np.concatenate([cut[1:], [len(by)]]), strict=True):
            i = by[lo:hi]
            row = {"doc_id": 0, "at": 0, "stop": 0, "anchor": anchor[i[0]], "range": range_[i[0]], "shard": shard[i[0]]}
            yield pd.DataFrame([row | {"keys": keys[i].tobytes(), "owners": owners[i].tobytes()}])

    def rows(batches):
        held, size = [], 0
        for run in runs(batches, ["anchor", "shard"]):
            held.append(run)
            size += int(run["bytes"].map(len).sum())
            if size >= CHUNK_BYTES:
                yield from chunk(held)
                held, size = [], 0
        if held:
            yield from chunk(held)

    return rows


def merge_blocks(blocks: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """(doc_id, offset) of the windows that start earlier in another block; keys are sorted."""
    keys, owners = None, None
    later = []
    for new_keys, new_owners in blocks:
        if keys is None:
            keys, owners = new_keys, new_owners.copy()
            continue
        place = np.searchsorted(keys, new_keys)
        hit = keys[np.minimum(place, len(keys) - 1)] == new_keys
        hit &= place < len(keys)
        old, new = owners[place[hit]], new_owners[hit]
        newer = (new[:, 0] > old[:, 0]) | ((new[:, 0] == old[:, 0]) & (new[:, 1] > old[:, 1]))
        differ = (new != old).any(1)
        later.append(np.where(newer[:, None], new, old)[differ])
        owners[place[hit]] = np.where(newer[:, None], old, new)
        keys = np.insert(keys, place[~hit], new_keys[~hit])
        owners = np.insert(owners, place[~hit], new_owners[~hit], axis=0)
    return np.concatenate(later) if later else np.empty((0, 2), np.int64)


def _merged_shards(length: int):
    def rows(batches):
        for run in runs(batches, ["anchor", "range"]):
            blocks = (
                (np.frombuffer(k, f"S{length + 1}"), np.frombuffer(o, np.int64).reshape(-1, 2))
                for k, o in zip(run["keys"], run["owners"], strict=True)
            )
            later = merge_blocks(blocks)
            if len(later):
                yield pd.DataFrame({"doc_id": later[:, 0], "at": later[:, 1], "stop": later[:, 1] + length})

    return rows


def repeated_spans(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """(doc_id, at, stop): byte spans to remove. They may overlap. Ids are whole numbers, one per row."""
    if not GRAM <= length < 512:
        raise ValueError(f"length must be at least {GRAM} and below 512")
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    firsts = map_slices(source, "text", _first_contexts(length), _CONTEXT)
    order = ("anchor", "shape", "body", "doc_id", "at")
    split = firsts.repartition("anchor").sortWithinPartitions(*order).mapInPandas(
        tidy(_distinct_contexts(length, shard_rows)), "doc_id bigint, at bigint, stop bigint, shard bigint, anchor bigint, shape int"
    )
    split = stage(split, "contexts")
    columns = ("anchor", "shard", "at", "shape")
    marks = split.where("shard >= 0").groupBy("doc_id").agg(F.collect_list(F.struct(*columns)).alias("marks"))
    each = [F.col("marks")[c].alias(c) for c in columns]
    marked = source.join(marks, "doc_id").select("doc_id", "text", *each)
    cut = map_slices(marked, "text", _cut_contexts(length), "anchor bigint, shard bigint, doc_id bigint, at bigint, shape int, bytes binary")
    sorted_ = cut.repartition("anchor", "shard").sortWithinPartitions("anchor", "shard")
    found = stage(
        sorted_.mapInPandas(
            tidy(_shard_rows(length, shard_rows)),
            "doc_id bigint, at bigint, stop bigint, anchor bigint, range bigint, shard bigint, keys binary, owners binary",
        ),
        "shards",
    )
    blocks = found.where("range >= 0").select("anchor", "range", "shard", "keys", "owners")
    blocks = blocks.repartition("anchor", "range").sortWithinPartitions("anchor", "range", "shard")
    across = blocks.mapInPandas(tidy(_merged_shards(length)), "doc_id bigint, at bigint, stop bigint")
    spans = split.where("shard < 0").select("doc_id", "at", "stop")
    return spans.union(found.where("range < 0").select("doc_id", "at", "stop")).union(across)


def _cut(columns: list[str], schema: StructType, with_text: bool):
    def one(text, at, stop):
        raw = (text or "").encode("utf-8", "surrogatepass")
        if not at:
            return len(raw), 0, 0, raw
        _, begin, end = merged(np.zeros(len(at), np.int64), np.array(at), np.array(stop))
        ends = [0, *end.tolist()]
        kept = b"".join(raw[x:y] for x, y in zip(ends, [*begin.tolist(), len(raw)], strict=True))
        return len(raw), len(raw) - len(kept), len(begin), kept

    def rows(batches):
        for part in byte_slices(batches, "_text"):
            n, removed, spans, kept = zip(*map(one, *(part.column(c).to_pylist() for c in ("_text", "_at", "_stop"))), strict=True)
            found = [pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())]
            if with_text:
                found.append(pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), *found], names=schema.names)

    return rows


def remove_repeats(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    shard_rows: int = SHARD_ROWS,
    others: tuple[str, ...] = (),
    with_text: bool = False,
) -> DataFrame:
    """Per row: doc_id, ``others``, n_bytes, n_removed, n_spans (maximal removed runs), kept (the remaining bytes).

    ``with_text`` adds kept_text, the kept bytes as text. A cut can part a character; what is
    left of it goes too.
    """
    limit_batches(docs.sparkSession)
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"), *others)
    source = own_rows(named, "doc_id", "_text")
    spans = repeated_spans(source, ROW, "_text", length, shard_rows)
    spans = spans.groupBy(F.col("doc_id").alias(ROW)).agg(F.collect_list(F.struct("at", "stop")).alias("_spans"))
    spans = spans.select(ROW, F.col("_spans.at").alias("_at"), F.col("_spans.stop").alias("_stop"))
    plain = named.drop("_text")
    new = StructType.fromDDL("n_bytes bigint, n_removed bigint, n_spans bigint, kept binary" + ", kept_text string" * with_text).fields
    schema = StructType([*(StructField(f.name, f.dataType, True) for f in plain.schema.fields), *new])
    return source.join(spans, ROW, "left").mapInArrow(_cut(plain.columns, schema, with_text), schema)
