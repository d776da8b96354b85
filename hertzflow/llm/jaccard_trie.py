"""N-gram Jaccard join over prefix trees.

A document's set holds its distinct word n-grams. Two documents link when
100 * intersection >= percent * union. The join goes in steps that each see all rows:

1. Every text becomes its set; equal sets share one set id, so copies are never compared.
2. N-grams have one order for the whole corpus: first those whose hash falls into
   ``SHARE`` sixteenths of all, by the number of sets that hold them, then the others by
   hash. Linked sets must share an n-gram of their prefixes in it. As the first part is
   longer than a prefix, only its n-grams are counted, and a set with enough n-grams of
   its own leaves here. Sets that share a prefix n-gram and whose sizes allow a link are
   chained, and chains are closed to families; all links lie within families.
3. A family's sets are shipped once and stored in a trie. Each set then traverses the
   trie: sets below a node share the overlap counted on the way to it, and a subtree is
   pruned when its overlap plus what can still be shared stays under the bound. A family
   beyond ``block_ngrams`` is split into blocks, and pairs of blocks are joined the same
   way, so no task holds more than two blocks.
4. A set that is already connected to all of a trie needs no further traversal: each task
   returns a spanning forest of the links it found, and their components are the classes.

Nothing of unknown size is broadcast: the family table only where it has at most
``BROADCAST_ROWS`` rows, else the join is shuffled. Counts stop at ``MOST`` sets, as a
tie, so that no task holds all sets of an n-gram. Nulls and texts without words have an
empty set and link with nothing. Texts of fewer than n words have one n-gram, the whole
sequence. Rows count by their texts, so rows that repeat a doc_id are reported each, linked
or not as their own texts are, and null ids stay; a class of null ids alone is named by null.
N-grams are compared by 64-bit hashes. Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stage
from .batches import map_slices, tidy, with_columns
from .components import components, links_of
from .rows import text_key
from .words import mix, runs, shingle_hashes, word_hashes

SHARE = 5
MOST = 1 << 15
BROADCAST_ROWS = 500_000
BLOCK_NGRAMS = 1_000_000
TEXTS = 500


def text_sets(texts, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    words, start = word_hashes(texts)
    for lo, hi in zip(start[:-1], start[1:], strict=True):
        yield np.unique(shingle_hashes(words[lo:hi], size))


def set_id(ngrams: np.ndarray) -> int:
    both = np.array([ngrams.sum(), np.bitwise_xor.reduce(mix(ngrams + np.uint64(1)))], np.uint64)
    return int(mix(mix(both[:1]) + both[1:] + np.uint64(len(ngrams)))[0].astype(np.int64))


def needed(total, percent: int):
    """Smallest intersection of two sets whose sizes sum to ``total``."""
    return -(-percent * total // (100 + percent))


def _parts(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    for lo in range(0, len(pdf), TEXTS):
        yield pdf.iloc[lo : lo + TEXTS]


def _profiles(size: int):
    def columns(texts: pa.Array):
        found = [(len(x), set_id(x) if len(x) else None) for x in text_sets(texts.to_pylist(), size)]
        return [pa.array([n for n, _ in found], pa.int64()), pa.array([i for _, i in found], pa.int64())]

    return columns


def leading(ngrams: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The n-grams that the prefix can be taken from, and how many of them it leaves over."""
    n = len(ngrams)
    prefix = n + (-percent * n // 100) + 1
    counted = (ngrams & np.uint64(15)) < SHARE
    front = ngrams[counted]
    if len(front) < prefix:
        front = np.concatenate([front, ngrams[~counted][: prefix - len(front)]])
    return front, len(front) - prefix


def _leads(size: int, percent: int):
    """(token, set_id, shape) of each set of a partition; shape is n and what the prefix leaves over."""

    def rows(batches):
        seen = set()
        for pdf in batches:
            for part in _parts(pdf):
                tokens, ids, shapes = [], [], []
                for ngrams in text_sets(part["text"], size):
                    if not len(ngrams) or (me := set_id(ngrams)) in seen:
                        continue
                    seen.add(me)
                    front, over = leading(ngrams, percent)
                    tokens.append(front)
                    ids.append(np.full(len(front), me, np.int64))
                    shapes.append(np.full(len(front), len(ngrams) << 32 | over, np.int64))
                if tokens:
                    yield pd.DataFrame(
                        {
                            "token": np.concatenate(tokens).view(np.int64),
                            "set_id": np.concatenate(ids),
                            "shape": np.concatenate(shapes),
                        }
                    )

    return rows


def _counted(batches):
    """Of a partition sorted by (token, set_id): the rows of tokens that several sets hold,
    with their number of sets. Tokens outside the counted part come after all others."""
    held = None  # the rows of the last token so far, up to MOST of them
    over = False  # whether it has more, so that its rows pass as they come
    for pdf in batches:
        if not len(pdf):
            continue
        if held is not None:
            pdf = pd.concat([held, pdf], ignore_index=True)
        token, ids = pdf["token"].to_numpy(), pdf["set_id"].to_numpy()
        new = np.concatenate([[True], token[1:] != token[:-1]])
        distinct = new | np.concatenate([[True], ids[1:] != ids[:-1]])
        skip_first = over  # then the held row was passed on already
        run = np.cumsum(new) - 1
        count = np.bincount(run, weights=distinct).astype(np.int64)
        if over:
            count[0] = MOST
        count = np.minimum(count, MOST)
        last = run == run[-1]
        full = count[-1] >= MOST
        out = distinct & (count[run] >= 2) & (~last | full)
        if skip_first:
            out[0] = False
        yield _with_count(pdf[out], count[run][out])
        over = bool(full)
        held = pdf[last & distinct].iloc[-1:] if over else pdf[last & distinct]
    if held is not None and not over and len(held) >= 2:
        yield _with_count(held, np.full(len(held), len(held), np.int64))


def _with_count(rows: pd.DataFrame, count: np.ndarray) -> pd.DataFrame:
    counted = (rows["token"].to_numpy().view(np.uint64) & np.uint64(15)) < SHARE
    return rows.assign(sets=np.where(counted, count, MOST + 1))


def _prefixes(batches):
    """Of a partition sorted by (set_id, sets, token): the prefix tokens that other sets hold too."""
    for run in _whole_sets(batches):
        ids = run["set_id"].to_numpy()
        new = np.concatenate([[True], ids[1:] != ids[:-1]])
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(ids)))
        place = np.arange(len(ids)) - np.repeat(start, size)
        shape = run["shape"].to_numpy()
        chosen = place < np.repeat(size, size) - (shape & 0xFFFFFFFF)
        yield pd.DataFrame({"token": run["token"].to_numpy()[chosen], "n": shape[chosen] >> 32, "set_id": ids[chosen]})


def _whole_sets(batches):
    """Batches that end where a set ends."""
    held = None
    for pdf in batches:
        if not len(pdf):
            continue
        pdf = pd.concat([held, pdf], ignore_index=True) if held is not None else pdf
        last = pdf["set_id"].to_numpy() == pdf["set_id"].iloc[-1]
        if not last.all():
            yield pdf[~last]
        held = pdf[last]
    if held is not None:
        yield held


def _chains(percent: int):
    """Neighbours within a token's sets by size. Where a size is under ``percent`` of the
    next, no smaller set can link with that or a larger one, and the chain may break."""

    def rows(batches):
        last = None
        for pdf in batches:
            if last is not None:
                pdf = pd.concat([last, pdf], ignore_index=True)
            token, n, ids = (pdf[c].to_numpy() for c in ("token", "n", "set_id"))
            near = (token[1:] == token[:-1]) & (ids[1:] != ids[:-1])
            near &= 100 * n[:-1].astype(np.int64) >= percent * n[1:].astype(np.int64)
            yield pd.DataFrame({"a": ids[1:][near], "b": ids[:-1][near]})
            last = pdf.iloc[-1:]

    return rows


class Trie:
    """A radix tree over sets of ranks, stored as arrays."""

    def __init__(self, sets: list[np.ndarray]):
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        edges, parents, ends, leaf = [np.empty(0, np.int64)], [-1], [0], [-1]
        path, before = [0], np.empty(0, np.int64)
        for i in order:
            now = sets[i]
            m = min(len(now), len(before))
            differ = np.flatnonzero(now[:m] != before[:m])
            common = int(differ[0]) if len(differ) else m
            split = None
            while ends[path[-1]] > common:
                split = path.pop()
            top = path[-1]
            if ends[top] < common:
                # The edge to ``split`` parts within.
                cut = common - ends[top]
                edges.append(edges[split][:cut])
                parents.append(top)
                ends.append(common)
                leaf.append(-1)
                top = len(edges) - 1
                edges[split], parents[split] = edges[split][cut:], top
                path.append(top)
            edges.append(now[common:])
            parents.append(top)
            ends.append(len(now))
            leaf.append(i)
            path.append(len(edges) - 1)
            before = now
        self.ends, self.leaf = np.array(ends), np.array(leaf)
        self.parents = np.array(parents)
        self.smallest = np.where(self.leaf >= 0, self.ends, 1 << 40)
        self.largest = np.where(self.leaf >= 0, self.ends, 0)
        for v in sorted(range(1, len(ends)), key=lambda v: -ends[v]):
            self._lift(v)
        # A set that is the beginning of others ends on the same depth as its parent.
        for v in sorted(range(1, len(ends)), key=lambda v: -ends[v]):
            self._lift(v)
        self.last = np.array([int(e[-1]) if len(e) else -1 for e in edges])
        self.start = np.concatenate([[0], np.cumsum([len(e) for e in edges])])
        self.tokens = np.concatenate(edges)
        self.by_parent = np.argsort(self.parents, kind="stable")
        self.child_start = np.searchsorted(self.parents[self.by_parent], np.arange(len(ends) + 1))

    def _lift(self, v: int) -> None:
        p = self.parents[v]
        self.smallest[p] = min(self.smallest[p], self.smallest[v])
        self.largest[p] = max(self.largest[p], self.largest[v])

    def linked(self, probe: np.ndarray, held: np.ndarray, percent: int) -> np.ndarray:
        """The stored sets linked with ``probe``. ``held`` marks its ranks."""
        n = len(probe)
        nodes, shared, out = np.zeros(1, np.int64), np.zeros(1, np.int64), []
        while len(nodes):
            first, count = self.child_start[nodes], self.child_start[nodes + 1] - self.child_start[nodes]
            total = int(count.sum())
            if not total:
                break
            inner = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
            nodes, shared = self.by_parent[np.repeat(first, count) + inner], np.repeat(shared, count)
            fits = (100 * self.largest[nodes] >= percent * n) & (percent * self.smallest[nodes] <= 100 * n)
            nodes, shared = nodes[fits], shared[fits]
            size = self.start[nodes + 1] - self.start[nodes]
            at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.start[nodes], size)
            seen = np.concatenate([[0], np.cumsum(held[self.tokens[at]])])
            upto = np.cumsum(size)
            shared = shared + seen[upto] - seen[upto - size]
            left = n - np.searchsorted(probe, self.last[nodes], side="right")
            left = np.where(size > 0, left, n)
            bound = shared + np.minimum(left, self.largest[nodes] - self.ends[nodes])
            open_ = bound >= needed(n + self.smallest[nodes], percent)
            nodes, shared = nodes[open_], shared[open_]
            full = (self.leaf[nodes] >= 0) & (shared >= needed(n + self.ends[nodes], percent))
            out.append(self.leaf[nodes[full]])
        return np.concatenate(out) if out else np.empty(0, np.int64)


def forest_links(stored: list[np.ndarray], probes: list[np.ndarray] | None, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between ``stored`` and ``probes`` (None: among ``stored``).

    Members are numbered through, the probes after the stored ones.
    """
    members = stored if probes is None else stored + probes
    flat = np.concatenate(members)
    distinct, codes, df = np.unique(flat, return_inverse=True, return_counts=True)
    # Shared n-grams first, so that sets have long beginnings in common.
    rank = np.empty(len(distinct), np.int64)
    rank[np.lexsort((distinct, -df))] = np.arange(len(distinct))
    cut = np.cumsum([len(s) for s in members])[:-1]
    ranked = [np.sort(s) for s in np.split(rank[codes], cut)]
    trie = Trie(ranked[: len(stored)])
    group = np.arange(len(members))
    held = np.zeros(len(distinct), np.int8)
    links = []
    for i in range(0 if probes is None else len(stored), len(members)):
        if (group[: len(stored)] == group[i]).all():
            continue
        held[ranked[i]] = 1
        for j in trie.linked(ranked[i], held, percent).tolist():
            if group[i] != group[j]:
                links.append((i, j))
                group[group == group[j]] = group[i]
        held[ranked[i]] = 0
    return links


def _family_links(percent: int):
    def rows(batches):
        for run in runs(batches, ["family", "i", "j"]):
            run = run.drop_duplicates("set_id")
            sets = [np.frombuffer(x, np.int64) for x in run["ngrams"]]
            ids, block = run["set_id"].to_numpy(), run["block"].to_numpy()
            i, j = run["i"].iloc[0], run["j"].iloc[0]
            if len(sets) < 2:
                continue
            if i == j:
                links = forest_links(sets, None, percent)
            else:
                left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
                if not len(left) or not len(right):
                    continue
                ids = ids[np.concatenate([left, right])]
                links = forest_links([sets[k] for k in left], [sets[k] for k in right], percent)
            if links:
                a, b = np.array(links).T
                yield pd.DataFrame({"a": ids[a], "b": ids[b]})

    return rows


def _family_sets(size: int):
    """The sets of some texts, each set once per task. A text that only shares another one's hash is left."""

    def rows(batches):
        seen = set()
        for pdf in batches:
            for part in _parts(pdf):
                sets = list(text_sets(part["text"], size))
                own = [len(s) > 0 and set_id(s) == i and not (i in seen or seen.add(i)) for s, i in zip(sets, part["set_id"].tolist(), strict=True)]
                packed = [s.astype(np.int64).tobytes() for s, x in zip(sets, own, strict=True) if x]
                yield part.drop(columns="text")[own].assign(ngrams=packed)

    return rows


def jaccard_classes(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    size: int = 5,
    percent: int = 80,
    block_ngrams: int = BLOCK_NGRAMS,
) -> DataFrame:
    """Per row: doc_id, n_shingles (set size), set_id (null for empty sets; equal for equal
    sets), component_id, the smallest doc_id reachable by links, class (a number that linked
    rows share, null for empty sets) and text_key."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), text_key(F.col(text)).alias("text_key"))
    profile = stage(with_columns(source, "text", "n bigint, set_id bigint", _profiles(size)).drop("text"), "set-profiles")

    leads = map_slices(source.select("text"), "text", _leads(size, percent), "token bigint, set_id bigint, shape bigint")
    counted = leads.repartition("token").sortWithinPartitions("token", "set_id").mapInPandas(
        tidy(_counted), "token bigint, set_id bigint, shape bigint, sets int"
    )
    by_set = counted.repartition("set_id").sortWithinPartitions("set_id", "sets", "token")
    prefixes = by_set.mapInPandas(tidy(_prefixes), "token bigint, n bigint, set_id bigint")
    sorted_ = prefixes.repartition("token").sortWithinPartitions("token", "n", "set_id")
    families = components(links_of(sorted_, _chains(percent)))
    families = families.select(F.col("node").alias("set_id"), F.col("component").alias("family"))

    first = profile.where("set_id IS NOT NULL").groupBy("set_id").agg(F.min("text_key").alias("text_key"), F.max("n").alias("n"))
    members = stage(first.join(families, "set_id"), "family-members")
    totals = members.groupBy("family").agg((F.floor(F.sum("n") / block_ngrams) + 1).alias("blocks"))
    placed = members.drop("n").join(totals, "family").withColumn("block", F.pmod("set_id", "blocks"))
    placed = stage(placed, "family-blocks")
    texts = source.join(F.broadcast(placed) if placed.count() <= BROADCAST_ROWS else placed, "text_key")
    held = texts.select("family", "set_id", "block", "blocks", "text")
    sets = map_slices(held, "text", _family_sets(size), "family bigint, set_id bigint, block bigint, blocks bigint, ngrams binary")
    pairs = sets.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)"))).select(
        "family", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "set_id", "ngrams"
    )
    blocks = pairs.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "set_id")
    classes = components(links_of(blocks, _family_links(percent)))
    classes = classes.select(F.col("node").alias("set_id"), F.col("component").alias("class"))

    classed = stage(profile.join(classes, "set_id", "left").withColumn("class", F.coalesce("class", "set_id")), "classes")
    least = classed.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("component_id"))
    component = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return classed.join(least, "class", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), "set_id", component.alias("component_id"), "class", "text_key"
    )
