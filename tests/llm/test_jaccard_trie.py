import random
import re

import numpy as np
import pytest

from hertzflow.llm.components import components
from hertzflow.llm.jaccard_trie import forest_links, jaccard_classes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size=5):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute(docs, percent=80):
    sets = {d: shingles(t) for d, t in docs}
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                lo, hi = sorted((root(a), root(b)))
                up[hi] = lo
    return {d: (len(sets[d]), root(d)) for d in ids}


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") * rng.randint(1, 3)
    docs, base = [], [[word() for _ in range(rng.choice([3, 5, 9, 40, 80, 200]))] for _ in range(25)]
    for words in base:
        for _ in range(rng.choice([1, 1, 2, 8])):
            w = list(words)
            for _ in range(rng.randint(0, max(1, len(w) // 40))):
                w[rng.randrange(len(w))] = word()
            docs.append(" ".join(w))
    docs += [None, "", " \t ", "one two", "ONE two", "one  two ", " ", docs[0], docs[0].upper(), "a" * 5000, "x " * 9000]
    docs += ["shared passage of some length here " * 3 + " ".join(word() for _ in range(4)) for _ in range(12)]
    return list(enumerate(docs))


@pytest.mark.parametrize("block", [1_000_000, 60])
def test_equals_brute_force(spark, block):
    docs = corpus()
    df = spark.createDataFrame([(*d, 7) for d in docs], "doc_id long, text string, set_id int").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_classes(df, block_ngrams=block).collect()}
    assert got == brute(docs)


def test_forest_equals_all_pairs():
    rng = np.random.default_rng(2)
    for trial in range(40):
        base = rng.choice(10_000, 60, replace=False).astype(np.int64)
        sets = []
        for _ in range(25):
            s = base[: rng.integers(1, 61)].copy()
            s[rng.random(len(s)) < 0.1] += 10_000
            sets.append(np.unique(s))
        sets = list({s.tobytes(): s for s in sets}.values())

        def close(a, b):
            both = len(np.intersect1d(a, b))
            return 100 * both >= 80 * (len(a) + len(b) - both)

        half = len(sets) // 2 if trial % 2 else None
        pairs = [
            (i, j)
            for i in range(len(sets))
            for j in range(i)
            if (half is None or (j < half <= i)) and close(sets[i], sets[j])
        ]
        found = forest_links(sets[:half], sets[half:], 80) if half else forest_links(sets, None, 80)
        assert all(close(sets[a], sets[b]) for a, b in found)

        def label(links):
            g = list(range(len(sets)))
            for a, b in links:
                g = [g[a] if x == g[b] else x for x in g]
            return [g.index(x) for x in g]

        assert label(pairs) == label(found)


def test_components(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(5, 900), (900, 7), (3, 3)] + [(1000, x) for x in range(1001, 1300)]
    df = spark.createDataFrame(links, "a long, b long").repartition(6)
    got = {r.node: r.component for r in components(df).collect()}
    want = {i: 100 for i in range(100, 161)} | {5: 5, 7: 5, 900: 5} | {x: 1000 for x in range(1000, 1300)}
    assert got == want
    assert components(df.limit(0)).count() == 0


def test_empty_table(spark):
    assert jaccard_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_counts_over_batches_and_beyond_the_most(monkeypatch):
    import pandas as pd

    from hertzflow.llm import jaccard_trie as J

    monkeypatch.setattr(J, "MOST", 4)
    rng = random.Random(1)
    rows = sorted((rng.randint(0, 12) * 16, rng.randint(0, 9), 0) for _ in range(150))
    pdf = pd.DataFrame(rows, columns=["token", "set_id", "shape"], dtype="int64")
    sets = {t: {s for u, s, _ in rows if u == t} for t, _, _ in rows}
    want = sorted((t, s, min(len(sets[t]), 4)) for t in sets for s in sets[t] if len(sets[t]) > 1)
    for step in (1, 2, 3, 7, 40, 200):
        parts = J._counted(pdf.iloc[i : i + step] for i in range(0, len(pdf), step))
        got = sorted((int(t), int(s), int(k)) for p in parts for t, s, k in zip(p["token"], p["set_id"], p["sets"]))
        assert got == want, step
