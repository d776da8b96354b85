import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from hertzflow.llm import kneser_ney as K

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) + ["</s>"]


def brute(docs):
    train = [words(t) for _, t, y in docs if y]
    count = Counter(w for d in train for w in d)
    pair = Counter(p for d in train for p in zip(["<s>", *d], d))
    context, begins, ends = Counter(), defaultdict(Counter), Counter()
    for (a, b), c in pair.items():
        context[a] += c
        begins[a][min(c, 3)] += 1
        ends[b] += 1
    of = lambda values: [sum(v == k for v in values) for k in (1, 2, 3, 4)]
    d2, d1 = K.discounts(of(pair.values())), K.discounts(of(ends.values()))
    n_pairs, n, v = len(pair), sum(count.values()), len(count)
    rest = sum(d1[min(c, 3)] for c in ends.values()) / n_pairs if n_pairs else 0

    def p(a, b):
        low = max(ends[b] - d1[min(ends[b], 3)], 0) / n_pairs + rest / (v + 1) if n_pairs else 1 / (v + 1)
        if not context[a]:
            return low
        c = pair[a, b]
        return max(c - d2[min(c, 3)], 0) / context[a] + sum(d2[k] * m for k, m in begins[a].items()) / context[a] * low

    out = []
    for i, t, y in docs:
        w = words(t)
        base = sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        out.append((i, y, len(w), sum(count[x] > 0 for x in w), n, base, sum(math.log10(p(a, b)) for a, b in zip(["<s>", *w], w))))
    vocabulary = [*count, "<unknown>"]
    if train:
        for a in ("<s>", train[0][0], "never seen"):
            assert sum(p(a, b) for b in vocabulary) == pytest.approx(1)
    return sorted(out)


def corpus():
    rng = random.Random(4)
    vocabulary = ["the", "of", "and", "Über", "x,", "漢", "it's"] + [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 60))) for _ in range(60)]
    texts += [None, "", " \n ", "THE the", texts[0], "unseen words only"]
    return [(i, t, rng.random() < 0.8) for i, t in enumerate(texts)]


@pytest.mark.parametrize("batch,shard", [(4_000_000, 500_000), (300, 50)])
def test_equals_brute_force(spark, monkeypatch, batch, shard):
    monkeypatch.setattr(K, "BATCH_CHARS", batch)
    monkeypatch.setattr(K, "SHARD_TOKENS", shard)
    docs = [d for d in corpus() if batch > 1000 or len(d[1] or "") < batch]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, y boolean, score int").repartition(3)
    got = sorted(
        (r.doc_id, r.trains, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score)
        for r in K.score(df, F.col("y")).collect()
    )
    for g, w in zip(got, brute(docs), strict=True):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:])


def test_a_cut_text_is_added_up(spark, monkeypatch):
    monkeypatch.setattr(K, "BATCH_CHARS", 100)
    text = " ".join(f"w{i % 9}" for i in range(200))
    df = spark.createDataFrame([(1, text, True), (2, "w1 w2", False)], "doc_id long, text string, y boolean")
    rows = {r.doc_id: r for r in K.score(df, F.col("y")).collect()}
    assert (rows[1].n_tokens, rows[1].n_known, rows[1].train_tokens) == (201, 201, 201)
    assert rows[2].n_tokens == 3 and rows[2].score < 0


def test_no_training_text_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None)], "doc_id long, text string")
    rows = K.score(df, F.lit(False)).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in rows) == [(1, 3, 0, 0), (1, 3, 0, 0), (2, 1, 0, 0)]
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)
    assert K.score(df.limit(0), F.lit(True)).count() == 0


def test_null_ids_are_kept_and_large_ids_exact(spark):
    big = 2**53 + 1
    df = spark.createDataFrame([(None, "a b", True), (big, "a c", True), (None, None, None)], "doc_id long, text string, y boolean")
    rows = K.score(df.coalesce(1), F.col("y")).collect()
    key = lambda r: (r[0] is None, r[1])
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.trains) for r in rows), key=key)
    assert got == [(big, 3, 3, True), (None, 1, 1, False), (None, 3, 3, True)]


def test_cut_texts_equal_brute_force_and_repeats_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(K, "BATCH_CHARS", 40)
    monkeypatch.setattr(K, "SHARD_TOKENS", 50)
    docs = corpus()[:30] + [(100, " " * 90 + "the of x,\n" * 12, True), (100, " " * 90 + "the of x,\n" * 12, True), (101, "w1 " * 60, False)]
    df = spark.createDataFrame(docs, "doc_id long, text string, y boolean").repartition(2)
    got = sorted(
        (r.doc_id, r.trains, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score)
        for r in K.score(df, F.col("y")).collect()
    )
    for g, w in zip(got, brute(docs), strict=True):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:])
