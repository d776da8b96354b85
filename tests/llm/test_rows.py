"""Null, 64-bit and repeated ids: rows of any of them have the results of their own contents."""

import hashlib
import random

import numpy as np
import pytest

import corpus_pipeline
from hertzflow.llm import chat_tree, cross_polytope, decontaminate, jaccard_trie, rows, suffix_dedup, warc

BIG = (1 << 53) + 1
rng = random.Random(6)
word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
A, B, C = (" ".join(word() for _ in range(60)) for _ in range(3))
IDS = [None, BIG, BIG + 2, 1, 1]


def documents(spark, found):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in found], "doc_id long, text string, lang string, source string, n_chars long")


def test_suffix_dedup(spark):
    found = [(1, A), (5, A), (5, B), (BIG, C), (BIG + 2, C), (None, C[:120]), (None, None)]
    out = {(r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(documents(spark, found)).collect()}
    a, b, c = len(A), len(B), len(C)
    # The null row comes first, so its bytes are removed from both later ones, and all of the last.
    assert out == {(1, a, 0), (5, a, a), (5, b, 0), (None, 120, 0), (BIG, c, 120), (BIG + 2, c, c), (None, 0, 0)}
    twice = suffix_dedup.remove_repeats(documents(spark, [(1, A), (1, A)])).collect()
    assert [r.n_removed for r in twice] == [0, 0]


def test_jaccard(spark):
    found = [(1, A), (1, B), (3, B + " more"), (BIG, C), (BIG + 2, C), (None, A + " x"), (None, "")]
    out = jaccard_trie.jaccard_classes(documents(spark, found))
    got = sorted(((r.doc_id or 0), r.n_shingles, r.component_id or 0) for r in out.collect())
    n = lambda t: len(t.split()) - 4
    assert got == sorted([(1, n(A), 1), (1, n(B), 1), (3, n(B) + 1, 1), (BIG, n(C), BIG), (BIG + 2, n(C), BIG), (0, n(A) + 1, 1), (0, 0, 0)])


def test_decontamination(spark):
    item = " ".join(B.split()[20:30])
    found = [(2, "clean"), (2, item), (None, A + " " + item), (None, A), (BIG, item), (BIG + 2, "clean")]
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    out = decontaminate.contamination(documents(spark, found), items).collect()
    got = sorted((r.doc_id or 0, r.n_words, r.n_hit, r.contaminated) for r in out)
    assert got == sorted([(2, 1, 0, False), (2, 10, 10, True), (0, 70, 10, True), (0, 60, 0, False), (BIG, 10, 10, True), (BIG + 2, 1, 0, False)])


def test_cross_polytope(spark):
    g = np.random.default_rng(2)
    x, y, z = g.standard_normal((3, 40))
    close = x + 1e-3 * g.standard_normal(40)
    found = [(1, x), (1, y), (BIG, z), (BIG + 2, z + 1e-3), (None, close), (None, None), (9, z * 1e-200), (10, (z + 1e-3) * 1e200)]
    rows_ = [(i, None if v is None else [float(c) for c in v], 3, "x") for i, v in found]
    df = spark.createDataFrame(rows_, "vec_id long, embedding array<double>, label int, n_links string").repartition(3)
    out = sorted(((r.vec_id or 0), r.n_links, r.component_id or 0, r.kept) for r in cross_polytope.near_duplicates(df).collect())
    assert out == sorted([(1, 1, 1, True), (1, 0, 1, True), (0, 1, 1, False), (0, 0, 0, True), (9, 3, 9, True), (10, 3, 9, False), (BIG, 3, 9, False), (BIG + 2, 3, 9, False)])


@pytest.mark.parametrize("hashes", [1, 4, None])
def test_labels_do_not_change_each_other(spark, hashes):
    g = np.random.default_rng(5)
    base = g.standard_normal((60, 16))
    near = base + 0.12 * g.standard_normal((60, 16))
    large = g.standard_normal((3000, 16))
    make = lambda i, v, label: (i, [float(c) for c in v], label)
    small = [make(i, v, 1) for i, v in enumerate(np.concatenate([base, near]))]
    alone = spark.createDataFrame(small, "vec_id long, embedding array<double>, label int")
    both = spark.createDataFrame(small + [make(1000 + i, v, 2) for i, v in enumerate(large)], alone.schema)
    one, two = ({r.vec_id: r.n_links for r in cross_polytope.near_duplicates(x, hashes=hashes).collect()} for x in (alone, both))
    assert all(two[i] == n for i, n in one.items())
    if hashes is None:
        every = np.concatenate([base, near])
        unit = every / np.linalg.norm(every, axis=1, keepdims=True)
        assert sum(one.values()) >= 0.98 * ((unit @ unit.T >= 0.93).sum() - 120)


def test_warc(spark, tmp_path):
    html = "x" * 2000
    found = [(BIG, "u", html), (BIG + 2, "u", html), (None, "u", html), (4, None, None)]
    warc.write_archives(spark.createDataFrame(found, "page_id long, url string, html string").coalesce(1), f"{tmp_path}/w")
    out = warc.read_archives(spark, f"{tmp_path}/w").collect()
    assert sorted(((r.page_id or 0), r.record_type, r.refers_to or 0) for r in out) == sorted(
        [(BIG, "revisit", BIG + 2), (BIG + 2, "response", 0), (0, "response", 0), (4, "response", 0)]
    )
    assert {r.problem for r in out} == {None}


def test_chats(spark):
    long = "[a\\]" * 250_000
    found = [(BIG, 0, "user", "hi"), (BIG + 2, 0, "user", "hi"), (None, 0, long, long), (None, 1, "assistant", long)]
    chats = spark.createDataFrame(found, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat_tree.digests(chat_tree.read_back(chat_tree.format_chats(chats))).collect()}
    assert set(out) == {None, BIG, BIG + 2}
    sha = lambda *turns: hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
    assert out[BIG].turns_sha256 == out[BIG + 2].turns_sha256 == sha(("user", "hi"))
    assert out[None].turns_sha256 == sha((long, long), ("assistant", long)) and out[None].loss_chars == len(long)


def test_own_rows(spark):
    plain = documents(spark, [(BIG, A), (3, B)])
    assert {(r.doc_id, r._row) for r in rows.own_rows(plain, "doc_id", "text").collect()} == {(BIG, BIG), (3, 3)}
    odd = documents(spark, [(5, A), (None, B), (5, C), (BIG, A), (5, A)])
    out = sorted(rows.own_rows(odd, "doc_id", "text").collect(), key=lambda r: r._row)
    assert [r.doc_id for r in out] == [None, 5, 5, 5, BIG]
    assert len({r._row for r in out}) == 4 and len({r._row for r in out if r.text == A and r.doc_id == 5}) == 1


def test_pipeline_stages(spark, tmp_path):
    item = " ".join(B.split()[:12])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    near = corpus_pipeline.drop_near_duplicates
    found = [(1, A), (1, B), (1, A + " x"), (3, B + " more"), (None, C), (None, C), (4, C + " y"), (None, ""), (6, "")]
    out = near(spark, documents(spark, found), str(tmp_path))
    kept = sorted((r.doc_id or 0, r.text[:8]) for r in out.collect())
    assert len(kept) == 5 and [i for i, t in kept if not t] == [0, 6]
    assert {t for _, t in kept if t} == {A[:8], B[:8], C[:8]} and out.columns == documents(spark, []).columns
    found = [(2, "clean"), (2, item), (None, A + " " + item), (None, A), (BIG, item)]
    out = corpus_pipeline.drop_contaminated(spark, documents(spark, found), str(tmp_path))
    assert sorted((r.doc_id or 0, r.text) for r in out.collect()) == sorted([(2, "clean"), (0, A)])
