import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from hertzflow.llm import mixing
from hertzflow.llm.queries import QUERIES

WORD = re.compile("[^\x20\x09-\x0d]+")


def text(rng, n):
    return " ".join("w" * int(k) for k in rng.integers(1, 6, n))


def corpus(n=900, seed=4):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        # A third of all rows in one source, a null source, one source of few words.
        source = "hot" if rng.random() < 0.35 else [None, "a", "b", "Z", "é", "small"][int(rng.integers(6))]
        rows.append((i, source, text(rng, 1 if source == "small" else int(rng.integers(0, 60)))))
    return rows


def expected_targets(rows):
    size = defaultdict(int)
    for _, s, t in rows:
        size[s] += len(WORD.findall(t or ""))
    names = sorted((s for s in size if s is not None)) + [None] * (None in size)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, target, free = sum(size.values()), dict.fromkeys(names, 0.0), set(names)
    while free:
        left = total - sum(target[s] for s in names if s not in free)
        for s in free:
            target[s] = left * weight[s] / sum(weight[x] for x in free)
        over = {s for s in free if target[s] > 3 * size[s]}
        if not over:
            break
        for s in over:
            target[s] = 3.0 * size[s]
        free -= over
    return size, target


def frame(spark, rows, n=5):
    return spark.createDataFrame([(i, s, t, "x") for i, s, t in rows], "doc_id long, source string, text string, size string").repartition(n)


def check(rows, out, near):
    size, target = expected_targets(rows)
    got = defaultdict(int)
    assert len(out) == len(rows)
    for r in out:
        assert r.source_size == size[r.source] and np.isclose(r.target, target[r.source], rtol=1e-12)
        assert r.taken == r.repeats * r.size and 0 <= r.taken <= 3 * r.size
        low = int(target[r.source] / size[r.source] + 1e-9) if size[r.source] else 0
        assert low <= r.repeats <= low + 1
        got[r.source] += r.taken
    for s in size:
        assert abs(got[s] - target[s]) <= near, (s, got[s], target[s])


def test_words_per_text():
    texts = [None, "", " ", "a", " a b\tc\n", "é漢\xa0x y", "a\x0bb\x1cc", "b "]
    for part in (texts, texts[3:], ["", None], []):
        assert mixing.count_words(pa.array(part, pa.string())).tolist() == [len(WORD.findall(t or "")) for t in part]
    assert mixing.count_words(pa.array(texts, pa.string()).slice(2, 4)).tolist() == [len(WORD.findall(t)) for t in texts[2:6]]


def test_flight_keeps_totals_and_probabilities():
    rng = np.random.default_rng(1)
    size = rng.integers(0, 500, 700)
    p = rng.random(700)
    out = mixing.fly(p, size, rng)
    assert ((out > 0) & (out < 1)).sum() <= mixing.LANDING
    assert np.isclose(out.sum(), p.sum()) and np.isclose(out @ size, p @ size)
    landed = mixing.land(out, size.astype(float))
    assert set(np.unique(landed)) <= {0.0, 1.0} and abs(landed @ size - p @ size) <= 10
    few, weights = np.full(40, 0.3), np.arange(40) % 7
    mean = np.mean([mixing.fly(few, weights, np.random.default_rng(k), landing=2) for k in range(3000)], axis=0)
    assert np.abs(mean - 0.3).max() < 0.05
    same = mixing.fly(np.full(50, 0.5), np.full(50, 9), rng)
    assert np.isclose(same.sum(), 25)


@pytest.mark.parametrize("block,fan", [(2048, 128), (32, 4)])
def test_targets_are_met_and_reruns_agree(spark, monkeypatch, block, fan):
    monkeypatch.setattr(mixing, "BLOCK", block)
    monkeypatch.setattr(mixing, "FAN_IN", fan)
    rows = corpus()
    out = mixing.mix(frame(spark, rows)).collect()
    check(rows, out, near=1.0)
    again = mixing.mix(frame(spark, rows, 3)).collect()
    assert sorted((r.doc_id, r.taken) for r in out) == sorted((r.doc_id, r.taken) for r in again)


def test_repeated_rows_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 16)
    monkeypatch.setattr(mixing, "FAN_IN", 2)
    rows = [(7, "a", "one two three")] * 200 + [(None, "b", "x y")] * 90 + [(9007199254740993, None, None)] + [(9007199254740995, "c", "p q r s")] * 3
    out = mixing.mix(frame(spark, rows), others=("text",)).collect()
    check(rows, out, near=3.0)
    assert sorted((r.doc_id or 0) for r in out) == sorted((i or 0) for i, _, _ in rows)
    assert {r.text for r in out if r.doc_id == 7} == {"one two three"}


def test_nothing_to_mix(spark):
    assert mixing.mix(frame(spark, [])).count() == 0
    out = mixing.mix(frame(spark, [(1, "a", ""), (2, None, None)])).collect()
    assert {(r.doc_id, r.size, r.target, r.taken) for r in out} == {(1, 0, 0.0, 0), (2, 0, 0.0, 0)}


def test_query(spark, tmp_path):
    rows = corpus(300)
    frame(spark, rows).drop("size").selectExpr("*", "'en' AS lang", "1L AS n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["op11_mixing"](spark, str(tmp_path))
    assert out.columns[:5] == ["doc_id", "size", "source_size", "target", "taken"]
    check(rows, out.collect(), near=1.0)
