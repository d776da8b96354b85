import random

import numpy as np
import pytest

from hertzflow.llm import suffix_dedup as S


def brute(docs, length):
    seen, out = set(), {}
    texts = {d: (t or "").encode() for d, t in docs}
    for d in sorted(texts):
        raw, gone = texts[d], np.zeros(len(texts[d]) + 1, bool)
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            if w in seen:
                gone[i : i + length] = True
            seen.add(w)
        runs = int((np.diff(gone.astype(int)) == 1).sum() + gone[0])
        out[d] = (len(raw), int(gone.sum()), runs, bytes(np.frombuffer(raw, np.uint8)[~gone[:-1]]))
    return out


def corpus():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(30) for _ in range(6)]
    docs = [None, "", "x", "a" * 700, "a" * 99, "a" * 100, "ab" * 300, "long " + "b" * 3000]
    docs += [prose(rng.randint(5, 120)) for _ in range(40)]
    docs += [prose(9) + rng.choice(passages) + prose(9) + rng.choice(passages)[: rng.randint(20, 200)] for _ in range(60)]
    docs += [docs[20], docs[21], docs[21], passages[0], passages[0] * 3]
    line = "one line that very many documents share, in front of other words every time. "
    docs += [prose(3) + line + prose(20) for _ in range(60)]
    order = list(range(len(docs)))
    rng.shuffle(order)
    return [(i, docs[k]) for i, k in enumerate(order)]


@pytest.mark.parametrize("shard_rows,slice_bytes,length", [(8192, 1 << 21, 100), (5, 700, 100), (3, 1 << 21, 40)])
def test_equals_brute_force(spark, monkeypatch, shard_rows, slice_bytes, length):
    monkeypatch.setattr(S, "SLICE_BYTES", slice_bytes)
    monkeypatch.setattr(S, "CHUNK_BYTES", slice_bytes)
    docs = corpus()
    df = spark.createDataFrame([(*d, 1, "c") for d in docs], "doc_id long, text string, at int, anchor string").repartition(5)
    got = {
        r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept))
        for r in S.remove_repeats(df, length=length, shard_rows=shard_rows).collect()
    }
    want = brute(docs, length)
    assert len(got) == len(docs)
    for d in want:
        assert got[d] == want[d], (d, docs[d][1])


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 30, 500):
        raw = rng.integers(0, 3, n).astype(np.uint8)
        text = raw.tobytes()
        order, group = S.suffix_array(raw, max(n, 9))
        assert [text[i:] for i in order] == sorted(text[i:] for i in range(n))
        if n:
            shared = S.common_prefixes(raw, order, group, 9)
            for a, b in zip(order[:-1], order[1:], strict=True):
                k = 0
                while k < 9 and text[a + k : a + k + 1] == text[b + k : b + k + 1] != b"":
                    k += 1
                assert shared[b] == k


def test_repeated_rows_and_empty_table(spark):
    text = "".join(random.Random(1).choices("abcdefgh", k=150))
    df = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in S.remove_repeats(df).collect()) == [(1, 0), (1, 0), (2, 150)]
    assert S.remove_repeats(df.limit(0)).count() == 0
