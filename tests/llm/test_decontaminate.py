import random
import re

import pytest

from hertzflow.llm import decontaminate
from hertzflow.llm.decontaminate import contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10):
    wins = {}
    for i, t in items:
        w = words(t)
        for s in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[s : s + window]), set()).add(str(i))
    out = {}
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for size in {len(x) for x in wins}:
            for s in range(len(w) - size + 1):
                if owner := wins.get(tuple(w[s : s + size])):
                    hit |= set(range(s, s + size))
                    ids |= owner
        out[d] = (len(w), len(hit), sorted(ids), bool(hit))
    return out


@pytest.mark.parametrize("broadcast_rows", [200_000, 0])
def test_equals_brute_force(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", broadcast_rows)
    rng = random.Random(3)
    vocabulary = ["the", "of", "naïve", "Ü", "x1", "and", "Cat", "漢字", "a", "b", "c"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([9, 10, 12, 30]))) for i in range(12)]
    items += [(20, "Short one"), (21, "x1"), (22, ""), (23, None), (24, "..!"), (25, "the " * 14), (26, items[0][1])]
    docs = [(i, text(rng.randint(0, 60))) for i in range(60)]
    docs += [(100 + i, text(5) + ", " + t.upper() + "; " + text(5)) for i, (_, t) in enumerate(items[:12])]
    docs += [(200, None), (201, ""), (202, "the " * 40), (203, "short! one"), (204, items[3][1] + " " + items[3][1])]
    d = spark.createDataFrame([(*r, "w") for r in docs], "doc_id long, text string, win string").repartition(4)
    b = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, token int")
    got = {r.doc_id: (r.n_words, r.n_hit, r.items, r.contaminated) for r in contamination(d, b).collect()}
    assert got == brute(docs, items)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r) for r in contamination(d, b).collect()] == [(1, 2, 0, [], False)]
    b = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert contamination(d.limit(0), b).count() == 0


def test_words(spark):
    texts = ["", None, "  ", "A", ",A,", "\x00İ KK ÉA-ß\x7fZ9[z`{|}", "ΑΣ ΣA", "x" * 50_000 + " " + "Q;" * 50_000, "@_Az\u0080 B　c"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r.i: r.w for r in df.select("i", decontaminate.words_of(df.text).alias("w")).collect()}
    assert got == {i: words(t) for i, t in enumerate(texts)}
