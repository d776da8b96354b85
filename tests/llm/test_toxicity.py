import numpy as np
import pytest

from hertzflow.llm import toxicity as T

SF = "/root/testdata/sf0.01"


def test_gradients():
    words = T.read_words(["you idiot clown xyz " * 3, "a nice day", "", "z " * 50])
    net = T.Network(words.hashes[:5].copy())
    text, first, size = T.windows(words.start)
    assert text.tolist() == [0, 1, 2, 3, 3]
    steps = np.arange(T.WINDOW)[:, None]
    mask, at = steps < size, np.minimum(first + steps, len(words.codes) - 1)
    d = (np.arange(len(text)) + 1).astype(np.float32)

    def run():
        x, rows = net.word_inputs(words)
        both = [np.ascontiguousarray(p) for p in np.hsplit(x @ net.p["w"] + net.p["b"], 2)]
        logit, state = net.forward(both, words.codes[at], mask, keep=True)
        return float((logit * d).sum()), lambda: net.gradients(words, x, rows, words.codes[at], mask, state, d)

    grads = run()[1]()
    for k, g in grads.items():
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        kept = net.p[k][i]
        values = []
        for shift in (0.01, -0.01):
            net.p[k][i] = kept + shift
            values.append(run()[0])
        net.p[k][i] = kept
        assert g[i] == pytest.approx((values[0] - values[1]) / 0.02, rel=0.02), k


def test_every_window_of_a_long_text_counts(monkeypatch):
    words = [f"w{i}" for i in range(4000)]
    text = " ".join(words)
    monkeypatch.setattr(T, "SLICE_BYTES", 1000)
    parts = list(T.long_parts(text, 1000))
    for i in range(len(words) - T.WINDOW):
        run = " ".join(words[i : i + T.WINDOW])
        assert any(run in p for p in parts)
    assert "".join(T.long_parts("x" * 2500, 1000)) == "x" * 2500


def test_held_out_accuracy(spark):
    from hertzflow.llm.queries import QUERIES

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = QUERIES["op10_toxicity"](spark, SF).join(labels, "doc_id", "left").toPandas()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    held = got[got.held_out & got.toxic.notna()]
    assert (held.predicted == held.toxic).mean() > 0.9


def test_odd_texts_and_no_labels(spark):
    docs = spark.createDataFrame([(1, None, 0.0), (2, "", 0.0), (3, "x " * 100_000, 0.0), (3, "y", 0.0), (4, "é漢😀" * 9, 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    net = T.fit(docs, labels)
    rows = T.score(docs, net, out="score").collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert rows[0].score == rows[1].score
    labels = spark.createDataFrame([(1, None), (2, 1), (3, 1), (4, 1)], "doc_id long, toxic int")
    assert T.score(docs, T.fit(docs, labels)).count() == 5
    assert T.score(docs.limit(0), net).count() == 0
