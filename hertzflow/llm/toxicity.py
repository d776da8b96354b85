"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A text is read as overlapping windows of words. Each word enters with a vector of its
own (words that several training texts share) and with the mean vector of its character
pairs. A gated recurrent network reads a window in both directions, attention pools the
states, and the text's score is that of its highest window. Training is numpy on a
sample of labelled rows of bounded size (``SAMPLE``): it maximises the likelihood of
the labels under a smooth maximum over a text's windows.

Scoring covers every window of every whole text: rows are independent, there is no
shuffle, and the model, whose size the sample bounds, is the only broadcast. Distinct
words of a batch are projected once; windows run through the network in blocks. Null
and empty texts are one empty window and get the score that the model gives to that.
Rows that repeat an id are scored each. Only id and text are read; labels are read for
the sample alone.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import tidy, with_columns
from .words import LOWER, slice_hashes

WINDOW, STRIDE = 32, 24
SAMPLE, SAMPLE_CHARS, SAMPLE_RUNS = 3000, 1 << 17, 64
UNITS, WORD_DIM, CHAR_DIM, PAIRS = 8, 12, 8, 1024
MIN_TEXTS = 3
BLOCK_WINDOWS = 2048
SLICE_BYTES = 1 << 21
SHARPNESS = 4.0

# Words are runs of ASCII letters, digits and all other non-ASCII bytes.
BLANK = np.ones(256, bool)
BLANK[48:58] = BLANK[65:91] = BLANK[97:123] = BLANK[128:] = False


@dataclass
class Words:
    """The words of some texts: codes into distinct words, with these words' inputs."""

    codes: np.ndarray
    start: np.ndarray
    hashes: np.ndarray
    pairs: np.ndarray
    pair_start: np.ndarray


def read_words(texts) -> Words:
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    starts = np.cumsum([0] + [len(x) + 1 for x in raw])
    joined = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    hashes, first, last = slice_hashes(joined, BLANK)
    codes, distinct = pd.factorize(hashes)
    seen = np.empty(len(distinct), np.int64)
    seen[codes[::-1]] = np.arange(len(codes))[::-1]
    # Character pairs of the distinct words, with the blanks on both sides.
    begin, size = first[seen], last[seen] - first[seen] + 1
    ends = np.cumsum(size)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - ends + size, size)
    low = np.concatenate([[32], LOWER[joined]]).astype(np.int64)
    low[BLANK[low]] = 32
    pairs = (low[at] * 257 + low[at + 1]) * 40503 % 65521 % PAIRS
    return Words(codes, np.searchsorted(first, starts), np.asarray(distinct), pairs, np.concatenate([[0], ends]))


def windows(start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and length of each window; a text without words has an empty one."""
    n = np.diff(start)
    count = 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE))
    text = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    return text, start[text] + k * STRIDE, np.minimum(WINDOW, n[text] - k * STRIDE)


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _gru(inputs, codes, mask, u, keep=False):
    """States (time, window, unit) of one direction; ``codes`` and ``mask`` are (time, window)."""
    units = u.shape[0]
    h = np.zeros((codes.shape[1], units), np.float32)
    states = np.empty((*codes.shape, units), np.float32)
    x, hu = np.empty((2, codes.shape[1], 3 * units), np.float32)
    every = mask.all(1)
    trace = []
    for t in range(len(codes)):
        np.take(inputs, codes[t], axis=0, out=x)
        np.matmul(h, u, out=hu)
        gates = x[:, : 2 * units] + hu[:, : 2 * units]
        gates *= 0.5
        np.tanh(gates, out=gates)
        gates += 1
        gates *= 0.5
        z, r = gates[:, :units], gates[:, units:]
        n = r * hu[:, 2 * units :]
        n += x[:, 2 * units :]
        np.tanh(n, out=n)
        new = np.subtract(h, n, out=states[t])
        new *= z
        new += n
        if not every[t]:
            np.copyto(new, h, where=~mask[t][:, None])
        if keep:
            trace.append((h, z, r, n, hu[:, 2 * units :].copy()))
        h = new
    return states, trace


def _gru_back(trace, mask, u, d_states):
    units = u.shape[0]
    d_inputs = np.empty((*d_states.shape[:2], 3 * units), np.float32)
    d_u, carry = np.zeros_like(u), np.zeros_like(d_states[0])
    for t in range(len(trace) - 1, -1, -1):
        h, z, r, n, hn = trace[t]
        dh = d_states[t] + carry
        on = np.where(mask[t][:, None], dh, 0)
        dn = on * (1 - z) * (1 - n * n)
        dz = on * (h - n) * z * (1 - z)
        dr = dn * hn * r * (1 - r)
        d_inputs[t] = np.hstack([dz, dr, dn])
        back = np.hstack([dz, dr, dn * r])
        d_u += h.T @ back
        carry = np.where(mask[t][:, None], on * z + back @ u.T, dh)
    return d_inputs, d_u


class Network:
    def __init__(self, known: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        normal = lambda *shape: rng.normal(0, 0.25, shape).astype(np.float32)
        self.known = np.sort(known)
        self.p = {
            # Row 0 stands for unknown words and stays zero. The others begin small, so that
            # words a small sample teaches nothing about have little say.
            "word": np.vstack([np.zeros((1, WORD_DIM), np.float32), 0.1 * normal(len(known), WORD_DIM)]),
            "pair": normal(PAIRS, CHAR_DIM),
            "w": normal(WORD_DIM + CHAR_DIM, 6 * UNITS),
            "b": np.zeros(6 * UNITS, np.float32),
            "uf": normal(UNITS, 3 * UNITS),
            "ub": normal(UNITS, 3 * UNITS),
            "a": normal(2 * UNITS, UNITS),
            "v": normal(UNITS),
            "o": normal(2 * UNITS),
            "c": np.zeros(1, np.float32),
        }

    def word_rows(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, at + 1, 0)

    def word_inputs(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        rows = self.word_rows(words.hashes)
        if not len(rows):
            return np.zeros((1, WORD_DIM + CHAR_DIM), np.float32), rows
        mean = np.add.reduceat(self.p["pair"][words.pairs], words.pair_start[:-1], axis=0)
        mean /= np.diff(words.pair_start)[:, None]
        return np.hstack([self.p["word"][rows], mean]).astype(np.float32), rows

    def forward(self, inputs, codes, mask, keep=False):
        """Logits of windows; ``codes`` and ``mask`` are (time, window)."""
        p = self.p
        hf, tf = _gru(inputs[0], codes, mask, p["uf"], keep)
        hb, tb = _gru(inputs[1], codes[::-1], mask[::-1], p["ub"], keep)
        h = np.concatenate([hf, hb[::-1]], axis=2)
        s = np.tanh(h @ p["a"])
        e = np.where(mask, s @ p["v"], np.float32(-30))
        w = np.exp(e - e.max(0))
        w = np.where(mask, w / w.sum(0), 0)
        pooled = np.einsum("tn,tnh->nh", w, h)
        return pooled @ p["o"] + p["c"][0], (h, s, w, pooled, tf, tb)

    def gradients(self, words: Words, x, rows, codes, mask, state, d_logit):
        p, (h, s, w, pooled, tf, tb) = self.p, state
        g = {"o": pooled.T @ d_logit, "c": np.array([d_logit.sum()], np.float32)}
        d_pooled = d_logit[:, None] * p["o"]
        along = np.einsum("nh,tnh->tn", d_pooled, h)
        d_e = w * (along - (w * along).sum(0))
        d_s = d_e[..., None] * p["v"] * (1 - s * s)
        g["v"] = np.einsum("tn,tnk->k", d_e, s)
        g["a"] = np.einsum("tnh,tnk->hk", h, d_s)
        d_h = w[..., None] * d_pooled + d_s @ p["a"].T
        df, g["uf"] = _gru_back(tf, mask, p["uf"], d_h[..., :UNITS])
        db, g["ub"] = _gru_back(tb, mask[::-1], p["ub"], d_h[::-1, :, UNITS:])
        d_in = np.concatenate([df, db[::-1]], axis=2)[mask]
        used = codes[mask]
        order = np.argsort(used, kind="stable")
        present, first = np.unique(used[order], return_index=True)
        total = np.zeros((len(x), 6 * UNITS), np.float32)
        if len(present):
            total[present] = np.add.reduceat(d_in[order], first, axis=0)
        g["w"], g["b"] = x.T @ total, total.sum(0)
        d_x = total @ p["w"].T
        g["word"], g["pair"] = np.zeros_like(p["word"]), np.zeros_like(p["pair"])
        if len(rows):
            np.add.at(g["word"], rows, d_x[:, :WORD_DIM])
            size = np.diff(words.pair_start)
            np.add.at(g["pair"], words.pairs, np.repeat(d_x[:, WORD_DIM:] / size[:, None], size, axis=0))
        g["word"][0] = 0
        return g

    def logits(self, texts) -> np.ndarray:
        """The highest window's logit of each text."""
        words = read_words(texts)
        x, _ = self.word_inputs(words)
        inputs = [np.ascontiguousarray(part) for part in np.hsplit(x @ self.p["w"] + self.p["b"], 2)]
        text, first, size = windows(words.start)
        codes = words.codes if len(words.codes) else np.zeros(1, np.int64)
        best = np.full(len(words.start) - 1, -np.inf)
        steps = np.arange(WINDOW)[:, None]
        for lo in range(0, len(text), BLOCK_WINDOWS):
            part = slice(lo, lo + BLOCK_WINDOWS)
            mask = steps < size[part]
            at = np.minimum(first[part] + steps, len(codes) - 1)
            np.maximum.at(best, text[part], self.forward(inputs, codes[at], mask)[0])
        return best


def long_parts(text: str, size: int = SLICE_BYTES) -> Iterator[str]:
    """Parts of a very long text; neighbours share more than a window, so no window is lost."""
    at = 0
    while len(text) - at > size:
        end = at + size
        cut = end
        for _ in range(2 * WINDOW):
            back = max((text.rfind(c, at + 1, cut) for c in " \n"), default=-1)
            if back <= at:
                break
            cut = back
        yield text[at:end]
        at = cut if cut > at else end
    yield text[at:]


def score_texts(net: Network, texts) -> np.ndarray:
    texts = [t or "" for t in texts]
    out, held, rows, size = np.full(len(texts), -np.inf), [], [], 0

    def flush():
        nonlocal size
        if held:
            np.maximum.at(out, rows, net.logits(held))
            held.clear()
            rows.clear()
            size = 0

    for i, text in enumerate(texts):
        for part in long_parts(text):
            held.append(part)
            rows.append(i)
            size += len(part)
            if size >= SLICE_BYTES:
                flush()
    flush()
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def train(texts: list[str], labels: list[int], epochs: int = 3, steps_at_least: int = 150, batch: int = 48, rate: float = 0.01, seed: int = 5) -> Network:
    every = read_words(texts)
    text_of = np.repeat(np.arange(len(texts)), np.diff(every.start))
    pairs = np.unique(np.stack([every.codes, text_of]), axis=1) if len(every.codes) else np.empty((2, 0), np.int64)
    net = Network(every.hashes[np.bincount(pairs[0], minlength=len(every.hashes)) >= MIN_TEXTS])
    y = np.array(labels, np.float32)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    # A small sample is gone through more often.
    epochs = max(epochs, -(-steps_at_least // max(1, -(-len(texts) // batch))))
    rng, step, steps = np.random.default_rng(seed), 0, np.arange(WINDOW)[:, None]
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), batch):
            chosen = order[lo : lo + batch]
            words = read_words([texts[i] for i in chosen])
            x, rows = net.word_inputs(words)
            inputs = [np.ascontiguousarray(part) for part in np.hsplit(x @ net.p["w"] + net.p["b"], 2)]
            text, first, size = windows(words.start)
            codes = words.codes if len(words.codes) else np.zeros(1, np.int64)
            mask, at = steps < size, np.minimum(first + steps, len(codes) - 1)
            logit, state = net.forward(inputs, codes[at], mask, keep=True)
            start = np.flatnonzero(np.diff(text, prepend=-1))
            top = np.maximum.reduceat(logit, start)
            weight = np.exp(SHARPNESS * (logit - top[text]))
            total = np.add.reduceat(weight, start)
            whole = top + np.log(total) / SHARPNESS
            d = (_sigmoid(whole) - y[chosen]) / len(chosen)
            g = net.gradients(words, x, rows, codes[at], mask, state, (d[text] * weight / total[text]).astype(np.float32))
            step += 1
            for k, grad in g.items():
                m, v = moments[k]
                m *= 0.9
                m += 0.1 * grad
                v *= 0.99
                v += 0.01 * grad * grad
                speed = rate * (0.3 if epoch == epochs - 1 else 1.0)
                net.p[k] -= (speed * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def sampled_text(text: Column) -> Column:
    """A text of up to ``SAMPLE_CHARS`` characters; of a longer one, evenly spread runs of that many."""
    size, run = F.length(text), SAMPLE_CHARS // SAMPLE_RUNS
    runs = F.transform(
        F.sequence(F.lit(0), F.lit(SAMPLE_RUNS - 1)),
        lambda i: F.substring(text, (i.cast("bigint") * (size - run) / (SAMPLE_RUNS - 1)).cast("int") + 1, F.lit(run)),
    )
    return F.when(size <= SAMPLE_CHARS, text).otherwise(F.array_join(runs, " "))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", sample: int = SAMPLE) -> Network:
    """Train on at most ``sample`` labelled rows, a third of them toxic where there are enough.

    Labelled ids of both kinds are taken in the order of a hash; only these, a bounded number,
    are joined to their texts, so no text is shuffled. They are trained on whole in one task;
    one beyond ``SAMPLE_CHARS`` characters is read in ``SAMPLE_RUNS`` runs spread evenly from
    its begin to its end, so that no labelled row is left out for its length, and
    only the network reaches the driver. Labels that are null are left out. Without any
    label of one kind, every text gets the other's score.
    """
    named = labels.where(F.col(toxic).isNotNull()).select(
        F.col(doc_id).alias("doc_id"), (F.col(toxic) > 0).cast("int").alias("y")
    )
    body = docs.select(F.col(doc_id).alias("doc_id"), sampled_text(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    some = []
    for y, most in ((1, sample // 3), (0, sample - sample // 3)):
        ids = named.where(F.col("y") == y).distinct().orderBy(*order).limit(most)
        some.append(body.join(F.broadcast(ids), "doc_id").orderBy(*order, "text").limit(most))

    def trained(batches):
        parts = list(batches)
        both = pd.concat(parts) if parts else pd.DataFrame({"doc_id": [], "text": [], "y": []})
        both = both.sort_values(["doc_id", "text", "y"])
        net = train(both["text"].tolist(), both["y"].tolist())
        yield pd.DataFrame({"known": [net.known.tobytes()], "weights": [pickle.dumps(net.p)]})

    one = some[0].union(some[1]).repartition(1).mapInPandas(tidy(trained), "known binary, weights binary").first()
    net = Network(np.empty(0, np.uint64))
    if one:
        net.known, net.p = np.frombuffer(one.known, np.uint64), pickle.loads(one.weights)
    return net


def score(docs: DataFrame, net: Network, text: str = "text", out: str = "toxicity") -> DataFrame:
    """Add the score, 0 to 1. A column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast({"known": net.known, "weights": net.p})

    def scored(texts):
        held = shared.value
        if "built" not in held:
            held["built"] = Network(np.empty(0, np.uint64))
            held["built"].known, held["built"].p = held["known"], held["weights"]
        return [pa.array(score_texts(held["built"], texts.to_pylist()), pa.float64())]

    return with_columns(docs, text, f"`{out}` double", scored)
