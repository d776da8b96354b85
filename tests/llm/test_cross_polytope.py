import math

import numpy as np
import pytest

from hertzflow.llm import cross_polytope as C


def brute(rows, threshold=0.93):
    good = [
        (i, np.array(v, float), x)
        for i, v, x in rows
        if x is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)
    ]
    links, up = {i: 0 for i, _, _ in rows}, {i: i for i, _, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (a, x, p) in enumerate(good):
        for b, y, q in good[:k]:
            if p == q and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                links[a] += 1
                links[b] += 1
                lo, hi = sorted((root(a), root(b)))
                up[hi] = lo
    return {i: (links[i], root(i)) for i in links}


def vectors():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 16))
    rows = []
    for k in range(320):
        b = base[rng.integers(60)] if k % 3 else base[0]
        noise = rng.choice([0, 0.01, 0.1, 0.2])
        rows.append((b + noise * rng.normal(size=16) * np.linalg.norm(b) / 4).astype(np.float32).tolist())
    rows += [rows[0]] * 30 + [[0.0] * 16, [], None, [1.0] * 15 + [None], [float("nan")] * 16, [float("inf")] * 16, [1.0] * 8, [2.0] * 8]
    return [(i, v, [0, 1, None][0 if i % 7 else i % 3]) for i, v in enumerate(rows)]


@pytest.mark.parametrize("hashes,block", [(None, 2048), (2, 10), (3, 2048)])
def test_against_brute_force(spark, hashes, block):
    rows = vectors()
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, weight int").repartition(4)
    got = {r.vec_id: r for r in C.near_duplicates(df, hashes=hashes, block_rows=block).collect()}
    want = brute(rows)
    assert len(got) == len(rows)
    assert sum(r.n_links for r in got.values()) >= 0.99 * sum(n for n, _ in want.values())
    for i, (n, component) in want.items():
        assert got[i].n_links <= n and got[i].component_id >= component
        assert got[i].kept == (got[i].component_id == i)


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert C.near_duplicates(df).count() == 0


def test_query_on_the_small_table(spark):
    from hertzflow.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    want = brute(rows)
    got = {r.vec_id: r.n_links for r in QUERIES["op1_cross_polytope"](spark, sf).collect()}
    assert sum(got.values()) >= 0.99 * sum(n for n, _ in want.values())
    assert all(got[i] <= n for i, (n, _) in want.items())
