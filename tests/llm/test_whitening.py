import numpy as np
import pytest

from hertzflow.llm import whitening
from hertzflow.llm.queries import QUERIES


def frame(spark, vectors, more=""):
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)


def cloud(n, d, seed=3, spread=None):
    rng = np.random.default_rng(seed)
    scale = np.linspace(3, 1, d) if spread is None else spread
    turn = np.linalg.qr(rng.standard_normal((d, d)))[0]
    return ((rng.standard_normal((n, d)) * scale) @ turn).astype(np.float32)


def expected(v):
    x = np.floor(64 * v.astype(np.float64)) + 1e6
    c = x - x.mean(0)
    values, vectors = np.linalg.eigh(c.T @ c / len(c))
    return x.astype(np.int64), values[::-1], vectors[:, ::-1]


@pytest.mark.parametrize("d,k,guard", [(40, 8, 4), (40, 8, 32), (6, 8, 4), (90, 20, 10)])
def test_eigenpairs_equal_brute_force(spark, d, k, guard):
    v = cloud(700, d)
    rows = whitening.lattice(frame(spark, v))
    model = whitening.fit(rows, k, guard)
    x, values, vectors = expected(v)
    k = min(k, d)
    assert np.allclose(model.values, values[:k], rtol=1e-12)
    assert np.abs(np.abs((vectors[:, :k] * model.vectors).sum(0)) - 1).max() < 1e-10
    assert model.residual < 1e-12 and model.identity_error < 1e-10
    assert np.isclose(model.centre.trace, values.sum(), rtol=1e-12)
    out = {r.vec_id: r for r in whitening.transform(rows, model).collect()}
    n, total = len(x), x.sum(0)
    for i in (0, 17, 699):
        assert out[i].deviation == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[i], total, strict=True))
        assert np.allclose(out[i].whitened, (x[i] - total / n) @ model.vectors / np.sqrt(model.values), atol=1e-9)


def test_flat_spectrum_is_certified(spark):
    """Unwanted values close to the wanted ones and far from zero, as in the given tables."""
    spread = np.concatenate([[12.0], np.linspace(8.7, 7.9, 31), np.linspace(7.88, 7.3, 32)])
    v = cloud(4000, 64, spread=spread / 8)
    model = whitening.fit(whitening.lattice(frame(spark, v)))
    _, values, vectors = expected(v)
    assert np.allclose(model.values, values[:32], rtol=1e-11)
    assert np.abs(np.abs((vectors[:, :32] * model.vectors).sum(0)) - 1).max() < 1e-8
    assert model.passes < 60


def test_sums_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    v = cloud(300, 12)
    model = whitening.fit(whitening.lattice(frame(spark, v).repartition(7)), 4, 3)
    assert np.allclose(model.values, expected(v)[1][:4], rtol=1e-12)


def test_rows_that_have_no_vector(spark):
    good = cloud(60, 5)
    bad = [None, [1, 2, None, 4, 5], [np.nan, 0, 0, 0, 0], [np.inf, 0, 0, 0, 0]]
    df = frame(spark, [*good, *bad]).selectExpr("IF(vec_id = 3, NULL, vec_id + 9007199254740993) AS vec_id", "embedding", "vec_id AS whitened", "'t' AS _x")
    df = df.union(df.where("vec_id = 9007199254740993"))
    rows = whitening.lattice(df)
    out = whitening.transform(rows, whitening.fit(rows, 3, 1))
    ids = sorted((r.vec_id or 0) for r in out.collect())
    assert ids == sorted([0, 9007199254740993, *(i + 9007199254740993 for i in range(60) if i != 3)])
    assert out.columns == ["vec_id", "_x", "whitened", "deviation"]


def test_nothing_to_whiten(spark):
    for vectors in ([], [[1, 2]], [[1, 2]] * 4, [[]] * 3, [None]):
        rows = whitening.lattice(frame(spark, vectors))
        model = whitening.fit(rows)
        assert len(model.values) == 0
        assert all(r.whitened == [] and r.deviation == 0 for r in whitening.transform(rows, model).collect())
    with pytest.raises(Exception, match="different lengths"):
        whitening.fit(whitening.lattice(frame(spark, [[1, 2], [1], [3, 4]])))


def test_large_values_and_few_directions(spark):
    v = np.zeros((50, 4), np.float32)
    v[:, 0] = np.arange(50) * 1e12
    v[:, 2] = 3e30
    rows = whitening.lattice(frame(spark, v))
    model = whitening.fit(rows)
    assert len(model.values) == 1 and model.identity_error < 1e-10
    assert {r.deviation for r in whitening.transform(rows, model).collect()} == {None}


def test_less_rank_than_components(spark):
    v = np.round(cloud(400, 10) * 4)
    wide = np.concatenate([v] * 8, axis=1) / 64
    model = whitening.fit(whitening.lattice(frame(spark, wide)), 20, 10)
    assert len(model.values) == 10 and model.identity_error < 1e-9
    assert np.allclose(model.values, expected(wide)[1][:10], rtol=1e-11)


def test_query(spark, tmp_path):
    v = cloud(200, 40)
    frame(spark, [*v, None]).selectExpr("*", "1 AS label").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = QUERIES["op12_whitening"](spark, str(tmp_path)).toPandas()
    x, values, _ = expected(v)
    assert len(out) == 200 * 32 and set(out["component"]) == set(range(1, 33)) and set(out["n"]) == {200}
    assert np.allclose(out.groupby("component")["explained"].first(), values[:32] / values.sum(), rtol=1e-9)
    w = out.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(w.T @ w / 200 - np.eye(32)).max() < 1e-9 and out["identity_error"].max() < 1e-9
