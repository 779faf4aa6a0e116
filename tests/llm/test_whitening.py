import numpy as np
import pytest

from listwright.llm.whitening import WhiteningPlan, fit_whitening, whiten

SCHEMA = "vec_id long, embedding array<float>, label int, lw_n string, n int, component int"


def table(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], i % 3, "x", 1, None) for i, v in enumerate(vectors)], SCHEMA)


def plain(vectors, plan=WhiteningPlan()):
    x = np.floor(plan.scale * np.array(vectors, np.float32).astype(float)).astype(object) + plan.offset
    n, s = len(x), x.sum(0)
    c = np.array(x - np.array([float(v) / n for v in s]), float)
    values, vecs = np.linalg.eigh(c.T @ c / n)
    return [int(((n * r - s) ** 2).sum()) for r in x], c, values[::-1], vecs[:, ::-1]


def check(spark, vectors, usable, plan=WhiteningPlan()):
    got = whiten(table(spark, vectors), plan=plan).collect()
    good = [vectors[i] for i in usable]
    deviations, c, values, vecs = plain(good, plan)
    k = min(plan.components, int((values > 1e-12 * values.sum()).sum()))
    assert len(got) == len(good) * k
    trace = values.sum()
    for r in got:
        i, j = usable.index(r["lw_own"]["vec_id"]), r["lw_component"] - 1
        assert r["lw_n"] == len(good) and r["lw_deviation"] == deviations[i]
        assert r["lw_explained"] == pytest.approx(values[j] / trace, rel=1e-9)
        assert r["lw_identity_error"] < 1e-9
    fit = fit_whitening(table(spark, vectors), plan=plan)
    for j in range(k):
        assert np.abs(vecs[:, j] @ fit.vectors[:, j]) == pytest.approx(1, abs=1e-9)
    w = np.zeros((len(good), k))
    for r in got:
        w[usable.index(r["lw_own"]["vec_id"]), r["lw_component"] - 1] = r["lw_whitened"]
    want = c @ vecs[:, :k] / np.sqrt(values[:k])
    for j in range(k):
        assert min(np.abs(w[:, j] - want[:, j]).max(), np.abs(w[:, j] + want[:, j]).max()) < 1e-6
    return fit


def test_against_numpy_with_odd_rows(spark):
    rng = np.random.default_rng(1)
    vectors = [list(v) for v in rng.normal(size=(300, 24)) * np.linspace(2, 0.5, 24)]
    usable = list(range(300))
    for i, bad in ((5, None), (6, [None, *vectors[6][1:]]), (7, [float("nan"), *vectors[7][1:]]), (8, [float("inf"), *vectors[8][1:]]), (9, []), (10, vectors[10][:5]), (11, [*vectors[11], 1.0])):
        vectors[i] = bad
        usable.remove(i)
    vectors[20] = vectors[21]
    fit = check(spark, vectors, usable)
    assert fit.n == 293 and len(fit.values) == 8


def test_wide_vectors_take_several_passes(spark):
    rng = np.random.default_rng(2)
    vectors = [list(v) for v in rng.normal(size=(400, 120))]
    fit = check(spark, vectors, list(range(400)), WhiteningPlan(components=4, block=6, widest=30))
    assert fit.passes > 5 and fit.residual < 1e-11


def test_few_components(spark):
    base = [[1.0, 2.0, 3.0], [2.0, 1.0, 3.0], [2.0, 1.0, 3.0], [0.0, 0.0, 3.0]]
    fit = check(spark, base, [0, 1, 2, 3])
    assert len(fit.values) == 2


def test_equal_eigenvalues(spark):
    vectors = [[float(s * (i == j)) for j in range(12)] for i in range(12) for s in (1, -1)]
    got = whiten(table(spark, vectors)).collect()
    w = np.zeros((24, 8))
    for r in got:
        w[r["lw_own"]["vec_id"], r["lw_component"] - 1] = r["lw_whitened"]
    assert np.abs(w.T @ w / 24 - np.eye(8)).max() < 1e-9


def test_large_numbers(spark):
    vectors = [[1e6, 0.0], [-1e6, 1.0], [3e5, 5e5], [1e30, 0.0]]
    got = {r["lw_own"]["vec_id"]: r for r in whiten(table(spark, vectors)).where("lw_component = 1").collect()}
    x = [[int(np.floor(1024 * min(v, 2.0**30))) + 100_000 for v in map(float, np.array(r, np.float32))] for r in vectors]
    s = [sum(c) for c in zip(*x)]
    for i, r in enumerate(x):
        true = sum((4 * v - t) ** 2 for v, t in zip(r, s))
        assert got[i]["lw_deviation"] == (true if true < 1 << 63 else None)


def test_without_vectors(spark):
    assert whiten(table(spark, [])).collect() == []
    assert whiten(table(spark, [None, [None]])).collect() == []
    assert whiten(table(spark, [[1.0, 2.0]])).collect() == []
    assert fit_whitening(table(spark, [])) is None


def test_query(spark):
    from listwright.llm.queries import op12_whitening

    df = op12_whitening(spark, "/root/testdata/sf0.001")
    assert df.dtypes[:7] == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    assert df.count() == 8 * spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count()
