"""How much the driver is given to do: jobs, rounds and tables that pass through it."""

import numpy as np

from tests.llm.test_operators import brute_components


def _jobs(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    try:
        out = run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_gram_product_is_a_job_however_many_tasks(spark, monkeypatch):
    from lensframe.llm.decontaminate import _gram_product

    rng = np.random.default_rng(1)
    a = np.zeros((30, 256), np.float32)
    for row in a:
        row[rng.choice(256, 20, replace=False)] = rng.random(20)
    q = rng.normal(size=(256, 5)).astype(np.float32)
    sample = spark.createDataFrame(
        [(np.flatnonzero(r).tolist(), r[r > 0].tolist()) for r in a], "terms array<int>, weights array<float>")
    kind = type(sample)
    monkeypatch.setattr(kind, "repartition", lambda self, n, *cols, f=kind.repartition: f(self, max(n, 40) if cols else n, *cols))
    got, jobs = _jobs(spark, "gram", lambda: _gram_product(sample, q))
    assert np.allclose(got, a.T @ (a @ q), rtol=1e-4, atol=1e-4)
    assert jobs < 10  # it was a job for each of the 40 tasks


def test_orthonormal_spans_the_same(spark):
    from lensframe.llm.decontaminate import orthonormal

    rng = np.random.default_rng(2)
    y = (rng.normal(size=(1000, 12)) * 10.0 ** -np.arange(12)).astype(np.float32)
    y[600:800] = 0
    q, want = orthonormal(y, 200), np.linalg.qr(y)[0]
    assert q.dtype == y.dtype and np.allclose(q.T @ q, np.eye(12), atol=1e-5)
    assert np.allclose(q @ q.T, want @ want.T, atol=1e-4)
    none = orthonormal(np.zeros((300, 4), np.float32), 200)
    assert np.allclose(none.T @ none, np.eye(4), atol=1e-6)


def test_components_end_with_stars(spark, monkeypatch):
    """Stars take no round; joins of small rounds are not broadcast."""
    from lensframe.operators import graph

    wrote, plans = [], []

    def note(df, name, f=graph.materialise):
        wrote.append(name)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return f(df, name)

    monkeypatch.setattr(graph, "materialise", note)
    find = lambda rows: {tuple(r) for r in graph.connected_components(spark.createDataFrame(rows, "i long, j long")).collect()}
    assert find([(1, 2), (3, 1), (1, 4), (7, 7)]) == {(1, 1), (2, 1), (3, 1), (4, 1), (7, 7)}
    assert wrote == ["cc"]
    wrote.clear()
    rng = np.random.default_rng(3)
    path = rng.permutation(200).tolist()
    want = {(x, min(path[:150])) for x in path[:150]} | {(x, min(path[150:])) for x in path[150:]}
    assert find(list(zip(path[:149], path[1:150])) + list(zip(path[150:-1], path[151:]))) == want
    assert len(wrote) > 2 and not any("Broadcast" in p for p in plans)


def test_rounds_without_pairs_verify_nothing(spark, monkeypatch):
    from lensframe.llm import jaccard

    wrote = []
    monkeypatch.setattr(jaccard, "materialise", lambda df, name, f=jaccard.materialise: wrote.append(name) or f(df, name))
    words = lambda n, k: " ".join(f"w{n}x{i}" for i in range(k))
    alone = [(i, words(i, 30)) for i in range(6)] + [(6, None), (7, " "), (8, words(1, 30))]
    linked = alone + [(10, words(2, 30) + " more"), (11, words(3, 29) + " other"), (12, words(3, 30) + " more")]
    for rows, sets in ((alone, 0), (linked, 1)):
        wrote.clear()
        got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()}
        assert got == brute_components(rows)
        assert wrote.count("jaccard-sets") == wrote.count("jaccard-component") == sets
