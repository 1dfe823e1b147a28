import numpy as np

from umbra.llm import quality
from umbra.llm.common import crc_fold


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    m = quality.learn(docs.where(crc_fold() != 0), labels.where(crc_fold() != 0))
    got = quality.score(docs.where(crc_fold() == 0), m).join(labels, "doc_id").collect()
    assert len(got) > 500 and sum((r["score"] >= 0.3) == (r["quality"] == 1) for r in got) / len(got) > 0.97


def test_sum_of_squares_identity():
    rng = np.random.default_rng(0)
    m = quality.Machine(0.1, rng.normal(size=20), rng.normal(size=(20, 3)))
    at, x = np.array([1, 4, 7]), rng.normal(size=3)
    pairs = sum(m.v[at[i]] @ m.v[at[j]] * x[i] * x[j] for i in range(3) for j in range(i + 1, 3))
    assert np.isclose(m.logit(at, x, np.array([0]))[0], 0.1 + m.w[at] @ x + pairs)


def test_gradient_equals_finite_differences():
    rng = np.random.default_rng(5)
    n, rank, rows = 12, 3, 7
    each = [np.sort(rng.choice(n, rng.integers(1, 6), replace=False)) for _ in range(rows)]
    at, size = np.concatenate(each), np.array([len(e) for e in each])
    first, x, y = np.cumsum(size) - size, rng.normal(size=int(size.sum())), rng.integers(0, 2, rows).astype(float)
    par, w0 = rng.normal(0, 0.5, (rank + 1, n)), 0.2

    def loss(par, w0):
        m = quality.Machine(w0, par[-1], par[:-1].T)
        p = m.score(at, x, first)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    grad, g = quality.slopes(par, w0, at, x, x * x, first, size, y)
    step = 1e-5
    for f in range(rank + 1):
        for i in range(n):
            up, down = par.copy(), par.copy()
            up[f, i] += step
            down[f, i] -= step
            assert abs((loss(up, w0) - loss(down, w0)) / (2 * step) - grad[f, i]) < 1e-7
    assert abs((loss(par, w0 + step) - loss(par, w0 - step)) / (2 * step) - g.sum()) < 1e-7


def test_query_scores_equal_all_pairs(spark):
    """The score of each document by the sum over all pairs of its features, one by one."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    m = quality.learn(docs.where(crc_fold() != 0), labels.where(crc_fold() != 0))
    from umbra.llm import queries

    got = {r["doc_id"]: r for r in queries.op7_quality(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == docs.count()
    for r in docs.where(docs.n_chars < 1500).collect():
        at, x = quality.features(r["text"])
        vx = m.v[at] * x[:, None]
        pairs = sum(float(vx[i] @ vx[j]) for i in range(len(at)) for j in range(i))
        want = 1 / (1 + np.exp(-(m.w0 + m.w[at] @ x + pairs)))
        assert abs(got[r["doc_id"]]["score"] - want) < 1e-9 and got[r["doc_id"]]["predicted"] == (want >= 0.3)
        assert got[r["doc_id"]]["held_out"] in (True, False)


def test_very_long_labelled_texts_are_bounded(spark, monkeypatch):
    """Many long texts: their features stay below the bound, and the rest still teaches."""
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(300))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    seen = []
    fit = quality.fit
    monkeypatch.setattr(quality, "fit", lambda at, *a, **k: seen.append(len(at)) or fit(at, *a, **k))
    quality.learn(docs, labels, sample_entries=20_000)
    assert 2_000 < seen[0] <= 20_000


def test_cases(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (2, "", 1.0), (3, "a b", 1.0), (3, "a b", 1.0), (4, "x " * 100000, 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, None), (3, 1), (3, 0), (4, 0)], "doc_id long, quality int")
    out = quality.score(docs, quality.learn(docs, labels)).collect()
    assert len(out) == 5 and all(0 <= r["score"] <= 1 for r in out)
    none = quality.score(docs, quality.learn(docs, labels.limit(0))).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality.score(docs.limit(0), quality.learn(docs, labels)).count() == 0


def test_an_id_on_many_rows_teaches_once(spark):
    """However its rows lie, and however often they repeat."""
    rows = [(i, ("good words stand here " if i % 2 else "bad ||| ") * (i + 1)) for i in range(20)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    once, often = ([(0, "another text"), *rows], [*rows[::-1], *[(0, "another text")] * 500])
    a, b = (quality.learn(spark.createDataFrame(r, "doc_id long, text string"), labels) for r in (once, often))
    assert a.w0 == b.w0 and (a.w == b.w).all() and (a.v == b.v).all()
