import numpy as np
import pytest

from umbra.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, component string, n int"


def brute(vectors, components=8):
    """By numpy, on all rows at once."""
    c = np.array([[float(np.float32(v)) for v in x] for x in vectors])
    x = np.floor(1024 * c).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    y = x - s / n
    v = y.T @ y / n
    e, w = np.linalg.eigh(v)
    e, w = e[::-1][:components], w[:, ::-1][:, :components]
    return ((n * x - s) ** 2).sum(1), y @ w / np.sqrt(e), e / np.trace(v)


def check(rows, ids, vectors, components=8):
    deviation, white, share = brute(vectors, components)
    got = {(r["vec_id"], r["component"]): r for r in rows}
    assert len(got) == len(rows) == len(ids) * white.shape[1]
    found = np.array([[got[i, k + 1]["whitened"] for k in range(white.shape[1])] for i in ids])
    sign = np.sign((found * white).sum(0))
    assert np.abs(found - sign * white).max() < 1e-8
    for i, d in zip(ids, deviation.tolist(), strict=True):
        r = got[i, 1]
        assert (r["n"], r["deviation"]) == (len(ids), d) and r["identity_error"] < 1e-8
    assert all(abs(got[ids[0], k + 1]["explained"] / s - 1) < 1e-9 for k, s in enumerate(share.tolist()))


def test_equals_numpy(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(300, 20)) @ np.diag(np.linspace(0.1, 2, 20))
    bad = [(1000, None), (1001, [1.0] * 19 + [float("nan")]), (1002, [float("inf")] + [1.0] * 19), (1003, [None] + [1.0] * 19)]
    good = [(i, v.tolist()) for i, v in enumerate(base)]
    df = spark.createDataFrame([(*r, "x", 3) for r in good + bad], SCHEMA).repartition(5)
    check(whitening.whiten(df).collect(), [i for i, _ in good], [v for _, v in good])


def test_query_form(spark):
    from umbra.llm import queries

    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    rows = queries.op11_whitening(spark, "/root/testdata/sf0.001").collect()
    check(rows, [r["vec_id"] for r in df], [r["embedding"] for r in df])


def test_cases(spark, monkeypatch):
    empty = spark.createDataFrame([], SCHEMA)
    assert whitening.whiten(empty).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.whiten(empty).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None, "x", 1), (2, [], "x", 1)], SCHEMA)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], "x", 1)], SCHEMA)).collect()  # no variance at all
    assert [(r["component"], r["deviation"], r["whitened"], r["explained"]) for r in one] == [(1, 0, None, None), (2, 0, None, None)]
    # repeated ids and rows stay rows; a short vector is filled up with zeros; a constant direction is null
    rows = [(1, [1.0, 0.0, 5.0], "x", 1), (1, [1.0, 0.0, 5.0], "x", 1), (2, [-1.0, 3.0, 5.0], "x", 1), (None, [0.5, -1.0, 5.0], "x", 1)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 12 and all((r["whitened"] is None) == (r["component"] == 3) for r in got)
    short = whitening.whiten(spark.createDataFrame([(1, [1.0, 0.0], "x", 1), (2, [3.0], "x", 1), (3, [0.0, 2.0], "x", 1)], SCHEMA)).collect()
    check(short, [1, 2, 3], [[1.0, 0.0], [3.0, 0.0], [0.0, 2.0]])
    monkeypatch.setattr(whitening, "PAIRS", 2)  # several aggregations
    check(whitening.whiten(spark.createDataFrame([(1, [1.0, 0.0], "x", 1), (2, [3.0, 0.0], "x", 1), (3, [0.0, 2.0], "x", 1)], SCHEMA)).collect(), [1, 2, 3], [[1.0, 0.0], [3.0, 0.0], [0.0, 2.0]])


def test_one_aggregation_sums_all_pairs(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (4.0, 5.0, 7.0)], "c0 double, c1 double, c2 double")
    assert whitening.products(df, ["c0", "c1", "c2"]).tolist() == [[17, 22, 31], [22, 29, 41], [31, 41, 58]]


def test_deviations_beyond_a_long_raise(spark):
    from pyspark.errors import ArithmeticException

    df = spark.createDataFrame([(1, [3e9], "x", 1), (2, [-3e9], "x", 1)], SCHEMA)
    with pytest.raises(ArithmeticException):
        whitening.whiten(df).collect()
