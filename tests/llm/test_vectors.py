import numpy as np
import pytest
from pyspark.sql import functions as F

from umbra.llm import ann, topk, vectors


def brute(rows, ask, k, scale=None):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float32).astype(float)
    if scale:
        x = np.floor(scale * x)
    out = {}
    for n, i in enumerate(ids):
        if ask(i):
            s = x @ x[n]
            o = [j for j in np.lexsort((ids, -np.round(s, 12))) if ids[j] != i][:k]
            out[int(i)] = [(int(ids[j]), float(s[j])) for j in o]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(int(i), v, 1.0, 2) for i, v in rows], "vec_id long, embedding array<float>, score double, rank int")


def copies(n=3000, dim=12, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x[::3] = x[0]
    return [(i, [float(a) for a in v]) for i, v in enumerate(x)]


def gathered(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def test_topk_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROWS", 500)
    monkeypatch.setattr(topk, "QUERIES", 20)
    rows = copies()
    got = gathered(topk.search(frame(spark, rows), F.col("vec_id") % 50 == 0))
    assert got == brute(rows, lambda i: i % 50 == 0, 5, 256)


def test_topk_on_the_sample(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = gathered(topk.search(df, F.col("vec_id") % 50 == 0))
    assert got == brute([(r["vec_id"], r["embedding"]) for r in df.collect()], lambda i: i % 50 == 0, 5, 256)


def test_ann_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(ann, "ROWS", 600)
    monkeypatch.setattr(ann, "QUERIES", 50)
    sample = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    for df in (frame(spark, copies()), sample):
        rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
        want = brute(rows, lambda i: i % 20 == 0, 20)
        got = gathered(ann.search(df, F.col("vec_id") % 20 == 0))
        assert got.keys() == want.keys() and all(len(g) == 20 for g in got.values())
        hit = sum(len({round(s, 9) for _, s in got[q]} & {round(s, 9) for _, s in want[q]}) / len({round(s, 9) for _, s in want[q]}) for q in want) / len(want)
        assert hit >= 0.9
        vec = {i: np.array(v, np.float32).astype(float) for i, v in rows}
        for q, found in got.items():
            assert found == sorted(found, key=lambda f: (-f[1], f[0])) and q not in dict(found)
            assert all(s == pytest.approx(vec[q] @ vec[i], abs=1e-12) for i, s in found)


def brute_items(rows, ask, k, scale=None):
    """As brute(), an id with several rows being one item: the best score over its rows."""
    best = {}
    x = [(i, np.array(v, np.float32).astype(float)) for i, v in rows]
    x = [(i, np.floor(scale * v) if scale else v) for i, v in x]
    for i, v in x:
        for j, w in x:
            if ask(i) and i != j:
                best.setdefault(i, {})[j] = max(best.get(i, {}).get(j, -np.inf), float(v @ w))
    return {i: sorted(((j, s) for j, s in own.items()), key=lambda f: (-round(f[1], 9), f[0]))[:k] for i, own in best.items()}


def test_repeated_ids_are_one_item(spark, monkeypatch):
    """Ids on two rows, with the same or with different vectors, as queries and as candidates, over many blocks."""
    for m in (ann, topk):
        monkeypatch.setattr(m, "ROWS", 40)
        monkeypatch.setattr(m, "QUERIES", 3)
    rng = np.random.default_rng(4)
    rows = [(i % 130, [float(a) for a in v]) for i, v in enumerate(rng.normal(size=(200, 6)).astype(np.float32))]
    rows += rows[95:120] + [rows[0], rows[100]]
    got = gathered(topk.search(frame(spark, rows), F.col("vec_id") % 50 == 0))
    assert got == brute_items(rows, lambda i: i % 50 == 0, 5, 256)
    got = gathered(ann.search(frame(spark, rows), F.col("vec_id") % 20 == 0, recall=1.0))
    want = brute_items(rows, lambda i: i % 20 == 0, 20)
    assert got.keys() == want.keys() and all(len({j for j, _ in g}) == len(g) == 20 for g in got.values())
    hit = [len({j for j, _ in got[q]} & {j for j, _ in want[q]}) / 20 for q in want]
    assert np.mean(hit) > 0.9 and all(s == pytest.approx(dict(brute_items(rows, lambda i: i == q, 200)[q])[j]) for q, g in got.items() for j, s in g)  # noqa: B023


def test_ann_widens_until_k_candidates(spark):
    """Small leaves whose rows are copies of the query's own id: more leaves, then all, before fewer than k are returned."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 8)).astype(np.float32)
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)] + [(0, [float(a) for a in x[0]])] * 300
    got = gathered(ann.search(frame(spark, rows), F.col("vec_id") % 20 == 0, recall=0.0))
    assert len(got) == 20 and all(len(g) == 20 for g in got.values())
    few = rows[:7] + rows[400:410]
    assert {q: len(g) for q, g in gathered(ann.search(frame(spark, few), F.col("vec_id") % 3 == 0)).items()} == {0: 6, 3: 6, 6: 6}


def test_topk_against_duckdb(spark):
    import duckdb

    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    con = duckdb.connect()
    con.sql("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet'")
    assert sorted(map(tuple, topk.search(df, F.col("vec_id") % 50 == 0).collect())) == sorted(con.sql(topk.oracle_sql()).fetchall())


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [0.0, 0.0]), (3, [None, 1.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (100, [1.0, 2.0, 3.0]), (200, [1.0, 2.0]), (300, [])]
    df = frame(spark, rows)
    assert gathered(topk.search(df, F.col("vec_id") % 50 == 0)) == {
        0: [(100, 327680), (200, 327680), (2, 0), (300, 0)], 100: [(0, 327680), (200, 327680), (2, 0), (300, 0)], 200: [(0, 327680), (100, 327680), (2, 0), (300, 0)], 300: [(0, 0), (2, 0), (100, 0), (200, 0)],
    }
    assert gathered(ann.search(df, F.col("vec_id") % 20 == 0)) == {0: [(100, 5.0), (200, 5.0)], 100: [(0, 5.0), (200, 5.0)], 200: [(0, 5.0), (100, 5.0)]}
    for search in (ann.search, topk.search):
        assert search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_chunks_are_bounded():
    plan = vectors.chunks({0: 10, 1: 10, 2: 95, 3: 5}, 20)
    assert plan == {0: (0, 1), 1: (0, 1), 2: (1, 5), 3: (6, 1)}
