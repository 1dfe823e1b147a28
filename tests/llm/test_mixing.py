import itertools

import pytest
from pyspark.sql import functions as F

from umbra.llm import mixing


def check(rows, docs):
    """Targets and bounds by plain arithmetic."""
    size = {}
    for i, s, n in docs:
        size[s] = size.get(s, 0) + n
    order = sorted(size, key=lambda s: (s is None, s or ""))
    left, open_, target = sum(size.values()), {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, {}
    while open_:
        share = {s: left * w / sum(open_.values()) for s, w in open_.items()}
        over = [s for s in share if share[s] > 3 * size[s]]
        target |= {s: 3.0 * size[s] for s in over} if over else share
        left -= sum(3 * size[s] for s in over)
        open_ = {s: w for s, w in open_.items() if over and s not in over}
    taken = {}
    assert len(rows) == len(docs)
    own = {i: s for i, s, _ in docs}
    for r in rows:
        s = own[r["doc_id"]]
        assert r["source_size"] == size[s] and r["target"] == pytest.approx(target[s])
        assert r["taken"] % max(r["size"], 1) == 0 and 0 <= r["taken"] <= 3 * r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
    return target, taken


def test_sample_is_near_target_and_stable(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    run = lambda: mixing.mix(df, F.col("source"), mixing.words(F.col("text")), F.md5("text")).collect()
    rows = run()
    docs = [(r["doc_id"], r["source"], len([w for w in r["text"].replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w])) for r in df.collect()]
    target, taken = check(rows, docs)
    assert {r["doc_id"]: r["size"] for r in rows} == {i: n for i, _, n in docs}
    for s in target:
        assert abs(taken[s] - target[s]) <= 0.01 * target[s] + 1
    assert sorted(map(tuple, run())) == sorted(map(tuple, rows))


def test_cases(spark):
    data = [(1, "a b c", "s0"), (2, None, "s1"), (3, "", None), (4, "x", None), (5, "a\x0bb c", ""), (5, "q", "s0"), (6, "w " * 5000, "s2")]
    df = spark.createDataFrame([(*r, 0) for r in data], "doc_id long, text string, source string, size int")
    rows = mixing.mix(df, F.col("source"), mixing.words(F.col("text")), F.md5("text")).collect()
    assert len(rows) == 7 and all(r["taken"] <= 3 * r["size"] for r in rows)
    assert mixing.mix(df.limit(0), F.col("source"), mixing.words(F.col("text")), F.md5("text")).count() == 0


def cheapest(cells, quota, repeats):
    """Least cost of meeting all quotas, by trying every flow."""
    names = list(cells)
    most, best = {}, None
    for (p, _), w in cells.items():
        most[p] = max(most.get(p, 0), w)
    for flow in itertools.product(*[range(repeats * cells[c] + 1) for c in names]):
        if all(sum(f for f, c in zip(flow, names, strict=True) if c[1] == s) == q for s, q in quota.items()):
            cost = 0
            for p, w in most.items():
                x = sum(f for f, c in zip(flow, names, strict=True) if c[0] == p)
                cost += sum(min(w, x - r * w) * r for r in range(-(-x // w)))
            best = cost if best is None else min(best, cost)
    return best


def test_flow_equals_brute_force():
    import random

    rng = random.Random(2)
    for _ in range(40):
        cells = {("a", "a"): rng.randrange(1, 4), ("b", "b"): rng.randrange(1, 4), ("ab", "a"): rng.randrange(1, 3), ("ab", "b"): rng.randrange(1, 3)}
        quota = {s: rng.randrange(0, 3 * sum(w for c, w in cells.items() if c[1] == s) + 1) for s in "ab"}
        got = mixing.route(cells, quota, 3)
        assert all(0 <= got[c] <= 3 * w for c, w in cells.items()) and all(sum(x for c, x in got.items() if c[1] == s) == q for s, q in quota.items())
        most = {"a": cells["a", "a"], "b": cells["b", "b"], "ab": max(cells["ab", "a"], cells["ab", "b"])}
        cost = 0
        for p, w in most.items():
            x = sum(v for c, v in got.items() if c[0] == p)
            cost += sum(min(w, x - r * w) * r for r in range(-(-x // w)))
        assert cost == cheapest(cells, quota, 3)


def test_flow_leaves_a_shared_text_to_one_source():
    cells = {("a", "a"): 10, ("b", "b"): 30, ("ab", "a"): 10, ("ab", "b"): 10}
    assert mixing.route(cells, {"a": 20, "b": 30}, 3) == {("a", "a"): 10, ("b", "b"): 30, ("ab", "a"): 10, ("ab", "b"): 0}
    cells = {(p, s): 5 for p in range(3000) for s in (p % 7, (p * 3 + 1) % 7)} | {(f"s{s}", s): 4000 for s in range(7)}
    quota = {s: 2 * sum(w for c, w in cells.items() if c[1] == s) for s in range(7)}
    got = mixing.route(cells, quota, 3)
    assert all(sum(x for c, x in got.items() if c[1] == s) == q for s, q in quota.items())


def test_overlapping_sources(spark, monkeypatch):
    """Texts on rows of several sources, with and without the broadcast; too many cells are refused, none is left out."""
    data = [(i, f"unique {i} " + "w " * (i % 9), f"s{i % 4}") for i in range(400)]
    data += [(1000 + i, f"shared {i // 3} " + "v " * 8, f"s{(i // 3 + (i % 3) ** 2) % 4}") for i in range(300)]
    data += [(2000 + i, "hot text", "s0" if i % 5 else None) for i in range(200)]
    df = spark.createDataFrame([(*r, 1) for r in data], "doc_id long, text string, source string, size int")
    docs = [(i, s, len(t.split())) for i, t, s in data]
    for texts in (200_000, 0):
        monkeypatch.setattr(mixing, "BROADCAST_TEXTS", texts)
        target, taken = check(mixing.mix(df, F.col("source"), mixing.words(F.col("text")), F.md5("text")).collect(), docs)
        assert all(-12 < taken[s] - target[s] <= 1 for s in target)
    monkeypatch.setattr(mixing, "MAX_CELLS", 6)
    with pytest.raises(ValueError, match="more than 6 cells"):
        mixing.mix(df, F.col("source"), mixing.words(F.col("text")), F.md5("text"))
    kept = mixing.mix(df, F.col("source"), mixing.words(F.col("text")), keep=("text", "size"))
    assert kept.columns == ["doc_id", "text", "size", "size", "source_size", "target", "taken"] and kept.count() == len(data)


def test_an_id_in_two_sources_stays_within_its_size(spark):
    """The id stands on a short row of one source and a shorter one of another."""
    docs = [(1, "a", 10), (1, "b", 3)] + [(100 + i, "b", 400 + i) for i in range(20)] + [(200 + i, "c", 50) for i in range(50)]
    df = spark.createDataFrame(docs, "doc_id long, source string, n long")
    for seed in range(3):
        rows = mixing.mix(df, F.col("source"), F.col("n"), keep=("source",), seed=seed).collect()
        assert len(rows) == len(docs) and all(r["taken"] <= 3 * r["size"] for r in rows)


def test_long_documents_at_the_cut_leave_no_gap(spark):
    """After the selection no document left over fits in what is missing, however long the one at the cut."""
    docs = [(i, "s0", 10 + i % 7) for i in range(400)] + [(1000 + i, "s0", 4000 + i) for i in range(5)] + [(2000 + i, "s1", 50) for i in range(500)] + [(3000 + i % 2, "s2", 30) for i in range(90)] + [(None, "s2", 9000 + i) for i in range(2)]
    df = spark.createDataFrame(docs, "doc_id long, source string, n long")
    for seed in range(4):
        rows = mixing.mix(df, F.col("source"), F.col("n"), seed=seed).withColumn("source", F.when(F.col("size") == 50, "s1").when((F.col("size") == 30) | (F.col("size") >= 9000), "s2").otherwise("s0")).collect()
        assert len(rows) == len(docs)
        for s in ("s0", "s1", "s2"):
            own = [r for r in rows if r["source"] == s]
            times = min(int(round(own[0]["target"])), 3 * own[0]["source_size"]) // own[0]["source_size"]
            missing = round(own[0]["target"]) - sum(r["taken"] for r in own)
            assert missing >= 0 and all(r["size"] > missing for r in own if r["taken"] == times * r["size"] and times < 3)
