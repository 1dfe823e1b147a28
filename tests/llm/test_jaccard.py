import random
import re

import pytest

from umbra.llm import jaccard


def brute(rows, t=0.8):
    """(class, copy, links) of every row by comparing all pairs."""
    words = [tuple(re.findall(r"\w+", (x or "").lower())) for _, x in rows]
    sets = [{w[i : i + 5] for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    n = len(rows)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * n
    for i in range(n):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both / len(sets[i] | sets[j]) >= t:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    out = []
    for i in range(n):
        group = [rows[j][0] for j in range(n) if find(j) == find(i)]
        copies = [rows[j][0] for j in range(n) if words[j] == words[i] and words[i]] or [rows[i][0]]
        out.append((rows[i][0], min(group), min(copies), links[i]))
    return sorted(out)


def corpus(n=260, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(60)]
    base = [word() for _ in range(300)]
    rows = []
    for i in range(n):
        if i % 3 == 0:
            t = base[:]
            for _ in range(rng.randrange(8)):
                t[rng.randrange(len(t))] = word()
        elif i % 3 == 1:
            t = [word() for _ in range(20)] + passage + [word() for _ in range(rng.randrange(30))]
        else:
            t = [word() for _ in range(rng.randrange(200))]
        rows.append((i, " ".join(t)))
    return rows + [(n + i, rows[7 * i][1].upper().replace(" ", ", ")) for i in range(20)] + [(500, None), (501, ""), (502, "..."), (503, "one two"), (504, "One, two!"), (505, "One, two!")]


@pytest.mark.parametrize("small", [48, 4])
def test_equals_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "CHUNK", 30)
    rows = corpus()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, class_id string, n int")
    assert sorted(map(tuple, jaccard.join(df).collect())) == brute(rows)


def test_sample_and_empty(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert sorted(map(tuple, jaccard.join(df).collect())) == brute(rows)
    assert jaccard.join(df.limit(0)).count() == 0


def test_repeated_ids(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (1, "g h i j k l"), (2, "g h i j k l")], "doc_id long, text string")
    assert sorted(map(tuple, jaccard.join(df).collect())) == [(1, 1, 1, 1), (1, 1, 1, 1), (1, 1, 1, 1), (2, 1, 1, 1)]


def test_posterior_bound():
    least = jaccard.least_matches(0.8)
    assert all(0 < m < (i + 1) * jaccard.STEP * 0.8 for i, m in enumerate(least))


def test_no_broadcast(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)
    rows = corpus(150)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard.join(df).collect())) == brute(rows)


def test_null_ids_and_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(200_000))
    rows = [(None, "a b c d e f g"), (None, "A, b c d e f g"), (None, "h i j k l m n"), (3, "h i j k l m n"), (None, None), (4, long), (5, long + " more"), (6, "o p q r s")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, jaccard.join(df).collect()), key=repr)
    assert got == sorted([(None, None, None, 1), (None, None, None, 1), (None, 3, 3, 1), (3, 3, 3, 1), (None, None, None, 0), (4, 4, 4, 1), (5, 4, 5, 1), (6, 6, 6, 0)], key=repr)


def test_first_of_groups_loses_no_text(spark):
    """One id with two unrelated texts, null ids, equal rows: each group keeps one row, no other text goes."""
    one, two = "a b c d e f g h", "p q r s t u v w"
    rows = [(1, one, "x"), (1, two, "x"), (2, one, "y"), (3, two.upper(), "y"), (None, one, "x"), (None, "q w e r t", "x"), (None, "q w e r t", "a"), (None, None, "x"), (None, None, "x"), (7, "", "z"), (1, one, "x"), (8, "only this", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(map(tuple, jaccard.first_of_groups(df).collect()), key=repr)
    assert got == sorted([(1, one, "x"), (1, two, "x"), (None, "q w e r t", "a"), (None, None, "x"), (None, None, "x"), (7, "", "z"), (8, "only this", "x")], key=repr)
    assert jaccard.first_of_groups(df.limit(0)).count() == 0
