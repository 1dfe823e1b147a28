"""Hamming blocks over keyed Bloom filters: what they find and how many pairs they look at."""

from itertools import combinations

from pyspark.sql import functions as F

from umbra.functions.strings import edits, jaro_winkler
from umbra.operators import utility
from umbra.sources import io

KEY = b"linkage"


def encodings(df, bits):
    return {r["id"]: set(r["bloom"]) for r in utility.bloom_encode(df.select(F.col("c_custkey").alias("id"), "c_name"), "c_name", 2, bits, 2, KEY).collect()}


def test_recall_and_pruning_on_names(spark):
    """1500 names that share most of their letters: of the pairs at 0.9 or more all but some are found, from few pairs."""
    df = io.read(spark, "/root/testdata/sf0.01", "customer")
    own = encodings(df, 512)
    want = {(a, b) for (a, x), (b, y) in combinations(sorted(own.items()), 2) if 2 * len(x & y) / (len(x) + len(y)) >= 0.9}
    classes = utility.bloom_encode(df.select(F.col("c_custkey").alias("id"), "c_name"), "c_name", 2, 512, 2, KEY).groupBy("bloom").agg(F.min("id").alias("id"))
    blocks = utility.lsh_blocks(classes, 512, 24, 6, 64, KEY)
    sizes = [r["count"] for r in blocks.groupBy("table", "key").count().collect()]
    assert max(sizes) <= 64
    looked = sum(n * (n - 1) // 2 for n in sizes)
    pairs, members = utility.lsh_link(df, "c_custkey", "c_name", 2, 512, 2, KEY, 0.9)
    found = {(r["a"], r["b"]) for r in pairs.collect()}
    assert found <= want and members.count() == 1500
    recall = len(found) / len(want)
    print(f"recall {recall:.4f} of {len(want)} pairs; {looked} pairs in blocks of {len(own) * (len(own) - 1) // 2}")
    assert recall >= 0.99
    candidates = blocks.withColumnRenamed("id", "a").join(blocks.withColumnRenamed("id", "b"), ["table", "key"]).where("a < b").select("a", "b").distinct().count()
    assert candidates < 0.25 * len(own) * (len(own) - 1) / 2 and looked <= 24 * 32 * len(own)


def test_equal_encodings_are_one_class(spark):
    """A third of the rows alike: no pair of them is made."""
    rows = [(i, "same name") for i in range(500)] + [(i, f"person {i * i}") for i in range(500, 800)] + [(900, None), (901, ""), (902, "")]
    df = spark.createDataFrame(rows, "id long, n string")
    pairs, members = utility.lsh_link(df, "id", "n", 2, 256, 2, KEY, 0.99, most=16)
    of = {r["id"]: r["class"] for r in members.collect()}
    assert all(of[i] == 0 for i in range(500)) and 900 not in of and of[902] == 901
    assert all(r["a"] < r["b"] and r["dice"] >= 0.99 for r in pairs.collect())
    assert utility.lsh_link(df.limit(0), "id", "n", 2, 256, 2, KEY, 0.9)[0].count() == 0


def test_encoding_needs_the_key(spark):
    df = spark.createDataFrame([("Anna",)], "x string")
    bits = [utility.bloom_encode(df, "x", 2, 1024, 2, k).first()["bloom"] for k in (b"a", b"a", b"b")]
    assert bits[0] == bits[1] != bits[2]


def test_likeness_of_strings():
    assert [edits(*p) for p in (("ca", "abc"), ("ab", "ba"), ("", "abc"), ("kitten", "sitting"), (None, "x"))] == [2, 1, 3, 3, None]
    assert round(jaro_winkler("martha", "marhta"), 4) == 0.9611 and round(jaro_winkler("dixon", "dicksonx"), 4) == 0.8133
    assert jaro_winkler("", "") == 1.0 and jaro_winkler("", "a") == 0.0 and jaro_winkler(None, "a") is None and jaro_winkler("ab", "xy") == 0.0


def brute(df, id_col, col, q, bits, least):
    own = {r["id"]: frozenset(r["bloom"]) for r in utility.bloom_encode(df.select(F.col(id_col).alias("id"), F.col(col).alias("x")).where("x is not null"), "x", q, bits, 2, KEY).collect()}
    classes = {}
    for i, x in sorted(own.items()):
        classes.setdefault(x, i)
    pairs = {(min(i, j), max(i, j)): 2 * len(x & y) / (len(x) + len(y)) for (x, i), (y, j) in combinations(classes.items(), 2)}
    return {p: d for p, d in pairs.items() if d >= least}


def test_no_pair_is_missed(spark):
    """Of names that share most letters, and of texts of any length; blocks in parts or whole."""
    names = io.read(spark, "/root/testdata/sf0.001", "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("n"))
    words = ["anna", "bert", "carl maria", "d'or", "von und zu", "meier", "müller", "smith-jones", "", "x"]
    texts = [(i, " ".join(words[(i * k * k + i // 7) % len(words)] for k in range(1, 2 + i % 6))) for i in range(160)] + [(900, None), (901, "ab" * 50), (902, "abcdefghijklmnopqrstuvwxyz" * 2), (903, "abcdefghijklmnopqrstuvwxy")]
    for df, least in ((names, 0.9), (names, 0.75), (spark.createDataFrame(texts, "id long, n string"), 0.8)):
        want = brute(df, "id", "n", 2, 200, least)
        for most in (4096, 5):
            got = [tuple(r) for r in utility.lsh_link(df, "id", "n", 2, 200, 2, KEY, least, most)[0].collect()]
            assert len(got) == len(want) > 50 and {(a, b): d for a, b, d in got} == want


def test_covering_tables_cover():
    """Whatever few bits differ, some table holds none of them; more tables than one are needed."""
    for radius in (1, 2, 3, 4, 6):
        tables = [set(t) for t in utility.covering_tables(16, radius, KEY)]
        for r in range(1, radius + 1):
            assert all(any(t.isdisjoint(d) for t in tables) for d in combinations(range(16), r))


def test_sizes_of_similar_sets_are_in_one_level_or_the_next():
    for least in (0.5, 0.8, 0.96, 1.0):
        of = {n: i for i, (low, high) in enumerate(utility._levels(300, least)) for n in range(low, high + 1)}
        assert sorted(of) == list(range(1, 301))
        assert all(of[b] - of[a] <= 1 for a in of for b in of if b >= a and 2 * a / (a + b) >= least)


def test_pairs_of_rows_by_their_classes(spark):
    """1500 names at 0.9: the pairs of classes with their members, and the members of one class, are all pairs of rows."""
    df = io.read(spark, "/root/testdata/sf0.01", "customer")
    own = encodings(df, 512)
    want = {(a, b) for (a, x), (b, y) in combinations(sorted(own.items()), 2) if 2 * len(x & y) / (len(x) + len(y)) >= 0.9}
    pairs, members = utility.lsh_link(df, "c_custkey", "c_name", 2, 512, 2, KEY, 0.9)
    of = {}
    for r in members.collect():
        of.setdefault(r["class"], []).append(r["id"])
    got = [(min(i, j), max(i, j)) for r in pairs.collect() for i in of[r["a"]] for j in of[r["b"]]] + [p for m in of.values() for p in combinations(sorted(m), 2)]
    assert len(got) == len(want) and set(got) == want
