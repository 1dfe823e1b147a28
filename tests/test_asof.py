"""The as-of join of two tables: ties, nulls, tolerance, a key with most of the rows."""

import random

import pytest
from pyspark.sql import functions as F

from umbra.operators.asof import asof_join

LEFT, RIGHT = "id long, k string, t int, v int", "rid long, key string, t int, v int"


def brute(left, right, tolerance=None):
    out = []
    for id_, k, t, v in left:
        own = [(r[2], r[0], r) for r in right if k is not None and r[1] == k and t is not None and r[2] is not None and r[2] <= t]
        best = max(own, default=(None, None, (None,) * 4), key=lambda x: x[:2])[2]
        if best[2] is not None and tolerance is not None and t - best[2] > tolerance:
            best = (None,) * 4
        out.append((id_, k, t, v, *best))
    return sorted(out, key=str)


def tables(spark, n, seed=0):
    draw = random.Random(seed)
    key = lambda: draw.choice(["hot"] * 6 + ["a", "b", "left only", None])
    left = [(i, key(), draw.choice([None, *range(40)]), i % 5) for i in range(n)]
    right = [(i, draw.choice(["hot"] * 4 + ["a", "b", "right only", None]), draw.choice([None, *range(40)]), i % 7) for i in range(n)]
    return left, right, spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT)


@pytest.mark.parametrize("tolerance", [None, 3])
def test_equals_brute_force(spark, tolerance):
    left, right, l, r = tables(spark, 400)  # noqa: E741
    out = asof_join(l, r, {"k": "key"}, ("t", "t"), "rid", None if tolerance is None else F.lit(tolerance))
    assert out.columns == ["id", "k", "t", "v", "rid", "key", "t_right", "v_right"]
    assert sorted(map(tuple, out.collect()), key=str) == brute(left, right, tolerance)


def test_matches_are_carried_over_many_ranges(spark):
    """One right row long before all left rows of its key; the hot key lies in several tasks."""
    l = spark.range(4000).select(F.col("id"), F.lit("hot").alias("k"), (F.col("id") + 10).cast("int").alias("t"))  # noqa: E741
    r = spark.createDataFrame([(7, "hot", 1), (8, "cold", 1)], "rid long, k string, s int")
    out = asof_join(l, r, {"k": "k"}, ("t", "s"), "rid")
    assert {x["rid"] for x in out.collect()} == {7} and out.count() == 4000
    assert "k_right" in out.columns


def test_cases(spark):
    left, right, l, r = tables(spark, 50, 1)  # noqa: E741
    none = asof_join(l, r.limit(0), {"k": "key"}, ("t", "t"), "rid").collect()
    assert len(none) == 50 and all(x["rid"] is None for x in none)
    assert asof_join(l.limit(0), r, {"k": "key"}, ("t", "t"), "rid").count() == 0
    twice = asof_join(l.union(l), r, {"k": "key"}, ("t", "t"), "rid").collect()
    assert sorted(map(tuple, twice), key=str) == sorted(2 * brute(left, right), key=str)
    with pytest.raises(ValueError, match="suffix"):
        asof_join(l.withColumn("t_right", F.lit(1)), r, {"k": "key"}, ("t", "t"), "rid")


def test_a_hot_key_is_split(spark):
    """The largest task of the sorted rows holds a small part of a key that has all of them."""
    l = spark.range(8000).select("id", F.lit("hot").alias("k"), F.col("id").alias("t"))  # noqa: E741
    out = asof_join(l, l.withColumnRenamed("id", "rid"), {"k": "k"}, ("t", "t"), "rid")
    sizes = [x["n"] for x in out.groupBy((F.col("rid") == F.col("id")).alias("same")).agg(F.count("*").alias("n")).collect()]
    assert sizes == [8000]
    from umbra.operators import asof

    seen = []
    keep = asof.stash
    asof.stash = lambda df, tag: seen.append(keep(df, tag)) or seen[-1]
    try:
        asof_join(l, l.withColumnRenamed("id", "rid"), {"k": "k"}, ("t", "t"), "rid").count()
    finally:
        asof.stash = keep
    parts = [x["n"] for x in seen[0].groupBy("__p").agg(F.count("*").alias("n")).collect()]
    assert len(parts) >= 6 and max(parts) < 16000 / 3
