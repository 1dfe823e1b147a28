"""Mondrian against a plain reading of its rule: k rows in each part, and no part that could still be split."""

from collections import defaultdict

from umbra.operators import risk


def check(rows, qi, k):
    parts = defaultdict(list)
    for r in rows:
        parts[r["part"]].append(r)
    for own in parts.values():
        assert len(own) >= k
        for c in qi:
            values = sorted(float("inf") if r[c] is None else r[c] for r in own)
            assert not any(values[i - 1] < values[i] for i in range(k, len(values) - k + 1)), (c, len(own))
    return parts


def test_splits_until_no_part_can_be_split(spark):
    df = spark.range(6000).selectExpr("id", "(id * 7919) % 6000 as a", "cast((id * 31) % 97 as double) as b")
    rows = risk.mondrian(df, ["a", "b"], 1).collect()
    assert len(check(rows, ["a", "b"], 1)) == len(rows) == 6000


def test_other_attributes_and_cuts(spark):
    """The widest attribute has one value but for one row; values tie at the top; nulls; nothing to split."""
    data = [(i, 1000.0 if i == 0 else 1.0, i % 10, None) for i in range(200)] + [(300 + i, None, 9, 1) for i in range(30)]
    df = spark.createDataFrame(data, "id long, a double, b int, c int")
    parts = check(risk.mondrian(df, ["a", "b", "c"], 10).collect(), ["a", "b", "c"], 10)
    assert sum(map(len, parts.values())) == 230 and len(parts) > 10
    top = spark.createDataFrame([(i, min(i, 20)) for i in range(100)], "id long, a int")
    assert len(check(risk.mondrian(top, ["a"], 10).collect(), ["a"], 10)) >= 3
    assert risk.mondrian(df.limit(0), ["a", "b"], 10).count() == 0
