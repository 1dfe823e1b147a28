"""Statistics and ranks within groups, of which one may hold a large part of all rows.

A window over such a group is one task. Here statistics are aggregated, partly before the shuffle, and joined
back; ranks come from a sort by ranges, which cuts a large group, and the counts of the ranges before.
Names of columns that begin with two underscores are reserved.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import small, stash


def same(left: DataFrame, right: DataFrame, by: list[str], prefix: str = "__b") -> Column:
    """Equality by the columns in `by`, which are numbered `prefix` in right; nulls are equal."""
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[f"{prefix}{i}"]) for i, c in enumerate(by)], F.lit(True))


def annotate(df: DataFrame, by: list[str], *stats: Column) -> DataFrame:
    """df with aggregates of each row's group, nulls in `by` being a value."""
    found = df.groupBy(*[F.col(c).alias(f"__b{i}") for i, c in enumerate(by)]).agg(*stats)
    if not by:
        return df.join(F.broadcast(found))  # one row
    found = small(stash(found, "groups"))
    return df.join(found, same(df, found, by), "left").drop(*[f"__b{i}" for i in range(len(by))])


def running(df: DataFrame, by: list[str], order: list, name: str, weight: Column | None = None, after: str | None = None) -> DataFrame:
    """df with the sum of `weight` (1) over the rows of its group up to this one in an order that ends in a unique column.

    With `after`, also the first `order` column of the next row of the group, or null.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    keys = [f"__o{i}" for i in range(len(order))]
    df = df.withColumns(dict(zip(keys, order, strict=True)) | {"__w": F.lit(1).cast("long") if weight is None else weight})
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)
    cut = stash(df.repartitionByRange(parts, *by, *keys).withColumn("__p", F.spark_partition_id()), "ranges")
    names = [F.col(c).alias(f"__b{i}") for i, c in enumerate(by)]
    grouped = [f"__b{i}" for i in range(len(by))]
    sums = cut.groupBy(*names, "__p").agg(F.sum("__w").alias("__sum"), F.min(F.struct("__o0")).alias("__low"))
    w = Window.partitionBy(*grouped).orderBy("__p")  # a row for each range that a group lies in
    sums = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("__next", F.lead("__low").over(w))
    sums = small(stash(sums.select(*grouped, F.col("__p").alias("__q"), "__before", "__next"), "range-sums"))
    out = cut.join(sums, same(cut, sums, by) & (cut["__p"] == sums["__q"]))
    own = Window.partitionBy(*by, "__p").orderBy(*keys)
    out = out.withColumn(name, F.col("__before") + F.sum("__w").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    if after:
        out = out.withColumn(after, F.coalesce(F.lead(F.struct("__o0")).over(own), F.col("__next"))["__o0"])
    return out.drop(*keys, *grouped, "__w", "__p", "__q", "__before", "__next")


def carried(df: DataFrame, order: list[str], mark: str, name: str) -> DataFrame:
    """df with the last non-null `mark` of the rows up to this one, in a total order: sorted by ranges, carried over their borders."""
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)
    cut = stash(df.repartitionByRange(parts, *order).withColumn("__p", F.spark_partition_id()), "ranges")
    ends = cut.where(F.col(mark).isNotNull()).groupBy("__p").agg(F.max_by(mark, F.struct(*order)).alias("__end"))  # a row a range
    every = df.sparkSession.range(parts).select(F.col("id").cast("int").alias("__q")).join(ends, F.col("__q") == F.col("__p"), "left").drop("__p")
    before = F.last("__end", ignorenulls=True).over(Window.orderBy("__q").rowsBetween(Window.unboundedPreceding, -1))
    before = every.withColumn("__before", before).select("__q", "__before")
    own = F.last(F.col(mark), ignorenulls=True).over(Window.partitionBy("__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return cut.withColumn(name, own).join(F.broadcast(before), F.col("__p") == F.col("__q"), "left").withColumn(name, F.coalesce(name, "__before")).drop("__p", "__q", "__before")


def grouped_quantiles(df: DataFrame, by: list[str], col: str, share: float, name: str) -> DataFrame:
    """By group: the exact quantile by linear interpolation, null without values. Values are counted and ranked by ranges; no group is held whole."""
    counts = df.where(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count("*").alias("__c"))
    ranked = annotate(running(counts, by, [col], "__upto", F.col("__c")), by, F.sum("__c").alias("__all"))
    at = (F.col("__all") - 1) * share
    low, high = F.floor(at) + 1, F.ceil(at) + 1
    has = lambda rank: F.when((rank <= F.col("__upto")) & (rank > F.col("__upto") - F.col("__c")), F.col(col))
    pair = ranked.groupBy(*by).agg(F.max(has(low)).alias("__l"), F.max(has(high)).alias("__h"), F.max(at - F.floor(at)).alias("__f"))
    found = pair.select(*by, (F.col("__l") + (F.col("__h") - F.col("__l")) * F.col("__f")).alias(name))
    groups = df.select(*[F.col(c).alias(f"__b{i}") for i, c in enumerate(by)]).distinct()
    return groups.join(found, same(found, groups, by), "left").select(*[F.col(f"__b{i}").alias(c) for i, c in enumerate(by)], name)


def quantiles(df: DataFrame, col: str, shares: list[float]) -> list[float | None]:
    """Exact quantiles by linear interpolation: values are counted, ranked by ranges, and those at the ranks asked for are fetched."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n"))
    ranked = stash(running(counts, [], [col], "upto", F.col("n")), "ranked")
    total = ranked.agg(F.max("upto").alias("n")).first()["n"]
    if not total:
        return [None] * len(shares)
    at = [(total - 1) * p for p in shares]
    want = sorted({int(a) + i for a in at for i in (1, 2)})
    hit = F.exists(F.array(*map(F.lit, want)), lambda r: (r <= F.col("upto")) & (r > F.col("upto") - F.col("n")))
    found = sorted((r["upto"], r[col]) for r in ranked.where(hit).collect())  # two rows for each share at most
    value = lambda rank: next((v for upto, v in found if upto >= rank), found[-1][1])
    return [value(int(a) + 1) + (value(int(a) + 2) - value(int(a) + 1)) * (a - int(a)) for a in at]
