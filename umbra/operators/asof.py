"""As-of join of two tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import stash


def asof_join(left: DataFrame, right: DataFrame, by: dict[str, str], on: tuple[str, str], tie: str, tolerance: Column | None = None, suffix: str = "_right") -> DataFrame:
    """Each left row with the last right row of its key at or before its time, or nulls: left's columns, then right's.

    by: left column -> right column; on: the times of left and right. Of right rows of one time the greatest by the
    right column `tie` counts. With a tolerance (in the unit of left time minus right time) older matches are
    nulls. A null key or time matches nothing. Columns of the right that the left has too get the suffix.

    Both sides are united and sorted by ranges of key and time, so a key with a large part of all rows lies in
    several tasks; the last right row before a range is carried into it. Only a key that several ranges
    hold is carried: at most the first and the last of each range, which is broadcast.
    """
    spark, width = left.sparkSession, len(by)
    keys = [f"__k{i}" for i in range(width)]
    known = lambda cols: [F.col(c).isNotNull() for c in cols]
    l_by, r_by = list(by), list(by.values())
    names = {c: c + suffix if c in left.columns else c for c in right.columns}
    if len({*left.columns, *names.values()}) < len(left.columns) + len(names):
        raise ValueError("columns clash: choose another suffix")
    own = left.select(*[F.col(c).alias(k) for k, c in zip(keys, l_by, strict=True)], F.col(on[0]).alias("__t"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__left"))
    other = right.where(_all(known([*r_by, on[1]]))).select(*[F.col(c).alias(k) for k, c in zip(keys, r_by, strict=True)], F.col(on[1]).alias("__t"), F.lit(0).alias("__side"), F.col(tie).alias("__tie"), F.struct(*right.columns).alias("__right"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    # Left rows of one key and time are dealt among themselves by their hash: no order between them matters.
    both = own.unionByName(other, allowMissingColumns=True).withColumn("__deal", F.xxhash64(*[F.col("__left")[c] for c, t in left.dtypes if "map<" not in t]))
    cut = stash(both.repartitionByRange(parts, *keys, "__t", "__side", "__tie", "__deal").drop("__deal").withColumn("__p", F.spark_partition_id()), "asof")

    ends = cut.groupBy(*keys, "__p").agg(F.max_by(F.when(F.col("__side") == 0, F.struct("__t", "__right")), F.when(F.col("__side") == 0, F.struct("__t", "__tie"))).alias("__end"))
    key = Window.partitionBy(*keys)
    before = F.last("__end", ignorenulls=True).over(key.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.withColumns({"__ranges": F.count("*").over(key), "__carried": before}).where("__ranges > 1 and __carried is not null")
    carried = F.broadcast(stash(ends.select(*[F.col(k).alias(f"{k}_") for k in keys], F.col("__p").alias("__q"), "__carried"), "asof-ends"))

    here = Window.partitionBy(*keys, "__p").orderBy("__t", "__side", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    found = cut.withColumn("__here", F.last(F.when(F.col("__side") == 0, F.struct("__t", "__right")), ignorenulls=True).over(here)).where("__side = 1")
    found = found.join(carried, _all([F.col(k) == F.col(f"{k}_") for k in keys] + [F.col("__p") == F.col("__q")]), "left")
    match = F.coalesce("__here", "__carried")
    near = F.lit(True) if tolerance is None else F.col("__t") - match["__t"] <= tolerance
    found = found.withColumn("__match", F.when(_all(known([*keys, "__t"])) & near, match["__right"]))
    return found.select("__left.*", *[F.col("__match")[c].alias(n) for c, n in names.items()])


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out
