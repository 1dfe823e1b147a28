"""Quasi-identifiers: generalization, suppression, perturbation. Every order that decides a row's
fate ends in a unique column, given by the caller. Nulls pass through as nulls; a null group is a group."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import draws
from ..sources.io import small
from .groups import annotate, quantiles, running, same


def bin_(col: str | Column, width: float) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return (F.floor(c / F.lit(float(width))) * width).cast("bigint")


def trunc_date(col: str, unit: str) -> Column:
    return F.date_trunc(unit, F.col(col)).cast("timestamp_ntz")


def generalize(df: DataFrame, col: str, hierarchy: DataFrame, level: int) -> DataFrame:
    """col replaced by column `level<n>` of the hierarchy (level0: the value); null where the hierarchy lacks it."""
    h = small(hierarchy.select(F.col("level0").alias("__0"), F.col(f"level{level}").alias("__n")))
    return df.join(h, F.col(col) == F.col("__0"), "left").withColumn(col, F.col("__n")).drop("__0", "__n")


def round_to(col: str, d: int) -> Column:
    return F.round(F.col(col), d)


def clip(col: str | Column, lo: float, hi: float) -> Column:
    """Values outside are moved to the bounds; nulls stay null."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(float(lo))), F.lit(float(hi))))


def winsorize(df: DataFrame, col: str, p: float) -> DataFrame:
    """Clamp to the exact p and 1-p quantiles."""
    lo, hi = quantiles(df, col, [p, 1 - p])
    return df if lo is None else df.withColumn(col, clip(col, lo, hi))


def microaggregate(df: DataFrame, col: str, k: int, within: list[str], order: str) -> DataFrame:
    """Values replaced by the mean of groups of at least k neighbours within each partition; nulls are neither counted nor replaced."""
    known = annotate(running(df.where(F.col(col).isNotNull()), within, [col, order], "__r"), within, F.count("*").alias("__n"))
    group = F.least(F.floor((F.col("__r") - 1) / k), F.greatest(F.floor(F.col("__n") / k) - 1, F.lit(0)))
    out = annotate(known.withColumn("__g", group), [*within, "__g"], F.avg(col).alias("__m")).withColumn(col, F.col("__m"))
    return out.select(*df.columns).unionByName(df.where(F.col(col).isNull()))


def swap(df: DataFrame, col: str, within: list[str], key: str, salt: str) -> DataFrame:
    """A permutation of the column's values inside each group, drawn by two hashes of the key."""
    u, v = (draws.uniform(salt + s, key) for s in ("a", "b"))
    left = running(df, within, [u, key], "__r")
    right = running(df.select(*within, key, F.col(col).alias("__v")), within, [v, key], "__s").drop(key)
    right = right.select("__v", "__s", *[F.col(c).alias(f"__b{i}") for i, c in enumerate(within)])
    return left.join(right, same(left, right, within) & (left["__r"] == right["__s"])).withColumn(col, F.col("__v")).select(*df.columns)


def shift_dates(df: DataFrame, col: str, unit: str, days: int, salt: str) -> DataFrame:
    """All dates of a unit moved back by one number of days, which keeps their gaps."""
    n = F.floor(draws.uniform(salt, unit) * days).cast("int")
    return df.withColumn(col, F.col(col) - F.make_dt_interval(n))


def add_noise(df: DataFrame, col: str, sigma: float, key: str, salt: str, draw=draws.fresh) -> DataFrame:
    """Normal noise on each value; nulls stay null."""
    noisy = df.withColumns({"__u": draw(salt + "a", key), "__v": draw(salt + "b", key)})
    return noisy.withColumn(col, F.col(col) + sigma * draws.normal(F.col("__u"), F.col("__v"))).drop("__u", "__v")


def pram(df: DataFrame, col: str, matrix: dict[str, dict[str, float]], key: str, salt: str, draw=draws.fresh) -> DataFrame:
    """Post-randomization: a value becomes another one with the probability that its row of the matrix gives; values without a row stay."""
    new, u = F.col(col), F.col("__u")
    for value, row in matrix.items():
        if abs(sum(row.values()) - 1) > 1e-9 or min(row.values()) < 0:
            raise ValueError(f"probabilities of {value!r} do not add up to 1")
        names, edges = list(row), list(accumulate(row.values()))
        to = F.lit(names[-1])
        for name, edge in reversed(list(zip(names[:-1], edges[:-1], strict=True))):
            to = F.when(u < edge, F.lit(name)).otherwise(to)
        new = F.when(F.col(col) == value, to).otherwise(new)
    return df.withColumn("__u", draw(salt, key)).withColumn(col, new).drop("__u")


def suppress_cells(df: DataFrame, qi: list[str], k: int, order: list[str]) -> DataFrame:
    """Columns set to null, one after the other, in rows whose class is still below k."""
    for c in order:
        df = annotate(df, qi, F.count("*").alias("__k")).withColumn(c, F.when(F.col("__k") >= k, F.col(c))).drop("__k")
    return df


def sample(df: DataFrame, rate: float, key: str, salt: str) -> DataFrame:
    return df.where(draws.uniform(salt, key) < rate)


def normalize(df: DataFrame, col: str, how: str = "minmax", within: list[str] = ()) -> DataFrame:
    """Min-max or z-score within groups; null where all values of a group are equal."""
    lo, hi = (F.min(col), F.max(col)) if how == "minmax" else (F.avg(col), F.stddev_samp(col))
    out = annotate(df, list(within), lo.alias("__lo"), hi.alias("__hi"))
    width = F.col("__hi") - F.col("__lo") if how == "minmax" else F.col("__hi")
    return out.withColumn(col, F.when(width != 0, (F.col(col) - F.col("__lo")) / width)).drop("__lo", "__hi")


def noise_vector(df: DataFrame, col: str, bound: float, sigma: float, key: str, salt: str, draw=draws.fresh) -> DataFrame:
    """Vectors scaled to a norm of at most `bound`, plus normal noise on each component; null vectors and components stay null."""
    v, many = F.col(col).cast("array<double>"), draws.many(draw)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    scale = F.when(norm > bound, bound / norm).otherwise(1.0)
    size = F.greatest(F.size(F.coalesce(col, F.array())), F.lit(0))
    noisy = df.withColumns({"__u": many(salt + "a", size, key), "__v": many(salt + "b", size, key)})
    noise = lambda i: draws.normal(F.get("__u", i), F.get("__v", i))
    return noisy.withColumn(col, F.transform(v, lambda x, i: x * scale + sigma * noise(i))).drop("__u", "__v")
