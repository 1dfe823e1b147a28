"""Random draws, as functions (salt, *keys) -> column in (0, 1).

`fresh` asks the operating system: for releases, which must be written once, as a rerun draws anew. `uniform`
is derived from an MD5 of salt and keys, so it repeats: for tests, and for sampling and shuffling that has to
repeat. Whoever knows the salt can take noise made of it off again.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

#: Stands for a null key, so that (a, null) and (null, a) differ.
NULL = "\\N"


def text(*keys) -> Column:
    return F.concat_ws("|", *[F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit(NULL)) for k in keys])


def uniform(salt: str, *keys) -> Column:
    """In (0, 1), from 32 bits of an MD5."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(salt), text(*keys))), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def _secure(anchor: pd.Series) -> pd.Series:
    import os

    raw = os.urandom(8 * len(anchor))
    return pd.Series([(int.from_bytes(raw[8 * i : 8 * i + 8], "little") >> 11) / 2.0**53 + 2.0**-54 for i in range(len(anchor))])


def fresh(salt: str, *keys) -> Column:
    """In (0, 1), from the operating system; the arguments tell draws of one row apart. Each use of the column draws: put it into a column first."""
    udf = F.pandas_udf(_secure, DoubleType()).asNondeterministic()
    return udf(F.concat(F.lit(salt), text(*keys)))


def uniform_many(salt: str, size: Column | int, *keys) -> Column:
    """An array of uniform(salt, *keys, i), i from 0."""
    n = size if isinstance(size, Column) else F.lit(size)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: uniform(salt, *keys, i))).otherwise(F.array().cast("array<double>"))


def _secure_many(size: pd.Series) -> pd.Series:
    draws = _secure(pd.Series(range(int(size.sum()))))
    ends = size.astype(int).cumsum()
    return pd.Series([draws.iloc[e - n : e].tolist() for e, n in zip(ends, size.astype(int), strict=True)])


def fresh_many(salt: str, size: Column | int, *keys) -> Column:
    """An array of draws from the operating system; put it into a column first, as each use draws."""
    udf = F.pandas_udf(_secure_many, ArrayType(DoubleType())).asNondeterministic()
    return udf(F.coalesce(size if isinstance(size, Column) else F.lit(size), F.lit(0)))


def many(draw):
    """The form of `uniform` or `fresh` that gives arrays."""
    return {uniform: uniform_many, fresh: fresh_many}[draw]


def laplace(u: Column, scale) -> Column:
    c = u - 0.5
    return F.signum(c) * -scale * F.log(1 - 2 * F.abs(c))


def geometric(u: Column, v: Column, epsilon: float, sensitivity: float = 1.0) -> Column:
    """Two-sided geometric noise, as the difference of two one-sided draws."""
    log_a = -epsilon / sensitivity
    return (F.floor(F.log(u) / log_a) - F.floor(F.log(v) / log_a)).cast("bigint")


def normal(u: Column, v: Column) -> Column:
    """Box-Muller."""
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)


def gumbel(u: Column) -> Column:
    return -F.log(-F.log(u))


def uniform_sql(salt: str, *keys: str) -> str:
    """uniform() for DuckDB."""
    parts = ", ".join(f"coalesce(({k})::varchar, '{NULL}')" for k in keys)
    return f"((('0x' || substr(md5('{salt}' || concat_ws('|', {parts})), 1, 8))::bigint + 0.5::double) / 4294967296::double)"
