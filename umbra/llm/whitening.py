"""Embedding whitening by upper-triangle column aggregates (operator 11).

One aggregation sums every dimension; a second one sums the centred products of every pair of dimensions, upper
triangle, as generated SQL expressions. The driver assembles the covariance (dim * dim numbers), decomposes it with
LAPACK, and the eigenvectors go back to the rows as generated expressions. No row leaves the executors, nothing is
shuffled but one row of sums a task.

Integers are centred at the integer part of their mean, so that products and sums are whole numbers, which doubles
hold exactly up to 2^53, in any order of the rows; what the mean's fraction adds is taken off the assembled
covariance.

Defined cases: rows whose vector is null or holds a null or non-finite entry take no part, and are not returned;
shorter vectors count as if zeros filled them up to the longest; a direction without variance (eigenvalue below
trace * 1e-12) has whitened null, and is left out of identity_error; with fewer dimensions than components there
are as many components as dimensions; an empty table gives an empty result; repeated ids are rows of their own;
other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import whole

#: Expressions of one aggregation; vectors of more dimensions (over 126) take several of them.
PAIRS = 8192
#: An eigenvalue below this share of the trace is no variance.
LEAST = 1e-12


@dataclass
class Whitening:
    """n rows, each dimension's sum and range, the covariance V (divisor n), its eigenvalues, falling, and eigenvectors, as columns."""

    n: int
    total: np.ndarray
    width: int
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray


def integers(df: DataFrame, id_col: str, vec_col: str, scale: float, offset: int) -> DataFrame:
    """(id, x array<long>): floor(scale * c) + offset of each entry, rows with null or non-finite ones dropped."""
    own = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).where(whole(F.col("v")))
    return own.select("id", F.transform("v", lambda c: F.floor(c.cast("double") * scale).cast("long") + offset).alias("x"))


def entries(df: DataFrame, dim: int, fill: int) -> DataFrame:
    """x as columns x0, x1, ...; `fill` where a vector is too short."""
    return df.select("id", *[F.coalesce(F.get("x", F.lit(i)), F.lit(fill).cast("long")).alias(f"x{i}") for i in range(dim)])


def products(df: DataFrame, names: list[str]) -> np.ndarray:
    """The sums over all rows of the products of every two of these columns: one expression a pair, each pair once."""
    dim = len(names)
    pairs = [(i, j) for i in range(dim) for j in range(i, dim)]
    out = np.zeros((dim, dim))
    for at in range(0, len(pairs), PAIRS):
        part = pairs[at : at + PAIRS]
        row = df.agg(*[F.expr(f"sum({names[i]} * {names[j]}) as p{k}") for k, (i, j) in enumerate(part)]).first()
        for (i, j), p in zip(part, row, strict=True):
            out[i, j] = out[j, i] = p
    return out


def fit(df: DataFrame, fill: int = 0) -> tuple[Whitening | None, DataFrame]:
    """The whitening of (id, x array<long>), or None without rows, and x as columns."""
    dim = df.agg(F.max(F.size("x"))).first()[0] or 0
    cols = entries(df, dim, fill)
    each = [F.expr(f"{f}(x{i}) as {f}{i}") for i in range(dim) for f in ("sum", "min", "max")]
    row = cols.agg(F.count("*").alias("n"), *each).first()
    n = row["n"]
    if not n or not dim:
        return None, cols
    total = [row[f"sum{i}"] for i in range(dim)]
    centred = cols.select(*[(F.col(f"x{i}") - F.lit(total[i] // n)).cast("double").alias(f"c{i}") for i in range(dim)])
    rest = np.array([(s % n) / n for s in total])
    v = products(centred, [f"c{i}" for i in range(dim)]) / n - np.outer(rest, rest)
    values, vectors = np.linalg.eigh(v)  # LAPACK's symmetric driver
    width = max(row[f"max{i}"] - row[f"min{i}"] for i in range(dim))
    return Whitening(n, np.array(total, object), width, v, values[::-1].copy(), vectors[:, ::-1].copy()), cols


def projections(model: Whitening, components: int) -> list[Column]:
    """The first whitened components, as generated sums over the columns x0, x1, ...; null without variance."""
    trace, out = float(np.trace(model.covariance)), []
    for k in range(min(components, len(model.values))):
        e = float(model.values[k])
        if e <= LEAST * trace:
            out.append(F.lit(None).cast("double"))
            continue
        terms = [f"(cast(x{i} as double) - {s / model.n!r}D) * {w!r}D" for i, (s, w) in enumerate(zip(model.total, map(float, model.vectors[:, k]), strict=True))]
        out.append(F.expr(f"({' + '.join(terms)}) / sqrt({e!r}D)"))
    return out


def identity_error(cols: DataFrame, model: Whitening, components: int) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity, as measured over all rows."""
    white = cols.select(*[p.alias(f"w{k}") for k, p in enumerate(projections(model, components))])
    names = [f"w{k}" for k, e in enumerate(model.values[:components]) if e > LEAST * float(np.trace(model.covariance))]
    if not names:
        return 0.0
    means = np.array(white.agg(*[F.avg(c) for c in names]).first(), float)
    return float(np.abs(products(white, names) / model.n - np.outer(means, means) - np.eye(len(names))).max())


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 8, scale: float = 1024.0, offset: int = 100_000) -> DataFrame:
    """(id, component from 1, n, deviation, whitened, explained, identity_error) of each row that takes part.

    x = floor(scale * entry) + offset; deviation is the sum over dimensions of (n * x - S)^2, S the dimension's sum over all n rows, as a whole
    number: a value beyond a long raises an error. whitened is x - S/n on the component, over the square root of its eigenvalue.
    """
    own = integers(df, id_col, vec_col, scale, offset)
    model, cols = fit(own, offset)
    if model is None:
        empty = "component int, n long, deviation long, whitened double, explained double, identity_error double"
        return df.sparkSession.createDataFrame([], f"`{id_col}` {dict(df.dtypes)[id_col]}, {empty}")
    n, dim = model.n, len(model.total)
    kind = "long" if dim * (n * model.width) ** 2 < 2**63 else "decimal(38,0)"
    gaps = [F.lit(n).cast(kind) * F.col(f"x{i}") - F.lit(int(s)).cast(kind) for i, s in enumerate(model.total)]
    deviation = sum((g * g for g in gaps[1:]), gaps[0] * gaps[0]).cast("long")
    trace = float(np.trace(model.covariance))
    share = [F.lit(float(e) / trace if trace else None).cast("double") for e in model.values[:components]]
    error = identity_error(cols, model, components)
    white = F.array(*[F.struct(F.lit(k + 1).alias("component"), p.alias("whitened"), share[k].alias("explained")) for k, p in enumerate(projections(model, components))])
    out = cols.select(F.col("id").alias(id_col), deviation.alias("deviation"), F.explode(white).alias("w"))
    return out.select(id_col, "w.component", F.lit(n).cast("long").alias("n"), "deviation", "w.whitened", "w.explained", F.lit(error).alias("identity_error"))
