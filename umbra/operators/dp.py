"""Differential privacy: bounding, mechanisms, local reports, the ledger.

Noise comes from `draw`, by default `draws.fresh` (the operating system): write a release once. With
`draws.uniform` noise repeats and can be taken off by whoever knows the salt: for tests.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import draws
from .groups import running
from .quasi import clip


@dataclass
class Ledger:
    """Epsilon and delta spent, on the driver; every mechanism charges it before it runs.

    A charge is admitted if the sums stay within (epsilon, delta), or, with a `slack`, if the filter of fully adaptive
    composition does (Whitehouse et al. 2023): sqrt(2 ln(1/slack) S) + S/2 <= epsilon, S the sum of squared epsilons, and the
    deltas plus slack <= delta. Both may differ from mechanism to mechanism and be chosen as results come in.
    """

    epsilon: float
    delta: float = 0.0
    slack: float = 0.0
    spent: list[tuple[str, float, float]] = field(default_factory=list)

    def spend(self, name: str, epsilon: float, delta: float = 0.0) -> None:
        if epsilon < 0 or delta < 0:
            raise ValueError(f"{name}: a negative budget")
        after = [*self.spent, (name, epsilon, delta)]
        if not any(e <= self.epsilon + 1e-12 and d <= self.delta + 1e-15 for e, d in self._costs(after)):
            raise ValueError(f"{name}: over budget")
        self.spent.append((name, epsilon, delta))

    def _costs(self, spent: list[tuple[str, float, float]]) -> list[tuple[float, float]]:
        basic = sum(s[1] for s in spent), sum(s[2] for s in spent)
        if not self.slack:
            return [basic]
        squares = sum(s[1] ** 2 for s in spent)
        return [basic, (math.sqrt(2 * math.log(1 / self.slack) * squares) + squares / 2, basic[1] + self.slack)]

    def total(self) -> tuple[float, float]:
        """What was spent: the least epsilon of the rules whose delta is within the budget."""
        return min(c for c in self._costs(self.spent) if c[1] <= self.delta + 1e-15)

    def advanced(self, slack: float) -> tuple[float, float]:
        """Advanced composition of what was spent, with the given extra delta, where the epsilons were fixed beforehand (Kairouz, Oh and Viswanath 2015)."""
        each = [s[1] for s in self.spent]
        squares = sum(e * e for e in each)
        drift = sum(e * (math.exp(e) - 1) / (math.exp(e) + 1) for e in each)
        low = min(sum(each), drift + math.sqrt(2 * squares * math.log(math.e + math.sqrt(squares) / slack)), drift + math.sqrt(2 * squares * math.log(1 / slack)))
        return low, 1 - (1 - slack) * math.prod(1 - s[2] for s in self.spent)


def charge(ledger: Ledger | None, name: str, epsilon: float, delta: float = 0.0) -> None:
    if ledger:
        ledger.spend(name, epsilon, delta)


def bound_contributions(df: DataFrame, unit: str, m: int, key: str, salt: str = "bound") -> DataFrame:
    """At most m rows of each unit, drawn by hash."""
    w = Window.partitionBy(unit).orderBy(draws.uniform(salt, key), key)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= m).drop("__r")


def gaussian_sigma(epsilon: float, delta: float, sensitivity: float) -> float:
    """The analytic calibration (Balle and Wang 2018): the least sigma that gives (epsilon, delta), by bisection."""
    if not 0 < delta < 1:
        raise ValueError("the Gaussian mechanism needs 0 < delta < 1")
    phi = lambda x: (1 + math.erf(x / math.sqrt(2))) / 2
    spent = lambda s: phi(1 / (2 * s) - epsilon * s) - math.exp(epsilon) * phi(-1 / (2 * s) - epsilon * s)
    lo, hi = 1e-6, 1.0
    while spent(hi) > delta:
        hi *= 2
    for _ in range(100):
        lo, hi = (lo, (lo + hi) / 2) if spent((lo + hi) / 2) <= delta else ((lo + hi) / 2, hi)
    return hi * sensitivity


def private_agg(df: DataFrame, keys: list[str], unit: str, key: str, value: str, bounds: tuple[float, float], m: int, epsilon: float, mechanism: str = "laplace", delta: float = 0.0, draw=draws.fresh, salt: str = "agg", ledger: Ledger | None = None, name: str = "agg") -> DataFrame:
    """Noisy count, sum and mean by group: bounded to m rows a unit, clamped, half the budget each for count and sum.

    Groups are released as they stand: their names must be public, or come from select_partitions.
    """
    if mechanism not in ("laplace", "geometric", "gaussian"):
        raise ValueError(mechanism)
    if mechanism != "gaussian" and delta:
        raise ValueError("only the Gaussian mechanism spends delta")
    charge(ledger, name, epsilon, delta)
    lo, hi = bounds
    half, top = epsilon / 2, m * max(abs(lo), abs(hi))
    out = bound_contributions(df, unit, m, key).groupBy(*keys).agg(F.count("*").alias("__c"), F.coalesce(F.sum(clip(value, lo, hi)), F.lit(0.0)).alias("__sum"))
    out = out.withColumns({f"__{x}": draw(salt + x, *keys) for x in ("n", "m", "s", "t")})
    u = {x: F.col(f"__{x}") for x in ("n", "m", "s", "t")}
    if mechanism == "gaussian":
        n, s = (gaussian_sigma(half, delta / 2, size) * draws.normal(u[a], u[b]) for size, a, b in ((m, "n", "m"), (top, "s", "t")))
    else:
        n = draws.laplace(u["n"], m / half) if mechanism == "laplace" else draws.geometric(u["n"], u["m"], half, m)
        s = draws.laplace(u["s"], top / half)
    out = out.withColumn("noisy_count", F.col("__c") + n).withColumn("noisy_sum", F.col("__sum") + s)
    return out.withColumn("noisy_mean", clip(F.col("noisy_sum") / F.greatest(F.col("noisy_count"), F.lit(1)), lo, hi)).drop("__c", "__sum", *[f"__{x}" for x in u])


def noisy_max(df: DataFrame, candidate: str, score: str, sensitivity: float, epsilon: float, draw=draws.fresh, salt: str = "max", ledger: Ledger | None = None, name: str = "max") -> DataFrame:
    """Exponential mechanism by Gumbel noise."""
    charge(ledger, name, epsilon)
    noisy = F.col(score) * epsilon / (2 * sensitivity) + draws.gumbel(F.col("__u"))
    return df.withColumn("__u", draw(salt, candidate)).agg(F.max_by(candidate, noisy).alias(candidate))


def private_quantile(df: DataFrame, col: str, q: float, lo: float, hi: float, epsilon: float, draw=draws.fresh, salt: str = "quantile", ledger: Ledger | None = None, name: str = "quantile") -> DataFrame:
    """Exponential mechanism on the gaps between the sorted clamped values (Smith 2011), then a uniform draw in the gap.

    A gap's weight is its width times exp(-epsilon / 2 * its distance in rank from q). Values are counted and
    ranked by ranges; units must be bounded to one row. Nulls are left out; without values the gap is [lo, hi].
    """
    charge(ledger, name, epsilon)
    own = df.where(F.col(col).isNotNull()).select(clip(col, lo, hi).alias("__v"))
    ends = df.sparkSession.createDataFrame([(float(lo), 0), (float(hi), 0)], "__v double, n long")
    counts = own.groupBy("__v").agg(F.count("*").alias("n")).unionByName(ends).groupBy("__v").agg(F.sum("n").alias("n"))
    gaps = running(counts, [], ["__v"], "__below", F.col("n"), after="__end").where("__end > __v")
    gaps = gaps.join(F.broadcast(counts.agg(F.sum("n").alias("__all"))))  # one row
    gaps = gaps.withColumn("__score", -F.abs(F.col("__below") - q * F.col("__all")) + 2 / epsilon * F.log(F.col("__end") - F.col("__v"))).withColumn("__gap", F.struct("__v", "__end"))
    best = gaps.withColumn("__u", draw(salt, "__v")).agg(F.max_by("__gap", F.col("__score") * epsilon / 2 + draws.gumbel(F.col("__u"))).alias("g"))
    return best.withColumn("__u", draw(salt + "at", F.lit(0))).select((F.col("g.__v") + F.col("__u") * (F.col("g.__end") - F.col("g.__v"))).alias("quantile"))


def partition_threshold(epsilon: float, delta: float, m: int) -> float:
    """A group of one unit passes it with probability delta / m about: so all groups that only one unit is in do with delta."""
    return 1 - m / epsilon * math.log(2 * (1 - (1 - delta) ** (1 / m)))


def select_partitions(df: DataFrame, keys: list[str], unit: str, epsilon: float, delta: float, m: int, draw=draws.fresh, salt: str = "partitions", ledger: Ledger | None = None, name: str = "partitions") -> DataFrame:
    """Groups whose noisy number of units passes a threshold, with that number: (epsilon, delta)-private.

    A unit counts in m of its groups at most, drawn by hash, so adding it changes m counts by 1: noise has scale m / epsilon.
    """
    charge(ledger, name, epsilon, delta)
    order = draws.uniform(salt + "m", unit, *keys)
    own = df.select(*keys, unit).distinct().withColumn("__r", F.row_number().over(Window.partitionBy(unit).orderBy(order, *keys))).where(F.col("__r") <= m)
    out = own.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("__u", draw(salt, *keys))
    out = out.withColumn("noisy_units", F.col("n") + draws.laplace(F.col("__u"), m / epsilon))
    return out.where(F.col("noisy_units") > partition_threshold(epsilon, delta, m)).drop("n", "__u")


def randomize(df: DataFrame, col: str, domain: list[str], epsilon: float, key: str, salt: str = "rr", draw=draws.fresh, ledger: Ledger | None = None, name: str = "response") -> DataFrame:
    """k-ary randomized response; values outside the domain, and nulls, answer as one of it at random. The ledger is each row's."""
    charge(ledger, name, epsilon)
    k = len(domain)
    keep = math.exp(epsilon) / (math.exp(epsilon) + k - 1)
    u, at = F.col("__u"), F.coalesce(F.array_position(F.array(*map(F.lit, domain)), F.col(col)), F.lit(0)).cast("int")
    step = (F.floor((u - keep) / (1 - keep) * (k - 1)) + 1).cast("int")
    other = F.element_at(F.array(*map(F.lit, domain)), F.pmod(at - 1 + step, F.lit(k)) + 1)
    any_ = F.element_at(F.array(*map(F.lit, domain)), (F.floor(u * k) + 1).cast("int"))
    return df.withColumn("__u", draw(salt, key)).withColumn(col, F.when(at == 0, any_).when(u < keep, F.col(col)).otherwise(other)).drop("__u")


def estimate_frequencies(df: DataFrame, col: str, domain: list[str], epsilon: float) -> DataFrame:
    """Unbiased counts from reports of randomize()."""
    k = len(domain)
    p = math.exp(epsilon) / (math.exp(epsilon) + k - 1)
    q = (1 - p) / (k - 1)
    n = df.agg(F.count("*").alias("__all"))
    return df.groupBy(col).agg(F.count("*").alias("n")).join(F.broadcast(n)).select(col, ((F.col("n") - F.col("__all") * q) / (p - q)).alias("estimate"))


def bloom_bits(value: Column, bits: int, hashes: int, salt: str = "bloom") -> Column:
    """The bits of a value's Bloom filter, by hash; two hashes may fall on one bit."""
    return F.array(*[F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(f"{salt}{i}"), value)), 1, 7), 16, 10).cast("bigint"), F.lit(bits)).cast("int") for i in range(hashes)])


def flip_rate(hashes: int, epsilon: float) -> float:
    """Two values differ in 2 * hashes bits at most."""
    return 1 / (1 + math.exp(epsilon / (2 * hashes)))


def bloom_report(df: DataFrame, col: str, bits: int, hashes: int, epsilon: float, key: str, salt: str = "bloom", draw=draws.fresh, ledger: Ledger | None = None, name: str = "bloom") -> DataFrame:
    """Bits of the value's Bloom filter, each flipped with probability 1/(1+e^(epsilon/2h)): column `report`. A null value sets no bit before the flips."""
    charge(ledger, name, epsilon)
    flip = flip_rate(hashes, epsilon)
    own = F.coalesce(bloom_bits(F.col(col).cast("string"), bits, hashes, salt), F.array().cast("array<int>"))
    noisy = df.withColumns({"__u": draws.many(draw)(salt, bits, key), "__own": own})
    said = F.transform("__u", lambda u, b: (F.array_contains("__own", b) != (u < flip)).cast("int"))
    return noisy.withColumn("report", said).drop("__u", "__own")


def debiased_bits(reports: DataFrame, bits: int, hashes: int, epsilon: float) -> DataFrame:
    """(bit, estimate, n): how many of the n rows set each bit before the flips, without bias; one aggregation, a sum a bit."""
    flip = flip_rate(hashes, epsilon)
    sums = reports.agg(F.count("*").alias("n"), *[F.sum(F.get("report", F.lit(b))).alias(f"b{b}") for b in range(bits)])
    each = F.array(*[F.coalesce(F.col(f"b{b}"), F.lit(0)) for b in range(bits)])
    return sums.select("n", F.posexplode(each).alias("bit", "c")).select("bit", ((F.col("c") - flip * F.col("n")) / (1 - 2 * flip)).alias("estimate"), "n")


def least_squares(a: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x >= 0 with the least |a x - y| (active sets)."""
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(10 * a.shape[1] + 10):
        slope = a.T @ (y - a @ x)
        if free.all() or slope[~free].max() <= 1e-9 * max(1.0, np.abs(y).max()):
            break
        free[np.flatnonzero(~free)[slope[~free].argmax()]] = True
        while True:
            new = np.zeros_like(x)
            new[free] = np.linalg.lstsq(a[:, free], y, rcond=None)[0]
            bad = free & (new <= 0)
            if not bad.any():
                x = new
                break
            step = min((x[i] / (x[i] - new[i]) for i in np.flatnonzero(bad)), default=0.0)
            x = x + step * (new - x)
            free &= x > 1e-12
            x[~free] = 0
    return x


#: Entries of the design matrix of estimate_bloom, which is on the driver.
DESIGN = 10_000_000


def estimate_bloom(reports: DataFrame, candidates: list[str], bits: int, hashes: int, epsilon: float, salt: str = "bloom") -> DataFrame:
    """(value, estimate, error): counts of the candidates from column `report`, by non-negative least squares on the bits.

    Bits are summed by Spark; what the driver solves is bits x candidates, DESIGN entries at most. `error` is the
    standard error that the flips alone cause, as if no estimate were cut at zero; null where other candidates set the same bits.
    """
    if bits * len(candidates) > DESIGN:
        raise ValueError(f"more than {DESIGN} bits x candidates")
    spark = reports.sparkSession
    found = sorted(debiased_bits(reports, bits, hashes, epsilon).collect())  # a row a bit
    y, n = np.array([r["estimate"] for r in found]), found[0]["n"]
    listed = spark.createDataFrame([(i, c) for i, c in enumerate(candidates)], "i int, value string")
    a = np.zeros((bits, len(candidates)))
    for r in listed.select("i", bloom_bits(F.col("value"), bits, hashes, salt).alias("b")).collect():
        a[r["b"], r["i"]] = 1
    x = least_squares(a, y)
    flip = flip_rate(hashes, epsilon)
    noise = n * flip * (1 - flip) / (1 - 2 * flip) ** 2  # of each bit's estimate
    unique = np.linalg.matrix_rank(a) == len(candidates)
    error = np.sqrt(np.diag(np.linalg.pinv(a.T @ a)) * noise)
    rows = [(c, float(v), float(e) if unique else None) for c, v, e in zip(candidates, x, error, strict=True)]
    return spark.createDataFrame(rows, "value string, estimate double, error double")


def local_hash_report(df: DataFrame, col: str, epsilon: float, key: str, salt: str = "olh", draw=draws.fresh, ledger: Ledger | None = None, name: str = "hash") -> DataFrame:
    """Optimized local hashing: the value hashed to g cells with the row's own seed, then randomized: columns `seed`, `cell`.

    The seed is public; the answer is drawn. A null value answers with any cell.
    """
    charge(ledger, name, epsilon)
    g = round(math.exp(epsilon)) + 1
    keep = math.exp(epsilon) / (math.exp(epsilon) + g - 1)
    u = F.col("__u")
    cell = F.floor(draws.uniform(salt + "h", key, col) * g).cast("int")
    moved = F.pmod(cell + (F.floor((u - keep) / (1 - keep) * (g - 1)) + 1).cast("int"), F.lit(g))
    said = F.when(F.col(col).isNull(), F.floor(u * g).cast("int")).when(u < keep, cell).otherwise(moved)
    return df.withColumn("__u", draw(salt, key)).withColumn("seed", F.col(key)).withColumn("cell", said).drop("__u")


def warner(flag: Column, p: float, u: Column, v: Column) -> Column:
    """Randomized response: the truth with probability p, else a fair coin."""
    return F.when(u < p, flag).otherwise(v < 0.5)


def randomized_response(df: DataFrame, flag: str, p: float, key: str, salt: str = "w", draw=draws.fresh, ledger: Ledger | None = None, name: str = "coin") -> DataFrame:
    """The column's truth with probability p, else a fair coin: epsilon is ln((1 + p) / (1 - p)). A null answers as a coin."""
    charge(ledger, name, math.log((1 + p) / (1 - p)) if p < 1 else math.inf)
    noisy = df.withColumns({"__u": draw(salt + "1", key), "__v": draw(salt + "2", key)})
    return noisy.withColumn(flag, F.coalesce(warner(F.col(flag), p, F.col("__u"), F.col("__v")), F.col("__v") < 0.5)).drop("__u", "__v")


def estimate_hashed(df: DataFrame, domain: list[str], epsilon: float, salt: str = "olh") -> DataFrame:
    """Unbiased counts of the domain's values from the reports (seed, cell) of local_hash_report()."""
    g = round(math.exp(epsilon)) + 1
    p = math.exp(epsilon) / (math.exp(epsilon) + g - 1)
    fits = [F.count_if(F.floor(draws.uniform(salt + "h", "seed", F.lit(v)) * g) == F.col("cell")).alias(f"c{i}") for i, v in enumerate(domain)]
    each = F.array(*[F.struct(F.lit(v).alias("value"), ((F.col(f"c{i}") - F.col("n") / g) / (p - 1 / g)).alias("estimate")) for i, v in enumerate(domain)])
    return df.agg(F.count("*").alias("n"), *fits).select(F.explode(each).alias("e")).select("e.*")
