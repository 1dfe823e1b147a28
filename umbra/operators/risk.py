"""Re-identification risk and privacy models."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import small, stash
from .groups import annotate, carried, running, same


def class_size(df: DataFrame, qi: list[str], name: str = "k") -> DataFrame:
    """df with the size of each row's class: counted, partly before the shuffle, and joined back."""
    return annotate(df, qi, F.count("*").alias(name))


def classes(df: DataFrame, qi: list[str]) -> DataFrame:
    return df.groupBy(*qi).agg(F.count("*").alias("k"))


def uniqueness(df: DataFrame, qi: list[str]) -> DataFrame:
    return classes(df, qi).agg(F.count_if(F.col("k") == 1).cast("bigint").alias("n_unique"), F.sum("k").cast("bigint").alias("n_rows"))


def k_map(df: DataFrame, population: DataFrame, qi: list[str]) -> DataFrame:
    """Classes of the sample with their size in the population (0 where it lacks them)."""
    c, p = classes(df, qi), classes(population, qi).select(*[F.col(x).alias(f"__b{i}") for i, x in enumerate(qi)], F.col("k").alias("k_population"))
    return c.join(p, same(c, p, qi), "left").select(*qi, "k", F.coalesce("k_population", F.lit(0)).alias("k_population"))


def delta_presence(df: DataFrame, public: DataFrame, qi: list[str]) -> DataFrame:
    return k_map(df, public, qi).withColumn("delta", F.col("k") / F.col("k_population"))


def reidentification_risk(df: DataFrame, qi: list[str]) -> DataFrame:
    c = classes(df, qi)
    return c.agg((1 / F.min("k")).alias("max_risk"), (F.count("*") / F.sum("k")).alias("avg_risk"))


def journalist_risk(df: DataFrame, population: DataFrame, qi: list[str]) -> DataFrame:
    """(max_risk, avg_risk, n_unique, n_population_unique, n_unknown): of a sample whose rows are known to be in a population.

    A row's risk is one over its class's size in the population; the mean is over the sample's rows. n_unique counts
    rows alone in the sample, n_population_unique those that are also alone in the population. Rows whose class the
    population lacks, or holds fewer rows of than the sample, count with the sample's size, and in n_unknown. Nulls are values.
    """
    c = k_map(df, population, qi).withColumn("__k", F.greatest("k", "k_population"))
    rows = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("k"))), F.lit(0)).cast("bigint")
    return c.agg(
        F.max(1 / F.col("__k")).alias("max_risk"),
        (F.sum(F.col("k") / F.col("__k")) / F.sum("k")).alias("avg_risk"),
        rows(F.col("k") == 1).alias("n_unique"),
        rows((F.col("k") == 1) & (F.col("k_population") == 1)).alias("n_population_unique"),
        rows(F.col("k_population") < F.col("k")).alias("n_unknown"),
    )


def is_k_anonymous(df: DataFrame, qi: list[str], k: int) -> bool:
    return classes(df, qi).where(F.col("k") < k).limit(1).count() == 0


def k_anonymize_by_suppression(df: DataFrame, qi: list[str], k: int) -> DataFrame:
    return class_size(df, qi, "__k").where(F.col("__k") >= k).drop("__k")


def k_anonymize_full_domain(df: DataFrame, levels: dict[str, list], k: int, max_suppressed: float = 0.05) -> tuple[DataFrame, dict[str, int]]:
    """Lowest generalization that needs to suppress at most a share of the rows; and its levels.

    levels: quasi-identifier -> column expressions from level 0 up. Rows are counted by all their levels first;
    all nodes of the lattice are then counted from these counts by grouping sets; the driver sees one row for each node.
    """
    names = list(levels)
    base = df.select(*[e.alias(f"{c}__{i}") for c in names for i, e in enumerate(levels[c])])
    base = stash(base.groupBy(*base.columns).agg(F.count("*").alias("n")), "lattice")
    nodes = list(product(*[range(len(levels[c])) for c in names]))
    sets = [[F.col(f"{c}__{i}") for c, i in zip(names, node, strict=True)] for node in nodes]
    every = [F.col(f"{c}__{i}") for c in names for i in range(len(levels[c]))]
    groups = base.groupingSets(sets, *every).agg(F.sum("n").alias("n"), F.grouping_id(*every).alias("g"))
    lost = {r["g"]: (r["lost"], r["total"]) for r in groups.groupBy("g").agg(F.sum(F.when(F.col("n") < k, F.col("n")).otherwise(0)).alias("lost"), F.sum("n").alias("total")).collect()}
    width = len(every)
    at = {f"{c}__{i}": p for p, (c, i) in enumerate((c, i) for c in names for i in range(len(levels[c])))}
    best = None
    for node in nodes:
        used = {at[f"{c}__{i}"] for c, i in zip(names, node, strict=True)}
        g = sum(1 << (width - 1 - p) for p in range(width) if p not in used)
        bad, total = lost.get(g, (0, 0))
        if bad <= max_suppressed * total and (best is None or (sum(node), bad) < best[0]):
            best = ((sum(node), bad), node)
    if best is None:
        raise ValueError("no node of the lattice is safe")
    chosen = dict(zip(names, best[1], strict=True))
    out = df.withColumns({c: levels[c][i] for c, i in chosen.items()})
    return k_anonymize_by_suppression(out, names, k), chosen


def mondrian(df: DataFrame, qi: list[str], k: int) -> DataFrame:
    """Multidimensional median splits, all open partitions of a level in one pass, until none can be split; adds column `part`.

    A part is split on its widest quasi-identifier (relative to the whole) that has a cut next to its
    median, above or else below it, with k rows on both sides; if these two cuts fail, so does any other
    of that quasi-identifier. A part is closed when all have failed. Nulls lie above all values. A level
    is aggregates by part; the driver sees only whether a part was split.
    """
    span = df.agg(*[(F.max(c) - F.min(c)).cast("double").alias(c) for c in qi]).first()
    x = [F.coalesce(F.col(c).cast("double"), F.lit(float("inf"))) for c in qi]
    out = df.withColumn("part", F.lit("0")).withColumn("__open", F.lit(True))
    accuracy = max(10_000, 10 * k)  # exact wherever a part is so small that k decides
    while True:
        parts = out.where("__open").groupBy("part")
        mids = [F.percentile_approx(v, 0.5, accuracy).alias(f"__m{i}") for i, v in enumerate(x)]
        widths = [((F.max(c) - F.min(c)).cast("double") / (span[c] or 1.0)).alias(f"__w{i}") for i, c in enumerate(qi)]
        stats = _cut(parts.agg(*mids, *widths))
        sides = [F.struct(F.count_if(v <= F.col(f"__m{i}")).alias("le"), F.count_if(v < F.col(f"__m{i}")).alias("lt")).alias(f"__s{i}") for i, v in enumerate(x)]
        counts = out.where("__open").join(stats, "part").groupBy("part").agg(F.count("*").alias("__n"), *sides)
        fits = lambda low: (low >= k) & (F.col("__n") - low >= k)
        cuts = F.array(*[F.when(fits(F.col(f"__s{i}.le")) | fits(F.col(f"__s{i}.lt")), F.struct(F.coalesce(f"__w{i}", F.lit(0.0)).alias("w"), F.lit(-i).alias("i"), F.col(f"__m{i}").alias("m"), fits(F.col(f"__s{i}.le")).alias("le"))) for i in range(len(qi))])
        best = _cut(counts.join(stats, "part").select("part", F.array_max(cuts).alias("__c")).where("__c is not null"))
        if not best.limit(1).count():
            return out.drop("__open")
        value = F.element_at(F.array(*x), 1 - F.col("__c.i"))
        low = F.when(F.col("__c.le"), value <= F.col("__c.m")).otherwise(value < F.col("__c.m"))
        split = F.col("__c").isNotNull()
        part = F.when(split, F.concat("part", F.when(low, "0").otherwise("1"))).otherwise(F.col("part"))
        out = _cut(out.join(best, "part", "left").select(*df.columns, part.alias("part"), split.alias("__open")))


def _cut(df: DataFrame) -> DataFrame:
    return stash(df, "mondrian")


def l_diversity(df: DataFrame, qi: list[str], sensitive: str, kind: str = "distinct", c: float = 2.0, l: int = 2) -> DataFrame:  # noqa: E741
    """By class: `l` (distinct), `entropy`, or `safe` (recursive (c, l))."""
    counts = df.groupBy(*qi, sensitive).agg(F.count("*").alias("n"))
    if kind == "distinct":
        return counts.groupBy(*qi).agg(F.count("*").alias("l"))
    total = F.sum("n").over(Window.partitionBy(*qi))
    if kind == "entropy":
        p = F.col("n") / F.col("t")
        return counts.withColumn("t", total).groupBy(*qi).agg((0 - F.sum(p * F.log(p))).alias("entropy"))
    rank = F.row_number().over(Window.partitionBy(*qi).orderBy(F.desc("n"), sensitive))
    ranked = counts.withColumn("r", rank).groupBy(*qi).agg(F.max(F.when(F.col("r") == 1, F.col("n"))).alias("r1"), F.coalesce(F.sum(F.when(F.col("r") >= l, F.col("n"))), F.lit(0)).alias("tail"))
    return ranked.withColumn("safe", F.col("r1") < c * F.col("tail")).drop("r1", "tail")


def t_closeness(df: DataFrame, qi: list[str], sensitive: str, ordered: bool = False) -> DataFrame:
    """By class: distance `t` of the sensitive value's distribution to the whole table's; a null value is a value, the least one.

    Categorical: half the sum of absolute differences; values that a class lacks add their whole share. Ordered: the
    sum of absolute cumulative differences over all m values, over m - 1. No class is joined with values that it lacks.

    Ordered: between two values that a class holds, its own cumulative share stays at some c while the whole's, Q, rises,
    so the sum of |c - Q| over that gap is a difference of prefix sums of Q on either side of where Q passes c. Values
    are ranked by ranges and those places found by a join on ranges, so there may be any number of values.
    """
    counts = df.groupBy(*qi, F.col(sensitive).alias("__s")).agg(F.count("*").alias("n"))
    whole = stash(df.groupBy(F.col(sensitive).alias("__v")).agg(F.count("*").alias("q")), "values")
    total = whole.agg(F.sum("q").alias("__t"), F.count("*").alias("__m"))
    if not ordered:
        whole = small(whole).join(F.broadcast(total)).select("__v", (F.col("q") / F.col("__t")).alias("q"))  # one row of `total`
        size = annotate(counts, qi, F.sum("n").alias("k"))
        each = size.join(whole, F.col("__s").eqNullSafe(F.col("__v")))
        return each.groupBy(*qi).agg(((F.sum(F.abs(F.col("n") / F.col("k") - F.col("q"))) + 1 - F.sum("q")) / 2).alias("t"))
    at = whole.withColumn("__null", F.col("__v").isNotNull())
    # place i from 1; upto: rows of the whole up to it; area: the sum of `upto` over all places up to it.
    ranked = running(running(at, [], ["__null", "__v"], "upto", F.col("q")), [], ["upto"], "i")
    ranked = stash(running(ranked, [], ["upto"], "area", F.col("upto").cast("decimal(38,0)")).select("__v", "i", "upto", "area"), "ranked")
    own = annotate(counts, qi, F.sum("n").alias("k")).join(small(ranked), F.col("__s").eqNullSafe(F.col("__v"))).drop("__v", "__s")
    stretch = running(own, qi, ["i"], "have", F.col("n"), after="end")
    # A stretch (class, have, from place i up to end - 1), and the one before the class's first value, of share 0.
    before = stretch.where("have = n and i > 1").withColumns({"have": F.lit(0).cast("long"), "end": F.col("i"), "i": F.lit(1).cast("long")})
    stretch = stretch.unionByName(before).join(F.broadcast(total)).withColumn("end", F.coalesce("end", F.col("__m") + 1))
    # The whole's share is at most have / k up to the last place with upto <= have * total / k.
    cut = F.call_function("div", F.col("have").cast("decimal(19,0)") * F.col("__t").cast("decimal(19,0)"), F.col("k").cast("decimal(19,0)"))
    stretch = stretch.withColumn("cut", cut.cast("long"))
    return _stretches(stretch, ranked, qi)


def _stretches(stretch: DataFrame, ranked: DataFrame, qi: list[str]) -> DataFrame:
    """The sum over all stretches of |have / k - upto / total| over their places, over m - 1, by class."""
    keys = [f"__g{i}" for i in range(len(qi))]
    names = dict(zip(keys, qi, strict=True))
    s = stretch.select(*[F.col(c).alias(g) for g, c in names.items()], "have", "k", "__t", "__m", "i", "end", "cut")
    # Areas at three places: before the stretch, at its end, and where the whole passes the class's share.
    by_place = small(ranked.select(F.col("i").alias("__i"), F.col("area").alias("__a")))
    start = s.join(by_place, F.col("i") - 1 == F.col("__i"), "left").withColumn("a0", F.coalesce("__a", F.lit(0))).drop("__i", "__a")
    both = start.join(by_place, F.col("end") - 1 == F.col("__i"), "left").withColumn("a2", F.coalesce("__a", F.lit(0))).drop("__i", "__a")
    marks = ranked.select(F.col("upto").alias("__at"), F.struct("i", "area").alias("__mark"), F.lit(0).alias("__side"), F.lit(0).cast("long").alias("__tie"))
    asked = both.select(F.col("cut").alias("__at"), F.struct(*both.columns).alias("__row"), F.lit(1).alias("__side"), F.xxhash64(*keys, "i").alias("__tie"))
    placed = carried(marks.unionByName(asked, allowMissingColumns=True), ["__at", "__side", "__tie"], "__mark", "__found").where("__side = 1")
    p = placed.select("__row.*", F.coalesce("__found.i", F.lit(0)).alias("ci"), F.coalesce("__found.area", F.lit(0)).alias("ca"))
    inside = F.col("ci").between(F.col("i"), F.col("end") - 1)
    ci = F.when(inside, F.col("ci")).when(F.col("ci") < F.col("i"), F.col("i") - 1).otherwise(F.col("end") - 1)
    ca = F.when(inside, F.col("ca")).when(F.col("ci") < F.col("i"), F.col("a0")).otherwise(F.col("a2"))
    c = F.col("have") / F.col("k")
    low = c * (ci - F.col("i") + 1) - (ca - F.col("a0")).cast("double") / F.col("__t")
    high = (F.col("a2") - ca).cast("double") / F.col("__t") - c * (F.col("end") - 1 - ci)
    out = p.withColumn("__d", low + high).groupBy(*keys).agg((F.sum("__d") / F.greatest(F.max("__m") - 1, F.lit(1))).alias("t"))
    return out.select(*[F.col(g).alias(c) for g, c in names.items()], "t")
