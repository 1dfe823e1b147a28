"""Linkage on encodings, and the utility of a release."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keyed
from ..sources.io import small, spread, stash
from .groups import annotate

#: Bits that two filters may differ in where they are compared; for more, the bits are dealt to parts.
NEAR = 3


def hashed_intersection(left: DataFrame, right: DataFrame, col: str, key: bytes) -> DataFrame:
    """Keyed hashes that both sides hold (not a cryptographic protocol)."""
    h = lambda d: d.select(keyed.hmac(col, key).alias("h")).distinct()
    return h(left).join(h(right), "h", "left_semi")


def qgrams(col: str | Column, q: int) -> Column:
    c = F.lower(F.col(col) if isinstance(col, str) else col)
    return F.when(F.length(c) >= q, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - q + 1), lambda i: F.substring(c, i, q)))).otherwise(F.array(c))


def bloom_encode(df: DataFrame, col: str, q: int, bits: int, hashes: int, key: bytes) -> DataFrame:
    """Column `bloom`: the sorted set bits of the value's q-grams, by keyed hashes."""
    bit = lambda g, i: F.pmod(F.conv(F.substring(keyed.hmac(F.concat(F.lit(f"{i}|"), g), key), 1, 7), 16, 10).cast("bigint"), F.lit(bits)).cast("int")
    return df.withColumn("bloom", F.array_sort(F.array_distinct(F.flatten(F.transform(qgrams(col, q), lambda g: F.array(*[bit(g, i) for i in range(hashes)]))))))


def dice(a: Column, b: Column) -> Column:
    return 2 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))


def block(df: DataFrame, col: str, q: int, bands: int, salt: str = "block") -> DataFrame:
    """(columns, band, key): the least q-gram by each of several hashes; equal keys are linkage candidates."""
    least = [F.array_min(F.transform(qgrams(col, q), _hashed(f"{salt}{i}"))) for i in range(bands)]
    return df.select("*", F.posexplode(F.array(*least)).alias("band", "key"))


def link(df: DataFrame, id_col: str, col: str, q: int, bands: int, bits: int, hashes: int, key: bytes) -> DataFrame:
    """(a, b, dice): Dice similarity of the encodings of each pair of rows that share a block; a < b. For few rows: see lsh_link."""
    own = bloom_encode(df.select(F.col(id_col).alias("id"), F.col(col).alias("__x")), "__x", q, bits, hashes, key)
    blocks = block(own.select("id", "__x"), "__x", q, bands).select("id", "band", "key")
    left, right = blocks.withColumnRenamed("id", "a"), blocks.withColumnRenamed("id", "b")
    pairs = left.join(right, ["band", "key"]).where("a < b").select("a", "b").distinct()
    x, y = own.select(F.col("id").alias("a"), F.col("bloom").alias("x")), own.select(F.col("id").alias("b"), F.col("bloom").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", dice(F.col("x"), F.col("y")).alias("dice"))


def lsh_blocks(encoded: DataFrame, bits: int, tables: int, sample: int, most: int, key: bytes, step: int = 2) -> DataFrame:
    """(id, table, key) of (id, bloom): Hamming blocks of at most `most` rows, whose filters agree on some sampled bits.

    Each table samples bits in a keyed order of its own, those first that at least one row in a hundred differs in from
    the others. Blocks are counted, and those with more than `most` rows are divided by `step` further bits, again
    and again: different filters part in the end. The driver sees a count for each bit. Similar filters may share no block, and
    rounds are many where filters differ in few bits; lsh_link misses no pair.
    """
    n = encoded.count()
    shares = {r["b"]: r["n"] / n for r in encoded.select(F.explode("bloom").alias("b")).groupBy("b").agg(F.count("*").alias("n")).collect()}
    parts = lambda b: min(shares.get(b, 0.0), 1 - shares.get(b, 0.0)) >= 0.01
    order = [sorted(range(bits), key=lambda b: (not parts(b), hashlib.sha256(key + f"{t}|{b}".encode()).digest())) for t in range(tables)]
    has = lambda b: F.when(F.array_contains("bloom", b), "1").otherwise("0")
    text = lambda lo, hi: F.element_at(F.array(*[F.concat(*[has(b) for b in o[lo:hi]]) for o in order]), F.col("table") + 1)
    all_ = encoded.withColumn("table", F.explode(F.array(*map(F.lit, range(tables)))))
    open_, done, at = all_.withColumn("key", text(0, sample)), [], sample
    while True:
        open_ = stash(annotate(open_, ["table", "key"], F.count("*").alias("__n")), "blocks")
        done.append(open_.where((F.col("__n") <= most) & (F.col("__n") > 1)).select("id", "table", "key"))
        open_ = open_.where(F.col("__n") > most)
        if at >= bits or not open_.limit(1).count():
            return reduce(DataFrame.unionByName, done)
        open_ = open_.drop("__n").withColumn("key", F.concat("key", text(at, at + step)))
        at += step


def covering_tables(bits: int, radius: int, key: bytes) -> list[list[int]]:
    """Sets of bits, of which any two filters that differ in at most `radius` bits agree in one: LSH without false negatives (Pagh).

    The bits are dealt to parts, in one of which the filters differ in at most NEAR bits, say r. Inside a part each bit draws a
    vector of r + 1 binary digits. Some vector that is not zero is orthogonal to those of the r bits or fewer that differ,
    so the filters agree in all bits whose vectors are not orthogonal to it: a table for each vector, 2^(r+1) - 1.
    """
    parts = radius // (NEAR + 1) + 1
    r = radius // parts
    drawn = [int.from_bytes(hashlib.sha256(key + f"cover{radius}|{b}".encode()).digest()[:8]) for b in range(bits)]
    part, vector = [d % parts for d in drawn], [d >> 32 & (1 << r + 1) - 1 for d in drawn]
    return [[b for b in range(bits) if part[b] == p and (vector[b] & v).bit_count() % 2] for p in range(parts) for v in range(1, 1 << r + 1)]


def _levels(bits: int, least: float) -> list[tuple[int, int]]:
    """Ranges of sizes; sets of Dice similarity `least` have their sizes in one or in neighbouring ranges."""
    out, low = [], 1
    while low <= bits:
        out.append((low, min(bits, int(low * (2 - least) / least + 1e-9))))
        low = out[-1][1] + 1
    return out


def lsh_link(df: DataFrame, id_col: str, col: str, q: int, bits: int, hashes: int, key: bytes, least: float, most: int = 4096) -> tuple[DataFrame, DataFrame]:
    """All pairs (a, b, dice) of classes with Dice similarity of at least `least` (above 0), and the members (id, class) of each class.

    A class is all rows with one encoding, named by its least id; nulls are in no class. Similar filters have similar
    sizes and so a bound on the bits they differ in; they share a block of covering_tables, one for each range of
    sizes. No pair is missed. A block of more than `most` classes is compared in parts, as tasks of their own.
    """
    own = bloom_encode(spread(df.select(F.col(id_col).alias("id"), F.col(col).alias("__x")).where("__x is not null")), "__x", q, bits, hashes, key)
    own = stash(own.select("id", "bloom"), "encoded")
    word = lambda k: F.aggregate("bloom", F.lit(0).cast("long"), lambda a, b: F.when(F.floor(b / 64) == k, a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b - 64 * k))).otherwise(a))
    words = [f"w{k}" for k in range(-(-bits // 64))]
    classes = own.groupBy("bloom").agg(F.min("id").alias("id")).select("id", "bloom", F.size("bloom").alias("n"), *[word(k).alias(w) for k, w in enumerate(words)])
    classes = stash(classes, "classes")
    members = own.join(classes.select("bloom", F.col("id").alias("class")), "bloom").select("id", "class")
    blocks = _blocks(classes.drop("bloom"), words, bits, least, key)
    big = blocks.groupBy("level", "table", "key").agg(F.count("*").alias("rows")).where(F.col("rows") > most)
    big = small(stash(big.select("level", "table", "key", F.ceil(F.col("rows") / most).cast("int").alias("cells")), "large-blocks"))
    blocks = blocks.join(big, ["level", "table", "key"], "left").withColumn("cells", F.coalesce("cells", F.lit(1)))
    left = blocks.where("own").withColumn("cell", F.pmod(F.xxhash64("id"), "cells").cast("int")).drop("own", "cells")
    right = blocks.withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1))).drop("cells")
    right = right.withColumnsRenamed({c: f"{c}_" for c in ["id", "n", *words]})
    apart = reduce(lambda x, y: x + y, [F.bit_count(F.col(w).bitwiseXOR(F.col(f"{w}_"))) for w in words])
    both = F.col("n") + F.col("n_")
    dice = (both - apart) / both
    found = left.join(right, ["level", "table", "key", "cell"]).where((~F.col("own") | (F.col("id") < F.col("id_"))) & (dice >= least))
    return found.select(F.least("id", "id_").alias("a"), F.greatest("id", "id_").alias("b"), dice.alias("dice")).distinct(), members


def _blocks(classes: DataFrame, words: list[str], bits: int, least: float, key: bytes) -> DataFrame:
    """(id, n, words, level, own, table, key): a class in the tables of its own level, and in those of the next for larger partners."""
    levels, spark = _levels(bits, least), classes.sparkSession
    of = {n: i for i, (low, high) in enumerate(levels) for n in range(low, high + 1)}
    sizes = {r["n"] for r in classes.select("n").distinct().collect()}  # `bits` at most
    top = {i: max(n for n in sizes if of[n] == i) for i in {of[n] for n in sizes}}
    places = [(n, i, i == of[n]) for n in sorted(sizes) for i in (of[n], of[n] + 1) if i in top]
    masks = []
    for i, n in top.items():
        radius = min(bits, int((1 - least) * 2 * n + 1e-9))
        for t, chosen in enumerate(covering_tables(bits, radius, key) if radius else []):  # 0: only equal filters, a class
            values = [sum(1 << b - 64 * k for b in chosen if b // 64 == k) for k in range(len(words))]
            masks.append((i, t, *[v - (1 << 64) if v >> 63 else v for v in values]))
    kinds = ", ".join(f"m{k} long" for k in range(len(words)))
    placed = spark.createDataFrame(places, "n int, level int, own boolean")
    masks = spark.createDataFrame(masks, f"level int, table int, {kinds}")
    out = classes.join(F.broadcast(placed), "n").join(F.broadcast(masks), "level")
    return out.withColumn("key", F.xxhash64(*[F.col(w).bitwiseAND(F.col(f"m{k}")) for k, w in enumerate(words)])).drop(*[f"m{k}" for k in range(len(words))])


def _hashed(salt: str):
    return lambda g: F.substring(F.md5(F.concat(F.lit(salt), g)), 1, 12)


def utility_report(original: DataFrame, released: DataFrame, qi: list[str]) -> DataFrame:
    """Discernibility, average class size, suppression rate."""
    k = released.groupBy(*qi).agg(F.count("*").alias("k"))
    n = original.agg(F.count("*").alias("n"))
    return k.agg(F.sum(F.col("k") * F.col("k")).alias("discernibility"), (F.sum("k") / F.count("*")).alias("average_class"), F.sum("k").alias("kept")).join(F.broadcast(n)).select("discernibility", "average_class", (1 - F.col("kept") / F.col("n")).alias("suppression_rate"))


def certainty_penalty(df: DataFrame, col: str, qi: list[str]) -> DataFrame:
    """Mean share of the column's range that a row's class spans."""
    whole = df.agg((F.max(col) - F.min(col)).alias("w"))
    return df.groupBy(*qi).agg((F.max(col) - F.min(col)).alias("s"), F.count("*").alias("k")).join(F.broadcast(whole)).agg((F.sum(F.col("s") / F.col("w") * F.col("k")) / F.sum("k")).alias("ncp"))


def distance(original: DataFrame, released: DataFrame, col: str) -> DataFrame:
    """Total variation and Kullback-Leibler divergence of a column's distributions (values the release lacks count as e-9)."""
    share = lambda d, n: d.groupBy(col).agg(F.count("*").alias("c")).join(F.broadcast(d.agg(F.count("*").alias("t")))).select(col, (F.col("c") / F.col("t")).alias(n))
    p, q = F.coalesce("p", F.lit(0.0)), F.coalesce("q", F.lit(0.0))
    both = share(original, "p").join(share(released, "q"), col, "full")
    return both.agg((F.sum(F.abs(p - q)) / 2).alias("tv"), F.sum(F.when(p > 0, p * F.log(p / F.greatest(q, F.lit(1e-9)))).otherwise(0.0)).alias("kl"))


