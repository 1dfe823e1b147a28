r"""N-gram Jaccard join with Bayesian candidate pruning (operator 1).

Documents are sets of word shingles (`SHINGLE` lower-cased words; a shorter document is one shingle).
Documents with the same words are copies and form one class, named by its smallest id; the join runs
between classes, and copies are counted, not expanded into pairs.

MinHash values are laid out in bands; documents that agree on a band are candidates. A candidate pair
compares its MinHash values a few at a time: with m of n equal and a uniform prior, the similarity's
posterior is Beta(m+1, n-m+1), and the pair is dropped once the chance of reaching the threshold is
below `TOLERANCE`. What is left is verified exactly on the shingle sets of the whole texts.

A pair belongs to the first band on which its documents agree, so it is counted once. Buckets of up
to `SMALL` classes list their pairs; a larger bucket (thousands of near copies, or documents that
share a frequent passage) is cut into chunks, and every pair of chunks is compared, pruned and
verified inside one task, which returns each document's number of links and enough edges to connect
them, never the pairs. No bucket is capped and no link is lost between different texts beyond the
error of the bands (a pair at similarity 0.8 misses all bands with probability 3e-6) and TOLERANCE.

A large bucket of the same classes as one of an earlier band is skipped: its pairs agree on that band too.

Texts move only for documents of candidate pairs that pruning left, once to each of their small buckets, 24 at
most, and of large buckets (by rows or by characters): there once for every chunk that the bucket has, so a bucket of n documents moves n * n / `CHUNK` texts for n * n / 2 pairs.

Defined cases: documents without a word (null and empty texts too) have no shingles, no links and a
class of their own; rows that share an id are documents of their own, copies if their words are the same;
null ids come last, so only a class without any other id is named null; extra columns are dropped; empty
tables give empty results.
"""

from __future__ import annotations

import hashlib
import re
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, lists, pieces, stash

SHINGLE = 5
BANDS, ROWS = 24, 4
HASHES = BANDS * ROWS
STEP = 16
TOLERANCE = 1e-6
SMALL = 48
#: Rows of a chunk of a large bucket; its texts' total size also counts, by chunks of so many characters.
CHUNK, CHUNK_CHARS = 1024, 4_000_000
#: What is looked up is broadcast up to so many rows of some 50 bytes; beyond, it is joined.
BROADCAST_ROWS = 300_000
CACHE_ENTRIES = 400_000
WORD = re.compile(r"\w+")
_rng = np.random.default_rng(20)
_A = _rng.integers(1, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)


class Codes(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: str) -> int:
        if len(self) > CACHE_ENTRIES:
            self.clear()
        b = word.encode("utf-8", "replace")
        v = self[word] = int.from_bytes(hashlib.blake2b(b, digest_size=8).digest(), "little")
        return v


_codes = Codes()


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_codes(text: str | None) -> np.ndarray:
    words = WORD.findall(text.lower()) if text else []
    return np.fromiter(map(_codes.__getitem__, words), np.uint64, len(words))


def shingles(codes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of all runs of `size` words, repeats included."""
    if not len(codes):
        return codes
    m = min(size, len(codes))
    n = len(codes) - m + 1
    out = np.zeros(n, np.uint64)
    for i in range(m):
        out = mix(out + codes[i : i + n] + np.uint64(i + 1))
    return out


def signature(sh: np.ndarray) -> np.ndarray:
    x = (sh >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 4096):
        part = x[at : at + 4096]
        for i in range(0, HASHES, STEP):
            out[i : i + STEP] = np.minimum(out[i : i + STEP], (part[None, :] * _A[i : i + STEP, None] + _B[i : i + STEP, None]).min(1))
    return out


def least_matches(threshold: float, tolerance: float = TOLERANCE) -> list[int]:
    """By each number n of compared values: the fewest matches m for which P(similarity >= threshold) >= tolerance.

    P(Beta(m+1, n-m+1) >= t) = P(Binomial(n+1, t) <= m).
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        p, m = 0.0, 0
        while m <= n:
            p += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if p >= tolerance:
                break
            m += 1
        out.append(m)
    return out


def survivors(one: np.ndarray, others: np.ndarray, least: list[int], band: int) -> np.ndarray:
    """Rows of `others` that first agree with `one` on this band and are not pruned."""
    rows = np.flatnonzero((others[:, band * ROWS : band * ROWS + ROWS] == one[band * ROWS : band * ROWS + ROWS]).all(1))
    if band and len(rows):
        before = (others[rows, : band * ROWS] == one[: band * ROWS]).reshape(len(rows), band, ROWS).all(2).any(1)
        rows = rows[~before]
    same = np.zeros(len(rows), np.int64)
    for i, need in enumerate(least):
        if not len(rows):
            break
        same = same + (others[rows, i * STEP : i * STEP + STEP] == one[i * STEP : i * STEP + STEP]).sum(1)
        keep = same >= need
        rows, same = rows[keep], same[keep]
    return rows


def jaccard(a: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Exact similarity of a sorted set to others."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = np.concatenate(sets)
    at = np.minimum(np.searchsorted(a, flat), len(a) - 1)
    both = np.add.reduceat((a[at] == flat).astype(np.int64), np.cumsum(size) - size)
    return both / (len(a) + size - both)


def sign(docs: DataFrame) -> DataFrame:
    """(id, row, words: digest of the word sequence, chars, sig binary, keys array<long>) of documents with a word, (id, row) of the others."""

    def run(batches):
        for b in pieces(batches):
            digest, sigs, keys, chars = [], [], [], []
            for t in column(b, "text").to_pylist():
                codes = word_codes(t)
                if len(codes):
                    s = signature(shingles(codes))
                    digest.append(hashlib.blake2b(codes.tobytes(), digest_size=16).digest())
                    sigs.append(s.tobytes())
                    k = np.ascontiguousarray(s.reshape(BANDS, ROWS)).astype(np.uint64)
                    h = np.arange(1, BANDS + 1, dtype=np.uint64)
                    for j in range(ROWS):
                        h = mix(h + k[:, j])
                    keys.append(h.view(np.int64))
                else:
                    digest.append(None)
                    sigs.append(None)
                    keys.append(np.zeros(0, np.int64))
                chars.append(len(t or ""))
            yield pa.RecordBatch.from_arrays(
                [column(b, "id"), column(b, "row"), pa.array(digest, pa.binary()), pa.array(chars, pa.int64()), pa.array(sigs, pa.binary()), lists(np.concatenate(keys), [len(k) for k in keys], pa.int64())],
                names=["id", "row", "words", "chars", "sig", "keys"],
            )
        _codes.clear()  # a reused worker's next task may be another operator's

    return docs.mapInArrow(run, "id long, row long, words binary, chars long, sig binary, keys array<long>")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each connected component of edges(a, b).

    Every round links each node's larger neighbours, then its smaller ones, to its smallest
    neighbour; edges become stars in about log(diameter) rounds. Only counts reach the driver.
    """
    edges = stash(edges.where("a <> b").selectExpr("least(a, b) as a", "greatest(a, b) as b").distinct(), "edges")
    while True:
        # large star: nodes above v move to v's smallest neighbour (v itself counts)
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("low").alias("a"), "b").where("a <> b").distinct()
        # small star: v and its smaller neighbours move to the smallest of them
        low = large.groupBy("b").agg(F.min("a").alias("low"))
        small = large.join(low, "b").select(F.col("low").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a <> b").distinct()
        new = stash(small, "edges")
        changed = new.join(edges, ["a", "b"], "left_anti").limit(1).count() or edges.join(new, ["a", "b"], "left_anti").limit(1).count()
        edges = new
        if not changed:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))


def small(df: DataFrame) -> DataFrame:
    """For a join: broadcast if its rows are few."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """(id, class_id: smallest id of its group of linked documents, copy_id: of those with its words, n_links)."""
    return groups(df, id_col, text_col, threshold).select(F.col("id").alias(id_col), "class_id", "copy_id", "n_links")


def first_of_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """The rows of df without those that a row of their group precedes by id (nulls last), then by a hash of the text; of equal ids and texts one row stays."""
    all_ = stash(groups(df, id_col, text_col, threshold).where("group is not null").select("id", "row", "group"), "groups")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    heads = all_.groupBy("group").agg(F.min(place).alias("head"), F.count("*").alias("n")).where("n > 1")
    key = F.struct(F.coalesce("id", F.lit(0)).alias("id"), F.col("id").isNull().alias("none"), "row").alias("key")
    kin = stash(all_.join(small(stash(heads, "heads")), "group").groupBy(key).agg(F.max(F.struct("head.none", "head.id", "head.row") == place).alias("first"), F.count("*").alias("n")), "kin")
    docs = df.withColumn("__key", F.struct(F.coalesce(F.col(id_col), F.lit(0)).alias("id"), F.col(id_col).isNull().alias("none"), F.xxhash64(text_col).alias("row")))
    lost = kin.where("not first").select(F.col("key").alias("__key"))
    several = kin.where("first and n > 1").select(F.col("key").alias("__key"))
    docs = docs.join(small(lost), "__key", "left_anti")
    one, more = docs.join(small(several), "__key", "left_anti"), docs.join(small(several), "__key", "left_semi")
    rest = [c for c in df.columns]
    more = more.groupBy("__key").agg(F.min(F.struct(*rest)).alias("r")).select("r.*")
    return one.select(*rest).unionByName(more)


def groups(df: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """(id, row: hash of the text, group: a digest that names its linked documents, or null without words, class_id, copy_id, n_links)."""
    least = least_matches(threshold)
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("row", F.xxhash64("text"))
    docs = stash(sign(texts.select("id", "row", "text")), "signed")
    known = docs.where(F.col("words").isNotNull())
    copies = small(stash(known.groupBy("words").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1"), "copies"))
    # A class is known by its words' digest, of 128 bits, and numbered for the join. One signed row stands for it; of copies, any.
    several = known.join(copies, "words").dropDuplicates(["words"])
    reps = known.join(copies, "words", "left_anti").withColumns({"rep": F.col("id"), "n": F.lit(1).cast("long")}).unionByName(several)
    reps = stash(reps.select(F.monotonically_increasing_id().alias("c"), "words", "id", "row", "rep", "n", "chars", "sig", "keys"), "reps")

    buckets = reps.select("c", "chars", F.posexplode("keys").alias("band", "key")).select("c", "chars", F.col("band").cast("int").alias("band"), "key")
    sizes = buckets.groupBy("band", "key").agg(F.count("*").alias("many"), F.sum("chars").alias("chars"), *[F.bit_xor(F.xxhash64("c", F.lit(i))).alias(f"set{i}") for i in (0, 1)]).where("many > 1")
    sizes = stash(sizes, "sizes")
    # A large bucket with the same classes as one of an earlier band adds nothing: its pairs agree on that band.
    again = sizes.where(F.col("many") > SMALL).groupBy("many", "set0", "set1").agg(F.min("band").alias("first"), F.count("*").alias("times")).where("times > 1").drop("times")
    first = sizes.join(small(stash(again, "again")), ["many", "set0", "set1"], "left").where("first is null or first = band")
    sizes = first.select("band", "key", "many", "chars")
    placed = stash(buckets.drop("chars").join(sizes, ["band", "key"]), "buckets")

    # Small buckets: pairs, once each, with the first band on which a small bucket holds both.
    few = (F.col("many") <= SMALL) & (F.col("chars") <= CHUNK_CHARS)
    listed = placed.where(few).groupBy("band", "key").agg(F.array_sort(F.collect_list("c")).alias("cs"))
    both = listed.select("band", "key", F.posexplode("cs").alias("i", "a"), "cs").select("band", "key", "a", F.explode(F.slice("cs", F.col("i") + 2, F.size("cs"))).alias("b"))
    both = both.groupBy("a", "b").agg(F.min(F.struct("band", "key")).alias("at")).select("a", "b", "at.*")
    sig = reps.select("c", "sig")
    both = both.join(sig.withColumnsRenamed({"c": "a", "sig": "sa"}), "a").join(sig.withColumnsRenamed({"c": "b", "sig": "sb"}), "b")

    def prune(batches):
        for b in batches:
            if b.num_rows:
                one, two = (np.frombuffer(b"".join(column(b, k).to_pylist()), np.uint32).reshape(-1, HASHES) for k in ("sa", "sb"))
                same = one == two
                agree = same.reshape(len(same), BANDS, ROWS).all(2)
                keep = agree.argmax(1) == np.asarray(column(b, "band"))
                for i, need in enumerate(least):
                    keep &= same[:, : (i + 1) * STEP].sum(1) >= need
                yield pa.RecordBatch.from_arrays([column(b, k).filter(pa.array(keep)) for k in ("a", "b", "band", "key")], names=["a", "b", "band", "key"])

    likely = stash(both.mapInArrow(prune, "a long, b long, band int, key long"), "likely")
    wanted = likely.select(F.col("a").alias("c")).union(likely.select("b")).union(placed.where(~few).select("c")).distinct()
    at = (F.xxhash64("id", F.lit(1)).alias("rid"), "row")  # null-safe
    wanted = stash(reps.join(wanted, "c").select("c", "n", *at), "wanted")
    body = stash(texts.select(*at, "text").join(small(wanted), ["rid", "row"]).dropDuplicates(["c"]).select("c", "n", "text"), "bodies")
    # A text goes once to each small bucket where it has a pair left, whatever its pairs there, and meets them in one run of rows.
    sides = likely.select("band", "key", F.col("a").alias("c"), F.array("b").alias("with")).union(likely.select("band", "key", "b", F.array().cast("array<long>")))
    sides = sides.groupBy("band", "key", "c").agg(F.flatten(F.collect_list("with")).alias("with")).join(body, "c")
    sides = sides.select("band", "key", "c", "n", "with", "text").repartition("band", "key").sortWithinPartitions("band", "key")

    def verify(batches):
        place, held, asked = None, {}, {}

        def settle() -> pa.RecordBatch:
            rows = []
            for one, others in asked.items():
                (own, n), sets = held[one], [held[x][0] for x in others]
                rows += [(one, x, n, held[x][1]) for x, same in zip(others, jaccard(own, sets).tolist(), strict=True) if same >= threshold]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], names=["a", "b", "na", "nb"])

        for batch in batches:
            for b in pieces([batch]):
                for band, key, c, n, others, text in zip(*(column(b, k).to_pylist() for k in ("band", "key", "c", "n", "with", "text")), strict=True):
                    if (band, key) != place:
                        if asked:
                            yield settle()
                        place, held, asked = (band, key), {}, {}
                    held[c] = np.unique(shingles(word_codes(text))), n
                    if others:
                        asked[c] = others
        if asked:
            yield settle()
        _codes.clear()  # a reused worker's next task may be another operator's

    linked = stash(sides.mapInArrow(verify, "a long, b long, na long, nb long"), "linked")

    # Large buckets: all pairs of chunks, each inside a task.
    cuts = F.greatest(F.ceil(F.col("many") / CHUNK), F.ceil(F.col("chars") / CHUNK_CHARS)).cast("int")
    large = placed.where(~few).withColumn("k", F.least(cuts, F.col("many").cast("int"))).withColumn("at", F.pmod(F.xxhash64("c"), "k").cast("int"))
    large = large.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select("c", "band", "key", "at", F.least("at", "to").alias("x"), F.greatest("at", "to").alias("y"))
    large = large.join(sig, "c").join(body, "c")

    def block(table):
        band, x, y = (table[k][0].as_py() for k in ("band", "x", "y"))
        table = table.sort_by("c")
        at, ids, n = np.asarray(table["at"]), np.asarray(table["c"]), np.asarray(table["n"])
        sigs = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint32).reshape(-1, HASHES)
        words = table["text"]
        sets: dict[int, np.ndarray] = {}

        def of(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = np.unique(shingles(word_codes(words[i].as_py())))
            return sets[i]

        links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        left, right = np.flatnonzero(at == x), np.flatnonzero(at == y)
        for i in left.tolist():
            rest = left[left > i] if x == y else right
            rows = rest[survivors(sigs[i], sigs[rest], least, band)]
            if len(rows):
                rows = rows[jaccard(of(i), [of(j) for j in rows.tolist()]) >= threshold]
                links[i] += n[rows].sum()
                links[rows] += n[i]
                for j in rows.tolist():
                    root[find(j)] = find(i)
        _codes.clear()
        hit = np.flatnonzero(links)
        return pa.table({"a": ids[hit], "b": ids[np.array([find(i) for i in hit.tolist()], np.int64)], "links": links[hit]})

    within = stash(large.groupBy("band", "key", "x", "y").applyInArrow(block, "a long, b long, links long"), "within")

    links = linked.select(F.col("a").alias("c"), F.col("nb").alias("links")).union(linked.select("b", "na")).union(within.select("a", "links")).groupBy("c").agg(F.sum("links").alias("links"))
    roots = components(linked.select("a", "b").union(within.select("a", "b")))
    found = stash(links.join(roots, F.col("c") == F.col("node"), "left").select("c", "links", F.coalesce("root", "c").alias("root")).join(reps.select("c", "words", "rep"), "c"), "found")
    # A group is named by the words' digest of its root, which is one of its classes.
    heads = found.groupBy("root").agg(F.min("rep").alias("class_id"), F.max(F.when(F.col("c") == F.col("root"), F.col("words"))).alias("group"))
    found = found.join(heads, "root").select("words", "links", "group", "class_id")
    member = known.select("id", "row", "words").join(copies, "words", "left").join(small(stash(found, "linked-classes")), "words", "left")
    copy = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("rep"))
    member = member.select("id", "row", F.coalesce("group", "words").alias("group"), F.when(F.col("links").isNull(), copy).otherwise(F.col("class_id")).alias("class_id"), copy.alias("copy_id"), (F.coalesce("links", F.lit(0)) + F.coalesce("n", F.lit(1)) - 1).alias("n_links"))
    rest = docs.where(F.col("words").isNull()).select("id", "row", F.lit(None).cast("binary").alias("group"), F.col("id").alias("class_id"), F.col("id").alias("copy_id"), F.lit(0).cast("long").alias("n_links"))
    return member.unionByName(rest)
