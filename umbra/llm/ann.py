r"""Approximate nearest neighbours by inner product (operator 3).

A hierarchical k-means tree is fitted on a sample of bounded size (`sample` rows, at most `SAMPLE_BYTES`;
documented bounds); every row is indexed in it. A query descends best bin first: a priority queue holds the
tree's open nodes by the inner product that the query can expect of their best rows (that of the centroid,
plus an allowance for the node's spread), and the best leaves are visited. How many is calibrated: the
fewest leaves with which sampled queries find at least `recall` of their true neighbours in the sample. A
query whose leaves hold fewer than k candidates visits more, and all of them before it returns fewer than k.

Leaves are packed into chunks of at most `ROWS` rows; a leaf with more (copies of one vector, say)
is split over several. The visits of a chunk are split likewise, so no task holds more than
`ROWS` rows and `QUERIES` queries whatever the data's skew, and no pair is formed outside a block.

Scores are inner products of the original vectors in double precision, added in component order, so
equal vectors score alike and ties go to the smaller id.

Defined cases: vectors that are null, all zero, or hold null or non-finite components neither ask nor
answer; vectors of other lengths count as padded with zeros; a query never finds its own id; an id on
several rows is one item: it is found once, with the best score of its rows, and asks with all of them;
extra columns are dropped; with fewer candidates than k all are returned; empty tables give empty results.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, lists, stash
from .vectors import Best, chunks, matrix, merge, spread_pairs, whole

ROWS, QUERIES, BLOCK = 8192, 4096, 256
BRANCH = 8
LEAF = 32
SAMPLE_BYTES = 64_000_000
#: Allowance for a node's spread (root mean square of a coordinate), for inner nodes and leaves.
WIDE = (2.0, 1.0)


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    centre = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = ((centre * centre).sum(1) / 2 - x @ centre.T).argmin(1)
        centre = np.stack([x[own == i].mean(0) if (own == i).any() else centre[i] for i in range(k)])
    return centre


class Tree:
    """Inner nodes hold their children's centroids; a child number below zero is leaf -1-number."""

    def __init__(self, x: np.ndarray, leaf: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.centres: list[np.ndarray] = []
        self.allow: list[np.ndarray] = []
        self.children: list[np.ndarray] = []
        self.leaves = 0

        def grow(rows: np.ndarray) -> int:
            part = x[rows]
            if len(rows) > max(leaf, BRANCH) and (part != part[0]).any():
                centre = kmeans(part, BRANCH, rng)
                own = ((centre * centre).sum(1) / 2 - part @ centre.T).argmin(1)
                used = np.unique(own)
                if len(used) > 1:
                    at = len(self.centres)
                    self.centres.append(centre[used])
                    self.allow.append(np.zeros(len(used)))
                    self.children.append(np.zeros(len(used), np.int64))
                    for i, u in enumerate(used):
                        child = self.children[at][i] = grow(rows[own == u])
                        self.allow[at][i] = WIDE[int(child < 0)] * np.sqrt(((part[own == u] - centre[u]) ** 2).mean())
                    return at
            self.leaves += 1
            return -self.leaves

        self.root = grow(np.arange(len(x)))

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Each row's leaf: the nearest centroid on every level."""
        out = np.zeros(len(x), np.int64)
        open_ = [(self.root, np.arange(len(x)))]
        while open_:
            node, rows = open_.pop()
            if node < 0:
                out[rows] = -1 - node
                continue
            c = self.centres[node]
            own = ((c * c).sum(1) / 2 - x[rows] @ c.T).argmin(1)
            open_ += [(int(child), r) for i, child in enumerate(self.children[node]) if len(r := rows[own == i])]
        return out

    def visit(self, q: np.ndarray, most: int, rows: dict[int, int] | None = None, need: int = 0) -> list[int]:
        """Best-bin-first: the first `most` leaves, and more until they hold `need` rows by the counts in `rows`."""
        out: list[int] = []
        heap = [(0.0, self.root)]
        norm, reached = float(np.sqrt(q @ q)), 0
        while heap and (len(out) < most or reached < need):
            _, node = heapq.heappop(heap)
            if node < 0:
                out.append(-1 - node)
                reached += rows.get(-1 - node, 0) if rows else 0
            else:
                for p, child in zip((-(self.centres[node] @ q) - norm * self.allow[node]).tolist(), self.children[node].tolist(), strict=True):
                    heapq.heappush(heap, (p, child))
        return out


def calibrate(tree: Tree, x: np.ndarray, k: int, recall: float, queries: int = 256) -> int:
    """The fewest leaves with which sampled queries reach the recall against brute force over the sample."""
    own = tree.assign(x)
    ask = np.unique(np.linspace(0, len(x) - 1, min(queries, len(x))).astype(int))
    at = []
    for i in ask:
        s = x @ x[i]
        s[i] = -np.inf
        best = np.argpartition(-s, min(k, len(x) - 1) - 1)[: min(k, len(x) - 1)] if len(x) > 1 else []
        rank = {leaf: r + 1 for r, leaf in enumerate(tree.visit(x[i], tree.leaves))}
        at += [rank[own[j]] for j in best]
    return int(np.quantile(at, recall, method="higher")) if at else 1


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row-wise inner products, added in component order."""
    acc = np.zeros(len(q))
    for j in range(q.shape[1]):
        acc += q[:, j] * x[:, j]
    return acc


def search(df: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, recall: float = 0.93, sample: int = 65_536) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row for which `is_query` holds."""
    spark = df.sparkSession
    v = F.col(vec_col).cast("array<double>")
    rows = df.select(F.col(id_col).alias("id"), v.alias("v"), is_query.alias("ask")).where(whole(F.col("v"))).where(F.exists("v", lambda x: x != 0))
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    n, dim = size["n"], size["dim"] or 1
    draw = F.pmod(F.xxhash64("id", F.lit("ann")), F.lit(1_000_003)) / 1_000_003.0
    wanted = min(sample, max(1, SAMPLE_BYTES // (8 * dim)))
    got = rows.where(draw < min(1.0, wanted / max(n, 1))).select("id", "v").toArrow().sort_by("id")
    x = matrix(got["v"], dim)
    tree = Tree(x, max(8, int(LEAF * min(1.0, len(x) / max(n, 1)))))
    most = calibrate(tree, x, k, recall) if len(x) else 1
    shared = spark.sparkContext.broadcast((tree, most))  # the tree has fewer nodes than the sample has rows

    def place(batches):
        for b in batches:
            leaf = shared.value[0].assign(matrix(column(b, "v"), dim))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf, pa.int32())], names=[*b.schema.names, "leaf"])

    placed = stash(rows.mapInArrow(place, "id long, v array<double>, ask boolean, leaf int"), "ann")
    counts = {r["leaf"]: r["n"] for r in placed.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # a row for each leaf of the tree
    plan = chunks(counts, ROWS)
    where = spark.sparkContext.broadcast((plan, counts))
    look = F.broadcast(spark.createDataFrame([(c, *p) for c, p in plan.items()], "leaf int, first int, parts int"))
    data = placed.join(look, "leaf").select("id", "v", "leaf", (F.col("first") + F.pmod(F.xxhash64("id"), "parts")).cast("int").alias("chunk"))

    data = data.select(F.col("chunk").alias("xchunk"), F.col("id").alias("xid"), F.col("v").alias("x"), "leaf")
    most_tasks = 4 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def answer(queries: DataFrame, most: int) -> DataFrame:
        """What these queries (id, v) find in so many leaves, or as many as hold k candidates."""

        def visits(batches):
            tree, (plan, rows) = shared.value[0], where.value
            for b in batches:
                to, chunk, leaves = [], [], []
                for i, q in enumerate(matrix(column(b, "v"), dim)):
                    own: dict[int, list[int]] = {}
                    for leaf in tree.visit(q, most, rows, k + 1):
                        if leaf in plan:
                            first, parts = plan[leaf]
                            for c in range(first, first + parts):
                                own.setdefault(c, []).append(leaf)
                    to += [i] * len(own)
                    chunk += own
                    leaves += own.values()
                flat = np.fromiter((x for o in leaves for x in o), np.int32)
                to = pa.array(to, pa.int64())
                yield pa.RecordBatch.from_arrays([column(b, "id").take(to), column(b, "v").take(to), pa.array(chunk, pa.int32()), lists(flat, [len(o) for o in leaves], pa.int32())], names=["id", "v", "chunk", "leaves"])

        asked = stash(queries.mapInArrow(visits, "id long, v array<double>, chunk int, leaves array<int>"), "ann-visits")
        parts = stash(asked.groupBy("chunk").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts")), "ann-parts")
        tasks = min(parts.agg(F.sum("parts")).first()[0] or 1, most_tasks)
        left = asked.join(parts, "chunk").withColumn("part", F.pmod(F.xxhash64("id", "v"), "parts").cast("int")).select(*[F.col(c).alias(c) for c in ("chunk", "part", "id", "v", "leaves")])
        right = data.join(parts.withColumnRenamed("chunk", "xchunk"), "xchunk").withColumn("xpart", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        left, right = spread_pairs(left, tasks, "chunk", "part"), spread_pairs(right.select("xchunk", "xpart", "xid", "x", "leaf"), tasks, "xchunk", "xpart")
        return left.groupBy("chunk", "part").cogroup(right.groupBy("xchunk", "xpart")).applyInArrow(block, "query_id long, vec_id long, score double")

    def block(left, right):
        qid, q = np.asarray(left["id"]), matrix(left["v"], dim)
        order = np.argsort(np.asarray(right["leaf"]), kind="stable")
        ids, x, leaf = np.asarray(right["xid"])[order], matrix(right["x"], dim)[order], np.asarray(right["leaf"])[order]
        cut = np.flatnonzero(np.diff(leaf)) + 1
        spans = [(int(leaf[a]), int(a), int(b)) for a, b in zip(np.append(0, cut), np.append(cut, len(leaf)), strict=True)] if len(leaf) else []
        once = len(np.unique(ids)) == len(ids)
        best = Best(len(qid), k, distinct=once)
        seen = left["leaves"].combine_chunks()
        offsets = np.asarray(seen.offsets)
        who = np.repeat(np.arange(len(qid)), np.diff(offsets))
        visited = np.asarray(seen.values)[offsets[0] : offsets[-1]]
        for a in range(0, len(qid), BLOCK):
            qs = np.arange(a, min(a + BLOCK, len(qid)))
            mine = (who >= a) & (who < a + BLOCK)
            to, at = who[mine] - a, visited[mine]
            by = np.argsort(at, kind="stable")
            to, at = to[by], at[by]
            s = np.full((len(qs), len(ids)), -np.inf)  # scores of visited leaves only
            for one, lo, hi in spans:
                ask = to[np.searchsorted(at, one) : np.searchsorted(at, one, "right")]
                s[ask, lo:hi] = q[qs[ask]] @ x[lo:hi].T
            s[qid[qs][:, None] == ids[None, :]] = -np.inf
            floor = np.partition(s, len(ids) - k, axis=1)[:, len(ids) - k] if once and len(ids) > k else np.full(len(qs), -np.inf)
            floor = np.where(np.isfinite(floor), floor - 1e-9 * (1 + np.abs(floor)), -np.finfo(float).max)
            i, j = np.nonzero(s >= floor[:, None])
            for c in range(0, len(i), 100_000):
                ii, jj = qs[i[c : c + 100_000]], j[c : c + 100_000]
                best.add(ii, ids[jj], exact(q[ii], x[jj]))
        i, j, s = best.settle()
        return pa.table({"query_id": qid[i], "vec_id": j, "score": s})

    queries = placed.where("ask").select("id", "v")
    found = stash(merge(answer(queries, most), k), "ann-found")
    if most >= tree.leaves:
        return found
    short = queries.select("id").distinct().join(found.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("n")), "id", "left").where(F.coalesce("n", F.lit(0)) < k).select("id")
    short = stash(short, "ann-short")
    if not short.limit(1).count():
        return found
    rest = merge(answer(queries.join(short, "id"), tree.leaves), k)
    return found.join(short, F.col("query_id") == F.col("id"), "left_anti").unionByName(rest)
