r"""Exact top-k by inner product with dual cover trees (operator 10).

All rows are dealt to cells around pivots of a sample of bounded size; cells are packed into chunks
of bounded size, for the queries as for the data. A pair of chunks is searched by walking two cover
trees together, best bound first: a pair of nodes is dropped when the largest inner product that
their centres and covering radii allow is below the worst k-th score of the query node's queries.

Two rounds: each query chunk first searches the data chunk around its own pivot; the k-th scores
found there then rule out whole cells by the same bound before the remaining pairs of chunks are
searched. Nothing is sampled or capped in the search itself, so the result is exact.

Pivots number one for `ROWS` rows, between 64 and 1024, from a sample of 16 a pivot, at least `sample`
rows and at most `SAMPLE_BYTES` (documented bounds): cells shrink as the table grows.

Defined cases: vectors that are null or hold null or non-finite components neither ask nor answer;
vectors of other lengths count as padded with zeros; a query never finds its own id; ties go to the
smaller id; an id on several rows is one item: it is found once, with the best score of its rows, and asks
with all of them; fewer candidates than k are all returned; extra columns are dropped; empty tables give
empty results. Scores beyond 64 bits raise an error.
"""

from __future__ import annotations

import heapq
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, stash
from .vectors import Best, chunks, matrix, merge, spread_pairs, whole

ROWS, QUERIES = 8192, 2048
PIVOTS, MOST_PIVOTS = 64, 1024
SAMPLE_BYTES = 64_000_000
LEAF, FAN = 96, 16


def spread(x: np.ndarray, most: int, within: float = 0.0, first: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Farthest-first centres until all points are within a radius: (centre rows, each point's centre, its distance)."""
    centre = [first]
    dist = np.sqrt(((x - x[first]) ** 2).sum(1))
    own = np.zeros(len(x), np.int64)
    while len(centre) < most and (far := int(dist.argmax())) >= 0 and dist[far] > within:
        d = np.sqrt(((x - x[far]) ** 2).sum(1))
        own[d < dist] = len(centre)
        dist = np.minimum(dist, d)
        centre.append(far)
    return np.array(centre), own, dist


class CoverTree:
    """Nodes own ranges of the reordered points; a child's radius is at most half its parent's, or it holds a share of a fan of FAN."""

    def __init__(self, x: np.ndarray):
        self.order = np.arange(len(x))
        self.centre, self.radius, self.range, self.kids = [], [], [], []
        open_ = [(0, len(x), 0, -1)]
        while open_:
            a, b, centre, parent = open_.pop()
            pts = x[self.order[a:b]]
            dist = np.sqrt(((pts - x[centre]) ** 2).sum(1))
            node = len(self.centre)
            self.centre.append(centre)
            self.radius.append(float(dist.max()))
            self.range.append((a, b))
            self.kids.append([])
            if parent >= 0:
                self.kids[parent].append(node)
            if b - a > LEAF and dist.max() > 0:
                at, own, _ = spread(pts, FAN, dist.max() / 2, int(dist.argmin()))
                rows = self.order[a:b]
                heads = rows[at]
                self.order[a:b] = rows[np.argsort(own, kind="stable")]
                ends = a + np.cumsum(np.bincount(own, minlength=len(at)))
                open_ += [(int(e - n), int(e), int(h), node) for e, n, h in zip(ends, np.bincount(own, minlength=len(at)), heads, strict=True) if n]
        self.at = x[self.centre]
        self.norm = np.sqrt((self.at**2).sum(1))
        self.radius = np.array(self.radius)


def dual(qid: np.ndarray, q: np.ndarray, floor: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of the k best for each query, among the points."""
    if not len(q) or not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    safe = float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1] < 2**53
    s, t = CoverTree(q), CoverTree(x)
    qs, xs = q[s.order], x[t.order]
    if not safe:
        qs, xs = (np.vectorize(int, otypes=[object])(m) for m in (qs, xs))
    qi, xi = qid[s.order], ids[t.order]
    best = Best(len(q), k, floor[s.order], hold=200_000, distinct=len(np.unique(ids)) == len(ids))

    def bound(a: int, b: int) -> float:
        u = float(s.at[a] @ t.at[b]) + s.radius[a] * t.norm[b] + t.radius[b] * s.norm[a] + s.radius[a] * t.radius[b]
        return u + 1e-9 * abs(u) + 1e-6

    tie = count()
    heap = [(-bound(0, 0), next(tie), 0, 0)]
    while heap:
        u, _, a, b = heapq.heappop(heap)
        lo, hi = s.range[a]
        if -u < best.worst[lo:hi].min():
            continue
        ka, kb = s.kids[a], t.kids[b]
        if ka or kb:
            if ka and (not kb or s.radius[a] >= t.radius[b]):
                pairs = [(c, b) for c in ka]
            else:
                pairs = [(a, c) for c in kb]
            for c, d in pairs:
                heapq.heappush(heap, (-bound(c, d), next(tie), c, d))
            continue
        c, d = t.range[b]
        score = qs[lo:hi] @ xs[c:d].T
        if not safe:
            if max(abs(int(v)) for v in (score.max(), score.min())) >= 2**63:
                raise OverflowError("an inner product does not fit 64 bits")
        i, j = np.nonzero((score >= best.worst[lo:hi][:, None]) & (qi[lo:hi][:, None] != xi[c:d][None, :]))
        if len(i):
            best.add(i + lo, xi[c:d][j], score[i, j].astype(np.int64))
            best.settle()
    i, j, v = best.settle()
    return s.order[i], j, v


def search(df: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, scale: int = 256, sample: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of floor(scale * x) of every row for which `is_query` holds."""
    spark = df.sparkSession
    raw = F.col(vec_col).cast("array<double>")
    rows = df.select(F.col(id_col).alias("id"), raw.alias("v"), is_query.alias("ask")).where(whole(F.col("v")))
    rows = rows.withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("double")))
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    n, dim = size["n"], max(size["dim"] or 1, 1)
    draw = F.pmod(F.xxhash64("id", F.lit("topk")), F.lit(1_000_003)) / 1_000_003.0
    many = min(max(PIVOTS, n // ROWS), MOST_PIVOTS)
    wanted = min(max(sample, 16 * many), max(1, SAMPLE_BYTES // (8 * dim)))
    got = rows.where(draw < min(1.0, wanted / max(n, 1))).select("id", "v").toArrow().sort_by("id")
    x = matrix(got["v"], dim) if got.num_rows else np.zeros((1, dim))
    pivots = x[spread(x, many)[0]]
    shared = spark.sparkContext.broadcast(pivots)

    def place(batches):
        p = shared.value
        for b in batches:
            v = matrix(column(b, "v"), dim)
            cell = ((p * p).sum(1) / 2 - v @ p.T).argmin(1) if len(v) else np.zeros(0, int)
            far = np.sqrt(((v - p[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(far, pa.float64())], names=[*b.schema.names, "cell", "far"])

    placed = stash(rows.mapInArrow(place, "id long, v array<double>, ask boolean, cell int, far double"), "topk")
    cells = placed.groupBy("cell").agg(F.count("*").alias("n"), F.count_if("ask").alias("nq"), F.max("far").alias("r"), F.max(F.when(F.col("ask"), F.col("far"))).alias("rq")).collect()  # MOST_PIVOTS rows at most
    data_at = chunks({c["cell"]: c["n"] for c in cells}, ROWS)
    ask_at = chunks({c["cell"]: c["nq"] for c in cells if c["nq"]}, QUERIES)

    def dealt(df: DataFrame, at: dict, name: str) -> DataFrame:
        look = F.broadcast(spark.createDataFrame([(c, *p) for c, p in at.items()], "cell int, first int, parts int"))
        return df.join(look, "cell").withColumn(name, (F.col("first") + F.pmod(F.xxhash64("id"), "parts")).cast("int")).select("id", "v", "cell", name)

    data, asked = dealt(placed, data_at, "d"), dealt(placed.where("ask"), ask_at, "q")

    most = 4 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(asked: DataFrame, pairs: DataFrame) -> DataFrame:
        def block(left, right):
            i, j, s = dual(np.asarray(left["id"]), matrix(left["v"], dim), np.asarray(left["floor"]), np.asarray(right["xid"]), matrix(right["x"], dim), k)
            return pa.table({"query_id": np.asarray(left["id"])[i], "cell": np.asarray(left["cell"])[i], "vec_id": j, "score": s.astype(np.int64)})

        left = asked.join(pairs, "q").select(*[F.col(c).alias(c) for c in ("q", "d", "id", "v", "cell", "floor")])
        right = data.join(pairs, "d").select(F.col("q").alias("xq"), F.col("d").alias("xd"), F.col("id").alias("xid"), F.col("v").alias("x"))
        tasks = min(max(pairs.count(), 1), most)
        left, right = spread_pairs(left, tasks, "q", "d"), spread_pairs(right, tasks, "xq", "xd")
        return left.groupBy("q", "d").cogroup(right.groupBy("xq", "xd")).applyInArrow(block, "query_id long, cell int, vec_id long, score long")

    near: dict[int, int] = {}
    for c in sorted(ask_at, reverse=True):
        for q in range(ask_at[c][0], ask_at[c][0] + ask_at[c][1]):
            near[q] = data_at[c][0]
    home = spark.createDataFrame(list(near.items()), "q int, d int")
    nothing = F.lit(float("-inf"))
    one = stash(run(asked.withColumn("floor", nothing), home), "topk-home")
    kth = merge(one, k).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k).select(F.col("query_id").alias("id"), F.col("floor").cast("double").alias("floor"))
    asked = stash(asked.join(kth, "id", "left").withColumn("floor", F.coalesce("floor", nothing)), "topk-asked")
    worst = {r["cell"]: r["w"] for r in asked.groupBy("cell").agg(F.min("floor").alias("w")).collect()}  # MOST_PIVOTS rows at most
    norm = np.sqrt((pivots**2).sum(1))
    left = []
    for a in cells:
        for b in cells if a["nq"] else []:
            i, j = a["cell"], b["cell"]
            u = float(pivots[i] @ pivots[j]) + a["rq"] * norm[j] + b["r"] * norm[i] + a["rq"] * b["r"]
            if u + 1e-9 * abs(u) + 1e-6 >= worst[i]:
                left.append((*ask_at[i], *data_at[j]))
    spans = spark.createDataFrame(left, "qf int, qn int, df int, dn int")
    upto = lambda a, b: F.explode(F.sequence(F.col(a), F.col(a) + F.col(b) - 1))
    pairs = spans.withColumn("q", upto("qf", "qn")).withColumn("d", upto("df", "dn")).select("q", "d").distinct().join(home, ["q", "d"], "left_anti")
    two = run(asked, stash(pairs, "topk-pairs"))
    return merge(one.unionByName(two), k)


def oracle_sql(table: str = "embeddings", k: int = 5) -> str:
    """The same search for DuckDB, by comparing all pairs."""
    return f"""
    WITH v AS (SELECT vec_id, [floor(256 * x::double)::bigint FOR x IN embedding] AS x FROM {table} WHERE embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, max(coalesce(list_sum([coalesce(z[1] * z[2], 0) FOR z IN list_zip(q.x, c.x)]), 0))::bigint AS score
          FROM v AS q JOIN v AS c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id GROUP BY 1, 2)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::integer AS rank, vec_id, score FROM s
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= {k}"""
