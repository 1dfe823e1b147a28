r"""Mixing sources to target weights (operator 4).

Sources overlap where they hold the same text. Documents are aggregated by membership pattern, the set of
sources that hold their text, and a min-cost flow routes each pattern's words to the quotas of its
sources. The r-th time that a pattern's texts are taken, by whichever of its sources, costs r-1: convex
costs, which spread repetition over all texts and let a source that shares a text leave it to another one.
No document is taken more than `max_repeats` times.

A pattern's documents in one source are a cell. Each cell takes whole rounds of all its documents, as many as
the flow's words allow; what a source then lacks is filled by a seeded selection among its documents that
may be taken once more: first those of cells that the flow took in part, then those taken least so far; in the
order of a hash of id and seed, each that still fits. So a source ends with fewer words missing than the
smallest of these documents left over has.

The flow sees one row per cell, never documents. It is solved by the primal-dual method: a shortest-path
search for each distinct cost of a path, and all paths of that cost at once. Cells are counted before they go to
the driver: more than `MAX_CELLS` raise an error, whose remedy is to mix coarser sources, since no part of them may be left out of the
flow. Patterns are numbered, so a text that very many sources hold makes no long keys.

The selection goes in rounds: of the documents no larger than what is missing, all before the first that goes
beyond it; then the same after that one, until none fits. A round's running sum is taken by hash buckets and
inside the one bucket where it ends, so a source with a third of all rows is spread over all tasks.

Defined cases: a null text has size 0 and is shared with none; documents of size 0 take 0 words; a null source
is a source of its own, last in order; ties in the seeded order go to the smaller id; rows that repeat an id or
are equal throughout are counted and taken one by one; extra columns are dropped, or kept under their names
where `keep` lists them; an empty table gives an empty mix.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

#: Cells that the driver may get: one for each source, and one more for each source of each pattern of several.
MAX_CELLS = 500_000
#: Texts that several sources hold are broadcast up to this many; beyond, they are joined.
BROADCAST_TEXTS = 200_000
BUCKETS = 4096
#: The fixed weights, dealt to the sources in order, again and again.
WEIGHTS = (5, 2, 1)


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def water_fill(sizes: dict, weights: dict, total: float, cap: int) -> dict:
    """Shares of `total` by weight; a share stops at cap times its size and the excess is reshared."""
    out, open_, left = {}, dict(weights), float(total)
    while open_:
        per = left / sum(open_.values())
        over = [s for s, w in open_.items() if per * w > cap * sizes[s]]
        if not over:
            out |= {s: per * w for s, w in open_.items()}
            break
        for s in over:
            out[s] = float(cap * sizes[s])
            left -= out[s]
            del open_[s]
    return out


def route(cells: dict, quota: dict, repeats: int) -> dict:
    """Min-cost flow: words taken from each cell.

    cells: (pattern, source) -> words of its documents; quota: source -> words wanted. Arcs: root -> pattern
    once for each repetition r (capacity: the pattern's words, which are those of its largest cell; cost r),
    pattern -> source (`repeats` times the cell's words, cost 0), source -> sink (its quota). Potentials keep
    reduced costs non-negative; along arcs of reduced cost 0 as much flows as can.
    """
    most: dict = {}
    total: dict = {}
    for (p, _), w in cells.items():
        most[p], total[p] = max(most.get(p, 0), w), total.get(p, 0) + repeats * w
    number = {("p", p): i + 1 for i, p in enumerate(most)}
    number |= {("s", s): len(number) + 1 + i for i, s in enumerate(quota)}
    sink = len(number) + 1
    arcs: list[list] = [[] for _ in range(sink + 1)]  # [to, capacity, cost, index of the reverse arc]

    def arc(a: int, b: int, capacity: int, cost: int) -> list:
        arcs[a].append([b, capacity, cost, len(arcs[b])])
        arcs[b].append([a, 0, -cost, len(arcs[a]) - 1])
        return arcs[b][-1]

    for p, w in most.items():
        for r in range(-(-total[p] // w) if w else 0):
            arc(0, number["p", p], w, r)
    taken = {(p, s): arc(number["p", p], number["s", s], repeats * w, 0) for (p, s), w in cells.items()}
    for s, w in quota.items():
        arc(number["s", s], sink, w, 0)
    price = [0] * (sink + 1)
    while True:
        dist, heap = {0: 0}, [(0, 0)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > dist[a]:
                continue
            for b, capacity, cost, _ in arcs[a]:
                if capacity > 0 and (e := d + cost + price[a] - price[b]) < dist.get(b, 1 << 60):
                    dist[b] = e
                    heapq.heappush(heap, (e, b))
        if sink not in dist:
            return {c: x[1] for c, x in taken.items()}  # what could flow back is what flows
        far = max(dist.values())
        price = [v + dist.get(i, far) for i, v in enumerate(price)]
        while blocking(arcs, price, sink):
            pass


def blocking(arcs: list[list], price: list[int], sink: int) -> bool:
    """Push flow along shortest paths (by arcs) of reduced cost 0 until none is left; whether any was."""
    level, todo = {0: 0}, [0]
    for a in todo:
        for b, capacity, cost, _ in arcs[a]:
            if capacity > 0 and b not in level and cost + price[a] == price[b]:
                level[b] = level[a] + 1
                todo.append(b)
    if sink not in level:
        return False
    at = [0] * len(arcs)
    path: list[list] = []
    nodes = [0]
    while nodes:
        a = nodes[-1]
        if a == sink:
            push = min(x[1] for x in path)
            for x in path:
                x[1] -= push
                arcs[x[0]][x[3]][1] += push
            cut = next(i for i, x in enumerate(path) if not x[1])
            del path[cut:], nodes[cut + 1 :]
            continue
        while at[a] < len(arcs[a]):
            x = arcs[a][at[a]]
            if x[1] > 0 and x[2] + price[a] == price[x[0]] and level.get(x[0]) == level[a] + 1:
                path.append(x)
                nodes.append(x[0])
                break
            at[a] += 1
        else:
            nodes.pop()
            if path:
                path.pop()
                at[nodes[-1]] += 1
    return True


def mix(df: DataFrame, source: Column, size: Column, same: Column | None = None, id_col: str = "doc_id", keep: tuple[str, ...] = (), weights: tuple = WEIGHTS, max_repeats: int = 3, seed: int = 7) -> DataFrame:
    """(id, kept columns, size, source_size, target, taken). `same`: equal for documents with one text (a digest), null for those that share it with none."""
    spark = df.sparkSession
    own = F.to_json(F.struct(source.alias("s")), {"ignoreNullFields": "false"})
    key = F.xxhash64(F.col(id_col), F.lit(seed))
    kept = [F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)]
    docs = df.select(F.col(id_col).alias("id"), size.alias("size"), source.alias("source"), own.alias("own"), (F.lit(None) if same is None else same).cast("string").alias("same"), key.alias("key"), F.monotonically_increasing_id().alias("row"), *kept)
    docs = stash(docs, "mix")  # `row` is written once
    shared = docs.where("same is not null and size > 0").groupBy("same").agg(F.collect_set("own").alias("in")).where(F.size("in") > 1)
    shared = stash(shared.select("same", F.md5(F.array_join(F.array_sort("in"), "|")).alias("digest")), "mix-shared")
    number = stash(shared.select("digest").distinct().select("digest", F.monotonically_increasing_id().cast("string").alias("pattern")), "mix-patterns")
    shared = stash(shared.join(number, "digest").select("same", "pattern"), "mix-shared")
    if shared.limit(BROADCAST_TEXTS + 1).count() <= BROADCAST_TEXTS:
        shared = F.broadcast(shared)
    docs = docs.join(shared, "same", "left").withColumn("pattern", F.coalesce("pattern", "own")).drop("same")
    light = stash(docs.select("own", "pattern", "source", "size", "id", "key", "row"), "mix-cells")

    rows = stash(light.groupBy("pattern", "own").agg(F.first("source").alias("source"), F.sum("size").alias("size")), "mix-rows")
    if rows.limit(MAX_CELLS + 1).count() > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} cells of pattern and source: mix coarser sources")
    rows = rows.collect()
    cells = {(r["pattern"], r["own"]): r["size"] for r in rows}
    name = {r["own"]: r["source"] for r in rows}
    sizes = dict.fromkeys(name, 0)
    for (_, s), w in cells.items():
        sizes[s] += w
    order = sorted(sizes, key=lambda s: (name[s] is None, name[s] or ""))
    target = water_fill(sizes, {s: weights[i % len(weights)] for i, s in enumerate(order)}, sum(sizes.values()), max_repeats)
    quota = {s: round(t) for s, t in target.items()}
    routed = route(cells, quota, max_repeats)
    plan, need = [], dict(quota)
    for c, w in cells.items():
        rounds, rest = divmod(routed[c], w) if w else (0, 0)
        need[c[1]] -= rounds * w
        plan.append((*c, sizes[c[1]], target[c[1]], rounds, (0 if rest else 1 + rounds) if rounds < max_repeats else None))
    plan = F.broadcast(spark.createDataFrame(plan, "pattern string, own string, source_size long, target double, rounds long, tier int"))  # as `rows`
    place = F.struct((F.col("tier") * BUCKETS + F.shiftrightunsigned("key", 52).cast("int")).alias("bucket"), "key", "id", "row").alias("at")
    light = light.join(plan.select("pattern", "own", "tier"), ["pattern", "own"]).where("tier is not null and size > 0").select("own", "size", place)
    cuts = select(light, {s: w for s, w in need.items() if w > 0})
    at = light.schema["at"].dataType.simpleString()
    ends = F.broadcast(spark.createDataFrame(list(cuts.items()), f"own string, cuts array<struct<need:long,stop:{at}>>"))  # a row for each source
    # What is missing only falls, so the first cut that ends after a document decides.
    extra = F.exists("cuts", lambda c: (F.col("size") <= c["need"]) & (c["stop"].isNull() | (F.col("at") < c["stop"])))
    extra = F.col("tier").isNotNull() & (F.col("size") > 0) & F.coalesce(extra, F.lit(False))
    out = docs.join(plan, ["pattern", "own"]).join(ends, "own", "left").withColumn("at", place)
    back = [F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)]
    return out.select(F.col("id").alias(id_col), *back, "size", "source_size", "target", (F.col("size") * (F.col("rounds") + extra.cast("long"))).alias("taken"))


def select(docs: DataFrame, rest: dict) -> dict:
    """Documents in the order of `at`, each that still fits in what its source lacks, as cuts: source -> [(need, stop)].

    A document is taken if it is no larger than the need of the first cut whose stop lies after it; a
    stop of None is the end. Every round takes one document of each source at least, or closes it.
    """
    spark, at = docs.sparkSession, docs.schema["at"].dataType.simpleString()
    cuts: dict = {s: [] for s in rest}
    open_ = {s: (w, (-1, 0, None, 0)) for s, w in rest.items()}
    while open_:
        need = F.broadcast(spark.createDataFrame([(s, *x) for s, x in open_.items()], f"own string, need long, after {at}"))  # a row for each source
        free = docs.join(need, "own").where((F.col("size") <= F.col("need")) & (F.col("at") > F.col("after"))).select("own", "size", "need", "at", F.col("at.bucket").alias("bucket"))
        sums = free.groupBy("own", "bucket").agg(F.sum("size").alias("words"), F.first("need").alias("need")).withColumn("upto", F.sum("words").over(_by("own", "bucket")))
        ends = sums.where(F.col("upto") > F.col("need")).groupBy("own").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("words")).alias("before"))).alias("end")).select("own", "end.*")
        inside = free.join(F.broadcast(ends), ["own", "bucket"]).withColumn("got", F.col("before") + F.sum("size").over(_by("own", "at")) - F.col("size"))  # a row of `ends` for each source at most
        found = {r["own"]: r["stop"] for r in inside.where(F.col("got") + F.col("size") > F.col("need")).groupBy("own").agg(F.min(F.struct("at", "got")).alias("stop")).collect()}
        left = {}
        for s, (w, _) in open_.items():
            stop = found.get(s)
            cuts[s].append((w, stop and stop["at"]))
            if stop and w > stop["got"]:
                left[s] = (w - stop["got"], stop["at"])
        open_ = left
    return cuts


def _by(key: str, order: str):
    return Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
