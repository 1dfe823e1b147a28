"""Best-fit packing by a grouping genetic algorithm on islands (operator 13).

Documents are tokenized and cut into pieces of at most `capacity` tokens; a full piece is a sequence of its own.
The others are dealt out to blocks of about BLOCK pieces by hash. A block that best fit, largest first, packs into as few
sequences as its tokens allow is done. For each other block, ISLANDS islands, a row each, evolve
populations of packings of their own: crossover injects whole well-filled bins of one parent into the other, takes
out the bins that hold one of their pieces a second time, and puts the pieces that lost their bin back by best fit,
largest first. Then each island's elite migrates to the next island of its block, which evolves it along with its
own; there are EPOCHS of this. The best island's packing counts. A block leaves a sequence or so badly filled: the
pieces of those go to new blocks, with those of other blocks, until a round saves no sequence.

A packing is better with fewer bins, then with the larger sum of squared fills. An island stops early where no
packing can have fewer bins. Islands draw from seeds made of round, block and island.

Defined cases: a null text is the empty one, which is its end token alone; a long text is cut into full pieces and a
last one that may be shorter; rows that share an id or a text are documents of their own; an empty table gives an
empty result; other columns are not looked at. Strings of special tokens in a text are what `tokenizers` makes of
them by default.
"""

from __future__ import annotations

import hashlib
import json
import os
import random
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import Chunks, Ragged, byte_letters, expand, sums
from .common import column, lists, stash
from .common import pieces as cut

#: Distinct words, and parts of words, that a worker keeps; beyond, the rarer half of the words goes, and all parts.
CACHE_WORDS = 400_000
#: Characters of a block of texts: their ids are in a worker's memory at once.
BLOCK_CHARS = 4_000_000
#: Pieces that are packed together, islands that do so, and what each does between migrations.
BLOCK, ISLANDS, EPOCHS, POPULATION, GENERATIONS, CHILDREN = 2048, 3, 2, 6, 4, 3
#: A sequence filled below this share is taken apart once more, along with others.
FILLED = 0.99
#: Rounds over such sequences: each has to save one, so few are run.
ROUNDS = 6
#: Blocks or islands that a task takes: starting a task costs as much as some of them.
TASK_ROWS = 16


#: Words of these letters need no look at Unicode's tables, of which libraries have different editions.
PLAIN = re.compile("[!-~\xa1-\u024f]*").fullmatch
#: What the tokenizer's file splits words by.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall


class Parts(dict):
    """Ids by part, in lower case."""

    def __init__(self, model):
        self.model, self.letters = model, {b: c for c, b in byte_letters().items()}

    def __missing__(self, part: str) -> list[int]:
        found = self.model.tokenize(part if part.isascii() else "".join([self.letters[i] for i in part.encode()]))
        self[part] = ids = [t.id for t in found]
        return ids


class Words:
    """Encodes texts by a tokenizer that drops white space, so that what stands between blanks is independent.

    Words of plain letters are split here and handed to the tokenizer's model part by part, each distinct part once;
    all others go through the whole tokenizer.
    """

    def __init__(self, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(model)
        spec = json.loads(model)
        self.plain = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] == SPLIT.__self__.pattern if spec["pre_tokenizer"]["type"] == "Sequence" else False
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or "(?!)").search
        self.parts, self.chunks, self.ids = Parts(self.tokenizer.model), Chunks(CACHE_WORDS), Ragged()

    def _whole(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _ids(self, words: list[str]) -> list[list[int]]:
        """The ids of each word."""
        if not self.plain:
            return self._whole(words)
        if len(self.parts) > CACHE_WORDS:
            self.parts.clear()
        other = [w for w in words if not PLAIN(w) or self.special(w)]
        whole, parts = dict(zip(other, self._whole(other), strict=True)), self.parts
        out = []
        for w in words:
            if w in whole:
                out.append(whole[w])
                continue
            low = w.lower()
            out.append(parts[low] if low.isalpha() else [i for x in SPLIT(low) for i in parts[x]])
        return out

    def encode(self, texts: list[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after the other, and the number of ids of each text."""
        kept = self.chunks.shrink()
        if kept is not None:
            values, size = self.ids.take(kept)
            self.ids.clear()
            self.ids.add(values, size)
        split = pc.split_pattern(pc.replace_substring((texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).fill_null(""), "\n", " "), " ")
        at, size, new = self.chunks.number_column(split)
        if new:
            own = self._ids(new)
            n = np.fromiter(map(len, own), np.int64, len(own))
            self.ids.add(np.fromiter(chain.from_iterable(own), np.int32, int(n.sum())), n)
        ids, each = self.ids.take(at)
        return ids, sums(each, size)


_words: dict[bytes, Words] = {}


def words(model: bytes) -> Words:
    """One encoder a worker process."""
    key = hashlib.sha256(model).digest()
    if key not in _words:
        _words[key] = Words(model)
    return _words[key]


def pieces(df: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """(id, piece, start, length, ids array<int>) of every document; without `ids`, ids_crc32 in their place, of little-endian 32-bit ids."""
    with open(tokenizer_path, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary: fixed size, some 2 MB
    base = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        encoder = words(shared.value)
        for b in cut(batches, chars=BLOCK_CHARS):
            found, size = encoder.encode(column(b, "text"))
            size = size + 1
            ends = np.cumsum(size)
            flat = np.full(int(ends[-1]), end_id, "<i4")
            flat[np.delete(np.arange(len(flat)), ends - 1)] = found
            n = -(-size // capacity)
            row = np.repeat(np.arange(len(size)), n)
            piece = expand(np.zeros(len(n), np.int64), n)
            start = piece * capacity
            length = np.minimum(size[row] - start, capacity)
            if ids:
                last = lists(flat, length, pa.int32())
            else:
                first = (ends - size)[row] + start
                last = pa.array([zlib.crc32(flat[a : a + m]) for a, m in zip(first.tolist(), length.tolist(), strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([column(b, "id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), last], names=["id", "piece", "start", "length", "last"])

    last = "ids array<int>" if ids else "ids_crc32 long"
    out = base.mapInArrow(run, f"id {base.dtypes[0][1]}, piece int, start long, length long, last {last.split()[1]}")
    return out.withColumnsRenamed({"id": id_col, "last": last.split()[0]})


# A packing is a list of bins, a bin a list of the pieces' numbers, and a list of the bins' fills.
Packing = tuple[list[list[int]], list[int]]


def best_fit(order: Iterable[int], sizes: list[int], capacity: int, packing: Packing = ((), ())) -> Packing:
    """The pieces, in this order, each into the fullest bin that still takes it, else into a new one."""
    bins, fills = [list(b) for b in packing[0]], list(packing[1])
    room = sorted((capacity - f, i) for i, f in enumerate(fills) if f < capacity)
    for x in order:
        size = sizes[x]
        at = bisect_left(room, (size,))
        if at < len(room):
            free, i = room.pop(at)
            bins[i].append(x)
            fills[i] += size
        else:
            free, i = capacity, len(bins)
            bins.append([x])
            fills.append(size)
        if free > size:
            insort(room, (free - size, i))
    return bins, fills


def fitness(packing: Packing) -> tuple[int, int]:
    """Fewer bins, then more in the fuller ones: the larger the better."""
    return -len(packing[1]), sum([f * f for f in packing[1]])


def cross(a: Packing, b: Packing, sizes: list[int], capacity: int, draw: random.Random) -> Packing:
    """Well-filled bins of b, then a's bins without a piece of those, then the pieces left over by best fit."""
    filled = sorted(range(len(b[1])), key=b[1].__getitem__, reverse=True)[: max(1, len(b[1]) * 3 // 4)]
    given = [i for i in filled if draw.random() < 0.5] or filled[:1]
    taken = set(chain.from_iterable(b[0][i] for i in given))
    kept = [i for i, x in enumerate(a[0]) if taken.isdisjoint(x)]
    kept_set = set(kept)
    loose = [x for i, own in enumerate(a[0]) if i not in kept_set for x in own if x not in taken]
    loose.sort(key=lambda x: (-sizes[x], x))
    return best_fit(loose, sizes, capacity, ([b[0][i] for i in given] + [a[0][i] for i in kept], [b[1][i] for i in given] + [a[1][i] for i in kept]))


def shaken(packing: Packing, sizes: list[int], capacity: int, draw: random.Random) -> Packing:
    """Mutation: the emptiest bins, and some others, are taken apart, and their pieces put back in a shuffled order."""
    bins, fills = packing
    order = sorted(range(len(bins)), key=fills.__getitem__)
    gone = set(order[: 1 + len(bins) // 50]) | {i for i in order if draw.random() < 0.03}
    loose = [x for i in sorted(gone) for x in bins[i]]
    loose.sort(key=lambda x: -sizes[x] * draw.uniform(0.8, 1.0))
    kept = [i for i in range(len(bins)) if i not in gone]
    return best_fit(loose, sizes, capacity, ([bins[i] for i in kept], [fills[i] for i in kept]))


def evolve(sizes: list[int], capacity: int, seed: str, start: list[list[list[int]]]) -> Packing:
    """The best packing of an island after GENERATIONS, from those that `start` brings along, as bins, and new ones."""
    draw, n, total = random.Random(seed), len(sizes), sum(sizes)
    brought = [(p, [sum(map(sizes.__getitem__, b)) for b in p]) for p in start]
    people = [(fitness(p), p) for p in brought]
    top = (-(-(-total // capacity)),)  # no packing has fewer bins
    spread = 0.3 if start else 0.0
    while len(people) < POPULATION and (not people or people[-1][0] < top):
        order = sorted(range(n), key=lambda x: (-sizes[x] * draw.uniform(1 - spread, 1.0), x))
        p = best_fit(order, sizes, capacity)
        people.append((fitness(p), p))
        spread += 0.1
    for _ in range(GENERATIONS):
        people.sort(key=lambda x: x[0], reverse=True)
        del people[POPULATION:]
        if people[0][0] >= top or n < 2:
            break
        for _ in range(CHILDREN):
            a, b = (min(draw.randrange(len(people)), draw.randrange(len(people))) for _ in range(2))
            child = cross(people[a][1], people[b][1], sizes, capacity, draw) if a != b else people[a][1]
            if a == b or draw.random() < 0.5:
                child = shaken(child, sizes, capacity, draw)
            people.append((fitness(child), child))
    return max(people, key=lambda x: x[0])[1]


def _numbers(bins: list[list[int]], n: int) -> list[int]:
    out = [0] * n
    for i, b in enumerate(bins):
        for x in b:
            out[x] = i
    return out


def _bins(numbers: list[int]) -> list[list[int]]:
    out = [[] for _ in range(max(numbers) + 1)]
    for x, i in enumerate(numbers):
        out[i].append(x)
    return out


ISLAND = "block long, island int, items array<long>, sizes array<int>, bins array<int>, n_bins int, least int, fit double"


def _epoch(df: DataFrame, rows: int, capacity: int, salt: str | None = None) -> DataFrame:
    """Rows (block, island, items, sizes, guests: packings to begin with), evolved: an island a row. Without `salt`, best fit alone.

    `least` is what no packing falls short of.
    """
    tasks = min(rows, max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)))

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                sizes = r["sizes"]
                if salt is None:
                    found = best_fit(range(len(sizes)), sizes, capacity)  # largest first as they stand
                else:
                    found = evolve(sizes, capacity, f"{salt}/{r['block']}/{r['island']}", [_bins(g) for g in r["guests"] or [] if g])
                own = {"bins": _numbers(found[0], len(sizes)), "n_bins": len(found[0]), "least": -(-sum(sizes) // capacity), "fit": float(fitness(found)[1])}
                row = {k: [v] for k, v in ({k: r[k] for k in ("block", "island", "items", "sizes")} | own).items()}
                yield pa.RecordBatch.from_pydict(row, schema)

    kinds = {"block": pa.int64(), "island": pa.int32(), "items": pa.list_(pa.int64()), "sizes": pa.list_(pa.int32()), "bins": pa.list_(pa.int32()), "n_bins": pa.int32(), "least": pa.int32(), "fit": pa.float64()}
    schema = pa.schema(list(kinds.items()))
    return stash(df.repartition(tasks, "block", "island").mapInArrow(run, ISLAND), "islands")


def _round(items: DataFrame, count: int, capacity: int, salt: str) -> DataFrame:
    """(block, items, sizes, bins) of the best packing of each block of (item, length)."""
    blocks = max(1, -(-count // BLOCK))
    dealt = items.select("item", F.col("length").cast("int").alias("length"), F.pmod(F.xxhash64(F.lit(salt), "item"), F.lit(blocks)).alias("block"))
    own = dealt.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("length", "item")), False).alias("x"))  # about BLOCK items a row
    own = own.select("block", F.lit(0).alias("island"), F.col("x.item").alias("items"), F.col("x.length").alias("sizes"))
    plain = _epoch(own, blocks, capacity)
    done = plain.where("n_bins <= least").select("block", "items", "sizes", "bins")
    open_ = plain.where("n_bins > least").select("block", "items", "sizes")
    rows = open_.count() * ISLANDS
    if not rows:
        return done
    own = open_.select("block", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), "items", "sizes")
    found = _epoch(own.withColumn("guests", F.array().cast("array<array<int>>")), rows, capacity, f"{salt}/0")
    for e in range(1, EPOCHS):
        elite = found.select(F.col("block").alias("__b"), F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("__i"), F.col("bins").alias("guest"))
        mixed = found.join(elite, (F.col("block") == F.col("__b")) & (F.col("island") == F.col("__i")))
        found = _epoch(mixed.select("block", "island", "items", "sizes", F.array("bins", "guest").alias("guests")), rows, capacity, f"{salt}/{e}")
    best = F.min_by(F.struct("items", "sizes", "bins"), F.struct("n_bins", -F.col("fit"), "island"))
    return done.unionByName(found.groupBy("block").agg(best.alias("b")).select("block", "b.*"))


def _packed(rest: DataFrame, count: int, capacity: int, salt: str, r: int) -> DataFrame:
    """(item, length, sequence_id, fill): the pieces in new blocks, packed."""
    found = _round(rest, count, capacity, f"{salt}{r}").select("block", F.explode(F.arrays_zip("items", "sizes", "bins")).alias("x"))
    sequence = F.lit(r << 58) + F.col("block") * F.lit(1 << 24) + F.col("x.bins")
    out = found.select(F.col("x.items").alias("item"), F.col("x.sizes").cast("long").alias("length"), sequence.alias("sequence_id"))
    return stash(out.withColumn("fill", F.sum("length").over(Window.partitionBy("sequence_id"))), "packed")


def place(items: DataFrame, capacity: int, salt: str = "pack") -> DataFrame:
    """(item, sequence_id, offset) of (item long and unique, length long); sequences of one full item have ids below 0."""
    full = items.where(F.col("length") >= capacity).select("item", (-1 - F.col("item")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest, done = items.where(F.col("length") < capacity).select("item", "length"), [full]
    count = rest.count()
    now = _packed(rest, count, capacity, salt, 0)
    for r in range(1, ROUNDS):
        poor = now.where(F.col("fill") < int(FILLED * capacity))
        alone = count <= BLOCK  # one block has tried them all together
        count, total, bins = poor.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0)), F.countDistinct("sequence_id")).first()
        if alone or -(-total // capacity) >= bins:
            break
        again = _packed(poor, count, capacity, salt, r)
        if again.agg(F.countDistinct("sequence_id")).first()[0] >= bins:
            break
        done.append(_offsets(now.where(F.col("fill") >= int(FILLED * capacity))))
        now = again
    return reduce(DataFrame.unionByName, [*done, _offsets(now)])


def _offsets(packed: DataFrame) -> DataFrame:
    """Places inside each sequence, gapless, the largest piece first."""
    w = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "item").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return packed.select("item", "sequence_id", (F.sum("length").over(w) - F.col("length")).cast("long").alias("offset"))


def pack(df: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """pieces() with sequence_id and offset: as few sequences of at most `capacity` tokens as found, without gaps."""
    own = stash(pieces(df, tokenizer_path, capacity, end_id, id_col, text_col, ids).withColumn("__item", F.monotonically_increasing_id()), "pieces")
    where = place(own.select(F.col("__item").alias("item"), "length"), capacity)
    return own.join(where, F.col("__item") == F.col("item")).drop("__item", "item")
