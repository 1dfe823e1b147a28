import random
import struct
import zlib

import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from umbra.llm import packing

PATH = P.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)
ODD = ["", None, "Hello, World's", " a  b\n\nc ", "été É ΑΣ ΑΣ.", "漢字 かな 😀", "x\x1cy\x85z w　v", "12 345", "don't I'LL", "\t\r\n", "İstanbul ẞ", "a" * 300, "<|endoftext|> <|startoftext|>x"]


def pieces_of(text, capacity):
    ids = [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 1]
    return [(k // capacity, k, ids[k : k + capacity]) for k in range(0, len(ids), capacity)]


def check(rows, docs, capacity):
    """Pieces are those of whole texts, sequences are gapless from 0 and hold no more than they may; gives their number."""
    want = sorted((i, *p) for i, t in docs for p in pieces_of(t, capacity))
    assert sorted((r["doc_id"], r["piece"], r["start"], list(r["ids"])) for r in rows) == want
    at = {}
    for r in rows:
        assert r["length"] == len(r["ids"])
        at.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in at.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(at)


def test_query_form(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = [(r["doc_id"], r["text"]) for r in df.collect()]
    rows = packing.pack(df, PATH).collect()
    total = sum(r["length"] for r in rows)
    assert check(rows, docs, 4096) <= -(-total // 4096) + 1  # none is possible below that
    crc = packing.pieces(df, PATH, ids=False).collect()
    got = {(r["doc_id"], r["piece"]): r["ids_crc32"] for r in crc}
    assert got == {(r["doc_id"], r["piece"]): zlib.crc32(struct.pack(f"<{len(r['ids'])}I", *r["ids"])) for r in rows}


def test_cases(spark):
    docs = [(i, t) for i, t in enumerate(ODD)] + [(2, "again " * 50), (3, " a  b\n\nc "), (None, "no id"), (90, "word " * 1000)]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, piece string, length int")
    rows = packing.pack(df, PATH, capacity=64).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["piece"], list(r["ids"]))
    assert sorted(map(key, rows)) == sorted((i is None, i or 0, p, x) for i, t in docs for p, _, x in pieces_of(t, 64))
    check([r for r in rows if r["doc_id"] == 90], [(90, docs[-1][1])], 64)
    assert packing.pack(df.limit(0), PATH).collect() == []
    assert "sequence_id" in packing.pack(df.limit(0), PATH).columns
    assert len(packing.pack(df.limit(1), PATH).collect()) == 1


def test_rounds_over_blocks(spark, monkeypatch):
    """Many small blocks: what each leaves badly filled is packed across blocks."""
    for name, value in (("BLOCK", 20), ("GENERATIONS", 2)):
        monkeypatch.setattr(packing, name, value)
    draw = random.Random(5)
    sizes = [draw.randint(1, 60) for _ in range(600)] + [100] * 5
    items = spark.createDataFrame(list(enumerate(sizes)), "item long, length long")
    rows = packing.place(items, 100).collect()
    assert sorted(r["item"] for r in rows) == list(range(605))
    at = {}
    for r in rows:
        at.setdefault(r["sequence_id"], []).append((r["offset"], sizes[r["item"]]))
    for places in at.values():
        ends = [sum(n for _, n in sorted(places)[:k]) for k in range(len(places))]
        assert [o for o, _ in sorted(places)] == ends and sum(n for _, n in places) <= 100
    alone = -(-sum(sizes) // 100)
    assert len(at) <= alone + 4  # 31 blocks alone would leave up to one each
    again = packing.place(items, 100).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


@pytest.mark.parametrize("seed", range(6))
def test_islands_reach_the_optimum(seed):
    """Sequences cut at random into pieces: the least number of bins is known."""
    draw, sizes = random.Random(seed), []
    for _ in range(40):
        cuts = sorted(draw.sample(range(1, 1000), draw.randint(1, 5)))
        sizes += [b - a for a, b in zip([0, *cuts], [*cuts, 1000], strict=True)]
    sizes.sort(reverse=True)
    first = packing.best_fit(list(range(len(sizes))), sizes, 1000)
    found = packing.evolve(sizes, 1000, str(seed), [])
    assert packing.fitness(found) >= packing.fitness(first)
    assert len(found[0]) <= 41


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=40), st.integers(0, 99))
def test_crossover_keeps_every_piece_once(sizes, seed):
    draw = random.Random(seed)
    a, b = (packing.best_fit(draw.sample(range(len(sizes)), len(sizes)), sizes, 50) for _ in range(2))
    for bins, fills in (packing.cross(a, b, sizes, 50, draw), packing.shaken(a, sizes, 50, draw), packing.evolve(sizes, 50, "s", [a[0], b[0]])):
        assert sorted(x for p in bins for x in p) == list(range(len(sizes)))
        assert fills == [sum(sizes[x] for x in p) for p in bins] and all(0 < f <= 50 for f in fills)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \n\r\t \x1c'sSßİΣ́a1!"), st.characters(codec="utf-8")), max_size=30), max_size=4))
def test_words_are_independent(texts):
    ids, size = packing.words(open(PATH, "rb").read()).encode(texts)
    ends = size.cumsum().tolist()
    assert [ids[e - n : e].tolist() for e, n in zip(ends, size.tolist(), strict=True)] == [TOKENIZER.encode(t, add_special_tokens=False).ids for t in texts]


def test_forgotten_words(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 3)
    words = packing.Words(open(PATH, "rb").read())
    for t in [*ODD, *ODD, "Les x<|endoftext|>y ÀÉß ½² I'm İstanbul Ǆ ŉ"]:
        assert words.encode([t])[0].tolist() == TOKENIZER.encode(t or "", add_special_tokens=False).ids


def test_plain_letters_are_split_as_the_tokenizer_does():
    words = packing.Words(open(PATH, "rb").read())
    assert words.plain
    letters = [chr(c) for c in range(0x21, 0x260) if packing.PLAIN(chr(c))]
    assert len(letters) > 500
    every = [x for c in letters for x in (c, f"a{c}b", f"1{c}{c}'S", f"{c}!{c}")]
    assert words._ids(every) == words._whole(every)


def test_blocks_that_best_fit_settles_are_not_evolved(spark, monkeypatch):
    """Halves fill sequences to the last token: each block is packed once, and a task takes several blocks."""
    seen, epoch, deal = [], packing._epoch, type(spark.range(0)).repartition
    monkeypatch.setattr(packing, "_epoch", lambda df, *a: (seen.append(df.count()), epoch(df, *a))[1])
    tasks = []
    monkeypatch.setattr(type(spark.range(0)), "repartition", lambda self, n, *c: (tasks.append(n), deal(self, n, *c))[1])
    monkeypatch.setattr(packing, "BLOCK", 4)
    n = 4 * 400
    placed = packing.place(spark.range(n).select(F.col("id").alias("item"), F.lit(8).cast("long").alias("length")), 8 * 2)
    assert placed.count() == n
    assert seen[0] <= 400 and max(tasks) <= 400 // packing.TASK_ROWS
    odd = sum(x % 2 for x in (r["count"] for r in spark.range(n).groupBy(F.pmod(F.xxhash64(F.lit("pack0"), "id"), F.lit(400))).count().collect()))
    got = placed.groupBy("sequence_id").count().groupBy("count").count().collect()
    assert odd and {r["count"] for r in got} <= {1, 2} and sum(seen) < 2 * 400
