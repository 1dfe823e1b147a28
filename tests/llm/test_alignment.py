import hashlib
from collections import Counter

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st

from umbra.llm import alignment

PATHS = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
FILES = tuple(open(p, "rb").read() for p in PATHS)
PAIR = alignment.Pair(*FILES)
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
ODD = ["", None, "a", " a", "a ", "a \n ", "  a  b", "\n\nfoo\r\nbar\n", "x = {\r\n}\r;\r", "tab\tand nbsp　wide", "<s></s><unk><|endoftext|>", "a▁b", "▁", "naïve café", "été", "漢字かな交じり文", "😀👍🏽 ok", "\x00\x01", " " * 50, "\r" * 7 + "z", "1234567 89", "don't we'll I'M", "a" * 500, "!?" * 200, "​﻿x", "x \r y", "x\r y \n z", "ﬁ ² Ⅷ ½"]


def groups_of(text):
    """Of whole texts, token by token: None, or (A ids, B ids, groups, links)."""
    if not text:
        return None
    a, b, whole = PAIR.a.encode(" " + text, add_special_tokens=False).ids, PAIR.b.encode(text), (" " + text).encode()
    if b"".join(PAIR.bytes_a[i] for i in a) != whole or b"".join(PAIR.bytes_b[i] for i in b) != whole:
        return None
    ends = [np.cumsum([len(x[i]) for i in ids]).tolist() for x, ids in ((PAIR.bytes_a, a), (PAIR.bytes_b, b))]
    names, links, i, j = [], [], 0, 0
    for cut in sorted(set(ends[0]) & set(ends[1])):
        x, y = [], []
        while i < len(a) and ends[0][i] <= cut:
            x.append(a[i])
            i += 1
        while j < len(b) and ends[1][j] <= cut:
            y.append(b[j])
            j += 1
        names.append(",".join(map(str, x)) + "|" + ",".join(map(str, y)))
        links += [(p, q) for p, e in zip(a, ends[0], strict=True) for q, f in zip(b, ends[1], strict=True) if e == f == cut] if len(a) * len(b) < 10_000 else [(x[-1], y[-1])]
    return a, b, names, links


def brute(texts):
    found = [groups_of(t) for t in texts]
    count = Counter(link for f in found if f for link in f[3])
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    digest = lambda names: hashlib.sha256(";".join(names).encode()).hexdigest()
    return [(len(f[0]), len(f[1]), len(f[2]), len(f[3]), sum(count[x] == best[x[1]] for x in f[3]), sum(count[x] for x in f[3]), digest(f[2])) if f else (0,) * 6 + ("",) for f in found]


def result(df):
    return sorted((r["doc_id"], *[r[c] for c in COLUMNS]) for r in alignment.Alignment(df, *PATHS).per_document().collect())


def test_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert result(docs) == sorted((i, *b) for (i, _), b in zip(rows, brute([t for _, t in rows]), strict=True))


def test_cases(spark, monkeypatch):
    rows = [(i, t, 7, "x") for i, t in enumerate([*ODD, *ODD[:8], "the end of the " * 3000])]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_a int, name string").repartition(3)
    want = sorted((i, *b) for i, b in enumerate(brute([r[1] for r in rows])))
    assert result(df) == want
    assert result(df.limit(0)) == []
    twice = result(df.select("doc_id", "text").union(df.select("doc_id", "text")))
    assert [r[:4] for r in twice[::2]] == [r[:4] for r in want] and [r[6] for r in twice[::2]] == [2 * r[6] for r in want]
    # a text may be in any dictionary, and chunks be forgotten in between
    for name, value in (("CACHE_CHUNKS", 4), ("DICTIONARY", 4), ("BLOCK_CHARS", 30), ("SHARED_CHARS", 60)):
        monkeypatch.setattr(alignment, name, value)
    aligner, total = alignment.Aligner(PAIR), Counter()
    for i in range(0, len(ODD), 3):
        aligner.block(ODD[i : i + 3])
        _, _, names, n, _ = aligner.dictionary()
        total.update(dict(zip(names, n.tolist(), strict=True)))
    assert total == Counter(x for t in ODD if (f := groups_of(t)) for x in f[2])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \n\r\t 　▁ab{};.'1é"), st.characters(codec="utf-8")), max_size=30), max_size=4))
def test_chunks_are_independent(texts):
    counts, digests, *_ = alignment.Aligner(PAIR).block(texts)
    for t, c, d in zip(texts, counts.tolist(), digests, strict=True):
        f = groups_of(t)
        assert c == ([len(f[0]), len(f[1]), len(f[2])] if f else [0, 0, 0])
        assert d == (hashlib.sha256(";".join(f[2]).encode()).hexdigest() if f else "")


def test_pairs_are_bounded_by_the_vocabularies(spark):
    aligned = alignment.Alignment(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), *PATHS)
    for r in aligned.pairs.collect():
        a, b = PAIR.bytes_a[r["a"]], PAIR.bytes_b[r["b"]]
        assert a.endswith(b) or b.endswith(a)
    assert aligned.pairs.count() <= PAIR.possible_pairs() < 400_000
    assert aligned.groups.count() == aligned.links.select("name").distinct().count()
