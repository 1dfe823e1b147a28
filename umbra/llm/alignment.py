"""Cross-tokenizer alignment by a group dictionary (operator 12).

Two tokenizers cut a text differently. Where tokens of both end at one byte, the text is cut into groups of
some A ids and some B ids. Each task interns its distinct groups in a dictionary and writes every document as
numbers of it, with frequencies, and the dictionary with its totals. The dictionaries are merged by the groups
themselves; links are expanded once for each distinct group, multiplied by its frequency, and counted by id pair;
each group's results are joined back to the dictionaries by group key, and to the documents by dictionary.

A link is a pair of an A and a B token that end at one byte. Both cover the bytes before it, so the shorter
token's bytes end the longer one's: pairs are at most those of the two vocabularies in which one token ends with
the other (`possible_pairs`), whatever the corpus, and their counts may be broadcast. A frequent group comes once
from each dictionary, so it is no hot key.

Texts are cut into chunks that both tokenizers treat one by one: white space with what follows it, where no B piece reaches over that
cut. What a distinct chunk gives is kept by the worker while it is frequent.

Defined cases: null and empty texts, and texts whose tokens' bytes by A or B are not " " + text, have no tokens:
zeros, and an empty groups_sha256; rows that repeat or share an id are rows of their own; long texts are read whole; an
empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import SPACE
from .chunks import Chunks, Ragged, byte_letters, expand, sums
from .common import column, lists, pieces, stash

#: Distinct chunks, and groups, that a worker keeps; beyond, the rarer half of the chunks goes, and a new dictionary begins.
CACHE_CHUNKS, DICTIONARY = 300_000, 400_000
#: Characters of a block of texts, and of the texts that share a dictionary at most.
BLOCK_CHARS, SHARED_CHARS = 3_000_000, 24_000_000


def piece_bytes(piece: str) -> bytes:
    if re.fullmatch("<0x[0-9A-F]{2}>", piece):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


class Pair:
    """Tokenizers A (byte-level, a `tokenizers` file) and B (pieces, a `sentencepiece` model): ids by chunk, bytes by id."""

    def __init__(self, a: bytes, b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_buffer(a), sentencepiece.SentencePieceProcessor(model_proto=b)
        self.a.encode_special_tokens = True
        letters = byte_letters()
        vocab = {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.bytes_a = [bytes(letters[c] for c in t) if (t := vocab.get(i, "")) and all(c in letters for c in t) else t.encode() for i in range(max(vocab) + 1)]
        pieces_b = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [piece_bytes(p) for p in pieces_b]
        self.size_a, self.size_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.bytes_a, self.bytes_b))
        self.blank = self.b.encode("a ")[len(self.b.encode("a")) :]
        # A cut stands before a space behind other characters, unless some B piece reaches over such a place.
        over = re.compile(f"[^▁{SPACE}]▁")
        glue = SPACE if any(map(over.search, pieces_b)) else SPACE.replace(" ", "", 1)
        self.chunk = re.compile(f"[{SPACE}]*[^{SPACE}]+(?:[{glue}][{SPACE}]*[^{SPACE}]*)*|[{SPACE}]+")

    def encode(self, chunks: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of chunks that begin with a space; B puts one in front by itself, but not of nothing."""
        ids_a = [e.ids for e in self.a.encode_batch_fast(chunks, add_special_tokens=False)]
        return ids_a, [x or self.blank for x in self.b.encode([c[1:] for c in chunks], num_threads=1)]

    def possible_pairs(self) -> int:
        """How many pairs of an A and a B token there are in which one's bytes end with the other's: no corpus links more."""
        count = lambda short, long, least: sum(short[t[i:]] for t in long for i in range(least, len(t)))
        return count(Counter(self.bytes_b), self.bytes_a, 0) + count(Counter(self.bytes_a), self.bytes_b, 1)


class Aligner:
    """Groups of texts, as numbers of a dictionary that goes on from block to block until it is handed out."""

    def __init__(self, pair: Pair):
        self.pair, self.chunks, self.groups = pair, Chunks(CACHE_CHUNKS), Ragged()
        self.names = Chunks(DICTIONARY)
        self.strings: list[str] = []
        self.counts = np.zeros((0, 4), np.int64)  # of each chunk: A ids, B ids, groups, whether it is exact
        self.begin()

    def begin(self) -> None:
        self.id, self.chars, self.n, self.docs = uuid.uuid4().hex, 0, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def crowded(self) -> bool:
        return self.chars > SHARED_CHARS or len(self.chunks) > CACHE_CHUNKS or len(self.names) > DICTIONARY

    def dictionary(self) -> tuple[str, np.ndarray, list[str], np.ndarray, np.ndarray]:
        """(its id, numbers, groups, occurrences, documents) of all groups used since the last call; then a new one begins."""
        used = np.flatnonzero(self.n)
        names = list(self.names)
        out = self.id, used, [names[i] for i in used.tolist()], self.n[used], self.docs[used]
        self.begin()
        self.chunks.most = CACHE_CHUNKS if len(self.names) <= DICTIONARY else len(self.chunks) - 1
        kept = self.chunks.shrink()
        if kept is not None:
            at, size = self.groups.take(kept)
            old, at = np.unique(at, return_inverse=True)
            self.names.clear()
            self.names.update((names[i], k) for k, i in enumerate(old.tolist()))
            self.groups.clear()
            self.groups.add(at, size)
            self.strings = [self.strings[i] for i in kept.tolist()]
            self.counts = self.counts[kept]
        return out

    def _learn(self, new: list[str]) -> None:
        """Cut new chunks into groups and number these."""
        ids_a, ids_b = self.pair.encode(new)
        bytes_a, bytes_b = self.pair.bytes_a, self.pair.bytes_b
        raw = [c.encode() for c in new]
        exact = np.array([b"".join([bytes_a[i] for i in a]) == r == b"".join([bytes_b[i] for i in b]) for a, b, r in zip(ids_a, ids_b, raw, strict=True)], bool)
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(new)) for x in (ids_a, ids_b))
        a, b = (np.fromiter(chain.from_iterable(x for x, e in zip(ids, exact, strict=True) if e), np.int64) for ids in (ids_a, ids_b))
        # Exact chunks stand one after the other, by A and by B alike, so ends are positions in all their bytes.
        end_a, end_b = np.cumsum(self.pair.size_a[a]), np.cumsum(self.pair.size_b[b])
        cuts = np.intersect1d(end_a, end_b)
        text_a = joined(a, np.searchsorted(cuts, end_a), len(cuts))
        text_b = joined(b, np.searchsorted(cuts, end_b), len(cuts))
        names = [f"{x}|{y}" for x, y in zip(text_a, text_b, strict=True)]
        size = np.fromiter(map(len, raw), np.int64, len(raw)) * exact
        ends = np.searchsorted(cuts, np.cumsum(size), "right")
        n_groups = np.diff(ends, prepend=0)
        self.groups.add(np.fromiter(map(self.names.__getitem__, names), np.int32, len(names)), n_groups)
        self.names.new = []
        self.strings += [";".join(names[e - n : e]) for e, n in zip(ends.tolist(), n_groups.tolist(), strict=True)]
        self.counts = np.concatenate((self.counts, np.stack((n_a, n_b, n_groups, exact), 1)))

    def block(self, texts: list[str | None]):
        """(counts of A ids, B ids and groups, digests, group numbers one text after the other, their frequencies, how many each text has)."""
        at, size, new = self.chunks.number([self.pair.chunk.findall(" " + t) if t else [] for t in texts])
        if new:
            self._learn(new)
        self.chars += sum(map(len, filter(None, texts)))
        whole = (sums(1 - self.counts[at, 3], size) == 0) & (size > 0)
        at, size = at[np.repeat(whole, size)], size * whole
        counts = np.stack([sums(self.counts[at, k], size) for k in range(3)], 1)
        digests, i = [], 0
        strings = list(map(self.strings.__getitem__, at.tolist()))
        for n in size.tolist():
            digests.append(hashlib.sha256(";".join(strings[i : i + n]).encode()).hexdigest() if n else "")
            i += n
        groups, each = self.groups.take(at)
        each = sums(each, size)
        width = max(len(self.names), 1)
        key, times = np.unique(np.repeat(np.arange(len(each)), each) * width + groups, return_counts=True)
        row, own = key // width, key % width
        self.n, self.docs = (np.pad(x, (0, width - len(x))) for x in (self.n, self.docs))
        self.n += np.bincount(own, times, width).astype(np.int64)
        self.docs += np.bincount(own, minlength=width)
        return counts, digests, own, times, np.bincount(row, minlength=len(each))


def joined(ids: np.ndarray, group: np.ndarray, n: int) -> list[str]:
    """The decimal ids of each of n groups, joined by commas."""
    text = list(map(str, ids.tolist()))
    size = np.bincount(group, minlength=n)
    if len(text) == n and (size == 1).all():
        return text
    ends = np.cumsum(size)
    return [text[e - 1] if m == 1 else ",".join(text[e - m : e]) for e, m in zip(ends.tolist(), size.tolist(), strict=True)]


_aligners: dict[str, Aligner] = {}


def _aligner(shared) -> Aligner:
    """One a worker process; `shared` is a broadcast of both tokenizers' files: vocabularies of fixed size, some 2 MB."""
    a, b = shared.value
    key = hashlib.sha256(a + b).hexdigest()
    if key not in _aligners:
        _aligners[key] = Aligner(Pair(a, b))
    return _aligners[key]


ALL_COLUMNS = {"id": None, "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "sha": pa.string(), "groups": pa.list_(pa.int32()), "times": pa.list_(pa.int32()), "number": pa.int32(), "name": pa.string(), "n": pa.int64(), "docs": pa.int64()}


def _intern(df: DataFrame, shared) -> DataFrame:
    """Rows of documents (name null) and rows of dictionaries (name: the group), told apart by dictionary."""

    def run(batches):
        aligner = _aligner(shared)
        aligner.begin()
        kind = None

        def rows(count: int, dictionary: str, **cols) -> pa.RecordBatch:
            own = {"dictionary": pa.array([dictionary] * count, pa.string())}
            for name, t in ALL_COLUMNS.items():
                own[name] = cols[name] if name in cols else pa.nulls(count, kind if t is None else t)
            return pa.RecordBatch.from_pydict(own)

        def entries() -> pa.RecordBatch:
            id_, number, names, n, docs = aligner.dictionary()
            return rows(len(names), id_, number=pa.array(number, pa.int32()), name=pa.array(names, pa.string()), n=pa.array(n), docs=pa.array(docs))

        for b in pieces(batches, chars=BLOCK_CHARS):
            kind = column(b, "id").type
            counts, digests, own, times, each = aligner.block(column(b, "text").to_pylist())
            n = {c: pa.array(np.ascontiguousarray(counts[:, k])) for k, c in enumerate(("n_a", "n_b", "n_groups"))}
            yield rows(b.num_rows, aligner.id, id=column(b, "id"), sha=pa.array(digests, pa.string()), groups=lists(own, each, pa.int32()), times=lists(times, each, pa.int32()), **n)
            if aligner.crowded():
                yield entries()
        if kind is not None:
            yield entries()

    schema = "dictionary string, id {}, n_a long, n_b long, n_groups long, sha string, groups array<int>, times array<int>, number int, name string, n long, docs long"
    return df.mapInArrow(run, schema.format(df.dtypes[0][1]))


def _links(groups: DataFrame, shared) -> DataFrame:
    """(name, n, docs, a, b): a row for each link of each distinct group."""

    def run(batches):
        pair = _aligner(shared).pair
        for batch in batches:
            names = [x.split("|") for x in column(batch, "name").to_pylist()]
            if not names:
                continue
            ids, ends, rows = [], [], []
            for side, size in ((0, pair.size_a), (1, pair.size_b)):
                own = [x[side].split(",") for x in names]
                each = np.fromiter(map(len, own), np.int64, len(own))
                flat = np.array(list(chain.from_iterable(own)), np.int64)
                total = np.cumsum(size[flat])
                ids.append(flat)
                rows.append(np.repeat(np.arange(len(own)), each))
                ends.append(total)  # both sides of a group have the same bytes, so positions agree
            first = np.searchsorted(ends[1], ends[0], "left")
            found = np.searchsorted(ends[1], ends[0], "right") - first
            at_a, at_b = np.repeat(np.arange(len(ids[0])), found), expand(first, found)
            same = rows[0][at_a] == rows[1][at_b]  # a token without bytes may stand at the end of the group before
            at_a, at_b = at_a[same], at_b[same]
            row = pa.array(rows[0][at_a])
            yield pa.RecordBatch.from_arrays([*(column(batch, c).take(row) for c in ("name", "n", "docs")), pa.array(ids[0][at_a], pa.int32()), pa.array(ids[1][at_b], pa.int32())], names=["name", "n", "docs", "a", "b"])

    return groups.select("name", "n", "docs").mapInArrow(run, "name string, n long, docs long, a int, b int")


def _sums(left: pa.Table, right: pa.Table) -> pa.Table:
    """The documents of a dictionary, with the sums over their groups of the groups' results."""
    flat = lambda c: left.column(c).combine_chunks()
    groups, times = flat("groups"), flat("times")
    each = np.diff(np.asarray(groups.offsets))
    own, times = np.asarray(groups.flatten()), np.asarray(times.flatten())
    number = np.asarray(right.column("number"))
    out = left.select(["id", "n_a", "n_b", "n_groups"])
    for c in ("n_links", "n_best", "count_sum"):
        value = np.zeros(int(number.max(initial=-1)) + 1, np.int64)
        value[number] = np.asarray(right.column(c))
        out = out.append_column(c, pa.array(sums(value[own] * times, each), pa.int64()))
    return out.append_column("groups_sha256", left.column("sha"))


class Alignment:
    """An aligned corpus: documents, dictionaries, groups (the distinct ones), links and pairs, written in the shared folder."""

    def __init__(self, df: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text"):
        with open(path_a, "rb") as a, open(path_b, "rb") as b:
            shared = df.sparkSession.sparkContext.broadcast((a.read(), b.read()))
        own = stash(_intern(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), shared), "interned")
        self.id_col = id_col
        self.documents = own.where("name is null").select("dictionary", "id", "n_a", "n_b", "n_groups", "sha", "groups", "times")
        self.dictionaries = own.where("name is not null").select("dictionary", "number", "name", "n", "docs")
        #: (name, n, docs): each distinct group, `a1,a2|b1`, its occurrences and documents.
        self.groups = stash(self.dictionaries.groupBy("name").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "groups")
        self.links = stash(_links(self.groups, shared), "links")
        count = self.links.groupBy("a", "b").agg(F.sum("n").alias("count"))
        #: (a, b, count, best): linked ids, how often, and whether no other A id is linked with b more often; see Pair.possible_pairs.
        self.pairs = stash(count.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("b"))), "pairs")

    def per_document(self) -> DataFrame:
        """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document."""
        found = self.links.join(F.broadcast(self.pairs), ["a", "b"])
        found = found.groupBy("name").agg(F.count("*").alias("n_links"), F.count_if("best").alias("n_best"), F.sum("count").alias("count_sum"))
        back = self.dictionaries.select(F.col("dictionary").alias("of"), "number", "name").join(found, "name").drop("name")
        kind = dict(self.documents.dtypes)["id"]
        schema = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
        out = self.documents.groupBy("dictionary").cogroup(back.groupBy("of")).applyInArrow(_sums, schema)
        return out.withColumnRenamed("id", self.id_col)
