"""Byte-level BPE by corpus-level merge replay (operator 8).

The distinct pre-tokens of a block of texts are laid out as one symbol array. An inverted index
maps each mergeable token pair (by its rank) to the positions where it stands; ranks are popped in
ascending order, every position of the rank is merged at once, and only the pairs that touch a
merged position are looked up again and re-indexed.

Defined cases: a null text is encoded as the empty text (no ids); empty texts give no ids; repeated
rows are encoded alike; columns other than the text pass through unused; empty tables give empty
results. Texts are processed whole, in blocks of bounded size, so a worker's memory does not grow
with the table.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, lists, pieces

NONE = np.int64(1 << 40)
#: Entries of the per-worker word cache after which it is emptied (bounds memory, not results).
CACHE_ENTRIES = 250_000
#: Characters of a block: its words, ids and index arrays are in a worker's memory at once.
BLOCK_CHARS = 2_000_000
#: White_Space of Unicode, which is what `\s` means to the tokenizer's own regex engine. Fixed values.
SPACE = "\t-\r \x85\xa0  -     　"
#: A run without white space (with one space before it) is split by the pattern on its own terms.
CHUNK = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


def expand(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indices of the slices that begin at `first` and are `size` long, one slice after the other."""
    before = np.cumsum(size) - size
    return np.repeat(first - before, size) + np.arange(int(size.sum()))


def packed(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all parts, where each begins, and how long it is."""
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(size) - size, size


class Seen(dict):
    """Numbers each new key; `new` lists the keys numbered since it was last emptied."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self.new.append(key)
        self[key] = at = len(self)
        return at


class Codec:
    """Encodes and decodes lists of texts by a rank file's content and a pre-token pattern."""

    def __init__(self, rank_file: bytes, pattern: str):
        rank = {base64.b64decode(a): int(b) for a, b in (x.split() for x in rank_file.splitlines() if x.strip())}
        token = {r: t for t, r in rank.items()}
        self.width = np.int64(max(token) + 1)
        self.bytes, self.bytes_at, self.bytes_size = packed([token.get(i, b"") for i in range(int(self.width))])
        self.digits, self.digits_at, self.digits_size = packed([b"%d " % i for i in range(int(self.width))])
        self.byte = np.array([rank[bytes([i])] for i in range(256)], np.int64)
        pairs = {}
        for t, r in rank.items():
            for i in range(1, len(t)):
                a, b = rank.get(t[:i]), rank.get(t[i:])
                if a is not None and b is not None:
                    pairs[a * int(self.width) + b] = r
        keys = np.fromiter(pairs.keys(), np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.ranks = np.append(np.fromiter(pairs.values(), np.int64, len(pairs))[order], NONE)
        self.pattern = regex.compile(pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^{SPACE}\p{{L}}\p{{N}}]").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]"))
        self._forget()

    def _forget(self) -> None:
        self.seen = Seen()
        self.ids, self.size = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        code = left * self.width + right
        at = np.searchsorted(self.keys, code)
        return np.where(self.keys[at] == code, self.ranks[at], NONE)

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, concatenated, and the number of ids of each word."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        tok = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        n, ends = len(tok), np.cumsum(size)
        if not n:
            return tok, size
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        full = size > 0
        nxt[ends[full] - 1] = -1
        prv[(ends - size)[full]] = -1
        alive, mark, here = np.ones(n, bool), np.zeros(n, bool), np.full(n, NONE)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def post(at: np.ndarray) -> None:
            """(Re)index the pairs that begin at these positions."""
            q = nxt[at]
            inner = q >= 0
            here[at[~inner]] = NONE
            at, q = at[inner], q[inner]
            r = self._rank(tok[at], tok[q])
            here[at] = r
            good = r < NONE
            at, r = at[good], r[good]
            if not len(at):
                return
            order = np.argsort(r, kind="stable")
            at, r = at[order], r[order]
            cut = np.flatnonzero(r[1:] != r[:-1]) + 1
            for key, part in zip(r[np.append(0, cut)].tolist(), np.split(at, cut) if len(cut) else [at], strict=True):
                if key in index:
                    index[key].append(part)
                else:
                    index[key] = [part]
                    heapq.heappush(heap, key)

        post(np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            parts = index.pop(r)
            p = parts[0] if len(parts) == 1 else np.concatenate(parts)
            p = p[here[p] == r]
            if not len(p):
                continue
            mark[p] = True
            clash = mark[nxt[p]]
            mark[p] = False
            if clash.any():  # overlapping positions, as in a run of one letter: leftmost first
                p = np.unique(p)
                taken, keep = -1, []
                for i, j in zip(p.tolist(), nxt[p].tolist(), strict=True):
                    keep.append(i != taken)
                    if keep[-1]:
                        taken = j
                p = p[np.array(keep)]
            q = nxt[p]
            after = nxt[q]
            tok[p], nxt[p], here[q], alive[q] = r, after, NONE, False
            linked = after >= 0
            prv[after[linked]] = p[linked]
            before = prv[p]
            post(np.concatenate((before[before >= 0], p)))
        ids = tok[alive]
        total = np.append(0, np.cumsum(alive))
        return ids, total[ends] - total[ends - size]

    def encode_block(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, concatenated, and the number of ids of each text."""
        if len(self.seen) > CACHE_ENTRIES:
            self._forget()
        cut = [CHUNK.findall(t) if t else [] for t in texts]
        parts = np.fromiter(map(len, cut), np.int64, len(cut))
        at = np.fromiter(map(self.seen.__getitem__, chain.from_iterable(cut)), np.int64, int(parts.sum()))
        if new := self.seen.new:
            self.seen.new = []
            split = list(map(self.pattern.findall, new))
            distinct: dict[str, int] = {}
            own = np.fromiter((distinct.setdefault(w, len(distinct)) for w in chain.from_iterable(split)), np.int64)
            ids, size = self.replay([w.encode() for w in distinct])
            first = np.cumsum(size) - size
            words = np.fromiter(map(len, split), np.int64, len(split))
            self.ids.append(ids[expand(first[own], size[own])].astype(np.int32))
            self.size.append(np.add.reduceat(size[own], np.cumsum(words) - words))
        ids, size = np.concatenate(self.ids), np.concatenate(self.size)
        self.ids, self.size = [ids], [size]
        first = np.cumsum(size) - size
        each = np.append(0, np.cumsum(size[at]))
        ends = np.cumsum(parts)
        return ids[expand(first[at], size[at])], each[ends] - each[ends - parts]

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text."""
        ids, size = self.encode_block(texts)
        return [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])] if len(size) else []

    def decode(self, ids) -> bytes:
        """The bytes of a list or array of ids."""
        ids = np.asarray(ids, np.int64)
        return self.bytes[expand(self.bytes_at[ids], self.bytes_size[ids])].tobytes()

    def decimals(self, ids: np.ndarray) -> bytes:
        """The decimal ids, joined by one space."""
        return self.digits[expand(self.digits_at[ids], self.digits_size[ids])].tobytes()[:-1]


_codecs: dict[str, Codec] = {}


def _codec(shared) -> Codec:
    """One codec a worker process; `shared` is a broadcast of (rank file, pattern)."""
    rank_file, pattern = shared.value
    key = hashlib.sha256(rank_file + pattern.encode()).hexdigest()
    if key not in _codecs:
        _codecs[key] = Codec(rank_file, pattern)
    return _codecs[key]


def _share(df: DataFrame, rank_path: str, pattern: str):
    """The rank file is a vocabulary of fixed size (some 1 MB), so it may be broadcast."""
    with open(rank_path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast((f.read(), pattern))


def encode(df: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every text."""
    shared = _share(df, rank_path, pattern)

    def run(batches):
        codec = _codec(shared)
        for b in pieces(batches, chars=BLOCK_CHARS):
            ids, size = codec.encode_block(column(b, "text").to_pylist())
            yield pa.RecordBatch.from_arrays([column(b, "id"), lists(ids, size, pa.int32())], names=["id", "ids"])

    return df.selectExpr(f"`{id_col}` as id", f"`{text_col}` as text").mapInArrow(run, "id long, ids array<int>").withColumnRenamed("id", id_col)


def decode(df: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, bytes binary) of every list of ids; a null list gives no bytes."""
    shared = _share(df, rank_path, pattern)

    def run(batches):
        codec = _codec(shared)
        for b in batches:
            yield pa.RecordBatch.from_arrays([column(b, "id"), pa.array([codec.decode(x or []) for x in column(b, "ids").to_pylist()], pa.binary())], names=["id", "bytes"])

    return df.selectExpr(f"`{id_col}` as id", f"`{ids_col}` as ids").mapInArrow(run, "id long, bytes binary").withColumnRenamed("id", id_col)


def tokens(df: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, kept columns, n_tokens, ids, exact): the ids of every text, and whether they decode to it."""
    shared = _share(df, rank_path, pattern)
    base = df.select(F.col(id_col).alias("id"), *keep, F.col(text_col).alias("text"))

    def run(batches):
        codec = _codec(shared)
        for b in pieces(batches, chars=BLOCK_CHARS):
            texts = column(b, "text").to_pylist()
            ids, size = codec.encode_block(texts)
            exact = [codec.decode(x) == (t or "").encode() for x, t in zip(np.split(ids, np.cumsum(size)[:-1]), texts, strict=True)]
            yield pa.RecordBatch.from_arrays([*(column(b, c) for c in ("id", *keep)), pa.array(size, pa.int64()), lists(ids, size, pa.int32()), pa.array(exact)], names=["id", *keep, "n_tokens", "ids", "exact"])

    return base.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in base.dtypes[:-1]) + ", n_tokens long, ids array<int>, exact boolean").withColumnRenamed("id", id_col)


def digests(df: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode the ids again and digest both, in one pass: ids never leave the worker."""
    shared = _share(df, rank_path, pattern)

    def run(batches):
        codec = _codec(shared)
        for b in pieces(batches, chars=BLOCK_CHARS):
            ids, size = codec.encode_block(column(b, "text").to_pylist())
            each = np.split(ids, np.cumsum(size)[:-1])
            yield pa.RecordBatch.from_arrays(
                [
                    column(b, "id"),
                    pa.array(size, pa.int64()),
                    pa.array([hashlib.sha256(codec.decimals(x)).hexdigest() for x in each]),
                    pa.array([hashlib.sha256(codec.decode(x)).hexdigest() for x in each]),
                ],
                names=["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return df.selectExpr(f"`{id_col}` as id", f"`{text_col}` as text").mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
