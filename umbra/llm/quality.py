r"""Quality classifier: a factorisation machine (operator 7).

Features of a text: its hashed words (lower-cased, split at white space) by their share of all words,
structure statistics, and its length as metadata. The score is the logistic of
w0 + sum w_i x_i + 1/2 sum_f [(sum v_if x_i)^2 - sum v_if^2 x_i^2], linear in the number of features.

Training runs on the driver over a sample of labelled rows of bounded size, chosen by a hash of the id: about
`sample_docs` rows and `sample_entries` features, two documented bounds, so very long texts are fewer in it. Their
features are computed on the executors from whole texts.

Defined cases: a row with a null id is scored like any other, teaches nothing and is held out by no fold; a null text counts as empty; an empty text has structure features only and still gets
a score; ids labelled more than once take their highest label; an id on several rows teaches by one of its texts
(the one with the smallest hash); null labels teach nothing; without
labels the score is 0.5; repeated rows are treated alike; extra columns are dropped.
"""

from __future__ import annotations

import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, lists, pieces, stash

BUCKETS = 1 << 14
RANK = 8
STATS = 13
CACHE_ENTRIES = 400_000
#: Characters of a piece: its features, and their products by factor, are in a worker's memory at once.
PIECE_CHARS = 2_000_000
PUNCT = re.compile(r"[^\w\s]")
DIGIT = re.compile(r"\d")
UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
ODD_END = re.compile(r"[^\w\s.,;:!?'\")\]](?=\s|$)|[!?]{2,}")


def stats(text: str, words: list[str], distinct: int) -> list[float]:
    """Structure statistics, each of the order of 1."""
    n, chars = len(words), max(len(text), 1)
    lines = text.split("\n")
    stops = sum(text.count(c) for c in ".!?")
    return [
        np.log1p(n) / 8,
        np.log1p(len(text)) / 10,
        min((chars - len(lines)) / max(n, 1) / 10, 3.0),
        len(UPPER.findall(text)) / chars * 5,
        len(PUNCT.findall(text)) / chars * 5,
        len(DIGIT.findall(text)) / chars * 5,
        distinct / max(n, 1),
        len(set(lines)) / len(lines),
        min(np.log1p(n / len(lines)) / 5, 3.0),
        min(len(ODD_END.findall(text)) / max(n, 1) * 2, 3.0),
        min(stops / max(n, 1) * 5, 3.0),
        min(sum(map(str.__eq__, words, words[1:])) / max(n, 1) * 3, 3.0),
        1.0 if n < 5 else 0.0,
    ]


class Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > CACHE_ENTRIES:
            self.clear()
        h = self[word] = zlib.crc32(word.encode("utf-8", "replace")) & (BUCKETS - 1)
        return h


_hashes = Hashes()


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(feature ids ascending, values): words first, then the statistics."""
    text = text or ""
    words = text.lower().split()
    at, n = np.unique(np.fromiter(map(_hashes.__getitem__, words), np.int64, len(words)), return_counts=True)
    x = np.concatenate([n * (4.0 / max(len(words), 1)), stats(text, words, len(set(words)))])
    return np.concatenate([at, BUCKETS + np.arange(STATS)]), x


class Machine:
    def __init__(self, w0: float, w: np.ndarray, v: np.ndarray):
        self.w0, self.w, self.v = w0, w, v

    def logit(self, at: np.ndarray, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Of rows laid end to end; each begins at `first` and has a feature at least."""
        vx = self.v[at] * x[:, None]
        s = np.add.reduceat(vx, first, axis=0)
        return self.w0 + np.add.reduceat(self.w[at] * x, first) + 0.5 * ((s * s).sum(1) - np.add.reduceat((vx * vx).sum(1), first))

    def score(self, at, x, first) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(at, x, first), -40, 40)))


def slopes(par: np.ndarray, w0: float, at: np.ndarray, x: np.ndarray, square: np.ndarray, first: np.ndarray, size: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The gradient of the mean log loss by par (row f is factor f, the last one w), and by each row's logit.

    One factor at a time, so that no array is larger than the entries: with s_f the sum of v_if x_i over a row,
    the gradient of v_if is the sum of g x_i s_f over rows less v_if times the sum of g x_i^2.
    """
    n = par.shape[1]
    s = [np.add.reduceat(p[at] * x, first) for p in par[:-1]]
    z = w0 + np.add.reduceat(par[-1][at] * x, first) + 0.5 * (sum(v * v for v in s) - np.add.reduceat((par[:-1] ** 2).sum(0)[at] * square, first))
    g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(y)
    own = np.bincount(at, np.repeat(g, size) * square, n)
    factors = [np.bincount(at, np.repeat(g * v, size) * x, n) - p * own for v, p in zip(s, par, strict=False)]
    return np.stack([*factors, np.bincount(at, np.repeat(g, size) * x, n)]), g


def fit(at: np.ndarray, x: np.ndarray, first: np.ndarray, y: np.ndarray, steps: int = 120, rate: float = 0.05, decay: float = 1e-4, seed: int = 3) -> Machine:
    """Full-batch Adam on the log loss."""
    n = BUCKETS + STATS
    # Row f of par is factor f; the last one is w.
    par = np.vstack([np.random.default_rng(seed).normal(0, 0.05, (n, RANK)).T, np.zeros(n)])
    w0 = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    size, square = np.diff(np.append(first, len(at))), x * x
    one, two = np.zeros_like(par), np.zeros_like(par)
    b1 = b2 = 0.0
    for t in range(1, steps + 1):
        grad, g = slopes(par, w0, at, x, square, first, size, y)
        grad += decay * par
        one = 0.9 * one + 0.1 * grad
        two = 0.99 * two + 0.01 * grad * grad
        par -= rate * (one / (1 - 0.9**t)) / (np.sqrt(two / (1 - 0.99**t)) + 1e-8)
        b1, b2 = 0.9 * b1 + 0.1 * g.sum(), 0.99 * b2 + 0.01 * g.sum() ** 2
        w0 -= rate * (b1 / (1 - 0.9**t)) / (np.sqrt(b2 / (1 - 0.99**t)) + 1e-8)
    return Machine(w0, par[RANK].copy(), np.ascontiguousarray(par[:RANK].T))


def learn(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_docs: int = 4000, sample_entries: int = 16_000_000) -> Machine:
    """From about `sample_docs` labelled rows with about `sample_entries` features; `df` and `labels` are already without the held-out ones."""
    labels = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label"))
    many = labels.count()
    draw = F.pmod(F.xxhash64("id", F.lit("quality")), F.lit(1_000_003)) / 1_000_003.0
    labels = labels.where(draw < min(1.0, sample_docs / max(many, 1)))
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(labels, "id")
    rows = rows.groupBy("id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # a row an id, so the bound holds
    rows = stash(rows, "quality-sample")
    # A text has at most as many different words as half its length, and as there are buckets.
    entries = F.least(F.coalesce(F.length("text"), F.lit(0)) / 2 + 1, F.lit(float(BUCKETS))) + STATS
    most = rows.agg(F.coalesce(F.sum(entries), F.lit(0.0))).first()[0]
    if most > sample_entries:
        rows = rows.where(F.pmod(F.xxhash64("id", F.lit("entries")), F.lit(1_000_003)) / 1_000_003.0 < sample_entries / most)

    def run(batches):
        for b in pieces(batches, chars=PIECE_CHARS):
            each = [features(t) for t in column(b, "text").to_pylist()]
            size = [len(a) for a, _ in each]
            flat = lambda k, kind: lists(np.concatenate([e[k] for e in each]), size, kind)
            yield pa.RecordBatch.from_arrays([column(b, "id"), column(b, "label").cast(pa.float64()), flat(0, pa.int32()), flat(1, pa.float64())], names=["id", "label", "at", "x"])
        _hashes.clear()  # a reused worker's next task may be another operator's

    got = rows.mapInArrow(run, "id long, label double, at array<int>, x array<double>").toArrow().sort_by([("id", "ascending")]).combine_chunks()
    if not got.num_rows:
        return Machine(0.0, np.zeros(BUCKETS + STATS), np.zeros((BUCKETS + STATS, RANK)))
    size = np.fromiter((len(v) for v in got["at"]), np.int64, got.num_rows)
    flat = lambda c: np.concatenate([np.asarray(v.values) for v in got[c]])
    return fit(flat("at"), flat("x"), np.cumsum(size) - size, np.minimum(got["label"].to_numpy(), 1.0))


def score(df: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", keep: list[Column] = ()) -> DataFrame:
    """(id, kept columns, score) of every whole text. The machine has a fixed size (some 1 MB), so it may be broadcast."""
    shared = df.sparkSession.sparkContext.broadcast(machine)
    base = df.select(F.col(id_col), *keep)
    kept = base.columns
    name = text_col if text_col in kept else "__text"
    if name not in kept:
        base = df.select(F.col(id_col), *keep, F.col(text_col).alias(name))

    def run(batches):
        for b in pieces(batches, chars=PIECE_CHARS, text=name):
            each = [features(t) for t in column(b, name).to_pylist()]
            size = np.fromiter((len(a) for a, _ in each), np.int64, len(each))
            at, x = (np.fromiter(chain.from_iterable(e[k] for e in each), kind, int(size.sum())) for k, kind in ((0, np.int64), (1, np.float64)))
            yield pa.RecordBatch.from_arrays([column(b, c) for c in kept] + [pa.array(shared.value.score(at, x, np.cumsum(size) - size))], names=[*kept, "score"])
        _hashes.clear()  # a reused worker's next task may be another operator's

    return base.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in base.dtypes if c in kept) + ", score double")
