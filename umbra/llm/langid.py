r"""Language identification with spans (operator 5).

A word is a run of letters (Unicode category L) with the marks that combine with them. Its script, from fixed
code-point ranges and by most of its letters, narrows the languages it can belong to (those that
were seen in that script while learning). Each word gets a log-score for each language from hashed
character n-grams, and Viterbi with a penalty for each switch labels runs of words, so mixed texts
get a span for each language. The language with the most letters in its spans is the prediction.

Learning is naive Bayes on counts from a bounded sample of labelled rows: at most about
`sample_docs` documents a language (documented bound), chosen by a hash of the id; their whole texts
count. The model is a table of `BUCKETS` x languages.

Defined cases: a row with a null id is predicted like any other, and held out by no fold; a null text or one
without a letter is `und` with score 0; words of a script that no
learned language uses may be any language; ties go to the language first in order; repeated rows are
treated alike; extra columns are dropped; with nothing to learn from, every text is `und`; empty
tables give empty results.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import Seen
from .common import column, pieces

BUCKETS = 1 << 15
GRAMS = (1, 2, 3, 4)
PENALTY = 12.0
#: Words scored at once are remembered up to this many (bounds memory, not results).
CACHE_ENTRIES = 400_000
MAX_LANGS = 1000


def ranges(kinds: tuple[str, ...], end: int = 0xE0200) -> str:
    """Characters of these Unicode categories, below `end`, as the inside of a character class."""
    at = [i for span in (range(0x20000), range(0xE0000, 0xE0200)) for i in span if i < end and unicodedata.category(chr(i)) in kinds]
    first = [i for i, before in zip(at, [-2, *at], strict=False) if i != before + 1]
    last = [i for i, after in zip(at, [*at[1:], -2], strict=True) if i + 1 != after]
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in zip(first, last, strict=True))


_LETTER = rf"[^\W\d_{ranges(('No', 'Nl'))}]"
_MARK = f"[{ranges(('Mn', 'Mc', 'Me'))}]"
WORD = re.compile(f"{_LETTER}+(?:{_MARK}+{_LETTER}*)*")
#: The same words, faster, in a text without a mark or a numeral that is no digit.
PLAIN_WORD = re.compile(r"[^\W\d_]+")
ODD = re.compile(f"[{ranges(('No', 'Nl', 'Mn', 'Mc', 'Me'), 0x10000)}\U00010000-\U0010ffff]")


def word_pattern(text: str) -> re.Pattern:
    """What finds a text's words."""
    return PLAIN_WORD if text.isascii() or not ODD.search(text) else WORD


#: Script ranges by first code point. Fixed values.
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, "Other"), (0x0900, "Devanagari"),
    (0x0980, "Bengali"), (0x0A00, "Other"), (0x0B80, "Tamil"), (0x0C00, "Other"), (0x0E00, "Thai"), (0x0E80, "Other"), (0x10A0, "Georgian"), (0x1100, "Hangul"),
    (0x1200, "Ethiopic"), (0x13A0, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x3040, "Kana"), (0x3100, "Other"), (0x3400, "Han"),
    (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB50, "Arabic"), (0xFE00, "Other"), (0x20000, "Han"),
]
STARTS = [a for a, _ in SCRIPTS]
NAMES = sorted({n for _, n in SCRIPTS})
SCRIPT_AT = [NAMES.index(n) for _, n in SCRIPTS]


def script(word: str) -> int:
    """That of most letters; of scripts with as many, the first in the word."""
    if word.isascii():
        return SCRIPT_AT[0]
    of = [SCRIPT_AT[bisect_right(STARTS, ord(c)) - 1] for c in word if c.isalpha()]
    return max(dict.fromkeys(of), key=of.count) if of else SCRIPT_AT[bisect_right(STARTS, ord(word[0])) - 1]


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all words, each between < and >, and the number of the word that each belongs to."""
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    code = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), size)
    end = np.cumsum(size)[word]
    first = end - size[word]
    at, own = [], []
    for n in GRAMS:
        i = np.arange(len(code) - n + 1)
        i = i[(i + n <= end[i]) & ((n > 1) | ((i > first[i]) & (i + 1 < end[i])))]
        h = np.full(len(i), n, np.uint64)
        for j in range(n):
            h = (h ^ code[i + j]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        at.append((h >> np.uint64(20)).astype(np.int64) & (BUCKETS - 1))
        own.append(word[i])
    return np.concatenate(at), np.concatenate(own)


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray):
        """counts: BUCKETS x langs; scripts: script x langs (letters seen)."""
        self.langs = langs
        total = counts.sum(0) + 0.5 * BUCKETS
        self.log = np.log((counts + 0.5) / total).astype(np.float32) if langs else np.zeros((BUCKETS, 0), np.float32)
        share = scripts / np.maximum(scripts.sum(0), 1)
        self.allowed = share > 0.01
        self.allowed[~self.allowed.any(1)] = True
        self._forget()

    def _forget(self) -> None:
        self.at = Seen()
        self.scores = np.zeros((0, len(self.langs)), np.float32)

    def score_new(self) -> None:
        new, self.at.new = self.at.new, []
        if not new:
            return
        at, own = grams(new)
        n = len(new)
        size = np.bincount(own, minlength=n)
        s = np.column_stack([np.bincount(own, self.log[at, k], n) for k in range(len(self.langs))]) / np.sqrt(size)[:, None]
        s[~self.allowed[np.fromiter(map(script, new), np.int64, n)]] = -1e4
        self.scores = np.concatenate([self.scores, s.astype(np.float32)])

    def label(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The language of each word (Viterbi), and each language's total score."""
        s = self.scores[words].astype(np.float64)
        total = s.sum(0)
        top = int(total.argmax())
        # One language throughout is optimal if no other gains more than the penalty on any stretch, nor any two
        # together on a stretch from the start and one to the end: q switches leave q - 1 stretches between these.
        gain = np.cumsum(s - s[:, top : top + 1], axis=0)
        low = np.minimum.accumulate(np.vstack([np.zeros((1, s.shape[1])), gain[:-1]]), axis=0)
        most = (gain - low).max(1)
        if most.max() <= PENALTY and gain.max() + most[-1] <= PENALTY:
            return np.full(len(words), top), total
        k = s.shape[1]
        # The maximum over languages is at most PENALTY above any other, so a language is worth
        # best - PENALTY at least: that is the switch. back[t][j]: the language before j at word t.
        rows = s.tolist()
        best, back, each = rows[0], [], range(k)
        for row in rows[1:]:
            top_score = max(best)
            jump = top_score - PENALTY
            if min(best) < jump:
                m = best.index(top_score)
                back.append([m if best[j] < jump else j for j in each])
                best = [(jump if best[j] < jump else best[j]) + row[j] for j in each]
            else:
                back.append(None)
                best = [best[j] + row[j] for j in each]
        at = best.index(max(best))
        path = [at]
        for step in reversed(back):
            if step is not None:
                at = step[at]
            path.append(at)
        out = np.array(path[::-1])
        return out, total

    def spans(self, texts: list[str | None]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        """Prediction, score and (start, end, language) spans in code points of each text."""
        if len(self.at) > CACHE_ENTRIES:
            self._forget()
        found = [[(m.start(), m.end(), self.at[m[0].lower()]) for m in word_pattern(t).finditer(t)] if t and self.langs else [] for t in texts]
        self.score_new()
        out = []
        for ws in found:
            if not ws:
                out.append(("und", 0.0, []))
                continue
            a = np.array(ws)
            path, total = self.label(a[:, 2])
            cut = np.flatnonzero(np.diff(path)) + 1
            first, last = np.append(0, cut), np.append(cut, len(path)) - 1
            spans = [(int(a[i, 0]), int(a[j, 1]), self.langs[path[i]]) for i, j in zip(first, last, strict=True)]
            out.append((*self.choose(path, a[:, 1] - a[:, 0], total), spans))
        return out

    def choose(self, path: np.ndarray, letters: np.ndarray, total: np.ndarray) -> tuple[str, float]:
        weight = np.bincount(path, letters, len(self.langs))
        best = int(weight.argmax())
        odds = 1 / (1 + np.exp(np.clip(np.delete(total, best) - total[best], -50, 50)).sum()) if len(total) > 1 else 1.0
        return self.langs[best], float(weight[best] / weight.sum() * max(odds, 0.5))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """As spans(), without offsets."""
        if len(self.at) > CACHE_ENTRIES:
            self._forget()
        number = self.at.__getitem__
        found = []
        for t in texts:
            low = t.lower() if t and self.langs else ""
            ws = word_pattern(low).findall(low)
            found.append((np.fromiter(map(number, ws), np.int64, len(ws)), np.fromiter(map(len, ws), np.int64, len(ws))))
        self.score_new()
        names, scores = [], []
        for ws, letters in found:
            if len(ws):
                path, total = self.label(ws)
                name, score = self.choose(path, letters, total)
            else:
                name, score = "und", 0.0
            names.append(name)
            scores.append(score)
        return names, scores


def learn(df: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_docs: int = 4000) -> Model:
    """Counts from about `sample_docs` labelled documents a language, gathered as one table of bounded size."""
    df = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null")
    many = {r["lang"]: r["n"] for r in df.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGS + 1).collect()}
    if len(many) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    langs = sorted(many)
    if not langs:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros((len(NAMES), 0)))
    rate = F.create_map(*chain.from_iterable((F.lit(k), F.lit(min(1.0, sample_docs / n))) for k, n in many.items()))
    draw = F.pmod(F.xxhash64("id", F.lit("langid")), F.lit(1_000_003)) / 1_000_003.0
    sample = df.where(draw < rate[F.col("lang")]).select("text", "lang")

    def count(batches):
        sums, letters = {}, {}
        for b in pieces(batches):
            bags: dict[str, dict[str, int]] = {}
            for text, lang in zip(column(b, "text").to_pylist(), column(b, "lang").to_pylist(), strict=True):
                bag = bags.setdefault(lang, {})
                low = text.lower()
                for w in word_pattern(low).findall(low):
                    bag[w] = bag.get(w, 0) + 1
            for lang, bag in bags.items():
                if bag:
                    words, n = list(bag), np.fromiter(bag.values(), np.float64, len(bag))
                    at, own = grams(words)
                    sums[lang] = sums.get(lang, 0) + np.bincount(at, n[own], BUCKETS)
                    size = np.fromiter(map(len, words), np.int64, len(words))
                    letters[lang] = letters.get(lang, 0) + np.bincount(np.fromiter(map(script, words), np.int64, len(words)), n * size, len(NAMES))
        for lang, s in sums.items():
            hit = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(hit)), pa.array(hit, pa.int32()), pa.array(s[hit])], names=["lang", "bucket", "n"])
            hit = np.flatnonzero(letters[lang])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(hit)), pa.array(-1 - hit, pa.int32()), pa.array(letters[lang][hit])], names=["lang", "bucket", "n"])

    rows = sample.mapInArrow(count, "lang string, bucket int, n double").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # BUCKETS + scripts rows a language at most
    counts, scripts = np.zeros((BUCKETS, len(langs))), np.zeros((len(NAMES), len(langs)))
    lang = rows["lang"].map({k: i for i, k in enumerate(langs)}).to_numpy(int)
    bucket, n = rows["bucket"].to_numpy(int), rows["n"].to_numpy()
    gram = bucket >= 0
    counts[bucket[gram], lang[gram]] = n[gram]
    scripts[-1 - bucket[~gram], lang[~gram]] = n[~gram]
    return Model(langs, counts, scripts)


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[Column] = ()) -> DataFrame:
    """(id, lang_pred, score) of every whole text, after the columns in `keep`. The model is BUCKETS x languages floats, so it may be broadcast."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    base = df.select(F.col(id_col).alias(id_col), *keep, F.col(text_col).alias("text"))
    kept = base.columns[:-1]

    def run(batches):
        for b in pieces(batches):
            names, scores = shared.value.predict(column(b, "text").to_pylist())
            yield pa.RecordBatch.from_arrays([column(b, c) for c in kept] + [pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*kept, "lang_pred", "score"])

    return base.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in base.dtypes[:-1]) + ", lang_pred string, score double")


def label_spans(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, spans array<struct<start, end, lang>>): the labelled runs of mixed-language texts."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches):
        for b in pieces(batches):
            out = shared.value.spans(column(b, "text").to_pylist())
            spans = pa.array([[{"start": s, "end": e, "lang": k} for s, e, k in x[2]] for x in out], kind)
            yield pa.RecordBatch.from_arrays([column(b, "id"), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64()), spans], names=["id", "lang_pred", "score", "spans"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>").withColumnRenamed("id", id_col)
