r"""Personal data in text, natively (operator 6): regular expressions propose spans, checksums and
range checks confirm them, words just before a span adjust its score.

Base kinds (email, ip, card, phone) are kept whatever their score. Added kinds are kept from a score
of `KEEP`: IBANs that pass mod-97, social security numbers that a context word names, and secrets
assigned to a telling name. Base matches that fail because they run over several numbers written side
by side (a phone, then a card) are searched again inside: `phone_part` and `card_part` are the numbers
found there, so they never overlap a base span of their kind.

Offsets are code points, end exclusive. They come from splitting the text by the pattern: a match
begins where the gaps and matches before it end. Everything is linear in the text's length; patterns
begin at run borders (or where the last match ended) and repeat possessively, which matches the same
spans as the plain forms without rescanning long runs or deep recursion.

Defined cases: a null text counts as empty and has no spans; repeated rows are treated alike; extra
columns are dropped by `find_spans` and kept by `redact`; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEEP = 0.5
BLOCK = 256  # prefix sums are built by blocks of so many matches, so that no array is copied per match

#: The contract's kinds first, then the added ones.
BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn", "secret")
PARTS = ("card_part", "phone_part")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": r"""(?<![A-Za-z0-9])(?i:password|passwd|token|secret|api[_-]?key)\s{0,3}[=:]\s{0,3}["']?[A-Za-z0-9_\-]{8,}["']?""",
    "card_part": r"(?<![0-9])(?:[0-9]{16,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3})(?![0-9])",
    "phone_part": r"\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{2,4}\)|[0-9]{1,4})(?:[\x20.-]?[0-9]{2,4}){2,4}?(?![0-9])",
}
#: Words before a span that make its kind likelier. Fixed values.
CONTEXT = {
    "email": r"(?i)e-?mail|contact|write to|mailto",
    "ip": r"(?i)\bip\b|address|host|server|login",
    "card": r"(?i)card|visa|master|amex|payment|credit|debit",
    "phone": r"(?i)phone|tel|call|mobile|fax|contact",
    "iban": r"(?i)iban|account|bank|transfer",
    "ssn": r"(?i)ssn|social security|tax id",
    "secret": r"(?i)login|credential|config|auth",
}
#: Score without context; what a context word adds. Fixed values.
SCORE = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3, "secret": 0.7}
CONTEXT_SCORE, CONTEXT_CHARS = 0.2, 40
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}$"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _mod97(x: Column) -> Column:
    """ISO 7064: the first four characters moved to the end, letters as 10 to 35, modulo 97."""
    compact = F.regexp_replace(x, " ", "")
    code = F.ascii(F.lit("A"))
    chars = F.split(F.concat(F.substr(compact, F.lit(5)), F.substr(compact, F.lit(1), F.lit(4))), "")
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - code + 10)
    step = lambda acc, c: F.when(c == "", acc).when(c.rlike("[0-9]"), (acc * 10 + value(c)) % 97).otherwise((acc * 100 + value(c)) % 97)
    return F.aggregate(chars, F.lit(0), step)


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return x.rlike(OCTETS)
    if kind in ("card", "card_part"):
        return F.length(_digits(x)).between(16, 19) & F.call_function("luhn_check", _digits(x))
    if kind in ("phone", "phone_part"):
        return F.length(_digits(x)).between(8, 15)
    if kind == "iban":
        return _mod97(x) == 1
    return F.lit(True)


def _split_again(kind: str, x: Column) -> Column:
    """Whether a match of a base kind fails for its length, so that it may run over several numbers."""
    return ~_valid(kind, x) & (F.length(_digits(x)) > (16 if kind == "card" else 15))


def _prefix(sizes: Column) -> Column:
    """Exclusive prefix sums of an int array, by blocks."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / BLOCK).cast("int")), lambda b: F.slice(sizes, b * BLOCK + 1, BLOCK))
    zero = F.lit(0)
    def running(values: Column, start: Column) -> Column:
        acc = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(values, acc, lambda a, v: F.struct((a["at"] + v).alias("at"), F.array_append(a["out"], a["at"]).alias("out")), lambda a: a["out"])
    total = lambda x: F.aggregate(x, zero, lambda a, v: a + v)
    starts = running(F.transform(blocks, total), zero)
    return F.flatten(F.zip_with(blocks, starts, running))


def _found(df: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Columns m_<kind> (matches) and g_<kind> (the gaps around them, one more)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = df.withColumns({f"m_{k}": F.regexp_extract_all(text, F.lit(PATTERNS[k]), F.lit(0)) for k in kinds})
    return df.withColumns({f"g_{k}": F.when(F.size(f"m_{k}") > 0, F.split(text, PATTERNS[k], -1)) for k in kinds})


def find_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct<kind, start, end, score>>): base kinds in the listed order, then added ones, each by start."""
    kinds = BASE + ADDED
    df = _found(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), kinds)

    empty = F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")

    def span(kind: str, base: str, start: Column, match: Column, gap: Column) -> Column:
        score = F.lit(SCORE[base]) + F.when(F.right(gap, F.lit(CONTEXT_CHARS)).rlike(CONTEXT[base]), CONTEXT_SCORE).otherwise(0.0)
        return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(match)).alias("end"), F.round(score, 3).alias("score"))

    def placed(gaps: Column, matches: Column) -> Column:
        """(at: where the gap begins, gap, match) of each match."""
        gaps = F.slice(gaps, 1, F.size(matches))
        return F.arrays_zip(_prefix(F.zip_with(gaps, matches, lambda a, b: F.length(a) + F.length(b))).alias("at"), gaps.alias("gap"), matches.alias("match"))

    def spans(k: str) -> Column:
        m = F.col(f"m_{k}")
        each = F.transform(F.filter(placed(F.col(f"g_{k}"), m), lambda x: _valid(k, x["match"])), lambda x: span(k, k, x["at"] + F.length(x["gap"]), x["match"], x["gap"]))
        if k in ADDED:
            each = F.filter(each, lambda x: x["score"] >= KEEP)
        return F.when(F.size(m) > 0, each).otherwise(empty)

    def parts(k: str) -> Column:
        """Numbers inside the base matches that fail for their length."""
        base, m = k.removesuffix("_part"), F.col(f"m_{k.removesuffix('_part')}")

        def inside(x: Column) -> Column:
            found = F.regexp_extract_all(x["match"], F.lit(PATTERNS[k]), F.lit(0))
            good = F.filter(placed(F.split(x["match"], PATTERNS[k], -1), found), lambda y: _valid(k, y["match"]))
            start = lambda y: x["at"] + F.length(x["gap"]) + y["at"] + F.length(y["gap"])
            return F.when(F.size(found) > 0, F.transform(good, lambda y: span(k, base, start(y), y["match"], F.concat(x["gap"], y["gap"])))).otherwise(empty)

        again = F.filter(placed(F.col(f"g_{base}"), m), lambda x: _split_again(base, x["match"]))
        return F.when(F.exists(m, lambda x: _split_again(base, x)), F.flatten(F.transform(again, inside))).otherwise(empty)

    return df.select(F.col("id").alias(id_col), F.concat(*[spans(k) for k in kinds], *[parts(k) for k in PARTS]).alias("spans"))


def _joined(gaps: Column, shown: Column) -> Column:
    """Gaps and what is shown between them, as one text."""
    return F.array_join(F.flatten(F.zip_with(gaps, F.array_append(shown, F.lit("")), lambda a, b: F.array(a, b))), "")


def _shown(kind: str, gap: Column, x: Column) -> Column:
    """What stands for a match: its kind if confirmed (with its context, where the kind needs that), else the match itself."""
    label, part = F.lit(f"[{kind.upper()}]"), f"{kind}_part"
    sure = _valid(kind, x)
    if SCORE[kind] < KEEP:
        sure &= F.right(gap, F.lit(CONTEXT_CHARS)).rlike(CONTEXT[kind])
    if part not in PARTS:
        return F.when(sure, label).otherwise(x)
    inner = F.transform(F.regexp_extract_all(x, F.lit(PATTERNS[part]), F.lit(0)), lambda y: F.when(_valid(part, y), label).otherwise(y))
    return F.when(sure, label).when(_split_again(kind, x), _joined(F.split(x, PATTERNS[part], -1), inner)).otherwise(x)


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Every confirmed span of the text replaced by its kind in brackets; null texts stay null; all columns stay.

    Kind by kind, so that numbers freed by an earlier kind are found by a later one; phones are searched
    again after the addresses and cards that they ran into.
    """
    others = [c for c in df.columns if c != text_col]
    out = df.select(F.struct(F.lit(0).alias("0"), *[F.col(f"`{c}`").alias(str(i + 1)) for i, c in enumerate(others)]).alias("others"), F.col(f"`{text_col}`").alias("text"))
    for k in ("email", "phone", "ip", "card", "phone", "iban", "ssn", "secret"):
        found = _found(out, (k,))
        m, g = F.col(f"m_{k}"), F.col(f"g_{k}")
        new = _joined(g, F.zip_with(F.slice(g, 1, F.size(m)), m, lambda a, b: _shown(k, a, b)))  # noqa: B023
        out = found.select("others", F.when(F.size(m) > 0, new).otherwise(F.col("text")).alias("text"))
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col("others").getField(str(others.index(c) + 1)).alias(c) for c in df.columns])


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts by base kind, the digest of the base spans, all spans as a string, and their scores in the same order."""
    say = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    joined = lambda x: F.array_join(F.transform(x, say), ",")
    spans = F.col("spans")
    of = lambda k: F.size(F.filter(spans, lambda x: x["kind"] == k)).cast("long")
    count = {f"n_{k}": of(k) for k in BASE}
    base = F.filter(spans, lambda x: x["kind"].isin(*BASE))
    return find_spans(df, id_col, text_col).select(id_col, *[c.alias(n) for n, c in count.items()], F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"), F.array_join(F.transform(spans, lambda x: x["score"].cast("string")), ",").alias("scores"))
