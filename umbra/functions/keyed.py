"""Keyed and salted hashes, masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = {"upper": "X", "lower": "x", "digit": "n"}


def salted(col: str | Column, salt: str) -> Column:
    """SHA-256 of salt and value. Small domains fall to a dictionary: prefer `hmac`."""
    return F.sha2(F.concat(F.lit(salt), F.col(col) if isinstance(col, str) else col), 256)


def pads(key: bytes) -> tuple[str, str]:
    """Inner and outer pad of RFC 2104 for SHA-256, as hex."""
    import hashlib

    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex()


def hmac(col: str | Column, key: bytes) -> Column:
    """HMAC-SHA-256, natively. The padded key stands in the plan; see README."""
    inner, outer = pads(key)
    x = (F.col(col) if isinstance(col, str) else col).cast("string").cast("binary")
    return F.sha2(F.concat(F.unhex(F.lit(outer)), F.unhex(F.sha2(F.concat(F.unhex(F.lit(inner)), x), 256))), 256)


def mask_chars(col: str | Column, upper: str = "X", lower: str = "x", digit: str = "n", other: str | None = None) -> Column:
    return F.mask(F.col(col) if isinstance(col, str) else col, F.lit(upper), F.lit(lower), F.lit(digit), F.lit(other))


def keep_last(col: str | Column, n: int) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.concat(F.repeat(F.lit("*"), F.greatest(F.length(c) - n, F.lit(0))), F.right(c, F.lit(n)))
