"""Format-preserving encryption: FF1 of NIST SP 800-38G, natively, with Spark's own AES."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = "0123456789"
#: Half of a value is a number below this: products of two such residues fit a decimal of 38 digits.
HALF = 10**18
#: The least number of values of one length, below which encryption protects nothing.
DOMAIN = 1_000_000
ROUNDS = 10


def _halves(n: int) -> tuple[int, int]:
    return n // 2, n - n // 2


def _number_bytes(n: int, radix: int) -> int:
    """How many bytes the standard gives the number of a half of n // 2 or more numerals."""
    return math.ceil(math.ceil(_halves(n)[1] * math.log2(radix)) / 8)


class FF1:
    """Encrypts the numerals of a string, those characters that the alphabet holds, and leaves the others in their places.

    Values with too few numerals (fewer than DOMAIN possible ones) or too many (a half of HALF possible ones or more) become null,
    and so do nulls. Equal values with one key and tweak give equal results; there is no Python worker. The key stands in
    the plan, as that of `keyed.hmac` does.
    """

    def __init__(self, key: bytes, tweak: bytes = b"", alphabet: str = DIGITS):
        if len(key) not in (16, 24, 32):
            raise ValueError("the key has 16, 24 or 32 bytes")
        if len(set(alphabet)) != len(alphabet) or len(alphabet) < 2:
            raise ValueError("the alphabet has two letters or more, each once")
        self.key, self.tweak, self.alphabet = key, tweak, alphabet
        radix = len(alphabet)
        self.least = next(n for n in range(2, 64) if radix**n >= DOMAIN)
        self.most = max(n for n in range(2, 256) if radix ** _halves(n)[1] <= HALF)

    def encrypt(self, col: str | Column) -> Column:
        return self._replace(F.col(col) if isinstance(col, str) else col, range(ROUNDS), False)

    def decrypt(self, col: str | Column) -> Column:
        return self._replace(F.col(col) if isinstance(col, str) else col, reversed(range(ROUNDS)), True)

    def _replace(self, col: Column, rounds, back: bool) -> Column:
        rounds = list(rounds)
        inside = lambda c: F.instr(F.lit(self.alphabet), c) > 0

        def put(chars: Column, own: Column) -> Column:
            """The k-th numeral goes where the k-th numeral was."""
            places = F.filter(F.sequence(F.lit(0), F.size(chars) - 1), lambda i: inside(F.get(chars, i)))
            at = lambda places, i: (F.array_position(places, i) - 1).cast("int")
            swap = lambda new, places: F.transform(chars, lambda c, i: F.when(inside(c), F.get(new, at(places, i))).otherwise(c))
            return F.array_join(_let(self._cipher(own, rounds, back), lambda new: _let(places, lambda places: swap(new, places))), "")

        chars = F.filter(F.split(col, ""), lambda c: c != "")
        fits = lambda own: F.size(own).between(self.least, self.most)
        return _let(chars, lambda chars: _let(F.filter(chars, inside), lambda own: F.when(fits(own), put(chars, own))))

    def _by_length(self, values: list, kind: str, n: Column) -> Column:
        """A constant that depends on the number of numerals."""
        return F.get(F.array(*[F.lit(v).cast(kind) for v in values]), n - self.least)

    def _cipher(self, numerals: Column, rounds: list[int], back: bool) -> Column:
        """The numerals after the rounds; what depends on their number alone is looked up once a value."""
        radix, lengths = len(self.alphabet), range(self.least, self.most + 1)
        width = [_number_bytes(k, radix) for k in lengths]
        head = [bytes([1, 2, 1, *radix.to_bytes(3, "big"), 10, _halves(k)[0] % 256, *k.to_bytes(4, "big"), *len(self.tweak).to_bytes(4, "big")]) for k in lengths]
        # P, the tweak and the zeros before the round's number, by length.
        fixed = [(p + self.tweak + bytes((-len(self.tweak) - b - 1) % 16)).hex() for p, b in zip(head, width, strict=True)]
        by_length = {
            "first": ("string", fixed), "count": ("int", width),
            "blocks": ("int", [(len(f) // 2 + 1 + b) // 16 for f, b in zip(fixed, width, strict=True)]),
            "taken": ("int", [4 * math.ceil(b / 4) + 4 for b in width]),  # 4 to 12 bytes: one AES block
        } | {f"size_{h}": ("decimal(19,0)", [radix ** _halves(k)[i] for k in lengths]) for i, h in enumerate("uv")}
        n = F.size(numerals)
        own = F.struct(n.alias("n"), F.floor(n / 2).cast("int").alias("u"), *[self._by_length(v, kind, n).alias(k) for k, (kind, v) in by_length.items()])
        return _let(own, lambda own: self._rounds(numerals, own, rounds, back))

    def _rounds(self, numerals: Column, own: Column, rounds: list[int], back: bool) -> Column:
        radix = len(self.alphabet)
        digit = lambda c: F.instr(F.lit(self.alphabet), c) - 1
        number = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda a, c: a * radix + digit(c))
        n, u, size_u, size_v, count = own["n"], own["u"], own["size_u"], own["size_v"], own["count"]
        v = n - u

        def draw(half: Column, i: Column, size: Column) -> Column:
            """The round's number, modulo `size`."""
            text = F.concat(own["first"], F.lpad(F.hex(i), 2, "0"), F.lpad(F.hex(half.cast("long")), 2 * count, F.lit("0")))
            sealed = F.aes_encrypt(F.unhex(text), F.unhex(F.lit(self.key.hex())), F.lit("CBC"), F.lit("DEFAULT"), F.unhex(F.lit("00" * 16)))
            block = F.substr(sealed, 16 * own["blocks"] + 1, own["taken"])  # the vector comes first, so this is the last block but the padding's
            word = lambda block, k: F.conv(F.hex(F.substr(block, 4 * k + 1, F.lit(4))), 16, 10).cast("decimal(19,0)")
            words = _let(block, lambda block: F.transform(F.sequence(F.lit(0), (own["taken"] / 4).cast("int") - 1), lambda k: word(block, k)))
            return F.aggregate(words, F.lit(0).cast("decimal(38,0)"), lambda a, w: ((a * F.lit(2**32).cast("decimal(10,0)") + w) % size).cast("decimal(38,0)"))

        whole = lambda x: x.cast("decimal(38,0)")

        def step(state: Column, i: Column) -> Column:
            size = F.when(i % 2 == 0, size_u).otherwise(size_v)
            a, b = state["a"], state["b"]
            if back:
                return F.struct(whole(F.pmod(b - draw(a, i, size), size)).alias("a"), a.alias("b"))
            return F.struct(b.alias("a"), whole((a + draw(b, i, size)) % size).alias("b"))

        start = F.struct(whole(number(F.slice(numerals, 1, u))).alias("a"), whole(number(F.slice(numerals, u + 1, v))).alias("b"))

        def spelled(x: Column, m: Column) -> Column:
            """m numerals of a number, the last one first peeled off."""
            empty = F.struct(x.cast("long").alias("x"), F.array().cast("array<string>").alias("s"))
            peel = lambda a, _: F.struct(F.call_function("div", a["x"], F.lit(radix)).alias("x"), F.array_prepend(a["s"], F.substr(F.lit(self.alphabet), (a["x"] % radix).cast("int") + 1, F.lit(1))).alias("s"))
            return F.aggregate(F.sequence(F.lit(1), m), empty, peel, lambda a: a["s"])

        end = F.aggregate(F.array(*map(F.lit, rounds)), start, step)
        return _let(end, lambda e: F.concat(spelled(e["a"], u), spelled(e["b"], v)))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where `value` is computed once, however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
