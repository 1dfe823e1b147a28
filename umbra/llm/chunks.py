"""Texts as chunks that a tokenizer treats one by one: each distinct chunk is computed once and kept while it is frequent."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def expand(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indices of the slices that begin at `first` and are `size` long, one slice after the other."""
    before = np.cumsum(size) - size
    return np.repeat(first - before, size) + np.arange(int(size.sum()))


def sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The sum of each of the successive slices, which may be empty."""
    total = np.append(0, np.cumsum(values))
    ends = np.cumsum(lengths)
    return total[ends] - total[ends - lengths]


class Ragged:
    """Rows of numbers of different lengths, appended in batches."""

    def __init__(self, kind=np.int32):
        self.kind = kind
        self.clear()

    def clear(self) -> None:
        self.parts, self.sizes = [np.zeros(0, self.kind)], [np.zeros(0, np.int64)]

    def add(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self.parts.append(values.astype(self.kind, copy=False))
        self.sizes.append(sizes)

    def flat(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All values, where each row begins, and its length."""
        values, size = np.concatenate(self.parts), np.concatenate(self.sizes)
        self.parts, self.sizes = [values], [size]
        return values, np.cumsum(size) - size, size

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of these rows, one after the other, and the rows' lengths."""
        values, first, size = self.flat()
        return values[expand(first[at], size[at])], size[at]


class Chunks(dict):
    """Numbers each new chunk; beyond `most` chunks the rarer half is forgotten (bounds memory, not results)."""

    def __init__(self, most: int):
        self.most, self.new, self.uses = most, [], np.zeros(0, np.int64)

    def __missing__(self, chunk: str) -> int:
        self.new.append(chunk)
        self[chunk] = at = len(self)
        return at

    def number(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Numbers of all texts' chunks, how many each text has, and the chunks that are new."""
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        at = np.fromiter(map(self.__getitem__, chain.from_iterable(texts)), np.int64, int(size.sum()))
        new, self.new = self.new, []
        self._count(at)
        return at, size, new

    def number_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """As number(), of a column of lists of strings without nulls: each distinct one of the column is looked up once."""
        own = column.flatten().dictionary_encode()
        distinct = own.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = np.fromiter(map(self.__getitem__, distinct), np.int64, len(distinct))
        at = found[np.asarray(own.indices)]
        new, self.new = self.new, []
        self._count(at)
        return at, np.diff(np.asarray(column.offsets)).astype(np.int64), new

    def _count(self, at: np.ndarray) -> None:
        uses = np.bincount(at, minlength=len(self))
        uses[: len(self.uses)] += self.uses
        self.uses = uses

    def shrink(self) -> np.ndarray | None:
        """To be called between blocks: the old numbers of the chunks that are kept, in their new order; None if all are."""
        if len(self) <= self.most:
            return None
        kept = np.sort(np.argsort(-self.uses, kind="stable")[: self.most // 2])
        keep = np.zeros(len(self), bool)
        keep[kept] = True
        chunks = [c for c, k in zip(self, keep.tolist(), strict=True) if k]  # a dict lists its keys by their number
        self.clear()
        self.update(zip(chunks, range(len(chunks)), strict=True))
        self.uses = self.uses[kept] // 2
        return kept
