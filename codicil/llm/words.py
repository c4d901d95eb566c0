"""Words of a text, alike in Spark expressions and in Arrow tasks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANKS = r"[\x20\x09-\x0D]+"
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def text_of(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def word_array(text: Column) -> Column:
    """Words of a text column; empty for null."""
    return F.array_remove(F.split(text_of(text), BLANKS), "")


def word_count(text: Column) -> Column:
    return F.regexp_count(text_of(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


class Rolling:
    """Hashes of word spans by differences of a running polynomial sum modulo 2**64.

    ``which`` picks one of two independent multipliers.
    """

    def __init__(self, which: int = 0) -> None:
        self._base = np.uint64(_MULTIPLIERS[which])
        self._inverse = np.uint64(pow(_MULTIPLIERS[which], -1, 1 << 64))
        self._up = self._down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self._up) < n:
            n = max(n, 2 * len(self._up))
            self._up = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n - 1, self._base))), dtype=np.uint64)
            self._down = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n - 1, self._inverse))), dtype=np.uint64)

    def sums(self, codes: np.ndarray) -> np.ndarray:
        self._powers(len(codes) + 1)
        out = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * self._up[: len(codes)], out=out[1:])
        return out

    def spans(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of words[start:end] for each pair, equal for equal word sequences."""
        return mixed((sums[ends] - sums[starts]) * self._down[starts])

    def windows(self, sums: np.ndarray, width: int) -> np.ndarray:
        n = len(sums) - width
        return mixed((sums[width:] - sums[:-width]) * self._down[:n]) if n > 0 else np.empty(0, np.uint64)


def raw_texts(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each text; ``bytes.split()`` then gives exactly the words."""
    for text in column.cast(pa.binary()):
        yield text.as_py()


def _byte_codes(fold: bool) -> np.ndarray:
    table = np.random.default_rng(20_11).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    if fold:
        table[ord("A") : ord("Z") + 1] = table[ord("a") : ord("z") + 1]
    return table


_CODES = {fold: _byte_codes(fold) for fold in (False, True)}
_SOLID = np.ones(256, bool)
_SOLID[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_SLICE = 1 << 20


class Words:
    """Words of a column of texts without Python strings: a 64-bit code, and the text each stands in.

    ``fold`` reads A-Z as a-z. Equal words have equal codes.
    """

    def __init__(self, column: pa.Array, rolling: Rolling, fold: bool = False) -> None:
        column = column.cast(pa.binary())
        size = len(column)
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + size + 1].astype(np.int64)
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        solid = _SOLID[data]
        inner = np.zeros(len(data) + 1, bool)
        inner[1:-1] = solid[1:] & solid[:-1]
        inner[offsets] = False
        starts = np.flatnonzero(solid & ~inner[:-1])
        ends = np.flatnonzero(solid & ~inner[1:]) + 1
        self.text = np.searchsorted(offsets, starts, side="right") - 1
        self.codes = np.empty(len(starts), np.uint64)
        lo = 0
        while lo < len(starts):
            hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + _SLICE)))
            base = starts[lo]
            sums = rolling.sums(_CODES[fold][data[base : ends[hi - 1]]])
            self.codes[lo:hi] = rolling.spans(sums, starts[lo:hi] - base, ends[lo:hi] - base)
            lo = hi
        self.counts = np.bincount(self.text, minlength=size)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the least value, the leftmost among equals, in each run of ``width`` values."""
    best, done = np.arange(len(values)), 1
    while done < width and len(values) >= width:
        step = min(done, width - done)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(values[right] < values[left], right, left)
        done += step
    return best if len(values) >= width else best[:0]


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
