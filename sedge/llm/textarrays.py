"""Arrow text columns as flat numpy arrays: words, hashes and pre-tokens of many texts at once.

All functions work on a slice of an Arrow batch that holds a bounded number of bytes (one text may exceed the bound;
texts are never cut), so memory in a Python worker does not grow with the input.
"""

from __future__ import annotations

import ctypes
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_MULT = np.uint64(0x9E3779B97F4A7C15)
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches by rows so that each piece has about ``limit`` bytes of text."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = np.diff(buffers(batch.column(text))[1])
        group = (np.cumsum(sizes) - sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)
    give_back()


def give_back() -> None:
    """Return freed memory to the system at the end of a task: workers are used again, and what one task freed is not what the next needs."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if len(texts) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, at - at[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, element by element."""
    x = x.astype(np.uint64, copy=True)
    for shift, mult in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(mult)
    x ^= x >> np.uint64(31)
    return x


@cache
def powers(n: int) -> np.ndarray:
    out = np.full(n, _MULT, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


@cache
def _symbol_hash(n: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * _MULT)


def run_hashes(symbols: np.ndarray, start: np.ndarray, length: np.ndarray, at_most: int | None = None) -> np.ndarray:
    """64-bit hash of each run symbols[start : start + length] (of its first ``at_most`` symbols)."""
    if len(start) == 0:
        return np.empty(0, np.uint64)
    if at_most is not None:
        length = np.minimum(length, at_most)
    total = int(length.sum())
    first = np.cumsum(length) - length
    pos = np.arange(total) - np.repeat(first, length)
    where = np.repeat(start, length) + pos
    terms = _symbol_hash(256 if symbols.dtype == np.uint8 else 0x110000)[symbols[where]]
    longest = int(length.max())
    terms *= powers(1 << max(10, longest.bit_length()))[pos]
    return mixed(np.add.reduceat(terms, first))


def runs_of(flag: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the maximal runs of True in ``flag`` that do not cross the positions in ``breaks``."""
    n = len(flag)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[breaks] = True
    before = np.concatenate(([False], flag[:-1]))
    starts = np.flatnonzero(flag & (~before | edge[:-1]))
    after = np.concatenate((flag[1:], [False]))
    ends = np.flatnonzero(flag & (~after | edge[1:])) + 1
    return starts, ends - starts


def ascii_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, and each text's first word's index (n + 1 entries)."""
    raw, at = buffers(texts)
    upper = (raw >= 65) & (raw <= 90)
    raw = raw + (upper.astype(np.uint8) << 5)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    start, length = runs_of(~blank, at)
    return run_hashes(raw, start, length), np.searchsorted(start, at)


@cache
def char_class() -> np.ndarray:
    """Class of each code point: letter, number, white space, other."""
    kinds = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            kinds[c] = LETTER
        elif k == "N":
            kinds[c] = NUMBER
    blanks = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    kinds[blanks] = SPACE
    return kinds


@cache
def lower_table() -> np.ndarray:
    """Lower-case code point of each code point (itself where that is longer than one character)."""
    out = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    for c in range(sys.maxunicode + 1):
        low = chr(c).lower() if not 0xD800 <= c < 0xE000 else ""
        if len(low) == 1:
            out[c] = ord(low)
    return out


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets) of a string column."""
    raw, at = buffers(texts)
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    heads = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    return points, heads[at]


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of letters and digits) and marks (runs of other characters), lower-cased.

    Returns (code points, start, length, index of each text's first token).
    """
    points, at = code_points(texts)
    kind = char_class()[points]
    word = kind <= NUMBER
    starts, lengths = [], []
    for flag in (word, kind == OTHER):
        s, n = runs_of(flag, at)
        starts.append(s)
        lengths.append(n)
    start, length = np.concatenate(starts), np.concatenate(lengths)
    order = np.argsort(start, kind="stable")
    start, length = start[order], length[order]
    return lower_table()[points], start, length, np.searchsorted(start, at)
