"""Pack token sequences into windows of fixed capacity by best-fit decreasing.

Each document is tokenised whole and cut into full windows and a rest. Only (id, start, length, checksum) of the pieces
go on; a hash deals them into groups of about ``group_size`` pieces, so one task packs a bounded number however large the
input is, and long documents or repeated rows do not meet in one group. In a group pieces come in decreasing length, and a
segment tree over remaining capacities finds the tightest open window. Pieces are written to the shared folder first, so
tokenising is not repeated when an executor is lost.

Defined cases: null or empty text is the end token alone; a document of exactly k windows has no rest; equal lengths are
ordered by (id, start, checksum); a repeated row is packed again; an empty table gives an empty one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.functions.storage import saved
from sedge.llm.textarrays import buffers, runs_of, slices

PIECE = "id long, start long, length long, ids_crc32 long, doc_tokens long"


@lru_cache(4)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words between ASCII blanks: (bytes, start, length, index of each text's first word (n + 1 entries)).

    A-Z is lower-cased and the ASCII marks that end a word after an ASCII letter are a word of their own: the vocabulary's own
    normaliser and pre-tokeniser do the same, and far fewer distinct words are left. Texts with the mark of a special token stay as they are.
    """
    raw, at = buffers(texts)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    breaks = at
    if b"<|" not in raw.tobytes():
        raw = raw + (((raw >= 65) & (raw <= 90)).astype(np.uint8) << 5)
        letter = (raw >= 97) & (raw <= 122)
        mark = (raw > 32) & (raw < 127) & ~letter & ~((raw >= 48) & (raw <= 57))
        first = np.flatnonzero(mark[1:] & letter[:-1]) + 1
        other = np.append(np.flatnonzero(~mark), len(raw))
        after = other[np.searchsorted(other, first)]  # where the run of marks that starts here ends
        text_end = at[np.searchsorted(at, first, side="right")]
        breaks = np.union1d(at, first[(after >= text_end) | np.append(blank, True)[after]])
    start, length = runs_of(~blank, breaks)
    return raw, start, length, np.searchsorted(start, at)


#: Words of at most so many bytes are compared as two 64-bit numbers.
SHORT = 16
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xBF58476D1CE4E5B9], np.uint64)


class WordIds:
    """Token ids of words by the library, remembered in the worker for at most about ``limit`` words.

    Short words lie in an open-addressed table of numpy arrays that holds their very bytes, so a whole slice is looked up at once;
    longer ones, which are few, in a dictionary.
    """

    def __init__(self, path: str, limit: int = 1_000_000):
        self.path, self.limit = path, limit
        self.bits = (4 * limit).bit_length()
        self.clear()

    def clear(self) -> None:
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.low, self.high, self.size = np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64)
        self.long: dict[bytes, int] = {}
        self.flat, self.start = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def _slot(self, low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
        h = low * _MIX[0] ^ (high * _MIX[1] + size.astype(np.uint64) * _MIX[2])
        h = (h ^ (h >> np.uint64(29))) * _MIX[3]
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Index of each word, -1 where it is not known."""
        out = np.full(len(low), -1, np.int64)
        slot, open_ = self._slot(low, high, size), np.arange(len(low))
        while len(open_):
            there = self.slots[slot].astype(np.int64)
            held = there >= 0
            open_, slot, there = open_[held], slot[held], there[held]
            same = (self.low[there] == low[open_]) & (self.high[there] == high[open_]) & (self.size[there] == size[open_])
            out[open_[same]] = there[same]
            open_, slot = open_[~same], (slot[~same] + 1) & (len(self.slots) - 1)
        return out

    def _insert(self, index: np.ndarray) -> None:
        slot = self._slot(self.low[index], self.high[index], self.size[index])
        while len(index):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = index[free]
            placed = self.slots[slot] == index
            index, slot = index[~placed], (slot[~placed] + 1) & (len(self.slots) - 1)

    def _add(self, words: list[bytes], low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
        first = len(self.start) - 1
        lists = [e.ids for e in tokenizer(self.path).encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]
        n = np.array([len(x) for x in lists], np.int64)
        self.flat = np.concatenate((self.flat, np.fromiter((i for x in lists for i in x), np.uint32, int(n.sum()))))
        self.start = np.concatenate((self.start, self.start[-1] + np.cumsum(n)))
        self.low, self.high, self.size = np.concatenate((self.low, low)), np.concatenate((self.high, high)), np.concatenate((self.size, size))
        return np.arange(first, first + len(words))

    def of(self, raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Index of each word raw[start : start + length] in the bounds ``start`` of ``flat``."""
        if len(self.start) > self.limit:
            self.clear()
        padded = np.concatenate((raw, np.zeros(SHORT, np.uint8)))
        eights = np.ndarray(len(raw) + 9, "<u8", padded, strides=(1,))
        low = eights[start] & _MASKS[np.minimum(length, 8)]
        high = eights[start + 8] & _MASKS[np.clip(length - 8, 0, 8)]
        out = self._find(low, high, length)
        wide = length > SHORT
        out[wide] = -1
        new = np.flatnonzero((out < 0) & ~wide)
        if len(new):
            order = new[np.lexsort((length[new], high[new], low[new]))]
            differs = np.ones(len(order), bool)
            differs[1:] = (low[order[1:]] != low[order[:-1]]) | (high[order[1:]] != high[order[:-1]]) | (length[order[1:]] != length[order[:-1]])
            one = order[differs]
            words = [raw[a : a + n].tobytes() for a, n in zip(start[one].tolist(), length[one].tolist(), strict=True)]
            made = self._add(words, low[one], high[one], length[one])
            self._insert(made)
            out[order] = made[np.cumsum(differs) - 1]
        wide = np.flatnonzero(wide)
        if len(wide):
            words = [raw[a : a + n].tobytes() for a, n in zip(start[wide].tolist(), length[wide].tolist(), strict=True)]
            unknown = list(dict.fromkeys(w for w in words if w not in self.long))
            if unknown:
                none = np.zeros(len(unknown), np.uint64)
                self.long.update(zip(unknown, self._add(unknown, none, none, none.astype(np.int64)).tolist(), strict=True))
            out[wide] = [self.long[w] for w in words]
        return out


@lru_cache(4)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def token_ids(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, offsets). The vocabulary must drop blanks, so that a text's ids are those of its words in turn."""
    raw, start, length, first = words_of(texts)
    if len(start) == 0:
        return np.empty(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
    known = word_ids(path)
    which = known.of(raw, start, length)
    from_ = known.start[which]
    n = known.start[which + 1] - from_
    ends = np.cumsum(n)
    ids = known.flat[np.repeat(from_ - (ends - n), n) + np.arange(int(ends[-1]))]
    return ids, np.concatenate(([0], ends))[first]


def cut_pieces(docs: DataFrame, vocabulary: str, *, id_col: str, text_col: str, window: int, end_id: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4")
        for part in slices(batches):
            ids, at = token_ids(part.column("text"), vocabulary)
            ids = ids.astype("<u4")
            rows = []
            for key, a, b in zip(part.column("id").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                whole = np.concatenate((ids[a:b], end))
                for s in range(0, len(whole), window):
                    piece = whole[s : s + window]
                    rows.append((key, s, len(piece), zlib.crc32(piece.tobytes()), len(whole)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["id", "start", "length", "ids_crc32", "doc_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(cut, PIECE)


class OpenWindows:
    """Segment tree over remaining capacities 0 .. window: each node says whether a window with such room is open."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.any = [0] * (2 * self.leaves)
        self.stacks: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, room: int, which: int) -> None:
        self.stacks[room].append(which)
        i = room + self.leaves
        while i:
            self.any[i] += 1
            i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """The open window with the least room that is at least ``least``: (room, window)."""
        i = least + self.leaves
        if not self.any[i]:
            while i > 1 and (i & 1 or not self.any[i + 1]):  # climb until something lies to the right
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.any[2 * i] else 2 * i + 1
        room = i - self.leaves
        which = self.stacks[room].pop()
        while i:
            self.any[i] -= 1
            i >>= 1
        return room, which


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(window number, offset in it) of pieces that come in decreasing length."""
    open_windows, made = OpenWindows(window), 0
    number, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, n in enumerate(lengths.tolist()):
        found = open_windows.take(n) if n < window else None
        if found is None:
            found = window, made
            made += 1
        room, which = found
        number[i], offset[i] = which, window - room
        if room > n:
            open_windows.add(room - n, which)
    return number, offset


def pack(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", window: int = 4096, end_id: int = 2, group_size: int = 50_000) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    pieces = saved(cut_pieces(docs, vocabulary, id_col=id_col, text_col=text_col, window=window, end_id=end_id), "pack-pieces")
    groups = max(1, -(-pieces.count() // group_size))

    def place(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "id", "start", "ids_crc32"], ascending=[False, True, True, True])
        number, offset = best_fit_decreasing(group["length"].to_numpy(), window)
        group["sequence_id"] = group["_group"].astype("int64") * (1 << 32) + number
        group["offset"] = offset
        return group.drop(columns="_group")

    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64("id", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("_group").applyInPandas(place, PIECE + ", sequence_id long, offset long")
