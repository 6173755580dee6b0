"""Token counts of a byte-level BPE vocabulary by rank-synchronous array merging.

A slice of texts becomes flat numpy arrays: code points are classed and cut into pre-tokens by comparing neighbours,
distinct pre-tokens become ragged arrays of byte symbols, and in each round every sequence merges all occurrences of its
lowest-rank pair at once. A sequence is done when no pair of it has a rank; its surviving symbols are its tokens. A special
token's string inside a text is one token and cuts the text, as the library has it by default.

Defined cases: null counts as empty; an empty text has 0 tokens; texts of any length are counted whole, slice by slice;
rows are independent, so repeated rows and ties need no rule; an empty table gives an empty one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.llm.textarrays import LETTER, SPACE, buffers, char_class, code_points, slices

NONE = np.int64(1 << 40)
#: The endings that the pre-token pattern cuts off after an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


class Ranks:
    """Merge ranks of a byte-level BPE file (``tokenizers`` JSON) as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {b: chr(b) for b in printable}
        shown |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
        self.byte_ids = np.array([vocab[shown[b]] for b in range(256)], np.int64)
        self.size = np.int64(max(vocab.values()) + 1)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * int(self.size) + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys)
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.special = [t["content"] for t in spec.get("added_tokens", []) if t.get("special")]

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], NONE)


@lru_cache(4)
def ranks(path: str) -> Ranks:
    return Ranks(path)


def pretoken_starts(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """First code point of each pre-token; ``at`` holds the texts' offsets."""
    n = len(points)
    if n == 0:
        return np.empty(0, np.int64)
    kind = char_class()[points]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    first, last = edge[:-1], edge[1:]
    before = np.concatenate(([SPACE + 9], kind[:-1]))
    after = np.concatenate((kind[1:], [SPACE + 9]))
    blank = kind == SPACE
    after_space = np.concatenate(([False], points[:-1] == 32)) & ~first
    start = first | (kind != before)
    start &= blank | ~after_space  # a single blank belongs to what follows
    start |= blank & ~last & (after != SPACE)  # a run's last blank leaves the run
    mark = np.flatnonzero((points == 39) & start & ~last & (after == LETTER))
    if len(mark):
        ends = np.repeat(at[1:], np.diff(at))[mark]
        used = np.zeros(len(mark), np.int64)
        for ending in ENDINGS:
            hit = (used == 0) & (mark + len(ending) < ends)
            for i, c in enumerate(ending, 1):
                hit &= points[np.minimum(mark + i, n - 1)] == ord(c)
            used[hit] = len(ending)
        mark, used, ends = mark[used > 0], used[used > 0], ends[used > 0]
        start[mark + 1] = False
        beyond = mark + 1 + used
        start[beyond[beyond < ends]] = True
    return np.flatnonzero(start)


def merged_lengths(data: np.ndarray, offsets: np.ndarray, table: Ranks) -> np.ndarray:
    """Number of symbols that survive in each byte sequence data[offsets[i] : offsets[i + 1]]."""
    n = len(offsets) - 1
    counts = np.diff(offsets).astype(np.int64)
    symbols = table.byte_ids[data]
    owner = np.repeat(np.arange(n), counts)
    live = counts[owner] > 1
    symbols, owner = symbols[live], owner[live]
    while len(symbols):
        same = owner[:-1] == owner[1:]
        rank = np.full(len(symbols), NONE)
        where = np.flatnonzero(same)
        rank[where] = table.of(symbols[where], symbols[where + 1])
        head = np.flatnonzero(np.concatenate(([True], ~same)))
        sizes = np.diff(np.append(head, len(symbols)))
        best = np.minimum.reduceat(rank, head)
        chosen = (rank == np.repeat(best, sizes)) & (rank < NONE)
        # Of overlapping occurrences (the same symbol again and again) every second one counts, from the left.
        begins = chosen & ~np.concatenate(([False], chosen[:-1] & same))
        place = np.arange(len(symbols))
        run_start = np.maximum.accumulate(np.where(begins, place, 0))
        chosen &= (place - run_start) % 2 == 0
        at = np.flatnonzero(chosen)
        symbols[at] = table.made[rank[at]]
        stays = np.ones(len(symbols), bool)
        stays[at + 1] = False
        counts -= np.bincount(owner[at], minlength=n)
        stays &= np.repeat(best < NONE, sizes) & (counts[owner] > 1)
        symbols, owner = symbols[stays], owner[stays]
    return counts


def count_tokens(texts: pa.Array, table: Ranks) -> np.ndarray:
    """Tokens of each text."""
    extra = np.zeros(len(texts), np.int64)
    owner = None
    raw = buffers(texts)[0].tobytes() if table.special else b""
    if any(s.encode() in raw for s in table.special):
        pieces, owner = [], []
        for i, text in enumerate(texts.to_pylist()):
            parts = [text or ""]
            for s in table.special:
                parts = [p for part in parts for p in part.split(s)]
            extra[i] = len(parts) - 1
            pieces += parts
            owner += [i] * len(parts)
        owner, whole = np.array(owner), texts
        texts = pa.array(pieces, pa.large_string())
    raw, _ = buffers(texts)
    points, at = code_points(texts)
    start = pretoken_starts(points, at)
    heads = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
    offsets = np.append(heads[start], len(raw)).astype(np.int64)
    if len(start):
        words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()
        data, ends = buffers_of_binary(words.dictionary)
        each = merged_lengths(data, ends, table)[words.indices.to_numpy()]
    else:
        each = np.empty(0, np.int64)
    total = np.concatenate(([0], np.cumsum(each)))
    cut = np.searchsorted(start, at)
    sums = total[cut[1:]] - total[cut[:-1]]
    if owner is None:
        return sums
    return extra + np.bincount(owner, weights=sums, minlength=len(whole)).astype(np.int64)


def buffers_of_binary(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def token_counts(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_bytes (UTF-8), n_tokens. ``vocabulary`` is a path that every executor can open."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ranks(vocabulary)
        for part in slices(batches):
            texts = part.column("text")
            n_bytes = np.diff(buffers(texts)[1])
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n_bytes, pa.int64()), pa.array(count_tokens(texts, table), pa.int64())], names=["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(count, "id long, n_bytes long, n_tokens long")


