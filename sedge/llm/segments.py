"""Tokens of texts by their segments: distinct segments are tokenised once, and a worker remembers about a million of them.

A segment is a piece of a text that the tokenizer treats on its own, whatever stands around it, so a text's tokens are those
of its segments in turn.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

from sedge.llm.packing import WordIds, tokenizer
from sedge.llm.textarrays import buffers, code_points
from sedge.llm.token_counts import NONE, Ranks, pretoken_starts, ranks


def pretokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, bounds of their byte-level pre-tokens)."""
    raw, _ = buffers(texts)
    points, at = code_points(texts)
    heads = np.flatnonzero((raw & 0xC0) != 0x80)
    return raw, np.append(heads[pretoken_starts(points, at)], len(raw)).astype(np.int64)


def merged_ids(data: np.ndarray, offsets: np.ndarray, table: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all byte sequences data[offsets[i] : offsets[i + 1]], how many each has): lowest-rank pairs merge in all sequences at once."""
    n = len(offsets) - 1
    counts = np.diff(offsets).astype(np.int64)
    symbols, owner = table.byte_ids[data], np.repeat(np.arange(n), counts)
    live = counts[owner] > 1
    done = [(symbols[~live], owner[~live])]
    symbols, owner = symbols[live], owner[live]
    while len(symbols):
        same = owner[:-1] == owner[1:]
        rank = np.full(len(symbols), NONE)
        inside = np.flatnonzero(same)
        rank[inside] = table.of(symbols[inside], symbols[inside + 1])
        head = np.flatnonzero(np.concatenate(([True], ~same)))
        least = np.repeat(np.minimum.reduceat(rank, head), np.diff(np.append(head, len(symbols))))
        chosen = (rank == least) & (rank < NONE)
        # Of overlapping occurrences (the same symbol again and again) every second one counts, from the left.
        place = np.arange(len(symbols))
        begins = chosen & ~np.concatenate(([False], chosen[:-1] & same))
        chosen &= (place - np.maximum.accumulate(np.where(begins, place, 0))) % 2 == 0
        at = np.flatnonzero(chosen)
        symbols[at] = table.made[rank[at]]
        stays = np.ones(len(symbols), bool)
        stays[at + 1] = False
        counts -= np.bincount(owner[at], minlength=n)
        goes_on = stays & (least < NONE) & (counts[owner] > 1)
        ended = stays & ~goes_on
        done.append((symbols[ended], owner[ended]))
        symbols, owner = symbols[goes_on], owner[goes_on]
    ids, owners = (np.concatenate(x) for x in zip(*done, strict=True))
    return ids[np.argsort(owners, kind="stable")], counts


class ByteIds(WordIds):
    """Ids of byte-level pre-tokens."""

    def _add(self, words: list[bytes], low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
        bounds = np.concatenate(([0], np.cumsum([len(w) for w in words])))
        ids, counts = merged_ids(np.frombuffer(b"".join(words), np.uint8), bounds, ranks(self.path))
        return self._keep(counts, low, high, size, flat=ids)

    def _keep(self, counts: np.ndarray, low: np.ndarray, high: np.ndarray, size: np.ndarray, **more: np.ndarray) -> np.ndarray:
        first = len(self.start) - 1
        for name, values in more.items():
            old = getattr(self, name)
            setattr(self, name, np.concatenate((old, np.asarray(values, old.dtype))))
        self.start = np.concatenate((self.start, self.start[-1] + np.cumsum(counts)))
        self.low, self.high, self.size = np.concatenate((self.low, low)), np.concatenate((self.high, high)), np.concatenate((self.size, size))
        return np.arange(first, first + len(counts))

    def tokens_of(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the segments between ``bounds``: which they are, the places of all their tokens in ``flat``, first token of each segment (n + 1 entries)."""
        which = self.of(raw, bounds[:-1], np.diff(bounds))
        n = self.start[which + 1] - self.start[which]
        ends = np.cumsum(n)
        where = np.repeat(self.start[which] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)
        return which, where, np.concatenate(([0], ends))


@lru_cache(4)
def byte_ids(path: str) -> ByteIds:
    return ByteIds(path)


def byte_token_ids(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, offsets) by a byte-level BPE file. Texts that hold the string of an added token are encoded whole by the library."""
    raw, bounds = pretokens(texts)
    known = byte_ids(path)
    _, where, first = known.tokens_of(raw, bounds)
    ids, at = known.flat[where], first[np.searchsorted(bounds, buffers(texts)[1])]
    library = tokenizer(path)
    marks = [t.content.encode() for t in library.get_added_tokens_decoder().values()]
    data = raw.tobytes()
    if not any(m in data for m in marks):
        return ids, at
    parts = []
    for i, text in enumerate(texts.to_pylist()):
        marked = any(m in (text or "").encode() for m in marks)
        parts.append(np.array(library.encode(text, add_special_tokens=False).ids, np.uint32) if marked else ids[at[i] : at[i + 1]])
    return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
