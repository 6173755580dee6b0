"""Pack whole documents into few windows by exact-complement hashing.

A document of up to a window of tokens stays whole; a longer one is cut into full windows from its end, so that its first
piece is the short one. How pieces share windows depends only on how many there are of each length, so the plan is made on
the histogram of lengths, which has at most ``window`` entries however large the corpus is:

1. The longest piece left opens a window. An index of the sums of one, two and three available lengths says whether its gap
   can be closed exactly; if not, the longest piece that fits joins and the index is asked again. A combination that closes
   the gap is consumed as often as the counts of its lengths allow, which uses up at least one of them. So the number of steps depends on the window alone.
2. Lengths for which no combination closes the gap are left to best fit, longest first, again many equal windows at a time. Plans that hold back short
   pieces for this step are made as well, and the one with the fewest windows is taken.

The plan is a list of (lengths, copies). Pieces get their rank by (length, id, start, checksum) over the whole table, made
per range partition, and the rank says which window of which pattern a piece takes and where it lies there. Nothing
but the histogram reaches the driver, and a length that a third of all pieces share is a run of ranks like any other.

Defined cases: null or empty text is the end token alone; equal pieces take places in any order; a repeated row is packed
again; a row with a null id is packed with a null id; an empty table gives an empty one; only the named columns are read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.functions.storage import saved
from sedge.llm.ranks import with_rank
from sedge.llm.segments import byte_token_ids
from sedge.llm.textarrays import slices

PIECE = "id long, piece int, start long, length long, ids_crc32 long"
Pattern = tuple[tuple[int, ...], int]


class SumIndex:
    """Which gaps one, two or three of the available lengths fill exactly, and with which.

    The sums of pairs and triples are bit sets, made anew when a length runs out; the counts decide about lengths used twice or thrice.
    """

    def __init__(self, counts: np.ndarray):
        self.counts, self.window = counts, len(counts) - 1
        self.seen = None

    def _renew(self) -> None:
        there = self.counts > 0
        if self.seen is not None and np.array_equal(there, self.seen):
            return
        self.seen = there
        mask = (1 << (self.window + 1)) - 1
        single = pairs = triples = 0
        lengths = np.flatnonzero(there).tolist()
        for n in lengths:
            single |= 1 << n
        for n in lengths:
            pairs |= (single << n) & mask
        for n in lengths:
            triples |= (pairs << n) & mask
        self.pairs, self.triples = pairs, triples

    def pair(self, gap: int, left: np.ndarray) -> tuple[int, int] | None:
        """The pair with the longest part, of lengths of which ``left`` are available."""
        if gap < 2 or not self.pairs >> gap & 1:
            return None
        a = np.arange(-(-gap // 2), gap)
        ok = (left[a] > 0) & (left[gap - a] > 0) & ((2 * a != gap) | (left[a] > 1))
        found = a[ok]
        return (int(found[-1]), gap - int(found[-1])) if len(found) else None

    def closing(self, gap: int, used: Counter) -> tuple[int, ...] | None:
        """One to three lengths that fill ``gap`` exactly, beside what ``used`` takes of the counts."""
        self._renew()
        left = self.counts.copy()
        for n, k in used.items():
            left[n] -= k
        if left[gap] > 0:
            return (gap,)
        if found := self.pair(gap, left):
            return found
        if gap > 2 and self.triples >> gap & 1:
            for a in np.flatnonzero(left[: gap - 1] > 0)[::-1].tolist():
                if 3 * a < gap:
                    break
                left[a] -= 1
                found = self.pair(gap - a, left)
                left[a] += 1
                if found:
                    return (a, *found)
        return None


def exact_windows(counts: np.ndarray) -> list[Pattern]:
    """Windows that are filled to the last token; their pieces are taken off ``counts``."""
    window, made, index = len(counts) - 1, [], SumIndex(counts)
    for n in range(window, 0, -1):
        while counts[n]:
            used, gap = Counter({n: 1}), window - n
            closed = gap == 0
            while gap:
                if more := index.closing(gap, used):
                    used.update(more)
                    closed = True
                    break
                fits = [k for k in np.flatnonzero(counts[: gap + 1])[::-1].tolist() if counts[k] > used[k]]
                if not fits:
                    break
                used[fits[0]] += 1
                gap -= fits[0]
            if not closed:
                break  # of this length; the rest goes to best fit
            copies = min(int(counts[k]) // m for k, m in used.items())
            for k, m in used.items():
                counts[k] -= copies * m
            made.append((tuple(sorted(used.elements(), reverse=True)), copies))
    return made


def best_fit_windows(counts: np.ndarray) -> list[Pattern]:
    """Best-fit decreasing for what is left, equal windows at a time."""
    window = len(counts) - 1
    room: dict[int, list[list]] = {}
    for n in range(window, 0, -1):
        while counts[n]:
            tight = min((r for r, held in room.items() if r >= n and held), default=None)
            lengths, copies = ((), int(counts[n])) if tight is None else room[tight].pop()
            free = window if tight is None else tight
            each = free // n
            several, one = divmod(int(counts[n]), each)
            take = min(copies, several) or 1
            fill = each if several else one
            if tight is not None and take < copies:
                room[tight].append([lengths, copies - take])
            counts[n] -= take * fill
            room.setdefault(free - fill * n, []).append([(*lengths, *[n] * fill), take])
    return [(tuple(lengths), copies) for held in room.values() for lengths, copies in held]


def plan_windows(histogram: dict[int, int], window: int) -> list[Pattern]:
    """Patterns (lengths, copies) that hold each piece once.

    Short pieces that exact combinations use up are missing where best fit has gaps to close. So plans are made with those below several lengths held
    back for best fit, and the one with the fewest windows is taken.
    """
    plans = []
    for least in (1, *(window >> i for i in range(6, 0, -1))):
        held = np.zeros(window + 1, np.int64)
        for n, k in histogram.items():
            held[n] = k
        counts = np.where(np.arange(window + 1) >= least, held, 0)
        held -= counts
        exact = exact_windows(counts)
        plans.append(exact + best_fit_windows(counts + held))
    return min(plans, key=lambda plan: sum(copies for _, copies in plan))


def places(plan: list[Pattern]) -> tuple[np.ndarray, ...]:
    """Rows (first rank, first window, pieces of that length per window, offset of the first, length) of the plan, by rank."""
    rows, base = [], 0
    for lengths, copies in plan:
        offset = 0
        for n, k in sorted(Counter(lengths).items(), reverse=True):
            rows.append((n, base, k, offset, copies * k))
            offset += n * k
        base += copies
    if not rows:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    table = np.array(sorted(rows), np.int64)
    first = np.cumsum(table[:, 4]) - table[:, 4]
    return first, table[:, 1], table[:, 2], table[:, 3], table[:, 0]


def cut_pieces(docs: DataFrame, vocabulary: str, *, id_col: str, text_col: str, window: int, end_id: int) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of whole texts."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4")
        for part in slices(batches):
            ids, at = byte_token_ids(part.column("text"), vocabulary)
            ids = ids.astype("<u4")
            rows = []
            for key, a, b in zip(part.column("id").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                whole = np.concatenate((ids[a:b], end))
                stop = len(whole) % window or window
                start = 0
                for i in range(-(-len(whole) // window)):
                    piece = whole[start:stop]
                    rows.append((key, i, start, len(piece), zlib.crc32(piece.tobytes())))
                    start, stop = stop, stop + window
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(cut, PIECE)


def pack_whole(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", window: int = 1024, end_id: int = 2) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = saved(cut_pieces(docs, vocabulary, id_col=id_col, text_col=text_col, window=window, end_id=end_id), "whole-pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``window`` rows
    first, base, each, offset, length = places(plan_windows(histogram, window))
    tied = pieces.withColumn("_tie", F.monotonically_increasing_id())
    ranked = with_rank(tied, [F.col(c) for c in ("length", "id", "start", "ids_crc32", "_tie")], "_rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rank = b.column("_rank").to_numpy() - 1
            slot = np.searchsorted(first, rank, side="right") - 1
            nth = rank - first[slot]
            sequence = base[slot] + nth // each[slot]
            at = offset[slot] + nth % each[slot] * length[slot]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("id", "piece", "start", "length", "ids_crc32")], pa.array(sequence), pa.array(at)], names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    out = ranked.drop("_tie").mapInArrow(place, PIECE + ", sequence_id long, offset long")
    return out
