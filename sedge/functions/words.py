"""Which of many words a text holds, by one pass over its bytes. Rules ask here first, so that a pattern reads only what it may match."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts are taken in pieces of about so many bytes; a text is never cut.
PIECE_BYTES = 1 << 20


class Finder:
    """Finds the words of ``marks`` (a word in lower case and the number it stands for) in texts laid end to end. Words are dealt over eight bits by their first bytes; a place at which
    some bit fits all of these bytes is looked up among the words' beginnings, and there the words are compared eight bytes at a time."""

    def __init__(self, marks: Sequence[tuple[str, int]]):
        words: dict[bytes, list[int]] = {}
        for word, mark in marks:
            words.setdefault(word.encode(), []).append(mark)
        if b"" in words:
            raise ValueError("an empty word is in every text")
        self.width = min([4, *map(len, words)])
        number = lambda start: int.from_bytes(start, "little")
        starts = sorted({w[: self.width] for w in words})
        fits = np.zeros((self.width, 256), np.uint8)
        for n, start in enumerate(starts):
            fits[range(self.width), list(start)] |= 1 << (8 * n // len(starts))
        self.fits = [row.tobytes() for row in fits]
        starts.sort(key=number)
        self.starts = np.array([number(s) for s in starts], np.uint32)
        self.words = [[(w, numbers) for w, numbers in words.items() if w.startswith(s)] for s in starts]

    def places(self, raw: bytes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, place, mark) of every word found; text i has the bytes from at[i] up to at[i + 1]."""
        padded = raw + bytes(16)
        fit = np.frombuffer(raw.translate(self.fits[0]), np.uint8).copy()
        for i in range(1, self.width):
            fit &= np.frombuffer(padded.translate(self.fits[i]), np.uint8)[i : i + len(raw)]
        place = np.flatnonzero(fit != 0)
        start = np.ndarray(len(raw), "<u4", padded, 0, (1,))[place] & np.uint32(2 ** (8 * self.width) - 1)
        group = np.searchsorted(self.starts, start)
        sure = self.starts[np.minimum(group, len(self.starts) - 1)] == start
        place, group = place[sure], group[sure].astype(np.uint16)
        place = place[np.argsort(group, kind="stable")]
        upto = np.cumsum(np.bincount(group, minlength=len(self.starts)))
        eight = np.ndarray(len(raw) + 8, "<u8", padded, 0, (1,))
        found, marks, lengths = [], [], []
        for words, a, b in zip(self.words, [0, *upto], upto, strict=False):
            for word, numbers in words if a < b else ():
                here = place[a:b]
                for i in range(0, len(word), 8):
                    part = word[i : i + 8]
                    here = here[here + i < len(eight)] if i > 8 else here
                    here = here[eight[here + i] & np.uint64(2 ** (8 * len(part)) - 1) == np.uint64(int.from_bytes(part, "little"))]
                for mark in numbers if len(here) else ():
                    found.append(here)
                    marks.append(mark)
                    lengths.append(len(word))
        sizes = [len(x) for x in found]
        where = np.concatenate([np.empty(0, np.int64), *found])
        text = np.searchsorted(at, where, "right") - 1
        whole = where + np.repeat(np.array(lengths, np.int64), sizes) <= at[text + 1]
        return text[whole], where[whole], np.repeat(np.array(marks, np.int64), sizes)[whole]


def _pieces(texts: pa.Array) -> Iterator[tuple[bytes, np.ndarray]]:
    """(bytes in lower case, offsets) of runs of texts; null counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = memoryview(data) if data is not None else memoryview(b"")
    run = (at[:-1] - at[0]) // PIECE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        low, ends = bytes(raw[at[a] : at[b]]), at[a : b + 1] - at[a]
        if low.isascii():
            low = low.lower()
        else:
            each = [low[i:j].decode("utf-8", "replace").lower().encode() for i, j in zip(ends, ends[1:], strict=False)]
            low, ends = b"".join(each), np.cumsum([0, *map(len, each)])
        yield low, ends


def _lists(owner: np.ndarray, n: int, values: pa.Array) -> pa.Array:
    """Lists of ``values``, those of one owner in a row, for owners 0 to n - 1."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]), pa.int32()), values)


def rules_held(text: Column, needs: Sequence[Sequence[Sequence[str]]]) -> Column:
    """array<int>: the numbers of the rules that have a word of each of their lists in the text, without regard to case. ``needs`` has the lists of each rule; one without any is always there."""
    lists = [(i, words) for i, of in enumerate(needs) for words in of]
    if not lists:
        return F.array(*map(F.lit, range(len(needs)))).cast("array<int>")
    finder = Finder([(w, m) for m, (_, words) in enumerate(lists) for w in words])
    rule_of = np.array([i for i, _ in lists])
    wanted = np.bincount(rule_of, minlength=len(needs))

    @F.arrow_udf("array<int>")
    def held(texts: pa.Array) -> pa.Array:
        out = []
        for raw, at in _pieces(texts):
            text, _, mark = finder.places(raw, at)
            has = np.zeros((len(at) - 1, len(lists)), bool)
            has[text, mark] = True
            met = np.zeros((len(at) - 1, len(needs)), np.int32)
            for m, i in enumerate(rule_of):
                met[:, i] += has[:, m]
            owner, rule = np.nonzero(met == wanted)
            out.append(_lists(owner, len(at) - 1, pa.array(rule, pa.int32())))
        return pa.concat_arrays(out)

    return held(text)


def lines_held(text: Column, words: Sequence[Sequence[str]], in_line: Sequence[bool], more: Sequence[int]) -> Column:
    """array<struct<rule int, lines array<int>>>: the numbers of the rules of whose ``words`` the text holds one, without regard to case; a rule without words is always there.

    ``lines``, of rules with ``in_line``, has the numbers of the lines (cut at line feeds, from 0) in which a word begins, and of as many lines after each as ``more`` says; of others it is empty.
    """
    kind, n = "array<struct<rule int, lines array<int>>>", len(words)
    if not any(words):
        return F.array(*[F.struct(F.lit(i).alias("rule"), F.array().cast("array<int>").alias("lines")) for i in range(n)]).cast(kind)
    finder = Finder([(w, i) for i, of in enumerate(words) for w in of])
    always = np.array([i for i, of in enumerate(words) if not of], np.int64)
    cut, after = np.array(in_line, bool), np.array(more, np.int64)

    @F.arrow_udf(kind)
    def held(texts: pa.Array) -> pa.Array:
        out = []
        for raw, at in _pieces(texts):
            text, place, rule = finder.places(raw, at)
            feeds = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10)
            first, last = np.searchsorted(feeds, at[text]), np.searchsorted(feeds, at[text + 1])
            line, pair = np.searchsorted(feeds, place) - first, text * n + rule
            every = np.union1d(pair, (np.arange(len(at) - 1)[:, None] * n + always).ravel())
            wide = after[rule] * cut[rule]
            reached = [pair[cut[rule]] * (len(feeds) + 1) + line[cut[rule]]]
            for k in range(1, wide.max(initial=0) + 1):
                far = (wide >= k) & (line + k <= last - first)
                reached.append(pair[far] * (len(feeds) + 1) + line[far] + k)
            pair, line = np.divmod(np.unique(np.concatenate(reached)), len(feeds) + 1)
            owner, rule = np.divmod(every, n)
            lines = _lists(np.searchsorted(every, pair), len(every), pa.array(line, pa.int32()))
            out.append(_lists(owner, len(at) - 1, pa.StructArray.from_arrays([pa.array(rule, pa.int32()), lines], ["rule", "lines"])))
        return pa.concat_arrays(out)

    return held(text)
