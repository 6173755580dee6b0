"""Align the tokens of two tokenizers over the same bytes, and weigh each linked pair by the documents that hold it.

A is a byte-level BPE file, read by ``tokenizers``; B is a ``sentencepiece`` model with byte fallback. Both cut the same bytes, a blank and the text.
Coarse cuts come from the libraries' spans - character offsets of the first, the spans of the second's protos - and are refined by the
tokens' decoded bytes where several tokens share a character. Spans are taken once per distinct segment (a pre-token of A; for B a run of blanks
and what follows up to the next, since no piece holds a blank after another character, which is checked) and laid end to end.

Places where tokens of A and B both end cut a document into groups. The ends of both together cut it into stretches, each covered by
one token of A and one of B; so stretches are exactly the overlapping pairs, and their number is linear in the tokens.

A document's distinct pairs and how often it holds each are written once. How many documents hold a pair is counted with map-side
combining. The counts then meet the documents' pairs by a broadcast of the commonest pairs - all that held by at least as many documents
as a cut chosen from the histogram of counts, at most ``broadcast`` of them - and by a shuffled join for the rare rest. So the
pairs that most rows hold are never shuffled, and no size is assumed.

Defined cases: a text that is null or empty, or whose tokens' bytes differ from a blank and the text (U+2581 in it, for one), has no tokens:
zeros and ''. Rows are documents: a repeated row counts again, a null id is a row like any other. An empty table gives an empty one; only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedge.functions.storage import saved
from sedge.llm.segments import ByteIds, pretokens
from sedge.llm.textarrays import buffers, slices

BLANK = "▁"
ALIGNED = "row long, id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<struct<pair:long,times:int>>"


def byte_decoder() -> dict[str, int]:
    """Byte of each character that stands for one in a byte-level vocabulary: printable characters are themselves, the others follow from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in printable}
    return shown | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}


class Spans(ByteIds):
    """Token ids and their sizes in bytes, per distinct segment. ``odd`` marks segments whose tokens' bytes differ from theirs.

    ``entries`` are the bytes that each id stands for; ``spans`` gives, of many segments, all ids, the bytes before each one's end in
    its segment by the library's spans, which tokens have no such cut of their own, and the number of tokens of each segment.
    """

    def __init__(self, path: str, limit: int, entries: list[bytes]):
        self.ids = len(entries)
        self.entry = np.frombuffer(b"".join(entries), np.uint8)
        self.entry_at = np.concatenate(([0], np.cumsum([len(e) for e in entries])))
        super().__init__(path, limit)

    def clear(self) -> None:
        super().clear()
        self.width, self.odd = np.empty(0, np.int32), np.empty(0, bool)

    def _add(self, words: list[bytes], low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
        data = np.frombuffer(b"".join(words), np.uint8)
        start = np.concatenate(([0], np.cumsum([len(w) for w in words])))
        ids, ends, uncut, counts = self.spans(words, data, start)
        first = np.concatenate(([0], np.cumsum(counts)))
        owner = np.repeat(np.arange(len(words)), counts)
        decoded = self.entry_at[ids + 1] - self.entry_at[ids]
        odd = np.bincount(owner, decoded, len(words)).astype(np.int64) != np.diff(start)
        # The decoded bytes, laid end to end, must be the segment's own.
        right = ~odd[owner]
        n = decoded[right]
        places = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        same = self.entry[np.repeat(self.entry_at[ids[right]], n) + places] == data[np.repeat(~odd, np.diff(start))]
        odd[np.unique(np.repeat(owner[right], n)[~same])] = True
        # A token without a cut of its own ends its decoded bytes after the last cut.
        run = np.cumsum(decoded)
        anchored = np.maximum.accumulate(np.where(uncut, -1, np.arange(len(ids))))
        begin = np.repeat(run[first[:-1]] - decoded[first[:-1]], counts)
        last = np.maximum(anchored, np.repeat(first[:-1], counts) - 1)
        inside = last >= np.repeat(first[:-1], counts)
        ends = np.where(uncut, np.where(inside, ends[last] + run - run[last], run - begin), ends)
        width = np.diff(ends, prepend=0)
        width[first[:-1]] = ends[first[:-1]]
        if odd.any():  # one token that covers the segment
            keep = ~odd[owner]
            keep[first[:-1]] = True
            width[first[:-1][odd]] = np.diff(start)[odd]
            ids, width, counts = ids[keep], width[keep], np.where(odd, 1, counts)
        self.odd = np.concatenate((self.odd, odd))
        return self._keep(counts, low, high, size, flat=ids, width=width)


class OffsetSpans(Spans):
    """``tokenizers``: character offsets; tokens that share a character with the next have no cut. Special tokens' strings are plain text."""

    def __init__(self, path: str, limit: int):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        code, names = byte_decoder(), self.library.get_vocab()
        entries = [b""] * (1 + max(names.values()))
        for name, i in self.library.get_vocab(with_added_tokens=False).items():
            if all(c in code for c in name):
                entries[i] = bytes(code[c] for c in name)
        super().__init__(path, limit, entries)

    def spans(self, words: list[bytes], data: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, ...]:
        found = self.library.encode_batch([w.decode() for w in words], add_special_tokens=False)
        ids = [e.ids for e in found]
        counts = np.array([len(x) for x in ids], np.int64)
        offsets = np.array([o for e in found for o in e.offsets], np.int64).reshape(-1, 2)
        heads = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        owner = np.repeat(np.arange(len(words)), counts)
        char = np.searchsorted(heads, start[:-1])[owner] + offsets[:, 1]
        uncut = np.zeros(len(owner), bool)
        uncut[:-1] = (owner[1:] == owner[:-1]) & (offsets[1:, 0] < offsets[:-1, 1])
        return np.array([i for x in ids for i in x], np.int64), heads[char] - start[:-1][owner], uncut, counts


class ProtoSpans(Spans):
    """``sentencepiece``: spans of the protos' pieces; byte-fallback tokens have no cut. Each segment begins with the blank that the model adds."""

    def __init__(self, path: str, limit: int):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        if any(BLANK in p.lstrip(BLANK) for p in pieces):
            raise ValueError("a piece holds a blank after another character, so words are not cut on their own")
        fallback = [self.library.is_byte(i) for i in range(len(pieces))]
        self.fallback, self.blank = np.array(fallback), self.library.piece_to_id(BLANK)
        super().__init__(path, limit, [bytes([int(p[3:5], 16)]) if b else p.replace(BLANK, " ").encode() for p, b in zip(pieces, fallback, strict=True)])

    def spans(self, words: list[bytes], data: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, ...]:
        protos = self.library.encode([w[1:].decode() for w in words], return_type="proto")
        # The library cuts a blank alone only after other text.
        found = [[(p.id, p.end) for p in proto.pieces] or [(self.blank, 0)] for proto in protos]
        flat = np.array([x for pieces in found for x in pieces], np.int64).reshape(-1, 2)
        return flat[:, 0], flat[:, 1] + 1, self.fallback[flat[:, 0]], np.array([len(x) for x in found], np.int64)


@lru_cache(2)
def spans_of(a: str, b: str, limit: int = 1_000_000) -> tuple[OffsetSpans, ProtoSpans]:
    return OffsetSpans(a, limit), ProtoSpans(b, limit)


def spaced(texts: pa.Array) -> pa.Array:
    """A blank before each text."""
    raw, at = buffers(texts)
    at = at + np.arange(len(at))
    out = np.empty(len(raw) + len(texts), np.uint8)
    blank = np.zeros(len(out), bool)
    blank[at[:-1]] = True
    out[blank], out[~blank] = 32, raw
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(out)])


def blank_segments(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Bounds of runs of blanks with what follows them, within texts that begin with one."""
    blank = raw == 32
    first = blank & ~np.concatenate(([False], blank[:-1]))
    first[at[:-1]] = True
    return np.append(np.flatnonzero(first), len(raw)).astype(np.int64)


def _decimals(n: int, marks: str) -> np.ndarray:
    return np.array([f"{i}{m}" for m in marks for i in range(n)], "S")


@lru_cache(2)
def _written(n_a: int, n_b: int) -> np.ndarray:
    """Each id of A with ',' or '|' after it, then each of B with ',' or ';'."""
    return np.concatenate((_decimals(n_a, ",|"), _decimals(n_b, ",;")))


def align(texts: pa.Array, a: OffsetSpans, b: ProtoSpans) -> tuple[np.ndarray, ...]:
    """Of texts that are not empty: n_a, n_b, n_groups, n_links, digest of the groups, and (text, pair, times) of the distinct pairs in text order."""
    line = spaced(texts)
    raw, at = buffers(line)
    n = len(texts)
    bounds_a, bounds_b = pretokens(line)[1], blank_segments(raw, at)
    which_a, where_a, _ = a.tokens_of(raw, bounds_a)
    which_b, where_b, _ = b.tokens_of(raw, bounds_b)
    bad = np.zeros(n, bool)
    for odd, bounds in ((a.odd[which_a], bounds_a), (b.odd[which_b], bounds_b)):
        bad[np.searchsorted(at, bounds[:-1][odd], side="right") - 1] = True
    id_a, id_b = a.flat[where_a].astype(np.int64), b.flat[where_b].astype(np.int64)
    end_a, end_b = np.cumsum(a.width[where_a], dtype=np.int64), np.cumsum(b.width[where_b], dtype=np.int64)
    ends_a, ends_b = np.zeros(len(raw) + 1, bool), np.zeros(len(raw) + 1, bool)
    ends_a[end_a], ends_b[end_b] = True, True
    done_a, done_b, done = np.cumsum(ends_a), np.cumsum(ends_b), np.cumsum(ends_a & ends_b)
    cut = np.flatnonzero(ends_a | ends_b)
    link_at = np.searchsorted(cut, at, side="right")
    owner = np.repeat(np.arange(n), np.diff(link_at))
    pair = id_a[done_a[cut - 1]] * b.ids + id_b[done_b[cut - 1]]

    of_all = a.ids * b.ids
    good = ~bad[owner]
    held, times = np.unique(owner[good] * of_all + pair[good], return_counts=True)

    # Tokens by group, those of A first; each is written with the mark that follows it.
    group_a, group_b = done[end_a - 1], done[end_b - 1]
    place_a = np.arange(len(id_a)) + np.searchsorted(group_b, group_a, side="left")
    place_b = np.arange(len(id_b)) + np.searchsorted(group_a, group_b, side="right")
    code = np.empty(len(id_a) + len(id_b), np.int64)
    code[place_a] = id_a + np.where(ends_b[end_a], a.ids, 0)
    code[place_b] = id_b + 2 * a.ids + np.where(ends_a[end_b], b.ids, 0)
    table = _written(a.ids, b.ids)
    shown = table[code]
    size = np.char.str_len(table)[code] if len(code) < len(table) else np.char.str_len(shown)
    flat = shown.view(np.uint8)
    flat = flat[flat != 0].tobytes()
    written = np.concatenate(([0], np.cumsum(size)))[done_a[at] + done_b[at]].tolist()
    digest = ["" if x else hashlib.sha256(flat[s : e - 1]).hexdigest() for x, s, e in zip(bad.tolist(), written, written[1:], strict=False)]
    counts = [np.where(bad, 0, np.diff(x[at])) for x in (done_a, done_b, done)]
    return *counts, np.where(bad, 0, np.diff(link_at)), digest, held // of_all, held % of_all, times


def document_links(docs: DataFrame, a: str, b: str, *, id_col: str, text_col: str) -> DataFrame:
    """A row per document with its counts, its groups' digest and its distinct pairs; ``pair`` is id of A times the size of B's vocabulary plus id of B."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = spans_of(a, b)
        for part in slices(batches):
            texts, n = part.column("text"), part.num_rows
            some = np.flatnonzero(np.diff(buffers(texts)[1]) > 0)
            counts, digest, lists = np.zeros((4, n), np.int64), [""] * n, np.zeros(n + 1, np.int64)
            pair, times = np.empty(0, np.int64), np.empty(0, np.int64)
            if len(some):
                *found, made, owner, pair, times = align(texts.take(pa.array(some)), *spans)
                counts[:, some] = found
                for i, d in zip(some.tolist(), made, strict=True):
                    digest[i] = d
                lists = np.searchsorted(some[owner], np.arange(n + 1))
            kind = pa.struct([("pair", pa.int64()), ("times", pa.int32())])
            held = pa.StructArray.from_arrays([pa.array(pair, pa.int64()), pa.array(times, pa.int32())], fields=list(kind))
            columns = [part.column("row"), part.column("id"), *[pa.array(c) for c in counts], pa.array(digest, pa.string()), pa.ListArray.from_arrays(pa.array(lists, pa.int32()), held)]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), text)
    return rows.mapInArrow(links, ALIGNED)


def pair_counts(links: DataFrame, n_b: int) -> DataFrame:
    """(pair, docs, best): in how many documents each pair is linked, and whether none of its A id's pairs is in more."""
    counts = links.groupBy("pair").agg(F.count("*").alias("docs"))
    most = F.max("docs").over(Window.partitionBy(F.expr(f"pair div {n_b}")))
    return counts.select("pair", "docs", (F.col("docs") == most).alias("best"))


def common_cut(pairs: DataFrame, most: int) -> int:
    """The least power of two such that at most ``most`` pairs are held by as many documents; 1 if that is all of them."""
    rows = pairs.groupBy(F.floor(F.log2("docs")).cast("int").alias("level")).agg(F.count("*").alias("n")).collect()  # at most 64 rows
    sizes = {r["level"]: r["n"] for r in rows}
    level, total = max(sizes, default=0) + 1, 0
    while level > 0 and total + sizes.get(level - 1, 0) <= most:
        level -= 1
        total += sizes.get(level, 0)
    return 1 << level


def alignments(docs: DataFrame, a: str, b: str, *, id_col: str = "doc_id", text_col: str = "text", broadcast: int = 1_000_000) -> DataFrame:
    """One row per row of ``docs``: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``a`` and ``b`` are paths that every executor can open; at most ``broadcast`` pairs are broadcast.
    """
    from sentencepiece import SentencePieceProcessor

    n_b = SentencePieceProcessor(model_file=b).get_piece_size()
    made = saved(document_links(docs, a, b, id_col=id_col, text_col=text_col), "aligned")
    links = made.select("row", F.inline("links"))
    pairs = saved(pair_counts(links, n_b), "pair-counts")
    cut = common_cut(pairs, broadcast)
    common = F.broadcast(pairs.filter(F.col("docs") >= cut))
    if cut == 1:
        weighed = links.join(common, "pair")
    else:
        met = links.join(common, "pair", "left")
        rare = met.filter("docs IS NULL").select("pair", "row", "times").join(pairs.filter(F.col("docs") < cut), "pair")
        weighed = met.filter("docs IS NOT NULL").unionByName(rare)
    per_row = weighed.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("docs") * F.col("times")).alias("count_sum"))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return made.drop("links").join(per_row, "row", "left").select("id", "n_a", "n_b", "n_groups", "n_links", *zero, "groups_sha256")
