"""Segmentation of texts into lines, pages, headings, sections and chunks with offset lineage.

Offsets are 0-based code points, end exclusive. Everything is keyed by the document, so one shuffle by ``id`` serves all
windows. Headings are matched per line, never across line ends.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedge.functions.embedding import Embedding, trigram_embed
from sedge.functions.joins import dealt
from sedge.functions.rules import RuleSet


def lines(df: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, line_no (from 0), char_start, char_end, line. """
    parts = F.split(F.col(text), "\n")
    rows = df.select(id, F.posexplode(parts).alias("line_no", "line"))
    before = Window.partitionBy(id).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).cast("long")
    return rows.withColumn("char_start", begin).withColumn("char_end", F.col("char_start") + F.length("line")).select(id, "line_no", "char_start", "char_end", "line")


def page_markers(df: DataFrame, *, id: str = "doc_id", text: str = "text", chars_per_page: int = 3000) -> DataFrame:
    """id, page_num, pos. Marker lines ``--- PAGE n ---`` or ``Page n``; documents without any get a page every ``chars_per_page`` characters."""
    pattern = r"(?i)^(?:--- page ([0-9]+) ---|page ([0-9]+))\s*$"
    marked = df.filter(F.col(text).rlike(r"(?im)^(?:--- page [0-9]+ ---|page [0-9]+)\s*$"))
    number = F.coalesce(F.nullif(F.regexp_extract("line", pattern, 1), F.lit("")), F.nullif(F.regexp_extract("line", pattern, 2), F.lit("")))
    real = lines(marked, id=id, text=text).filter(F.col("line").rlike(pattern)).select(id, number.cast("int").alias("page_num"), F.col("char_start").alias("pos"))
    plain = df.filter(~F.coalesce(F.col(text).rlike(r"(?im)^(?:--- page [0-9]+ ---|page [0-9]+)\s*$"), F.lit(False)))
    n = F.greatest(F.lit(1), F.floor(F.length(F.coalesce(F.col(text), F.lit(""))) / chars_per_page)).cast("int")
    made = plain.select(id, F.explode(F.sequence(F.lit(1), n)).alias("page_num")).select(id, "page_num", ((F.col("page_num") - 1).cast("long") * chars_per_page).alias("pos"))
    return real.unionByName(made)


def assign_page(points: DataFrame, pages: DataFrame, *, id: str = "doc_id", pos: str = "pos") -> DataFrame:
    """As-of join: add page_num, the last page that starts at or before the position; before the first marker, the first page."""
    extra = [c for c in points.columns if c not in (id, pos)]
    p = points.select(id, F.col(pos).cast("long").alias("_pos"), F.struct(*[F.col(c) for c in extra], F.lit(1).alias("_")).alias("_row"), F.lit(None).cast("int").alias("_page"), F.lit(1).alias("_k"))
    m = pages.select(id, F.col("pos").cast("long").alias("_pos"), F.lit(None).cast(p.schema["_row"].dataType).alias("_row"), F.col("page_num").alias("_page"), F.lit(0).alias("_k"))
    w = Window.partitionBy(id).orderBy("_pos", "_k")
    every = Window.partitionBy(id)
    both = p.unionByName(m).withColumn("page_num", F.last("_page", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_first", F.min_by("_page", F.when(F.col("_k") == 0, F.col("_pos"))).over(every))
    return both.filter("_k = 1").select(id, F.col("_pos").alias(pos), *[F.col(f"_row.{c}").alias(c) for c in extra], F.coalesce("page_num", "_first").alias("page_num"))


def headings(lines_df: DataFrame, rules: RuleSet, *, line: str = "line") -> DataFrame:
    """Candidates: a row per line and rule that matches, with level (the rule's weight) and ordinal."""
    hits = lines_df.withColumn("_h", F.explode(rules.hits(F.col(line))))
    return hits.withColumn("level", F.col("_h.weight").cast("int")).withColumn("ordinal", F.col("_h.ordinal")).drop("_h")


def drop_overlaps(heads: DataFrame, *, id: str = "doc_id") -> DataFrame:
    """One heading per line: the highest level number, then the first rule."""
    w = Window.partitionBy(id, "line_no").orderBy(F.desc("level"), "ordinal")
    return heads.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def line_windows(lines_df: DataFrame, *, id: str = "doc_id", most: int = 2) -> DataFrame:
    """Each line, and each line with those after it up to ``most`` lines, as one row: id, line_no, char_start, char_end, line. So a heading's rule can reach over a line end."""
    w = Window.partitionBy(id).orderBy("line_no").rowsBetween(0, most - 1)
    near = lines_df.withColumn("_l", F.collect_list(F.struct("char_end", "line")).over(w))
    each = near.select(id, "line_no", "char_start", "_l", F.explode(F.sequence(F.lit(1), F.size("_l"))).alias("_n"))
    parts = F.slice("_l", 1, F.col("_n"))
    return each.select(id, "line_no", "char_start", F.element_at(parts, -1)["char_end"].alias("char_end"), F.array_join(F.transform(parts, lambda x: x["line"]), "\n").alias("line"))


def drop_overlapping(heads: DataFrame, *, id: str = "doc_id") -> DataFrame:
    """Candidates of any span, greedily by (char_start, level, ordinal, char_end): one that a kept candidate covers for more than half of its own length takes that one's place if its
    level number is larger than those of all kept ones it meets so, else it is dropped. A document's candidates meet in one task, never its text.
    """

    def sweep(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["char_start", "level", "ordinal", "char_end"], kind="stable")
        start, end, level = (group[c].to_numpy() for c in ("char_start", "char_end", "level"))
        kept: list[int] = []
        for i in range(len(group)):
            # Candidates come by their starts, so what is kept and reaches over this start is what can overlap.
            met = [k for k in kept if 2 * (min(end[i], end[k]) - max(start[i], start[k])) > end[i] - start[i]]
            if any(level[k] >= level[i] for k in met):
                continue
            kept = [k for k in kept if k not in met]
            kept.append(i)
        return group.iloc[kept]

    return heads.groupBy(id).applyInPandas(sweep, heads.schema)


def merge_nearby(heads: DataFrame, *, id: str = "doc_id", gap: int = 500) -> DataFrame:
    """Runs of consecutive headings of one level less than ``gap`` characters apart become one; texts joined by ' / '."""
    w = Window.partitionBy(id).orderBy("char_start")
    new = (F.lag("level").over(w).isNull()) | (F.lag("level").over(w) != F.col("level")) | (F.col("char_start") - F.lag("char_end").over(w) >= gap)
    runs = heads.withColumn("_new", new.cast("int")).withColumn("_run", F.sum("_new").over(w))
    parts = F.array_sort(F.collect_list(F.struct("char_start", "line")))
    return runs.groupBy(id, "_run").agg(F.min("level").alias("level"), F.min("char_start").alias("char_start"), F.max("char_end").alias("char_end"), parts.alias("_p")).select(id, "level", "char_start", "char_end", F.array_join(F.transform("_p", lambda x: x["line"]), " / ").alias("heading"))


def section_cut(heads: DataFrame, docs: DataFrame, *, id: str = "doc_id", text: str = "text", min_chars: int = 50) -> DataFrame:
    """Content from each heading to the next one or the end; sections of under ``min_chars`` stripped characters go."""
    w = Window.partitionBy(id).orderBy("char_start")
    cut = heads.withColumn("_next", F.lead("char_start").over(w)).join(docs.select(id, F.col(text).alias("_t")), id)
    end = F.coalesce(F.col("_next"), F.length("_t").cast("long"))
    out = cut.withColumn("content", F.substring("_t", (F.col("char_start") + 1).cast("int"), (end - F.col("char_start")).cast("int"))).withColumn("section_end", end)
    return out.filter(F.length(F.btrim("content", F.lit(" \n\t\r"))) >= min_chars).drop("_t", "_next")


def parent_of(sections: DataFrame, *, id: str = "doc_id", levels: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """Add parent_start: start of the nearest earlier section with a smaller level; null means the root."""
    w = Window.partitionBy(id).orderBy("char_start").rowsBetween(Window.unboundedPreceding, -1)
    parent = F.lit(None).cast("long")
    for level in levels:
        above = F.last(F.when(F.col("level") < level, F.col("char_start")), ignorenulls=True).over(w)
        parent = F.when(F.col("level") == level, above).otherwise(parent)
    return sections.withColumn("parent_start", parent)


def ancestor_paths(sections: DataFrame, *, id: str = "doc_id", levels: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """Add path: the starts of a section's ancestors from the root down; empty at the root. The last one is its parent."""
    w = Window.partitionBy(id).orderBy("char_start").rowsBetween(Window.unboundedPreceding, -1)
    last = {k: F.last(F.when(F.col("level") == k, F.col("char_start")), ignorenulls=True).over(w) for k in levels}
    out = sections.withColumns({f"_at{k}": c for k, c in last.items()})
    path = []
    for i, k in enumerate(levels):
        above = [F.col(f"_at{j}") for j in levels[:i]]
        fresh = F.lit(True) if not above else F.col(f"_at{k}") > F.greatest(*[F.coalesce(c, F.lit(-1)) for c in above], F.lit(-1))
        path.append(F.when((F.col("level") > k) & fresh, F.col(f"_at{k}")))
    return out.withColumn("path", F.array_compact(F.array(*path))).drop(*[f"_at{k}" for k in levels])


def section_table(docs: DataFrame, heads: DataFrame, *, id: str = "doc_id", text: str = "text", min_doc: int = 500, min_chars: int = 50) -> DataFrame:
    """id, mode, level, char_start, char_end, content. Documents of fewer than ``min_doc`` characters are left out; those with two headings or more are cut at
    them ("sections"), the others into paragraphs ("paragraphs", no level), and what gives neither stays whole ("whole")."""
    long = docs.filter(F.length(text) >= min_doc).select(id, text)
    several = heads.groupBy(id).agg(F.count("*").alias("_n")).filter("_n > 1").select(id)
    cut = section_cut(heads.join(several, id, "left_semi"), long, id=id, text=text, min_chars=min_chars)
    cut = cut.select(id, F.lit("sections").alias("mode"), "level", "char_start", F.col("section_end").alias("char_end"), "content")
    rest = long.join(several, id, "left_anti")
    parts = paragraph_rows(rest, id=id, text=text, min_chars=min_chars).select(id, F.lit("paragraphs").alias("mode"), F.lit(None).cast("int").alias("level"), "char_start", "char_end", "content")
    whole = long.join(cut.select(id).union(parts.select(id)).distinct(), id, "left_anti")
    whole = whole.select(id, F.lit("whole").alias("mode"), F.lit(0).alias("level"), F.lit(0).cast("long").alias("char_start"), F.length(text).cast("long").alias("char_end"), F.col(text).alias("content"))
    return cut.unionByName(parts).unionByName(whole)


def paragraph_rows(df: DataFrame, *, id: str = "doc_id", text: str = "text", min_chars: int = 50, at_least: int = 3) -> DataFrame:
    """id, chunk_id (F-001, ...), char_start, char_end, content: runs of lines between blank ones, without blanks around them; runs of fewer than ``min_chars``
    characters go. A document with fewer than ``at_least`` runs left is one chunk, its whole text; a null text gives none."""
    rows = lines(df.filter(F.col(text).isNotNull()), id=id, text=text).withColumn("_blank", F.btrim("line", F.lit(" \t\r")) == "")
    before = Window.partitionBy(id).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    runs = rows.withColumn("_run", F.sum(F.col("_blank").cast("int")).over(before)).filter("NOT _blank")
    lead = F.length("line") - F.length(F.ltrim("line", F.lit(" \t\r")))
    tail = F.length("line") - F.length(F.rtrim("line", F.lit(" \t\r")))
    spans = runs.groupBy(id, "_run").agg(F.min_by(F.col("char_start") + lead, "line_no").alias("char_start"), F.max_by(F.col("char_end") - tail, "line_no").alias("char_end"))
    spans = spans.filter(F.col("char_end") - F.col("char_start") >= min_chars)
    lists = spans.groupBy(id).agg(F.array_sort(F.collect_list(F.struct("char_start", "char_end"))).alias("_s"))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("char_start"), F.length("_t").cast("long").alias("char_end")))
    both = df.select(id, F.col(text).alias("_t")).filter("_t IS NOT NULL").join(lists, id, "left")
    each = both.select(id, "_t", F.posexplode(F.when(F.size("_s") >= at_least, F.col("_s")).otherwise(whole)).alias("_no", "_p"))
    content = F.substring("_t", (F.col("_p.char_start") + 1).cast("int"), (F.col("_p.char_end") - F.col("_p.char_start")).cast("int"))
    return each.select(id, F.format_string("F-%03d", F.col("_no") + 1).alias("chunk_id"), "_p.char_start", "_p.char_end", content.alias("content"))


def leaves_or_whole(sections: DataFrame, docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, char_start, level, content: the leaf sections; a document without any section is its own leaf (level 0) if it has content."""
    own = leaves(sections, id=id).select(id, "char_start", "level", "content")
    bare = docs.filter(F.btrim(text, F.lit(" \n\t\r")) != "").join(sections.select(id).distinct(), id, "left_anti")
    return own.unionByName(bare.select(id, F.lit(0).cast("long").alias("char_start"), F.lit(0).alias("level"), F.col(text).alias("content")))


def leaves(sections: DataFrame, *, id: str = "doc_id") -> DataFrame:
    """Sections that are no other section's parent."""
    parents = sections.filter("parent_start IS NOT NULL").select(id, F.col("parent_start").alias("char_start")).distinct()
    return sections.join(parents, [id, "char_start"], "left_anti")


def paragraphs(df: DataFrame, *, id: str = "doc_id", text: str = "text", separator: str = r"\n[ \t]*\n", min_chars: int = 50, at_least: int = 3) -> DataFrame:
    """id, chunk_no, content; fewer than ``at_least`` paragraphs of ``min_chars`` leave the document whole."""
    parts = F.filter(F.transform(F.split(F.col(text), separator), lambda p: F.btrim(p, F.lit(" \n\t\r"))), lambda p: F.length(p) >= min_chars)
    out = df.select(id, F.col(text).alias("_t"), parts.alias("_p"))
    return out.select(id, F.posexplode(F.when(F.size("_p") >= at_least, F.col("_p")).otherwise(F.array("_t"))).alias("chunk_no", "content"))


def pack_paragraphs(df: DataFrame, *, id: str = "doc_id", text: str = "text", separator: str = "\n", target: int = 5000, most: int = 10000, small: int = 500) -> DataFrame:
    """id, chunk_no, char_start, char_end, n_chars (without separators), content.

    Greedy packing inside a document: flush before exceeding ``most``; flush at ``target`` unless the next paragraph is under ``small``.
    One pass over each row's text, without a shuffle. A null text gives no chunks.
    """

    def chunks(whole: str):
        begin = at = size = n = 0
        for part in whole.split(separator):
            if n and (size + len(part) > most or size >= target and len(part) >= small):
                yield begin, at - len(separator), size
                begin, size, n = at, 0, 0
            at += len(part) + len(separator)
            size, n = size + len(part), n + 1
        yield begin, at - len(separator), size

    def pack(batches):
        for batch in batches:
            known = batch[batch["_text"].notna()]
            rows = [(key, no, a, b, size, whole[a:b]) for key, whole in zip(known["_id"], known["_text"], strict=True) for no, (a, b, size) in enumerate(chunks(whole))]
            yield pd.DataFrame(rows, columns=[id, "chunk_no", "char_start", "char_end", "n_chars", "content"])

    kind = df.schema[id].dataType.simpleString()
    rows = df.select(F.col(id).alias("_id"), F.col(text).alias("_text"))
    return rows.mapInPandas(pack, f"`{id}` {kind}, chunk_no int, char_start long, char_end long, n_chars long, content string")


def fixed_chunks(df: DataFrame, *, id: str = "doc_id", text: str = "text", size: int = 2000, overlap: int = 0) -> DataFrame:
    """Windows of ``size`` characters, each starting size - overlap after the one before; the last is the one that reaches the end."""
    n, step = F.length(text), size - overlap
    last = F.greatest(F.lit(0), F.ceil((n - size) / step)).cast("int")
    rows = df.select(id, F.col(text).alias("_t"), F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
    return rows.select(id, "chunk_no", (F.col("chunk_no") * step).cast("long").alias("char_start"), F.substring("_t", (F.col("chunk_no") * step + 1).cast("int"), F.lit(size)).alias("content"))


def merge_boundaries(intervals: DataFrame, *, key: str, start: str, end: str, tolerance: int = 100, confidence: str | None = None) -> DataFrame:
    """Merge intervals that start at most ``tolerance`` after the furthest end so far; each result then runs to the next one's start."""
    intervals = dealt(intervals, key)  # one shuffle serves both windows and the sums between them
    w = Window.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = intervals.withColumn("_new", F.when(reach.isNull() | (F.col(start) > reach + tolerance), 1).otherwise(0)).withColumn("_run", F.sum("_new").over(w))
    aggs = [F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("n")]
    if confidence:
        aggs.append(F.max(confidence).alias("confidence"))
    merged = runs.groupBy(key, "_run").agg(*aggs).drop("_run")
    return merged.withColumn("next_start", F.lead("start").over(Window.partitionBy(key).orderBy("start")))


def sentences(df: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, sent_no, sentence: split after . ! ? and blanks; trimmed, empty ones dropped."""
    parts = F.filter(F.transform(F.split(F.col(text), r"(?<=[.!?])[ \t\r\n]+"), lambda s: F.btrim(s, F.lit(" \n\t\r"))), lambda s: F.length(s) > 0)
    return df.select(id, F.posexplode(parts).alias("sent_no", "sentence"))


def token_estimate(text: Column) -> Column:
    """ceil(characters / 4): 0 for an empty text, else at least 1."""
    return F.ceil(F.length(text) / 4).cast("long")


def truncate_to_budget(df: DataFrame, *, id: str = "doc_id", text: str = "text", max_tokens: int = 2000) -> DataFrame:
    """Keep whole leading sentences while the estimate fits; if none does, the first max_tokens * 4 characters. Adds truncated."""
    s = sentences(df, id=id, text=text)
    w = Window.partitionBy(id).orderBy("sent_no").rowsBetween(Window.unboundedPreceding, 0)
    fits = s.withColumn("_sum", F.sum(token_estimate(F.col("sentence"))).over(w)).filter(F.col("_sum") <= max_tokens)
    kept = fits.groupBy(id).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sent_no", "sentence"))), lambda x: x["sentence"]), " ").alias("_kept"))
    out = df.select(id, text).join(kept, id, "left")
    whole = token_estimate(F.col(text)) <= max_tokens
    cut = F.when(whole, F.col(text)).otherwise(F.coalesce(F.col("_kept"), F.left(F.col(text), F.lit(max_tokens * 4))))
    return out.select(id, cut.alias("content"), (~whole).alias("truncated"))


def pattern_sections(df: DataFrame, rules: RuleSet, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Lines that start a section by the catalogue cut the text; what comes before the first is the preamble. Counts per section."""
    rows = lines(df, id=id, text=text).withColumn("_g", rules.first(F.lower("line")))
    w = Window.partitionBy(id).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    at = F.sum(F.col("_g").isNotNull().cast("int")).over(w)
    run = rows.withColumn("section_no", at).withColumn("_first", F.max_by("_g", F.when(F.col("_g").isNotNull(), F.col("line_no"))).over(w))
    solid = F.length(F.regexp_replace("line", r"[ \t\r\n]", ""))
    out = run.groupBy(id, "section_no").agg(F.min_by("_first", "line_no").alias("_s"), F.min("char_start").alias("char_start"), F.max("char_end").alias("char_end"), F.sum(solid).alias("n_solid"), F.count("*").alias("n_lines"))
    return out.withColumn("section", F.coalesce("_s", F.lit("preamble"))).drop("_s")


ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}


def roman_value(c: Column) -> Column:
    """Value of a Roman numeral in capitals, else null."""
    digit = F.create_map(*[x for k, v in ROMAN.items() for x in (F.lit(k), F.lit(v))])
    values = F.transform(F.split(c, ""), lambda d: F.coalesce(F.element_at(digit, d), F.lit(0)))
    pairs = F.zip_with(values, F.concat(F.slice(values, 2, 100), F.array(F.lit(0))), lambda a, b: F.when(a < b, -a).otherwise(a))
    return F.when(c.rlike("^[IVXLCDM]+$"), F.aggregate(pairs, F.lit(0), lambda s, x: s + x))


def section_keys(df: DataFrame, *, number: str) -> DataFrame:
    """Add sort_key (ARRAY<INT>): dotted numbers part by part, a Roman numeral its value, a single letter its code."""
    c = F.col(number)
    dotted = F.when(c.rlike(r"^[0-9]+(\.[0-9]+)*$"), F.transform(F.split(c, r"\."), lambda x: x.cast("int")))
    return df.withColumn("sort_key", F.coalesce(dotted, F.when(roman_value(c).isNotNull(), F.array(roman_value(c))), F.when(c.rlike("^[A-Za-z]$"), F.array(F.ascii(c)))))


def number_tree(segments: DataFrame, *, id: str, key: str = "sort_key", pos: str = "pos") -> DataFrame:
    """Add parent_pos: the nearest earlier segment whose key is this key without its last part; null means the root."""
    kids = segments.withColumn("_up", F.slice(F.col(key), F.lit(1), F.size(key) - 1))
    above = segments.select(F.col(id).alias("_id"), F.col(key).alias("_key"), F.col(pos).alias("_pos"))
    pairs = kids.filter(F.size("_up") > 0).join(above, (F.col(id) == F.col("_id")) & (F.col("_up") == F.col("_key")) & (F.col("_pos") < F.col(pos)))
    parents = pairs.groupBy(id, pos).agg(F.max("_pos").alias("parent_pos"))
    return segments.join(parents, [id, pos], "left")


#: How headings are numbered: style, pattern of number and title. The first that fits counts.
NUMBER_STYLES = (
    ("dotted", r"^(?:[Ss]ection |SECTION |§ ?)?([0-9]+(?:\.[0-9]+)*)[.:)]?(?:[ \t-]+(.*))?$"),
    ("roman", r"^(?:ARTICLE|Article)[ \t]+([IVXLCDM]+)[.:]?(?:[ \t-]+(.*))?$"),
    ("upper", r"^([A-Z])[.)](?:[ \t]+(.*))?$"),
    ("lower", r"^\(([a-z])\)(?:[ \t]*(.*))?$"),
)


def heading_numbers(df: DataFrame, *, heading: str) -> DataFrame:
    """Add style, number, title and sort_key of a heading; one without a number has null style, number and key, and is its own title."""
    line = F.btrim(F.col(heading), F.lit(" \t\r\n"))
    style, number, title = F.lit(None).cast("string"), F.lit(None).cast("string"), line
    for name, pattern in reversed(NUMBER_STYLES):
        hit = line.rlike(pattern)
        style = F.when(hit, name).otherwise(style)
        number = F.when(hit, F.regexp_extract(line, pattern, 1)).otherwise(number)
        title = F.when(hit, F.btrim(F.regexp_extract(line, pattern, 2))).otherwise(title)
    keyed = section_keys(df.withColumn("style", style).withColumn("number", number).withColumn("title", title), number="number")
    letter = F.array(F.ascii(F.upper("number")) - 64)
    return keyed.withColumn("sort_key", F.when(F.col("style").isin("upper", "lower"), letter).otherwise(F.col("sort_key")))


def is_child(parent: Column, child: Column) -> Column:
    """Whether number ``child`` is a direct child of number ``parent``: one more dotted part, or a letter under a single digit."""
    dotted = F.startswith(child, F.concat(parent, F.lit("."))) & ~F.contains(F.substring(child, F.length(parent) + 2, F.lit(1 << 30)), F.lit("."))
    return F.coalesce(dotted | parent.rlike("^[0-9]$") & child.rlike("^[A-Za-z]$"), F.lit(False))


def number_outline(df: DataFrame, *, id: str, pos: str) -> DataFrame:
    """id, pos, parent_pos, path, depth, is_child, orphan of headings with ``heading_numbers``' columns, whatever styles a document mixes.

    A document's headings are folded in order of ``pos`` over a stack of open headings. A heading closes what stands from the first open heading of its own style on - for
    dotted numbers from the first dotted one that is not a proper beginning of its number - and belongs to the heading that is then on top (null: the root). ``path`` holds
    the positions of all that stay open, from the root; is_child says whether the parent's number is that of a direct parent; orphan, that a dotted number of several parts has no heading of one part less above it.
    Headings without a number close nothing and belong to the root. Only numbers meet in a task: its documents come sorted, batch by batch, and it holds the open headings of one.
    """
    kind = df.schema[id].dataType.simpleString()
    names = ["_id", "_pos", "parent_pos", "path", "is_child", "orphan"]
    schema = f"_id {kind}, _pos long, parent_pos long, path array<long>, is_child boolean, orphan boolean"

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, begun = None, False
        stack: list[tuple] = []
        for batch in batches:
            rows = []
            for of, at, style, number, key in zip(*(batch.column(c).to_pylist() for c in ("_id", "_pos", "style", "number", "sort_key")), strict=True):
                if not begun or of != doc:
                    doc, begun, stack = of, True, []
                if style is None:
                    rows.append((at, None, [], False, False))
                    continue
                for i, (_, s, _, k) in enumerate(stack):
                    if s == style and not (style == "dotted" and len(k) < len(key) and key[: len(k)] == k):
                        del stack[i:]
                        break
                top = stack[-1] if stack else None
                direct = top is not None and (number.startswith(top[2] + ".") and "." not in number[len(top[2]) + 1 :] or len(top[2]) == 1 and top[2].isdigit() and len(number) == 1 and number.isalpha())
                orphan = style == "dotted" and len(key) > 1 and not (top is not None and top[1] == "dotted" and len(top[3]) == len(key) - 1)
                rows.append((at, top[0] if top else None, [x[0] for x in stack], direct, orphan))
                stack.append((at, style, number, key))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.bool_(), pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column("_id"), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names)

    rows = df.select(F.col(id).alias("_id"), F.col(pos).cast("long").alias("_pos"), "style", "number", "sort_key")
    out = rows.repartition("_id").sortWithinPartitions("_id", "_pos").mapInArrow(fold, schema)
    return out.select(F.col("_id").alias(id), F.col("_pos").alias(pos), "parent_pos", "path", (F.size("path") + 1).alias("depth"), "is_child", "orphan")


def subtree_content(tree: DataFrame, *, id: str, key: str = "sort_key", text: str = "content") -> DataFrame:
    """Each node's text and those of all its descendants, in key order. The join is on every prefix of a node's key, so it is an equi-join."""
    up = tree.select(id, F.col(key).alias("_full"), F.col(text).alias("_text"), F.explode(F.transform(F.sequence(F.lit(1), F.size(key)), lambda i: F.slice(F.col(key), F.lit(1), i))).alias(key))
    joined = tree.select(id, key).distinct().join(up, [id, key])
    parts = F.array_sort(F.collect_list(F.struct("_full", "_text")))
    return joined.groupBy(id, key).agg(F.array_join(F.transform(parts, lambda p: p["_text"]), "\n").alias("full_content"))


def hierarchical_docs(segments: DataFrame, *, id: str, name: str, share: float = 0.3) -> DataFrame:
    """Per document the share of names that start with a dotted number, and whether it exceeds ``share``."""
    hit = F.avg(F.col(name).rlike(r"^[0-9]+\.[0-9]+").cast("int"))
    return segments.groupBy(id).agg(F.round(hit, 6).alias("share"), (hit > share).alias("is_hierarchical"))


def hierarchy_tags(segments: DataFrame, *, name: str, parent: str) -> DataFrame:
    """Add section_id, section_title from the name, else from the parent heading, and where they came from."""
    pattern = r"^([0-9]+(?:\.[0-9]+)*)[. ]+(.+)$"
    mine, up = F.regexp_extract(F.col(name), pattern, 1), F.regexp_extract(F.coalesce(F.col(parent), F.lit("")), pattern, 1)
    source = F.when(mine != "", "name").when(up != "", "parent").otherwise("none")
    pick = F.when(mine != "", F.col(name)).when(up != "", F.col(parent))
    return segments.withColumn("section_id", F.nullif(F.regexp_extract(pick, pattern, 1), F.lit(""))).withColumn("section_title", F.nullif(F.regexp_extract(pick, pattern, 2), F.lit(""))).withColumn("tag_source", source)


def group_runs(chunks: DataFrame, *, key: str, order: str, category: str) -> DataFrame:
    """Batches of consecutive chunks of one category: key, batch_no, category, first, last, n."""
    w = Window.partitionBy(key).orderBy(order)
    new = F.when(F.lag(category).over(w).eqNullSafe(F.col(category)), 0).otherwise(1)
    runs = chunks.withColumn("_new", new).withColumn("batch_no", F.sum("_new").over(w))
    return runs.groupBy(key, "batch_no", category).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def telemetry(chunks: DataFrame, *, category: str, risk: str, tokens: str, failed: str) -> DataFrame:
    """Counts, failures and tokens per category, per risk level and in total (grouping sets)."""
    return chunks.groupingSets([[F.col(category)], [F.col(risk)], []], F.col(category), F.col(risk)).agg(
        F.count("*").alias("n_chunks"), F.count_if(F.col(failed)).alias("n_failed"), F.sum(tokens).alias("n_tokens"), F.round(F.avg(tokens), 6).alias("mean_tokens"), F.count_if(F.col(tokens) > 1000).alias("n_long"), F.grouping_id().alias("set_id"))


def fallback_sections(df: DataFrame, *, id: str = "doc_id", text: str = "text", caps: str = r"^[A-Z][A-Z ,&'-]{4,}$", numbered: str = r"^([0-9]+)(?:\.[0-9]+)*[.)]? ", least_caps: int = 3, least_numbered: int = 5) -> DataFrame:
    """Documents with enough all-caps lines are cut there, else those with enough numbered lines where the first number changes; others give nothing.

    id, mode, section_no, char_start, char_end, n_lines.
    """
    rows = lines(df, id=id, text=text).withColumn("_c", F.col("line").rlike(caps)).withColumn("_n", F.nullif(F.regexp_extract("line", numbered, 1), F.lit("")))
    every = Window.partitionBy(id)
    w = every.orderBy("line_no")
    rows = rows.withColumn("_nc", F.sum(F.col("_c").cast("int")).over(every)).withColumn("_nn", F.count("_n").over(every))
    mode = F.when(F.col("_nc") >= least_caps, "caps").when(F.col("_nn") >= least_numbered, "numbered")
    last = F.last("_n", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(F.col("mode") == "caps", F.col("_c")).otherwise(F.col("_n").isNotNull() & ~F.col("_n").eqNullSafe(last))
    rows = rows.withColumn("mode", mode).filter("mode IS NOT NULL").withColumn("_b", begins.cast("int")).withColumn("section_no", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.filter("section_no > 0").groupBy(id, "mode", "section_no").agg(F.min("char_start").alias("char_start"), F.max("char_end").alias("char_end"), F.count("*").alias("n_lines"))


def semantic_chunks(sents: DataFrame, *, id: str, order: str, text: str, embed: Embedding = trigram_embed, close_below: float = 0.7, target: int = 1000) -> DataFrame:
    """id, chunk_no, first, last (``order`` of the first and last sentence), n_sentences, n_chars, content.

    Chunks of consecutive sentences: closed where the cosine to the sentence before is under ``close_below`` and the chunk is over half the
    target, or where it is over the target. ``embed`` gives the sentences' vectors, a batch at a time. A task folds its sorted documents batch by batch and holds one open chunk.
    """
    kind = sents.schema[id].dataType.simpleString()
    names = [id, "chunk_no", "first", "last", "n_sentences", "n_chars", "content"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, open_, begun = None, None, False  # open_: chunk_no, numbers of the first and last sentence, characters, parts
        last = None  # the vector of the sentence before
        out, kind_of = [], None

        def close() -> None:
            no, first, end, size, parts = open_
            out.append((doc, no, first, end, len(parts), size, " ".join(parts)))

        for batch in batches:
            kind_of = batch.schema.field("_id").type
            parts = batch.column("_text").to_pylist()
            if not parts:
                continue
            v = np.asarray(embed(parts), float)
            length = np.linalg.norm(v, axis=1)
            before = np.vstack((v[:1] if last is None else last[None], v[:-1]))
            both = length * np.linalg.norm(before, axis=1)
            near = np.divide((v * before).sum(axis=1), both, out=np.zeros(len(both)), where=both > 0).tolist()
            last = v[-1]
            for of, n, part, cosine in zip(batch.column("_id").to_pylist(), batch.column("_n").to_pylist(), parts, near, strict=True):
                if not begun or of != doc:
                    if begun:
                        close()
                    doc, begun, open_ = of, True, [0, n, n, 0, []]
                elif cosine < close_below and open_[3] > target / 2 or open_[3] > target:
                    close()
                    open_ = [open_[0] + 1, n, n, 0, []]
                open_[2] = n
                open_[3] += len(part)
                open_[4].append(part)
            if out:
                yield made(out, kind_of)
                out.clear()
        if begun:
            close()
            yield made(out, kind_of)

    def made(rows: list, kind: pa.DataType) -> pa.RecordBatch:
        kinds = (kind, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    rows = sents.select(F.col(id).alias("_id"), F.col(order).cast("long").alias("_n"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    schema = f"`{id}` {kind}, chunk_no int, first long, last long, n_sentences long, n_chars long, content string"
    return rows.repartition("_id").sortWithinPartitions("_id", "_n").mapInArrow(fold, schema)
