"""Row gates, filters and classifiers over a table of texts. All are projections: no shuffle, no Python."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedge.functions.joins import containment_join
from sedge.functions.rules import RuleSet, contains_any, present

BLANK = r"[ \t\r\n\f\x0b]"


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def quality_gate(df: DataFrame, *, text: str = "text", scanned_share: float = 0.3, min_chars: int = 200, min_solid: int = 100, min_lines: int = 5, empty_below: int = 20) -> DataFrame:
    """Add n_chars, n_solid (not blank), n_lines, odd_share (code over 126), scanned, meaningful, empty_page."""
    c = F.col(text)
    out = df.withColumn("n_chars", F.length(c).cast("long")).withColumn("n_solid", F.length(F.regexp_replace(c, BLANK, "")).cast("long"))
    out = out.withColumn("n_lines", F.size(F.split(c, "\n")).cast("long"))
    odd = F.length(F.regexp_replace(c, r"[\x00-\x7e]", ""))
    out = out.withColumn("odd_share", F.round(F.coalesce(F.try_divide(odd, F.length(c)), F.lit(0.0)), 6))
    return (
        out.withColumn("scanned", F.col("odd_share") > scanned_share)
        .withColumn("meaningful", (F.col("n_chars") > min_chars) & (F.col("n_solid") > min_solid) & (F.col("n_lines") > min_lines))
        .withColumn("empty_page", F.col("n_solid") < empty_below)
    )


def min_length(df: DataFrame, n: int, *, text: str = "text", strip: bool = False) -> DataFrame:
    """Add reject_reason: null for texts of at least n characters, else why they go."""
    size = F.length(F.trim(F.col(text)) if strip else F.col(text))
    reason = F.when(F.col(text).isNull(), "null").when(size == 0, "empty").when(size < n, F.lit(f"under {n}"))
    return df.withColumn("reject_reason", reason)


def drop_boilerplate(df: DataFrame, keywords: Sequence[str], *, text: str = "text", head: int = 500, max_chars: int = 1500) -> DataFrame:
    """Drop short texts (under max_chars) whose first ``head`` characters hold a keyword."""
    found = contains_any(F.lower(F.left(F.col(text), F.lit(head))), keywords)
    return df.filter(~(found & (F.length(text) < max_chars)))


def template_marks(df: DataFrame, patterns: Sequence[str], *, text: str = "text", more_than: int = 5, kinds: int = 3) -> DataFrame:
    """Add n_marks (all hits of all patterns), n_kinds (patterns that hit), is_template, warn_template."""
    marks, seen = F.lit(0).cast("long"), F.lit(0).cast("long")
    for p in patterns:
        marks = marks + count_of(F.col(text), p)
        seen = seen + F.col(text).rlike(p).cast("long")
    return df.withColumn("n_marks", marks).withColumn("n_kinds", seen).withColumn("is_template", F.col("n_marks") > more_than).withColumn("warn_template", F.col("n_kinds") >= kinds)


def classify_docs(df: DataFrame, wanted: RuleSet, others: RuleSet, *, text: str = "text", wanted_name: str, other_over: float = 4.0, wanted_from: float = 5.0) -> DataFrame:
    """Weighted votes: the best other group over ``other_over`` wins, else ``wanted_name`` from ``wanted_from``, else unknown."""
    low = F.lower(F.col(text))
    score = wanted.score(low, wanted.groups()[0])
    best = others.best(low)
    out = df.withColumn("_w", score).withColumn("_o", best)
    kind = F.when(F.col("_o.score") > other_over, F.col("_o.group")).when(F.col("_w") >= wanted_from, F.lit(wanted_name)).otherwise("unknown")
    sure = F.when(F.col("_o.score") > other_over, F.least(F.col("_o.score") / 10, F.lit(0.95))).when(F.col("_w") >= wanted_from, F.least(F.col("_w") / 15, F.lit(0.95))).otherwise(0.3)
    return out.withColumn("doc_class", kind).withColumn("class_confidence", F.round(sure, 6)).drop("_w", "_o")


def missing_terms(df: DataFrame, terms: Sequence[str], *, text: str = "text") -> DataFrame:
    """Add missing: the terms that do not occur as whole words (ASCII word boundaries), in order."""
    low = F.col("_low")
    # A term that is nowhere in the text needs no pattern; the lower-cased text is made once.
    lacks = [F.when(~(F.contains(low, F.lit(t)) & low.rlike(rf"(^|[^a-z0-9_]){t}([^a-z0-9_]|$)")), F.lit(t)) for t in terms]
    return df.withColumn("_low", F.lower(F.col(text))).withColumn("missing", F.array_compact(F.array(*lacks))).drop("_low")


def doc_profile(df: DataFrame, *, text: str = "text") -> DataFrame:
    """Add n_words, n_lines, n_pages (markers), has_table, has_money, has_email, has_number."""
    c = F.col(text)
    return (
        df.withColumn("n_words", count_of(c, r"[^ \t\r\n\f\x0b]+"))
        .withColumn("n_lines", F.size(F.split(c, "\n")).cast("long"))
        .withColumn("n_pages", count_of(c, r"(?m)^--- PAGE [0-9]+ ---"))
        .withColumn("has_table", c.rlike(r"\|[^\n]*\|"))
        .withColumn("has_money", c.rlike(r"\$ ?[0-9]"))
        .withColumn("has_email", c.rlike(r"[A-Za-z0-9._-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"))
        .withColumn("has_number", c.rlike(r"[0-9]{3,}"))
    )


def categorise(df: DataFrame, aliases: DataFrame, *, name: str, category: str = "category", alias: str = "alias", ordinal: str = "ordinal") -> DataFrame:
    """Add category: the one named exactly (lower case, blanks as underscores), else the first by ordinal with an alias inside the name.

    Distinct names meet the aliases once.
    """
    dim = aliases.select(F.col(category).alias("_cat"), F.col(alias).alias("_alias"), F.col(ordinal).alias("_ord"))
    low = F.lower(F.col(name))
    names = df.select(F.col(name).alias("_name")).distinct().withColumn("_low", F.lower("_name"))
    inside = containment_join(names, dim, text="_low", phrase="_alias").groupBy("_name").agg(F.min_by("_cat", "_ord").alias("_inside"))
    exact = dim.select(F.col("_cat").alias("_exact")).distinct()
    out = df.join(exact, F.replace(low, F.lit(" "), F.lit("_")) == F.col("_exact"), "left").join(inside, F.col(name) == F.col("_name"), "left")
    return out.withColumn("category", F.coalesce("_exact", "_inside")).drop("_exact", "_name", "_inside")


def infer_type(df: DataFrame, indicators: Sequence[tuple[str, Sequence[str]]], *, text: str = "text") -> DataFrame:
    """Add type and votes: the type with most of its indicators contained; ties to the first; none gives null."""
    low = F.lower(F.col(text))
    scored = F.array(*[
        F.struct(sum((F.contains(low, F.lit(w)).cast("long") for w in words), F.lit(0).cast("long")).alias("votes"), F.lit(-i).alias("rank"), F.lit(t).alias("type"))
        for i, (t, words) in enumerate(indicators)
    ])
    out = df.withColumn("_top", F.array_max(scored))
    return out.withColumn("type", F.when(F.col("_top.votes") > 0, F.col("_top.type"))).withColumn("votes", F.col("_top.votes")).drop("_top")


def route(df: DataFrame, routes: Sequence[tuple[str, Sequence[str]]], *, name: str, default: str, head: int | None = None) -> DataFrame:
    """Add route: the first entry one of whose words occurs in the name (or its first ``head`` characters)."""
    low = F.lower(F.left(F.col(name), F.lit(head)) if head else F.col(name))
    out = None
    for target, words in routes:
        hit = contains_any(low, words)
        out = F.when(hit, target) if out is None else out.when(hit, target)
    return df.withColumn("route", out.otherwise(default) if out is not None else F.lit(default))


def flag_review(df: DataFrame, *, confidence: str = "confidence", n_tags: str = "n_tags", below: float = 0.6) -> DataFrame:
    """Add needs_review (low confidence without tags) and use: skipped under .4, weak under .7, else normal."""
    c = F.col(confidence)
    use = F.when(c < 0.4, "skip").when(c < 0.7, "weak").otherwise("normal")
    return df.withColumn("needs_review", (c < below) & (F.col(n_tags) == 0)).withColumn("use", use)


def risk_counts(df: DataFrame, *, level: str = "level", keys: Sequence[str] = ()) -> DataFrame:
    """Counts per level for each key group."""
    counts = [F.count_if(F.col(level) == v).alias(f"n_{v}") for v in ("high", "medium", "low")]
    return df.groupBy(*keys).agg(*counts, F.count("*").alias("n_all"))


def traceability(df: DataFrame, *, key: str, page: str, text: str, head: int = 200) -> DataFrame:
    """(key, page, sample) of the rows that have a page."""
    sample = F.concat(F.left(F.col(text), F.lit(head)), F.lit("..."))
    return df.filter(F.col(page).isNotNull()).select(key, page, sample.alias("sample"))


def evidence(df: DataFrame, keywords: Sequence[str], *, text: str = "text", context: int = 30, head: int = 100) -> DataFrame:
    """Add evidence: a window of ``context`` characters around the earliest keyword, grown to blanks; no hit gives the head of the text."""
    c, low = F.col(text), F.lower(F.col(text))
    hits = F.filter(F.array(*[F.struct(F.instr(low, w.lower()).alias("at"), F.lit(len(w)).alias("size")) for w in keywords]), lambda h: h["at"] > 0)
    out = df.withColumn("_hit", F.array_min(hits))
    begin = F.greatest(F.lit(1), F.col("_hit.at") - context)
    end = F.least(F.length(c) + 1, F.col("_hit.at") + F.col("_hit.size") + context)
    before, after = F.substring(c, F.lit(1), begin - 1), F.substring(c, end, F.length(c))
    grown = F.concat(F.regexp_extract(before, r"[^ \t\r\n]*\z", 0), F.substring(c, begin, end - begin), F.regexp_extract(after, r"^[^ \t\r\n]*", 0))
    left = F.length(F.regexp_extract(before, r"[^ \t\r\n]*\z", 0)) < F.length(before)
    right = F.length(F.regexp_extract(after, r"^[^ \t\r\n]*", 0)) < F.length(after)
    window = F.concat(F.when(left, "...").otherwise(""), grown, F.when(right, "...").otherwise(""))
    return out.withColumn("evidence", F.when(F.col("_hit").isNull(), F.concat(F.left(c, F.lit(head)), F.lit("..."))).otherwise(window)).drop("_hit")


def headings_present(df: DataFrame, names: Sequence[str], *, text: str = "text") -> DataFrame:
    """Add headings: the known headings that occur, without regard to case."""
    return df.withColumn("headings", present(F.lower(F.col(text)), [n.lower() for n in names]))


def short_critical(df: DataFrame, names: Sequence[str], *, name: str, text: str, below: int = 100) -> DataFrame:
    """Sections with a critical name whose text is under ``below`` characters."""
    return df.filter(F.lower(F.col(name)).isin([n.lower() for n in names]) & (F.length(text) < below))
