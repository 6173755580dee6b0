"""Catalogue-driven extraction: one job turns texts into a long table of facts; aggregates pivot, merge and count it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedge.functions.words import lines_held


@dataclass(frozen=True)
class FactRule:
    """``group`` of ``pattern`` is a value of ``field``; rules of a field are tried in the catalogue's order.

    ``words``, in lower case, are such that every match holds one of them, without regard to case: texts without any are passed over unread by the pattern. With ``in_line`` no match can
    hold a line's end nor depend on one, and only lines with one of the words are read; with ``line_end`` besides, matches may end with their line's end or depend on it.
    """

    field: str
    pattern: str
    group: int = 0
    confidence: float = 0.8
    words: tuple[str, ...] = ()
    in_line: bool = False
    line_end: bool = False


#: ``$`` fits before a last line end, too, so what is read must go on for two lines to end no line that goes on in the text.
LINES_AFTER = 2


def _clean(value: Column) -> Column:
    return F.rtrim(F.btrim(F.regexp_replace(value, r"[ \t\r\n]+", " "), F.lit(" ")), F.lit(" ,."))


def _tried(df: DataFrame, rules: Sequence, *, id: str, text: str) -> DataFrame:
    """(id, _rule, _x): a row for each text and number of a rule that may match it, and what the rule is to read, which is the whole text or its lines with one of the rule's words.

    ``rules`` have ``words`` and ``in_line`` as those of a ``FactRule``. The outer form is for the optimiser, which adds a filter on the array to the inner one and so would look for the words twice.
    """
    found = lines_held(F.col(text), [r.words for r in rules], [r.in_line for r in rules], [LINES_AFTER * r.line_end for r in rules])
    held = df.select(id, F.col(text).alias("_text"), F.split(text, "\n").alias("_lines"), found.alias("_held"))
    some = lambda h: F.array_join(F.transform(h["lines"], lambda i: F.get("_lines", i)), "\n")
    reads = F.transform("_held", lambda h: F.struct(h["rule"].alias("rule"), F.when(F.size(h["lines"]) > 0, some(h)).otherwise(F.col("_text")).alias("x")))
    return held.select(id, F.explode_outer(reads).alias("_h")).filter("_h IS NOT NULL").select(id, F.col("_h.rule").alias("_rule"), F.col("_h.x").alias("_x"))


def _by_rule(values: Sequence[Column]) -> Column:
    """The value of the row's rule; those of other rules are not computed."""
    out = F.when(F.col("_rule") == 0, values[0])
    for i, value in enumerate(values[1:], 1):
        out = out.when(F.col("_rule") == i, value)
    return out


def _matches(pattern: str, group: int) -> Column:
    return F.transform(F.regexp_extract_all("_x", F.lit(pattern), F.lit(group)), _clean)


def extract_facts(df: DataFrame, rules: Sequence[FactRule], *, id: str, text: str, mode: str = "all", least_chars: int = 3) -> DataFrame:
    """(id, field, value, ordinal, rule_id, confidence). mode "all": every match of every rule; "first": the first match of the first rule that hits."""
    values = F.filter(_by_rule([_matches(r.pattern, r.group) for r in rules]), lambda v: F.length(v) >= least_chars)
    found = _tried(df, rules, id=id, text=text).select(id, "_rule", F.posexplode_outer(values).alias("ordinal", "value")).filter("value IS NOT NULL")
    of_rule = lambda each: F.get(F.array(*map(F.lit, each)), F.col("_rule"))
    rows = found.select(id, of_rule([r.field for r in rules]).alias("field"), "value", "ordinal", F.col("_rule").alias("rule_id"), of_rule([float(r.confidence) for r in rules]).alias("confidence"))
    if mode == "all":
        return rows
    best = rows.groupBy(id, "field").agg(F.min(F.struct("rule_id", "ordinal", "value", "confidence")).alias("b"))
    return best.select(id, "field", "b.value", "b.ordinal", "b.rule_id", "b.confidence")


def extract_pairs(df: DataFrame, pattern: str, *, id: str, text: str, names: tuple[str, str] = ("first", "second")) -> DataFrame:
    """(id, ordinal, first, second): both groups of every match of a pattern with two, such as percentage and threshold or condition and consequence."""
    return extract_pair_kinds(df, {"": pattern}, id=id, text=text, names=names).drop("kind")


def extract_pair_kinds(df: DataFrame, patterns: dict[str, str], *, id: str, text: str, words: dict[str, tuple[str, ...]] | None = None, names: tuple[str, str] = ("first", "second")) -> DataFrame:
    """(id, kind, ordinal, first, second): ``extract_pairs`` of several patterns in one pass. ``words`` of a kind are as those of a ``FactRule`` in a line."""
    rules = [FactRule(kind, pattern, words=(words or {}).get(kind, ()), in_line=True) for kind, pattern in patterns.items()]
    pairs = _by_rule([F.arrays_zip(_matches(r.pattern, 1).alias("a"), _matches(r.pattern, 2).alias("b")) for r in rules])
    found = _tried(df, rules, id=id, text=text).select(id, "_rule", F.posexplode_outer(pairs).alias("ordinal", "_p")).filter("_p IS NOT NULL")
    return found.select(id, F.get(F.array(*[F.lit(r.field) for r in rules]), F.col("_rule")).alias("kind"), "ordinal", F.col("_p.a").alias(names[0]), F.col("_p.b").alias(names[1]))


def iso_date(value: Column) -> Column:
    """m/d/y dates as Y-m-d, two-digit years in the 2000s; month names likewise; what is no such date stays as it is."""
    parts = F.split(value, "/")
    year = F.when(F.length(parts[2]) == 2, F.concat(F.lit("20"), parts[2])).otherwise(parts[2])
    numeric = F.concat_ws("-", year, F.lpad(parts[0], 2, "0"), F.lpad(parts[1], 2, "0"))
    named = F.try_to_timestamp(value, F.lit("MMMM d, yyyy"))
    is_named = value.rlike(r"^[A-Z][a-z]+ [0-9]{1,2}, [0-9]{4}$")
    return F.when(value.rlike(r"^[0-9]{1,2}/[0-9]{1,2}/([0-9]{2}|[0-9]{4})$"), numeric).when(is_named & named.isNotNull(), F.date_format(named, "yyyy-MM-dd")).otherwise(value)


#: Number words.
NUMBER_WORDS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")


def count_of(value: Column) -> Column:
    """A number in digits or in words up to ten; null for anything else."""
    out = F.expr("cast(null as int)")
    for i, w in enumerate(NUMBER_WORDS):
        out = F.when(F.lower(value) == w, i + 1).otherwise(out)
    return F.when(value.rlike("^[0-9]{1,3}$"), value.cast("int")).otherwise(out)


def option_rows(facts: DataFrame, *, id: str, number: str = "renewal_options", term: str = "option_term", most: int = 100) -> DataFrame:
    """(id, option_no, term): one row per renewal option of a text, each with the text's option term; more than ``most`` are taken for a misreading."""
    first = lambda field: F.min_by(F.when(F.col("field") == field, F.col("value")), F.when(F.col("field") == field, F.struct("rule_id", "ordinal")))
    rows = facts.groupBy(id).agg(count_of(first(number)).alias("_n"), first(term).alias("term")).filter(F.col("_n").between(1, most))
    return rows.select(id, F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("option_no"), "term")


def overview(df: DataFrame, *, id: str, text: str, types: Sequence[tuple[str, Sequence[str]]], date: str, amount: str, default: str = "OTHER", first: int = 3, chars_per_page: int = 3000) -> DataFrame:
    """(id, doc_type, dates, amounts, n_words, n_pages): the type is the first of ``types`` (name, words) of which a word is in the text; ``date`` and ``amount`` are patterns whose first group, the first three times, is kept."""
    c = F.coalesce(F.col(text), F.lit(""))
    kind = F.lit(default)
    for name, words in reversed(types):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(F.lower(c), F.lit(w))
        kind = F.when(hit, name).otherwise(kind)
    found = lambda p: F.slice(F.regexp_extract_all(c, F.lit(p), F.lit(1)), 1, first)
    pages = F.greatest(F.lit(1), F.floor(F.length(c) / chars_per_page))
    return df.select(id, kind.alias("doc_type"), found(date).alias("dates"), found(amount).alias("amounts"), F.regexp_count(c, F.lit(r"[^ \t\r\n\f\x0b]+")).cast("long").alias("n_words"), pages.alias("n_pages"))


def parse_key_values(df: DataFrame, fields: Sequence[tuple[str, str]], *, id: str, text: str) -> DataFrame:
    """(id, field, value): ``name: value`` lines of a text that is no JSON. ``fields`` are (field, pattern with one group); of several patterns of a field the last that hits
    counts, with its first match. Values are stripped of blanks, quotes and a last comma; null, none, n/a and empty ones are dropped."""
    rows = []
    for i, (field, pattern) in enumerate(fields):
        hit = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1))
        rows.append(F.struct(F.lit(field).alias("field"), F.lit(i).alias("place"), F.btrim(F.get(hit, F.lit(0)), F.lit(" \t\r\n\"',")).alias("value")))
    each = df.select(id, F.inline(F.array(*rows))).filter("value IS NOT NULL AND lower(value) NOT IN ('', 'null', 'none', 'n/a')")
    return each.groupBy(id, "field").agg(F.max_by("value", "place").alias("value"))


def list_items(facts: DataFrame, *, id: str, field: str) -> DataFrame:
    """(id, field, item_no, item): values that are lists, split at commas, semicolons and a last "and"."""
    items = F.filter(F.transform(F.split("value", r",\s*and\s+|\s+and\s+|[,;]"), lambda c: F.btrim(c, F.lit(" "))), lambda c: c != "")
    return facts.filter(F.col("field") == field).select(id, "field", F.posexplode(items).alias("item_no", "item"))


def merge_facts(primary: DataFrame, secondary: DataFrame, *, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Per key the primary value, else the secondary one (full outer join)."""
    a = primary.select(*keys, F.col(value).alias("_a"))
    b = secondary.select(*keys, F.col(value).alias("_b"))
    return a.join(b, list(keys), "full_outer").select(*keys, F.coalesce("_a", "_b").alias(value), F.when(F.col("_a").isNotNull(), "primary").otherwise("secondary").alias("origin"))


def facts_wide(facts: DataFrame, fields: Sequence[str], *, id: str) -> DataFrame:
    """One column per field: its first value."""
    return facts.groupBy(id).pivot("field", list(fields)).agg(F.min_by("value", F.struct("rule_id", "ordinal")))


def coverage(docs: DataFrame, facts: DataFrame, *, id: str, by: str) -> DataFrame:
    """Per group: documents, documents with any fact, facts, distinct fields, share covered."""
    per_doc = facts.groupBy(id).agg(F.count("*").alias("_n"), F.collect_set("field").alias("_f"))
    rows = docs.select(id, by).join(per_doc, id, "left")
    out = rows.groupBy(by).agg(F.count("*").alias("n_docs"), F.count("_n").alias("n_with"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n_facts"), F.size(F.array_distinct(F.flatten(F.collect_set("_f")))).alias("n_fields"))
    return out.withColumn("share", F.round(F.col("n_with") / F.col("n_docs"), 6))


def _word_list(c: Column | str) -> Column:
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def resolve_terms(df: DataFrame, terms: DataFrame, *, id: str, text: str, term: str, definition: str) -> DataFrame:
    """(id, term, definition) of the terms contained in a text: runs of as many words as terms have are joined to them, so the dictionary may be large."""
    dim = terms.select(F.array_join(_word_list(term), " ").alias("_w"), F.size(_word_list(term)).alias("_k"), F.col(term), F.col(definition)).filter("_k > 0")
    lengths = sorted(r["_k"] for r in dim.select("_k").distinct().collect())

    def runs_of(k: int) -> Column:
        run = lambda i: F.array_join(F.slice("_t", i, F.lit(k)), " ")
        return F.when(F.size("_t") >= k, F.transform(F.sequence(F.lit(1), F.size("_t") - (k - 1)), run)).otherwise(F.array().cast("array<string>"))

    every = F.flatten(F.array(*map(runs_of, lengths))) if lengths else F.array().cast("array<string>")
    tokens = df.select(id, _word_list(text).alias("_t")).select(id, F.explode(F.array_distinct(every)).alias("_w"))
    return tokens.join(dim.drop("_k"), "_w").select(id, term, definition)


def deadline(base: Column, n: Column, unit: Column, sign: int = 1) -> Column:
    """Base date plus n days, months of 30 days or years of 365 days."""
    days = F.when(F.lower(unit).startswith("year"), n * 365).when(F.lower(unit).startswith("month"), n * 30).otherwise(n)
    return F.date_add(base, (sign * days).cast("int"))


def totals(*, base: Column, share: Column, pct: Column, others: Column) -> tuple[Column, Column]:
    """(subtotal, annual): base + pct + share + others, and (base + share + others) x 12."""
    extra = F.aggregate(F.map_values(others), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
    return base + pct + share + extra, (base + share + extra) * 12
