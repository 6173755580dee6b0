"""Roll-ups, audit statistics and feedback analytics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedge.functions.joins import containment_join, percentiles


def complexity(df: DataFrame, *, doc: str, xref: Column, conditional: Column, financial: Column, table: Column) -> DataFrame:
    """min(n/2, 30) + min(2 xrefs, 20) + min(5 conditions, 20) + min(3 financial, 20) + min(5 tables, 10), at most 100."""
    c = df.groupBy(doc).agg(F.count("*").alias("n"), F.count_if(xref).alias("x"), F.count_if(conditional).alias("c"), F.count_if(financial).alias("f"), F.count_if(table).alias("t"))
    score = F.least(F.col("n") / 2, F.lit(30.0)) + F.least(2 * F.col("x"), F.lit(20)) + F.least(5 * F.col("c"), F.lit(20)) + F.least(3 * F.col("f"), F.lit(20)) + F.least(5 * F.col("t"), F.lit(10))
    return c.select(doc, F.least(F.lit(100), F.floor(score)).cast("int").alias("complexity"))


def entity_timeline(events: DataFrame, *, entity: str, ts: str, id: str) -> DataFrame:
    """Each entity's events numbered by time, with seconds since the one before."""
    w = Window.partitionBy(entity).orderBy(ts, id)
    gap = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(F.col(ts).cast("timestamp")).over(w))) / 1e6
    return events.select(entity, id, F.row_number().over(w).alias("step"), F.round(gap, 3).alias("gap_s"))


def stats(events: DataFrame, *, entity: str, kinds: Sequence[str], kind: str, value: str) -> DataFrame:
    """Counts per kind and sums per entity and in total (grouping sets)."""
    return events.groupingSets([[F.col(entity)], []], F.col(entity)).agg(F.count("*").alias("n_events"), *[F.count_if(F.col(kind) == k).alias(f"n_{k}") for k in kinds], F.round(F.avg(value), 6).alias("mean_value"))


def export_slice(events: DataFrame, *, ts: str, start: str, end: str) -> DataFrame:
    """Rows within [start, end]; the filter reaches the scan."""
    return events.filter(F.col(ts).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))


def latency(events: DataFrame, *, operation: str, ms: str) -> DataFrame:
    """Per operation: number, mean, least, largest, total and 95th percentile."""
    sums = events.groupBy(operation).agg(F.count("*").alias("n"), F.round(F.avg(ms), 6).alias("mean_ms"), F.min(ms).alias("min_ms"), F.max(ms).alias("max_ms"), F.round(F.sum(F.col(ms).cast("decimal(18,4)")).cast("double"), 4).alias("total_ms"))
    high = percentiles(events, by=[operation], value=ms, p=0.95).select(operation, F.round("percentile", 6).alias("p95_ms"))
    return sums.join(high, operation, "left")


def pair_spans(events: DataFrame, *, entity: str, ts: str, id: str, is_start: Column, is_end: Column) -> DataFrame:
    """Each end is matched with the entity's latest start before it, if no other end lies between: start id, end id, seconds (0 if unmatched)."""
    w = Window.partitionBy(entity).orderBy(ts, id)
    marked = events.filter(is_start | is_end).withColumn("_s", is_start).withColumn("_prev_start", F.lag(F.col("_s")).over(w)).withColumn("_prev_id", F.lag(id).over(w)).withColumn("_prev_ts", F.lag(ts).over(w))
    hit = F.coalesce(F.col("_prev_start"), F.lit(False))
    seconds = F.when(hit, F.round((F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("_prev_ts").cast("timestamp"))) / 1e6, 3)).otherwise(0.0)
    return marked.filter(~F.col("_s")).select(entity, F.when(hit, F.col("_prev_id")).alias("start_id"), F.col(id).alias("end_id"), seconds.alias("seconds"))


def last_n(df: DataFrame, *, key: str, order: Sequence[str], n: int | None = None) -> DataFrame:
    """The last n rows per key (all, if n is None), numbered in ascending order."""
    if n is None:
        return df.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    down = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    up = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(down)).filter(F.col("_r") <= n).withColumn("nth", F.row_number().over(up)).drop("_r")


def latest(df: DataFrame, *, order: Sequence[str], n: int = 10) -> DataFrame:
    """The last n rows of the whole table; each task hands on n at most."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)


def group_stats(df: DataFrame, *, doc: str, group: Column) -> DataFrame:
    """Totals and per-group counts (grouping sets) with distinct documents."""
    rows = df.withColumn("field_group", group)
    return rows.groupingSets([[F.col("field_group")], []], F.col("field_group")).agg(F.count("*").alias("n"), F.countDistinct(doc).alias("n_docs"))


def _literal(text: Column) -> Column:
    """Regular expression for the very characters of ``text``."""
    return F.concat(F.lit("\\Q"), F.replace(text, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def apply_corrections(df: DataFrame, *, doc: str, text: str, corrections: DataFrame, order: str, old: str, new: str) -> DataFrame:
    """Apply a document's corrections to its text in order: doc, corrected, n_corrections, n_skipped, latest (the largest ``order``), spans.

    A correction replaces all places of its old text, from the left, but only in text that no correction before it has changed: what was inserted is not corrected again, and
    text on both sides of a changed place is not one. A correction whose old text is there, but touches changed text everywhere, is skipped and
    counted. ``spans`` are the changed places (start, end) in the corrected text. Only documents whose text changes come out. Corrections with an empty or null old text do
    nothing, a null new text deletes; equal ``order`` goes by old, then new text.

    The state of the fold is the text in pieces, each changed or not, so offsets need no shifting.
    """
    folded = corrections.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.coalesce(old, F.lit("")).alias("old"), F.coalesce(new, F.lit("")).alias("new")))).alias("_c"))
    joined = df.select(doc, F.col(text).alias("_t")).filter("_t IS NOT NULL").join(folded, doc)
    piece = lambda t, changed: F.struct(t.alias("t"), F.lit(changed).alias("changed"))

    def cut(p: Column, c: Column) -> Column:
        parts = F.split(p["t"], _literal(c["old"]), -1)
        return F.when(p["changed"], F.array(p)).otherwise(F.flatten(F.transform(parts, lambda x, i: F.when(i == 0, F.array(piece(x, False))).otherwise(F.array(piece(c["new"], True), piece(x, False))))))

    def step(s: Column, c: Column) -> Column:
        pieces = F.flatten(F.transform(s["pieces"], lambda p: cut(p, c)))
        seen = F.contains(F.array_join(F.transform(s["pieces"], lambda p: p["t"]), ""), c["old"])
        skips = F.when(seen & (F.size(pieces) == F.size(s["pieces"])), 1).otherwise(0)
        return F.when(c["old"] == "", s).otherwise(F.struct(pieces.alias("pieces"), (s["skipped"] + skips).alias("skipped")))

    start = F.struct(F.array(piece(F.col("_t"), False)).alias("pieces"), F.lit(0).alias("skipped"))
    done = joined.withColumn("_s", F.aggregate("_c", start, step))

    def place(s: Column, p: Column) -> Column:
        end = s["at"] + F.length(p["t"])
        spans = F.when(p["changed"], F.array_append(s["spans"], F.struct(s["at"].alias("start"), end.alias("end")))).otherwise(s["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    out = done.withColumn("corrected", F.array_join(F.transform("_s.pieces", lambda p: p["t"]), "")).filter("corrected <> _t")
    return out.select(doc, "corrected", F.size("_c").alias("n_corrections"), F.col("_s.skipped").alias("n_skipped"), F.array_max(F.transform("_c", lambda c: c["at"])).alias("latest"), F.aggregate("_s.pieces", empty, place)["spans"].alias("spans"))


def first_contained(left: DataFrame, right: DataFrame, *, text: str, name: str, ordinal: str, id: str) -> DataFrame:
    """For each row of ``left`` the first row of ``right`` whose name lies in the text."""
    dim = right.select(F.lower(name).alias("_n"), F.col(name).alias("_name"), F.col(ordinal).alias("_o"))
    texts = left.select(id, F.lower(text).alias("_t"))
    return containment_join(texts, dim, text="_t", phrase="_n").groupBy(id).agg(F.min_by("_name", "_o").alias("matched"))


def error_rates(feedback: DataFrame, items: DataFrame, *, key: str, confidence: str) -> DataFrame:
    """Corrections per item in each group, with the items' mean confidence."""
    f = feedback.groupBy(key).agg(F.count("*").alias("n_feedback"))
    i = items.groupBy(key).agg(F.count("*").alias("n_items"), F.round(F.avg(confidence), 6).alias("mean_confidence"))
    return i.join(f, key, "left").withColumn("n_feedback", F.coalesce("n_feedback", F.lit(0)).cast("long")).withColumn("rate", F.round(F.try_divide("n_feedback", "n_items"), 6))


def structure_flags(df: DataFrame, *, doc: str, flags: dict[str, Column], kinds: Sequence[tuple[str, Column]], otherwise: str = "other") -> DataFrame:
    """Per document: each flag (does any clause fulfil it), the number of clauses, and the first kind that any clause fulfils."""
    kind = F.lit(otherwise)
    for name, condition in reversed(kinds):
        kind = F.when(F.bool_or(condition), name).otherwise(kind)
    return df.groupBy(doc).agg(*[F.bool_or(c).alias(k) for k, c in flags.items()], F.count("*").alias("n"), kind.alias("kind"))


def financial_summary(df: DataFrame, *, doc: str, order: str, amount: str, extra: str, is_extra: Column) -> DataFrame:
    """Per document: the last amount, the sum of all, and the extra charges in order."""
    extras = F.transform(F.array_sort(F.collect_list(F.when(is_extra, F.struct(order, extra)))), lambda x: x[extra])
    total = F.sum(F.col(amount).cast("decimal(18,2)")).cast("double").alias("total")
    return df.groupBy(doc).agg(F.max_by(amount, order).alias("last_price"), total, F.nullif(F.array_join(extras, "|"), F.lit("")).alias("extras"))


def date_timeline(df: DataFrame, *, doc: str, date: str, ties: Sequence[str]) -> DataFrame:
    """``df`` with d (the date) and nth, its place among the document's dates; ties go by ``ties``. Rows without a date are left out."""
    w = Window.partitionBy(doc).orderBy(date, *ties)
    return df.filter(F.col(date).isNotNull()).withColumn("d", F.to_date(date)).withColumn("nth", F.row_number().over(w))


def section_rollup(df: DataFrame, *, by: Sequence[str], size: str, present: dict[str, Column]) -> DataFrame:
    """Per section: items, their size and whether any shows each feature."""
    return df.groupBy(*by).agg(F.count("*").alias("n_docs"), F.sum(size).alias("n_chars"), *[F.bool_or(c).alias(k) for k, c in present.items()])


def executive(df: DataFrame, *, keep: Sequence[str], text: str, flags: Column, levels: Sequence[str] = ("high", "medium"), chars: int = 100) -> DataFrame:
    """One row per flag of one of ``levels``: the kept columns, its rule and the text's beginning in place of the text."""
    rows = df.select(*keep, F.left(text, F.lit(chars)).alias("excerpt"), F.explode(F.filter(flags, lambda h: h["level"].isin(*levels))).alias("_f"))
    return rows.select(*keep, F.col("_f.name").alias("rule"), "excerpt")


def select_sections(df: DataFrame, sections: DataFrame, *, id: str, text: str, section: str = "section", keyword: str = "keyword") -> DataFrame:
    """(id, section): the sections of which a keyword lies in the text."""
    return containment_join(df.select(id, text), sections.select(section, keyword), text=text, phrase=keyword).select(id, section).distinct()


def ordered_sections(df: DataFrame, sections: DataFrame, *, id: str, text: str, kind: str, section: str = "section", keyword: str = "keyword", place: str = "place") -> DataFrame:
    """(id, section, nth): the report sections that a document's type asks for, of which a keyword lies in the text, in the type's order.

    ``sections`` has a row per type (null: for every type), section and keyword with the section's place; a type's own place goes before that for every type.
    """
    dim = sections.select(F.col(kind).alias("_kind"), section, keyword, F.col(place).alias("_place"))
    hits = containment_join(df.select(id, F.col(kind).alias("_own"), text), dim, text=text, phrase=keyword).filter("_kind IS NULL OR _kind = _own")
    best = hits.groupBy(id, section).agg(F.min(F.struct(F.col("_kind").isNull().alias("general"), "_place")).alias("_b"))
    return best.select(id, section, F.row_number().over(Window.partitionBy(id).orderBy("_b._place", section)).alias("nth"))


def validation_events(issues: DataFrame, *, doc: str, is_issue: Column, is_high: Column, each: int = 5) -> DataFrame:
    """Per document: issues, high ones, and a score of 100 less ``each`` per issue, 0 at least."""
    n = F.count_if(is_issue)
    return issues.groupBy(doc).agg(n.alias("n_issues"), F.count_if(is_issue & is_high).alias("n_high"), F.greatest(F.lit(0), 100 - each * n).alias("score"))


def document_card(df: DataFrame, *, doc: str, order: str, first: dict[str, str], last: dict[str, str]) -> DataFrame:
    """Per document: the first value of some columns and the last of others, as {new name: column}; nulls are passed over."""
    at = lambda c: F.when(F.col(c).isNotNull(), F.col(order))
    return df.groupBy(doc).agg(*[F.min_by(c, at(c)).alias(k) for k, c in first.items()], *[F.max_by(c, at(c)).alias(k) for k, c in last.items()])


def run_card(runs: DataFrame, *parts: DataFrame, key: str) -> DataFrame:
    """``runs`` with the counts of each part (one row per key, its other columns numbers), 0 where a part has no row."""
    out = runs
    for part in parts:
        names = [c for c in part.columns if c != key]
        out = out.join(part, key, "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in names})
    return out


def derive_events(decisions: DataFrame, risks: DataFrame, *, id: str, decision: tuple[str, Column], risk: tuple[str, str]) -> DataFrame:
    """(id, event_type, subject, detail): an audit row per decision (subject column, detail) and per risk (subject and detail columns)."""
    r = risks.select(id, F.lit("risk").alias("event_type"), F.col(risk[0]).alias("subject"), F.col(risk[1]).alias("detail"))
    return r.unionByName(decisions.select(id, F.lit("decision").alias("event_type"), F.col(decision[0]).alias("subject"), decision[1].alias("detail")))


def kpis(df: DataFrame, *, ts: str, period: str, value: Column, flagged: Column) -> DataFrame:
    """Per period: count, value, flagged, each with the change in percent to the period before."""
    p = df.groupBy(F.date_trunc(period, ts).alias("period")).agg(F.count("*").alias("n"), F.round(F.sum(value.cast("decimal(18,2)")).cast("double"), 2).alias("total"), F.count_if(flagged).alias("n_flagged"))
    w = Window.orderBy("period")  # one row per period
    change = lambda c: F.round(F.try_divide(100.0 * (F.col(c) - F.lag(c).over(w)), F.lag(c).over(w)), 6)
    return p.withColumn("n_change", change("n")).withColumn("total_change", change("total")).withColumn("flagged_change", change("n_flagged"))
