"""Clause reconciliation: best per type, merges, distinct tags, sentinel rows. Keys always hold the document id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clause_score(*, confidence: Column, content: Column, n_fields: Column, needs_review: Column) -> Column:
    """100 x confidence, less 50 for a placeholder text, plus 5 a field and up to 10 for length, less 20 for review."""
    empty = F.contains(F.lower(content), F.lit("no information found"))
    return 100 * confidence - F.when(empty, 50).otherwise(0) + 5 * n_fields + F.least(F.length(content) / 100, F.lit(10.0)) - F.when(needs_review, 20).otherwise(0)


def best_per_type(df: DataFrame, *, doc: str, kind: str, score: Column, ordinal: str) -> DataFrame:
    """The row with the highest score per (document, type); ties to the smallest ordinal."""
    w = Window.partitionBy(doc, kind).orderBy(F.desc("score"), ordinal)
    return df.withColumn("score", F.round(score, 6)).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def reconcile(parent: DataFrame, child: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """Full outer join of (keys, confidence, fields map): the higher confidence wins (parent on ties); a winning child's fields override the parent's."""
    p = parent.select(*keys, F.col("confidence").alias("pc"), F.col("fields").alias("pf"))
    c = child.select(*keys, F.col("confidence").alias("cc"), F.col("fields").alias("cf"))
    both = p.join(c, list(keys), "full_outer")
    child_wins = F.col("pc").isNull() | (F.col("cc") > F.col("pc"))
    empty = F.expr("cast(map() as map<string, string>)")
    pf, cf = F.coalesce("pf", empty), F.coalesce("cf", empty)
    merged = F.map_concat(F.map_filter(pf, lambda k, _: ~F.map_contains_key(cf, k)), cf)
    origin = F.when(F.col("pc").isNull(), "inferred").when(F.col("cc").isNull(), "parent").when(child_wins, "child").otherwise("parent")
    return both.select(*keys, origin.alias("origin"), F.when(child_wins, F.col("cc")).otherwise(F.col("pc")).alias("confidence"), F.when(child_wins, merged).otherwise(pf).alias("fields"))


def reconcile_tags(parent: DataFrame, child: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """``reconcile`` for rows that also have ``tags`` (array of struct<type, level>): where the child wins, the parent's tags and then the child's, each type once; else the winner's own."""
    both = reconcile(parent, child, keys=keys)
    p, c = parent.select(*keys, F.col("tags").alias("_pt")), child.select(*keys, F.col("tags").alias("_ct"))
    none = F.array().cast(parent.schema["tags"].dataType)
    rows = both.join(p, list(keys), "left").join(c, list(keys), "left").withColumn("_pt", F.coalesce("_pt", none)).withColumn("_ct", F.coalesce("_ct", none))
    seen = lambda kept, x: F.exists(kept, lambda k: k["type"].eqNullSafe(x["type"]))
    united = F.aggregate(F.concat("_pt", "_ct"), none, lambda kept, x: F.when(seen(kept, x), kept).otherwise(F.array_append(kept, x)))
    tags = F.when(F.col("origin").isin("child", "inferred"), united).otherwise(F.col("_pt"))
    return rows.withColumn("tags", tags).drop("_pt", "_ct")


def structure_context(df: DataFrame, *, doc: str, order: str, section: str, terms: str, roles: str, refs: str, exhibits: str, tables: str) -> DataFrame:
    """What a document's segments say together: outline (sections in order), terms and roles (name and value, the last segment's value wins), all references in order, n_tables, distinct exhibits.

    ``terms`` and ``roles`` are maps, ``refs`` and ``exhibits`` arrays, ``tables`` a number. Lists come out sorted by name; a document's names meet in one task, not its texts.
    """
    last = lambda c: df.select(doc, order, F.explode(c).alias("_k", "_v")).groupBy(doc, "_k").agg(F.max_by("_v", order).alias("_v")).groupBy(doc).agg(F.array_sort(F.collect_list(F.concat_ws("=", "_k", "_v"))).alias(c))
    own = df.groupBy(doc).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(order, section))), lambda x: x[section]).alias("outline"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col(refs).isNotNull(), F.struct(order, refs)))), lambda x: x[refs])).alias("refs"),
        F.coalesce(F.sum(tables), F.lit(0)).cast("long").alias("n_tables"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(exhibits)))).alias("exhibits"),
    )
    none = F.array().cast("array<string>")
    out = own.join(last(terms), doc, "left").join(last(roles), doc, "left")
    return out.withColumns({c: F.coalesce(c, none) for c in (terms, roles)})


def merge_leaves(leaves: DataFrame, *, doc: str, path: str, order: str, value: str, is_list: str) -> DataFrame:
    """Deep merge of flattened results: at a scalar path the first chunk wins, at a list path all values are appended in chunk order."""
    grouped = leaves.groupBy(doc, path).agg(F.bool_or(is_list).alias("_l"), F.min_by(value, order).alias("_first"), F.array_sort(F.collect_list(F.struct(order, value))).alias("_all"))
    joined = F.array_join(F.transform("_all", lambda x: x[value]), "|")
    return grouped.select(doc, path, F.when(F.col("_l"), joined).otherwise(F.col("_first")).alias("merged"))


def distinct_work(df: DataFrame, key: Column, work, *, result: str) -> DataFrame:
    """Do expensive work once per distinct content: hash, distinct, ``work`` (DataFrame -> DataFrame with _key and result), join back."""
    keyed = df.withColumn("_key", F.md5(key))
    once = work(keyed.dropDuplicates(["_key"])).select("_key", result)
    return keyed.join(once, "_key").drop("_key")


def first_per(df: DataFrame, *, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in the given order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def page_range(df: DataFrame, *, text: str) -> DataFrame:
    """Add page_start and page_end from "a-b", "a–b" or "a"."""
    pattern = r"^\s*([0-9]+)\s*(?:[-–]\s*([0-9]+))?\s*$"
    a, b = (F.expr("try_cast(nullif(regexp_extract({c}, '{p}', {i}), '') as int)".format(c=text, p=pattern.replace("\\", "\\\\"), i=i)) for i in (1, 2))
    return df.withColumn("page_start", a).withColumn("page_end", F.coalesce(b, a))


def attach_parents(clauses: DataFrame, tree: DataFrame, *, node: str, parent: str, label: str) -> DataFrame:
    """Add the label of a clause's node and that of the node's parent."""
    own = tree.select(F.col(node), F.col(parent).alias("_p"), F.col(label).alias("own_label"))
    up = tree.select(F.col(node).alias("_p"), F.col(label).alias("parent_label"))
    return clauses.join(own, node, "left").join(up, "_p", "left").drop("_p")


def fill_empty(docs: DataFrame, clauses: DataFrame, *, doc: str, text: str, few: int = 3) -> DataFrame:
    """Sentinel rows: failed (no clause at all; confidence .1, high risk) or overview (fewer than ``few`` clauses; confidence .5)."""
    counts = docs.select(doc, text).join(clauses.groupBy(doc).agg(F.count("*").alias("_n")), doc, "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    kind = F.when(F.col("_n") == 0, "failed").otherwise("overview")
    return counts.filter(F.col("_n") < few).select(doc, kind.alias("clause_key"), F.when(F.col("_n") == 0, 0.1).otherwise(0.5).alias("confidence"), F.when(F.col("_n") == 0, "high").alias("risk_level"), F.left(text, F.lit(500)).alias("content"))


def enrich(clauses: DataFrame, facts: DataFrame, *, doc: str, name: str, words: dict[str, Sequence[str]]) -> DataFrame:
    """Clauses whose name holds a family's word get that family's best fact (value and the higher confidence)."""
    family = None
    for f, ws in words.items():
        hit = F.lower(name).rlike("|".join(ws))
        family = F.when(hit, f) if family is None else family.when(hit, f)
    best = facts.groupBy(doc, "family").agg(F.max(F.struct("fact_confidence", "value")).alias("_f"))
    out = clauses.withColumn("family", family).join(best, [doc, "family"], "left")
    return out.withColumn("value", F.col("_f.value")).withColumn("confidence", F.greatest("confidence", F.col("_f.fact_confidence"))).drop("_f")
