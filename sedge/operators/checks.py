"""Consistency checks. Each returns issue rows or a flag; blank or null inputs are skipped, never failed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedge.functions.storage import saved_with


def check_dates(df: DataFrame, *, start: str, end: str, deadline: str | None = None) -> DataFrame:
    """One row per broken rule: issue_type, severity. Start not before end (high); a deadline after the end (high); a first date before the start (medium)."""
    rules = [F.when(F.col(start) >= F.col(end), F.struct(F.lit("start_after_end").alias("issue_type"), F.lit("high").alias("severity")))]
    if deadline:
        rules.append(F.when(F.col(deadline) > F.col(end), F.struct(F.lit("deadline_after_end").alias("issue_type"), F.lit("high").alias("severity"))))
        rules.append(F.when(F.col(deadline) < F.col(start), F.struct(F.lit("before_start").alias("issue_type"), F.lit("medium").alias("severity"))))
    return df.withColumn("_i", F.explode(F.array_compact(F.array(*rules)))).withColumn("issue_type", F.col("_i.issue_type")).withColumn("severity", F.col("_i.severity")).drop("_i")


def check_tolerance(df: DataFrame, *, stated: Column, computed: Column, tolerance: float = 0.01) -> DataFrame:
    """Add deviation (relative, six digits) and broken; a stated value of zero or null is skipped (null)."""
    off = F.try_divide(F.abs(computed - stated), F.abs(stated))
    return df.withColumn("deviation", F.round(off, 6)).withColumn("broken", off > tolerance)


def check_share(df: DataFrame, *, total: Column, percent: Column, estimate: Column, tolerance: float = 0.01) -> DataFrame:
    """Rows whose estimate is off a share of a total (total x percent / 100) by more than ``tolerance`` of it: expected, deviation, severity medium. Null or zero inputs are skipped."""
    expected = total * percent / 100
    off = F.try_divide(F.abs(estimate - expected), F.abs(expected))
    rows = df.withColumn("expected", F.round(expected, 6)).withColumn("deviation", F.round(off, 6)).withColumn("_off", off)
    return rows.filter((F.col("_off") > tolerance) & (estimate != 0)).withColumn("severity", F.lit("medium")).drop("_off")


def check_ascending(df: DataFrame, *, key: str, order: Sequence[str], value: str) -> DataFrame:
    """Rows whose value is not over the one before."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("previous", F.lag(value).over(w)).filter(F.col(value) <= F.col("previous"))


def broken_refs(refs: DataFrame, targets: DataFrame, *, on: Sequence[str]) -> DataFrame:
    """References to numbers that do not exist."""
    return refs.join(targets.select(*on).distinct(), list(on), "left_anti")


def undefined_terms(texts: DataFrame, defined: DataFrame, *, id: str, text: str, stop: Sequence[str] = (), pattern: str = r"(?:^|[^A-Za-z])([A-Z][a-z]+(?: [A-Z][a-z]+)+)") -> DataFrame:
    """Runs of capitalised words that are neither stop words nor defined (column term): term, first text that uses it, number of texts."""
    found = texts.select(id, F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1)))).alias("term"))
    found = found.filter(~F.col("term").isin(list(stop))) if stop else found
    open_terms = found.join(defined.select("term").distinct(), "term", "left_anti")
    return open_terms.groupBy("term").agg(F.min(id).alias("first_id"), F.count("*").alias("n_texts"))


def high_stakes(df: DataFrame, kinds: DataFrame, *, kind: str, mutual: str | None = None) -> DataFrame:
    """Rows of a type that is always flagged (medium), high where ``mutual`` is false."""
    hit = df.join(kinds.select(F.col("kind").alias(kind)).distinct(), kind, "left_semi")
    return hit.withColumn("severity", F.when(~F.col(mutual), "high").otherwise("medium") if mutual else F.lit("medium"))


def validation_report(issues: DataFrame, checked: DataFrame, *, id: str) -> DataFrame:
    """score = max(0, 100 - 100 x issues / checked), 100 when nothing was checked; strict_score = 100 - 5 x issues."""
    n = issues.groupBy(id).agg(F.count("*").alias("n_issues"), F.count_if(F.col("severity") == "high").alias("n_high"))
    both = checked.join(n, id, "full_outer").withColumn("n_issues", F.coalesce("n_issues", F.lit(0)).cast("long")).withColumn("n_high", F.coalesce("n_high", F.lit(0)).cast("long")).withColumn("n_checked", F.coalesce("n_checked", F.lit(0)).cast("long"))
    score = F.when(F.col("n_checked") == 0, 100.0).otherwise(F.greatest(F.lit(0.0), 100 - 100 * F.try_divide("n_issues", "n_checked")))
    return both.withColumn("score", F.round(score, 6)).withColumn("strict_score", 100 - 5 * F.col("n_issues"))


def flatten_json(df: DataFrame, *, id: str, json: str) -> DataFrame:
    """Leaves of a JSON text at any depth: id, path, value (as JSON), is_date_key (the last name holds date, deadline, expir or commenc).

    Names are joined by dots, places in arrays stand in brackets from 0. Containers without members are leaves ({} and []), and so is null. Texts that
    are no JSON, or whose top is no container, give no rows. One level is opened at a time, until no row holds a container; each level is written to the
    shared folder, and a level costs no shuffle.
    """
    is_open = "schema_of_variant(v) RLIKE '^(OBJECT|ARRAY)' AND to_json(v) NOT IN ('{}', '[]')"
    level = df.select(F.col(id).alias("id"), F.lit("").alias("path"), F.lit(None).cast("string").alias("name"), F.try_parse_json(json).alias("v")).filter("v IS NOT NULL").filter(is_open)
    opened = "SELECT id, CASE WHEN e.key IS NULL THEN path || '[' || e.pos || ']' WHEN path = '' THEN e.key ELSE path || '.' || e.key END AS path, coalesce(e.key, name) AS name, e.value AS v FROM {{level}}, LATERAL variant_explode({v}) AS e"
    found, v = None, "v"
    while True:
        members = df.sparkSession.sql(opened.format(v=v), level=level).selectExpr("id", "path", "name", "to_json(v) AS value", f"{is_open} AS is_open")
        members, n_open = saved_with(members, "leaves", F.count_if("is_open"))
        leaves = members.filter("NOT is_open")
        found = leaves if found is None else found.unionByName(leaves)
        if not n_open:
            break
        level, v = members.filter("is_open"), "parse_json(value)"
    return found.select(F.col("id").alias(id), "path", "value", F.coalesce(F.lower("name").rlike("date|deadline|expir|commenc"), F.lit(False)).alias("is_date_key"))


def attach_refs(refs: DataFrame, clauses: DataFrame, *, doc: str, src: str, dst: str, section: str) -> DataFrame:
    """Per (document, source section) the target sections that have clauses, where the source has one as well."""
    own = clauses.select(doc, section).distinct()
    ok = refs.join(own.withColumnRenamed(section, src), [doc, src], "left_semi").join(own.withColumnRenamed(section, dst), [doc, dst], "left_semi")
    return ok.groupBy(doc, src).agg(F.array_sort(F.collect_set(dst)).alias("targets"))
