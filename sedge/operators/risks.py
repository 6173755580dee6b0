"""Risk and completeness analytics over clause tables; rules come as data (RuleSet)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedge.functions.rules import RuleSet
from sedge.functions.words import rules_held


def clause_risks(df: DataFrame, rules: RuleSet, *, text: Column, keep: Sequence[str]) -> DataFrame:
    """One row per clause and rule that fires: the kept columns, rule, level, message, ordinal."""
    hits = df.select(*keep, F.explode(rules.hits(text)).alias("_h"))
    return hits.select(*keep, F.col("_h.name").alias("rule"), F.col("_h.level").alias("level"), F.col("_h.message").alias("message"), F.col("_h.ordinal").alias("ordinal"))


def pattern_tags(df: DataFrame, tags: Sequence[tuple[str, str, str]], *, id: str, texts: Sequence[str]) -> DataFrame:
    """(id, tag, level): the tags whose pattern fires on any of the text columns, each once per row. ``tags`` are (tag, level, pattern)."""
    fires = lambda pattern: F.array_contains(F.array(*[F.coalesce(F.col(c).rlike(pattern), F.lit(False)) for c in texts]), True)
    found = F.array_compact(F.array(*[F.when(fires(p), F.struct(F.lit(tag).alias("tag"), F.lit(level).alias("level"))) for tag, level, p in tags]))
    return df.select(id, F.inline(F.array_distinct(found)))


def flag_rows(df: DataFrame, *, keep: Sequence[str], tags: str, text: str, chars: int = 100) -> DataFrame:
    """One row per stored tag (struct of name and level): the kept columns, level (medium if null), rule, evidence (the text's beginning)."""
    rows = df.select(*keep, F.left(text, F.lit(chars)).alias("evidence"), F.explode(tags).alias("_t"))
    return rows.select(*keep, F.coalesce("_t.level", F.lit("medium")).alias("level"), F.col("_t.name").alias("rule"), "evidence")


def risk_class(df: DataFrame, classes: DataFrame, *, category: str, default: str = "low") -> DataFrame:
    """``df`` with risk_class from a small dimension (category, risk_class); categories that are not in it get ``default``."""
    return df.join(classes, category, "left").withColumn("risk_class", F.coalesce("risk_class", F.lit(default)))


def typed_risks(df: DataFrame, by_type: dict[str, RuleSet], *, kind: str, text: Column, keep: Sequence[str]) -> DataFrame:
    """Like clause_risks, with the rule set chosen by a column."""
    out = None
    for value, rules in by_type.items():
        part = clause_risks(df.filter(F.col(kind) == value), rules, text=text, keep=keep)
        out = part if out is None else out.unionByName(part)
    return out


def all_risks(df: DataFrame, rules: RuleSet, by_type: dict[str, RuleSet], *, kind: str, text: Column, keep: Sequence[str]) -> DataFrame:
    """``clause_risks`` of the rules for every type and ``typed_risks`` of the others, in one pass over the clauses: the words that the rules need are looked for at once,
    and a rule reads the clauses of its type that hold its own."""
    every = [(None, i, r) for i, r in enumerate(rules.rules)] + [(value, i, r) for value, own in by_type.items() for i, r in enumerate(own.rules)]
    if not every:
        return clause_risks(df, rules, text=text, keep=keep)
    sparing = {k: len(every) + n for n, k in enumerate(k for k, (_, _, r) in enumerate(every) if r.unless and r.spared)}

    def fires(k: int) -> Column:
        value, _, r = every[k]
        hit = RuleSet._fires(r, F.col("_x"), F.array_contains("_held", sparing[k]) if k in sparing else None)
        return hit if value is None else (F.col("_kind") == value) & hit

    def fired(n: Column) -> Column:
        out = F.when(n == 0, fires(0))
        for k in range(1, len(every)):
            out = out.when(n == k, fires(k))
        return out

    needs = [r.needs for _, _, r in every] + [every[k][2].spared for k in sparing]
    rows = df.select(*keep, F.col(kind).alias("_kind"), text.alias("_x")).withColumn("_held", rules_held(F.col("_x"), needs))
    # The outer form: for the inner one the optimiser adds a filter on the array, which would try every rule twice.
    found = rows.select(*keep, F.explode_outer(F.filter("_held", fired)).alias("_n")).filter("_n IS NOT NULL")
    told = F.get(F.array(*[F.struct(F.lit(r.name or r.pattern).alias("rule"), F.lit(r.level).alias("level"), F.lit(r.message).alias("message"), F.lit(i).alias("ordinal")) for _, i, r in every]), F.col("_n"))
    return found.select(*keep, told.alias("_h")).select(*keep, "_h.rule", "_h.level", "_h.message", "_h.ordinal")


def absence(df: DataFrame, *, doc: str, never: Column, though: Column) -> DataFrame:
    """Documents in which no clause fulfils ``never`` while some clause fulfils ``though``."""
    sums = df.groupBy(doc).agg(F.bool_or(F.coalesce(never, F.lit(False))).alias("_n"), F.bool_or(F.coalesce(though, F.lit(False))).alias("_t"))
    return sums.filter("NOT _n AND _t").select(doc)


def paired_risks(df: DataFrame, *, doc: str, order: str, a: Column, b: Column) -> DataFrame:
    """Documents with a clause for either condition: the first clause of each."""
    sums = df.groupBy(doc).agg(F.min(F.when(a, F.col(order))).alias("first_a"), F.min(F.when(b, F.col(order))).alias("first_b"))
    return sums.filter("first_a IS NOT NULL AND first_b IS NOT NULL")


def dedup_risks(df: DataFrame, *, keys: Sequence[str], ordinal: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(ordinal)
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def missing(df: DataFrame, essential: DataFrame, *, doc: str, kind: str, most: int = 10_000) -> DataFrame:
    """Essential kinds a document lacks. Each document carries the short list; what it holds is taken away by an anti-join.

    A list of more than ``most`` kinds is refused.
    """
    wanted = [r[0] for r in essential.select(kind).filter(F.col(kind).isNotNull()).distinct().limit(most + 1).collect()]
    if len(wanted) > most:
        raise ValueError(f"more than {most} essential kinds")
    if not wanted:
        return df.select(doc, kind).limit(0)
    every = df.select(doc).distinct().withColumn(kind, F.explode(F.array(*[F.lit(w) for w in sorted(wanted)])))
    return every.join(df.select(doc, kind).distinct(), [doc, kind], "left_anti")


def missing_by_words(clauses: DataFrame, essential: DataFrame, *, doc: str, key: str, texts: Sequence[str], category: str = "category", keyword: str = "keyword", kind: str | None = None, most: int = 10_000) -> DataFrame:
    """(doc, category): essential categories that nothing in a document speaks of.

    ``essential`` has a row per category and keyword, and per document kind if ``kind`` names a column of both (null there: for every kind). A category is there if it, or one of its
    keywords, is the clause's key without its endings _data, _clause and _inferred, or if a keyword lies in a key or in one of ``texts`` (content, structured data as text). Letters' case does not count.
    All keywords of a clause are tried in one pass over it; found categories, not texts, cross the shuffle. More than ``most`` rows of ``essential`` are refused.
    """
    typed = [kind] if kind else []
    wanted = essential.select(*typed, F.lower(category).alias("category"), F.lower(keyword).alias("_w")).distinct().limit(most + 1).collect()
    if len(wanted) > most:
        raise ValueError(f"more than {most} rows of essential categories")
    docs = clauses.select(doc, *typed).distinct()
    if not wanted:
        return docs.select(doc, F.lit("").alias("category")).limit(0)
    stem = F.regexp_replace(F.lower(key), "_data|_clause|_inferred", "")
    hay = [F.lower(F.col(c).cast("string")) for c in (key, *texts)]
    words: dict[str, set] = {}
    for r in wanted:
        words.setdefault(r["category"], set()).add(r["_w"])
    found = F.array_compact(F.array(*[F.when(F.coalesce(stem.isin(name, *[w for w in ws if w]), F.lit(False)) | F.array_contains(F.array(*[F.coalesce(F.contains(h, F.lit(w)), F.lit(False)) for h in hay for w in sorted(w for w in ws if w)] or [F.lit(False)]), True), F.lit(name)) for name, ws in sorted(words.items())]))
    there = clauses.select(doc, F.explode(found).alias("category")).distinct()
    lists: dict = {}
    for r in wanted:
        lists.setdefault(r[kind] if kind else None, set()).add(r["category"])
    each = lambda names: F.array(*[F.lit(n) for n in sorted(names)]) if names else F.array().cast("array<string>")
    base = lists.get(None, set())
    need = each(base)
    for value, names in lists.items():
        if value is not None:
            need = F.when(F.col(kind) == value, each(names | base)).otherwise(need)
    return docs.select(doc, F.explode(need).alias("category")).distinct().join(there, [doc, "category"], "left_anti")


def analysis_log(clauses: DataFrame, flags: DataFrame, *, key: str, confidence: str, skip_below: float = 0.4) -> DataFrame:
    """Per clause: confidence, rules that matched (sorted text), skipped; keys that only the flags know come with a null confidence."""
    matched = flags.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("rule")), ",").alias("matched"))
    out = clauses.select(key, confidence).join(matched, key, "full_outer")
    return out.withColumn("skipped", F.coalesce(F.col(confidence) < skip_below, F.lit(False))).withColumn("matched", F.coalesce("matched", F.lit("")))


def risk_profile(flags: DataFrame, *, doc: str, level: str) -> DataFrame:
    high, medium = F.count_if(F.col(level) == "high"), F.count_if(F.col(level) == "medium")
    out = flags.groupBy(doc).agg(high.alias("n_high"), medium.alias("n_medium"), F.count_if(~F.col(level).isin("high", "medium")).alias("n_other"))
    return out.withColumn("overall", F.when(F.col("n_high") > 2, "high").when((F.col("n_high") > 0) | (F.col("n_medium") > 5), "medium").otherwise("low"))


def risk_rollup(flags: DataFrame, *, doc: str, level: str, text: str) -> DataFrame:
    """Highest level and distinct descriptions without regard to case, high ones first."""
    rank = F.when(F.col(level) == "high", 0).when(F.col(level) == "medium", 1).otherwise(2)
    once = flags.groupBy(doc, F.lower(text).alias("_t")).agg(F.min(rank).alias("_k"))
    parts = F.array_sort(F.collect_list(F.struct("_k", "_t")))
    out = once.groupBy(doc).agg(F.min("_k").alias("_m"), parts.alias("_p"), F.count("*").alias("n_descriptions"))
    return out.select(doc, F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), F.col("_m") + 1).alias("max_level"), "n_descriptions", F.array_join(F.transform("_p", lambda x: x["_t"]), "; ").alias("descriptions"))


def risk_cube(flags: DataFrame, *, dims: Sequence[str]) -> DataFrame:
    return flags.cube(*dims).agg(F.count("*").alias("n"))


def incomplete(df: DataFrame, *, keep: Sequence[str], confidence: str, review: Column) -> DataFrame:
    return df.filter(review | (F.col(confidence) < 0.7)).select(*keep, F.floor(F.round(F.col(confidence) * 100, 6)).cast("int").alias("percent"))
