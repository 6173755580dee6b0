"""Gates and classifiers over ``documents``, ``part``, ``events`` and ``lineitem``."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedge.functions.rules import Rule, RuleSet
from sedge.operators import gates
from sedge.plans.base import query, t

BLANKS_SQL = r"[ \t\r\n\f\x0b]"
MARKS = (r"[#*%&]{3}", r"!!", r"\$\$\$")


@query("text_quality_gate", rf"""
WITH b AS (SELECT doc_id, text, length(text) AS n_chars, length(regexp_replace(text, '{BLANKS_SQL}', '', 'g')) AS n_solid, len(string_split(text, chr(10))) AS n_lines,
                  length(regexp_replace(text, '[\x00-\x7e]', '', 'g')) AS odd FROM documents)
SELECT doc_id, n_chars, n_solid, n_lines, round(odd / n_chars::DOUBLE, 6) AS odd_share, round(odd / n_chars::DOUBLE, 6) > 0.3 AS scanned,
       n_chars > 200 AND n_solid > 100 AND n_lines > 5 AS meaningful, n_solid < 20 AS empty_page FROM b""")  # fmt: skip
def text_quality_gate(spark, sf):
    return gates.quality_gate(t(spark, sf, "documents").select("doc_id", "text")).drop("text")


@query("short_text_filter", """
SELECT doc_id, CASE WHEN text IS NULL THEN 'null' WHEN length(text) = 0 THEN 'empty' WHEN length(text) < 500 THEN 'under 500' END AS reject_reason FROM documents""")
def short_text_filter(spark, sf):
    return gates.min_length(t(spark, sf, "documents").select("doc_id", "text"), 500).select("doc_id", "reject_reason")


@query("boilerplate_filter", """
SELECT doc_id, length(text) AS n FROM documents
WHERE NOT ((contains(lower(left(text, 500)), 'license') OR contains(lower(left(text, 500)), 'copyright') OR contains(lower(left(text, 500)), 'the than')) AND length(text) < 1500)""")
def boilerplate_filter(spark, sf):
    kept = gates.drop_boilerplate(t(spark, sf, "documents").select("doc_id", "text"), ["license", "copyright", "the than"])
    return kept.select("doc_id", F.length("text").alias("n"))


@query("template_detector", """
WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '[#*%&]{3}')) AS a, len(regexp_extract_all(text, '!!')) AS b, len(regexp_extract_all(text, '\\$\\$\\$')) AS c FROM documents)
SELECT doc_id, a + b + c AS n_marks, (a > 0)::BIGINT + (b > 0)::BIGINT + (c > 0)::BIGINT AS n_kinds, a + b + c > 5 AS is_template, (a > 0)::INT + (b > 0)::INT + (c > 0)::INT >= 2 AS warn_template FROM c""".replace("\\\\", "\\"))
def template_detector(spark, sf):
    return gates.template_marks(t(spark, sf, "documents").select("doc_id", "text"), MARKS, kinds=2).drop("text")


PROSE = RuleSet([Rule("prose", "the", 2.0), Rule("prose", r"\.\n", 1.5), Rule("prose", "of ", 2.0), Rule("prose", "that", 1.0)])
NOISE = RuleSet([Rule("shouting", "!!", 5.0), Rule("symbols", r"%%%|###", 3.0), Rule("symbols", r"\$\$\$", 3.0), Rule("table", r" \| ", 4.5)])


@query("weighted_doc_classifier", r"""
WITH x AS (SELECT doc_id, lower(text) AS l FROM documents),
s AS (SELECT doc_id, (CASE WHEN contains(l, 'the') THEN 2.0 ELSE 0 END + CASE WHEN contains(l, '.' || chr(10)) THEN 1.5 ELSE 0 END + CASE WHEN contains(l, 'of ') THEN 2.0 ELSE 0 END + CASE WHEN contains(l, 'that') THEN 1.0 ELSE 0 END)::DOUBLE AS w,
  CASE WHEN contains(l, '!!') THEN 5.0::DOUBLE ELSE 0 END AS s1, (CASE WHEN contains(l, '%%%') OR contains(l, '###') THEN 3.0 ELSE 0 END + CASE WHEN contains(l, '$$$') THEN 3.0 ELSE 0 END)::DOUBLE AS s2, CASE WHEN contains(l, ' | ') THEN 4.5::DOUBLE ELSE 0 END AS s3 FROM x),
o AS (SELECT *, greatest(s1, s2, s3) AS m, CASE WHEN s1 >= s2 AND s1 >= s3 THEN 'shouting' WHEN s2 >= s3 THEN 'symbols' ELSE 'table' END AS g FROM s)
SELECT doc_id, CASE WHEN m > 4 THEN g WHEN w >= 5 THEN 'prose' ELSE 'unknown' END AS doc_class,
       round(CASE WHEN m > 4 THEN least(m / 10, 0.95) WHEN w >= 5 THEN least(w / 15, 0.95) ELSE 0.3 END, 6)::DOUBLE AS class_confidence FROM o""")
def weighted_doc_classifier(spark, sf):
    return gates.classify_docs(t(spark, sf, "documents").select("doc_id", "text"), PROSE, NOISE, wanted_name="prose").drop("text")


TERMS = ("the", "license", "der", "que", "and")


@query("essential_terms_check", """
SELECT doc_id, array_to_string(list_filter(['the', 'license', 'der', 'que', 'and'], lambda w: NOT regexp_matches(lower(text), '(^|[^a-z0-9_])' || w || '([^a-z0-9_]|$)')), ',') AS missing FROM documents""")
def essential_terms_check(spark, sf):
    return gates.missing_terms(t(spark, sf, "documents"), TERMS).select("doc_id", F.array_join("missing", ",").alias("missing"))


@query("doc_profile", r"""
SELECT doc_id, len(regexp_extract_all(text, '[^ \t\r\n\f\x0b]+')) AS n_words, len(string_split(text, chr(10))) AS n_lines, len(regexp_extract_all(text, '(?m)^--- PAGE [0-9]+ ---')) AS n_pages,
       regexp_matches(text, '\|[^\n]*\|') AS has_table, regexp_matches(text, '\$ ?[0-9]') AS has_money, regexp_matches(text, '[A-Za-z0-9._-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') AS has_email, regexp_matches(text, '[0-9]{3,}') AS has_number
FROM documents""")
def doc_profile(spark, sf):
    return gates.doc_profile(t(spark, sf, "documents").select("doc_id", "text")).drop("text")


ALIASES = [("blue_bolt", "bolt", 0), ("fasteners", "bolt", 1), ("fasteners", "nut", 1), ("rings", "ring", 2), ("machines", "gear", 3), ("machines", "widget", 3)]


@query("alias_categoriser", """
WITH a(category, alias, ordinal) AS (VALUES ('blue_bolt', 'bolt', 0), ('fasteners', 'bolt', 1), ('fasteners', 'nut', 1), ('rings', 'ring', 2), ('machines', 'gear', 3), ('machines', 'widget', 3))
SELECT p_partkey, coalesce((SELECT any_value(category) FROM a WHERE category = replace(lower(p_name), ' ', '_')),
       (SELECT arg_min(category, ordinal) FROM a WHERE contains(lower(p_name), alias))) AS category FROM part""")
def alias_categoriser(spark, sf):
    dim = spark.createDataFrame(ALIASES, "category string, alias string, ordinal int")
    return gates.categorise(t(spark, sf, "part"), dim, name="p_name").select("p_partkey", "category")


@query("keyword_vote_type", """
WITH v AS (SELECT doc_id, lower(text) AS l FROM documents),
s AS (SELECT doc_id, contains(l, 'the')::BIGINT + contains(l, 'that')::BIGINT + contains(l, 'with')::BIGINT AS en, contains(l, 'der')::BIGINT + contains(l, 'ung')::BIGINT + contains(l, 'sch')::BIGINT AS de, contains(l, 'que')::BIGINT + contains(l, 'ment')::BIGINT + contains(l, 'eau')::BIGINT AS fr FROM v)
SELECT doc_id, greatest(en, de, fr) AS votes, CASE WHEN greatest(en, de, fr) = 0 THEN NULL WHEN en >= de AND en >= fr THEN 'english' WHEN de >= fr THEN 'german' ELSE 'french' END AS type FROM s""")
def keyword_vote_type(spark, sf):
    kinds = [("english", ["the", "that", "with"]), ("german", ["der", "ung", "sch"]), ("french", ["que", "ment", "eau"])]
    return gates.infer_type(t(spark, sf, "documents"), kinds).select("doc_id", "type", "votes")


@query("section_router", """
SELECT p_partkey, CASE WHEN contains(lower(p_name), 'bolt') OR contains(lower(p_name), 'nut') THEN 'rent' WHEN contains(lower(p_name), 'red') THEN 'term' WHEN contains(lower(p_name), 'widget') THEN 'use' ELSE 'other' END AS route FROM part""")
def section_router(spark, sf):
    return gates.route(t(spark, sf, "part"), [("rent", ["bolt", "nut"]), ("term", ["red"]), ("use", ["widget"])], name="p_name", default="other").select("p_partkey", "route")


@query("heading_router", """
SELECT doc_id, CASE WHEN contains(h, 'the') THEN 'general' WHEN contains(h, 'sch') OR contains(h, 'ung') THEN 'german' WHEN contains(h, 'eau') THEN 'french' ELSE 'miscellaneous' END AS route
FROM (SELECT doc_id, lower(string_split(text, chr(10))[1]) AS h FROM documents)""")
def heading_router(spark, sf):
    first = t(spark, sf, "documents").select("doc_id", F.substring_index("text", "\n", 1).alias("heading"))
    return gates.route(first, [("general", ["the"]), ("german", ["sch", "ung"]), ("french", ["eau"])], name="heading", default="miscellaneous").select("doc_id", "route")


@query("extractor_router", """
SELECT doc_id, CASE WHEN contains(h, 'license') THEN 'rights' WHEN contains(h, ' if ') OR contains(h, 'con ') THEN 'conditional' WHEN contains(h, 'and ') THEN 'financial' ELSE 'general' END AS route
FROM (SELECT doc_id, lower(left(text, 500)) AS h FROM documents)""")
def extractor_router(spark, sf):
    return gates.route(t(spark, sf, "documents"), [("rights", ["license"]), ("conditional", [" if ", "con "]), ("financial", ["and "])], name="text", default="general", head=500).select("doc_id", "route")


@query("review_flagging", """
SELECT l_orderkey, l_linenumber, 1 - 8 * l_discount < 0.6 AND l_tax = 0 AS needs_review, CASE WHEN 1 - 8 * l_discount < 0.4 THEN 'skip' WHEN 1 - 8 * l_discount < 0.7 THEN 'weak' ELSE 'normal' END AS use FROM lineitem""")
def review_flagging(spark, sf):
    rows = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (1 - 8 * F.col("l_discount")).alias("confidence"), F.when(F.col("l_tax") == 0, 0).otherwise(1).alias("n_tags"))
    return gates.flag_review(rows).select("l_orderkey", "l_linenumber", "needs_review", "use")


LEVEL_SQL = "CASE WHEN l_discount >= 0.08 THEN 'high' WHEN l_discount >= 0.04 THEN 'medium' ELSE 'low' END"


def level_rows(spark, sf):
    return t(spark, sf, "lineitem").withColumn("level", F.expr(LEVEL_SQL))


@query("risk_level_filter", f"""
SELECT l_returnflag, count(*) FILTER ({LEVEL_SQL} = 'high') AS n_high, count(*) FILTER ({LEVEL_SQL} = 'medium') AS n_medium, count(*) FILTER ({LEVEL_SQL} = 'low') AS n_low, count(*) AS n_all FROM lineitem GROUP BY 1""")
def risk_level_filter(spark, sf):
    return gates.risk_counts(level_rows(spark, sf), keys=["l_returnflag"])


@query("traceability_projection", """
SELECT doc_id, n_chars AS page, left(text, 200) || '...' AS sample FROM documents WHERE n_chars IS NOT NULL""")
def traceability_projection(spark, sf):
    return gates.traceability(t(spark, sf, "documents"), key="doc_id", page="n_chars", text="text").withColumnRenamed("n_chars", "page")


@query("evidence_window", r"""
WITH h AS (SELECT doc_id, text, list_min(list_filter([CASE WHEN instr(lower(text), 'license') > 0 THEN {'at': instr(lower(text), 'license'), 'size': 7} END, CASE WHEN instr(lower(text), 'with') > 0 THEN {'at': instr(lower(text), 'with'), 'size': 4} END], lambda x: x IS NOT NULL)) AS hit FROM documents),
w AS (SELECT *, greatest(1, hit.at - 30) AS b, least(length(text) + 1, hit.at + hit.size + 30) AS e FROM h),
p AS (SELECT *, substring(text, 1, b - 1) AS bef, substring(text, b, e - b) AS mid, substring(text, e) AS aft FROM w),
g AS (SELECT *, regexp_extract(bef, '[^ \t\r\n]*$') AS bx, regexp_extract(aft, '^[^ \t\r\n]*') AS ax FROM p)
SELECT doc_id, CASE WHEN hit IS NULL THEN left(text, 100) || '...' ELSE (CASE WHEN length(bx) < length(bef) THEN '...' ELSE '' END) || bx || mid || ax || (CASE WHEN length(ax) < length(aft) THEN '...' ELSE '' END) END AS evidence FROM g""")
def evidence_window(spark, sf):
    return gates.evidence(t(spark, sf, "documents"), ["license", "with"]).select("doc_id", "evidence")


@query("common_headings", """
SELECT source, count(*) AS n_docs, round(avg(len(list_filter(['the', 'license', 'der ', 'que '], lambda w: contains(lower(text), w)))), 6) AS mean_headings, count(*) FILTER (NOT contains(lower(text), 'the') AND NOT contains(lower(text), 'license') AND NOT contains(lower(text), 'der ') AND NOT contains(lower(text), 'que ')) AS n_without
FROM documents GROUP BY source""")
def common_headings(spark, sf):
    rows = gates.headings_present(t(spark, sf, "documents"), ["The", "License", "Der ", "Que "])
    return rows.groupBy("source").agg(F.count("*").alias("n_docs"), F.round(F.avg(F.size("headings")), 6).alias("mean_headings"), F.count_if(F.size("headings") == 0).alias("n_without"))


@query("short_critical_sections", """
SELECT source, doc_id FROM documents WHERE lower(source) IN ('src0', 'src5', 'src7') AND length(text) < 400""")
def short_critical_sections(spark, sf):
    return gates.short_critical(t(spark, sf, "documents"), ["SRC0", "src5", "src7"], name="source", text="text", below=400).select("source", "doc_id")
