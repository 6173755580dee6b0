"""Risk, completeness, audit and feedback queries over ``documents``, ``events``, ``conversations`` and ``orders``."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedge.functions.rules import Rule, RuleSet
from sedge.operators import insights, risks
from sedge.plans.base import query, t

RULES = RuleSet([
    Rule("noise", "!!", name="shouting", level="high", message="text shouts"),
    Rule("noise", r"%%%|###", name="symbols", level="medium", message="symbols between words"),
    Rule("licence", "license", name="licence", level="low", message="mentions a licence", unless="copyright"),
    Rule("mail", "@", name="mail", level="medium", message="Mail address", gate=r"\.com|\.org|\.net"),
])
FLAGS_SQL = r"""
x AS (SELECT doc_id, source, lang, lower(text) AS l FROM documents),
flags AS (
  SELECT doc_id, source, lang, 'shouting' AS rule, 'high' AS level, 'text shouts' AS message, 0 AS ordinal FROM x WHERE contains(l, '!!')
  UNION ALL SELECT doc_id, source, lang, 'symbols', 'medium', 'symbols between words', 1 FROM x WHERE contains(l, '%%%') OR contains(l, '###')
  UNION ALL SELECT doc_id, source, lang, 'licence', 'low', 'mentions a licence', 2 FROM x WHERE contains(l, 'license') AND NOT contains(l, 'copyright')
  UNION ALL SELECT doc_id, source, lang, 'mail', 'medium', 'Mail address', 3 FROM x WHERE contains(l, '@') AND regexp_matches(l, '\.com|\.org|\.net'))"""


def flags(spark, sf):
    return risks.clause_risks(t(spark, sf, "documents"), RULES, text=F.lower("text"), keep=["doc_id", "source", "lang"])


@query("rule_risks", f"WITH {FLAGS_SQL} SELECT doc_id, rule, level, message, ordinal FROM flags")
def rule_risks(spark, sf):
    return flags(spark, sf).select("doc_id", "rule", "level", "message", "ordinal")


@query("segment_type_risks", "SELECT doc_id, lang, 'the' AS rule, 'low' AS level FROM documents WHERE lang = 'en' AND contains(lower(text), 'the') UNION ALL SELECT doc_id, lang, 'umlaut', 'medium' FROM documents WHERE lang = 'de' AND regexp_matches(lower(text), '[äöü]')")
def segment_type_risks(spark, sf):
    by = {"en": RuleSet([Rule("a", "the", name="the", level="low")]), "de": RuleSet([Rule("b", "[äöü]", name="umlaut", level="medium")])}
    return risks.typed_risks(t(spark, sf, "documents"), by, kind="lang", text=F.lower("text"), keep=["doc_id", "lang"]).select("doc_id", "lang", "rule", "level")


@query("absence_rule", "SELECT user_id FROM events GROUP BY 1 HAVING NOT bool_or(event_type = 'error' AND value > 40) AND bool_or(event_type = 'purchase' AND value > 20)")
def absence_rule(spark, sf):
    e, v = F.col("event_type"), F.col("value")
    return risks.absence(t(spark, sf, "events"), doc="user_id", never=(e == "error") & (v > 40), though=(e == "purchase") & (v > 20))


@query("cross_clause_risks", "SELECT user_id, min(event_id) FILTER (event_type = 'error' AND value > 30) AS first_a, min(event_id) FILTER (event_type = 'purchase' AND value > 30) AS first_b FROM events GROUP BY 1 HAVING first_a IS NOT NULL AND first_b IS NOT NULL")
def cross_clause_risks(spark, sf):
    e, v = F.col("event_type"), F.col("value")
    return risks.paired_risks(t(spark, sf, "events"), doc="user_id", order="event_id", a=(e == "error") & (v > 30), b=(e == "purchase") & (v > 30))


@query("tag_risks", f"WITH {FLAGS_SQL} SELECT f.doc_id, level, rule, left(text, 100) AS evidence FROM flags f JOIN documents USING (doc_id)")
def tag_risks(spark, sf):
    docs = t(spark, sf, "documents").withColumn("tags", RULES.hits(F.lower("text")))
    return risks.flag_rows(docs, keep=["doc_id"], tags="tags", text="text")


@query("risk_dedup", f"WITH {FLAGS_SQL} SELECT source, level, min(doc_id) AS doc_id FROM flags GROUP BY 1, 2")
def risk_dedup(spark, sf):
    return risks.dedup_risks(flags(spark, sf), keys=["source", "level"], ordinal="doc_id").select("source", "level", "doc_id")


@query("missing_categories", "SELECT user_id, k AS event_type FROM (SELECT DISTINCT user_id FROM events), (VALUES ('error'), ('purchase'), ('refund')) v(k) WHERE (user_id, k) NOT IN (SELECT (user_id, event_type) FROM events)")
def missing_categories(spark, sf):
    essential = spark.createDataFrame([("error",), ("purchase",), ("refund",)], "event_type string")
    return risks.missing(t(spark, sf, "events"), essential, doc="user_id", kind="event_type")


@query("heuristic_log", f"""WITH {FLAGS_SQL}, m AS (SELECT doc_id, string_agg(DISTINCT rule, ',' ORDER BY rule) AS matched FROM flags GROUP BY 1)
SELECT coalesce(l.doc_id, m.doc_id) AS doc_id, quality::DOUBLE AS confidence, coalesce(matched, '') AS matched, coalesce(quality < 0.4, false) AS skipped FROM labels l FULL OUTER JOIN m ON l.doc_id = m.doc_id""")
def heuristic_log(spark, sf):
    items = t(spark, sf, "labels").select("doc_id", F.col("quality").cast("double").alias("confidence"))
    return risks.analysis_log(items, flags(spark, sf), key="doc_id", confidence="confidence")


PROFILE = "count(*) FILTER (level = 'high') AS n_high, count(*) FILTER (level = 'medium') AS n_medium, count(*) FILTER (level = 'low') AS n_other"


@query("risk_profile", f"WITH {FLAGS_SQL}, p AS (SELECT source, {PROFILE} FROM flags GROUP BY 1) SELECT *, CASE WHEN n_high > 2 THEN 'high' WHEN n_high > 0 OR n_medium > 5 THEN 'medium' ELSE 'low' END AS overall FROM p")
def risk_profile(spark, sf):
    return risks.risk_profile(flags(spark, sf), doc="source", level="level")


@query("risk_rollup", f"""WITH {FLAGS_SQL}, o AS (SELECT source, lower(message) AS m, min(CASE level WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END) AS k FROM flags GROUP BY 1, 2)
SELECT source, CASE min(k) WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS max_level, count(*) AS n_descriptions, string_agg(m, '; ' ORDER BY k, m) AS descriptions FROM o GROUP BY 1""")
def risk_rollup(spark, sf):
    return risks.risk_rollup(flags(spark, sf), doc="source", level="level", text="message")


@query("risk_cube", f"WITH {FLAGS_SQL} SELECT source, lang, level, count(*) AS n FROM flags GROUP BY CUBE (source, lang, level)")
def risk_cube(spark, sf):
    return risks.risk_cube(flags(spark, sf), dims=["source", "lang", "level"])


@query("category_risk_class", "SELECT event_type, CASE event_type WHEN 'error' THEN 'high' WHEN 'purchase' THEN 'medium' ELSE 'low' END AS risk_class, count(*) AS n FROM events GROUP BY 1, 2")
def category_risk_class(spark, sf):
    dim = spark.createDataFrame([("error", "high"), ("purchase", "medium")], "event_type string, risk_class string")
    return risks.risk_class(t(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n")), dim, category="event_type")


@query("incomplete_list", "SELECT doc_id, floor(round((doc_id % 100) / 100.0 * 100, 6))::INT AS percent FROM documents WHERE contains(text, '!!') OR (doc_id % 100) / 100.0 < 0.7")
def incomplete_list(spark, sf):
    rows = t(spark, sf, "documents").withColumn("confidence", (F.col("doc_id") % 100) / 100)
    return risks.incomplete(rows, keep=["doc_id"], confidence="confidence", review=F.contains("text", F.lit("!!")))


@query("structure_flags", "SELECT user_id, bool_or(event_type = 'error') AS has_error, bool_or(event_type = 'purchase' AND value > 50) AS has_big, count(*) AS n, CASE WHEN bool_or(value > 60) THEN 'gross' WHEN bool_or(value > 30) THEN 'net' ELSE 'other' END AS kind FROM events GROUP BY 1")
def structure_flags(spark, sf):
    e, v = F.col("event_type"), F.col("value")
    flags = {"has_error": e == "error", "has_big": (e == "purchase") & (v > 50)}
    return insights.structure_flags(t(spark, sf, "events"), doc="user_id", flags=flags, kinds=[("gross", v > 60), ("net", v > 30)])


@query("financial_summary", "SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS last_price, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total, string_agg(o_orderpriority, '|' ORDER BY o_orderkey) FILTER (o_orderstatus = 'F') AS extras FROM orders GROUP BY 1")
def financial_summary(spark, sf):
    return insights.financial_summary(t(spark, sf, "orders"), doc="o_custkey", order="o_orderkey", amount="o_totalprice", extra="o_orderpriority", is_extra=F.col("o_orderstatus") == "F")


@query("timeline", "SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate::DATE AS d, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey))::INT AS nth FROM lineitem")
def timeline(spark, sf):
    rows = insights.date_timeline(t(spark, sf, "lineitem"), doc="l_orderkey", date="l_shipdate", ties=["l_linenumber", "l_partkey", "l_suppkey"])
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "d", "nth")


@query("complexity", """
SELECT source, least(100, floor(least(n / 2, 30.0) + least(2 * x, 20) + least(5 * c, 20) + least(3 * f, 20) + least(5 * t, 10)))::INT AS complexity FROM
(SELECT source, count(*) AS n, count(*) FILTER (contains(text, '@')) AS x, count(*) FILTER (contains(text, '!!')) AS c, count(*) FILTER (contains(text, '%')) AS f, count(*) FILTER (contains(text, '|')) AS t FROM documents GROUP BY 1)""")
def complexity(spark, sf):
    has = lambda s: F.contains("text", F.lit(s))
    return insights.complexity(t(spark, sf, "documents"), doc="source", xref=has("@"), conditional=has("!!"), financial=has("%"), table=has("|"))


@query("section_rollup", "SELECT source, lang, count(*) AS n_docs, sum(n_chars)::BIGINT AS n_chars, bool_or(contains(text, '@')) AS has_mail FROM documents GROUP BY 1, 2")
def section_rollup(spark, sf):
    return insights.section_rollup(t(spark, sf, "documents"), by=["source", "lang"], size="n_chars", present={"has_mail": F.contains("text", F.lit("@"))})


@query("summary_styles", f"WITH {FLAGS_SQL} SELECT f.doc_id, rule, left(text, 100) AS excerpt FROM flags f JOIN documents USING (doc_id) WHERE level IN ('high', 'medium')")
def summary_styles(spark, sf):
    return insights.executive(t(spark, sf, "documents"), keep=["doc_id"], text="text", flags=RULES.hits(F.lower("text")))


@query("section_select", "SELECT p_partkey, section FROM part JOIN (VALUES ('tools', 'bolt'), ('tools', 'gear'), ('ornament', 'ring'), ('colour', 'red'), ('colour', 'blue')) v(section, keyword) ON contains(p_name, keyword) GROUP BY 1, 2")
def section_select(spark, sf):
    dim = spark.createDataFrame([("tools", "bolt"), ("tools", "gear"), ("ornament", "ring"), ("colour", "red"), ("colour", "blue")], "section string, keyword string")
    return insights.select_sections(t(spark, sf, "part"), dim, id="p_partkey", text="p_name")


REPORT = ((None, "colour", "red", 9), (None, "colour", "blue", 9), (None, "tools", "bolt", 2), ("Brand#11", "colour", "green", 1), ("Brand#12", "tools", "gear", 11), ("Brand#12", "ornament", "ring", 1), (None, "ornament", "ring", 5))


@query("ordered_sections", f"""WITH d(brand, section, keyword, place) AS (VALUES {", ".join(f"({repr(b) if b else 'NULL'}, '{s}', '{k}', {n})" for b, s, k, n in REPORT)}),
h AS (SELECT p_partkey, section, min((CASE WHEN brand IS NULL THEN 1 ELSE 0 END, place)) AS b FROM part JOIN d ON contains(p_name, keyword) AND (brand IS NULL OR brand = p_brand) GROUP BY 1, 2)
SELECT p_partkey, section, (row_number() OVER (PARTITION BY p_partkey ORDER BY b[2], section))::INT AS nth FROM h""")
def ordered_sections(spark, sf):
    """Report sections in the order of a part's brand."""
    dim = spark.createDataFrame(list(REPORT), "p_brand string, section string, keyword string, place int")
    return insights.ordered_sections(t(spark, sf, "part"), dim, id="p_partkey", text="p_name", kind="p_brand")


@query("doc_timeline", "SELECT user_id, event_id, (row_number() OVER w)::INT AS step, round((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6, 3) AS gap_s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def doc_timeline(spark, sf):
    return insights.entity_timeline(t(spark, sf, "events"), entity="user_id", ts="ts", id="event_id")


KINDS = ("view", "signup", "error", "click", "purchase")


@query("processing_stats", f"SELECT user_id, count(*) AS n_events, {', '.join(f'''count(*) FILTER (event_type = '{k}') AS n_{k}''' for k in KINDS)}, round(avg(value), 6) AS mean_value FROM events GROUP BY GROUPING SETS ((user_id), ())")
def processing_stats(spark, sf):
    return insights.stats(t(spark, sf, "events"), entity="user_id", kinds=KINDS, kind="event_type", value="value")


@query("event_export", "SELECT event_id, event_type FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-20 12:00:00'")
def event_export(spark, sf):
    return insights.export_slice(t(spark, sf, "events"), ts="ts", start="2024-01-10 00:00:00", end="2024-01-20 12:00:00").select("event_id", "event_type")


@query("latency_summary", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_ms, min(value) AS min_ms, max(value) AS max_ms, round(sum(value::DECIMAL(18,4))::DOUBLE, 4) AS total_ms, round(quantile_cont(value, 0.95), 6) AS p95_ms FROM events GROUP BY 1")
def latency_summary(spark, sf):
    return insights.latency(t(spark, sf, "events"), operation="event_type", ms="value")


@query("span_pairing", """
WITH m AS (SELECT user_id, event_id, ts, event_type = 'view' AS s, lag(event_type = 'view') OVER w AS ps, lag(event_id) OVER w AS pid, lag(ts) OVER w AS pts FROM events WHERE event_type IN ('view', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, CASE WHEN ps THEN pid END AS start_id, event_id AS end_id, CASE WHEN ps THEN round((epoch_us(ts) - epoch_us(pts)) / 1e6, 3) ELSE 0 END AS seconds FROM m WHERE NOT s""")
def span_pairing(spark, sf):
    return insights.pair_spans(t(spark, sf, "events"), entity="user_id", ts="ts", id="event_id", is_start=F.col("event_type") == "view", is_end=F.col("event_type") == "purchase")


@query("validation_event", "SELECT user_id, count(*) FILTER (event_type = 'error') AS n_issues, count(*) FILTER (event_type = 'error' AND value > 30) AS n_high, greatest(0, 100 - 5 * count(*) FILTER (event_type = 'error')) AS score FROM events GROUP BY 1")
def validation_event(spark, sf):
    bad = F.col("event_type") == "error"
    return insights.validation_events(t(spark, sf, "events"), doc="user_id", is_issue=bad, is_high=F.col("value") > 30)


@query("feedback_by_doc", "SELECT conv_id, turn, role, (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::INT AS nth FROM conversations")
def feedback_by_doc(spark, sf):
    return insights.last_n(t(spark, sf, "conversations"), key="conv_id", order=["turn"]).select("conv_id", "turn", "role", "nth")


@query("feedback_by_field", "SELECT role, conv_id, turn, (row_number() OVER (PARTITION BY role ORDER BY conv_id, turn))::INT AS nth FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY conv_id DESC, turn DESC) AS r FROM conversations) WHERE r <= 50")
def feedback_by_field(spark, sf):
    return insights.last_n(t(spark, sf, "conversations"), key="role", order=["conv_id", "turn"], n=50).select("role", "conv_id", "turn", "nth")


@query("feedback_stats", "SELECT left(role, 4) AS field_group, count(*) AS n, count(DISTINCT conv_id) AS n_docs FROM conversations GROUP BY GROUPING SETS ((left(role, 4)), ())")
def feedback_stats(spark, sf):
    return insights.group_stats(t(spark, sf, "conversations"), doc="conv_id", group=F.left("role", F.lit(4)))


@query("feedback_latest", "SELECT conv_id, turn, role FROM conversations ORDER BY conv_id DESC, turn DESC LIMIT 10")
def feedback_latest(spark, sf):
    """The last ten rows beside the totals of ``feedback_stats``."""
    return insights.latest(t(spark, sf, "conversations"), order=["conv_id", "turn"], n=10).select("conv_id", "turn", "role")


@query("extraction_examples", "SELECT p_partkey, arg_min(k, o) AS matched FROM part JOIN (VALUES ('widget', 1), ('RED', 2), ('bolt', 3), ('ring', 0)) v(k, o) ON contains(lower(p_name), lower(k)) GROUP BY 1")
def extraction_examples(spark, sf):
    dim = spark.createDataFrame([("widget", 1), ("RED", 2), ("bolt", 3), ("ring", 0)], "k string, o int")
    return insights.first_contained(t(spark, sf, "part"), dim, text="p_name", name="k", ordinal="o", id="p_partkey")


#: Corrections of a turn: the second would correct what the first inserts, the fifth lies across a deletion, the last is there only in changed text.
CORRECTIONS = ((1, "e", "E"), (2, "En", "nE"), (3, "ar", ""), (4, "o", "(o)"), (5, "st", "ts"), (6, "(", "["))
_MARKED = "text"
for _i, _old, _ in CORRECTIONS:
    _MARKED = f"replace({_MARKED}, '{_old}', chr({_i}))"  # a changed place is one control character, which no later correction meets
_WRITTEN = "marked"
for _i, _, _new in CORRECTIONS:
    _WRITTEN = f"replace({_WRITTEN}, chr({_i}), '{_new}')"
_STATES = ["text"]
for _i, _old, _ in CORRECTIONS:
    _STATES.append(f"replace({_STATES[-1]}, '{_old}', chr({_i}))")


def _written_so_far(state: str, n: int) -> str:
    for i, _, new in CORRECTIONS[:n]:
        state = f"replace({state}, chr({i}), '{new}')"
    return state


_SKIPPED = " + ".join(f"(contains({_written_so_far(_STATES[n], n)}, '{old}') AND NOT contains({_STATES[n]}, '{old}'))::INT" for n, (_, old, _) in enumerate(CORRECTIONS))


@query("summary_examples", f"""WITH m AS (SELECT conv_id, turn, text, {_MARKED} AS marked, {_SKIPPED} AS n_skipped FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, turn, md5({_WRITTEN}) AS corrected_md5, {len(CORRECTIONS)} AS n_corrections, n_skipped, {CORRECTIONS[-1][0]} AS latest, {" + ".join(f"length(marked) - length(replace(marked, chr({i}), ''))" for i, _, _ in CORRECTIONS)} AS n_spans FROM m WHERE {_WRITTEN} <> text""")
def summary_examples(spark, sf):
    texts = t(spark, sf, "conversations").select(F.struct("conv_id", "turn").alias("conv_id"), "text")
    fixes = texts.select("conv_id", F.explode(F.array(*[F.struct(F.lit(i).alias("ts"), F.lit(old).alias("old"), F.lit(new).alias("new")) for i, old, new in CORRECTIONS])).alias("c")).select("conv_id", "c.*")
    out = insights.apply_corrections(texts, doc="conv_id", text="text", corrections=fixes, order="ts", old="old", new="new")
    return out.select("conv_id.conv_id", "conv_id.turn", F.md5("corrected").alias("corrected_md5"), "n_corrections", "n_skipped", "latest", F.size("spans").alias("n_spans"))


@query("correction_rate", "SELECT source, count(*) AS n_items, round(avg(n_chars / 1000), 6) AS mean_confidence, count(l.doc_id) FILTER (quality = 0) AS n_feedback, round(count(l.doc_id) FILTER (quality = 0) / count(*), 6) AS rate FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def correction_rate(spark, sf):
    docs = t(spark, sf, "documents").withColumn("confidence", F.col("n_chars") / 1000)
    bad = docs.join(t(spark, sf, "labels").filter("quality = 0"), "doc_id")
    return insights.error_rates(bad, docs, key="source", confidence="confidence")


@query("lookup_projection", "SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS first_priority, arg_max(o_orderstatus, o_orderkey) AS last_status FROM orders GROUP BY 1")
def lookup_projection(spark, sf):
    return insights.document_card(t(spark, sf, "orders"), doc="o_custkey", order="o_orderkey", first={"first_priority": "o_orderpriority"}, last={"last_status": "o_orderstatus"})


@query("run_card", f"""WITH {FLAGS_SQL}, a AS (SELECT source, count(*) AS n_docs, count(DISTINCT md5(text)) AS n_texts FROM documents GROUP BY 1), b AS (SELECT source, count(*) AS n_flags, count(*) FILTER (level = 'high') AS n_high FROM flags GROUP BY 1)
SELECT source, n_docs, n_texts, coalesce(n_flags, 0) AS n_flags, coalesce(n_high, 0) AS n_high FROM a LEFT JOIN b USING (source)""")
def run_card(spark, sf):
    a = t(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n_docs"), F.countDistinct(F.md5("text")).alias("n_texts"))
    b = flags(spark, sf).groupBy("source").agg(F.count("*").alias("n_flags"), F.count_if(F.col("level") == "high").alias("n_high"))
    return insights.run_card(a, b, key="source")


@query("derive_events", f"WITH {FLAGS_SQL} SELECT doc_id, 'risk' AS event_type, rule AS subject, level AS detail FROM flags UNION ALL SELECT doc_id, 'decision', lang, CASE WHEN n_chars > 1000 THEN 'long' ELSE 'short' END FROM documents")
def derive_events(spark, sf):
    size = F.when(F.col("n_chars") > 1000, "long").otherwise("short")
    return insights.derive_events(t(spark, sf, "documents"), flags(spark, sf), id="doc_id", decision=("lang", size), risk=("rule", "level"))


@query("portfolio_kpis", """
WITH p AS (SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS period, count(*) AS n, round(sum(o_totalprice::DECIMAL(18,2))::DOUBLE, 2) AS total, count(*) FILTER (o_orderstatus = 'F') AS n_flagged FROM orders GROUP BY 1)
SELECT *, round(100.0 * (n - lag(n) OVER w) / lag(n) OVER w, 6)::DOUBLE AS n_change, round(100.0 * (total - lag(total) OVER w) / lag(total) OVER w, 6) AS total_change, round(100.0 * (n_flagged - lag(n_flagged) OVER w) / lag(n_flagged) OVER w, 6)::DOUBLE AS flagged_change FROM p WINDOW w AS (ORDER BY period)""")
def portfolio_kpis(spark, sf):
    return insights.kpis(t(spark, sf, "orders"), ts="o_orderdate", period="month", value=F.col("o_totalprice"), flagged=F.col("o_orderstatus") == "F")
