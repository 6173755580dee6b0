"""Sources, sinks, extraction and text tables over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedge.functions import catalogues, udtfs
from sedge.functions.rules import Rule, RuleSet
from sedge.functions.storage import fresh_path
from sedge.operators import facts, segment, texttables
from sedge.plans.base import over, query, t
from sedge.sources import tables

#: SQL for a JSON response per event: some are cut short, some wrapped in prose, some break a rule.
RAW_SQL = """raw AS (SELECT event_id, user_id, CASE event_id % 8
  WHEN 0 THEN 'reply: {"category": "' || event_type || '", "confidence": 0.5, "risk_flags": []} end'
  WHEN 1 THEN '{"category": "' || event_type || '", "confid'
  WHEN 2 THEN '{"category": 7, "confidence": 0.5, "risk_flags": []}'
  WHEN 3 THEN '{"category": "' || event_type || '", "confidence": "high", "risk_flags": []}'
  WHEN 4 THEN '{"category": "' || event_type || '", "confidence": 1.5, "risk_flags": []}'
  WHEN 5 THEN '{"category": "' || event_type || '", "confidence": 0.5}'
  WHEN 6 THEN '{"category": "' || event_type || '", "confidence": 0.5, "risk_flags": [{"level": "huge", "description": "x"}]}'
  ELSE '{"category": "' || event_type || '", "confidence": 0.5, "risk_flags": [{"level": "low", "description": "x"}]}' END AS raw FROM events)"""


def raw_responses(spark, sf):
    return over(spark, f"WITH {RAW_SQL} SELECT * FROM raw", events=t(spark, sf, "events"))


@query("scan_documents", "SELECT doc_id, CASE WHEN contains(source, 'src1') THEN 'AMENDMENT' WHEN contains(source, 'src2') THEN 'EXHIBIT' ELSE 'BASE' END AS doc_class, length(text) AS n FROM documents")
def scan_documents(spark, sf):
    docs = tables.read_documents(spark, f"{sf}/documents.parquet")
    return docs.select("doc_id", tables.doc_class(F.col("source"), (("src1", "AMENDMENT"), ("src2", "EXHIBIT"))).alias("doc_class"), F.length("text").alias("n"))


@query("scan_jsonl_logs", "SELECT event_id, CASE WHEN event_id % 13 <> 0 THEN json_extract(props, '$.k')::BIGINT END AS k, event_id % 13 = 0 AS quarantined FROM events")
def scan_jsonl_logs(spark, sf):
    raw = t(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 13 == 0, F.left("props", F.length("props") - 1)).otherwise(F.col("props")).alias("line"))
    good, bad = tables.parse_jsonl(raw, raw="line", schema="k bigint")
    return good.select("event_id", "k", F.lit(False).alias("quarantined")).unionByName(bad.select("event_id", F.lit(None).cast("bigint").alias("k"), F.lit(True).alias("quarantined")))


@query("scan_artifacts")
def scan_artifacts(spark, sf):
    found, missing = tables.read_artifacts(spark, sf, expected=["documents", "labels", "summaries"])
    return found.select("artifact", "n_files", "n_bytes").unionByName(missing.select("artifact", F.lit(0).cast("long").alias("n_files"), F.lit(0).cast("long").alias("n_bytes")))


@query("artifact_rows")
def artifact_rows(spark, sf):
    """Files of the input folder by the folder that holds them."""
    return tables.artifact_rows(spark, sf)


@query("model_response_parse", f"WITH {RAW_SQL} SELECT event_id, CASE WHEN event_id % 8 = 1 THEN NULL WHEN event_id % 8 = 2 THEN '7' ELSE split_part(split_part(raw, '\"category\": \"', 2), '\"', 1) END AS category FROM raw")
def model_response_parse(spark, sf):
    return tables.parse_responses(raw_responses(spark, sf), raw="raw").select("event_id", F.try_variant_get("response", "$.category", "string").alias("category"))


@query("model_response_validate", """SELECT event_id, CASE event_id % 8 WHEN 1 THEN 'not json' WHEN 2 THEN 'category' WHEN 3 THEN 'confidence type' WHEN 4 THEN 'confidence range' WHEN 5 THEN 'risk_flags' WHEN 6 THEN 'risk flag' END AS reject_reason FROM events""")
def model_response_validate(spark, sf):
    return tables.validate_responses(tables.parse_responses(raw_responses(spark, sf), raw="raw")).select("event_id", "reject_reason")


@query("model_response_explode", """
WITH c AS (SELECT conv_id, role, turn, length(text) % 100 / 100.0 AS confidence FROM conversations WHERE role <> 'system'),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS nth FROM c)
SELECT conv_id, role || '_data' || CASE WHEN nth > 1 THEN '_' || nth ELSE '' END AS clause_key, round(confidence, 6)::DOUBLE AS confidence, confidence < 0.5 AS needs_review FROM n""")
def model_response_explode(spark, sf):
    item = F.struct("turn", F.col("role").alias("clause_type"), (F.length("text") % 100 / 100).alias("confidence"))
    rows = t(spark, sf, "conversations").groupBy("conv_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(item)).alias("detected_clauses"))).alias("raw"))
    out = tables.responses_to_clauses(tables.parse_responses(rows, raw="raw"), id="conv_id", skip=["system"])
    return out.select("conv_id", "clause_key", F.round("confidence", 6).alias("confidence"), "needs_review")


@query("request_table", "SELECT doc_id, md5(CASE WHEN length(text) > 6000 THEN left(text, 2000) || chr(10) || '...' || chr(10) || right(text, 2000) ELSE text END) AS content_md5 FROM documents")
def request_table(spark, sf):
    return tables.build_requests(t(spark, sf, "documents"), text="text").select("doc_id", F.md5("content").alias("content_md5"))


@query("sample_excerpts", """
SELECT doc_id, i::INT AS piece_no, md5(p[i + 1]) AS excerpt_md5 FROM (SELECT doc_id, p, unnest(range(len(p))) AS i FROM (SELECT doc_id, CASE WHEN length(text) > 10000 THEN
  [substring(text, 1, 500), substring(text, length(text) // 3 + 1, 500), substring(text, 2 * length(text) // 3 + 1, 500), substring(text, length(text) - 499, 500)] ELSE [left(text, 2000)] END AS p FROM documents))""")
def sample_excerpts(spark, sf):
    return tables.excerpts(t(spark, sf, "documents"), id="doc_id", text="text").select("doc_id", "piece_no", F.md5("excerpt").alias("excerpt_md5"))


#: Responses in every shape; a customer's orders are the segments of one document.
SHAPES = """shapes AS (SELECT o_custkey AS doc, CASE WHEN o_orderkey % 2 = 0 THEN 'Base Rent ' ELSE 'Other ' END || CAST(o_orderkey AS STRING) AS section, o_orderkey AS k,
  CASE o_orderkey % 3 WHEN 0 THEN '{"detected_clauses": [{"clause_type": "base_rent", "confidence": 0.' || CAST(o_orderkey % 10 AS STRING) || ', "risks": [' || CASE WHEN o_orderkey % 4 = 0 THEN '{"level": "high"}, "late"' ELSE '' END || ']}, {"clause_type": "Signature block", "confidence": 1.0}, {"clause_type": "use"}]}'
  WHEN 1 THEN 'Here: {"miscellaneous_clauses": ["A late fee of ' || CAST(o_orderkey AS STRING) || '", "Anything else"]}' ELSE '{"extracted_items": [{"clause_type": "use", "confidence": 0.' || CAST(o_orderkey % 10 AS STRING) || '}, {"clause_type": "parking", "confidence": 0.85}]}' END AS raw FROM orders)"""


@query("response_clauses", f"""WITH {SHAPES}, u AS (
  SELECT doc, section, k, 0 AS shape, 0 AS pos, 'base_rent' AS t, k % 10 / 10 AS c, NOT contains(lower(section), 'base rent') AS inferred, k % 10 < 5 OR k % 4 = 0 AS review FROM shapes WHERE k % 3 = 0 UNION ALL SELECT doc, section, k, 0, 2, 'use', 0.0, true, true FROM shapes WHERE k % 3 = 0
  UNION ALL SELECT doc, section, k, 1, 0, 'penalty', 0.6, true, false FROM shapes WHERE k % 3 = 1 UNION ALL SELECT doc, section, k, 1, 1, 'misc', 0.7, true, false FROM shapes WHERE k % 3 = 1
  UNION ALL SELECT doc, section, k, 2, 0, 'use', k % 10 / 10, false, k % 10 < 8 FROM shapes WHERE k % 3 = 2 UNION ALL SELECT doc, section, k, 2, 1, 'parking', 0.85, false, false FROM shapes WHERE k % 3 = 2),
n AS (SELECT *, row_number() OVER (PARTITION BY doc, t ORDER BY shape, section, pos) AS nth FROM u)
SELECT doc, section, CASE shape WHEN 0 THEN 'detected' WHEN 1 THEN 'loose' ELSE 'item' END AS shape, t || '_data' || CASE WHEN nth > 1 THEN '_' || nth ELSE '' END AS clause_key, t AS clause_type, round(c::DOUBLE, 6) AS confidence, inferred, review AS needs_review FROM n""")
def response_clauses(spark, sf):
    rows = over(spark, f"WITH {SHAPES} SELECT doc, section, raw FROM shapes", orders=t(spark, sf, "orders"))
    out = tables.response_clauses(tables.parse_responses(rows, raw="raw"), id="doc", section="section", kinds=RuleSet([Rule("penalty", "late fee|fine")]))
    return out.withColumn("confidence", F.round("confidence", 6))


@query("request_table_head", "SELECT doc_id, md5(CASE WHEN length(text) > 8000 THEN left(text, 8000) || chr(10) || '...' || chr(10) ELSE text END) AS content_md5 FROM documents")
def request_table_head(spark, sf):
    return tables.build_requests(t(spark, sf, "documents"), text="text", most=8000, policy="head").select("doc_id", F.md5("content").alias("content_md5"))


@query("answered_requests", "SELECT doc_id, length(CASE WHEN length(text) > 6000 THEN left(text, 2000) || chr(10) || '...' || chr(10) || right(text, 2000) ELSE text END) AS n, NULL AS reject_reason FROM documents")
def answered_requests(spark, sf):
    """A given function in the model's place: here one that answers with the length of its text."""

    def lengths(texts):
        return [f'{{"category": "{len(x)}", "confidence": 1, "risk_flags": []}}' for x in texts]

    asked = tables.run_requests(tables.build_requests(t(spark, sf, "documents"), text="text").select("doc_id", "content"), lengths)
    out = tables.validate_responses(tables.parse_responses(asked, raw="raw"))
    return out.select("doc_id", F.try_variant_get("response", "$.category", "string").cast("long").alias("n"), "reject_reason")


@query("sample_excerpts_thirds", """
SELECT doc_id, i::INT AS piece_no, md5(p[i + 1]) AS excerpt_md5 FROM (SELECT doc_id, p, unnest(range(len(p))) AS i FROM (SELECT doc_id, CASE WHEN length(text) > 50000 THEN [substring(text, 1, 15000), substring(text, (length(text) - 15000) // 2 + 1, 15000), substring(text, length(text) - 14999, 15000)]
  WHEN length(text) > 10000 THEN [substring(text, 1, 500), substring(text, length(text) // 3 + 1, 500), substring(text, 2 * length(text) // 3 + 1, 500), substring(text, length(text) - 499, 500)] ELSE [left(text, 2000)] END AS p FROM documents))""")
def sample_excerpts_thirds(spark, sf):
    return tables.excerpts(t(spark, sf, "documents"), id="doc_id", text="text", thirds_over=50_000).select("doc_id", "piece_no", F.md5("excerpt").alias("excerpt_md5"))


@query("sink_tables", "SELECT lang, count(*) AS n, count(DISTINCT doc_id) AS n_ids, format FROM documents, (VALUES ('parquet'), ('json'), ('csv')) f(format) GROUP BY lang, format")
def sink_tables(spark, sf):
    """Write the flags of documents in three formats and read them back."""
    rows = t(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    folders = tables.write_outputs(rows, fresh_path(spark, "sink"), partition_by=["lang"])
    out = None
    for fmt, folder in folders.items():
        back = spark.read.format(fmt).option("header", True).load(folder).groupBy("lang").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_ids")).withColumn("format", F.lit(fmt))
        out = back if out is None else out.unionByName(back)
    return out


EXPORT_SQL = """
x AS (SELECT p_partkey, p_size, p_name, p_brand, p_type FROM part),
v AS (SELECT p_partkey, unnest([['name', p_name], ['brand_id', p_brand]]) AS kv, p_size, p_name FROM x WHERE p_size % 3 = 0)"""


_PAGES = "CASE WHEN p_size % 5 = 0 THEN '' WHEN p_size % 4 = 0 THEN (p_size % 7)::VARCHAR ELSE (p_size % 7) || '-' || (p_size % 7 + p_size % 4) END AS page_range"
_SHOWN = f"printf('%.2f', round(p_size / 50.0, 2)) AS confidence, {_PAGES}, CASE WHEN p_size % 2 = 0 THEN 'Yes' ELSE 'No' END AS truncated"


@query("sink_flat_export_full", f"""WITH {EXPORT_SQL}
SELECT p_partkey, kv[1] AS key, kv[2] AS value, CASE WHEN kv[1] = 'brand_id' AND p_size % 2 = 0 THEN 'high' WHEN p_size % 2 = 1 THEN 'low' END AS level, CASE WHEN kv[1] = 'brand_id' AND p_size % 2 = 0 THEN 'Brand unclear' WHEN p_size % 2 = 1 THEN 'other' END AS description, {_SHOWN} FROM v
UNION ALL SELECT p_partkey, 'Risk', NULL, 'low', 'other', {_SHOWN} FROM x WHERE p_size % 3 = 1
UNION ALL SELECT p_partkey, 'General', NULL, NULL, NULL, {_SHOWN} FROM x WHERE p_size % 3 = 2""")
def sink_flat_export_full(spark, sf):
    size = F.col("p_size")
    extra = export_rows(spark, sf).withColumn("conf", F.round(size / 50.0, 2)).withColumn("a", F.when(size % 5 != 0, size % 7)).withColumn("b", size % 7 + size % 4).withColumn("cut", size % 2 == 0)
    return tables.flat_export_full(extra, keep=["p_partkey"], values="values", risks="risks", confidence="conf", page_start="a", page_end="b", truncated="cut")


@query("sink_flat_export", f"""WITH {EXPORT_SQL}
SELECT p_partkey, kv[1] AS key, kv[2] AS value, CASE WHEN kv[1] = 'brand_id' AND p_size % 2 = 0 THEN 'high' WHEN p_size % 2 = 1 THEN 'low' END AS level, CASE WHEN kv[1] = 'brand_id' AND p_size % 2 = 0 THEN 'Brand unclear' WHEN p_size % 2 = 1 THEN 'other' END AS description FROM v
UNION ALL SELECT p_partkey, 'Risk', NULL, 'low', 'other' FROM x WHERE p_size % 3 = 1
UNION ALL SELECT p_partkey, 'General', NULL, NULL, NULL FROM x WHERE p_size % 3 = 2""")
def sink_flat_export(spark, sf):
    return tables.flat_export(export_rows(spark, sf), keep=["p_partkey"], values="values", risks="risks")


def export_rows(spark, sf):
    size = F.col("p_size")
    risk = lambda level, text: F.struct(F.lit(level).alias("level"), F.lit(text).alias("description"))
    none = F.expr("cast(array() as array<struct<level: string, description: string>>)")
    risks = F.when(size % 3 == 2, none).when((size % 3 == 0) & (size % 2 == 0), F.array(risk("high", "Brand unclear"), risk("medium", "zzz"))).otherwise(F.array(risk("low", "other")))
    return t(spark, sf, "part").select("p_partkey", "p_size", F.when(size % 3 == 0, F.create_map(F.lit("name"), F.col("p_name"), F.lit("brand_id"), F.col("p_brand"))).alias("values"), risks.alias("risks"))


@query("sink_markdown", """
SELECT conv_id, CASE WHEN count(*) < 5 THEN '# Limited report' ELSE '# Report' END || chr(10) || string_agg('## ' || role || chr(10) || text, chr(10) ORDER BY turn) AS report FROM conversations GROUP BY 1""")
def sink_markdown(spark, sf):
    rows = t(spark, sf, "conversations").select("conv_id", "turn", "role", F.col("text").alias("body"))
    return tables.report_markdown(rows, doc="conv_id", title="role", body="body", order="turn")


CATALOGUE = (
    facts.FactRule("email", r"[A-Za-z0-9._-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", 0, 0.9),
    facts.FactRule("licence", r"[Ll]icense", 0, 0.8),
    facts.FactRule("address", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", 0, 0.7),
    facts.FactRule("number", r"[0-9]{4,}", 0, 0.5),
)
_LISTS = ", ".join(f"list_transform(regexp_extract_all(text, '{r.pattern}'), lambda v: {{'field': '{r.field}', 'v': v, 'rule_id': {i}}})" for i, r in enumerate(CATALOGUE))
FACTS_SQL = f"f0 AS (SELECT doc_id, unnest(flatten([{_LISTS}])) AS f FROM documents), facts AS (SELECT doc_id, f.field AS field, regexp_replace(f.v, '[ ,.]+$', '') AS value, f.rule_id::INT AS rule_id FROM f0)"


def fact_rows(spark, sf, mode="all"):
    return facts.extract_facts(t(spark, sf, "documents"), CATALOGUE, id="doc_id", text="text", mode=mode)


@query("facts_job", f"WITH {FACTS_SQL} SELECT doc_id, field, value, rule_id, count(*) AS n FROM facts GROUP BY ALL")
def facts_job(spark, sf):
    return fact_rows(spark, sf).groupBy("doc_id", "field", "value", "rule_id").agg(F.count("*").alias("n"))


@query("facts_overview", "SELECT doc_id, array_to_string(regexp_extract_all(text, '[0-9]{4,}')[:3], '|') AS first_numbers, len(regexp_extract_all(text, '[^ \\t\\r\\n\\f\\x0b]+')) AS n_words, greatest(1, length(text) // 3000) AS n_pages FROM documents".replace("\\\\", "\\"))
def facts_overview(spark, sf):
    c = F.col("text")
    return t(spark, sf, "documents").select("doc_id", F.array_join(F.slice(F.regexp_extract_all(c, F.lit("[0-9]{4,}"), F.lit(0)), 1, 3), "|").alias("first_numbers"), F.regexp_count(c, F.lit(r"[^ \t\r\n\f\x0b]+")).cast("long").alias("n_words"), F.greatest(F.lit(1), F.floor(F.length(c) / 3000)).alias("n_pages"))


@query("kv_text_parse", "SELECT event_id, regexp_extract(props, '\"k\": ([0-9]+)', 1) AS value FROM events")
def kv_text_parse(spark, sf):
    rules = [facts.FactRule("k", r'"k": ([0-9]+)', 1)]
    return facts.extract_facts(t(spark, sf, "events"), rules, id="event_id", text="props", mode="first", least_chars=1).select("event_id", "value")


_TYPES = (("MAIL", ("@",)), ("LICENCE", ("license", "copyright")), ("NUMBERS", ("1", "2")))


@query("overview_rows", "SELECT doc_id, CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower(text), {w!r})' for w in words)} THEN '{name}'" for name, words in _TYPES) + r" ELSE 'OTHER' END AS doc_type, array_to_string(regexp_extract_all(text, '([0-9]{1,3}\.[0-9]{1,3})', 1)[:3], '|') AS dates, array_to_string(regexp_extract_all(text, '([0-9]{4,})', 1)[:3], '|') AS amounts, len(regexp_extract_all(text, '[^ \t\r\n\f\x0b]+')) AS n_words, greatest(1, length(text) // 3000) AS n_pages FROM documents")
def overview_rows(spark, sf):
    out = facts.overview(t(spark, sf, "documents"), id="doc_id", text="text", types=_TYPES, date=r"([0-9]{1,3}\.[0-9]{1,3})", amount="([0-9]{4,})")
    return out.withColumns({c: F.array_join(c, "|") for c in ("dates", "amounts")})


#: Answers in plain text, with several names for a field.
ANSWERS = """answers AS (SELECT o_orderkey AS id, 'I found this:' || chr(10) || 'Tenant: Customer ' || CAST(o_custkey AS STRING) || chr(10) || '- "landlord" = "Clerk Ltd",' || chr(10) || 'rent: ' || CAST(o_orderkey % 1000 AS STRING) || chr(10)
  || CASE WHEN o_orderkey % 3 = 0 THEN '* Base Rent: $' || CAST(o_orderkey % 77 AS STRING) || chr(10) ELSE '' END || 'Start date: ' || CASE WHEN o_orderkey % 4 = 0 THEN 'null' WHEN o_orderkey % 4 = 1 THEN 'N/A' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END || chr(10) || 'Use:   ' || chr(10) || 'remarks:none' AS answer FROM orders)"""


@query("key_value_rows", f"""WITH {ANSWERS}, f AS (SELECT id, 'tenant' AS field, 'Customer ' || o_custkey AS value FROM answers JOIN orders ON o_orderkey = id UNION ALL SELECT id, 'landlord', 'Clerk Ltd' FROM answers
UNION ALL SELECT id, 'rent', CASE WHEN id % 3 = 0 THEN '$' || id % 77 ELSE (id % 1000)::VARCHAR END FROM answers UNION ALL SELECT id, 'start_date', o_orderdate::DATE::VARCHAR FROM answers JOIN orders ON o_orderkey = id WHERE id % 4 > 1) SELECT * FROM f""")
def key_value_rows(spark, sf):
    rows = over(spark, f"WITH {ANSWERS} SELECT * FROM answers", orders=t(spark, sf, "orders"))
    return facts.parse_key_values(rows, catalogues.KEY_VALUES, id="id", text="answer")


@query("facts_merge", f"""WITH {FACTS_SQL}, a AS (SELECT doc_id, min(value) AS v FROM facts WHERE field = 'email' GROUP BY 1), b AS (SELECT doc_id, min(value) AS v FROM facts WHERE field IN ('number', 'address') GROUP BY 1)
SELECT doc_id, coalesce(a.v, b.v) AS value, CASE WHEN a.v IS NOT NULL THEN 'primary' ELSE 'secondary' END AS origin FROM a FULL OUTER JOIN b USING (doc_id)""")
def facts_merge(spark, sf):
    rows = fact_rows(spark, sf)
    least = lambda fields: rows.filter(F.col("field").isin(*fields)).groupBy("doc_id").agg(F.min("value").alias("value"))
    return facts.merge_facts(least(["email"]), least(["number", "address"]), keys=["doc_id"])


@query("facts_pivot", f"""WITH o AS (SELECT doc_id, text FROM documents), {FACTS_SQL}
SELECT doc_id, nullif(regexp_extract(text, '{CATALOGUE[0].pattern}'), '') AS email, nullif(regexp_replace(regexp_extract(text, '{CATALOGUE[2].pattern}'), '[ ,.]+$', ''), '') AS address, nullif(regexp_extract(text, '[0-9]{{4,}}'), '') AS number FROM o WHERE doc_id IN (SELECT doc_id FROM facts)""")
def facts_pivot(spark, sf):
    return facts.facts_wide(fact_rows(spark, sf), ["email", "address", "number"], id="doc_id")


@query("facts_coverage", f"""WITH {FACTS_SQL}, p AS (SELECT doc_id, count(*) AS n FROM facts GROUP BY 1)
SELECT source, count(*) AS n_docs, count(p.n) AS n_with, coalesce(sum(p.n), 0)::BIGINT AS n_facts, (SELECT count(DISTINCT field) FROM facts JOIN documents e USING (doc_id) WHERE e.source = d.source)::INT AS n_fields, round(count(p.n) / count(*), 6) AS share FROM documents d LEFT JOIN p USING (doc_id) GROUP BY source""")
def facts_coverage(spark, sf):
    return facts.coverage(t(spark, sf, "documents"), fact_rows(spark, sf), id="doc_id", by="source")


@query("corpus_facts", f"""WITH {FACTS_SQL}, l AS (SELECT doc_id, len(string_split(text, chr(10))) AS n_lines, greatest(1, length(text) // 3000) AS n_pages FROM documents), p AS (SELECT doc_id, count(*) AS n FROM facts GROUP BY 1)
SELECT source, lang, count(*) AS n_docs, sum(n_lines)::BIGINT AS n_lines, sum(n_pages)::BIGINT AS n_pages, coalesce(sum(p.n), 0)::BIGINT AS n_facts, round(count(p.n) / count(*), 6) AS share FROM documents JOIN l USING (doc_id) LEFT JOIN p USING (doc_id) GROUP BY 1, 2""")
def corpus_facts(spark, sf):
    """Flagship: per source and language documents, lines, pages, facts and the share of documents with any fact."""
    docs = t(spark, sf, "documents").select("doc_id", "text", "source", "lang")
    n_lines = segment.lines(docs).groupBy("doc_id").agg(F.count("*").alias("n_lines"))
    n_pages = segment.page_markers(docs).groupBy("doc_id").agg(F.count("*").alias("n_pages"))
    n_facts = fact_rows(spark, sf).groupBy("doc_id").agg(F.count("*").alias("n"))
    rows = docs.select("doc_id", "source", "lang").join(n_lines, "doc_id").join(n_pages, "doc_id").join(n_facts, "doc_id", "left")
    out = rows.groupBy("source", "lang").agg(F.count("*").alias("n_docs"), F.sum("n_lines").alias("n_lines"), F.sum("n_pages").alias("n_pages"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_facts"), F.count("n").alias("_w"))
    return out.withColumn("share", F.round(F.col("_w") / F.col("n_docs"), 6)).drop("_w")


@query("term_resolution", r"""
WITH w AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Z][a-z]{5,}'))) AS term FROM benchmark),
k AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS term FROM documents) SELECT doc_id, term, length(term) AS definition FROM k JOIN w USING (term)""")
def term_resolution(spark, sf):
    words = t(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{5,}"), F.lit(0))).alias("w")).select(F.lower("w").alias("term")).distinct()
    return facts.resolve_terms(t(spark, sf, "documents"), words.withColumn("definition", F.length("term")), id="doc_id", text="text", term="term", definition="definition")


@query("deadline_calc", "SELECT o_orderkey, (o_orderdate::DATE + CASE o_orderkey % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 * 30 ELSE 365 END)::DATE AS due FROM orders".replace("WHEN 1 THEN 2 * 30", "WHEN 1 THEN 60"))
def deadline_calc(spark, sf):
    third = F.col("o_orderkey") % 3
    n, unit = F.when(third == 0, 5).when(third == 1, 2).otherwise(1), F.when(third == 0, "days").when(third == 1, "months").otherwise("year")
    return t(spark, sf, "orders").select("o_orderkey", facts.deadline(F.to_date("o_orderdate"), n, unit).alias("due"))


@query("total_cost_calc", "SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice + l_quantity * 2 + l_tax + l_discount + l_quantity, 4) AS subtotal, round((l_extendedprice + l_tax + l_discount + l_quantity) * 12, 4) AS annual FROM lineitem")
def total_cost_calc(spark, sf):
    others = F.create_map(F.lit("a"), F.col("l_discount"), F.lit("b"), F.col("l_quantity"))
    sub, year = facts.totals(base=F.col("l_extendedprice"), share=F.col("l_tax"), pct=F.col("l_quantity") * 2, others=others)
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(sub, 4).alias("subtotal"), F.round(year, 4).alias("annual"))


#: Texts with tables: the documents, a pipe table per order and, for every third order, a tab table with the same lines twice.
TABLE_TEXTS = """
ln0 AS (SELECT l_orderkey, CAST(l_linenumber AS STRING) || '|' || CAST(l_partkey AS STRING) || '|' || CAST(CAST(floor(l_quantity) AS INT) AS STRING) || '|' || CASE WHEN l_linenumber % 3 = 0 THEN 'n/a' ELSE l_returnflag END AS line FROM lineitem),
ln1 AS (SELECT l_orderkey, array_to_string(array_sort(array_agg(line)), chr(10)) AS body FROM ln0 GROUP BY l_orderkey),
tx AS (SELECT doc_id, text FROM documents UNION ALL SELECT 1000000000 + l_orderkey, 'Order' || chr(10) || 'line|part|qty|flag' || chr(10) || body || chr(10) || 'end'
  || CASE WHEN l_orderkey % 3 = 0 THEN chr(10) || replace('line|part|qty|flag' || chr(10) || body, '|', chr(9)) || chr(10) || chr(10) || 'line|part|qty|flag' || chr(10) || body ELSE '' END FROM ln1)"""
BLOCK_SQL = TABLE_TEXTS.replace("array_to_string(array_sort(array_agg(line)), chr(10))", "string_agg(line, chr(10) ORDER BY line)") + """,
ls AS (SELECT doc_id, list_zip(range(len(string_split(text, chr(10)))), string_split(text, chr(10))) AS z FROM tx), ln AS (SELECT doc_id, u[1] AS line_no, u[2] AS line FROM (SELECT doc_id, unnest(z) AS u FROM ls)),
c AS (SELECT *, CASE WHEN contains(line, chr(9)) THEN chr(9) WHEN contains(line, '|') THEN '|' END AS sep FROM ln), c2 AS (SELECT *, sep || (length(line) - length(replace(line, sep, ''))) AS n FROM c),
r AS (SELECT *, sum(nw) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN lag(n) OVER (PARTITION BY doc_id ORDER BY line_no) IS NOT DISTINCT FROM n THEN 0 ELSE 1 END AS nw FROM c2)),
r2 AS (SELECT *, count(*) OVER (PARTITION BY doc_id, run) AS size FROM r WHERE n IS NOT NULL),
b AS (SELECT doc_id, (dense_rank() OVER (PARTITION BY doc_id ORDER BY run))::INT AS block_no, (row_number() OVER (PARTITION BY doc_id, run ORDER BY line_no) - 1)::INT AS row_no, line_no, line, sep FROM r2 WHERE size >= 2),
ce0 AS (SELECT doc_id, block_no, row_no, (i - 1)::INT AS col_no, trim(string_split(line, sep)[i], ' ' || chr(9) || chr(13)) AS value FROM (SELECT *, unnest(range(1, len(string_split(line, sep)) + 1)) AS i FROM b)),
ce AS (SELECT d.*, h.value AS header FROM ce0 d JOIN ce0 h ON h.doc_id = d.doc_id AND h.block_no = d.block_no AND h.col_no = d.col_no AND h.row_no = 0 WHERE d.row_no > 0)"""


def table_texts(spark, sf):
    sql = TABLE_TEXTS.replace("array_to_string(", "array_join(")
    return over(spark, f"WITH {sql} SELECT doc_id, text FROM tx", documents=t(spark, sf, "documents"), lineitem=t(spark, sf, "lineitem"))


def blocks(spark, sf):
    return texttables.text_blocks(table_texts(spark, sf), id="doc_id", least_lines=2)


def all_cells(spark, sf):
    return texttables.cells(blocks(spark, sf), id="doc_id")


@query("delimited_blocks", f"WITH {BLOCK_SQL} SELECT doc_id, block_no, row_no, line_no::INT AS line_no, sep = chr(9) AS tabs FROM b")
def delimited_blocks(spark, sf):
    return blocks(spark, sf).select("doc_id", "block_no", "row_no", "line_no", (F.col("delimiter") == "\t").alias("tabs"))


MARKDOWN = """
m0 AS (SELECT o_custkey, o_orderkey, '| ' || CAST(o_orderkey AS STRING) || ' | ' || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderstatus END || ' | ' || o_orderpriority || ' |' AS line FROM orders),
m1 AS (SELECT o_custkey, array_to_string(array_sort(array_agg(line)), chr(10)) AS body FROM m0 GROUP BY o_custkey),
md AS (SELECT o_custkey, 'Customer | notes' || chr(10) || '| order | status | priority |' || chr(10) || CASE o_custkey % 3 WHEN 0 THEN '|---|:-:|---|' WHEN 1 THEN '--- | --- | ---:' ELSE '| dashes - | no | ruler |' END || chr(10) || body || chr(10) || 'end' AS text FROM m1)"""
MARKDOWN_SQL = MARKDOWN.replace("array_to_string(array_sort(array_agg(line)), chr(10))", "string_agg(line, chr(10) ORDER BY line)")


@query("markdown_blocks", f"""WITH {MARKDOWN_SQL}, ls AS (SELECT o_custkey, string_split(text, chr(10)) AS z FROM md), ln AS (SELECT o_custkey, i - 1 AS line_no, z[i] AS line FROM (SELECT *, unnest(range(1, len(z) + 1)) AS i FROM ls)),
ok AS (SELECT o_custkey, line_no, list_filter(list_transform(string_split(line, '|'), lambda c: trim(c)), lambda c: c <> '') AS v FROM ln WHERE o_custkey % 3 < 2 AND line_no <> 2 AND line_no > 0 AND contains(line, '|')),
k AS (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS size FROM ok WHERE len(v) = 3)
SELECT o_custkey, 1 AS block_no, (row_number() OVER (PARTITION BY o_custkey ORDER BY line_no) - 1)::INT AS row_no, line_no::INT AS line_no, array_to_string(v, '~') AS row_text FROM k WHERE size > 1""")
def markdown_blocks(spark, sf):
    texts = over(spark, "WITH " + MARKDOWN.replace("array_to_string(", "array_join(") + " SELECT o_custkey, text FROM md", orders=t(spark, sf, "orders"))
    found = texttables.markdown_blocks(segment.lines(texts, id="o_custkey"), id="o_custkey")
    return found.select("o_custkey", "block_no", "row_no", "line_no", F.array_join("values", "~").alias("row_text"))


@query("table_cells", f"WITH {BLOCK_SQL} SELECT doc_id, block_no, row_no, col_no, header, value FROM ce")
def table_cells(spark, sf):
    return all_cells(spark, sf).select("doc_id", "block_no", "row_no", "col_no", "header", "value")


@query("table_cells_udtf", f"WITH {BLOCK_SQL} SELECT doc_id, block_no, row_no, col_no, header, value FROM ce")
def table_cells_udtf(spark, sf):
    """The same from SQL, by a table function."""
    udtfs.register(spark)
    return over(spark, "SELECT doc_id, c.* FROM texts, LATERAL text_tables(text, 2) c", texts=table_texts(spark, sf))


@query("flat_values_udtf", "SELECT p_partkey, kv[1] AS key, kv[2] AS value FROM (SELECT p_partkey, unnest(CASE WHEN p_size % 3 = 0 THEN [['General', NULL]] ELSE [['brand', p_brand], ['name', p_name]] END) AS kv FROM part)")
def flat_values_udtf(spark, sf):
    udtfs.register(spark)
    empty = F.create_map().cast("map<string,string>")
    part = t(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") % 3 == 0, empty).otherwise(F.create_map(F.lit("name"), F.col("p_name"), F.lit("brand"), F.col("p_brand"))).alias("pairs"))
    return over(spark, "SELECT p_partkey, c.* FROM parts, LATERAL flat_values(pairs) c", parts=part)


@query("table_validate", f"""WITH {BLOCK_SQL}, v AS (SELECT doc_id, block_no, max(row_no)::BIGINT AS n_rows, count(DISTINCT col_no) AS n_cols, count(DISTINCT header) AS h, avg((value <> '')::INT) AS f FROM ce GROUP BY 1, 2)
SELECT doc_id, block_no, n_rows, n_cols, n_rows >= 2 AND n_cols >= 2 AND h >= 0.8 * n_cols AND f >= 0.3 AS valid FROM v""")
def table_validate(spark, sf):
    return texttables.validate(all_cells(spark, sf), id="doc_id")


KINDS_OF_TABLES = (("order lines", ("line", "qty", "flag"), ("a", "7")), ("prose", ("the", "er", "ung"), ("and", "sch")))
_SHARES = ", ".join(f"round(0.6 * ({' + '.join(f'contains(h, {w!r})::INT' for w in heads)}) / {len(heads)} + 0.4 * ({' + '.join(f'contains(v, {w!r})::INT' for w in words)}) / {len(words)}, 6) AS k{i}" for i, (_, heads, words) in enumerate(KINDS_OF_TABLES))


@query("table_type_score", f"""WITH {BLOCK_SQL}, s AS (SELECT doc_id, block_no, lower(string_agg(DISTINCT header, ' ' ORDER BY header)) AS h, lower(coalesce(string_agg(DISTINCT value, ' ' ORDER BY value) FILTER (row_no <= 3), '')) AS v FROM ce GROUP BY 1, 2),
k AS (SELECT *, {_SHARES} FROM s) SELECT doc_id, block_no, CASE WHEN k0 >= k1 THEN 'order lines' ELSE 'prose' END AS kind, greatest(k0, k1)::DOUBLE AS score FROM k""")
def table_type_score(spark, sf):
    return texttables.type_score(all_cells(spark, sf), KINDS_OF_TABLES, id="doc_id")


@query("typed_tables", f"""WITH {BLOCK_SQL}, s AS (SELECT doc_id, block_no, lower(string_agg(DISTINCT header, ' ' ORDER BY header)) AS h, lower(coalesce(string_agg(DISTINCT value, ' ' ORDER BY value) FILTER (row_no <= 3), '')) AS v FROM ce GROUP BY 1, 2),
k AS (SELECT *, {_SHARES} FROM s), b2 AS (SELECT doc_id, block_no, CASE WHEN k0 >= k1 THEN 'order lines' ELSE 'prose' END AS kind, greatest(k0, k1)::DOUBLE AS score FROM k)
SELECT doc_id, block_no, kind, score, round(least(1.0, 1.2 * score), 6)::DOUBLE AS confidence FROM b2 WHERE score > 0.5""")
def typed_tables(spark, sf):
    return texttables.typed_tables(all_cells(spark, sf), KINDS_OF_TABLES, id="doc_id")


#: A roster per order: who rents how much and bears which share; every other order's shares make 100.
ROSTER = """
ro AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS part, CAST(floor(min(l_quantity)) AS INT) AS qty, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber),
rl AS (SELECT l_orderkey, CAST(l_linenumber AS STRING) || '|' || CASE WHEN part % 4 = 0 THEN 'Vacant' ELSE 'T' || CAST(part AS STRING) END || '|' || CAST(qty AS STRING) || '00 sq|' || CAST(CASE WHEN l_orderkey % 2 = 0 AND l_linenumber = 1 THEN 100 - 7 * (n - 1) ELSE 7 END AS STRING) || '.00%' AS line FROM ro),
rx AS (SELECT l_orderkey AS doc_id, 'unit|tenant|area|share' || chr(10) || array_to_string(array_sort(array_agg(line)), chr(10)) AS text FROM rl GROUP BY l_orderkey)"""
ROSTER_SQL = ROSTER.replace("array_to_string(array_sort(array_agg(line)), chr(10))", "string_agg(line, chr(10) ORDER BY line)")


def roster_cells(spark, sf):
    texts = over(spark, f"WITH {ROSTER.replace('array_to_string(', 'array_join(')} SELECT doc_id, text FROM rx", lineitem=t(spark, sf, "lineitem"))
    return texttables.cells(texttables.text_blocks(texts, id="doc_id", least_lines=2), id="doc_id")


def _type_sql() -> str:
    def share(column, words):
        return "(" + " + ".join(f"contains({column}, '{w}')::INT" for w in words) + f") / {len(words)}"

    scores = ", ".join(f"round(0.6 * {share('h', heads)} + 0.4 * {share('v', words)}, 6)" for _, heads, words in catalogues.TABLE_TYPES)
    names = ", ".join(f"'{name}'" for name, _, _ in catalogues.TABLE_TYPES)
    return f"""WITH {ROSTER_SQL}, x AS (SELECT l_orderkey AS doc_id, 'area share tenant unit' AS h, lower(string_agg(line, '|' ORDER BY line) FILTER (nth <= 3)) AS v FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY line) AS nth FROM rl) GROUP BY 1),
s AS (SELECT doc_id, [{scores}] AS s FROM x) SELECT doc_id, 1 AS block_no, list_extract([{names}], list_position(s, list_max(s))::INT) AS kind, list_max(s)::DOUBLE AS score FROM s"""


@query("table_types", _type_sql())
def table_types(spark, sf):
    """Rosters by the built-in types of tables."""
    return texttables.type_score(roster_cells(spark, sf), catalogues.TABLE_TYPES, id="doc_id")


@query("table_cost_shares", f"WITH {ROSTER_SQL} SELECT l_orderkey AS doc_id, 1 AS block_no, sum(CASE WHEN l_orderkey % 2 = 0 AND l_linenumber = 1 THEN 100 - 7 * (n - 1) ELSE 7 END)::DOUBLE AS percent_total, abs(sum(CASE WHEN l_orderkey % 2 = 0 AND l_linenumber = 1 THEN 100 - 7 * (n - 1) ELSE 7 END) - 100) <= 0.01 AS fully_allocated FROM ro GROUP BY 1")
def table_cost_shares(spark, sf):
    return texttables.cost_shares(roster_cells(spark, sf), id="doc_id")


@query("table_occupancy", f"WITH {ROSTER_SQL} SELECT l_orderkey AS doc_id, 1 AS block_no, sum(100 * qty)::DOUBLE AS total_area, coalesce(sum(100 * qty) FILTER (part % 4 <> 0), 0)::DOUBLE AS occupied_area, round(coalesce(sum(qty) FILTER (part % 4 <> 0), 0) / sum(qty), 6)::DOUBLE AS rate FROM ro GROUP BY 1")
def table_occupancy(spark, sf):
    return texttables.occupancy(roster_cells(spark, sf), id="doc_id")


@query("table_validate_typed", f"""WITH {BLOCK_SQL}, v AS (SELECT doc_id, block_no, max(row_no)::BIGINT AS n_rows, count(DISTINCT col_no) AS n_cols, count(DISTINCT header) AS h, avg((value <> '')::INT) AS f, bool_or(regexp_matches(value, '[0-9]')) AS d FROM ce GROUP BY 1, 2),
s AS (SELECT doc_id, block_no, lower(string_agg(DISTINCT header, ' ' ORDER BY header)) AS h, lower(coalesce(string_agg(DISTINCT value, ' ' ORDER BY value) FILTER (row_no <= 3), '')) AS v FROM ce GROUP BY 1, 2), k AS (SELECT *, {_SHARES} FROM s)
SELECT v.doc_id, v.block_no, n_rows, n_cols, n_rows >= 2 AND n_cols >= 2 AND v.h >= 0.8 * n_cols AND f >= 0.3 AND (k0 < k1 OR d) AS valid, CASE WHEN k0 >= k1 THEN 'order lines' ELSE 'prose' END AS kind FROM v JOIN k USING (doc_id, block_no)""")
def table_validate_typed(spark, sf):
    rows = all_cells(spark, sf)
    return texttables.validate_typed(rows, texttables.type_score(rows, KINDS_OF_TABLES, id="doc_id"), ["order lines"], id="doc_id")


@query("table_dedup_topk", f"""WITH {BLOCK_SQL}, x AS (SELECT doc_id, block_no, string_agg(row_no || ':' || col_no || ':' || header || ':' || value, chr(10) ORDER BY row_no, col_no) AS c, count(*) AS score FROM ce GROUP BY 1, 2),
d AS (SELECT doc_id, c, min(block_no) AS block_no, count(*) AS n_copies, any_value(score) AS score FROM x GROUP BY 1, 2)
SELECT doc_id, block_no, n_copies, score, nth::INT AS nth FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, block_no) AS nth FROM d) WHERE nth <= 2""")
def table_dedup_topk(spark, sf):
    rows = all_cells(spark, sf)
    distinct = texttables.dedup_tables(rows, id="doc_id").withColumnRenamed("n_cells", "score")
    return texttables.top_tables(distinct, id="doc_id", score="score", k=2).select("doc_id", "block_no", "n_copies", "score", "nth")


@query("table_rollups", f"""WITH {BLOCK_SQL}, x AS (SELECT *, try_cast(regexp_replace(value, '[^0-9.-]', '', 'g') AS DECIMAL(38,6)) AS x FROM ce)
SELECT doc_id, block_no, sum(CASE WHEN x > 0 THEN x END)::DOUBLE AS total, round(avg(CASE WHEN x > 0 THEN x::DOUBLE END), 6) AS mean, count(*) FILTER (lower(value) IN ('', 'vacant', 'available', 'empty', 'tbd', 'n/a')) AS n_vacant, count(*) AS n_cells FROM x GROUP BY 1, 2""")
def table_rollups(spark, sf):
    return texttables.rollups(all_cells(spark, sf), id="doc_id")


@query("tables_to_clauses", f"""WITH {BLOCK_SQL}, src AS (SELECT doc_id, source FROM documents), cl AS (SELECT source AS doc, 'doc_' || doc_id AS key, 0.9::DOUBLE AS confidence FROM src), m AS (SELECT doc FROM cl GROUP BY 1 HAVING count(*) > 5),
x AS (SELECT source AS doc, 'table_pipe_' || (1000 * doc_id + block_no) AS key, (count(*) % 10 / 10.0)::DOUBLE AS confidence FROM b JOIN src USING (doc_id) GROUP BY source, doc_id, block_no)
SELECT doc, key, confidence, confidence < 0.5 AS needs_review FROM cl UNION ALL SELECT doc, key, confidence, confidence < 0.5 FROM x WHERE doc IN (SELECT doc FROM m)""")
def tables_to_clauses(spark, sf):
    docs = t(spark, sf, "documents").select("doc_id", F.col("source").alias("doc"))
    found = blocks(spark, sf).groupBy("doc_id", "block_no").agg((F.count("*") % 10 / 10).alias("score")).join(docs, "doc_id")
    found = found.select("doc", F.lit("pipe").alias("kind"), (1000 * F.col("doc_id") + F.col("block_no")).alias("block_no"), "score")
    clauses = docs.select("doc", F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("key"), F.lit(0.9).alias("confidence"))
    return texttables.tables_as_clauses(found, clauses, doc="doc", key="key", confidence="confidence")
