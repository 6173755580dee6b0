"""Clauses, change logs and checks. ``documents`` with ``labels`` stand for clauses; a customer's orders are the change log of that customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedge.operators import changelog, checks, clauses
from sedge.plans.base import over, query, t

CLAUSE_SQL = "c AS (SELECT d.doc_id, source, lang, text, 0.1 * (d.doc_id % 10) AS confidence, contains(text, '!!') AS needs_review, coalesce(quality, 0) + coalesce(toxic, 0) AS n_fields FROM documents d LEFT JOIN labels USING (doc_id))"


def clause_rows(spark, sf):
    d = t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id", "left")
    return d.select("doc_id", "source", "lang", "text", (0.1 * (F.col("doc_id") % 10)).alias("confidence"), F.contains("text", F.lit("!!")).alias("needs_review"), (F.coalesce("quality", F.lit(0)) + F.coalesce("toxic", F.lit(0))).alias("n_fields"))


@query("clause_dedup_best", f"""WITH {CLAUSE_SQL},
s AS (SELECT *, round(100 * confidence - CASE WHEN contains(lower(text), 'no information found') THEN 50 ELSE 0 END + 5 * n_fields + least(length(text) / 100, 10.0) - CASE WHEN needs_review THEN 20 ELSE 0 END, 6)::DOUBLE AS score FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY score DESC, doc_id) AS r FROM s)
SELECT source, lang, doc_id, score FROM r WHERE r = 1""")
def clause_dedup_best(spark, sf):
    score = clauses.clause_score(confidence=F.col("confidence"), content=F.col("text"), n_fields=F.col("n_fields"), needs_review=F.col("needs_review"))
    return clauses.best_per_type(clause_rows(spark, sf), doc="source", kind="lang", score=score, ordinal="doc_id").select("source", "lang", "doc_id", "score")


@query("parent_child_reconcile", """
WITH p AS (SELECT conv_id, turn // 2 AS k, length(text) % 10 / 10.0 AS c, md5(text) AS v FROM conversations WHERE role = 'user'),
q AS (SELECT conv_id, turn // 2 AS k, length(text) % 7 / 7.0 AS c, md5(text) AS v FROM conversations WHERE role = 'assistant')
SELECT conv_id, k, CASE WHEN p.c IS NULL THEN 'inferred' WHEN q.c IS NULL THEN 'parent' WHEN q.c > p.c THEN 'child' ELSE 'parent' END AS origin,
       round(CASE WHEN p.c IS NULL OR q.c > p.c THEN q.c ELSE p.c END, 6)::DOUBLE AS confidence, CASE WHEN p.c IS NULL OR q.c > p.c THEN q.v ELSE p.v END AS value
FROM p FULL OUTER JOIN q USING (conv_id, k)""")
def parent_child_reconcile(spark, sf):
    rows = t(spark, sf, "conversations").withColumn("k", F.floor(F.col("turn") / 2))

    def side(role, m):
        return rows.filter(F.col("role") == role).select("conv_id", "k", (F.length("text") % m / m).alias("confidence"), F.create_map(F.lit("v"), F.md5("text")).alias("fields"))

    out = clauses.reconcile(side("user", 10), side("assistant", 7), keys=["conv_id", "k"])
    return out.select("conv_id", "k", "origin", F.round("confidence", 6).alias("confidence"), F.col("fields")["v"].alias("value"))


_SIDES = """
p AS (SELECT conv_id, turn // 2 AS k, length(text) % 10 / 10.0 AS c, length(text) AS n FROM conversations WHERE role = 'user'), q AS (SELECT conv_id, turn // 2 AS k, length(text) % 7 / 7.0 AS c, length(text) AS n FROM conversations WHERE role = 'assistant'),
b AS (SELECT conv_id, k, p.c AS pc, q.c AS qc, p.n AS pn, q.n AS qn, p.c IS NULL OR q.c > p.c AS wins FROM p FULL OUTER JOIN q USING (conv_id, k))"""


@query("reconcile_tags", f"""WITH {_SIDES}, x AS (SELECT conv_id, k, wins, CASE WHEN pn IS NULL THEN [] ELSE ['len' || pn % 3 || ':high', 'user:low'] END AS pt, CASE WHEN qn IS NULL OR NOT coalesce(wins, false) THEN [] ELSE ['len' || qn % 3 || ':low', 'reply:low'] END AS qt FROM b)
SELECT conv_id, k, array_to_string(list_concat(pt, list_filter(qt, lambda t: NOT list_contains(list_transform(pt, lambda y: split_part(y, ':', 1)), split_part(t, ':', 1)))), ',') AS tags FROM x""")
def reconcile_tags(spark, sf):
    """A winning child's tags are united with the parent's, each type once."""
    rows = t(spark, sf, "conversations").withColumn("k", F.floor(F.col("turn") / 2))

    def side(role, m, level, other):
        tag = lambda kind, level: F.struct(kind.alias("type"), F.lit(level).alias("level"))
        tags = F.array(tag(F.concat(F.lit("len"), (F.length("text") % 3).cast("string")), level), tag(F.lit(other), "low"))
        return rows.filter(F.col("role") == role).select("conv_id", "k", (F.length("text") % m / m).alias("confidence"), F.create_map(F.lit("v"), F.md5("text")).alias("fields"), tags.alias("tags"))

    out = clauses.reconcile_tags(side("user", 10, "high", "user"), side("assistant", 7, "low", "reply"), keys=["conv_id", "k"])
    return out.select("conv_id", "k", F.array_join(F.transform("tags", lambda x: F.concat_ws(":", x["type"], x["level"])), ",").alias("tags"))


@query("deep_merge", """
SELECT o_custkey, path, CASE WHEN path = 'status' THEN arg_min(value, o_orderkey) ELSE string_agg(value, '|' ORDER BY o_orderkey) END AS merged
FROM (SELECT o_custkey, o_orderkey, 'status' AS path, o_orderstatus AS value FROM orders UNION ALL SELECT o_custkey, o_orderkey, 'priority', o_orderpriority FROM orders) GROUP BY 1, 2""")
def deep_merge(spark, sf):
    leaves = t(spark, sf, "orders").select("o_custkey", "o_orderkey", F.stack(F.lit(2), F.lit("status"), F.col("o_orderstatus"), F.lit(False), F.lit("priority"), F.col("o_orderpriority"), F.lit(True)).alias("path", "value", "is_list"))
    return clauses.merge_leaves(leaves, doc="o_custkey", path="path", order="o_orderkey", value="value", is_list="is_list")


@query("mean_confidence", "SELECT user_id, round(avg(json_extract(props, '$.k')::DOUBLE), 6) AS mean_confidence FROM events GROUP BY 1")
def mean_confidence(spark, sf):
    leaves = checks.flatten_json(t(spark, sf, "events"), id="event_id", json="props").filter("path = 'k'").select("event_id", F.col("value").cast("double").alias("c"))
    users = t(spark, sf, "events").select("event_id", "user_id")
    return users.join(leaves, "event_id", "left").groupBy("user_id").agg(F.round(F.coalesce(F.avg("c"), F.lit(0.0)), 6).alias("mean_confidence"))


@query("content_hash_once", "SELECT doc_id, length(text) - length(replace(text, 'e', '')) AS n_e FROM documents")
def content_hash_once(spark, sf):
    docs = t(spark, sf, "documents").select("doc_id", "text")
    return clauses.distinct_work(docs, F.col("text"), lambda d: d.withColumn("n_e", F.length("text") - F.length(F.replace("text", F.lit("e"), F.lit("")))), result="n_e").select("doc_id", "n_e")


@query("risk_tag_dedup", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def risk_tag_dedup(spark, sf):
    return clauses.first_per(t(spark, sf, "events"), keys=["user_id", "event_type"], order=["event_id"]).select("user_id", "event_type", "event_id")


@query("clause_to_chunk", "SELECT o_orderkey, (o_orderkey % 50)::INT AS page_start, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 50 ELSE o_orderkey % 50 + o_orderkey % 4 END::INT AS page_end FROM orders")
def clause_to_chunk(spark, sf):
    k = F.col("o_orderkey")
    text = F.when(k % 3 == 0, (k % 50).cast("string")).when(k % 3 == 1, F.concat((k % 50).cast("string"), F.lit("-"), (k % 50 + k % 4).cast("string"))).otherwise(F.concat((k % 50).cast("string"), F.lit(" – "), (k % 50 + k % 4).cast("string")))
    return clauses.page_range(t(spark, sf, "orders").select("o_orderkey", text.alias("pages")), text="pages").select("o_orderkey", "page_start", "page_end")


@query("provenance_attach", "SELECT c_custkey, n_name AS own_label, r_name AS parent_label FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def provenance_attach(spark, sf):
    nation = t(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("node"), (F.col("n_regionkey") + 1000).cast("long").alias("parent"), F.col("n_name").alias("label"))
    region = t(spark, sf, "region").select((F.col("r_regionkey") + 1000).cast("long").alias("node"), F.lit(None).cast("long").alias("parent"), F.col("r_name").alias("label"))
    rows = t(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("node"))
    return clauses.attach_parents(rows, nation.unionByName(region), node="node", parent="parent", label="label").select("c_custkey", "own_label", "parent_label")


@query("empty_result_rows", """
WITH n AS (SELECT d.doc_id, left(any_value(text), 500) AS content, count(l.doc_id) FILTER (quality = 1) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.doc_id)
SELECT doc_id, CASE WHEN n = 0 THEN 'failed' ELSE 'overview' END AS clause_key, CASE WHEN n = 0 THEN 0.1 ELSE 0.5 END::DOUBLE AS confidence, CASE WHEN n = 0 THEN 'high' END AS risk_level, content FROM n WHERE n < 3""")
def empty_result_rows(spark, sf):
    return clauses.fill_empty(t(spark, sf, "documents"), t(spark, sf, "labels").filter("quality = 1"), doc="doc_id", text="text")


@query("enrich_with_facts", """
WITH f AS (SELECT o_custkey, CASE WHEN o_orderstatus = 'F' THEN 'money' ELSE 'time' END AS family, max((o_totalprice / 1000000, o_orderpriority)) AS f FROM orders GROUP BY 1, 2),
c AS (SELECT c_custkey AS o_custkey, c_mktsegment, CASE WHEN regexp_matches(lower(c_mktsegment), 'auto|mach') THEN 'money' WHEN regexp_matches(lower(c_mktsegment), 'house') THEN 'time' END AS family FROM customer)
SELECT c.o_custkey, c.family, f.f[2] AS value, round(greatest(0.2, f.f[1]), 6)::DOUBLE AS confidence FROM c LEFT JOIN f ON c.o_custkey = f.o_custkey AND c.family = f.family""")
def enrich_with_facts(spark, sf):
    facts = t(spark, sf, "orders").select("o_custkey", F.when(F.col("o_orderstatus") == "F", "money").otherwise("time").alias("family"), (F.col("o_totalprice") / 1000000).alias("fact_confidence"), F.col("o_orderpriority").alias("value"))
    rows = t(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", F.lit(0.2).alias("confidence"))
    out = clauses.enrich(rows, facts, doc="o_custkey", name="c_mktsegment", words={"money": ["auto", "mach"], "time": ["house"]})
    return out.select("o_custkey", "family", "value", F.round("confidence", 6).alias("confidence"))


@query("structure_context", "SELECT conv_id, arg_max(length(text), turn) AS last_length, string_agg(DISTINCT role, ',' ORDER BY role) AS roles, count(*) AS n_segments FROM conversations GROUP BY 1")
def structure_context(spark, sf):
    return t(spark, sf, "conversations").groupBy("conv_id").agg(F.max_by(F.length("text").cast("long"), "turn").alias("last_length"), F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"), F.count("*").alias("n_segments"))


#: A customer's orders as segments of one document: two terms, a role on every third, references, exhibits, tables.
SEGMENTS = """segs AS (SELECT o_custkey AS doc, o_orderkey AS n, o_orderpriority AS section, o_orderstatus, CAST(CAST(o_orderdate AS DATE) AS STRING) AS day FROM orders)"""


@query("structure_outline", f"""WITH {SEGMENTS}, tm AS (SELECT doc, name, arg_max(v, n) AS v FROM (SELECT doc, n, 'date' AS name, day AS v FROM segs UNION ALL SELECT doc, n, 'term ' || o_orderstatus, n::VARCHAR FROM segs) GROUP BY 1, 2),
ro AS (SELECT doc, section AS name, arg_max(n, n)::VARCHAR AS v FROM segs WHERE n % 3 = 0 GROUP BY 1, 2)
SELECT doc, string_agg(section, '|' ORDER BY n) AS outline, (SELECT string_agg(name || '=' || v, '|' ORDER BY name || '=' || v) FROM tm WHERE tm.doc = s.doc) AS terms, coalesce((SELECT string_agg(name || '=' || v, '|' ORDER BY name || '=' || v) FROM ro WHERE ro.doc = s.doc), '') AS roles,
  coalesce(string_agg('s' || n % 5 || '|s' || n % 7, '|' ORDER BY n) FILTER (n % 2 = 0), '') AS refs, sum(n % 4)::BIGINT AS n_tables, string_agg(DISTINCT 'E' || n % 3, '|' ORDER BY 'E' || n % 3) AS exhibits FROM segs s GROUP BY doc""")
def structure_outline(spark, sf):
    """Outline, terms, roles, references, tables and exhibits of a document from its segments."""
    n = F.col("n")
    text = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    rows = over(spark, f"WITH {SEGMENTS} SELECT * FROM segs", orders=t(spark, sf, "orders"))
    rows = rows.select("doc", "n", "section", F.create_map(F.lit("date"), F.col("day"), text("term ", F.col("o_orderstatus")), n.cast("string")).alias("terms"), F.when(n % 3 == 0, F.create_map(F.col("section"), n.cast("string"))).alias("roles"), F.when(n % 2 == 0, F.array(text("s", n % 5), text("s", n % 7))).alias("refs"), F.array(text("E", n % 3)).alias("exhibits"), (n % 4).alias("tables"))
    out = clauses.structure_context(rows, doc="doc", order="n", section="section", terms="terms", roles="roles", refs="refs", exhibits="exhibits", tables="tables")
    return out.withColumns({c: F.array_join(c, "|") for c in ("outline", "terms", "roles", "refs", "exhibits")}).select("doc", "outline", "terms", "roles", "refs", "n_tables", "exhibits")


def order_log(spark, sf):
    return t(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority", F.to_date("o_orderdate").alias("d"))


@query("amendment_chain", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderdate::DATE END NULLS FIRST, o_orderkey)::INT AS seq FROM orders")
def amendment_chain(spark, sf):
    log = order_log(spark, sf).withColumn("d", F.when(F.col("o_orderkey") % 7 != 0, F.col("d")))
    return changelog.chain(log, base="o_custkey", date="d", ordinal="o_orderkey").select("o_custkey", "o_orderkey", "seq")


@query("current_state", "SELECT o_custkey, o_orderpriority, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS value, count(*) AS n_writes FROM orders GROUP BY 1, 2")
def current_state(spark, sf):
    return changelog.current_state(t(spark, sf, "orders"), base="o_custkey", key="o_orderpriority", value="o_orderstatus", order=F.struct("o_orderdate", "o_orderkey"))


@query("state_as_of", "SELECT o_custkey, o_orderpriority, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS value, count(*) AS n_writes FROM orders WHERE o_orderdate <= TIMESTAMP '1997-06-30' GROUP BY 1, 2")
def state_as_of(spark, sf):
    return changelog.current_state(t(spark, sf, "orders"), base="o_custkey", key="o_orderpriority", value="o_orderstatus", order=F.struct("o_orderdate", "o_orderkey"), until=F.col("o_orderdate") <= F.lit("1997-06-30").cast("timestamp"))


@query("change_history", """
SELECT o_custkey, o_orderkey, row_number() OVER w::INT AS change_no, lag(o_orderstatus) OVER w AS old_value, o_orderstatus AS new_value, lag(o_orderstatus) OVER w IS DISTINCT FROM o_orderstatus AS changed
FROM orders WINDOW w AS (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey)""".replace("row_number() OVER w::INT", "(row_number() OVER w)::INT"))
def change_history(spark, sf):
    out = changelog.history(t(spark, sf, "orders"), base="o_custkey", key="o_orderpriority", value="o_orderstatus", order=["o_orderdate", "o_orderkey"])
    return out.select("o_custkey", "o_orderkey", "change_no", "old_value", F.col("o_orderstatus").alias("new_value"), "changed")


@query("change_conflicts", "SELECT * FROM (SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS previous FROM orders) WHERE previous IS NOT NULL")
def change_conflicts(spark, sf):
    return changelog.conflicts(t(spark, sf, "orders"), base="o_custkey", section="o_orderpriority", order=["o_orderdate", "o_orderkey"], id="o_orderkey").select("o_custkey", "o_orderkey", "previous")


@query("orphan_changes", "SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_mktsegment IN ('MACHINERY', 'FURNITURE'))")
def orphan_changes(spark, sf):
    base = t(spark, sf, "customer").filter(F.col("c_mktsegment").isin("MACHINERY", "FURNITURE")).select(F.col("c_custkey").alias("o_custkey"))
    return changelog.orphans(t(spark, sf, "orders"), base, on=["o_custkey"]).select("o_orderkey", "o_custkey")


#: Keys that exist at first, and changes to a customer's priorities: what an order says depends on its status and price.
CHANGES = """
base AS (SELECT c_custkey AS base_id, p AS k, c_mktsegment AS v FROM customer, (SELECT '1-URGENT' AS p UNION ALL SELECT '2-HIGH' AS p) x WHERE c_acctbal > 0),
log AS (SELECT o_custkey AS base_id, o_orderpriority AS k, o_orderkey AS id, CAST(o_orderdate AS DATE) AS d, CAST(o_orderkey AS STRING) AS v, CASE o_orderstatus WHEN 'P' THEN 'add' WHEN 'F' THEN 'modify' ELSE CASE WHEN o_totalprice > 200000 THEN 'remove' WHEN o_totalprice > 150000 THEN 'add' ELSE 'modify' END END AS kind FROM orders)"""
CHANGES_SQL = f"""{CHANGES}, s AS (SELECT *, row_number() OVER (PARTITION BY base_id, k ORDER BY d, id) AS n FROM log),
f AS (SELECT base_id, k, 0::BIGINT AS id, 0::BIGINT AS n, NULL::VARCHAR AS kind, true AS applied, v AS state, v IS NOT NULL AS live, NULL::VARCHAR AS old_value, 0 AS done FROM (SELECT DISTINCT s.base_id, s.k, b.v FROM s LEFT JOIN base b USING (base_id, k))
  UNION ALL SELECT s.base_id, s.k, s.id, s.n, s.kind, s.kind = 'add' OR f.live, CASE WHEN s.kind = 'remove' THEN NULL WHEN s.kind = 'add' OR f.live THEN s.v END, s.kind <> 'remove' AND (s.kind = 'add' OR f.live), f.state, f.done + (s.kind = 'add' OR f.live)::INT FROM f JOIN s ON s.base_id = f.base_id AND s.k = f.k AND s.n = f.n + 1)"""


def change_log(spark, sf):
    tables = dict(orders=t(spark, sf, "orders"), customer=t(spark, sf, "customer"))
    return [over(spark, f"WITH {CHANGES} SELECT * FROM {name}", **tables) for name in ("base", "log")]


@query("applied_changes", f"WITH RECURSIVE {CHANGES_SQL} SELECT id, kind, applied, old_value, CASE WHEN applied THEN done END AS change_no FROM f WHERE n > 0")
def applied_changes(spark, sf):
    """Which changes hold: one to a key that does not exist at its time does not, and later ones see that."""
    return changelog.applied_changes(*change_log(spark, sf), keys=["base_id", "k"], kind="kind", value="v", order=["d", "id"]).select("id", "kind", "applied", "old_value", "change_no")


@query("state_after_changes", f"""WITH RECURSIVE {CHANGES_SQL}, l AS (SELECT base_id, k, arg_max(live, n) AS live, arg_max(coalesce(state, ''), n) AS v, max(done) AS n_changes FROM f GROUP BY 1, 2)
SELECT base_id, k, v, n_changes::BIGINT AS n_changes FROM l WHERE live UNION ALL SELECT base_id, k, v, 0 FROM base WHERE (base_id, k) NOT IN (SELECT (base_id, k) FROM l)""")
def state_after_changes(spark, sf):
    return changelog.state_after(*change_log(spark, sf), keys=["base_id", "k"], kind="kind", value="v", order=["d", "id"])


@query("chain_order_check", "SELECT * FROM (SELECT o_custkey, o_orderkey, o_orderdate::DATE AS d, lag(o_orderdate::DATE) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS previous_date FROM orders) WHERE d < previous_date")
def chain_order_check(spark, sf):
    return changelog.date_order_issues(order_log(spark, sf), base="o_custkey", arrival="o_orderkey", date="d").select("o_custkey", "o_orderkey", "d", "previous_date")


@query("date_logic", """
WITH l AS (SELECT l_orderkey, min(l_shipdate) AS s, max(l_shipdate) AS e FROM lineitem GROUP BY 1), j AS (SELECT o_orderkey, s, e, o_orderdate AS d FROM orders JOIN l ON l_orderkey = o_orderkey)
SELECT o_orderkey, 'start_after_end' AS issue_type, 'high' AS severity FROM j WHERE s >= e UNION ALL SELECT o_orderkey, 'deadline_after_end', 'high' FROM j WHERE d > e UNION ALL SELECT o_orderkey, 'before_start', 'medium' FROM j WHERE d < s""")
def date_logic(spark, sf):
    return date_issues(spark, sf).select("o_orderkey", "issue_type", "severity")


def date_issues(spark, sf):
    spans = t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("s"), F.max("l_shipdate").alias("e"))
    return checks.check_dates(t(spark, sf, "orders").join(spans, "o_orderkey"), start="s", end="e", deadline="o_orderdate")


@query("tolerance_check", """
WITH l AS (SELECT l_orderkey AS o_orderkey, sum((l_extendedprice * (1 - l_discount) * (1 + l_tax))::DECIMAL(18,4))::DOUBLE AS c FROM lineitem GROUP BY 1)
SELECT o_orderkey, round(abs(c - o_totalprice) / o_totalprice, 6) AS deviation, abs(c - o_totalprice) / o_totalprice > 0.5 AS broken FROM orders JOIN l USING (o_orderkey)""")
def tolerance_check(spark, sf):
    price = (F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).cast("decimal(18,4)")
    sums = t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(price).cast("double").alias("c"))
    return checks.check_tolerance(t(spark, sf, "orders").join(sums, "o_orderkey"), stated=F.col("o_totalprice"), computed=F.col("c"), tolerance=0.5).select("o_orderkey", "deviation", "broken")


LINES = "(SELECT l_orderkey, l_linenumber, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2)"


@query("share_check", """WITH s AS (SELECT l_orderkey, l_linenumber, o_totalprice::DOUBLE AS total, (10 * l_linenumber)::DOUBLE AS pct, l_extendedprice::DOUBLE AS estimate FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT l_orderkey, l_linenumber, round(total * pct / 100, 6) AS expected, round(abs(estimate - total * pct / 100) / (total * pct / 100), 6) AS deviation, 'medium' AS severity FROM s WHERE total * pct <> 0 AND estimate <> 0 AND abs(estimate - total * pct / 100) / abs(total * pct / 100) > 0.5""")
def share_check(spark, sf):
    rows = t(spark, sf, "lineitem").join(t(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", F.col("o_totalprice").cast("double").alias("total"), (10.0 * F.col("l_linenumber")).alias("pct"), F.col("l_extendedprice").cast("double").alias("estimate"))
    out = checks.check_share(rows, total=F.col("total"), percent=F.col("pct"), estimate=F.col("estimate"), tolerance=0.5)
    return out.select("l_orderkey", "l_linenumber", "expected", "deviation", "severity")


@query("monotone_check", f"SELECT * FROM (SELECT l_orderkey, l_linenumber, q, lag(q) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS previous FROM {LINES}) WHERE q <= previous")
def monotone_check(spark, sf):
    rows = t(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"))
    return checks.check_ascending(rows, key="l_orderkey", order=["l_linenumber"], value="q")


@query("xref_check", "SELECT DISTINCT l_orderkey, l_partkey % 1900 + 200 AS p_partkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey % 1900 + 200)")
def xref_check(spark, sf):
    refs = t(spark, sf, "lineitem").select("l_orderkey", (F.col("l_partkey") % 1900 + 200).alias("p_partkey")).distinct()
    return checks.broken_refs(refs, t(spark, sf, "part"), on=["p_partkey"]).select("l_orderkey", "p_partkey")


@query("undefined_terms", r"""
WITH f AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '(?:^|[^A-Za-z])([A-Z][a-z]+(?: [A-Z][a-z]+)+)', 1))) AS term FROM documents),
d AS (SELECT DISTINCT unnest(regexp_extract_all(text, '(?:^|[^A-Za-z])([A-Z][a-z]+(?: [A-Z][a-z]+)+)', 1)) AS term FROM benchmark)
SELECT term, min(doc_id) AS first_id, count(*) AS n_texts FROM f WHERE term NOT IN ('The The') AND NOT EXISTS (SELECT 1 FROM d WHERE d.term = f.term) GROUP BY term""")
def undefined_terms(spark, sf):
    pattern = r"(?:^|[^A-Za-z])([A-Z][a-z]+(?: [A-Z][a-z]+)+)"
    defined = t(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("term"))
    return checks.undefined_terms(t(spark, sf, "documents"), defined, id="doc_id", text="text", stop=["The The"])


@query("high_stakes", "SELECT event_id, CASE WHEN value < 10 THEN 'high' ELSE 'medium' END AS severity FROM events WHERE event_type IN ('error', 'purchase')")
def high_stakes(spark, sf):
    kinds = spark.createDataFrame([("error",), ("purchase",)], "kind string")
    return checks.high_stakes(t(spark, sf, "events").withColumn("mutual", F.col("value") >= 10), kinds, kind="event_type", mutual="mutual").select("event_id", "severity")


@query("validation_report", """
WITH l AS (SELECT l_orderkey, min(l_shipdate) AS s, max(l_shipdate) AS e, count(*) AS n FROM lineitem GROUP BY 1), j AS (SELECT o_custkey, o_orderkey, s, e, o_orderdate AS d FROM orders JOIN l ON l_orderkey = o_orderkey),
i AS (SELECT o_custkey, 'high' AS s FROM j WHERE s >= e UNION ALL SELECT o_custkey, 'high' FROM j WHERE d > e UNION ALL SELECT o_custkey, 'medium' FROM j WHERE d < s),
n AS (SELECT o_custkey, count(*) AS n_issues, count(*) FILTER (s = 'high') AS n_high FROM i GROUP BY 1), c AS (SELECT o_custkey, 3 * count(*) AS n_checked FROM orders GROUP BY 1)
SELECT o_custkey, coalesce(n_checked, 0) AS n_checked, coalesce(n_issues, 0) AS n_issues, coalesce(n_high, 0) AS n_high, round(CASE WHEN n_checked IS NULL THEN 100 ELSE greatest(0, 100 - 100 * coalesce(n_issues, 0) / n_checked) END, 6)::DOUBLE AS score, 100 - 5 * coalesce(n_issues, 0) AS strict_score
FROM c FULL OUTER JOIN n USING (o_custkey)""")
def validation_report(spark, sf):
    checked = t(spark, sf, "orders").groupBy("o_custkey").agg((3 * F.count("*")).alias("n_checked"))
    return checks.validation_report(date_issues(spark, sf), checked, id="o_custkey")


#: Nested JSON of an event: three levels and more, arrays of objects, empty containers, nulls, date keys.
NESTED = """nested AS (SELECT event_id, '{"kind": "' || event_type || '", "props": ' || coalesce(props, 'null') || ', "term": {"start_date": "' || CAST(CAST(ts AS DATE) AS STRING) || '", "notice": {"deadline_days": ' || CAST(event_id % 9 AS STRING)
  || ', "to": ' || CASE event_id % 4 WHEN 0 THEN '[]' WHEN 1 THEN '{}' WHEN 2 THEN 'null' ELSE '["a", {"name": "b", "expiry": [1, [2, ' || CAST(event_id AS STRING) || ']]}]' END || '}}' || CASE WHEN event_id % 10 = 0 THEN '' ELSE '}' END AS doc FROM events)"""
_LEAVES = {
    "kind": "json_extract(doc, '$.kind')::VARCHAR", "props.k": "json_extract(doc, '$.props.k')::VARCHAR", "term.start_date": "json_extract(doc, '$.term.start_date')::VARCHAR",
    "term.notice.deadline_days": "json_extract(doc, '$.term.notice.deadline_days')::VARCHAR", "term.notice.to": "CASE event_id % 4 WHEN 0 THEN '[]' WHEN 1 THEN '{}' WHEN 2 THEN 'null' END",
    "term.notice.to[0]": "json_extract(doc, '$.term.notice.to[0]')::VARCHAR", "term.notice.to[1].name": "json_extract(doc, '$.term.notice.to[1].name')::VARCHAR", "term.notice.to[1].expiry[0]": "json_extract(doc, '$.term.notice.to[1].expiry[0]')::VARCHAR",
    "term.notice.to[1].expiry[1][0]": "json_extract(doc, '$.term.notice.to[1].expiry[1][0]')::VARCHAR", "term.notice.to[1].expiry[1][1]": "json_extract(doc, '$.term.notice.to[1].expiry[1][1]')::VARCHAR",
}


@query("flatten_nested", f"WITH {NESTED}, n2 AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN '{{}}' ELSE doc END AS doc FROM nested), x AS (" + " UNION ALL ".join(f"SELECT event_id, '{path}' AS path, {value} AS value, regexp_matches('{path.rpartition('.')[2]}', 'date|deadline|expir|commenc') AS is_date_key FROM n2 WHERE event_id % 10 <> 0" for path, value in _LEAVES.items()) + ") SELECT * FROM x WHERE value IS NOT NULL")
def flatten_nested(spark, sf):
    """Every tenth text lacks its last brace and is no JSON."""
    return checks.flatten_json(over(spark, f"WITH {NESTED} SELECT * FROM nested", events=t(spark, sf, "events")), id="event_id", json="doc")


@query("xref_attach", """
WITH own AS (SELECT DISTINCT conv_id, turn FROM conversations WHERE role <> 'system'), r AS (SELECT conv_id, turn AS src, unnest([turn + 1, turn + 2]) AS dst FROM conversations)
SELECT conv_id, src, string_agg(DISTINCT dst::VARCHAR, ',' ORDER BY dst::VARCHAR) AS targets FROM r WHERE (conv_id, src) IN (SELECT (conv_id, turn) FROM own) AND (conv_id, dst) IN (SELECT (conv_id, turn) FROM own) GROUP BY 1, 2""")
def xref_attach(spark, sf):
    rows = t(spark, sf, "conversations")
    refs = rows.select("conv_id", F.col("turn").alias("src"), F.explode(F.array(F.col("turn") + 1, F.col("turn") + 2)).alias("dst"))
    out = checks.attach_refs(refs, rows.filter("role <> 'system'"), doc="conv_id", src="src", dst="dst", section="turn")
    return out.select("conv_id", "src", F.array_join(F.transform("targets", lambda x: x.cast("string")), ",").alias("targets"))
