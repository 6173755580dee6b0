"""Graph and similarity queries. A part points to the part of the order's next line; ``embeddings`` stand for clause vectors, ``vec_id % 20`` for their documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sedge.functions import catalogues
from sedge.functions.joins import dealt
from sedge.operators import graph, similarity
from sedge.plans.base import over, query, t

LINE_SQL = "l AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p, min(l_suppkey) AS s FROM lineitem GROUP BY 1, 2)"
EDGE_SQL = f"{LINE_SQL}, e AS (SELECT DISTINCT p AS src, q AS dst FROM (SELECT p, lead(p) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS q FROM l) WHERE q IS NOT NULL)"
#: An acyclic graph: an order's supplier and the nearest larger one after it.
DAG_SQL = f"{LINE_SQL}, g AS (SELECT DISTINCT least(s, q) AS src, greatest(s, q) AS dst FROM (SELECT s, lead(s) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS q FROM l) WHERE q IS NOT NULL AND abs(s - q) = 1)"

FAR_SQL = DAG_SQL.replace("abs(s - q) = 1", "abs(s - q) >= 30")


def lines(spark, sf):
    rows = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return dealt(rows, "l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))


def part_edges(spark, sf):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    return lines(spark, sf).select(F.col("p").alias("src"), F.lead("p").over(w).alias("dst")).filter("dst IS NOT NULL").distinct()


def supplier_dag(spark, sf, apart="= 1"):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    e = lines(spark, sf).select("s", F.lead("s").over(w).alias("q")).filter(f"q IS NOT NULL AND abs(s - q) {apart}")
    return e.select(F.least("s", "q").alias("src"), F.greatest("s", "q").alias("dst")).distinct()


def pagerank_sql(rounds: int = 10) -> str:
    steps = "r0 AS (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM n) AS rank FROM n)"
    for i in range(1, rounds + 1):
        steps += f""",
g{i} AS (SELECT e.dst AS node, sum(r.rank / n.o) AS got FROM e JOIN r{i - 1} r ON r.node = e.src JOIN n ON n.node = e.src GROUP BY 1),
r{i} AS (SELECT n.node, 0.15::DOUBLE / (SELECT count(*) FROM n) + 0.85 * (coalesce(got, 0) + (SELECT coalesce(sum(r.rank), 0) FROM r{i - 1} r JOIN n USING (node) WHERE n.o = 0) / (SELECT count(*) FROM n)) AS rank FROM n LEFT JOIN g{i} USING (node))"""
    return f"""WITH {EDGE_SQL},
n AS (SELECT node, sum(o)::BIGINT AS o, sum(i)::BIGINT AS in_degree FROM (SELECT src AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY 1),
{steps}
SELECT node, round(rank, 9) AS rank, in_degree FROM r{rounds} JOIN n USING (node) ORDER BY round(rank, 9) DESC, node LIMIT 10"""


@query("hub_nodes", pagerank_sql())
def hub_nodes(spark, sf):
    return graph.hubs(part_edges(spark, sf), top_n=10)


@query("xref_edges", r"""
WITH m AS (SELECT source, doc_id, unnest(list_distinct(regexp_extract_all(text, '[^0-9]([0-9]{1,3})[^0-9]', 1))) AS r, 'mentions' AS rel_type FROM documents
           UNION ALL SELECT source, doc_id, unnest(list_distinct(regexp_extract_all(text, '([0-9]{1,3})@', 1))), 'mails' FROM documents),
x AS (SELECT source, (doc_id // 20)::VARCHAR AS r, min(doc_id) AS dst FROM documents GROUP BY 1, 2)
SELECT source, doc_id, dst, rel_type FROM m JOIN x USING (source, r) WHERE doc_id <> dst""")
def xref_edges(spark, sf):
    docs = t(spark, sf, "documents").withColumn("number", F.floor(F.col("doc_id") / 20))
    return graph.reference_edges(docs, doc="source", src="doc_id", text="text", number="number", rules=[("[^0-9]([0-9]{1,3})[^0-9]", "mentions"), ("([0-9]{1,3})@", "mails")])


#: A customer's orders as a set of documents: leases and, every fourth, an exhibit; each amends the next older one, urgent ones also the next dearer one; references by title and by exhibit.
DOCSET = """
d0 AS (SELECT o_orderkey AS id, o_custkey AS grp, CAST(o_orderdate AS DATE) AS d, o_totalprice AS price, o_orderpriority AS prio, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS seq FROM orders),
docs AS (SELECT *, seq % 4 = 0 AS exhibit, seq = 1 AND prio <> '5-LOW' AS base, CASE WHEN seq % 4 = 0 THEN 'Exhibit Z' || CAST(id % 11 AS STRING) ELSE 'Lease ' || CAST(id AS STRING) END AS title FROM d0),
e0 AS (SELECT id, prio, lead(id) OVER (PARTITION BY grp ORDER BY d DESC, id) AS older, lead(id) OVER (PARTITION BY grp ORDER BY price, id) AS dearer, lag(id) OVER (PARTITION BY grp ORDER BY id) AS prev, grp FROM docs),
edges AS (SELECT id AS src, older AS dst FROM e0 WHERE older IS NOT NULL UNION SELECT id, dearer FROM e0 WHERE dearer IS NOT NULL AND prio = '1-URGENT'),
refs AS (SELECT grp, id, 'as in LEASE ' || CAST(prev + CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END AS STRING) AS ref, false AS to_exhibit FROM e0 WHERE prev IS NOT NULL
         UNION ALL SELECT grp, id, 'exhibit  Z' || CAST(id % 9 AS STRING) || ' hereto' AS ref, true FROM e0)"""
CLOSURE = "r AS (SELECT src, dst FROM edges UNION SELECT r.src, e.dst FROM r JOIN edges e ON e.src = r.dst)"
RESOLVED = r"""u AS (SELECT DISTINCT grp, ref FROM refs), t1 AS (SELECT u.grp, ref, arg_min(id, (seq, id)) AS one FROM u JOIN docs d ON d.grp = u.grp AND contains(lower(ref), lower(title)) GROUP BY 1, 2),
t2 AS (SELECT u.grp, ref, arg_min(id, (seq, id)) AS two FROM u JOIN docs d ON d.grp = u.grp AND exhibit AND regexp_extract(lower(ref), 'exhibit\s+([a-z0-9]+)', 1) <> '' AND contains(lower(title), regexp_extract(lower(ref), 'exhibit\s+([a-z0-9]+)', 1)) GROUP BY 1, 2),
resolved AS (SELECT refs.*, coalesce(one, two) AS target, CASE WHEN one IS NOT NULL THEN 'title' WHEN two IS NOT NULL THEN 'exhibit' END AS how FROM refs LEFT JOIN t1 USING (grp, ref) LEFT JOIN t2 USING (grp, ref))"""


def docset(spark, sf, name):
    return over(spark, f"WITH {DOCSET} SELECT * FROM {name}", orders=t(spark, sf, "orders"))


#: Clauses, the lines of an order, that refer to others of it by the phrases of contracts.
XREF = """xr AS (SELECT l_orderkey AS doc, l_linenumber AS n, min(l_partkey) AS part FROM lineitem GROUP BY l_orderkey, l_linenumber),
xt AS (SELECT doc, n, 'Price ' || CAST(part AS STRING) || ' is due ' || CASE part % 6 WHEN 0 THEN 'subject to Section ' WHEN 1 THEN 'as set forth in article ' WHEN 2 THEN 'notwithstanding Clause ' WHEN 3 THEN 'contingent upon section ' WHEN 4 THEN 'incorporating paragraph ' ELSE 'subject to the terms of Section ' END || CAST(part % 8 AS STRING) || ' and Section 1.' AS body FROM xr)"""
_PHRASES = (("subject to Section ", ("cross_reference", "subject_to")), ("as set forth in article ", ("cross_reference",)), ("notwithstanding Clause ", ("modifies",)), ("contingent upon section ", ("depends_on",)), ("incorporating paragraph ", ("incorporates",)), ("subject to the terms of Section ", ("subject_to",)))


@query("xref_table", f"""WITH {XREF}, e AS ({" UNION ALL ".join(f"SELECT x.doc, x.n, y.n AS dst, '{kind}' AS rel_type, substring(body, greatest(1, strpos(body, '{phrase}') - 50), strpos(body, '{phrase}') + {len(phrase) + 1} + 50 - greatest(1, strpos(body, '{phrase}') - 50)) AS context FROM xt x JOIN xr USING (doc, n) JOIN xr y ON y.doc = x.doc AND y.n = xr.part % 8 AND y.n <> x.n WHERE contains(body, '{phrase}')" for phrase, kinds in _PHRASES for kind in kinds)})
SELECT *, 0.9::DOUBLE AS strength FROM e""")
def xref_table(spark, sf):
    """References by the phrases of contracts, with strength and context."""
    rows = over(spark, f"WITH {XREF} SELECT * FROM xt", lineitem=t(spark, sf, "lineitem"))
    return graph.reference_table(rows.withColumn("no", F.col("n")), doc="doc", src="n", text="body", number="no", rules=catalogues.REFERENCE_PHRASES)


@query("xdoc_edges", """
WITH d AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS phrase FROM part) SELECT phrase, (SELECT arg_min(p_partkey, p_partkey) FROM part WHERE contains(lower(p_name), lower(phrase))) AS target, true AS resolved FROM d""")
def xdoc_edges(spark, sf):
    part = t(spark, sf, "part")
    refs = part.select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("phrase")).distinct()
    return graph.title_edges(refs, part, phrase="phrase", id="p_partkey", title="p_name", ordinal="p_partkey")


@query("communities", f"""WITH RECURSIVE {DAG_SQL}, b AS (SELECT src AS a, dst AS b FROM g UNION SELECT dst, src FROM g), r AS (SELECT DISTINCT a AS id, a AS seen FROM b UNION SELECT r.id, b.b FROM r JOIN b ON b.a = r.seen)
SELECT id AS node, min(seen) AS component FROM r GROUP BY 1""")
def communities(spark, sf):
    return graph.components(supplier_dag(spark, sf))


@query("label_communities")
def label_communities(spark, sf):
    return graph.label_propagation(part_edges(spark, sf), rounds=5)


@query("dependencies", f"WITH {DAG_SQL}, two AS (SELECT DISTINCT a.src, b.dst FROM g a JOIN g b ON a.dst = b.src) SELECT src, dst, min(hops)::INT AS hops FROM (SELECT src, dst, 1 AS hops FROM g UNION ALL SELECT src, dst, 2 FROM two) GROUP BY 1, 2")
def dependencies(spark, sf):
    return graph.dependency_closure(supplier_dag(spark, sf), depth=2)


@query("conflicts", """
WITH l AS (SELECT l_orderkey, l_returnflag, l_linenumber, max(l_quantity) AS q, max(l_linestatus) AS s FROM lineitem GROUP BY 1, 2, 3)
SELECT a.l_orderkey, a.l_returnflag, a.l_linenumber AS a, b.l_linenumber AS b, CASE WHEN a.s <> b.s THEN 'status' ELSE 'quantity' END AS reason
FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.l_returnflag = b.l_returnflag AND a.l_linenumber < b.l_linenumber WHERE a.s <> b.s OR a.q <> b.q""")
def conflicts(spark, sf):
    rows = t(spark, sf, "lineitem").groupBy("l_orderkey", "l_returnflag", "l_linenumber").agg(F.max("l_quantity").alias("q"), F.max("l_linestatus").alias("s"))
    return graph.conflicts(rows, keys=["l_orderkey", "l_returnflag"], order="l_linenumber", differ=[("s", "status"), ("q", "quantity")])


@query("conflict_groups", """WITH g AS (SELECT l_partkey, l_returnflag, l_linestatus, count(*) AS n_rows, min(l_orderkey) AS first FROM lineitem GROUP BY 1, 2, 3), n AS (SELECT l_partkey, count(*) AS n_groups FROM g GROUP BY 1 HAVING count(*) > 1)
SELECT * FROM g JOIN n USING (l_partkey)""")
def conflict_groups(spark, sf):
    return graph.conflict_groups(t(spark, sf, "lineitem"), keys=["l_partkey"], order="l_orderkey", values=["l_returnflag", "l_linestatus"])


@query("reading_order", f"""WITH RECURSIVE {FAR_SQL}, n AS (SELECT src AS node FROM g UNION SELECT dst FROM g), r AS (SELECT node, 0 AS level FROM n WHERE node NOT IN (SELECT dst FROM g) UNION SELECT g.dst, r.level + 1 FROM r JOIN g ON g.src = r.node)
SELECT node, max(level)::INT AS level FROM r GROUP BY 1""")
def reading_order(spark, sf):
    return graph.topo_levels(supplier_dag(spark, sf, ">= 30"))


@query("graph_export", "SELECT k AS event_type, count(event_id) AS n FROM (VALUES ('error'), ('purchase'), ('refund'), ('view')) v(k) LEFT JOIN events ON event_type = k GROUP BY 1")
def graph_export(spark, sf):
    kinds = spark.createDataFrame([("error",), ("purchase",), ("refund",), ("view",)], "event_type string")
    return graph.type_counts(t(spark, sf, "events"), kinds, kind="event_type")


@query("graph_node_table", f"WITH {DOCSET}, k AS (SELECT src, dst, CASE WHEN src % 2 = 0 THEN 'even' ELSE 'odd' END AS kind FROM edges) SELECT id, title, (SELECT count(*) FROM k WHERE src = id) AS n_out, (SELECT count(*) FROM k WHERE dst = id) AS n_in, (SELECT count(DISTINCT kind) FROM k WHERE src = id OR dst = id) AS n_types FROM docs")
def graph_node_table(spark, sf):
    kinds = docset(spark, sf, "edges").withColumn("kind", F.when(F.col("src") % 2 == 0, "even").otherwise("odd"))
    return graph.graph_tables(docset(spark, sf, "docs").select("id", "title"), kinds, node="id", src="src", dst="dst", kind="kind")[0]


@query("graph_edge_table", f"WITH {EDGE_SQL}, k AS (SELECT src, dst, 'follows' AS kind FROM e) SELECT src, dst, kind, count(*) AS n FROM k WHERE src IN (SELECT p_partkey FROM part) AND dst IN (SELECT p_partkey FROM part) GROUP BY 1, 2, 3")
def graph_edge_table(spark, sf):
    return graph.graph_tables(t(spark, sf, "part").select("p_partkey"), part_edges(spark, sf).withColumn("kind", F.lit("follows")), node="p_partkey", src="src", dst="dst", kind="kind")[1]


@query("doc_edge_build", "SELECT o_orderkey, o_custkey, EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey + 200) AS valid FROM orders")
def doc_edge_build(spark, sf):
    edges = t(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") + 200).alias("dst"), "o_custkey")
    nodes = t(spark, sf, "customer").select(F.col("c_custkey").alias("node"))
    ok, bad = graph.valid_edges(edges.withColumn("src", F.col("o_custkey")), nodes, src="src", dst="dst", node="node")
    return ok.select("o_orderkey", "o_custkey", F.lit(True).alias("valid")).unionByName(bad.select("o_orderkey", "o_custkey", F.lit(False).alias("valid")))


@query("doc_refs_resolve", "WITH d AS (SELECT DISTINCT p_type AS phrase FROM part) SELECT phrase, (SELECT min(p_partkey) FROM part WHERE contains(lower(p_name || ' ' || p_brand), lower(phrase))) AS target, (SELECT min(p_partkey) FROM part WHERE contains(lower(p_name || ' ' || p_brand), lower(phrase))) IS NOT NULL AS resolved FROM d")
def doc_refs_resolve(spark, sf):
    part = t(spark, sf, "part").withColumn("title", F.concat_ws(" ", "p_name", "p_brand"))
    return graph.title_edges(part.select(F.col("p_type").alias("phrase")).distinct(), part, phrase="phrase", id="p_partkey", title="title", ordinal="p_partkey")


@query("doc_ref_check", """WITH d AS (SELECT DISTINCT p_type || ' ' || p_brand AS phrase FROM part), k AS (SELECT DISTINCT d.phrase FROM d JOIN part p ON contains(lower(p.p_name || CASE WHEN p.p_size > 45 THEN ' ' || p.p_type || ' ' || p.p_brand ELSE '' END), lower(d.phrase)))
SELECT DISTINCT o_custkey, p_type || ' ' || p_brand AS phrase, 'unresolved_reference' AS issue_type, 'medium' AS severity FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE p_type || ' ' || p_brand NOT IN (SELECT phrase FROM k)""")
def doc_ref_check(spark, sf):
    part, lines = t(spark, sf, "part"), t(spark, sf, "lineitem").join(t(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    titles = part.withColumn("title", F.concat_ws(" ", "p_name", F.when(F.col("p_size") > 45, F.concat_ws(" ", "p_type", "p_brand"))))
    refs = lines.join(part, F.col("p_partkey") == F.col("l_partkey")).select("o_custkey", F.concat_ws(" ", "p_type", "p_brand").alias("phrase"))
    return graph.unresolved_refs(refs, titles, doc="o_custkey", phrase="phrase", id="p_partkey", title="title", ordinal="p_partkey")


@query("docset_audit", f"""WITH RECURSIVE {DOCSET}, {CLOSURE}, {RESOLVED}
SELECT 'orphan' AS issue, id, NULL AS detail FROM docs WHERE NOT base AND id NOT IN (SELECT src FROM edges UNION SELECT dst FROM edges)
UNION ALL SELECT DISTINCT 'dated_before_target', src, NULL FROM edges JOIN docs a ON a.id = src JOIN docs b ON b.id = dst WHERE a.d < b.d
UNION ALL SELECT 'on_cycle', a.src, min(a.dst)::VARCHAR FROM r a JOIN r b ON b.src = a.dst AND b.dst = a.src GROUP BY a.src
UNION ALL SELECT DISTINCT CASE WHEN to_exhibit THEN 'missing_exhibit' ELSE 'unresolved_reference' END, id, ref FROM resolved WHERE target IS NULL""")
def docset_audit(spark, sf):
    return graph.docset_audit(docset(spark, sf, "docs"), docset(spark, sf, "edges"), docset(spark, sf, "refs"), by="grp", id="id", title="title", ordinal="seq", date="d", is_base="base", is_exhibit="exhibit", ref="ref", to_exhibit="to_exhibit")


@query("doc_refs_two_stages", f"WITH {DOCSET}, {RESOLVED} SELECT id, ref, target, how FROM resolved")
def doc_refs_two_stages(spark, sf):
    return graph.resolve_references(docset(spark, sf, "refs"), docset(spark, sf, "docs"), by="grp", ref="ref", id="id", title="title", ordinal="seq", is_exhibit=F.col("exhibit")).select("id", "ref", "target", "how")


@query("reading_places", f"""WITH RECURSIVE {DOCSET}, {CLOSURE}, c AS (SELECT src FROM r WHERE src = dst), bad AS (SELECT src AS node FROM c UNION SELECT r.dst FROM r JOIN c USING (src)), n AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges),
lv AS (SELECT node, 0 AS level FROM n WHERE node NOT IN (SELECT dst FROM edges) AND node NOT IN (SELECT node FROM bad) UNION SELECT e.dst, lv.level + 1 FROM lv JOIN edges e ON e.src = lv.node WHERE e.dst NOT IN (SELECT node FROM bad)),
l AS (SELECT node, max(level) AS level FROM lv GROUP BY 1 UNION ALL SELECT node, -1 FROM bad), g AS (SELECT node, level, (SELECT count(*) FROM edges WHERE dst = node) AS i, (SELECT count(*) FROM edges WHERE src = node) AS o FROM l)
SELECT node, level::INT AS level, (row_number() OVER (PARTITION BY level ORDER BY CASE WHEN level < 0 THEN i END, CASE WHEN level < 0 THEN o END, node))::INT AS place FROM g""")
def reading_places(spark, sf):
    """The order in which a document set is read, with what lies on or behind a cycle in the order of its degrees."""
    return graph.reading_positions(docset(spark, sf, "edges"))


#: Orders as documents (agreements and exhibits) whose clauses, the lines, point to a clause of the customer's order before.
XDOC = """
x0 AS (SELECT o_orderkey AS doc, o_custkey AS grp, CASE WHEN o_orderkey % 2 = 1 THEN 'Supply  O' || CAST(o_orderkey AS STRING) || ' Agreement' ELSE 'Exhibit X' || CAST(o_orderkey AS STRING) || ' (Prices)' END AS title,
  lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev FROM orders),
xl AS (SELECT l_orderkey AS doc, l_linenumber AS clause, min(l_partkey) AS part FROM lineitem GROUP BY l_orderkey, l_linenumber),
xc AS (SELECT x0.doc, grp, clause, CASE WHEN prev IS NULL THEN 'nothing' WHEN prev % 2 = 1 THEN 'Pursuant to the O' || CAST(prev AS STRING) || '  agreement section ' || CAST(part % 9 AS STRING) || ' and' ELSE 'see EXHIBIT X' || CAST(prev AS STRING) || ' Section ' || CAST(part % 9 AS STRING) || '.' END AS body FROM x0 JOIN xl ON xl.doc = x0.doc)"""


@query("xdoc_clause_edges", rf"""WITH {XDOC}, m AS (SELECT grp, doc, clause, regexp_extract(body, '(?i)(?:as defined in|pursuant to)\s+(?:the\s+)?(\w+\s+(?:agreement|lease|amendment))\s+section\s+([0-9.]+)', ['name', 'no']) AS a, regexp_extract(body, '(?i)((?:exhibit|schedule)\s+[a-z0-9]+)\s+section\s+([0-9]+)', ['name', 'no']) AS b FROM xc),
h AS (SELECT grp, doc, clause, lower(regexp_replace(a.name, '\s+', ' ', 'g')) AS name, a.no AS no FROM m WHERE a.name <> '' UNION ALL SELECT grp, doc, clause, lower(regexp_replace(b.name, '\s+', ' ', 'g')), b.no FROM m WHERE b.name <> ''),
o AS (SELECT h.grp, h.doc, clause, no, arg_min(x0.doc, x0.doc) AS other_doc FROM h JOIN x0 ON x0.grp = h.grp AND contains(lower(title), name) GROUP BY 1, 2, 3, 4)
SELECT o.doc, o.clause, o.other_doc, xl.clause AS dst FROM o JOIN xl ON xl.doc = o.other_doc AND xl.clause::VARCHAR = o.no""")
def xdoc_clause_edges(spark, sf):
    parts = [over(spark, f"WITH {XDOC} SELECT * FROM {name}", orders=t(spark, sf, "orders"), lineitem=t(spark, sf, "lineitem")) for name in ("xc", "x0")]
    out = graph.cross_document_edges(*parts, by="grp", doc="doc", src="clause", text="body", number="clause", title="title", ordinal="doc")
    return out.select("doc", "clause", "other_doc", "dst")


@query("community_scores", f"""WITH RECURSIVE {DAG_SQL}, b AS (SELECT src AS a, dst AS b FROM g UNION SELECT dst, src FROM g), r AS (SELECT DISTINCT a AS id, a AS seen FROM b UNION SELECT r.id, b.b FROM r JOIN b ON b.a = r.seen), c AS (SELECT id, min(seen) AS c FROM r GROUP BY 1),
m AS (SELECT count(*)::DOUBLE AS m2 FROM b), k AS (SELECT x.c, count(*) AS d, count(*) FILTER (x.c = y.c) AS inside FROM b JOIN c x ON x.id = a JOIN c y ON y.id = b.b GROUP BY 1)
SELECT count(*) AS n_communities, round(sum(inside / m2 - (d / m2) ^ 2), 9) AS modularity FROM k, m""")
def community_scores(spark, sf):
    edges = supplier_dag(spark, sf)
    parts = graph.components(edges).withColumnRenamed("component", "community")
    return graph.modularity(edges, parts).withColumn("modularity", F.round("modularity", 9))


@query("refined_communities")
def refined_communities(spark, sf):
    return graph.refined_communities(supplier_dag(spark, sf), rounds=8)[0]


@query("term_dictionary", "SELECT p_name, arg_max(p_brand, (p_size, -p_partkey)) AS definition, count(DISTINCT p_brand) AS n_definitions, count(DISTINCT p_brand) > 1 AS conflicting FROM part GROUP BY 1")
def term_dictionary(spark, sf):
    return graph.term_dictionary(t(spark, sf, "part"), term="p_name", definition="p_brand", date="p_size", ordinal="p_partkey")


@query("chunk_relations", "SELECT conv_id, turn, string_agg(dst::VARCHAR, ',' ORDER BY dst) AS related FROM (SELECT a.conv_id, a.turn, b.turn AS dst FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn IN (a.turn + 1, a.turn + 3)) GROUP BY 1, 2")
def chunk_relations(spark, sf):
    rows = t(spark, sf, "conversations").select("conv_id", "turn")
    rels = rows.select("conv_id", "turn", F.explode(F.array(F.col("turn") + 1, F.col("turn") + 3)).alias("dst"))
    out = graph.relations(rows, rels, doc="conv_id", node="turn", target="dst")
    return out.select("conv_id", "turn", F.array_join(F.transform("related", lambda x: x.cast("string")), ",").alias("related"))


@query("neighbour_context", "SELECT conv_id, turn, right(lag(text) OVER w, 50) AS before, left(lead(text) OVER w, 50) AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def neighbour_context(spark, sf):
    return graph.neighbours(t(spark, sf, "conversations"), doc="conv_id", order="turn", text="text", context=50).select("conv_id", "turn", "before", "after")


@query("clause_nodes", "SELECT p_partkey, split_part(p_name, ' ', 1) AS section, split_part(p_type, '_', 1) AS kind, CASE WHEN p_size > 40 THEN 'high' ELSE 'low' END AS risk FROM part")
def clause_nodes(spark, sf):
    part = t(spark, sf, "part").withColumn("field", F.replace("p_name", F.lit(" "), F.lit(".")))
    return graph.clause_nodes(part, field="field", key="p_type", risky=F.col("p_size") > 40).select("p_partkey", "section", "kind", "risk")


@query("trigram_embed", "SELECT doc_id, sum(c)::BIGINT AS n_trigrams FROM (SELECT doc_id, length(text) - 2 AS c FROM documents WHERE length(text) >= 3) GROUP BY 1")
def trigram_embed(spark, sf):
    return similarity.trigram_counts(t(spark, sf, "documents"), id="doc_id", text="text").groupBy("doc_id").agg(F.sum("n").alias("n_trigrams"))


COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query("similar_topk", f"SELECT b.vec_id AS id, round({COS}, 6) AS similarity FROM embeddings a, embeddings b WHERE a.vec_id = 7 AND b.vec_id <> 7 AND round({COS}, 6) >= 0.2 ORDER BY 2 DESC, 1 LIMIT 5")
def similar_topk(spark, sf):
    e = t(spark, sf, "embeddings")
    return similarity.similar(e, e.filter("vec_id = 7"), id="vec_id", vector="embedding", k=5, least=0.2).select("id", "similarity")


@query("similar_topk_all", f"SELECT query_id, id, similarity FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, round({COS}, 6) AS similarity, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({COS}, 6) DESC, b.vec_id) AS nth FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id AND round({COS}, 6) >= 0.2) WHERE nth <= 5")
def similar_topk_all(spark, sf):
    e = t(spark, sf, "embeddings")
    return similarity.similar(e, e.filter("vec_id % 100 = 0"), id="vec_id", vector="embedding", k=5, least=0.2)


@query("outliers", """
WITH u AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings),
c AS (SELECT list(m ORDER BY i) AS c FROM (SELECT i, avg(v[i]) AS m FROM (SELECT v, unnest(range(1, 65)) AS i FROM u) GROUP BY i)),
s AS (SELECT vec_id AS id, round(list_inner_product(v, c), 9) AS mean_similarity FROM u, c)
SELECT id, mean_similarity FROM s WHERE mean_similarity <= (SELECT quantile_cont(mean_similarity, 0.1) FROM s)""")
def outliers(spark, sf):
    return similarity.outliers(t(spark, sf, "embeddings"), id="vec_id", vector="embedding")


NEAR_SQL = """u AS (SELECT vec_id AS id, vec_id % 20 AS doc, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings),
near AS (SELECT a.id AS a, b.id AS b, a.doc AS a_doc, b.doc AS b_doc, round(list_inner_product(a.v, b.v), 6) AS similarity FROM u a JOIN u b ON a.id < b.id)"""


@query("near_dup_groups", f"""WITH RECURSIVE {NEAR_SQL}, e AS (SELECT a, b FROM near WHERE similarity >= 0.4), g AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT DISTINCT a AS id, a AS seen FROM g UNION SELECT r.id, g.b FROM r JOIN g ON g.a = r.seen)
SELECT id, min(seen) AS group_id FROM r GROUP BY 1""")
def near_dup_groups(spark, sf):
    return similarity.duplicate_groups(similarity.similar_links(t(spark, sf, "embeddings"), id="vec_id", vector="embedding", least=0.4))


@query("xdoc_similarity", f"WITH {NEAR_SQL} SELECT a, b, similarity FROM near WHERE similarity >= 0.3 AND a_doc <> b_doc")
def xdoc_similarity(spark, sf):
    pairs = similarity.similar_pairs(t(spark, sf, "embeddings"), id="vec_id", vector="embedding", least=0.3)
    return pairs.filter(F.col("a") % 20 != F.col("b") % 20)


@query("standard_clauses")
def standard_clauses(spark, sf):
    e = t(spark, sf, "embeddings").select("vec_id", "embedding", (F.col("vec_id") % 20).alias("doc"))
    return similarity.boilerplate_groups(similarity.similar_pairs(e, id="vec_id", vector="embedding", least=0.3), e, id="vec_id", doc="doc")


@query("common_types", "SELECT event_type, count(DISTINCT user_id) AS n_docs FROM events GROUP BY 1 HAVING count(DISTINCT user_id) = (SELECT count(DISTINCT user_id) FROM events)")
def common_types(spark, sf):
    return similarity.common_types(t(spark, sf, "events"), doc="user_id", kind="event_type")


@query("exact_text_dups", "SELECT md5(text) AS digest, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_text_dups(spark, sf):
    return similarity.exact_duplicates(t(spark, sf, "documents"), id="doc_id", text="text")
