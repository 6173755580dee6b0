"""Cases that the driver tables do not hold: responses, requests, exports, tables, tags, contexts, reports."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sedge.functions import catalogues
from sedge.functions.rules import Rule, RuleSet
from sedge.operators import checks, clauses, facts, graph, insights, texttables
from sedge.sources import tables


def test_responses_of_every_shape(spark):
    raw = [
        (1, "Rent", '{"detected_clauses": [{"clause_type": "rent", "confidence": 0.9}, {"clause_type": "rent"}, {"clause_type": "Certificate", "confidence": 1}, {"clause_type": null, "confidence": 0.7, "risks": [{"level": "low"}]}], "miscellaneous_clauses": [null, "a fine", ""]}'),
        (1, None, '{"extracted_items": [{"clause_type": "rent", "confidence": 0.8}], "detected_clauses": "none"}'), (2, "x", "{broken"), (3, "x", None), (4, "x", "{}"),
    ]
    df = tables.parse_responses(spark.createDataFrame(raw, "id int, section string, raw string"), raw="raw")
    got = {(r.id, r["shape"], r.clause_key): (r.clause_type, r.confidence, r.inferred, r.needs_review) for r in tables.response_clauses(df, id="id", section="section", kinds=RuleSet([Rule("penalty", "fine")])).collect()}
    assert got == {
        (1, "detected", "rent_data"): ("rent", 0.9, False, False), (1, "detected", "rent_data_2"): ("rent", 0.0, False, True), (1, "detected", "unknown_data"): (None, 0.7, True, True),
        (1, "loose", "penalty_data"): ("penalty", 0.6, True, False), (1, "loose", "misc_data"): ("misc", 0.7, True, False), (1, "item", "rent_data_3"): ("rent", 0.8, False, False),
    }


def test_requests_are_answered_by_a_function(spark):
    def call(texts):
        if "bad" in texts:
            raise RuntimeError("no answer")
        return [t.upper() for t in texts]

    df = spark.createDataFrame([(1, "a"), (2, None), (3, "bad"), (4, "x" * 20)], "id int, text string").coalesce(1)
    asked = tables.run_requests(tables.build_requests(df, text="text", most=10, policy="head", marker="~"), call, at_once=1)
    assert {r.id: r.raw for r in asked.collect()} == {1: "A", 2: None, 3: None, 4: "X" * 10 + "~"}
    long = spark.createDataFrame([(1, "".join(chr(97 + i % 26) for i in range(90)))], "id int, text string")
    got = tables.excerpts(long, id="id", text="text", over=20, piece=4, thirds_over=60, third=10).collect()
    text = long.first().text
    assert [r.excerpt for r in sorted(got, key=lambda r: r.piece_no)] == [text[:10], text[40:50], text[80:]]


def test_artifact_rows(spark, tmp_path):
    for doc, name in (("d1", "summary.md"), ("d1", "clauses.json"), ("d2", "summary.md")):
        (tmp_path / doc).mkdir(exist_ok=True)
        (tmp_path / doc / name).write_text("12345")
    assert sorted(tuple(r) for r in tables.artifact_rows(spark, str(tmp_path)).collect()) == [("d1", "clauses", 5), ("d1", "summary", 5), ("d2", "summary", 5)]


def cell_rows(spark, table, doc=1, block=1):
    head, *rows = table
    return spark.createDataFrame([(doc, block, i, j, h, v) for i, row in enumerate(rows, 1) for j, (h, v) in enumerate(zip(head, row, strict=True))], "id int, block_no int, row_no int, col_no int, header string, value string")


def test_table_types_shares_and_occupancy(spark):
    table = [("Unit", "Area sq ft", "Tenant", "Share"), ("1", "1,200 sq", "Ann", "33.33%"), ("2", "800", "VACANT", "33.33 %"), ("3", "-", "Bo", "33.33%"), ("4", "100", "Cy", "n/a")]
    cells = cell_rows(spark, table)
    assert tuple(texttables.cost_shares(cells, id="id").first()) == (1, 1, 99.99, True)
    assert tuple(texttables.occupancy(cells, id="id").first()) == (1, 1, 2100.0, 1200.0, 0.571429)  # the last row's share is not given, so it counts as vacant
    kinds = [("roster", ("unit", "tenant"), ("ann",)), ("rent", ("rent",), ("$",))]
    assert [tuple(r) for r in texttables.typed_tables(cells, kinds, id="id").collect()] == [(1, 1, "roster", 1.0, 1.0)]
    assert texttables.typed_tables(cells, [("rent", ("rent",), ("$",))], id="id").count() == 0
    words = cell_rows(spark, [("a", "b"), ("x", "y"), ("z", "w")])
    types = spark.createDataFrame([(1, 1, "rent")], "id int, block_no int, kind string")
    assert [texttables.validate_typed(words, types, ks, id="id").first().valid for ks in (["rent"], ["other"])] == [False, True]
    assert texttables.cost_shares(words, id="id").count() == texttables.occupancy(words, id="id").count() == 0


def test_tags_and_contexts(spark):
    schema = "k int, confidence double, fields map<string,string>, tags array<struct<type:string,level:string>>"
    parent = spark.createDataFrame([(1, 0.5, {"a": "p"}, [("x", "high"), ("y", "low")]), (2, 0.9, {}, [("x", "high")]), (3, 0.1, {}, None)], schema)
    child = spark.createDataFrame([(1, 0.6, {"a": "c"}, [("x", "low"), ("z", "low"), ("z", "high")]), (2, 0.9, {}, [("z", "low")]), (4, 0.1, {}, [("q", "low"), ("q", "high")]), (3, 0.2, {}, [("w", "low")])], schema)
    got = {r.k: (r.origin, [tuple(x) for x in r.tags]) for r in clauses.reconcile_tags(parent, child, keys=["k"]).collect()}
    assert got == {1: ("child", [("x", "high"), ("y", "low"), ("z", "low")]), 2: ("parent", [("x", "high")]), 3: ("child", [("w", "low")]), 4: ("inferred", [("q", "low")])}
    rows = [(1, 1, "A", {"t": "1", "u": "5"}, None, ["r"], None, 1), (1, 2, "B", {"t": "2"}, {"Landlord": "X"}, None, ["E1", "E1"], None), (2, 1, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc int, n int, section string, terms map<string,string>, roles map<string,string>, refs array<string>, exhibits array<string>, tables int")
    out = {r.doc: r for r in clauses.structure_context(df, doc="doc", order="n", section="section", terms="terms", roles="roles", refs="refs", exhibits="exhibits", tables="tables").collect()}
    assert (out[1].outline, out[1].terms, out[1].roles, out[1].refs, out[1].n_tables, out[1].exhibits) == (["A", "B"], ["t=2", "u=5"], ["Landlord=X"], ["r"], 1, ["E1"])
    assert (out[2].terms, out[2].roles, out[2].n_tables) == ([], [], 0)


def test_shares_sections_and_overviews(spark):
    df = spark.createDataFrame([(1, 1000.0, 10.0, 100.5), (2, 1000.0, 10.0, 102.0), (3, 0.0, 10.0, 5.0), (4, 1000.0, None, 5.0), (5, 1000.0, 10.0, 0.0)], "id int, t double, p double, e double")
    assert [(r.id, r.expected, r.severity) for r in checks.check_share(df, total=F.col("t"), percent=F.col("p"), estimate=F.col("e")).collect()] == [(2, 100.0, "medium")]
    docs = spark.createDataFrame([(1, "office", "rent and parking"), (2, None, "parking rent"), (3, "shop", "none")], "id int, kind string, text string")
    dim = spark.createDataFrame([(None, "Money", "rent", 1), (None, "Cars", "parking", 2), ("office", "Money", "rent", 9)], "kind string, section string, keyword string, place int")
    assert sorted(tuple(r) for r in insights.ordered_sections(docs, dim, id="id", text="text", kind="kind").collect()) == [(1, "Cars", 1), (1, "Money", 2), (2, "Cars", 2), (2, "Money", 1)]
    texts = spark.createDataFrame([(1, "Amendment of 1 May 2020 and 2 May 2020: $5, $6, $7, $8"), (2, None)], "id int, text string")
    got = {r.id: (r.doc_type, list(r.dates), list(r.amounts), r.n_words, r.n_pages) for r in facts.overview(texts, id="id", text="text", types=catalogues.DOCUMENT_TYPES, date=r"([0-9] May [0-9]{4})", amount=r"(\$[0-9])").collect()}
    assert got == {1: ("AMENDMENT", ["1 May 2020", "2 May 2020"], ["$5", "$6", "$7"], 13, 1), 2: ("OTHER", [], [], 0, 1)}
    answers = spark.createDataFrame([(1, 'Lessee: "Ann",\nRent: 5\nmonthly rent = $7\nlandlord: N/A\nuse:'), (2, "nothing"), (3, None)], "id int, text string")
    assert sorted((r.id, r.field, r.value) for r in facts.parse_key_values(answers, catalogues.KEY_VALUES, id="id", text="text").collect()) == [(1, "rent", "$7"), (1, "tenant", "Ann")]


def test_references_with_context_and_exports(spark):
    rows = [(1, 1, "1", "a" * 60 + " pursuant to Section 12 and subject to section 2 only"), (1, 2, "2", "x"), (1, 3, "12", "as in Section 2"), (1, 4, "3", None)]
    df = spark.createDataFrame(rows, "doc int, n int, no string, text string")
    got = sorted((r.n, r.dst, r.rel_type, r.strength, r.context) for r in graph.reference_table(df, doc="doc", src="n", text="text", number="no", rules=catalogues.REFERENCE_PHRASES).collect())
    assert [g[:4] for g in got] == [(1, 2, "cross_reference", 0.9), (1, 2, "subject_to", 0.9), (1, 3, "cross_reference", 0.9)]
    assert got[2][4] == "a" * 49 + " pursuant to Section 12 and subject to section 2 only" and "subject to section 2 only" in got[0][4]
    nodes = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    edges = spark.createDataFrame([(1, 2, "a"), (1, 2, "a"), (2, 1, "b"), (1, 9, "a")], "src int, dst int, kind string")
    out, table = graph.graph_tables(nodes, edges, node="id", src="src", dst="dst", kind="kind")
    assert sorted(tuple(r) for r in out.collect()) == [(1, 2, 1, 2), (2, 1, 2, 2), (3, 0, 0, 0)]
    assert sorted(tuple(r) for r in table.collect()) == [(1, 2, "a", 2), (2, 1, "b", 1)]


@pytest.mark.parametrize("accuracy", [10, 10_000])
def test_percentiles_count_ties(spark, accuracy):
    from sedge.functions.joins import percentiles

    rows = [("a", 1.0)] * 500 + [("a", 2.0)] * 400 + [("a", float(i)) for i in range(3, 103)] + [(None, 5.0), (None, 7.0), ("b", None)]
    got = {r.g: (r.n, r.percentile) for r in percentiles(spark.createDataFrame(rows, "g string, x double"), by=["g"], value="x", p=0.5, accuracy=accuracy).collect()}
    assert got == {"a": (1000, 1.5), None: (2, 6.0)}
