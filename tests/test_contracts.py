"""Operators on small contract-like fixtures, where the driver tables hold nothing of the kind."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedge.functions.rules import Rule, RuleSet
from sedge.operators import changelog, facts, gates, graph, segment, similarity, texttables
from sedge.sources import tables

TEXT = """--- PAGE 1 ---
ARTICLE I. PREMISES
The landlord lets the suite at 12 Elm Street to the tenant for use as an office and for nothing else.
Section 1.1 Term
The term is 60 months. Base rent shall be $2,500 per month, and the tenant gives 90 days notice before renewal.
--- PAGE 2 ---
(a) Subject to Section 9.2
Rent is due on the first day. If rent is late then a charge of 5% is added to what is due for that month."""
HEADS = RuleSet([Rule("h", r"^ARTICLE [IVXLC0-9]+", 1.0), Rule("h", r"^Section [0-9.]+", 2.0), Rule("h", r"^\([a-z]\) ", 3.0)])


@pytest.fixture(scope="module")
def docs(spark):
    rows = [("d1", TEXT), ("d2", "no pages " * 800), ("d3", ""), ("d4", None)]
    return spark.createDataFrame(rows, "doc_id string, text string")


def test_pages_and_positions(docs):
    pages = segment.page_markers(docs)
    by = {}
    for r in pages.collect():
        by.setdefault(r.doc_id, []).append((r.page_num, r.pos))
    assert sorted(by["d1"]) == [(1, 0), (2, TEXT.index("--- PAGE 2"))]
    assert sorted(by["d2"]) == [(1, 0), (2, 3000)]
    points = docs.filter("doc_id = 'd1'").select("doc_id", F.explode(F.array(F.lit(5), F.lit(len(TEXT) - 1))).alias("pos"))
    assert sorted((r.pos, r.page_num) for r in segment.assign_page(points, pages).collect()) == [(5, 1), (len(TEXT) - 1, 2)]


def test_sections_give_the_text_back(docs):
    heads = segment.drop_overlaps(segment.headings(segment.lines(docs), HEADS))
    assert sorted((r.level, r.line) for r in heads.collect()) == [(1, "ARTICLE I. PREMISES"), (2, "Section 1.1 Term"), (3, "(a) Subject to Section 9.2")]
    tree = segment.parent_of(segment.section_cut(heads, docs)).orderBy("char_start").collect()
    assert [r.content for r in tree] == [TEXT[r.char_start : r.section_end] for r in tree]
    starts = [r.char_start for r in tree]
    assert [r.parent_start for r in tree] == [None, starts[0], starts[1]]


def test_facts(docs):
    rules = [facts.FactRule("rent", r"\$([0-9,]+) per month", 1, 0.9), facts.FactRule("notice", r"([0-9]+ days) notice", 1), facts.FactRule("rent", r"([0-9]+)%", 1, 0.3)]
    out = facts.extract_facts(docs, rules, id="doc_id", text="text", mode="first", least_chars=1).collect()
    assert sorted((r.field, r.value, r.confidence) for r in out) == [("notice", "90 days", 0.8), ("rent", "2,500", 0.9)]


def test_terms_of_several_words(spark):
    texts = spark.createDataFrame([(1, "The Base  Rent (and base rent) of the premises"), (2, "base, then rent; additional base-rent charge"), (3, ""), (4, None)], "id long, text string")
    terms = spark.createDataFrame([("Base Rent", "a"), ("Premises", "b"), ("Additional Base Rent Charge", "c"), ("", "d")], "term string, definition string")
    out = facts.resolve_terms(texts, terms, id="id", text="text", term="term", definition="definition").collect()
    assert sorted((r.id, r.definition) for r in out) == [(1, "a"), (1, "b"), (2, "a"), (2, "c")]


def test_rules_with_gate_and_unless(docs):
    rules = RuleSet([Rule("a", "rent", name="late rent", gate="late", unless="grace"), Rule("b", "sublet", name="sublet")])
    hits = docs.select("doc_id", F.explode(rules.hits(F.lower("text"))).alias("h")).collect()
    assert [(r.doc_id, r.h.name) for r in hits] == [("d1", "late rent")]
    again = RuleSet.from_rows(docs.sparkSession.createDataFrame([("a", "rent", 2.0)], "group string, pattern string, weight double"))
    assert again.rules == [Rule("a", "rent", 2.0)]


def test_template_and_evidence(docs):
    t = docs.sparkSession.createDataFrame([("x", "[NAME] and [DATE] of {CITY} ____ [A] [B] [C]")], "doc_id string, text string")
    assert gates.template_marks(t, [r"\[[^\]]*\]", r"\{[^}]*\}", "_{3,}"]).first()["n_marks"] == 7
    assert gates.evidence(docs.filter("doc_id = 'd1'"), ["90 days"], context=8).first()["evidence"] == "...tenant gives 90 days notice before..."


def test_text_tables(spark):
    text = "intro\nUnit | Rent | Tenant\n1 | 100 | A\n2 | 200 | vacant\nend"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    cells = texttables.cells(texttables.delimited_blocks(segment.lines(df), id="doc_id"), id="doc_id")
    assert sorted((r.row_no, r.header, r.value) for r in cells.collect() if r.header == "Rent") == [(1, "Rent", "100"), (2, "Rent", "200")]
    assert texttables.validate(cells, id="doc_id").first()["valid"]
    assert texttables.rollups(cells, id="doc_id").first()["n_vacant"] == 1


def test_references_and_order(spark):
    clauses = spark.createDataFrame([("d", 1, "1.1", "subject to Section 9.2"), ("d", 2, "9.2", "see Section 7"), ("d", 3, "4", "none")], "doc string, ord int, number string, text string")
    edges = graph.reference_edges(clauses, doc="doc", src="ord", text="text", number="number", rules=[(r"Section ([0-9.]+[0-9]|[0-9]+)", "refers"), (r"subject to Section ([0-9.]+)", "subject_to")])
    assert sorted((r.ord, r.dst, r.rel_type) for r in edges.collect()) == [(1, 2, "refers"), (1, 2, "subject_to")]
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (0, 1), (5, 6)], "src long, dst long")
    assert {r.node: r.level for r in graph.topo_levels(e).collect()} == {0: 0, 5: 0, 6: 1, 1: -1, 2: -1, 3: -1}
    assert {r.node: r.component for r in graph.components(e).collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 5: 5, 6: 5}
    assert graph.pagerank(e.filter("false")).count() == 0


def test_levels_take_few_rounds_on_dense_graphs(spark, monkeypatch):
    pairs = [(i, j) for i in range(100) for j in range(i + 1, 100)] + [(i, 200 + i % 3) for i in range(0, 90, 7)] + [(200, 201), (201, 202), (202, 201), (99, 300)]
    want = {**{i: i for i in range(100)}, 200: 85, 201: -1, 202: -1, 300: 100}
    steps, plain = [], graph.saved_with
    monkeypatch.setattr(graph, "SMALL_REST", 1500)
    monkeypatch.setattr(graph, "saved_with", lambda df, name, measure: steps.append(name) or plain(df, name, measure))
    assert {r.node: r.level for r in graph.topo_levels(spark.createDataFrame(pairs, "src long, dst long")).collect()} == want
    assert 1 <= steps.count("topo-step") < 10  # 101 levels
    monkeypatch.setattr(graph, "SMALL_REST", 3)  # the free nodes alone are more
    assert {r.node: r.level for r in graph.topo_levels(spark.createDataFrame([(1, 11), (2, 12), (11, 12), (3, 13), (4, 14), (5, 15)], "src long, dst long")).collect()} == {1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 11: 1, 12: 2, 13: 1, 14: 1, 15: 1}


def test_levels_of_a_long_path(spark, monkeypatch):
    path = [(i, i + 1) for i in range(1200)] + [(2000, 2001), (2001, 2000), (2001, 2002)]
    want = {**{i: i for i in range(1201)}, 2000: -1, 2001: -1, 2002: -1}
    edges = spark.createDataFrame(path, "src long, dst long")
    assert {r.node: r.level for r in graph.topo_levels(edges).collect()} == want
    monkeypatch.setattr(graph, "SMALL_REST", 2396, raising=False)  # some rounds first
    assert {r.node: r.level for r in graph.topo_levels(edges).collect()} == want


def test_state_as_of_the_end_is_the_current_state(spark):
    log = spark.createDataFrame([("b", "rent", "10", 1), ("b", "rent", "12", 3), ("b", "term", "5", 2)], "base string, key string, value string, seq int")
    now = changelog.current_state(log, base="base", key="key", value="value", order=F.col("seq"))
    then = changelog.current_state(log, base="base", key="key", value="value", order=F.col("seq"), until=F.col("seq") <= 99)
    assert sorted(now.collect()) == sorted(then.collect())
    assert {r.key: r.value for r in now.collect()} == {"rent": "12", "term": "5"}


def test_vectors(spark):
    """a-b and b-c are near, a-c is not: one group by components, two leaders by absorption."""
    rows = [(1, "p", [1.0, 0.0, 0.0]), (2, "q", [0.95, 0.312, 0.0]), (3, "r", [0.805, 0.593, 0.0]), (4, "s", [0.0, 0.0, 0.0]), (5, "t", [0.0, 0.0, 1.0]), (6, "u", [0.0, 0.0, 2.0])]
    df = spark.createDataFrame(rows, "id long, doc string, v array<double>")
    pairs = similarity.similar_pairs(df, id="id", vector="v", least=0.94)
    assert sorted((r.a, r.b) for r in pairs.collect()) == [(1, 2), (2, 3), (5, 6)]
    assert {r.id: r.group_id for r in similarity.duplicate_groups(pairs).collect()} == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5}
    led = similarity.boilerplate_groups(pairs, df, id="id", doc="doc", least_docs=2)
    assert sorted((r.leader, r.id) for r in led.collect()) == [(1, 1), (1, 2), (5, 5), (5, 6)]


def test_similar_answers_every_query(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, [0.1, 0.9]), (5, [0.0, 0.0])], "id long, v array<double>")
    out = similarity.similar(df, df.filter("id IN (1, 3, 5)"), id="id", vector="v", k=1, least=0.5).collect()
    assert sorted((r.query_id, r.id) for r in out) == [(1, 2), (3, 4)]


def test_similar_pairs_are_all_found(spark, monkeypatch):
    """Against brute force, over several blocks, with a large group of equal vectors."""
    monkeypatch.setattr(similarity, "BLOCK", 300, raising=False)
    rng = np.random.default_rng(1)
    data = rng.standard_normal((1000, 32))
    data[100:160] = data[100]
    unit = data / np.sqrt((data * data).sum(axis=1, keepdims=True))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "id long, v array<double>")
    a, b = np.nonzero(np.triu(np.round(unit @ unit.T, 6) >= 0.4, 1))
    want = set(zip(a.tolist(), b.tolist(), strict=True))
    got = [(r.a, r.b) for r in similarity.similar_pairs(df, id="id", vector="v", least=0.4).collect()]
    assert len(got) == len(want) and set(got) == want
    links = similarity.similar_links(df, id="id", vector="v", least=0.4)
    groups = {r.id: r.group_id for r in similarity.duplicate_groups(links).collect()}
    assert groups == {r.node: r.component for r in graph.components(spark.createDataFrame(got, "src long, dst long")).collect()}


@pytest.mark.parametrize("clustered", [True, False])
def test_far_blocks_are_left_out_and_no_pair_is_lost(spark, monkeypatch, clustered):
    monkeypatch.setattr(similarity, "BLOCK", 60)
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((12, 16))
    data = centres[rng.integers(0, 12, 900)] + rng.standard_normal((900, 16)) * (0.15 if clustered else 5.0)
    rows = [(i, v.tolist()) for i, v in enumerate(data)] + [(2000, [1.0, 0.0]), (2001, [1.0, 0.1])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    unit = data / np.sqrt((data * data).sum(axis=1, keepdims=True))
    a, b = np.nonzero(np.triu(np.round(unit @ unit.T, 6) >= 0.9, 1))
    got = [(r.a, r.b) for r in similarity.similar_pairs(df, id="id", vector="v", least=0.9).collect()]
    assert sorted(got) == sorted([*zip(a.tolist(), b.tolist(), strict=True), (2000, 2001)])
    placed, pairs = similarity.block_plan(similarity.normalised(df, id="id", vector="v"), 0.9)
    n, kept = placed.select("block").distinct().count(), pairs.count()
    share = 1 - kept / (n * (n + 1) / 2)
    assert share > 0.6 if clustered else share < 0.3
    print(f"left out of {n} blocks' pairs: {share:.2f}")
    assert similarity.similar_pairs(df.limit(0), id="id", vector="v", least=0.9).count() == 0


def test_party_facts(spark):
    from sedge.functions.catalogues import PARTIES

    text = "Suite 12B on the second floor has 1,200 square feet and two parking spaces. The lease is month-to-month. Rent is due on the first day of each month; a late fee of $50.00 applies after a grace period of 5 days. No pets allowed. Tenant pays for water, gas and internet. Landlord may enter after 24 hours. The laws of the State of New York apply. Holding over costs 150% of rent. Guaranteed by: Elm Bank LLC"
    got = {r.field: r.value for r in facts.extract_facts(spark.createDataFrame([(1, text)], "doc_id long, text string"), PARTIES, id="doc_id", text="text", mode="first", least_chars=1).collect()}
    want = {"unit": "12B", "floor": "second floor", "area": "1,200", "parking": "two", "month_to_month": "month-to-month", "rent_due": "first", "late_fee": "50.00", "grace_period": "5 days", "pets": "No pets allowed", "utilities": "water, gas and internet", "entry_notice": "24 hours", "governing_law": "New York", "holdover": "150", "guarantor": "Elm Bank LLC"}
    assert {k: got.get(k) for k in want} == want


def test_responses(spark):
    raw = [(1, '{"category": "x", "confidence": 0.5, "risk_flags": []}'), (2, "say {\"category\": \"x\", \"confidence\": 2, \"risk_flags\": []} ok"), (3, "{cut"), (4, None), (5, "")]
    out = tables.validate_responses(tables.parse_responses(spark.createDataFrame(raw, "id long, raw string"), raw="raw")).collect()
    assert {r.id: r.reject_reason for r in out} == {1: None, 2: "confidence range", 3: "not json", 4: "not json", 5: "not json"}


def test_catalogues(spark):
    from sedge.functions.catalogues import CATALOGUES

    text = (
        "This lease is between Elm Holdings LLC (the \"Landlord\") and Blue Bakery Inc. (\"Tenant\"). The premises located at 12 Elm Street, Springfield.\n"
        "The term shall be 60 months, commencing on March 1, 2024 and expiring on February 28, 2029. Base rent shall be $2,500.00 per month, increased by 3% each year.\n"
        "Tenant may renew with 90 days notice; there are two (2) options to extend. Tenant shall cure any default within 10 days. If rent is late, then a fee is due. Right of first refusal applies.\n"
        "Percentage rent of 6% of gross sales above $500,000. Triple net; common area costs are estimated at $4.50. Security deposit of $5,000."
    )
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = {(name, r.field): r.value for name, rules in CATALOGUES.items() for r in facts.extract_facts(df, rules, id="doc_id", text="text", mode="first", least_chars=1).collect()}
    want = {
        ("rent", "rent_amount"): "2,500.00", ("rent", "escalation"): "3", ("percentage_rent", "percentage"): "6", ("percentage_rent", "breakpoint"): "500,000", ("shared_costs", "structure"): "Triple net",
        ("critical_dates", "start_date"): "March 1, 2024", ("critical_dates", "end_date"): "February 28, 2029", ("notice", "cure_period"): "10 days", ("conditions", "condition"): "rent is late",
        ("options", "renewal_options"): "two", ("options", "first_refusal"): "Right of first refusal", ("parties", "landlord"): "Elm Holdings LLC", ("parties", "term"): "60 months", ("parties", "deposit"): "5,000",
    }
    assert {k: got.get(k) for k in want} == want


#: Of each built-in rule: contract type, key, a text it must fire on and one it must not.
RULE_CASES = {
    "broad_assignment_rights": ("all", "assignment", "Lessee is free to sublease the unit without asking for anyone's approval: no consent is needed to sublease.", "Lessee needs a written approval for any sublease."),
    "arbitrary_consent_standard": ("all", "sublet_rights", "The lessee may not sublet any part.", "The lessee may not sublet any part unless approval is given, which shall be reasonable. Approval must be reasonable."),
    "unclear_termination_notice": ("all", "term", "Lessee is entitled to cancel the contract.", "Lessee is entitled to cancel the contract. It notifies the owner sixty days ahead."),
    "uncertain_commencement": ("all", "commencement", "The term begins on a day to be agreed.", "The term begins on 1 May."),
    "undefined_escalation": ("all", "base_rent", "Rent rises every spring.", "Rent rises every spring by 2 percent."),
    "uncapped_cpi": ("all", "rent", "Rent follows the cost of living.", "Rent follows the cost of living, at most 3% a year."),
    "incomplete_insurance": ("all", "insurance", "Lessee insures itself.", "Lessee keeps a policy. " * 20),
    "insurance_without_limits": ("all", "liability", "Lessee takes care of everything that may happen.", "Lessee keeps a policy over one million."),
    "no_mutual_subrogation": ("all", "insurance", "Lessee releases subrogation.", "Either party releases the other from subrogation."),
    "restrictive_use": ("all", "permitted_use", "The unit is used solely as a bakery.", "The unit is used solely as a bakery and for related uses."),
    "no_cotenancy_remedy": ("retail", "co_tenancy", "There is a co-tenancy with the anchor.", "If the co-tenancy fails, rent abates."),
    "undefined_percentage_rent": ("retail", "percentage_rent", "Percentage rent is due each quarter.", "Percentage rent is 5 percent of sales."),
    "mandatory_mall_hours": ("retail", "operating_hours", "The shop must keep the hours of the mall.", "The shop keeps its own hours."),
    "no_tenant_exclusive": ("retail", "exclusive", "The owner grants exclusivity to another shop.", "The lessee has the exclusive for bread in the mall."),
    "no_opex_cap": ("office", "opex", "Running costs are shared.", "Running costs are shared, with a ceiling."),
    "no_audit_rights": ("office", "opex", "Running costs are shared.", "Lessee inspects the ledgers of running costs."),
    "no_measurement_standard": ("office", "area", "The floor has 900 square feet.", "The floor has 900 square feet by the BOMA rules."),
    "undefined_ti_allowance": ("office", "allowance", "There is an improvement allowance.", "There is an improvement allowance of $ 20,000."),
    "tenant_preexisting_env_liability": ("industrial", "environmental", "Lessee is liable for any spill, earlier ones too.", "Lessee is liable for its own spills."),
    "no_hazmat_representations": ("industrial", "hazardous", "Toxic waste is kept out.", "Lessor discloses all toxic waste."),
    "unlimited_hazmat_indemnity": ("industrial", "hazardous", "Lessee indemnifies the owner for toxic waste.", "Lessee indemnifies the owner for toxic waste, save for what is there prior to the term."),
    "tenant_ada_liability": ("industrial", "ada", "Lessee bears the cost of accessibility of the building.", "Lessor bears the cost of accessibility."),
}


def test_every_clause_rule_fires_and_keeps_still(spark):
    from sedge.functions.clause_rules import CLAUSE_RISKS, clause_text
    from sedge.operators import risks

    assert set(RULE_CASES) == {r.name for rules in CLAUSE_RISKS.values() for r in rules}
    rows = [(name, kind, key, text, yes) for name, (kind, key, *texts) in RULE_CASES.items() for text, yes in zip(texts, (True, False), strict=True)]
    df = spark.createDataFrame(rows, "name string, kind string, clause_key string, line string, yes boolean")
    text = clause_text(F.col("clause_key"), F.col("line"))
    every = risks.clause_risks(df.filter("kind = 'all'"), RuleSet(CLAUSE_RISKS["all"]), text=text, keep=["name", "yes"])
    typed = risks.typed_risks(df, {k: RuleSet(v) for k, v in CLAUSE_RISKS.items() if k != "all"}, kind="kind", text=text, keep=["name", "yes"])
    fired = {(r.name, r.yes) for r in every.unionByName(typed).collect() if r.rule == r.name}
    assert fired == {(name, True) for name in RULE_CASES}


def test_document_rules(spark):
    from sedge.functions.clause_rules import ABSENCE_RISKS, PAIRED_RISKS, clause_text
    from sedge.operators import risks

    rows = [
        (1, 0, "permitted_use", "A shop for shoes."), (1, 1, "rent", "Monthly."), (2, 0, "permitted_use", "A shop for shoes."), (2, 1, "other", "Co-tenancy is agreed."), (3, 0, "permitted_use", "An office."), (3, 1, "rent", "The mall."),
        (4, 0, "repair", "Lessee repairs the roof."), (4, 1, "insurance", "Owner keeps property insurance."), (5, 0, "repair", "Lessee repairs the roof."), (5, 1, "insurance", "Lessee keeps property insurance."),
        (6, 0, "term", "Tenant may cancel."), (6, 1, "default", "Landlord makes all rent immediately due."), (7, 0, "term", "Tenant may cancel."), (7, 1, "default", "Landlord waits for the rent."), (8, 0, None, None),
    ]
    df = spark.createDataFrame(rows, "doc int, line_no int, k string, line string").withColumn("_x", clause_text(F.col("k"), F.col("line")))
    ((_, _, _, though, never),) = ABSENCE_RISKS
    assert [r.doc for r in risks.absence(df, doc="doc", never=F.col("_x").rlike(never), though=F.col("_x").rlike(though[0]) & F.col("_x").rlike(though[1])).collect()] == [1]
    found = {}
    for name, _, a, b in PAIRED_RISKS:
        side = lambda s: F.col("_x").rlike(s[0]) & F.col("_x").rlike(s[1])
        found[name] = [(r.doc, r.first_a, r.first_b) for r in risks.paired_risks(df, doc="doc", order="line_no", a=side(a), b=side(b)).collect()]
    assert found == {"repair_insurance_mismatch": [(4, 0, 1)], "termination_acceleration_conflict": [(6, 0, 1)]}
