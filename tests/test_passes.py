"""How often a text is read: rules share one pass, and words that a rule needs are looked for before its pattern."""

from __future__ import annotations

import dataclasses
import random

from sedge.functions import catalogues, joins
from sedge.operators import facts, gates, graph, segment
from sedge.plans import catalogue

SAID = """Acme Holdings LLC ("Landlord"), Beta & Co. (the “Lessor”) and Gamma Stores Inc., (the "Tenant"), Delta (lessee)\nLandlord: Acme Ltd\nLessee: Delta Sons
Premises: 12 Main Street, Unit 4\nlocated at known as 7 High Road, Springfield\nproperty at: 9 Low Lane, Suite no. 3B\nThe TERM shall be about 5 years; a term of 12 months\nSecurity deposit is $ 1,200.00 and late fee $50.00 or late charge of 4.5%
used only for offices; Use as a shop; used solely for storage room\nLandlord's address is 5 Park Row, Boston\nlessor notices are sent to: 8 Dock Street, Hull\nTenant's notices: 6 Mill Lane, York\nGuarantor: Eve Adams\nguaranteed by Zed Corp\nBroker: Kim Lee
Agents Max\nThree occupants and 2 adult persons\nApt. 5 on the third floor, 1,200 square feet, 900 sq. ft, 80 square meters, two-bedroom, 3 covered parking spaces, fully furnished\nIt commences on 2024-01-31 and expires 1/2/2030, ends on May 3, 2031
month-to-month, month to month\nHolding over costs 150%\nhold-over at 20 %\nRent is due on the 1st day of each month, payable by the first of every month\ngrace period of 5 days\nReturned check fee $25\ndishonoured payment $30.00\nprorated rent $10\nLast month's rent $900
deposit is refunded within 30 days\ncleaning fee $75\nNo pets are allowed, pet deposit $200\nLessee shall pay for water, gas and electricity\nNo smoking\nno subletting is allowed\nLandlord may enter after 24 hours\nrenter's insurance of $100,000\nliability insurance $5\nThe laws of the State of New York
6% of gross sales over $1,000\nif late, then pay more\n30 days written notice\nincreasing by 3% each year\ncustomary areas, carpets, expenses in the center"""


def texts():
    rng, lines = random.Random(3), SAID.split("\n")
    for i in range(60):
        some = [rng.choice(lines) for _ in range(rng.randrange(12))]
        yield i, rng.choice(("\n", "\r\n", " ", "; ")).join(rng.choice((str, str.upper, str.title))(x) for x in some)
    yield from ((90, SAID), (91, ""), (92, None), (93, SAID.replace("\n", "\n\n")))


def test_words_of_rules_leave_out_no_match(spark):
    df = spark.createDataFrame(list(texts()), "doc_id long, text string")
    rules = catalogues.PARTIES
    assert all(r.words for r in rules)
    plain = [dataclasses.replace(r, words=(), in_line=False) for r in rules]
    got, want = (sorted(map(tuple, facts.extract_facts(df, x, id="doc_id", text="text", least_chars=1).collect())) for x in (rules, plain))
    assert got == want and {r[4] for r in want} == set(range(len(rules)))


def test_pairs_of_all_kinds_in_one_pass(spark, sf_dir):
    df = spark.createDataFrame(list(texts()), "doc_id long, text string")
    got = facts.extract_pair_kinds(df, catalogues.PAIRS, id="doc_id", text="text", words=catalogues.PAIR_WORDS)
    want = [(r[0], kind, *r[1:]) for kind, p in catalogues.PAIRS.items() for r in facts.extract_pairs(df, p, id="doc_id", text="text").select("doc_id", "ordinal", "first", "second").collect()]
    assert sorted(tuple(r) for r in got.select("doc_id", "kind", "ordinal", "first", "second").collect()) == sorted(want) and {k for _, k, *_ in want} == set(catalogues.PAIRS)
    for name in ("facts_pairs", "contract_risks"):  # orders and lineitem are read once
        plan = catalogue.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [") == 2, name


def test_missing_terms_lower_a_text_once(spark):
    df = spark.createDataFrame([(1, "The LICENSE_ der,und\nAND"), (2, "theory que"), (3, ""), (4, None), (5, "the")], "id int, text string")
    out = gates.missing_terms(df, ("the", "license", "der", "que", "and"))
    assert out.columns == ["id", "text", "missing"]
    assert {r.id: r.missing for r in out.collect()} == {1: ["license", "que"], 2: ["the", "license", "der", "and"], 3: ["the", "license", "der", "que", "and"], 4: [], 5: ["license", "der", "que", "and"]}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rank_rounds_are_tables(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (None, 4), (4, None)], "src int, dst int")
    ranked = graph.pagerank(edges, rounds=4)
    assert "Join" not in plan_of(ranked) and abs(sum(r["rank"] for r in ranked.collect()) - 1) < 1e-9
    assert [(r.node, r.in_degree) for r in sorted(graph.hubs(edges, top_n=9).collect())] == [(1, 1), (2, 1), (3, 1), (4, 1)]


def test_tasks_of_islands_and_labels_grow_in_number(spark, monkeypatch):
    monkeypatch.setattr(joins, "ROWS_OF_TASK", 10)
    monkeypatch.setattr(graph, "VOTES_MOST", 10)
    monkeypatch.setattr(graph, "LIST_MOST", 3)
    rows = spark.createDataFrame([(i % 40, i, i + 1, i / 100) for i in range(200)], "k int, s long, e long, c double")
    assert "RepartitionByExpression [k#" in plan_of(segment.merge_boundaries(rows, key="k", start="s", end="e", confidence="c")) and joins.dealt(rows, "k").rdd.getNumPartitions() == 20
    star = [(0, i) for i in range(1, 12)] + [(20, 21), (21, 22), (22, 20)]
    got = {r.node: r.community for r in graph.label_propagation(spark.createDataFrame(star, "src int, dst int"), rounds=1).collect()}
    assert got == {0: 1, **{i: 0 for i in range(1, 12)}, 20: 21, 21: 20, 22: 20}


def test_semantic_chunks_take_documents_batch_by_batch(spark):
    sents = spark.createDataFrame([(d, i, f"{'word ' * (d % 7 + 1)}number {i} of {d}.") for d in range(50) for i in range(d % 5 + 1)], "doc_id int, sent_no int, sentence string")
    sizes = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        out = []
        for n in ("7", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
            df = segment.semantic_chunks(sents, id="doc_id", order="sent_no", text="sentence", target=60)
            assert "InPandas" not in plan_of(df)
            out.append(sorted(map(tuple, df.collect())))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", sizes)
    assert out[0] == out[1] and {r[0] for r in out[0]} == set(range(50)) and sum(r[4] for r in out[0]) == sents.count()
