"""Cycles of document sets and phrases of sets: closed and small sets go without rounds and beginnings, the others are not lost."""

from __future__ import annotations

import random

import pytest

from sedge.functions import joins
from sedge.operators import graph
from tests.test_graphs import on_cycles


@pytest.mark.parametrize("small", [1_000_000, 6])
def test_cycles_of_sets(spark, monkeypatch, small):
    """Sets of five nodes; two are linked to each other, one node has no set, one set is large, one node is its own target."""
    monkeypatch.setattr(graph, "SMALL_REST", small)
    rng = random.Random(11)
    edges = {(g * 5 + rng.randint(0, 4), g * 5 + rng.randint(0, 4)) for g in range(6) for _ in range(6)} | {(0, 5), (7, 2), (29, 99), (99, 29), (12, 12)} | {(a, b) for a in range(15, 20) for b in range(15, 20) if a < b}
    nodes = spark.createDataFrame([(n, n // 5) for n in range(30)] + [(3, 4)], "node int, set int")  # a node in two sets
    got = [(r.node, r.component) for r in graph.cycle_members(spark.createDataFrame(sorted(edges), "src int, dst int"), sets=nodes).collect()]
    assert len(got) == len(dict(got)) and dict(got) == on_cycles(edges)
    assert graph.cycle_members(spark.createDataFrame([], "src int, dst int"), sets=nodes).count() == 0


def test_closed_sets_take_no_round(spark, monkeypatch):
    ring = [(g * 40 + i, g * 40 + (i + 1) % 40) for g in range(5) for i in range(40)]
    monkeypatch.setattr(graph, "SMALL_REST", 50)  # less than all edges, more than a set's
    written, save = [], graph.saved
    monkeypatch.setattr(graph, "saved", lambda df, name: written.append(name) or save(df, name))
    got = graph.cycle_members(spark.createDataFrame(ring, "src int, dst int"), sets=spark.createDataFrame([(n, n // 40) for n in range(200)], "node int, set int"))
    assert "scc-colour" not in written and {(r.node, r.component) for r in got.collect()} == {(n, n // 40 * 40) for n in range(200)}


@pytest.mark.parametrize("few", [100, 2])
def test_phrases_of_sets(spark, monkeypatch, few):
    monkeypatch.setattr(joins, "FEW_PHRASES", few)
    texts = [(1, "lease one and two"), (1, "nothing"), (2, "lease three of four"), (None, "one")]
    phrases = [(1, "one"), (1, "two"), (2, "three"), (2, "four"), (2, "lease three"), (2, "one"), (None, "one"), (2, ""), (1, None)]
    a, b = spark.createDataFrame(texts, "g int, t string"), spark.createDataFrame(phrases, "g int, p string")
    out = joins.containment_join(a, b, text="t", phrase="p", by=["g"], limit=0)
    assert ("_gram" in out._jdf.queryExecution().analyzed().toString()) == (few == 2)
    assert sorted((r.g, r.t, r.p) for r in out.collect()) == sorted((g, t, p) for g, t in texts for h, p in phrases if g is not None and g == h and p and p in t)
