"""Graphs, references, change logs and missing categories against plain versions."""

from __future__ import annotations

import random

import pytest

from sedge.operators import changelog, graph, risks


def on_cycles(edges):
    """{node: least node of its cycle's component} by reachability."""
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    reach = {}
    for start in {n for e in edges for n in e}:
        seen, todo = set(), [start]
        while todo:
            for n in out.get(todo.pop(), ()):
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        reach[start] = seen
    return {n: min(m for m in reach[n] if n in reach[m]) for n in reach if n in reach[n]}


@pytest.mark.parametrize("small", [200_000, 0])
def test_cycles_with_long_tails(spark, monkeypatch, small):
    """A planted cycle with a tail before and behind it, two cycles in one colour, a self-loop; then random graphs."""
    monkeypatch.setattr(graph, "SMALL_REST", small)
    ring = [(i, i % 5 + 1) for i in range(1, 6)]
    tail = [(5, 10)] + [(i, i + 1) for i in range(10, 16)] + [(20, 21), (21, 22), (22, 1)]
    behind = [(16, 30), (30, 31), (31, 30)] + [(40, 40), (40, 41), (50, 51)]
    cases = [ring + tail + behind + ring[:2]]
    rng = random.Random(3)
    if not small:
        cases.append([(rng.randint(0, 25), rng.randint(0, 25)) for _ in range(34)])
    else:
        cases += [[(rng.randint(0, 40), rng.randint(0, 40)) for _ in range(n)] for n in (30, 50, 90)]
    for edges in cases:
        got = {r.node: r.component for r in graph.cycle_members(spark.createDataFrame(edges, "src int, dst int"), trims=1).collect()}
        assert got == on_cycles(edges)
    assert graph.cycle_members(spark.createDataFrame([], "src int, dst int")).count() == 0
    assert graph.cycle_members(spark.createDataFrame([(None, 1), (1, None), (1, 2)], "src int, dst int")).count() == 0


def test_document_set(spark):
    docs = [(1, 1, "Lease One", 1, 5, True, False), (1, 2, "Amendment", 2, 3, False, False), (1, 3, "Exhibit Z9", 3, 6, False, True), (1, 4, "Loose", 4, 6, False, False), (1, 5, None, 5, 1, False, False), (2, 6, "Lease One", 1, 5, True, False), (2, 7, "", 2, 5, False, True)]
    refs = [(1, 2, "see LEASE one, page 4", False), (1, 2, "Exhibit  z9 hereto", True), (1, 1, "exhibit q1", True), (1, 1, "the Lost Deed", False), (2, 6, "Exhibit z9", True), (2, 6, None, False), (2, 7, "", False)]
    d = spark.createDataFrame(docs, "grp int, id int, title string, seq int, d int, base boolean, exhibit boolean")
    r = spark.createDataFrame(refs, "grp int, id int, ref string, to_exhibit boolean")
    e = spark.createDataFrame([(2, 1), (1, 3), (3, 2), (5, 1)], "src int, dst int")
    got = {(x["grp"], x["ref"]): (x["target"], x["how"]) for x in graph.resolve_references(r, d, by="grp", ref="ref", id="id", title="title", ordinal="seq", is_exhibit=d["exhibit"]).collect()}
    assert got == {(1, refs[0][2]): (1, "title"), (1, refs[1][2]): (3, "exhibit"), (1, "exhibit q1"): (None, None), (1, "the Lost Deed"): (None, None), (2, "Exhibit z9"): (None, None), (2, None): (None, None), (2, ""): (None, None)}
    issues = graph.docset_audit(d, e, r, by="grp", id="id", title="title", ordinal="seq", date="d", is_base="base", is_exhibit="exhibit", ref="ref", to_exhibit="to_exhibit").collect()
    assert {(x.issue, x.id, x.detail) for x in issues} == {
        ("orphan", 4, None), ("orphan", 7, None), ("dated_before_target", 2, None), ("dated_before_target", 1, None), ("dated_before_target", 5, None),
        ("on_cycle", 1, "1"), ("on_cycle", 2, "1"), ("on_cycle", 3, "1"), ("missing_exhibit", 1, "exhibit q1"), ("unresolved_reference", 1, "the Lost Deed"), ("missing_exhibit", 6, "Exhibit z9"), ("unresolved_reference", 6, None), ("unresolved_reference", 7, ""),
    }
    assert len(issues) == 13


def score(edges, of):
    m = len(edges)
    degree = {}
    for a, b in edges:
        degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
    inside, total = {}, {}
    for a, b in edges:
        inside[of[a]] = inside.get(of[a], 0) + (of[a] == of[b])
    for n, k in degree.items():
        total[of[n]] = total.get(of[n], 0) + k
    return sum(inside.get(c, 0) / m - (k / 2 / m) ** 2 for c, k in total.items())


def test_modularity_never_falls(spark):
    rng = random.Random(5)
    edges = {(a, b) for g in range(4) for a in range(g * 8, g * 8 + 8) for b in range(a + 1, g * 8 + 8) if rng.random() < 0.7} | {(0, 8), (9, 17), (18, 25)}
    df = spark.createDataFrame([*edges, (3, 3), *[(b, a) for a, b in list(edges)[:5]]], "src int, dst int")
    found, scores = graph.refined_communities(df, rounds=12)
    of = {r.node: r.community for r in found.collect()}
    assert set(of) == {n for e in edges for n in e}
    assert all(a < b for a, b in zip(scores, scores[1:], strict=False)) and scores[-1] > 0.5
    row = graph.modularity(df, found).first()
    assert row.n_communities == len(set(of.values())) and row.modularity == pytest.approx(score(edges, of)) == pytest.approx(scores[-1])
    assert graph.modularity(df.limit(0), found.limit(0)).first().modularity == 0


def test_reading_positions(spark):
    e = [(1, 2), (1, 3), (2, 4), (3, 4), (5, 6), (6, 5), (6, 7), (7, 8)]
    got = {r.node: (r.level, r.place) for r in graph.reading_positions(spark.createDataFrame(e, "src int, dst int")).collect()}
    assert got == {1: (0, 1), 2: (1, 1), 3: (1, 2), 4: (2, 1), 8: (-1, 1), 5: (-1, 2), 7: (-1, 3), 6: (-1, 4)}


def test_rejected_changes(spark):
    rng = random.Random(7)
    base = [(1, "a", "x"), (1, "b", "y"), (2, "a", None)]
    log = [(rng.randint(1, 2), rng.choice("abc"), i, f"v{i}" if i % 7 else None, rng.choice(["add", "modify", "modify", "remove", "other"])) for i in range(80)]
    live, state, want, numbers = {(b, k) for b, k, _ in base}, {(b, k): v for b, k, v in base}, {}, {}
    for b, k, i, v, kind in log:
        key = (b, k)
        ok = kind == "add" or kind in ("modify", "remove") and key in live
        numbers[key] = numbers.get(key, 0) + ok
        want[i] = (ok, state.get(key) if key in live else None, numbers[key] if ok else None)
        if ok and kind == "remove":
            live.discard(key)
        elif ok:
            live.add(key)
            state[key] = v
    b = spark.createDataFrame(base, "b int, k string, v string")
    c = spark.createDataFrame(log, "b int, k string, n int, v string, kind string")
    options = dict(keys=["b", "k"], kind="kind", value="v", order=["n"])
    assert {r.n: (r.applied, r.old_value, r.change_no) for r in changelog.applied_changes(b, c, **options).collect()} == want
    assert {(r.b, r.k): (r.v, r.n_changes) for r in changelog.state_after(b, c, **options).collect()} == {key: (state[key], numbers.get(key, 0)) for key in live}


def test_missing_by_words(spark):
    clauses = [(1, "Rent_data", "Monthly.", None, "x"), (1, "other", "The tenant shall INSURE it", None, "x"), (2, "use", None, '{"note": "hours of opening"}', "y"), (2, None, None, None, "y"), (3, "premises_clause", "", None, None)]
    essential = [(None, "Rent", "payment"), (None, "insurance", "insure"), ("y", "hours", "hours"), ("y", "parking", "garage"), (None, "premises", "")]
    df = spark.createDataFrame(clauses, "doc int, k string, content string, data string, kind string")
    words = spark.createDataFrame(essential, "kind string, category string, keyword string")
    got = risks.missing_by_words(df, words, doc="doc", key="k", texts=["content", "data"], kind="kind").collect()
    assert sorted((r.doc, r.category) for r in got) == [(1, "premises"), (2, "insurance"), (2, "parking"), (2, "premises"), (2, "rent"), (3, "insurance"), (3, "rent")]
    assert risks.missing_by_words(df, words.limit(0), doc="doc", key="k", texts=["content"]).count() == 0
    with pytest.raises(ValueError):
        risks.missing_by_words(df, words, doc="doc", key="k", texts=["content"], most=2)
