"""Headings that overlap, mixed numbers, paths and paragraphs against plain versions."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from sedge.functions.catalogues import HEADINGS
from sedge.functions.rules import Rule, RuleSet
from sedge.operators import segment


def kept_plainly(candidates):
    kept = []
    for c in sorted(candidates, key=lambda c: (c[0], c[2], c[3], c[1])):
        met = [k for k in kept if (min(c[1], k[1]) - max(c[0], k[0])) / (c[1] - c[0]) > 0.5]
        if all(k[2] < c[2] for k in met):
            kept = [k for k in kept if k not in met] + [c]
    return sorted(kept)


def test_overlapping_candidates(spark):
    rng = random.Random(4)
    rows = []
    for doc in range(30):
        seen = set()
        for o in range(12):
            a = rng.randint(0, 40)
            seen.add((a, a + rng.randint(1, 15), rng.randint(1, 3), o))
        rows += [(doc, *c) for c in seen]
    df = spark.createDataFrame(rows, "doc_id int, char_start long, char_end long, level int, ordinal int")
    got = {}
    for r in segment.drop_overlapping(df).collect():
        got.setdefault(r.doc_id, []).append((r.char_start, r.char_end, r.level, r.ordinal))
    assert {d: sorted(v) for d, v in got.items()} == {d: kept_plainly([r[1:] for r in rows if r[0] == d]) for d in range(30)}
    assert segment.drop_overlapping(df.limit(0)).count() == 0


def test_built_in_headings_over_line_ends(spark):
    text = "ARTICLE IV\nTerm and rent\n\n4.1 Rent due\nIt is due.\n(a) Late payment\nText.\nGENERAL PROVISIONS\nSection 7 Notices\nplain line"
    rules = RuleSet([Rule("h", p, float(level)) for p, level in HEADINGS])
    wide = segment.headings(segment.line_windows(segment.lines(spark.createDataFrame([(1, text)], "doc_id int, text string"))), rules)
    found = sorted((r.char_start, text[r.char_start : r.char_end], r.level) for r in segment.drop_overlapping(wide.select("doc_id", "char_start", "char_end", "level", "ordinal")).collect())
    assert [(t, n) for _, t, n in found] == [("ARTICLE IV\nTerm and rent", 1), ("4.1 Rent due", 2), ("(a) Late payment", 3), ("GENERAL PROVISIONS", 2), ("Section 7 Notices", 2)]


def outline_plainly(headings):
    """[(parent, path, is_child, orphan)] of (style, number, key) in order."""
    stack, out = [], []
    for i, (style, number, key) in enumerate(headings):
        if style is None:
            out.append((None, [], False, False))
            continue
        for j, (_, s, _, k) in enumerate(stack):
            if s == style and (style != "dotted" or len(k) >= len(key) or key[: len(k)] != k):
                stack = stack[:j]
                break
        parent = stack[-1] if stack else None
        child = bool(parent) and (style == "dotted" and parent[1] == "dotted" and number.rpartition(".")[0] == parent[2] or parent[2] in "0123456789" and len(number) == 1 and number.isalpha())
        orphan = style == "dotted" and len(key) > 1 and not (parent and parent[1] == "dotted" and len(parent[3]) + 1 == len(key))
        out.append((parent and parent[0], [s[0] for s in stack], child, orphan))
        stack.append((i, style, number, key))
    return out


def test_outline_of_mixed_numbers(spark):
    lines = ["ARTICLE IV - Term", "1. Rent", "1.1 Due", "(a) early", "(b) late", "1.2 Where", "(a) here", "2. Use", "A. Shops", "2.1.3 Deep", "General", "ARTICLE V", "Section 2.1 Again", "(c) end", "3", "B) x", "4.1", "4.1.1 y", "4.2"]
    rng = random.Random(8)
    docs = [lines, *[rng.choices(lines, k=14) for _ in range(25)]]
    df = spark.createDataFrame([(d, n, line) for d, ls in enumerate(docs) for n, line in enumerate(ls)], "doc int, n int, line string")
    numbered = segment.heading_numbers(df, heading="line")
    parts = {(r.doc, r.n): (r.style, r.number, tuple(r.sort_key) if r.sort_key else None) for r in numbered.collect()}
    assert parts[0, 0] == ("roman", "IV", (4,)) and parts[0, 9] == ("dotted", "2.1.3", (2, 1, 3)) and parts[0, 10] == (None, None, None) and parts[0, 13] == ("lower", "c", (3,)) and parts[0, 8] == ("upper", "A", (1,))
    got = {(r.doc, r.n): (r.parent_pos, list(r.path), r.is_child, r.orphan) for r in segment.number_outline(numbered, id="doc", pos="n").collect()}
    for d, ls in enumerate(docs):
        for n, want in enumerate(outline_plainly([parts[d, n] for n in range(len(ls))])):
            assert got[d, n] == want
    assert got[0, 4] == (2, [0, 1, 2], False, False) and got[0, 9][3] and got[0, 8] == (7, [0, 7], True, False)


def test_paths_and_paragraphs(spark):
    levels = [2, 1, 3, 2, 3, 3, 1, 3, 2]
    rows = spark.createDataFrame([(1, i * 10, k) for i, k in enumerate(levels)], "doc_id int, char_start long, level int")
    path = {r.char_start: list(r.path) for r in segment.ancestor_paths(rows).collect()}
    assert path == {0: [], 10: [], 20: [10], 30: [10], 40: [10, 30], 50: [10, 30], 60: [], 70: [60], 80: [60]}
    long = "word " * 12
    texts = [(1, f"  {long}\n{long}\n\nshort\n \t\n{long}\n\n{long}x\n"), (2, f"{long}\n\n{long}"), (3, ""), (4, None)]
    df = spark.createDataFrame(texts, "doc_id int, text string")
    got = segment.paragraph_rows(df).collect()
    of = dict(texts)
    assert all(of[r.doc_id][r.char_start : r.char_end] == r.content for r in got)
    assert [(r.chunk_id, r.content[-6:]) for r in sorted(got, key=lambda r: r.char_start) if r.doc_id == 1] == [("F-001", "d word"), ("F-002", "d word"), ("F-003", "word x")]
    assert [(r.doc_id, r.content) for r in got if r.doc_id in (2, 3, 4)] == [(2, of[2]), (3, "")]
    parts = spark.createDataFrame([("4", "4.1"), ("4", "4.1.1"), ("4.1", "4.1.1"), ("4", "41"), ("4", "a"), ("12", "a"), ("a", "b"), (None, "1")], "p string, c string")
    assert [r.x for r in parts.select(segment.is_child(F.col("p"), F.col("c")).alias("x")).collect()] == [True, False, True, False, True, False, False, False]


def test_outline_takes_no_python_call_per_document(spark):
    rows = [(d, n, h) for d in range(3000) for n, h in enumerate(("1. Rent", "1.1 Due", "(a) late", "words"))]
    found = segment.number_outline(segment.heading_numbers(spark.createDataFrame(rows, "doc int, n int, heading string"), heading="heading"), id="doc", pos="n")
    assert "FlatMapGroups" not in found._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)  # documents cross batches
    try:
        got = {tuple((r.n, r.parent_pos, *r.path) for r in found.filter(f"doc = {d}").orderBy("n").collect()) for d in (0, 1, 2999)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {((0, None), (1, 0, 0), (2, 1, 0, 1), (3, None))}
