"""Operators against plain versions, and the cases that the driver tables do not hold."""

from __future__ import annotations

import json
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

WORDS = "alpha beta gamma delta omega rent clause lease notice tenant owner".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_containment_join_beyond_the_broadcast_bound(spark):
    from sedge.functions.joins import containment_join

    rng = random.Random(1)
    texts = [(i, prose(rng, 12)) for i in range(60)] + [(100, None), (101, "")]
    phrases = [(i, prose(rng, 2)) for i in range(40)] + [(50, "beta"), (51, ""), (52, None), (53, "rent")]
    left = spark.createDataFrame(texts, "id int, text string")
    right = spark.createDataFrame(phrases, "phrase_id int, phrase string")
    want = {(i, j) for i, t in texts for j, p in phrases if t and p and p in t}
    for limit in (1000, 5, 1):
        got = [(r.id, r.phrase_id) for r in containment_join(left, right, text="text", phrase="phrase", limit=limit).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    left, right = left.withColumn("half", F.col("id") % 2), right.withColumn("half", F.col("phrase_id") % 2)
    for limit in (1000, 1):
        got = [(r.id, r.phrase_id) for r in containment_join(left, right, text="text", phrase="phrase", by=["half"], limit=limit).collect()]
        assert sorted(got) == sorted((i, j) for i, j in want if i % 2 == j % 2)


@pytest.mark.parametrize("accuracy", [50, 10_000])
def test_percentiles(spark, accuracy):
    from sedge.functions.joins import percentiles

    rng = np.random.default_rng(2)
    rows = [(g, float(x)) for g, n in (("a", 1), ("b", 2), ("c", 700), ("d", 3000)) for x in np.round(rng.exponential(5, n), 1)] + [("e", None), ("a", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    for p in (0.0, 0.1, 0.5, 0.95, 1.0):
        got = {r.g: r.percentile for r in percentiles(df, by=["g"], value="x", p=p, accuracy=accuracy).collect()}
        for g in "abcd":
            assert got[g] == pytest.approx(np.quantile([x for h, x in rows if h == g and x is not None], p))
        assert "e" not in got
        assert percentiles(df, by=[], value="x", p=p, accuracy=accuracy).first().percentile == pytest.approx(np.quantile([x for _, x in rows if x is not None], p))


def test_packed_chunks_keep_every_character(spark):
    from sedge.operators.segment import pack_paragraphs

    rng = random.Random(3)
    texts = [(i, "\n".join(prose(rng, rng.randint(0, 40)) for _ in range(rng.randint(1, 60)))) for i in range(30)] + [(90, None), (91, ""), (92, "é" * 5000)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    out = {}
    for r in pack_paragraphs(df, target=300, most=600, small=60).collect():
        out.setdefault(r.doc_id, []).append(r)
    assert 90 not in out and out[91][0].content == ""
    for i, text in texts:
        if text is not None:
            chunks = sorted(out[i], key=lambda r: r.chunk_no)
            assert "\n".join(r.content for r in chunks) == text and all(text[r.char_start : r.char_end] == r.content for r in chunks)
            assert all(r.n_chars == len(r.content.replace("\n", "")) for r in chunks)
            assert all(r.n_chars <= 600 or "\n" not in r.content for r in chunks)


def test_semantic_chunks_and_another_embedding(spark):
    from sedge.operators.segment import semantic_chunks

    def close(a, b):
        ca, cb = (Counter(x.lower()[i : i + 3] for i in range(len(x) - 2)) for x in (a, b))
        norm = (sum(v * v for v in ca.values()) * sum(v * v for v in cb.values())) ** 0.5
        return sum(ca[k] * cb[k] for k in ca) / norm if norm else 0.0

    def plain(parts, near, below, target):
        out, begin, size = [], 0, 0
        for i, p in enumerate(parts):
            if i > begin and (near(parts[i - 1], p) < below and size > target / 2 or size > target):
                out.append((begin, i))
                begin, size = i, 0
            size += len(p)
        return [*out, (begin, len(parts))]

    rng = random.Random(4)
    docs = {i: [prose(rng, rng.randint(1, 9)) for _ in range(rng.randint(1, 30))] for i in range(12)}
    rows = [(i, n, s) for i, parts in docs.items() for n, s in enumerate(parts)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id int, sent_no int, sentence string")
    from sedge.functions.embedding import trigram_embed

    for embed, near in ((lambda texts: trigram_embed(texts, 1 << 16), close), (lambda texts: np.array([[len(x) % 2, 1 - len(x) % 2] for x in texts]), lambda a, b: float(len(a) % 2 == len(b) % 2))):
        got = {}
        for r in semantic_chunks(df, id="doc_id", order="sent_no", text="sentence", close_below=0.5, target=120, embed=embed).collect():
            got.setdefault(r.doc_id, []).append((r.first, r.last + 1, r.content))
        for i, parts in docs.items():
            assert sorted(got[i]) == [(a, b, " ".join(parts[a:b])) for a, b in plain(parts, near, 0.5, 120)]


def test_trigram_vectors(spark):
    """Cosines of the hashed vectors equal those of the plain trigram counts where no two trigrams share a slot."""
    from sedge.functions.embedding import embedded, trigram_embed
    from sedge.operators.similarity import trigram_vectors

    texts = [(1, "The rent is due"), (2, "the RENT was due"), (3, "zz"), (4, "")]
    df = spark.createDataFrame(texts, "id long, text string")
    counts = {i: Counter(t.lower()[k : k + 3] for k in range(len(t) - 2)) for i, t in texts}
    want = sum(counts[1][k] * counts[2][k] for k in counts[1]) / (sum(v * v for v in counts[1].values()) * sum(v * v for v in counts[2].values())) ** 0.5
    by_sql = {r.id: np.array(r.v) for r in trigram_vectors(df, id="id", text="text", dim=4096).collect()}
    assert set(by_sql) == {1, 2} and np.linalg.norm(by_sql[1]) == pytest.approx(1) and by_sql[1] @ by_sql[2] == pytest.approx(want, abs=0.05)
    by_hook = {r.id: np.array(r.v) for r in df.select("id", embedded(F.col("text"), lambda xs: trigram_embed(xs, 4096)).alias("v")).collect()}
    assert by_hook[1] @ by_hook[2] == pytest.approx(want, abs=0.05) and not by_hook[3].any()
    assert len(df.select(embedded(F.col("text")).alias("v")).first().v) == 384
    twice = df.select(embedded(F.col("text"), lambda xs: [[float(len(x))] for x in xs]).alias("v"))
    assert [r.v for r in twice.collect()] == [[15.0], [16.0], [2.0], [0.0]]


def test_leaders_absorb_their_neighbours(spark, sf_dir):
    """standard_clauses by its definition."""
    from sedge.plans.catalogue import QUERIES

    rows = [(r.vec_id, np.array(r.embedding, float)) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    unit = {i: v / np.linalg.norm(v) for i, v in rows}
    free, groups = set(unit), {}
    for i in sorted(unit):
        if i in free:
            groups[i] = [i] + [j for j in sorted(free) if j > i and round(float(unit[i] @ unit[j]), 6) >= 0.3]
            free -= set(groups[i])
    want = {(lead, i) for lead, ids in groups.items() if len(ids) >= 3 and len({i % 20 for i in ids}) >= 3 for i in ids}
    assert {(r.leader, r.id) for r in QUERIES["standard_clauses"](spark, sf_dir).select("leader", "id").collect()} == want


def test_label_propagation(spark):
    from sedge.operators.graph import label_propagation

    rng = random.Random(6)
    edges = {(rng.randrange(40), rng.randrange(40)) for _ in range(70)}
    got = {r.node: r.community for r in label_propagation(spark.createDataFrame(sorted(edges), "src int, dst int"), rounds=3).collect()}
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    label = {n: n for n in near}
    for _ in range(3):
        votes = {n: Counter(label[m] for m in near[n]) for n in near}
        label = {n: min(v, key=lambda c: (-v[c], c)) for n, v in votes.items()}
    assert got == label


def test_essential_kinds_beyond_the_limit_are_refused(spark):
    from sedge.operators.risks import missing

    rows = spark.createDataFrame([("d", "k1"), ("e", "k7")], "doc string, kind string")
    wanted = spark.createDataFrame([(f"k{i}",) for i in range(1200)], "kind string")
    assert missing(rows, wanted, doc="doc", kind="kind").count() == 2 * 1200 - 2
    with pytest.raises(ValueError, match="more than 1000"):
        missing(rows, wanted, doc="doc", kind="kind", most=1000)
    assert missing(rows, wanted.limit(0), doc="doc", kind="kind").count() == 0


def test_streams_go_on_from_their_root(spark, tmp_path):
    from sedge.streaming import streams

    def put(name, rows):
        spark.createDataFrame(rows, "id int, ts timestamp_ntz").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    import datetime as dt

    day = lambda d, h=0: dt.datetime(2024, 1, d, h)
    root = str(tmp_path / "root")
    put("a", [(1, day(1)), (2, day(5))])
    read = lambda: streams.read_stream(spark, str(tmp_path / "in"))
    first = streams.late_rows(read(), ts="ts", delay_s=86_400, name="late", root=root)
    assert {r.id: r.late for r in first.collect()} == {1: False, 2: False}
    put("b", [(3, day(2)), (4, day(4, 1)), (5, day(6))])
    again = streams.late_rows(read(), ts="ts", delay_s=86_400, name="late", root=root)
    assert {r.id: r.late for r in again.collect()} == {1: False, 2: False, 3: True, 4: False, 5: False}


def test_markdown_tables_and_copies(spark):
    from sedge.operators import segment, texttables

    text = "a | b\nx\n| h1 | h2 |\n|:--|--:|\n| 1 | 2 |\n| 3 | |\n| --- | --- |\n\n| only | head |\n|---|---|\nend"
    df = spark.createDataFrame([("d", text), ("n", None)], "doc_id string, text string")
    out = texttables.markdown_blocks(segment.lines(df), id="doc_id").orderBy("line_no").collect()
    assert [(r.block_no, r.row_no, r.line_no, list(r["values"])) for r in out] == [(1, 0, 2, ["h1", "h2"]), (1, 1, 4, ["1", "2"]), (1, 2, 6, ["---", "---"])]
    twice = "p|q\n1|2\n\np|q\n1|2\n\np|q\n1|3"
    cells = texttables.cells(texttables.delimited_blocks(segment.lines(spark.createDataFrame([("d", twice)], "doc_id string, text string")), id="doc_id", least_lines=2), id="doc_id")
    assert sorted((r.block_no, r.n_copies) for r in texttables.dedup_tables(cells, id="doc_id").collect()) == [(1, 2), (3, 1)]


def test_dates_counts_and_pairs(spark):
    from sedge.functions.catalogues import PAIRS
    from sedge.operators import facts

    values = spark.createDataFrame([("3/4/25",), ("12/31/2030",), ("March 5, 2024",), ("2024-01-02",), ("Foo 5, 2024",), (None,)], "v string")
    assert [r.d for r in values.select(facts.iso_date(F.col("v")).alias("d")).collect()] == ["2025-03-04", "2030-12-31", "2024-03-05", "2024-01-02", "Foo 5, 2024", None]
    words = spark.createDataFrame([("Two",), ("7",), ("many",), (None,)], "v string")
    assert [r.n for r in words.select(facts.count_of(F.col("v")).alias("n")).collect()] == [2, 7, None, None]
    text = "5% of gross sales over $1,000 and 6% of gross sales above $2,000.50. If late, then pay. If early then wait."
    df = spark.createDataFrame([(1, text), (2, None)], "id int, text string")
    assert [(r[0], r[1]) for r in facts.extract_pairs(df, PAIRS["percentage_breaks"], id="id", text="text").select(F.col("first"), F.col("second")).collect()] == [("5", "1,000"), ("6", "2,000.50")]
    assert [(r[0], r[1]) for r in facts.extract_pairs(df, PAIRS["conditions"], id="id", text="text", names=("a", "b")).select("a", "b").collect()] == [("late", "pay"), ("early", "wait")]


def test_artifacts(spark, tmp_path):
    from sedge.sources import tables

    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "one.parquet"))
    found, missing = tables.read_artifacts(spark, str(tmp_path), expected=["one", "two"])
    assert [r.artifact for r in found.collect()] == ["one"] and [r.artifact for r in missing.collect()] == ["two"]


def test_ranks_converge(spark):
    from sedge.operators.graph import pagerank

    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (5, 1)]
    got = {r.node: r.rank for r in pagerank(spark.createDataFrame(edges, "src int, dst int"), rounds=200, tolerance=1e-9).collect()}
    out = {a: [b for x, b in edges if x == a] for a in range(1, 6)}
    rank = dict.fromkeys(range(1, 6), 0.2)
    for _ in range(300):
        loose = sum(rank[a] for a in out if not out[a])
        rank = {n: 0.15 / 5 + 0.85 * (sum(rank[a] / len(out[a]) for a in out if n in out[a]) + loose / 5) for n in rank}
    assert got == pytest.approx(rank, abs=1e-7)


def flat(v, path="", name=""):
    """Leaves of a parsed JSON value: (path, JSON text, whether the last name is a date's)."""
    if isinstance(v, dict) and v:
        return [x for k, w in v.items() for x in flat(w, f"{path}.{k}" if path else k, k)]
    if isinstance(v, list) and v:
        return [x for i, w in enumerate(v) for x in flat(w, f"{path}[{i}]", name)]
    return [(path, json.dumps(v, separators=(",", ":")), any(w in name.lower() for w in ("date", "deadline", "expir", "commenc")))] if path else []


def test_leaves_at_any_depth(spark):
    from sedge.operators import checks

    deep = {"v": 1}
    for i in range(12):
        deep = {f"level{i}": [deep, i]}
    docs = [{"a": 1, "b": {"c": {"startDate": "x", "d": [1, {"Expiry": None}, [], {}]}}, "e": [], "f": {}, "g": None, "h": ""}, [1, [2, {"date": [3]}]], deep, {}, [], 5, None, "text"]
    rows = [(i, json.dumps(d)) for i, d in enumerate(docs)] + [(20, "{cut"), (21, None), (22, "")]
    got = sorted(tuple(r) for r in checks.flatten_json(spark.createDataFrame(rows, "path long, value string"), id="path", json="value").toDF("id", "path", "value", "is_date_key").collect())
    assert got == sorted((i, *leaf) for i, d in enumerate(docs) for leaf in flat(d))
    assert checks.flatten_json(spark.createDataFrame([], "id long, j string"), id="id", json="j").count() == 0


def corrected_plainly(text, fixes):
    """(text, skipped, spans) by a mark per character: None for untouched, else the number of the change that made it; zero-length changes stand between."""
    pieces, skipped = [(text, False)], 0
    for _, old, new in sorted((o, a or "", b or "") for o, a, b in fixes):
        if not old:
            continue
        was, hits, out = "".join(p for p, _ in pieces), 0, []
        for p, changed in pieces:
            at = -1 if changed else p.find(old)
            start = 0
            while at >= 0:
                out += [(p[start:at], False), (new, True)]
                hits, start = hits + 1, at + len(old)
                at = p.find(old, start)
            out.append((p[start:], changed))
        pieces = out
        skipped += old in was and not hits
    spans, at = [], 0
    for p, changed in pieces:
        if changed:
            spans.append((at, at + len(p)))
        at += len(p)
    return "".join(p for p, _ in pieces), skipped, spans


def test_corrections_leave_changed_text_alone(spark):
    from sedge.operators import insights

    rng = random.Random(2)
    cases = [("one two three", [(1, "two", "2 two"), (2, "two", "no"), (3, "ne 2", "x"), (4, "thr", "")]), ("abcabc", [(1, "b", ""), (2, "ac", "x"), (3, "ca", "y"), (4, "a", "\\E.\\Q$1")]), ("a.b*c\\E", [(1, ".", "*"), (2, "*", "+"), (3, "\\E", "e")]), ("same", [(1, "x", "y")]), ("null", [(1, None, "a"), (2, "l", None), (2, "", "b")])]
    cases += [("".join(rng.choice("abc") for _ in range(30)), [(rng.randint(0, 5), "".join(rng.choice("abc") for _ in range(rng.randint(1, 3))), "".join(rng.choice("abcd") for _ in range(rng.randint(0, 3)))) for _ in range(6)]) for _ in range(60)]
    texts = spark.createDataFrame([*[(i, t) for i, (t, _) in enumerate(cases)], (900, None), (901, "no corrections")], "id long, text string")
    fixes = spark.createDataFrame([(i, *f) for i, (_, fs) in enumerate(cases) for f in fs] + [(900, 1, "a", "b")], "id long, n int, old string, new string")
    got = {r["id"]: r for r in insights.apply_corrections(texts, doc="id", text="text", corrections=fixes, order="n", old="old", new="new").collect()}
    for i, (t, fs) in enumerate(cases):
        want, skipped, spans = corrected_plainly(t, fs)
        assert (i in got) == (want != t)
        if i in got:
            assert (got[i].corrected, got[i].n_skipped, [tuple(s) for s in got[i].spans]) == (want, skipped, spans)
            assert got[i].n_corrections == len(fs) and got[i].latest == max(f[0] for f in fs)
    assert not {900, 901} & set(got)


def test_a_key_comes_again_after_its_life(spark, tmp_path):
    from sedge.streaming import streams

    batches = [[(1, "a", "02 00:00"), (2, "a", "02 01:59"), (3, "a", "02 02:00"), (4, "b", "02 00:30")], [(5, "a", "02 03:59"), (6, "a", "02 04:00"), (7, "b", "02 00:10"), (8, "a", "01 23:00")], [(9, "b", "02 09:00"), (10, "a", "02 12:00"), (11, "a", "02 04:30")]]
    path = str(tmp_path / "in")
    for i, rows in enumerate(batches):
        spark.createDataFrame([(n, k, f"2024-01-{at}") for n, k, at in rows], "id long, k string, at string").select("id", "k", F.to_timestamp("at").alias("ts")).coalesce(1).write.parquet(f"{path}/part={i}")
        time.sleep(1.1)
    stream = spark.readStream.schema("id long, k string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{path}/*")
    out = streams.run(streams.first_within(streams.with_time(stream, "ts", "12 hours"), keys=["k"], ts="ts", id="id", life_s=7200), mode="append", name="life")
    assert sorted(r["id"] for r in out.collect()) == [1, 3, 4, 6, 8, 9, 10]  # 7 and 11 lie within the life of 4 and 6, 8 lies long before 6


def test_repeats_take_no_python_call_per_key(spark, tmp_path):
    from sedge.streaming import streams

    for i in range(4):  # 4,000 keys in each of four batches, an hour apart
        rows = spark.range(4000).select("id", (F.col("id") % 7).alias("j"), (F.lit(f"2024-01-01 0{i}:00").cast("timestamp")).alias("ts"))
        rows.coalesce(1).write.parquet(f"{tmp_path}/in/part={i}")
        time.sleep(1.1)
    stream = spark.readStream.schema("id long, j long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    kept = streams.first_within(streams.with_time(stream, "ts", "1 hour"), keys=["id"], ts="ts", id="j", life_s=7200)
    assert "FlatMapGroups" not in kept._jdf.queryExecution().analyzed().toString()
    out = streams.run(kept, mode="append", name="life", root=f"{tmp_path}/root")
    assert sorted((r.h, r["count"]) for r in out.groupBy(F.hour("ts").alias("h")).count().collect()) == [(0, 4000), (2, 4000)]
    states = spark.read.parquet(f"{tmp_path}/root/fold").filter("NOT _new").groupBy("batch").count().collect()
    assert sorted(r["count"] for r in states) == [4000, 4000]  # states older than a batch ago are gone


def test_tables_of_whole_texts_need_no_shuffle(spark):
    from sedge.operators import segment, texttables

    rng = random.Random(5)
    texts = [(i, "\n".join(rng.choice(["a|b", "c|d", "a\tb", "a|b\tc", "x", "", "|", "a|b|c"]) for _ in range(rng.randint(1, 25)))) for i in range(80)] + [(90, None), (91, "")]
    df = spark.createDataFrame(texts, "id int, text string")
    found = texttables.text_blocks(df, id="id", least_lines=2)
    plan = texttables.cells(found, id="id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan and "Window" not in plan
    assert plan.count("split(text#") <= 2  # lambdas read the columns, not their expressions
    want = []
    for i, text in texts:
        kinds = [("\t", x.count("\t")) if "\t" in x else ("|", x.count("|")) if "|" in x else None for x in (text or "").split("\n")]
        starts = [j for j, k in enumerate(kinds) if j == 0 or k != kinds[j - 1]] + [len(kinds)]
        runs = [(a, b) for a, b in zip(starts, starts[1:], strict=False) if kinds[a] and b - a >= 2]
        want += [(i, no, at - a, at, text.split("\n")[at], kinds[a][0], text.split("\n")[a]) for no, (a, b) in enumerate(runs, 1) for at in range(a, b)]
    assert sorted(map(tuple, found.collect())) == want
    assert sorted(map(tuple, texttables.delimited_blocks(segment.lines(df, id="id"), id="id", least_lines=2).collect())) == want
    spaced = texttables.type_score(spark.createDataFrame([(1, 1, 1, 0, "cost", "v"), (1, 1, 1, 1, "share", "w")], "id int, block_no int, row_no int, col_no int, header string, value string"), [("k", ("cost share", "cost"), ("w", "none"))], id="id")
    assert spaced.first()["score"] == 0.8


def test_history_goes_on_over_batches(spark, tmp_path):
    from sedge.streaming import streams

    batches = [[(1, "a", "x"), (2, "a", "x"), (3, "b", None)], [(4, "a", "x"), (5, "a", "y"), (6, "b", None)], [(7, "c", "z")], [(8, "a", "x"), (9, "b", "x"), (10, "b", None)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame([(n, "g", k, v) for n, k, v in rows], "n long, g string, k string, v string").coalesce(1).write.parquet(f"{tmp_path}/in/part={i}")
        time.sleep(1.1)
    stream = spark.readStream.schema("n long, g string, k string, v string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    history = streams.change_history(stream, base="g", key="k", value="v", order="n")
    assert "TransformWithState" not in history._jdf.queryExecution().analyzed().toString()
    out = streams.run(history, mode="append", name="history")
    got = sorted((r.n, r.k, r.change_no, r.old_value, r.new_value) for r in out.collect())
    assert got == [(1, "a", 1, None, "x"), (3, "b", 1, None, None), (5, "a", 2, "x", "y"), (7, "c", 1, None, "z"), (8, "a", 3, "y", "x"), (9, "b", 2, None, "x"), (10, "b", 3, "x", None)]


def test_trigrams_are_counted_where_the_text_is(spark):
    from sedge.operators.similarity import trigram_counts

    texts = [(1, "Ab ab ab"), (2, "zz"), (3, None), (4, "é𝄞xé𝄞x"), (5, "q" * 5000)]
    counts = trigram_counts(spark.createDataFrame(texts, "k long, t string"), id="k", text="t", dim=4096)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Exchange" not in plan  # no row per trigram, nothing shuffled
    got = {}
    for r in counts.collect():
        got.setdefault(r.k, []).append(r.n)
    assert {k: sorted(v) for k, v in got.items()} == {1: [2, 2, 2], 4: [1, 1, 2], 5: [4998]}
