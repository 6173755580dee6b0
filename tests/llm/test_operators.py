from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import brute

DOC = "doc_id long, text string, lang string, source string, n_chars long, kept string, ID string"
WORDS = [a + b + c for a in "bdfgklmnprst" for b in "aeiou" for c in ("n", "r", "st", "l")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "x", "y") for i, t, s in rows], DOC)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def odd_rows():
    rng = random.Random(3)
    long = prose(rng, 6000)
    return [(1, None, "a"), (2, "", None), (3, "  \n \t", "a"), (4, "Same text here\nfor all", "b"), (5, "Same text here\nfor all", None), (5, "Same text here\nfor all", None), (6, long, "b"), (7, long + " tail", "b"), (8, "ÉÀ é à \U0001f600", ""), (None, "Same text here\nfor all", "c"), (9, "one", "c")]


def written_docs(spark, rows, tmp_path):
    path = str(tmp_path / "documents.parquet")
    frame(spark, rows).repartition(3).write.parquet(path)
    return path


def test_exact_dedup(spark, odd_rows, tmp_path):
    from sedge.llm.exact_dedup import exact_dedup

    out = exact_dedup(spark, written_docs(spark, odd_rows, tmp_path)).collect()
    assert len(out) == len(odd_rows)
    by = {}
    for i, t, _ in odd_rows:
        by.setdefault(t or "", []).append(i)
    for r in out:
        text = next(t for t in by if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        assert r.group_size == len(by[text]) and r.keep_id == max(i for i in by[text] if i is not None)
    assert sum(r.kept for r in out) == len(by)
    assert exact_dedup(spark, written_docs(spark, [], tmp_path / "empty")).count() == 0


def test_exact_dedup_goes_on_from_its_state(spark, tmp_path):
    from sedge.llm.exact_dedup import exact_dedup

    path, state = str(tmp_path / "d.parquet"), str(tmp_path / "state")
    frame(spark, [(1, "a", "s"), (2, "b", "s")]).coalesce(1).write.parquet(path)
    exact_dedup(spark, path, checkpoint=state).collect()
    frame(spark, [(3, "a", "s")]).coalesce(1).write.mode("append").parquet(path)
    out = {r.id: (r.keep_id, r.group_size) for r in exact_dedup(spark, path, checkpoint=state, max_files=1).collect()}
    assert out == {1: (3, 2), 2: (2, 1), 3: (3, 2)}


def test_near_duplicates_odd_rows(spark, odd_rows):
    from sedge.llm.near_dedup import deduplicated, near_duplicates

    out = near_duplicates(frame(spark, odd_rows)).collect()
    want = brute.near_components([(i, t) for i, t, _ in odd_rows if i is not None])
    assert len(out) == len(odd_rows)
    for r in out:
        if r.id is not None:
            assert (r.n_shingles, r.component_id) == want[r.id]
            assert r.kept == (r.id == r.component_id)
    kept = [r.doc_id for r in deduplicated(frame(spark, odd_rows)).collect()]
    assert sorted(x for x in kept if x is not None) == [1, 2, 3, 4, 6, 8, 9]
    assert near_duplicates(frame(spark, [])).count() == 0


def test_near_duplicates_of_many_edited_copies(spark):
    """Copies near the threshold, in one large list: what hubs leave must still be linked right."""
    from sedge.llm.near_dedup import near_duplicates

    rng = random.Random(5)
    rows = []
    for base in range(3):
        text = prose(rng, 120).split(" ")
        for _ in range(70):
            copy = list(text)
            for at in rng.sample(range(len(copy)), rng.randint(0, 7)):
                copy[at] = rng.choice(WORDS)
            rows.append((len(rows), " ".join(copy), "s"))
    passage = prose(rng, 60)
    rows += [(1000 + i, passage + " " + prose(rng, rng.randint(5, 60)), "s") for i in range(60)]
    rng.shuffle(rows)
    got = {r.id: (r.n_shingles, r.component_id) for r in near_duplicates(frame(spark, rows)).collect()}
    assert got == brute.near_components([(i, t) for i, t, _ in rows])


def test_near_duplicates_of_whole_and_cut_sketches(spark):
    """Cuttings of 118-128 shingles, retained whole, out of texts of 150-170, of which a part is retained."""
    from sedge.llm.near_dedup import near_duplicates

    rng = random.Random(9)
    rows = []
    for n, m in [(128, 170), (126, 168), (124, 165), (121, 160), (118, 150), (118, 158)] * 25:
        text = prose(rng, m + 4).split(" ")
        at = rng.randint(0, m - n)
        rows += [(len(rows), " ".join(text), "s"), (len(rows) + 1, " ".join(text[at : at + n + 4]), "s")]
    got = {r.id: (r.n_shingles, r.component_id) for r in near_duplicates(frame(spark, rows)).collect()}
    assert got == brute.near_components([(i, t) for i, t, _ in rows])


def test_line_dedup(spark, odd_rows):
    from sedge.llm.line_dedup import line_dedup

    rng = random.Random(1)
    shared = [" Read MORE\there ", "read more\there", "ÉCOLE", "école", ""]
    rows = [(i, "\n".join(rng.choice([*shared, prose(rng, 3)]) for _ in range(rng.randint(0, 8))), "s") for i in range(60)] + [(i if i is None else 100 + i, t, s) for i, t, s in odd_rows]
    got = sorted(((r.doc_id, r.text) for r in line_dedup(frame(spark, rows), min_docs=4).collect()), key=str)
    assert got == sorted(brute.line_dedup([(i, t) for i, t, _ in rows], 4), key=str)
    out = line_dedup(frame(spark, rows))
    assert out.columns == [*frame(spark, []).columns, "n_lines", "n_dropped"]
    assert line_dedup(frame(spark, [])).count() == 0


def test_mixing(spark, odd_rows):
    from sedge.llm.mixing import mix, mix_plan

    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randint(0, 90)), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(1000)]
    out = mix_plan(frame(spark, rows)).collect()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t, _ in rows}
    total, sizes = sum(size.values()), {}
    for i, _, s in rows:
        sizes[s] = sizes.get(s, 0) + size[i]
    weights = dict(zip(sorted((s for s in sizes if s is not None)) + [None], [1, 2, 3, 1], strict=True))
    open_, target, left = set(sizes), {}, float(total)
    while open_:
        share = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if share * weights[s] >= 3 * sizes[s]}
        if not full:
            target |= {s: share * weights[s] for s in open_}
            break
        for s in full:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= full
    taken = {}
    for r in out:
        assert r.size == size[r.id] and r.target == pytest.approx(target[r.source]) and r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 0.01 * target[s] + 5
    again = {r.id: r.taken for r in mix_plan(frame(spark, rows[::-1])).collect()}
    assert again == {r.id: r.taken for r in out}
    mixed = mix(frame(spark, rows))
    assert mixed.columns == frame(spark, []).columns and mixed.count() == sum(r.copies for r in out)
    assert mix_plan(frame(spark, odd_rows)).count() == len(odd_rows)
    assert mix_plan(frame(spark, [])).count() == 0


def test_url_verdicts(spark):
    from sedge.llm.queries import URL_RULES
    from sedge.llm.url_filter import url_verdicts

    urls = ["HTTP://WWW.Example.COM/en/7?x=1", "http://a.example.com/en/8", "https://x.net/de/1#t", "http://b.example.net/de/81", "http://c.org/es/", "http://notorg/es/", None, "no scheme", "http://É.com/en/", "http://", "http://host?://x/y"]
    rows = [(i, u, None, "clash") for i, u in enumerate(urls)]
    rows += [(100 + i, f"http://bad.example.edu/spam/{i}.html", 1, "") for i in range(40)] + [(200 + i, f"http://bad.example.edu/news/{i}.html", 0, "") for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, bad int, host string")
    out = {r.id: r for r in url_verdicts(df, rules=URL_RULES).collect()}
    assert len(out) == len(rows)
    seen = [(out[i].host, out[i].path, out[i].rule, out[i].verdict) for i in range(len(urls))]
    assert seen[:6] == [("www.example.com", "/en/7", "example.com/en/7", "allow"), ("a.example.com", "/en/8", "com/en/", "block"), ("x.net", "/de/1", "net/de/", "allow"), ("b.example.net", "/de/81", "example.net/de/8", "block"), ("c.org", "/es/", "org/es/", "block"), ("notorg", "/es/", None, "allow")]
    assert [s[:2] for s in seen[6:]] == [("", ""), ("", ""), ("É.com", "/en/"), ("", ""), ("host", "")]
    assert out[100].verdict == "block" and out[200].verdict == "allow" and out[100].template == "/spam/*.html"
    assert url_verdicts(df.filter("false"), rules=URL_RULES).count() == 0


def fuzz_texts():
    rng = random.Random(1)
    letters = "abc's t'reX''  \n\t　é漢字1２½!!?.,'ll've-_ \U0001f600aaaa"
    plain = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    marked = ["x<|endoftext|>y <|endoftext|>", "<|startoftext|>A.", "a" * 3000, "'s't're'", " ", "\n\n a", "don't 's", "'sabc 'S", "%" * 4000, None, ""]
    return plain, marked


@pytest.mark.parametrize("part", [0, 1])
def test_tokenisers_agree_with_the_library(part):
    from tokenizers import Tokenizer

    from sedge.llm.packing import token_ids
    from sedge.llm.queries import vocabulary
    from sedge.llm.token_counts import Ranks, count_tokens

    texts = pa.array(fuzz_texts()[part])
    plain = [t or "" for t in texts.to_pylist()]
    path = vocabulary("byte_bpe_50k.json")
    want = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(plain, add_special_tokens=False)]
    assert count_tokens(texts, Ranks(path)).tolist() == want
    path = vocabulary("word_bpe_49k.json")
    ids, at = token_ids(texts, path)
    for i, e in enumerate(Tokenizer.from_file(path).encode_batch(plain, add_special_tokens=False)):
        assert ids[at[i] : at[i + 1]].tolist() == e.ids


def test_token_counts(spark, odd_rows):
    from sedge.llm.queries import vocabulary
    from sedge.llm.token_counts import token_counts

    out = token_counts(frame(spark, odd_rows), vocabulary("byte_bpe_50k.json")).collect()
    assert sorted(r.n_bytes for r in out) == sorted(len((t or "").encode()) for _, t, _ in odd_rows)
    assert token_counts(frame(spark, []), vocabulary("byte_bpe_50k.json")).count() == 0


def test_packing(spark, odd_rows):
    from tokenizers import Tokenizer

    from sedge.llm.packing import pack
    from sedge.llm.queries import vocabulary

    rng = random.Random(4)
    rows = [*odd_rows, *((100 + i, prose(rng, rng.randint(1, 300)), "s") for i in range(150))]
    path = vocabulary("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for i, t, _ in rows}
    out = pack(frame(spark, rows), path, window=512).collect()
    pieces, windows = {}, {}
    for r in out:
        part = ids[r.id][r.start : r.start + r.length]
        assert r.length == len(part) <= 512 and r.doc_tokens == len(ids[r.id]) and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        pieces.setdefault(r.id, []).append((r.start, r.length))
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, _, _ in rows:
        if i != 5:
            assert sum(n for _, n in pieces[i]) == len(ids[i]) * sum(1 for x in rows if x[0] == i)
    for parts in windows.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 512
    assert len(windows) == brute.best_fit([r.length for r in out], 512)
    assert pack(frame(spark, []), path).count() == 0


def test_quality(spark, odd_rows):
    from sedge.llm.quality import kth_largest, quality_scores, resampled

    rng = random.Random(6)
    good = [(i, prose(rng, rng.randint(5, 200)), "s") for i in range(200)]
    bad = [(1000 + i, " ".join(w + "%%% ###" for w in prose(rng, 40).split()) if i % 2 else ("spam " * 60), "s") for i in range(60)]
    docs = frame(spark, good + bad)
    labels = spark.createDataFrame([(i, 1) for i, _, _ in good[:150]] + [(i, 0) for i, _, _ in bad[:40]] + [(None, 1), (5, None)], "doc_id long, quality int")
    out = {r.id: r.selected for r in quality_scores(spark, docs, labels).collect()}
    assert sum(out[i] for i, _, _ in good) >= 199 and sum(out[i] for i, _, _ in bad) <= 1
    kept = resampled(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, s in out.items() if s}
    odd = quality_scores(spark, frame(spark, odd_rows), labels).collect()
    assert len(odd) == len(odd_rows) and not any(r.selected for r in odd if r.id in (1, 2, 3))
    assert resampled(frame(spark, []), labels).count() == 0
    keys = spark.createDataFrame([(float(x),) for x in [5, 1, 1, 1, 9, 3, -2, 7]], "key double")
    assert [kth_largest(keys, k, bins=2) for k in range(1, 9)] == [9, 7, 5, 3, 1, 1, 1, -2]


def test_toxicity(spark, odd_rows):
    from sedge.llm.toxicity import fit, toxicity

    rng = random.Random(7)

    def text(toxic):
        words = prose(rng, rng.randint(20, 150)).split(" ")
        if toxic:
            words.insert(rng.randrange(len(words)), "vilzor" + rng.choice(WORDS))
        return " ".join(words)

    rows = [(i, text(i % 5 == 0), "s") for i in range(900)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(600)] + [(7, None), (None, 1)], "doc_id long, toxic int")
    net = fit(frame(spark, rows), labels)
    out = {r.id: r.score for r in toxicity(frame(spark, rows), net).collect()}
    held = [(out[i] >= 0.3, i % 5 == 0) for i in range(600, 900)]
    assert sum(a == b for a, b in held) >= 290
    odd = toxicity(frame(spark, odd_rows), net).collect()
    assert len(odd) == len(odd_rows) and all(0 <= r.score <= 1 for r in odd)
    assert toxicity(frame(spark, []), net).count() == 0
    none = fit(frame(spark, rows), labels.filter("toxic = 0"))
    assert {r.score for r in toxicity(frame(spark, rows[:3]), none).collect()} == {none.constant}


def test_nearest(spark):
    from sedge.llm.ann import nearest

    rng = np.random.default_rng(8)
    data = rng.standard_normal((1500, 16)) * rng.uniform(0.5, 2, (1500, 1))
    data[700:900] = data[700]
    rows = [(i, v.tolist(), "x") for i, v in enumerate(data)]
    rows += [(2000, None, "x"), (2020, [0.0] * 16, "x"), (2040, [float("nan")] * 16, "x"), (2060, [None] + [1.0] * 15, "x"), (2080, [1.0] * 3, "x"), (None, [1.0] * 16, "x"), (20, data[20].tolist(), "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    out = nearest(df, F.col("id") % 20 == 0, block=100, query_block=16).collect()
    got = {}
    for r in out:
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 1500, 20))
    hits = 0
    for q, found in got.items():
        score = (data[q] * data).sum(axis=1)
        want = [i for i in np.lexsort((np.arange(1500), -score)) if i != q][:20]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and len({f[1] for f in found}) == 20
        assert all(abs(f[2] - score[f[1]]) < 1e-12 for f in found)
        hits += len({f[1] for f in found} & set(want))
    assert hits / (20 * len(got)) >= 0.9
    few = nearest(df.filter("vec_id < 6"), F.col("id") % 20 == 0).collect()
    assert sorted(r.vec_id for r in few) == [1, 2, 3, 4, 5]
    assert nearest(df.filter("false"), F.col("id") % 20 == 0).count() == 0


def test_components(spark):
    from sedge.operators.graph import components

    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (300, 300)]
    out = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), src="a", dst="b").collect()}
    assert out == {**dict.fromkeys(range(41), 0), 100: 100, 200: 100, 150: 100}


def test_pipeline(spark, sf_dir):
    """Every stage on what the one before it kept, against plain versions."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = [docs]
    for _, stage in corpus_pipeline.STAGES:
        got.append(stage(spark, got[-1], sf_dir).cache())
    rows = [[(r.doc_id, r.text) for r in d.collect()] for d in got[:5]]
    assert all(d.columns == docs.columns for d in got[:5])
    assert set(rows[1]) <= set(rows[0])
    assert sorted(rows[2]) == sorted(brute.line_dedup(rows[1]))
    want = brute.near_components(rows[2])
    assert sorted(i for i, _ in rows[3]) == sorted(i for i, (_, c) in want.items() if i == c)
    assert {i for i, _ in rows[4]} <= {i for i, _ in rows[3]}
    pieces = got[5].groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("d")).collect()
    copies = {i: sum(1 for x, _ in rows[4] if x == i) for i, _ in rows[4]}
    assert {r.doc_id: r.n / r.d for r in pieces} == copies


def test_clashing_names_survive_line_dedup_and_mixing(spark):
    from sedge.llm.line_dedup import line_dedup
    from sedge.llm.mixing import mix

    clash = ["row", "_row", "_flags", "gone", "lines", "hash", "_hash", "copies", "_copies", "_copy", "copy", "id", "size", "key", "slot", "c0", "n_lines", "Text2"]
    rows = [(i, f"shared\nown {i}", "a" if i % 2 else "b", *[f"{c}{i}" for c in clash]) for i in range(12)]
    df = spark.createDataFrame(rows, ["doc_id", "text", "source", *clash])
    out = line_dedup(df)
    assert out.columns == ["doc_id", "text", "source", *[c for c in clash if c != "n_lines"], "n_lines", "n_dropped"]
    for r in out.collect():
        assert r.text == f"own {r.doc_id}" and (r.n_lines, r.n_dropped) == (2, 1) and all(r[c] == f"{c}{r.doc_id}" for c in clash if c != "n_lines")
    mixed = mix(df)
    assert mixed.columns == df.columns
    assert {tuple(r) for r in mixed.collect()} <= set(rows) and mixed.count() >= 12


def test_empty_texts_are_not_in_the_mixed_corpus(spark):
    from sedge.llm.mixing import mix

    rows = [(i, "" if i % 3 == 0 else "w " * 20, "abc"[i % 2]) for i in range(40)] + [(100 + i, None, "empty") for i in range(5)]
    assert all(r.text for r in mix(frame(spark, rows)).collect())


def test_quality_samples_by_weight(spark):
    """Over many seeds texts are drawn as often as Gumbel top-k at the found weights draws them, and not simply the largest weights."""
    from sedge.llm.quality import quality_scores, resample

    rng = random.Random(8)
    odd = lambda n: " ".join("%%#" + rng.choice("abcdef") for _ in range(n))
    rows = [(i, prose(rng, 40), "s") for i in range(40)] + [(100 + i, odd(40), "s") for i in range(40)]
    rows += [(200 + i, prose(rng, 4 * (i + 1)) + " " + odd(4 * (10 - i)), "s") for i in range(10)]
    docs = frame(spark, rows).coalesce(1).cache()
    labels = spark.createDataFrame([(i, 1) for i in range(40)] + [(100 + i, 0) for i in range(40)], "doc_id long, quality int")
    first = resample(docs, labels, k=45, scale=12.0)
    out = quality_scores(spark, docs, labels, k=45, scale=12.0).collect()
    weight = {r.id: r.log_weight for r in out}
    assert first.k == 45 == sum(r.selected for r in out)
    ids, runs = list(weight), 24
    w = np.array([weight[i] for i in ids])
    noise = np.random.default_rng(0).gumbel(size=(4000, len(ids)))
    expected = (np.argsort(np.argsort(-(w + noise), axis=1), axis=1) < 45).mean(axis=0)
    seen = np.zeros(len(ids))
    for seed in range(runs):
        from sedge.llm.quality import gumbel, kth_largest

        keys = spark.createDataFrame([(i, weight[i]) for i in ids], "id long, w double").withColumn("key", F.col("w") + gumbel(F.col("id"), F.lit(""), seed)).cache()
        at = kth_largest(keys.select("key"), 45)
        chosen = {r.id for r in keys.filter(F.col("key") >= at).collect()}
        assert len(chosen) == 45
        seen += np.array([i in chosen for i in ids])
    assert np.abs(seen / runs - expected).max() < 0.45 and np.abs((seen / runs - expected).mean()) < 0.02
    between = (expected > 0.1) & (expected < 0.9)
    assert between.sum() >= 3
    assert np.abs(seen[between].mean() / runs - expected[between].mean()) < 0.12


def test_url_templates_against_a_plain_version(spark):
    """Labelled bad templates go and clean ones stay; trees, merging and shares equal a plain version. Repeated rows, nulls and a very long url are among them."""
    from sedge.llm.url_filter import url_verdicts

    rng = random.Random(12)
    rows = []
    for host, bad_at in [("a.example.com", "promo"), ("b.example.com", "x1"), ("c.example.org", None), ("d.example.net", "all")]:
        for i in range(260):
            top = rng.choice(["news", "promo", "x1", "deep/er", "u" + "%04d" % rng.randint(0, 9999)])
            bad = int(rng.random() < (0.95 if bad_at in (top, "all") else 0.05)) if rng.random() < 0.7 else None
            rows.append((len(rows), f"https://{host}/{top}/{rng.choice(['p', 'q'])}/{rng.randint(1, 99999)}{rng.choice(['', '.html', '/', '?a=1'])}", bad))
    rows += [(10_000 + i, None if i % 2 else "nothing", 1) for i in range(6)]
    rows += [(20_000, "http://long.example.com/" + "s/" * 3000 + "x" * 20_000, 0), (20_001, "http:///no-host", None), *((30_000 + i, *rows[0][1:]) for i in range(3))]
    df = spark.createDataFrame(rows, "page_id long, url string, bad int")
    held = {r.url: r.held for r in df.select("url", (F.pmod(F.xxhash64("url"), F.lit(5)) == 0).alias("held")).distinct().collect()}
    want = brute.url_verdicts(rows, held=held.get)
    got = {r.id: r for r in url_verdicts(df).collect()}
    assert set(got) == set(want)
    for i, (host, path, template, purity, verdict) in want.items():
        assert (got[i].host, got[i].path, got[i].template, got[i].verdict) == (host, path, template, verdict) and abs(got[i].purity - purity) < 1e-9
    blocked = {(r.host, r.template.split("/")[1]) for r in got.values() if r.verdict == "block"}
    assert ("a.example.com", "promo") in blocked and not any(h == "c.example.org" for h, _ in blocked)
    assert sum(r.verdict == "block" for r in got.values() if r.host == "d.example.net") > 200
    shuffled = [bad for _, _, bad in rows]
    rng.shuffle(shuffled)
    none = spark.createDataFrame([(i, u, b) for (i, u, _), b in zip(rows, shuffled, strict=True)], df.schema)
    assert url_verdicts(none).filter("verdict = 'block'").count() == 0


def test_nearest_exactly(spark):
    from sedge.llm.ann import nearest

    rng = np.random.default_rng(3)
    data = np.round(rng.standard_normal((300, 6)), 1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
    got = {}
    for r in nearest(df, F.col("id") % 7 == 0, exact=True, k=5, block=64, query_block=16).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert set(got) == set(range(0, 300, 7))
    for q, found in got.items():
        score = (data[q] * data).sum(axis=1)
        assert [i for _, i in sorted(found)] == [i for i in np.lexsort((np.arange(300), -score)) if i != q][:5]


def test_equal_digests_of_different_texts(spark, tmp_path, monkeypatch):
    """A digest that stands for two texts is told apart by the texts, with the hits broadcast and without."""
    from sedge.llm import exact_dedup as m

    located = m._located
    monkeypatch.setattr(m, "_located", lambda *a: located(*a).withColumn("digest", F.left("text", F.lit(1))))
    frame(spark, [(1, "ab", "s"), (2, "ac", "s"), (3, "ab", "s"), (4, "b", "s"), (None, "b", "s")]).write.parquet(str(tmp_path / "d.parquet"))
    for bound in (1_000_000, 0):
        monkeypatch.setattr(m, "BROADCAST_HITS", bound)
        out = {(r.id, r.keep_id, r.group_size, r.kept) for r in m.exact_dedup(spark, str(tmp_path / "d.parquet")).collect()}
        assert out == {(1, 3, 2, False), (2, 2, 1, True), (3, 3, 2, True), (4, 4, 2, True), (None, 4, 2, False)}


def test_stages_on_odd_documents(spark, tmp_path):
    """Every stage takes nulls, empty and very long texts, repeated rows, empty tables and clashing columns, and those before the last keep the documents' columns."""
    import corpus_pipeline

    rng = random.Random(15)
    clash = ["row", "gone", "copies", "_key", "component_id", "c1", "size"]
    rows = [(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0), (2, None, "de", "a", None), (3, prose(rng, 9000), "en", "a", 1), (3, prose(rng, 50), "en", "a", 1)]
    rows += [(10 + i, prose(rng, 60), "en", "ab"[i % 2], 3) for i in range(20)] + [(None, prose(rng, 30), "en", "a", 3)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in clash)
    docs = spark.createDataFrame([(*r, *["x"] * len(clash)) for r in rows], schema)
    spark.createDataFrame([(10 + i, 1) for i in range(20)] + [(None, None), (2, 0)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, str(tmp_path))
            n = out.count()
            assert n > 0 if table is docs else n == 0
            if name != "packing":
                assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_toxicity_thresholds_by_language_and_repeated_rows(spark):
    """Languages with enough labelled rows of both kinds get a threshold of their own, at the best F1 of their calibration fold; others use that of all."""
    from sedge.llm.toxicity import best_threshold, fit, toxicity

    rng = random.Random(17)
    rows = []
    for i in range(1500):
        words = prose(rng, rng.randint(20, 60)).split(" ")
        toxic = i % 3 == 0
        if toxic:
            words.insert(rng.randrange(len(words)), "vilzor")
        rows.append((i, " ".join(words), "fr" if i % 50 == 0 else "de" if i % 2 else "en", toxic))
    docs = spark.createDataFrame([(i, t, g) for i, t, g, _ in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(x)) for i, _, _, x in rows], "doc_id long, toxic int")
    net = fit(docs, labels)
    assert {None, "en", "de"} <= set(net.thresholds) and "fr" not in net.thresholds
    twice = docs.unionByName(docs.limit(50)).unionByName(spark.createDataFrame([(9000, None, None), (9001, rows[0][1], None)], docs.schema))
    out = toxicity(twice, net).collect()
    assert len(out) == 1552
    lang = {i: g for i, _, g, _ in rows} | {9000: None, 9001: None}
    scores = {}
    for r in out:
        assert r.threshold == net.thresholds.get(lang[r.id], net.thresholds[None]) and r.toxic == (r.score >= r.threshold)
        assert scores.setdefault(r.id, r.score) == r.score
    p, y = np.array([0.9, 0.8, 0.7, 0.2]), np.array([True, True, False, False])
    best = best_threshold(p, y)
    assert 0.7 <= best <= 0.8
    f1 = lambda cut: 2 * (y & (p >= cut)).sum() / ((p >= cut).sum() + y.sum())
    assert f1(best) == max(f1(c) for c in np.linspace(0, 1, 101))
