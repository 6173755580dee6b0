from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

VECTORS = "vec_id long, embedding array<float>, label int, id string, V string"


@pytest.fixture(scope="module")
def paths():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def odd_texts(n, seed=5, more=()):
    rng = random.Random(seed)
    parts = [*"abcdeEST 's'll   \n\n\t\r.,!?-0123é日本　\xa0\U0001f600éß\x00‍", "<|endoftext|>", "'re", " the", "\n  ", "word", "<s>", "<0x41>", *more]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def documents(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "x", "y") for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, id string, piece string")


def brute_alignment(text, a, b, entries):
    """(A ids, B ids, groups, links) of whole texts by the libraries, with plain loops."""
    if not text:
        return [], [], [], Counter()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    of_a = [entries[i] for i in ids_a]
    of_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if not b"".join(of_a) == b"".join(of_b) == (" " + text).encode():
        return [], [], [], Counter()
    ends = [np.cumsum([len(x) for x in of]).tolist() for of in (of_a, of_b)]
    links = Counter()
    for i, x in enumerate(ids_a):
        for j, y in enumerate(ids_b):
            if max(ends[0][i] - len(of_a[i]), ends[1][j] - len(of_b[j])) < min(ends[0][i], ends[1][j]):
                links[x, y] += 1
    groups, i, j = [], 0, 0
    for cut in sorted(set(ends[0]) & set(ends[1])):
        k, m = ends[0].index(cut) + 1, ends[1].index(cut) + 1
        groups.append(",".join(map(str, ids_a[i:k])) + "|" + ",".join(map(str, ids_b[j:m])))
        i, j = k, m
    return ids_a, ids_b, groups, links


@pytest.mark.parametrize("broadcast", [1_000_000, 40])
def test_alignment(spark, paths, broadcast):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    from sedge.llm.alignment import alignments, byte_decoder

    a, b = Tokenizer.from_file(paths[0]), SentencePieceProcessor(model_file=paths[1])
    a.encode_special_tokens = True
    code = byte_decoder()
    entries = {i: bytes(code[c] for c in t) for t, i in a.get_vocab(with_added_tokens=False).items() if all(c in code for c in t)}
    texts = [*odd_texts(120), *odd_texts(20, seed=6, more=["▁"]), None, "", " ", "  ", "a ", "\n", "same words here", "same words here", "word " * 5000, "unbroken" * 700]
    ids = [*range(len(texts) - 1), None]
    plain = [brute_alignment(t, a, b, entries) if len(t or "") < 2000 else None for t in texts]
    long = [i for i, p in enumerate(plain) if p is None]
    for i in long:  # by the libraries too, but with links from the cuts
        ids_a, ids_b = a.encode(" " + texts[i], add_special_tokens=False).ids, b.encode(texts[i])
        ends_a = np.cumsum([len(entries[x]) for x in ids_a])
        ends_b = np.cumsum([len(b.id_to_piece(x).replace("▁", " ")) for x in ids_b])
        cuts = np.union1d(ends_a, ends_b)
        links = Counter(zip(np.array(ids_a)[np.searchsorted(ends_a, cuts)].tolist(), np.array(ids_b)[np.searchsorted(ends_b, cuts)].tolist(), strict=True))
        plain[i] = ids_a, ids_b, None, links
    held = Counter(pair for p in plain for pair in p[3])
    most = Counter()
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    got = {r["id"]: r for r in alignments(documents(spark, texts, ids), *paths, broadcast=broadcast).collect()}
    assert len(got) == len(texts)
    for i, (ids_a, ids_b, groups, links) in zip(ids, plain, strict=True):
        r = got[i]
        best = sum(n for pair, n in links.items() if held[pair] == most[pair[0]])
        assert (r.n_a, r.n_b, r.n_links, r.n_best, r.count_sum) == (len(ids_a), len(ids_b), sum(links.values()), best, sum(held[p] * n for p, n in links.items()))
        if groups is not None:
            assert r.n_groups == len(groups) and r.groups_sha256 == (hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
    assert alignments(documents(spark, []), *paths).count() == 0


def test_common_cut(spark):
    from sedge.llm.alignment import common_cut

    pairs = spark.createDataFrame([(i, d) for i, d in enumerate([1, 1, 1, 2, 3, 4, 9, 20])], "pair long, docs long")
    assert [common_cut(pairs, n) for n in (100, 8, 7, 5, 2, 0)] == [1, 1, 2, 2, 8, 32]
    assert common_cut(pairs.limit(0), 5) == 1


def brute_negatives(rows, anchors, positives=5, k=5, percent=80):
    """rows: {id: (label, integer vector)}."""
    out = []
    for a in anchors:
        scored = sorted((-sum(x * y for x, y in zip(rows[a][1], v, strict=True)), i, label == rows[a][0]) for i, (label, v) in rows.items() if i != a)
        for p, pos in [(-s, i) for s, i, same in scored if same][:positives]:
            window = [(-s, i) for s, i, same in scored if not same and percent * p <= -100 * s <= 100 * p][:k]
            out += [(a, pos, n, i, p, s) for n, (s, i) in enumerate(window, 1)]
    return sorted(out)


@pytest.mark.parametrize("size", [8192, 13])
def test_hard_negatives(spark, size):
    from sedge.llm.hard_negatives import hard_negatives

    rng = np.random.default_rng(4)
    centre = rng.normal(size=(3, 6))
    data = [(i, (centre[i % 3] + rng.normal(size=6) * 0.6).round(1).tolist(), int(rng.integers(0, 4))) for i in range(260)]
    data += [(300 + i, [0.5] * 6, 1 + i % 2) for i in range(120)]  # ties
    data += [(500, None, 1), (501, [0.1] * 6, None), (502, [0.1, None] + [0.2] * 4, 1), (503, [float("nan")] * 6, 1), (504, [float("inf")] * 6, 1), (505, [0.1] * 5, 1), (None, [0.1] * 6, 1), (506, [], 1), (400, [0.5] * 6, 2), (507, [0.0] * 6, 3)]
    frame = spark.createDataFrame([(*r, "x", "y") for r in data], VECTORS)
    rows = {}
    for i, v, label in data:
        if i is None or label is None or v is None or len(v) != 6 or any(x is None or not np.isfinite(x) for x in v):
            continue
        whole = np.floor(256 * np.array(v, np.float32).astype(float)).astype(int).tolist()
        rows[i] = min(rows.get(i, (label, whole)), (label, whole))
    anchors = [i for i in rows if i % 20 == 0]
    out = hard_negatives(frame, F.col("id") % 20 == 0, block=size, anchor_block=size)
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert out.columns == names
    assert sorted(tuple(r) for r in out.collect()) == brute_negatives(rows, anchors)
    assert hard_negatives(frame.limit(0), F.col("id") % 20 == 0).count() == 0
    assert hard_negatives(frame, F.col("id") < 0).count() == 0
    wide = frame.filter("vec_id < 40").withColumn("embedding", F.transform("embedding", lambda x: (x * 2.0**20).cast("float")))  # products beyond 2^53
    big = {i: (label, np.floor(256 * (np.array(v, np.float32) * np.float32(2**20)).astype(float)).astype(int).tolist()) for i, v, label in data[:40]}
    assert sorted(tuple(r) for r in hard_negatives(wide, F.col("id") % 20 == 0, block=size).collect()) == brute_negatives(big, [0, 20])
    with pytest.raises(ValueError):
        hard_negatives(wide.withColumn("embedding", F.transform("embedding", lambda x: (x * 1e6).cast("float"))), F.col("id") % 20 == 0)


def checked_windows(out, window):
    """Windows are gapless and not overfull; returns how many there are."""
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= window
    return len(by)


def test_complement_packing(spark, paths):
    from tokenizers import Tokenizer

    from sedge.llm.complement_packing import pack_whole

    library = Tokenizer.from_file(paths[0])
    texts = [*odd_texts(150), None, "", "same words here", "same words here", "word " * 5000, " ".join(odd_texts(200, seed=8))]
    ids = [*range(len(texts) - 3), 7, 7, None]
    out = pack_whole(documents(spark, texts, ids), paths[0], window=128).collect()
    checked_windows(out, 128)
    expected = Counter()
    for i, t in zip(ids, texts, strict=True):
        whole = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(whole) % 128 or min(128, len(whole))
        cuts = [0, *range(first, len(whole) + 1, 128)]
        for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            expected[i, n, a, b - a, zlib.crc32(whole[a:b].tobytes())] += 1
    assert Counter((r.id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == expected
    assert pack_whole(documents(spark, []), paths[0]).count() == 0
    assert [(r.piece, r.length, r.offset) for r in pack_whole(documents(spark, [None]), paths[0]).collect()] == [(0, 1, 0)]


@pytest.mark.parametrize("low, high, n", [(1, 60, 900), (100, 700, 900), (513, 1024, 200), (300, 345, 400), (1, 1024, 3000), (1024, 1025, 7), (5, 6, 10_000)])
def test_window_plans(low, high, n):
    """Every piece once, no window overfull, never more windows than best-fit decreasing alone makes, and few steps for many pieces."""
    from sedge.llm.complement_packing import exact_windows, plan_windows
    from sedge.llm.packing import best_fit_decreasing

    lengths = np.random.default_rng(1).integers(low, high, n)
    histogram = Counter(lengths.tolist())
    plan = plan_windows(histogram, 1024)
    back = Counter()
    for parts, copies in plan:
        assert sum(parts) <= 1024 and copies > 0
        for x in parts:
            back[x] += copies
    assert back == histogram
    made = sum(copies for _, copies in plan)
    assert -(-int(lengths.sum()) // 1024) <= made <= best_fit_decreasing(np.sort(lengths)[::-1], 1024)[0].max() + 1
    many = plan_windows({k: v * 10_000 for k, v in histogram.items()}, 1024)
    assert len(many) < 3000 and sum(copies for _, copies in many) <= made * 10_000
    counts = np.zeros(1025, np.int64)
    for k, v in histogram.items():
        counts[k] = v
    assert all(sum(parts) == 1024 for parts, _ in exact_windows(counts))


def test_sum_index():
    from sedge.llm.complement_packing import SumIndex

    counts = np.zeros(101, np.int64)
    counts[[10, 20, 45]] = [1, 2, 1]
    index = SumIndex(counts)
    none = Counter()
    assert index.closing(20, none) == (20,) and index.closing(30, none) == (20, 10) and index.closing(40, none) == (20, 20)
    assert index.closing(90, none) is None and index.closing(75, none) == (45, 20, 10)
    assert index.closing(85, none) == (45, 20, 20) and index.closing(85, Counter({20: 1})) is None
    assert index.closing(60, none) is None  # 20 thrice


def test_byte_ids_equal_the_library(paths):
    from tokenizers import Tokenizer

    from sedge.llm.segments import byte_token_ids

    texts = odd_texts(600, seed=9)
    ids, at = byte_token_ids(pa.array(texts, pa.string()), paths[0])
    for e, a, b in zip(Tokenizer.from_file(paths[0]).encode_batch(texts, add_special_tokens=False), at, at[1:], strict=False):
        assert e.ids == ids[a:b].tolist()


def test_token_counts_through_spark(spark, paths):
    from tokenizers import Tokenizer

    from sedge.llm.token_counts import token_counts

    texts = [*odd_texts(80, seed=3), None, "", "word " * 3000]
    want = [len(Tokenizer.from_file(paths[0]).encode(t or "", add_special_tokens=False).ids) for t in texts]
    got = {r.id: (r.n_bytes, r.n_tokens) for r in token_counts(documents(spark, texts), paths[0]).collect()}
    assert got == {i: (len((t or "").encode()), n) for i, (t, n) in enumerate(zip(texts, want, strict=True))}


def test_rows_with_the_last_key_are_selected_together(spark):
    from sedge.llm.quality import quality_scores

    rng = random.Random(1)
    words = [f"word{i}" for i in range(40)]
    texts = [" ".join(rng.choice(words) for _ in range(20)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(texts)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")
    for k in (1, 3, 4):
        out = quality_scores(spark, docs, labels, k=k).collect()
        kept = [r.id for r in out if r.selected]
        assert len(kept) == k + k % 2 and all(kept.count(i) == 2 for i in kept)


def test_left_over_pairs_stay_in_proportion(spark, monkeypatch):
    """Edited, cut and prolonged copies of one text: what hubs leave gives fewer pairs than there are members, and components equal brute force."""
    from sedge.llm import near_dedup

    rng = random.Random(1)
    words = [f"w{i}" for i in range(5000)]
    base = [rng.choice(words) for _ in range(150)]
    texts = []
    for i in range(400):
        text = list(base)
        if i % 4 < 2:
            for _ in range(rng.randint(0, 5)):
                text[rng.randrange(150)] = rng.choice(words)
        elif i % 4 == 2:
            text = base[: rng.randint(60, 150)]
        else:
            text = base[:110] + [rng.choice(words) for _ in range(rng.randint(0, 60))]
        texts.append(" ".join(text))
    counted = []
    original = near_dedup._left_over

    def counting(open_lists, sets, *, percent):
        out = original(open_lists, sets, percent=percent)
        counted.append(near_dedup._ordered(out).count())
        return out

    monkeypatch.setattr(near_dedup, "_left_over", counting)
    got = {r.id: r.component_id for r in near_dedup.near_duplicates(documents(spark, texts)).collect()}
    assert sum(counted) < len(texts)
    sets = [frozenset(zip(*[t.split()[j:] for j in range(5)], strict=False)) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    assert got == {i: root(i) for i in range(len(texts))}
