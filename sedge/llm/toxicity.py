"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the sum of the embeddings of its hash and of the hashes of its first 4, 5 and 6 letters, so an inflected word that was
not in the sample shares most of its stem's parts. Filters of widths 1, 2 and 3 run over the whole text, each keeps its maximum, and a
logistic layer weighs the maxima. It is fitted on a bounded, documented sample of labelled rows on the driver;
embeddings start from the smoothed log odds of their bucket and all parameters are then trained by Adagrad. Scores are
calibrated to probabilities on a fold of the sample (Platt, at the label share of all labelled rows), and a threshold per language is
chosen on that fold. Scoring runs in Arrow UDFs over every whole text; language, source and id are never inputs of a score.

Defined cases: null, empty or blank texts score as a text without words; null labels are not used; several labels of one id count
as their maximum; if the sample has one class only, every score is that class's smoothed share; languages with fewer than ``min_lang``
rows of either class in the fold, and null languages, use the threshold of all; rows are scored independently, so repeated
rows and ties need no rule; an empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedge.llm.textarrays import mixed, run_hashes, slices, tokens

STEMS = (None, 4, 5, 6)
WIDTHS = (1, 2, 3)
BUCKETS = 1 << 17
DIM, FILTERS = 8, 8
PAD = max(WIDTHS)


def word_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of each distinct word: [u, len(STEMS)], index of each word of the texts, offsets of the texts)."""
    words, firsts, hashes, feats, base = [], [np.zeros(1, np.int64)], [], [], 0
    for part in slices(iter([pa.RecordBatch.from_arrays([texts], names=["text"])])):
        points, start, length, first = tokens(part.column("text"))
        h = run_hashes(points, start, length)
        known, one = np.unique(h, return_index=True)
        if len(known):
            stems = [mixed(run_hashes(points, start[one], length[one], stem) + np.uint64(i + 1)) % np.uint64(BUCKETS) for i, stem in enumerate(STEMS)]
            feats.append(np.stack(stems, axis=1).astype(np.int64))
        words.append(h)
        hashes.append(known)
        firsts.append(first[1:] + base)
        base += len(h)
    first = np.concatenate(firsts)
    if not feats:
        return np.empty((0, len(STEMS)), np.int64), np.empty(0, np.int64), first
    known, one = np.unique(np.concatenate(hashes), return_index=True)
    return np.concatenate(feats)[one], np.searchsorted(known, np.concatenate(words)), first


def padded(which: np.ndarray, first: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Word indexes with PAD pads after each text, and the texts' offsets in them."""
    n = np.diff(first)
    at = np.concatenate(([0], np.cumsum(n + PAD)))
    out = np.full(int(at[-1]), pad, np.int64)
    shift = np.repeat(at[:-1] - first[:-1], n)
    out[np.arange(len(which)) + shift] = which
    return out, at


@dataclass
class TextCnn:
    embed: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, DIM), np.float32))
    taps: list[np.ndarray] = field(default_factory=list)  # per width: [width, DIM, FILTERS]
    bias: np.ndarray = field(default_factory=lambda: np.zeros(len(WIDTHS) * FILTERS, np.float32))
    out: np.ndarray = field(default_factory=lambda: np.zeros(len(WIDTHS) * FILTERS, np.float32))
    out_bias: float = 0.0
    platt: tuple[float, float] = (1.0, 0.0)
    thresholds: dict[str | None, float] = field(default_factory=lambda: {None: 0.5})
    constant: float | None = None

    def responses(self, feats: np.ndarray, which: np.ndarray, first: np.ndarray):
        """Per width the filters' responses at each padded position; also the padded words, offsets and each text's last start + 1."""
        vectors = np.concatenate((self.embed[feats].sum(axis=1), np.zeros((1, DIM), np.float32)))
        words, at = padded(which, first, len(feats))
        maps = []
        for w, taps in zip(WIDTHS, self.taps, strict=True):
            total = None
            for k in range(w):
                part = (vectors @ taps[k])[words]
                if k:
                    part = np.concatenate((part[k:], np.zeros((k, FILTERS), np.float32)))
                total = part if total is None else total + part
            maps.append(total)
        return maps, words, at

    def logits(self, texts: pa.Array) -> np.ndarray:
        feats, which, first = word_features(texts)
        maps, _, at = self.responses(feats, which, first)
        if len(texts) == 0:
            return np.empty(0)
        # A window that starts at the pads sees zeros only, which ReLU makes the least value anyway.
        pooled = np.concatenate([np.maximum.reduceat(m, at[:-1], axis=0) for m in maps], axis=1)
        return np.maximum(pooled + self.bias, 0) @ self.out + self.out_bias

    def probability(self, texts: pa.Array) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        a, b = self.platt
        return 1 / (1 + np.exp(-np.clip(a * self.logits(texts) + b, -40, 40)))


def _log_odds(feats: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Smoothed log odds of a bucket's presence in a toxic text, shrunk where it is rare. ``feats``: buckets of each text."""
    pos, neg = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for f, y in zip(feats, labels, strict=True):
        (pos if y else neg)[f] += 1
    n_pos, n_neg = labels.sum(), len(labels) - labels.sum()
    odds = np.log((pos + 0.5) / (n_pos + 1)) - np.log((neg + 0.5) / (n_neg + 1))
    return (odds * (pos + neg) / (pos + neg + 4)).astype(np.float32)


def train(texts: pa.Array, labels: np.ndarray, *, epochs: int = 6, batch: int = 64, rate: float = 0.05, seed: int = 5) -> TextCnn:
    rng = np.random.default_rng(seed)
    net = TextCnn()
    feats, which, first = word_features(texts)
    per_text = [np.unique(feats[which[a:b]]) for a, b in zip(first[:-1], first[1:], strict=True)]
    net.embed = (rng.standard_normal((BUCKETS, DIM)) * 0.02).astype(np.float32)
    net.embed[:, 0] = _log_odds(per_text, labels) / len(STEMS)
    net.taps = [(rng.standard_normal((w, DIM, FILTERS)) * 0.1).astype(np.float32) for w in WIDTHS]
    for w, taps in zip(WIDTHS, net.taps, strict=True):
        taps[:, 0, : FILTERS // 2] += 1 / w
    net.bias[:] = 0.0
    net.out = np.abs(rng.standard_normal(len(net.out)) * 0.05).astype(np.float32)
    net.out_bias = float(-1.0)
    state = {id(p): np.full(p.shape, 1e-4, np.float32) for p in (net.embed, *net.taps, net.bias, net.out)}
    weight = np.where(labels, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9))

    def step(param: np.ndarray, grad: np.ndarray) -> None:
        seen = state[id(param)]
        seen += grad**2
        param -= rate * grad / np.sqrt(seen)

    bias_seen = 1e-4
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for i in range(0, len(order), batch):
            rows = order[i : i + batch]
            spans = [np.arange(first[r], first[r + 1]) for r in rows]
            local = np.concatenate(spans) if spans else np.empty(0, np.int64)
            starts = np.concatenate(([0], np.cumsum([len(s) for s in spans])))
            used, inside = np.unique(which[local], return_inverse=True)
            maps, words, at = net.responses(feats[used], inside, starts)
            tops = [np.stack([m[a:b].argmax(axis=0) + a for a, b in zip(at[:-1], at[1:], strict=True)]) for m in maps]  # [texts, FILTERS]
            pooled = np.concatenate([np.take_along_axis(m, t, axis=0) for m, t in zip(maps, tops, strict=True)], axis=1)
            active = pooled + net.bias
            hidden = np.maximum(active, 0)
            z = hidden @ net.out + net.out_bias
            g = ((1 / (1 + np.exp(-z))) - labels[rows]) * weight[rows] / len(rows)
            d_hidden = g[:, None] * net.out[None, :] * (active > 0)
            vectors = np.concatenate((net.embed[feats[used]].sum(axis=1), np.zeros((1, DIM), np.float32)))
            d_vec = np.zeros_like(vectors)
            for j, (w, taps, top) in enumerate(zip(WIDTHS, net.taps, tops, strict=True)):
                d = d_hidden[:, j * FILTERS : (j + 1) * FILTERS]
                d_taps = np.zeros_like(taps)
                for k in range(w):
                    hit = words[np.minimum(top + k, len(words) - 1)]
                    d_taps[k] = np.einsum("tfd,tf->df", vectors[hit], d)
                    np.add.at(d_vec, hit.ravel(), (d[:, :, None] * taps[k].T[None]).reshape(-1, DIM))
                step(taps, d_taps)
            step(net.bias, d_hidden.sum(axis=0).astype(np.float32))
            step(net.out, (g @ hidden).astype(np.float32))
            bias_seen += float(g.sum()) ** 2
            net.out_bias -= rate * float(g.sum()) / bias_seen**0.5
            moved = np.flatnonzero(np.abs(d_vec[:-1]).sum(axis=1))
            if len(moved):
                buckets = feats[used[moved]]
                flat, back = np.unique(buckets.ravel(), return_inverse=True)
                grad = np.zeros((len(flat), DIM), np.float32)
                np.add.at(grad, back, np.repeat(d_vec[moved], len(STEMS), axis=0))
                seen = state[id(net.embed)][flat] + grad**2
                state[id(net.embed)][flat] = seen
                net.embed[flat] -= rate * grad / np.sqrt(seen)
    return net


def fit_platt(z: np.ndarray, y: np.ndarray, share: float, rounds: int = 200) -> tuple[float, float]:
    """Slope and shift of a logistic curve by Newton steps, with the classes weighed to the given share of label 1."""
    if y.min() == y.max():
        return 1.0, 0.0
    w = np.where(y, share / y.mean(), (1 - share) / (1 - y.mean()))
    n_pos, n_neg = y.sum(), len(y) - y.sum()
    t = np.where(y, (n_pos + 1) / (n_pos + 2), 1 / (n_neg + 2))
    scale = max(float(np.std(z)), 1e-6)
    x = np.stack((z / scale, np.ones_like(z)), axis=1)
    theta = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        grad = x.T @ (w * (p - t)) + 1e-3 * theta
        hess = (x * (w * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        move = np.linalg.solve(hess, grad)
        theta -= np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    return float(theta[0] / scale), float(theta[1])


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The score at which F1 is best."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    best = int(np.argmax(f1))
    nxt = p[order[best + 1]] if best + 1 < len(p) else 0.0
    return float((p[order[best]] + nxt) / 2)


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic", max_rows: int = 6_000, min_lang: int = 20, seed: int = 5) -> TextCnn:
    """Fit on at most ``max_rows`` labelled rows, up to a third of them toxic; a fifth of the sample calibrates."""
    marked = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("_y"))
    totals = marked.agg(F.sum("_y"), F.count("*")).first()
    share = (totals[0] or 0) / max(totals[1], 1)
    ordered = marked.withColumn("_h", F.xxhash64("_id", F.lit(seed)))
    sample = ordered.filter("_y = 1").orderBy("_h").limit(max_rows // 3).unionByName(ordered.filter("_y = 0").orderBy("_h").limit(max_rows - max_rows // 3))
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col(lang_col).alias("lang")).join(F.broadcast(sample), "_id")
    got = rows.select("_id", "text", "lang", "_y", "_h").toArrow().sort_by([("_h", "ascending"), ("_id", "ascending")])
    texts, y = got.column("text").combine_chunks(), got.column("_y").to_numpy().astype(bool)
    if len(y) == 0 or y.min() == y.max():
        return TextCnn(constant=((totals[0] or 0) + 0.5) / (totals[1] + 1))
    held = np.arange(len(y)) % 5 == 4
    net = train(texts.filter(pa.array(~held)), y[~held], seed=seed)
    check = texts.filter(pa.array(held))
    z = np.concatenate([net.logits(p.column("text")) for p in slices(iter([pa.RecordBatch.from_arrays([check], names=["text"])]))] or [np.empty(0)])
    if len(z) and y[held].min() != y[held].max():
        net.platt = fit_platt(z, y[held], share)
        p = 1 / (1 + np.exp(-np.clip(net.platt[0] * z + net.platt[1], -40, 40)))
        net.thresholds = {None: best_threshold(p, y[held])}
        langs = np.array(got.column("lang").to_pylist(), object)[held]
        for lang in sorted({x for x in langs if x is not None}):
            mine = langs == lang
            if min(y[held][mine].sum(), (~y[held][mine]).sum()) >= min_lang:
                net.thresholds[lang] = best_threshold(p[mine], y[held][mine])
    return net


def score_column(docs: DataFrame, net: TextCnn, text: Column) -> Column:
    """Score of each whole text, by an Arrow UDF; the model is a broadcast of fixed size (BUCKETS * DIM floats)."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        parts = [shared.value.probability(p.column("text")) for p in slices(iter([pa.RecordBatch.from_arrays([texts], names=["text"])]))]
        return pa.array(np.concatenate(parts) if parts else np.empty(0), pa.float64())

    return score(F.coalesce(text.cast("string"), F.lit("")))


def toxicity(docs: DataFrame, net: TextCnn, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of ``docs``: id, score, threshold (of its language), toxic."""
    scored = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("_lang"), score_column(docs, net, F.col(text_col)).alias("score"))
    threshold = F.lit(net.thresholds[None])
    for lang, value in net.thresholds.items():
        if lang is not None:
            threshold = F.when(F.col("_lang") == lang, F.lit(value)).otherwise(threshold)
    return scored.select("id", "score", threshold.alias("threshold")).withColumn("toxic", F.col("score") >= F.col("threshold"))
