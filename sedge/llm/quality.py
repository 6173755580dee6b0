"""Quality selection by importance resampling (hashed n-gram models, Gumbel top-k).

Two generative models over hashed word unigrams and bigrams: one of target texts (labelled good, at most ``max_target`` of them),
one of the raw corpus (all documents, counted per task in numpy and summed by bucket). A document's log importance weight
is ``scale`` times what its mean log ratio of the models per n-gram exceeds the cut by, so that length alone decides nothing; the cut separates
a labelled calibration fold best, and ``scale`` makes the weight a log odds on that fold (the ratio is tempered: summed over the n-grams
of a text it would leave no room for chance). Adding Gumbel noise seeded by the id and keeping the k largest keys samples k documents without
replacement in proportion to the weights. k is given, or the expected number of keys over 0, that is the sum of 1 - exp(-weight) over all
documents. Texts far above the cut are so always kept and those far below it never, while in between inclusion is a matter of the weight.

A word that repeats the one before it becomes one "repeat" symbol, so that runs of any word look alike.

Defined cases: null, empty or blank texts hold no n-gram, have a null weight and are never selected; without labelled good texts
every text that holds an n-gram is selected unless k is given; all rows whose key is that of the k-th are selected, so repeated rows go
together and k may be exceeded by them; a row with a null id draws its noise from its text; an empty table gives an empty one; ``resampled``
keeps all columns, also those whose names look like its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedge.functions.storage import saved
from sedge.llm.textarrays import mixed, run_hashes, slices, tokens

BUCKETS = 1 << 12
#: Pseudo-counts per bucket by which the target model leans on the raw one.
LEAN = 10.0
#: Deals the labelled rows into target and calibration fold, whatever the seed of the noise.
SPLIT_SEED = 11


def ngram_buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all n-grams, offsets of the texts)."""
    points, start, length, first = tokens(texts)
    words = run_hashes(points, start, length)
    n = len(words)
    if n == 0:
        return np.empty(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    head = np.zeros(n + 1, bool)
    head[first] = True
    before = np.concatenate(([np.uint64(0)], words[:-1]))
    again = (words == before) & ~head[:-1]
    symbols = np.where(again, np.uint64(12345), words)
    pair = mixed(symbols * np.uint64(0x9E3779B97F4A7C15) + np.concatenate(([np.uint64(0)], symbols[:-1])))
    pair = np.where(head[:-1], mixed(symbols + np.uint64(1)), pair)
    both = np.stack((symbols, pair), axis=1).ravel()
    return (mixed(both) % np.uint64(BUCKETS)).astype(np.int64), 2 * first


@dataclass
class Ratio:
    """Log ratio of target to raw per bucket."""

    log_ratio: np.ndarray

    def means(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(mean log ratio, number of n-grams) per text; the mean of none is NaN."""
        buckets, at = ngram_buckets(texts)
        total = np.concatenate(([0.0], np.cumsum(self.log_ratio[buckets])))
        n = np.diff(at)
        with np.errstate(invalid="ignore", divide="ignore"):
            return (total[at[1:]] - total[at[:-1]]) / n, n


def fit(docs: DataFrame, good_ids: DataFrame, *, id_col: str, text_col: str) -> Ratio:
    """``good_ids`` (one column, id) is a bounded sample of target documents."""
    target = F.broadcast(good_ids.select(F.col("id").alias("_good")).distinct())
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.join(target, F.col("_id") == F.col("_good"), "left").select("text", F.col("_good").isNotNull().alias("good"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for part in slices(batches):
            buckets, at = ngram_buckets(part.column("text"))
            raw += np.bincount(buckets, minlength=BUCKETS)
            flag = np.repeat(part.column("good").to_numpy(zero_copy_only=False), np.diff(at))
            good += np.bincount(buckets[flag], minlength=BUCKETS)
        seen = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(raw[seen]), pa.array(good[seen])], names=["bucket", "raw", "good"])

    sums = rows.mapInArrow(count, "bucket long, raw long, good long").groupBy("bucket").agg(F.sum("raw"), F.sum("good")).collect()  # BUCKETS rows at most
    raw, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for b, r, g in sums:
        raw[b], good[b] = r, g
    p_raw = (raw + 1) / (raw.sum() + BUCKETS)
    lean = LEAN * BUCKETS
    p_good = (good + lean * p_raw) / (good.sum() + lean)
    return Ratio(np.log(p_good / p_raw))


def mean_log_ratio(model: Ratio, text: Column) -> Column:
    """Struct (mean, n) by an Arrow UDF."""

    @F.arrow_udf("struct<mean: double, n: long>")
    def score(texts: pa.Array) -> pa.Array:
        means, sizes = [np.empty(0)], [np.empty(0, np.int64)]
        for part in slices(iter([pa.RecordBatch.from_arrays([texts], names=["text"])])):
            m, n = model.means(part.column("text"))
            means.append(m)
            sizes.append(n)
        mean = np.concatenate(means)
        return pa.StructArray.from_arrays([pa.array(mean, pa.float64(), mask=np.isnan(mean)), pa.array(np.concatenate(sizes), pa.int64())], names=["mean", "n"])

    return score(F.coalesce(text.cast("string"), F.lit("")))


def gumbel(id_col: Column, text: Column, seed: int) -> Column:
    """Standard Gumbel noise from a hash."""
    h = F.coalesce(F.xxhash64(id_col.cast("string"), F.lit(seed)) + F.when(id_col.isNull(), None).otherwise(0), F.xxhash64(text, F.lit(seed)))
    unit = (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(unit))


def best_cut(good: np.ndarray, bad: np.ndarray) -> float:
    """The cut with the best balanced accuracy; in a gap, its middle. Without bad texts, below all good ones."""
    good, bad = np.sort(good[~np.isnan(good)]), np.sort(bad[~np.isnan(bad)])
    if len(good) == 0 or len(bad) == 0:
        return -np.inf
    values = np.unique(np.concatenate((good, bad)))
    right = 1 - np.searchsorted(good, values) / len(good)  # good texts at or over the value
    wrong = np.searchsorted(bad, values) / len(bad)  # bad texts below it
    best = int(np.argmax(right + wrong))
    below = values[best - 1] if best else values[0] - 1
    return float((values[best] + below) / 2)


def log_odds_scale(good: np.ndarray, bad: np.ndarray, cut: float) -> float:
    """The factor that makes (value - cut) the log odds of good against bad, both kinds weighing the same; targets are smoothed by half a row."""
    x = np.concatenate((good, bad)) - cut
    target = np.concatenate((np.full(len(good), (len(good) + 0.5) / (len(good) + 1)), np.full(len(bad), 0.5 / (len(bad) + 1))))
    weight = np.concatenate((np.full(len(good), 1 / len(good)), np.full(len(bad), 1 / len(bad))))
    low, high = 0.0, 1e6
    for _ in range(100):  # the likelihood's slope falls as the factor grows
        middle = (low + high) / 2
        p = 1 / (1 + np.exp(-np.clip(middle * x, -500, 500)))
        low, high = (middle, high) if (weight * x * (target - p)).sum() > 0 else (low, middle)
    return max(low, 1e-3)


def kth_largest(keys: DataFrame, k: int, *, bins: int = 4096) -> float:
    """The k-th largest ``key`` by counting in ever finer bins: each round aggregates the rows left in one bin."""
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    rows = keys
    while low < high:
        width = (high - low) / bins
        if width <= 0 or low + width == low:
            break
        index = F.least(F.floor((F.col("key") - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
        found = sorted(rows.groupBy(index.alias("bin")).agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).collect(), reverse=True)
        for _, n, bin_low, bin_high in found:  # at most ``bins`` rows
            if n >= k:
                break
            k -= n
        if (bin_low, bin_high) == (low, high):
            break
        low, high = bin_low, bin_high
        rows = rows.filter(F.col("key").between(low, high))
    return high


@dataclass
class Selection:
    """What ``resampled`` found: apply it with ``keep``."""

    model: Ratio
    cut: float
    k: int
    threshold: float
    scale: float
    seed: int

    def columns(self, df: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
        """``df`` with _n_ngrams, _log_weight, _key and _selected."""
        scored = df.withColumn("_score", mean_log_ratio(self.model, F.col(text_col)))
        weight = (F.col("_score.mean") - F.lit(self.cut)) * self.scale
        key = weight + gumbel(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")), self.seed)
        out = scored.withColumn("_n_ngrams", F.col("_score.n")).withColumn("_log_weight", weight).withColumn("_key", key).drop("_score")
        return out.withColumn("_selected", F.coalesce(F.col("_key") >= self.threshold, F.lit(False)))


def resample(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", good_col: str = "quality", k: int | None = None, scale: float | None = None, max_target: int = 20_000, max_calibration: int = 4_000, seed: int = 11) -> Selection:
    """Fit the models on all of ``docs``, calibrate and find the k-th key.

    ``labels`` holds ``id_col`` and ``good_col`` (1 or 0). At most ``max_target`` good ids, and ``max_calibration`` others of either kind, are used.
    """
    marked = labels.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(good_col).cast("int").alias("good"), F.xxhash64(F.col(id_col), F.lit(SPLIT_SEED)).alias("h"))
    fold = F.pmod("h", F.lit(5)) == 0
    target = marked.filter("good = 1").filter(~fold).orderBy("h").limit(max_target).select("id")
    model = fit(docs, target, id_col=id_col, text_col=text_col)
    checks = [marked.filter(kind).orderBy("h").limit(max_calibration) for kind in ((F.col("good") == 1) & fold, F.col("good") == 0)]  # bad texts are in no model
    check = F.broadcast(checks[0].unionByName(checks[1]).groupBy(F.col("id").alias("_check")).agg(F.min("good").alias("_good")))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).join(check, F.col("_id") == F.col("_check"), "left")
    raw = rows.select("_good", mean_log_ratio(model, F.col("_text"))["mean"].alias("mean"), gumbel(F.col("_id"), F.coalesce("_text", F.lit("")), seed).alias("noise"))
    scored = saved(raw, "quality-scores").filter("mean IS NOT NULL")
    fold_rows = scored.filter("_good IS NOT NULL").select("_good", "mean").toPandas()  # bounded by max_calibration
    values, kind = fold_rows["mean"].to_numpy(float), fold_rows["_good"].to_numpy(int)
    good, bad = values[kind == 1], values[kind == 0]
    cut = best_cut(good, bad)
    known = np.isfinite(cut)
    cut = cut if known else 0.0
    scale = scale or (log_odds_scale(good, bad, cut) if known else 1.0)
    weight = (F.col("mean") - F.lit(cut)) * scale
    n, expected = scored.agg(F.count("*"), F.sum(1 - F.exp(-F.exp(F.least(weight, F.lit(50.0)))))).first()
    k = min(n, k if k is not None else round(expected or 0) if known else n)
    threshold = kth_largest(scored.select((weight + F.col("noise")).alias("key")), k) if k else float("inf")
    return Selection(model, cut, k, threshold, scale, seed)


def resampled(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The selected rows of ``docs``, with its columns."""
    found = resample(docs, labels, id_col=id_col, text_col=text_col, **options)
    names = docs.columns
    safe = docs.select([F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    at = {c: f"c{i}" for i, c in enumerate(names)}
    kept = found.columns(safe, id_col=at[id_col], text_col=at[text_col]).filter("_selected")
    return kept.select([F.col(at[c]).alias(c) for c in names])


def quality_scores(spark: SparkSession, docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: id, n_ngrams, log_weight, gumbel_key, selected."""
    found = resample(docs, labels, **options)
    rows = docs.select(F.col(options.get("id_col", "doc_id")).alias("id"), F.col(options.get("text_col", "text")).alias("text"))
    out = found.columns(rows, id_col="id", text_col="text")
    return out.select("id", F.col("_n_ngrams").alias("n_ngrams"), F.col("_log_weight").alias("log_weight"), F.col("_key").alias("gumbel_key"), F.col("_selected").alias("selected"))
