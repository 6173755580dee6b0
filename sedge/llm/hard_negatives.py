"""Hard negatives by slots: rows of another label whose score against an anchor lies just below that of a positive.

An anchor's positives are its ``positives`` best rows of its own label. Each positive has a window of scores, from ``percent`` hundredths of
its own score up to it, and windows of one anchor overlap. The positives' scores, as upper limits, split all scores into disjoint
slots: slot j holds what is over the next lower limit and not over the j-th. A combiner keeps the ``k`` best of each slot, so what a block of rows
hands on is bounded whatever its size. A window's answer is then found by merging slots downwards: as slots are disjoint and come in order,
their kept rows laid end to end are sorted, and the first k of the suffix that starts at a positive's slot are the best k that are not over its score.
Those below the window's lower limit are cut off; no window is scanned twice.

Every row meets every anchor in blocks: positives only in the blocks of the anchor's own label, negatives in blocks dealt by a hash of the
id. A label that holds a third of all rows is split into as many blocks as it needs. Scores are integer: components are floor(scale * x), and products are
made in double precision while they must be exact there (all sums below 2^53), else in 64-bit integers.

Defined cases: rows with a null id, a null label, a null vector, or a null or non-finite component, and rows whose dimension is not the most
common one (the smaller of equally common ones) take no part; of rows that share an id the first by (label, vector) counts; equal scores go by the smaller id; an anchor without positives or with
positives below zero has no rows for them; an empty table gives an empty one; only the named columns are read. Vectors so large that
a score may leave 64 bits are refused with a ValueError.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedge.functions.storage import saved

#: Scores of one step of a task at most; a step takes as many anchors as that allows.
STEP = 1 << 21
FOUND = "anchor_id long, slot int, id long, score long"


def integer_rows(vectors: DataFrame, label: Column, *, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, label, v) with v as array<long>, one row per id, of the rows that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), F.col(vec_col).cast("array<double>").alias("v")).filter("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x))
    one = rows.filter(finite).groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", F.col("r.v").alias("v"))
    return one.select("id", "label", whole.alias("v"))


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def best_in_slots(anchors: pa.Table, block: pa.Table, *, dim: int, exact: bool, same: bool, k: int, percent: int) -> pa.Table:
    """The k best rows of ``block`` in each slot of each anchor: of its label if ``same`` (one slot without limits), else of other labels."""
    if not anchors.num_rows or not block.num_rows:
        return pa.table({"anchor_id": pa.array([], pa.int64()), "slot": pa.array([], pa.int32()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
    order = np.argsort(block.column("id").to_numpy())
    ids, labels = block.column("id").to_numpy()[order], block.column("label").combine_chunks().dictionary_encode()
    names = {v: i for i, v in enumerate(labels.dictionary.to_pylist())}
    labels = labels.indices.to_numpy()[order]
    kind = np.float64 if exact else np.int64
    rows = _matrix(block.column("v"), dim)[order].astype(kind)
    out = []
    at_once = max(1, STEP // max(1, len(ids)))
    for part in (anchors.slice(i, at_once) for i in range(0, anchors.num_rows, at_once)):
        own = part.column("id").to_numpy()
        mine = np.array([names.get(x, -1) for x in part.column("label").to_pylist()])
        scores = (_matrix(part.column("v"), dim).astype(kind) @ rows.T).astype(np.int64)
        if same:
            seen = (mine[:, None] == labels[None]) & (own[:, None] != ids[None])
            if scores.shape[1] > k:  # what is below the k-th best of the block cannot stay
                masked = np.where(seen, scores, np.iinfo(np.int64).min)
                seen &= scores >= np.partition(masked, -k, axis=1)[:, [-k]]
            row, col = np.nonzero(seen)
            slot = np.zeros(len(row), np.int64)
        else:
            limits = part.column("limits").to_pylist()  # descending, none below zero
            top = np.array([x[0] for x in limits], np.int64)
            least = np.array([-(-percent * x[-1] // 100) for x in limits], np.int64)
            row, col = np.nonzero((mine[:, None] != labels[None]) & (scores <= top[:, None]) & (scores >= least[:, None]))
            padded = np.full((len(own), max(map(len, limits))), -1, np.int64)
            for i, x in enumerate(limits):
                padded[i, : len(x)] = x
            slot = (padded[row] >= scores[row, col][:, None]).sum(axis=1) - 1
        found = scores[row, col]
        by = np.lexsort((ids[col], -found, slot, row))
        row, col, slot, found = row[by], col[by], slot[by], found[by]
        group = row * (int(slot.max()) + 1 if len(slot) else 1) + slot
        keep = np.arange(len(group)) - np.searchsorted(group, group) < k
        out.append(pa.table({"anchor_id": pa.array(own[row[keep]], pa.int64()), "slot": pa.array(slot[keep], pa.int32()), "id": pa.array(ids[col[keep]], pa.int64()), "score": pa.array(found[keep], pa.int64())}))
    return pa.concat_tables(out)


def _dealt(df: DataFrame, name: str, n: int) -> DataFrame:
    """``df`` with its rows dealt into ``n`` groups by a hash of the id."""
    return df.withColumn(name, F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, *, id_col: str = "vec_id", vec_col: str = "embedding", label: Column | str = "label",
    scale: int = 256, positives: int = 5, k: int = 5, percent: int = 80, block: int = 8192, anchor_block: int = 8192,
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score: for each row that ``is_anchor`` (a condition on the id as
    ``id``) names and each of its positives the k best rows of other labels within the positive's window.

    ``block`` and ``anchor_block`` are about how many rows and anchors one task multiplies; they change no result.
    """
    label = F.col(label) if isinstance(label, str) else label
    rows = integer_rows(vectors, label, id_col=id_col, vec_col=vec_col, scale=scale)
    rows = saved(rows.withColumn("most", F.array_max(F.transform("v", F.abs))), "negative-rows")
    empty = vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    first = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max("most").alias("most")).orderBy(F.desc("n"), "dim").first()
    if first is None or first["dim"] == 0:
        return empty
    dim, total, bound = first["dim"], first["n"], first["dim"] * int(first["most"]) ** 2
    if bound >= 1 << 63:
        raise ValueError("scores of these vectors may leave 64 bits: scale them down first")
    rows = rows.filter(F.size("v") == dim).drop("most")
    anchors = saved(rows.filter(is_anchor), "negative-anchors")
    if anchors.isEmpty():
        return empty
    options = dict(dim=dim, exact=bound < 1 << 53, k=k, percent=percent)
    n_groups = -(-anchors.count() // anchor_block)

    # Positives: an anchor visits the blocks of its own label; a label has as many as it needs.
    deals = rows.groupBy("label").agg(F.ceil(F.count("*") / block).cast("int").alias("deals"))
    deals = saved(deals.join(anchors.groupBy("label").agg(F.ceil(F.count("*") / anchor_block).cast("int").alias("a_deals")), "label"), "negative-deals")
    mine = anchors.join(deals, "label").withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1))).withColumn("a_deal", F.pmod(F.xxhash64("id"), "a_deals").cast("int"))
    theirs = rows.join(deals, "label").withColumn("deal", F.pmod(F.xxhash64("id"), "deals").cast("int")).withColumn("a_deal", F.explode(F.sequence(F.lit(0), F.col("a_deals") - 1)))
    keys = ["label", "deal", "a_deal"]

    def own(a: pa.Table, b: pa.Table) -> pa.Table:
        return best_in_slots(a, b, same=True, **options | {"k": positives})

    best = mine.drop("deals", "a_deals").groupBy(*keys).cogroup(theirs.drop("deals", "a_deals").groupBy(*keys)).applyInArrow(own, FOUND)
    by_score = [F.desc("score"), F.col("id")]
    nth = F.row_number().over(Window.partitionBy("anchor_id").orderBy(*by_score))
    near = saved(best.withColumn("nth", nth).filter(F.col("nth") <= positives).filter("score >= 0").select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    limits = near.groupBy(F.col("anchor_id").alias("id")).agg(F.reverse(F.array_sort(F.collect_set("positive_score"))).alias("limits"))  # at most ``positives`` each

    # Negatives: every anchor with a window visits every block.
    n_blocks = -(-total // block)
    every = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))
    a = _dealt(anchors.join(limits, "id"), "group", n_groups).withColumn("block", every)
    b = _dealt(rows, "block", n_blocks).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))

    def other(a: pa.Table, b: pa.Table) -> pa.Table:
        return best_in_slots(a, b, same=False, **options)

    found = a.groupBy("block", "group").cogroup(b.groupBy("block", "group")).applyInArrow(other, FOUND)
    in_slot = F.row_number().over(Window.partitionBy("anchor_id", "slot").orderBy(*by_score))
    kept = found.withColumn("nth", in_slot).filter(F.col("nth") <= k)

    # Suffixes: of an anchor's kept rows, best first, each positive takes the first k that are not over its score.
    laid = kept.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("away"), "id"))).alias("laid"))  # at most positives * k each
    answers = near.join(laid, "anchor_id").withColumn("best", F.slice(F.filter("laid", lambda x: -x["away"] <= F.col("positive_score")), 1, k))
    each = answers.select("anchor_id", "positive_id", "positive_score", F.posexplode("best").alias("at", "x"))
    out = each.select("anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias("negative_id"), "positive_score", (-F.col("x.away")).alias("negative_score"))
    p, n = (F.col(c).cast("decimal(20,0)") for c in ("positive_score", "negative_score"))  # a hundred times a score may leave 64 bits
    return out.filter(F.lit(percent) * p <= F.lit(100) * n)
