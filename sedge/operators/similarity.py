"""Vector similarity over tables. Vectors are normalised first, so a cosine is a sum of products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedge.functions.embedding import trigram_slots
from sedge.functions.joins import percentiles
from sedge.functions.storage import saved
from sedge.operators.graph import components

#: Rows of a block; each block meets each other one that it may share a pair with in a task of its own.
BLOCK = 4096
#: Vectors whose angles tell which blocks lie too far apart.
PIVOTS = 64


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def normalised(df: DataFrame, *, id: str, vector: str) -> DataFrame:
    """(id, v): unit vectors as array<double>; zero and null vectors are left out."""
    v = F.col(vector).cast("array<double>")
    length = F.sqrt(dot(v, v))
    return df.filter(F.col(vector).isNotNull()).withColumn("_n", length).filter("_n > 0").select(F.col(id).alias("id"), F.transform(v, lambda x: x / F.col("_n")).alias("v"))


def trigram_counts(df: DataFrame, *, id: str, text: str, dim: int = 384) -> DataFrame:
    """(id, slot, n): hashed character-trigram counts, a text's own, taken where its row is; texts under three characters give none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                rows, slots, n = [np.empty(0, np.int64)], [np.empty(0, np.int32)], [np.empty(0, np.int64)]
                for i, one in enumerate(part.column("text")):
                    found = trigram_slots(one.as_py(), dim)
                    if found is not None:
                        at = np.flatnonzero(found)
                        rows.append(np.full(len(at), i))
                        slots.append(at.astype(np.int32))
                        n.append(found[at])
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(slots)), pa.array(np.concatenate(n))], ["id", "slot", "n"])

    long = df.filter(F.length(text) >= 3).select(F.col(id).alias("id"), F.lower(F.col(text)).alias("text"))
    return long.mapInArrow(count, f"id {df.schema[id].dataType.simpleString()}, slot int, n long").withColumnRenamed("id", id)


def trigram_vectors(df: DataFrame, *, id: str, text: str, dim: int = 384) -> DataFrame:
    """(id, v): dense L2-normalised vectors of the hashed trigram counts."""
    sparse = trigram_counts(df, id=id, text=text, dim=dim).groupBy(id).agg(F.map_from_entries(F.collect_list(F.struct("slot", F.col("n").cast("double")))).alias("m"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("len"))
    return sparse.select(F.col(id).alias("id"), F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0)) / F.col("len")).alias("v"))


def _blocks(vectors: DataFrame) -> int:
    return max(1, -(-vectors.count() // BLOCK))


def _block_of(blocks: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")


def _products(placed: DataFrame, least: float) -> DataFrame:
    """(a, b, i, j, similarity) of all side-0 and side-1 rows (id, v) of a block pair (i, j) with cosine of at least ``least``."""
    kind = placed.schema["id"].dataType.simpleString()

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        dim, i, j = (k.as_py() for k in key)
        sides = [table.filter(pc.equal(table["side"], s)) for s in (0, 1)]
        left, right = (pc.list_flatten(t["v"]).to_numpy().reshape(t.num_rows, dim) for t in sides)
        at, to, score = [], [], []
        for start in range(0, len(left), 256):
            cosine = left[start : start + 256] @ right.T
            x, y = np.nonzero(cosine >= least - 1e-6)
            at.append(x + start)
            to.append(y)
            score.append(cosine[x, y])
        flat = [np.concatenate(p) if p else np.empty(0, t) for p, t in ((at, np.int64), (to, np.int64), (score, np.float64))]
        n = len(flat[0])
        a, b = (t["id"].combine_chunks().take(pa.array(p)) for t, p in zip(sides, flat[:2], strict=True))
        return pa.table({"a": a, "b": b, "i": pa.array(np.full(n, i), pa.int32()), "j": pa.array(np.full(n, j), pa.int32()), "similarity": flat[2]})

    rows = placed.withColumn("dim", F.size("v")).select("dim", "i", "j", "side", "id", "v")
    out = rows.groupBy("dim", "i", "j").applyInArrow(compare, f"a {kind}, b {kind}, i int, j int, similarity double")
    return out.withColumn("similarity", F.round("similarity", 6)).filter(F.col("similarity") >= least)


def similar(df: DataFrame, query: DataFrame, *, id: str, vector: str, k: int = 5, least: float = 0.7) -> DataFrame:
    """(query_id, id, similarity): for each row of ``query`` (the same columns) the best k other rows with cosine of at least ``least``."""
    rows, asked = saved(normalised(df, id=id, vector=vector), "unit-vectors"), saved(normalised(query, id=id, vector=vector), "query-vectors")
    n, m = _blocks(asked), _blocks(rows)
    left = asked.select("id", "v", _block_of(n).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("j"), F.lit(0).alias("side"))
    right = rows.select("id", "v", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"), _block_of(m).alias("j"), F.lit(1).alias("side"))
    scored = _products(left.unionByName(right), least).filter("a <> b")
    w = Window.partitionBy("a").orderBy(F.desc("similarity"), "b")
    return scored.withColumn("_nth", F.row_number().over(w)).filter(F.col("_nth") <= k).select(F.col("a").alias("query_id"), F.col("b").alias("id"), "similarity")


def outliers(df: DataFrame, *, id: str, vector: str, contamination: float = 0.1, least_rows: int = 10) -> DataFrame:
    """Rows whose mean cosine to all rows is at or under the given percentile. Linear: the mean is the product with the mean vector."""
    unit = normalised(df, id=id, vector=vector)
    mean = unit.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"))
    centre = mean.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))  # one row of the vectors' dimension
    scored = saved(unit.join(F.broadcast(centre)).select("id", F.round(dot(F.col("v"), F.col("c")), 9).alias("mean_similarity")), "mean-similarity")
    cut = percentiles(scored, by=[], value="mean_similarity", p=contamination)
    return scored.join(F.broadcast(cut)).filter((F.col("n") >= least_rows) & (F.col("mean_similarity") <= F.col("percentile"))).select("id", "mean_similarity")


def _vector_classes(df: DataFrame, *, id: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """(id, rep) of all rows and (id, v) of representatives: rows of equal unit vectors are one class, its least id stands for it."""
    unit = saved(normalised(df, id=id, vector=vector), "unit-vectors")
    reps = saved(unit.groupBy("v").agg(F.min("id").alias("id")).select("id", "v"), "vector-classes")
    members = unit.join(reps.withColumnRenamed("id", "rep"), "v").select("id", "rep")
    return saved(members, "class-members"), reps


def block_plan(reps: DataFrame, least: float, *, pivots: int = PIVOTS) -> tuple[DataFrame, DataFrame]:
    """((id, v, block) of all vectors, (i, j) of the block pairs, i <= j, that may hold a pair with cosine of at least ``least``).

    Up to ``pivots`` vectors, drawn by a hash, are pivots. A vector goes to the cell of its nearest pivot, and cells are dealt into blocks of about BLOCK rows. A block keeps, for each pivot, the least
    and largest angle of its vectors to it. By the triangle inequality two vectors lie at least as far apart as their angles to any pivot differ, so a pair of blocks is left out if
    for some pivot its intervals are further apart than the angle of ``least``. Nothing is estimated: on vectors without clusters all pairs stay. Vectors of another dimension than
    the pivots' have intervals that exclude nothing.
    """
    drawn = reps.orderBy(F.xxhash64("id"), "id").limit(pivots).select("v").collect()  # a bounded number of vectors
    if not drawn:
        return reps.withColumn("block", F.lit(0)), reps.select(F.lit(0).alias("i"), F.lit(0).alias("j")).limit(0)
    dim = len(drawn[0]["v"])
    axes = np.array([r["v"] for r in drawn if len(r["v"]) == dim], float).reshape(-1, dim)
    kind = reps.schema["id"].dataType.simpleString()

    def measure(batches):
        for b in batches:
            n = b.num_rows
            angles = np.tile([0.0, np.pi], (n, len(axes), 1))
            sizes = pc.list_value_length(b.column("v")).to_numpy(zero_copy_only=False)
            same = np.flatnonzero(sizes == dim)
            if len(same):
                rows = pc.list_flatten(b.column("v").take(pa.array(same))).to_numpy().reshape(len(same), dim)
                angles[same] = np.arccos(np.clip(rows @ axes.T, -1, 1))[:, :, None]
            cell = np.full(n, -1, np.int32)
            cell[same] = angles[same, :, 0].argmin(axis=1)
            lists = lambda x: pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(x).ravel()), len(axes)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(cell), lists(angles[:, :, 0]), lists(angles[:, :, 1])], names=["id", "v", "cell", "low", "high"])

    measured = saved(reps.select("id", "v").mapInArrow(measure, f"id {kind}, v array<double>, cell int, low array<double>, high array<double>"), "measured")
    cells = measured.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("deals"))  # ``pivots`` + 1 rows at most
    first = F.coalesce(F.sum("deals").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    dealt = measured.join(F.broadcast(cells.withColumn("first", first)), "cell")
    dealt = saved(dealt.withColumn("block", (F.col("first") + F.pmod(F.xxhash64("id"), "deals")).cast("int")).select("id", "v", "block", "low", "high"), "dealt")
    spans = dealt.select("block", F.posexplode(F.arrays_zip("low", "high")).alias("k", "x")).groupBy("block", "k").agg(F.min("x.low").alias("low"), F.max("x.high").alias("high"))
    blocks = saved(spans.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("k", "low", "high"))).alias("spans")), "blocks")
    n_blocks = cells.agg(F.sum("deals")).first()[0]
    left = blocks.select(F.col("block").alias("i"), F.col("spans").alias("a"), F.explode(F.sequence(F.col("block"), F.lit(int(n_blocks) - 1))).alias("j"))
    both = left.join(blocks.select(F.col("block").alias("j"), F.col("spans").alias("b")), "j")
    reach = float(np.arccos(np.clip(least - 1e-6, -1, 1))) + 1e-6
    apart = F.exists(F.zip_with("a", "b", lambda x, y: F.greatest(x["low"] - y["high"], y["low"] - x["high"])), lambda d: d > reach)
    return dealt.select("id", "v", "block"), saved(both.filter(~apart).select("i", "j"), "block-pairs")


def _rep_pairs(reps: DataFrame, least: float) -> DataFrame:
    rows, blocks = block_plan(reps, least)
    left = rows.withColumnRenamed("block", "i").join(blocks, "i").select("id", "v", "i", "j", F.lit(0).alias("side"))
    right = rows.withColumnRenamed("block", "j").join(blocks, "j").select("id", "v", "i", "j", F.lit(1).alias("side"))  # a block meets itself: both sides
    pairs = _products(left.unionByName(right), least).filter("a <> b AND (i <> j OR a < b)")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")


def similar_pairs(df: DataFrame, *, id: str, vector: str, least: float) -> DataFrame:
    """All pairs (a < b, similarity) with cosine of at least ``least``; one vector per id.

    Blocks of class representatives are compared with all others but those that ``block_plan`` proves too far away, so no pair is missed; on vectors
    without clusters the work grows with the square of the number of distinct vectors.
    """
    members, reps = _vector_classes(df, id=id, vector=vector)
    found = saved(_rep_pairs(reps, least), "class-pairs")
    ma, mb = members.select(F.col("id").alias("x"), F.col("rep").alias("a")), members.select(F.col("id").alias("y"), F.col("rep").alias("b"))
    across = found.join(ma, "a").join(mb, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")
    self = reps.select(F.col("id").alias("a"), F.round(dot(F.col("v"), F.col("v")), 6).alias("similarity")).filter(F.col("similarity") >= least)
    inside = self.join(ma, "a").join(mb.withColumnRenamed("b", "a"), "a").filter("x < y").select(F.col("x").alias("a"), F.col("y").alias("b"), "similarity")
    return across.unionByName(inside)


def similar_links(df: DataFrame, *, id: str, vector: str, least: float) -> DataFrame:
    """Pairs (a, b) with the components of ``similar_pairs``: of equal vectors each meets its representative only."""
    members, reps = _vector_classes(df, id=id, vector=vector)
    equal = reps.filter(F.round(dot(F.col("v"), F.col("v")), 6) >= least).select(F.col("id").alias("rep"))
    return _rep_pairs(reps, least).select("a", "b").unionByName(members.filter("id <> rep").join(equal, "rep", "left_semi").select(F.col("rep").alias("a"), F.col("id").alias("b")))


def duplicate_groups(pairs: DataFrame) -> DataFrame:
    """(id, group_id): connected components of the similarity pairs."""
    return components(pairs, src="a", dst="b").select(F.col("node").alias("id"), F.col("component").alias("group_id"))


def boilerplate_groups(pairs: DataFrame, items: DataFrame, *, id: str, doc: str, least_docs: int = 3) -> DataFrame:
    """(leader, id): in id order an unused item leads and absorbs later unused neighbours; groups of at least ``least_docs`` items from as many documents.

    In rounds: an item leads once all its earlier neighbours are known to be absorbed; it absorbs those later neighbours that have no earlier open neighbour or leader.
    """
    e = saved(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "bp-edges")
    open_items = saved(e.select(F.col("a").alias("i")).unionByName(e.select(F.col("b").alias("i"))).distinct(), "bp-open")
    found, leaders = None, open_items.limit(0)
    while not open_items.isEmpty():
        there = open_items.unionByName(leaders).select(F.col("i").alias("a"))
        live = e.join(there, "a", "left_semi").join(open_items.select(F.col("i").alias("b")), "b", "left_semi")
        leads = saved(open_items.join(live.select(F.col("b").alias("i")).distinct(), "i", "left_anti"), "bp-leads")
        leaders = saved(leaders.unionByName(leads), "bp-leaders")
        first = live.groupBy(F.col("b").alias("i")).agg(F.min("a").alias("a"))  # only a leader that comes before all open neighbours takes an item
        taken = saved(first.join(leaders.select(F.col("i").alias("a")), "a").select("i", F.col("a").alias("leader")), "bp-taken")
        now = leads.select("i", F.col("i").alias("leader")).unionByName(taken.select("i", "leader"))
        found = now if found is None else found.unionByName(now)
        open_items = saved(open_items.join(now.select("i"), "i", "left_anti"), "bp-open")
    if found is None:
        return open_items.select(F.col("i").alias("leader"), F.col("i").alias("id"))
    named = found.join(items.select(F.col(id).alias("i"), F.col(doc).alias("_d")), "i")
    big = named.groupBy("leader").agg(F.count("*").alias("n"), F.countDistinct("_d").alias("d")).filter((F.col("n") >= least_docs) & (F.col("d") >= least_docs))
    return named.join(big, "leader").select("leader", F.col("i").alias("id"))


def common_types(df: DataFrame, *, doc: str, kind: str) -> DataFrame:
    """Kinds that occur in every document."""
    n = df.select(F.countDistinct(doc).alias("_n"))
    per = df.groupBy(kind).agg(F.countDistinct(doc).alias("n_docs"))
    return per.join(F.broadcast(n), F.col("n_docs") == F.col("_n")).select(kind, "n_docs")


def exact_duplicates(df: DataFrame, *, id: str, text: str) -> DataFrame:
    """(digest, first_id, n) of texts held more than once."""
    return df.groupBy(F.md5(F.col(text)).alias("digest")).agg(F.min(id).alias("first_id"), F.count("*").alias("n")).filter("n > 1")
