"""Mix sources to target weights by capped water-filling.

Every source asks for a share of the total size by its weight; a source stops at ``max_epochs`` times its own size and
what it leaves is shared again by weight, until no source is above its cap. A source's documents are then repeated whole
as often as the target holds its size, and the remaining fraction is sampled: documents in a seeded order as long as the
remainder holds them. Where a long document stops that early, sources that still miss ``MISS`` of their target go through
the documents left that fit, ``FILLS`` times at most; at last the one document nearest to what is missing is added if it helps.

Texts are dropped before any shuffle. Sizes are summed per (source, slot of the seeded order), so the running sum that
finds the border covers at most ``SLOTS`` sums per source, 256 in one task, and only the border slot of a source is put in order row by row;
a source with a third of all rows is spread over its slots. The source table is numbered over range partitions and the
water level is found by whole-table sums, so the number of sources is not bound by one task either.

Defined cases: null or empty text has size 0, takes nothing and is not in the mixed corpus; null sources form one source, which comes last; a source
of size 0 has target 0; rows that repeat an id and a size in a source are taken alike in the mixed corpus; an empty
table gives an empty one; the columns read are named by parameters and no others are touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedge.functions.storage import saved, saved_with
from sedge.llm.common import safe_names
from sedge.llm.ranks import with_rank

SLOTS = 1 << 16
FILLS, MISS = 3, 0.002
#: Tables with a row per source are broadcast while there are at most so many sources (some 100 bytes each).
BROADCAST_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def seeded_order(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))


def water_level(sources: DataFrame) -> DataFrame:
    """(key, weight, size, cap) -> target. ``sources`` is read several times and must be cheap to read."""
    total = sources.agg(F.sum("size").alias("t")).first()["t"] or 0
    level = 0.0
    while True:
        full = F.col("cap") <= level * F.col("weight")
        row = sources.agg(F.sum(F.when(full, F.col("cap"))).alias("used"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if not row["open"]:
            break
        new = (total - (row["used"] or 0.0)) / row["open"]
        if new <= level:
            break
        level = new
    return sources.withColumn("target", F.least(F.col("cap"), F.lit(float(level)) * F.col("weight")))


def mix_plan(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[float, ...] = (1.0, 2.0, 3.0), max_epochs: float = 3.0, seed: int = 7) -> DataFrame:
    """One row per document: id, source, size, source_size, target, copies, taken. Weights go to the sources in code-point order, repeating."""
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col)).alias("size"), seeded_order(id_col, seed).alias("u"),
    )
    rows = rows.withColumn("key", F.struct(F.col("source").isNull().alias("last"), F.coalesce("source", F.lit("")).alias("name")))
    rows = saved(rows.withColumn("slot", F.conv(F.substring("u", 1, 4), 16, 10).cast("int")), "mix-sizes")
    slots = rows.groupBy("key", "slot").agg(F.sum("size").alias("in_slot"))
    ranked = with_rank(slots.groupBy("key").agg(F.sum("in_slot").alias("size")), [F.col("key")], "nth")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("nth") - 1, F.lit(len(weights))) + 1).cast("int"))
    sources = saved(ranked.select("key", "size", weight.alias("weight"), (F.col("size") * float(max_epochs)).alias("cap")), "mix-sources")
    few = sources.count() <= BROADCAST_SOURCES

    def per_source(table: DataFrame) -> DataFrame:
        return F.broadcast(table) if few else table

    targets = water_level(sources).select("key", F.col("size").alias("source_size"), "target")
    targets = targets.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    targets = targets.withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    targets = saved(targets, "mix-targets")  # small tables that several steps read are written, so that no plan holds the steps before it over and over
    chosen = _taken_in_order(rows, per_source(targets.select("key", F.col("rest").alias("room"))))
    for _ in range(FILLS):
        chosen = saved(chosen, "mix-chosen")
        short, n_short = saved_with(_missing(chosen, targets).filter(F.col("missing") > MISS * F.col("target")), "mix-short", F.count(F.lit(1)))
        if not n_short:
            break
        fits = chosen.filter("extra = 0 AND size > 0").join(per_source(short), "key").filter("size <= missing").select(rows.columns)
        fits = saved(fits, "mix-fits")
        more = _taken_in_order(fits, per_source(short.select("key", F.col("missing").alias("room")))).filter("extra = 1").select("key", "u", "size", "id", F.lit(1).alias("added")).distinct()
        chosen = chosen.alias("c").join(more.alias("m"), _same_row("c", "m"), "left").select(*[F.col(f"c.{c}") for c in rows.columns], F.coalesce(F.col("m.added"), F.col("c.extra")).cast("long").alias("extra"))
    chosen = saved(chosen, "mix-chosen")
    # One more document per source: of those left, the one nearest to what is missing.
    missing = saved(_missing(chosen, targets), "mix-missing")
    off = F.abs(F.col("size") - F.col("missing"))
    left = chosen.filter("extra = 0 AND size > 0").join(per_source(missing), "key").filter(off < F.col("missing"))
    last = left.groupBy("key").agg(F.min(F.struct(off.alias("off"), F.col("u").alias("u"), F.col("size").alias("size"), F.col("id").alias("id"))).alias("m"))
    last = last.select("key", "m.u", "m.size", "m.id", F.lit(1).alias("added"))
    both = chosen.alias("c").join(per_source(last).alias("m"), _same_row("c", "m"), "left").select("c.*", "m.added").join(per_source(targets), "key")
    copies = F.when(F.col("size") > 0, F.col("whole") + F.greatest(F.col("extra"), F.coalesce("added", F.lit(0)))).otherwise(0).cast("long")
    return both.select("id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def _same_row(a: str, b: str) -> Column:
    same = [F.col(f"{a}.{c}") == F.col(f"{b}.{c}") for c in ("key", "u", "size")]
    return same[0] & same[1] & same[2] & F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id"))


def _missing(chosen: DataFrame, targets: DataFrame) -> DataFrame:
    got = chosen.groupBy("key").agg(F.sum(F.col("extra") * F.col("size")).alias("got"))
    return got.join(targets, "key").select("key", "target", (F.col("rest") - F.col("got")).alias("missing"))


def _taken_in_order(rows: DataFrame, room: DataFrame) -> DataFrame:
    """``rows`` with extra = 1 as long as the running sum of sizes of the key, ordered by (u, size, id), stays within its room."""
    slots = rows.groupBy("key", "slot").agg(F.sum("size").alias("in_slot")).withColumn("stretch", F.shiftright("slot", 8))
    # Sums before a slot: those of the stretches of 256 slots before its own, and those of the slots before it there.
    earlier = lambda by, order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    stretches = slots.groupBy("key", "stretch").agg(F.sum("in_slot").alias("in_stretch"))
    stretches = stretches.select("key", "stretch", F.coalesce(F.sum("in_stretch").over(earlier(["key"], "stretch")), F.lit(0)).alias("before_stretch"))
    slots = slots.join(stretches, ["key", "stretch"]).withColumn("before", F.col("before_stretch") + F.coalesce(F.sum("in_slot").over(earlier(["key", "stretch"], "slot")), F.lit(0)))
    after = F.col("before") + F.col("in_slot")
    placed = slots.join(room, "key").select("key", "slot", "room", "before", (after <= F.col("room")).alias("inside"), (F.col("before") < F.col("room")).alias("begun"))
    joined = rows.join(saved(placed, "mix-placed"), ["key", "slot"])
    inner = Window.partitionBy("key", "slot").orderBy("u", "size", "id").rowsBetween(Window.unboundedPreceding, 0)
    fits = F.col("before") + F.sum("size").over(inner) <= F.col("room")
    ordered = joined.filter("begun AND NOT inside").withColumn("extra", fits.cast("long"))
    plain = joined.filter("inside OR NOT begun").withColumn("extra", F.col("inside").cast("long"))
    return plain.unionByName(ordered).select(*rows.columns, "extra")


def mix(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as the plan takes it, with the columns of ``docs``."""
    safe, at = safe_names(docs)
    plan = mix_plan(safe, id_col=at[id_col], source_col=at[source_col], text_col=at[text_col], **options)
    taken = plan.groupBy("id", "source", "size").agg(F.max("copies").cast("int").alias("copies")).filter("copies > 0")
    same = safe[at[id_col]].eqNullSafe(taken["id"]) & safe[at[source_col]].cast("string").eqNullSafe(taken["source"]) & (word_count(safe[at[text_col]]) == taken["size"])
    joined = safe.join(taken, same).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return joined.select([F.col(at[c]).alias(c) for c in docs.columns])
