"""Structured Streaming jobs over append-only logs. Each runs until the input at hand is used up and returns what it wrote.

Results and checkpoints go to the folder the cluster shares; a batch that is run again overwrites its own output.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedge.functions.storage import fresh_path


def read_stream(spark: SparkSession, path: str, *, max_files: int | None = None) -> DataFrame:
    """Parquet files under a path (a folder or one file) as a stream with the files' schema."""
    parent, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(f"{parent}/{{{name}}}")


def run(stream: DataFrame, *, mode: str, name: str, root: str | None = None, batch: Callable[[DataFrame, int], DataFrame] | None = None, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Run to the end of the input. "complete": the last batch's table; "update" and "append": all batches' rows, with the batch they came in for "update".

    With the same ``root`` a later call goes on where the last one ended, also after a crash, and returns what all calls wrote.
    """
    spark = stream.sparkSession
    root = root or fresh_path(spark, f"stream-{name}")
    if hasattr(stream, "each_batch"):  # a job that keeps its own state
        batch = stream.each_batch(root)

    def keep(df: DataFrame, batch_id: int) -> None:
        out = batch(df, batch_id) if batch else df
        writer = out.write.mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{root}/out/batch={batch_id}")

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{root}/log").trigger(availableNow=True).start().awaitTermination()
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/out")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return spark.createDataFrame([], getattr(stream, "out_schema", stream.schema))
    done = sorted(int(f.getPath().getName().split("=")[1]) for f in files.listStatus(folder) if f.getPath().getName().startswith("batch="))
    if mode == "complete":
        return spark.read.parquet(f"{root}/out/batch={done[-1]}")
    out = spark.read.option("basePath", f"{root}/out").option("mergeSchema", True).parquet(*[f"{root}/out/batch={i}" for i in done])
    return out if mode == "update" else out.drop("batch")


def latest(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows written in update mode the last one of each key: the state of the result table."""
    rest = [c for c in updates.columns if c not in (*keys, "batch")]
    last = updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_last"))
    return last.select(*keys, *[F.col(f"_last.{c}") for c in rest])


def with_time(events: DataFrame, ts: str, delay: str) -> DataFrame:
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def ingest(events: DataFrame, *, raw: str, schema: str, ts: str) -> DataFrame:
    """Typed ingest: parse a JSON column, mark rows that do not parse, add the day to partition by."""
    parsed = F.from_json(raw, schema)
    return events.withColumn("_p", parsed).withColumn("quarantined", F.col("_p").isNull()).withColumn("day", F.to_date(ts)).drop("_p")


def event_windows(events: DataFrame, *, ts: str, kind: str, value: str, size: str, slide: str | None = None) -> DataFrame:
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    out = events.groupBy(w.alias("w"), kind).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean_value"))
    return out.select(F.col("w.start").alias("window_start"), kind, "n", "mean_value")


def sessions(events: DataFrame, *, ts: str, entity: str, gap: str) -> DataFrame:
    out = events.groupBy(F.session_window(ts, gap).alias("w"), entity).agg(F.count("*").alias("n"))
    return out.select(entity, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def span_join(starts: DataFrame, ends: DataFrame, *, entity: str, ts: str, id: str, within: str, unmatched: bool = False) -> DataFrame:
    """Interval join of two streams: each end with the entity's starts at most ``within`` before it. Both need a watermark on ``ts``.

    With ``unmatched`` a start without an end, and an end without a start, comes out once the watermark has passed the time
    in which a partner could still come; its partner and seconds are null.
    """
    if unmatched:
        return _span_join_outer(starts, ends, entity=entity, ts=ts, id=id, within=within)
    s = starts.select(F.col(entity).alias("s_entity"), F.col(id).alias("start_id"), F.col(ts).alias("s_ts"))
    e = ends.select(F.col(entity).alias("e_entity"), F.col(id).alias("end_id"), F.col(ts).alias("e_ts"))
    on = F.expr(f"s_entity = e_entity AND e_ts >= s_ts AND e_ts <= s_ts + INTERVAL {within}")
    return s.join(e, on).select("start_id", "end_id", F.round((F.unix_micros("e_ts") - F.unix_micros("s_ts")) / 1e6, 3).alias("seconds"))


def _span_join_outer(starts: DataFrame, ends: DataFrame, *, entity: str, ts: str, id: str, within: str) -> DataFrame:
    """``span_join`` with the rows that find no partner. ``run`` does it batch by batch.

    The state, rows that a partner could still meet and whether one has, is a table that each batch writes anew: one shuffle a batch, and no state store per task, side and key. A task
    walks its entities' rows in time and holds the starts of one ``within``. The slower stream sets the watermark; rows without a time, and rows not after the watermark of the batches
    before, are left out. What the watermark has passed comes out at the end of the batch that moved it. A batch that is run again reads the same state and overwrites its own.
    """
    spark = starts.sparkSession
    span = spark.sql(f"SELECT unix_micros(timestamp_micros(0) + INTERVAL {within})").first()[0]
    delays = {flag: 1000 * side.schema[ts].metadata["spark.watermarkDelayMs"] for flag, side in ((True, starts), (False, ends))}
    kinds = {c: starts.schema[c].dataType.simpleString() for c in (entity, id)}
    out = f"start_id {kinds[id]}, end_id {kinds[id]}, seconds double"
    schema = f"_entity {kinds[entity]}, start_id {kinds[id]}, s_us long, end_id {kinds[id]}, e_us long, _matched boolean"

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of which one is new (_matched is null), and every row with whether it has met a partner."""
        of, live = None, deque()  # live: [id, time, matched, new] of the entity's starts that an end can still follow
        for batch in batches:
            rows = []

            def close(entity, most, rows=rows):
                while live and (most is None or live[0][1] < most):
                    name, at, met, _ = live.popleft()
                    rows.append((entity, name, at, None, None, met))

            for key, name, at, start, met, new in zip(*(batch.column(c).to_pylist() for c in ("_entity", "_id", "_us", "_start", "_matched", "_new")), strict=True):
                if key != of:
                    close(of, None)
                    of = key
                close(of, at - span)
                if start:
                    live.append([name, at, met, new])
                    continue
                for s in live if key is not None else ():
                    s[2] = met = True
                    if new or s[3]:
                        rows.append((key, s[0], s[1], name, at, None))
                rows.append((key, None, None, name, at, met))
            if rows:
                yield made(rows, batch.schema)
            kind = batch.schema
        if live:
            yield made([(of, name, at, None, None, met) for name, at, met, _ in live], kind)

    def made(rows: list, kind: pa.Schema) -> pa.RecordBatch:
        kinds = [kind.field(c).type for c in ("_entity", "_id", "_us", "_id", "_us", "_matched")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["_entity", "start_id", "s_us", "end_id", "e_us", "_matched"])

    def mark_of(tops: list, most: int) -> int | None:
        marks = [max((r["top"] - delay for r in tops if r["_start"] == flag and r["batch"] <= most and r["top"] is not None), default=None) for flag, delay in delays.items()]
        return None if None in marks else min(marks)

    def each_batch(root: str) -> Callable[[DataFrame, int], DataFrame]:
        def keep(df: DataFrame, batch_id: int) -> DataFrame:
            spark, path = df.sparkSession, f"{root}/fold/batch="
            df.groupBy("_start").agg(F.max("_us").alias("top")).coalesce(1).write.mode("overwrite").parquet(f"{root}/tops/batch={batch_id}")
            tops = spark.read.schema("_start boolean, top long, batch int").parquet(f"{root}/tops").filter(F.col("batch") <= batch_id)
            tops = tops.groupBy("_start", (F.col("batch") == batch_id).cast("int").alias("batch")).agg(F.max("top").alias("top")).collect()  # four rows at most
            before, mark = mark_of(tops, 0), mark_of(tops, 1)
            rows = df.filter("_us IS NOT NULL").withColumns({"_matched": F.lit(False), "_new": F.lit(True)})
            if before is not None:
                rows = rows.filter(F.col("_us") > before)
            if batch_id:
                state = spark.read.schema(schema).parquet(f"{path}{batch_id - 1}").filter("_matched IS NOT NULL")
                if before is not None:
                    state = state.filter(~passed(before))
                start = F.col("s_us").isNotNull()
                state = state.select("_entity", F.when(start, F.col("start_id")).otherwise(F.col("end_id")).alias("_id"), F.coalesce("s_us", "e_us").alias("_us"), start.alias("_start"), "_matched", F.lit(False).alias("_new"))
                rows = rows.unionByName(state)
            rows.repartition("_entity").sortWithinPartitions("_entity", "_us", F.desc("_start")).mapInArrow(walk, schema).write.mode("overwrite").parquet(f"{path}{batch_id}")
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}{batch_id - 2}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
            done = F.col("_matched").isNull() if mark is None else F.col("_matched").isNull() | ~F.col("_matched") & passed(mark)
            return spark.read.schema(schema).parquet(f"{path}{batch_id}").filter(done).select("start_id", "end_id", F.round((F.col("e_us") - F.col("s_us")) / 1e6, 3).alias("seconds"))

        return keep

    def passed(mark: int):
        return F.coalesce(F.col("s_us") + span, F.col("e_us")) < mark

    sides = [side.select(F.col(entity).alias("_entity"), F.col(id).alias("_id"), F.unix_micros(ts).alias("_us"), F.lit(flag).alias("_start")) for flag, side in ((True, starts), (False, ends))]
    rows = sides[0].unionByName(sides[1])
    rows.each_batch, rows.out_schema = each_batch, out
    return rows


def dedup_ttl(events: DataFrame, *, keys: list[str]) -> DataFrame:
    """The first row of each key while its state lives (as long as the watermark's delay)."""
    return events.dropDuplicatesWithinWatermark(keys)


def first_within(events: DataFrame, *, keys: list[str], ts: str, id: str, life_s: int) -> DataFrame:
    """Rows that repeat no row kept in the ``life_s`` seconds before them: keys, id, ts. The stream needs a watermark on ``ts``.

    The state of a key is the time of its last kept row, and goes once the watermark has passed its life. It is a table that each batch writes anew, so ``run`` does the work batch by
    batch. A batch's rows are taken by (ts, id). A row that comes late, with a time before the last kept row's, is a repeat if it lies within the life of that row on either side, else
    it is kept and the state stays. Rows without a time, and rows not after the watermark, are left out. A batch that is run again reads the same state and overwrites its own.
    """
    life, names = 1_000_000 * life_s, [*keys, id, ts]
    delay = 1000 * events.schema[ts].metadata["spark.watermarkDelayMs"]
    kinds = {c: events.schema[c].dataType.simpleString() for c in names}
    schema = ", ".join(f"`{c}` {k}" for c, k in kinds.items()) + ", _us long, _new boolean"

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Kept rows, and after each key's rows its state."""
        key, last = None, None
        for batch in batches:
            kept, ended = [], []
            for k, at, new in zip(zip(*(batch.column(c).to_pylist() for c in keys), strict=True), batch.column("_us").to_pylist(), batch.column("_new").to_pylist(), strict=True):
                if k != key:
                    if key is not None:
                        ended.append((key, last))
                    key, last = k, None
                keep = new and (last is None or abs(at - last) >= life)
                if keep or not new:
                    last = at if last is None else max(last, at)
                kept.append(keep)
            yield batch.filter(pa.array(kept, pa.bool_()))
            if ended:
                yield states(ended, batch.schema)
        if key is not None:
            yield states([(key, last)], batch.schema)

    def states(ended: list, kind: pa.Schema) -> pa.RecordBatch:
        values = dict(zip(keys, zip(*(k for k, _ in ended), strict=True), strict=True)) | {"_us": [at for _, at in ended], "_new": [False] * len(ended)}
        return pa.RecordBatch.from_arrays([pa.array(values[f.name], f.type) if f.name in values else pa.nulls(len(ended), f.type) for f in kind], schema=kind)

    def each_batch(root: str) -> Callable[[DataFrame, int], DataFrame]:
        def keep(df: DataFrame, batch_id: int) -> DataFrame:
            spark = df.sparkSession
            df.agg(F.unix_micros(F.max(ts)).alias("top")).write.mode("overwrite").parquet(f"{root}/tops/batch={batch_id}")
            top = spark.read.schema("top long, batch int").parquet(f"{root}/tops").filter(F.col("batch") < batch_id).agg(F.max("top")).first()[0]
            rows = df.select(*names, F.unix_micros(ts).alias("_us"), F.lit(True).alias("_new")).filter("_us IS NOT NULL")
            if top is not None:
                rows = rows.filter(F.col("_us") > top - delay)
            if batch_id:
                state = spark.read.schema(schema).parquet(f"{root}/fold/batch={batch_id - 1}").filter("NOT _new")
                rows = rows.unionByName(state if top is None else state.filter(F.col("_us") + life > top - delay))
            rows.repartition(*keys).sortWithinPartitions(*keys, "_new", "_us", id).mapInArrow(fold, schema).write.mode("overwrite").parquet(f"{root}/fold/batch={batch_id}")
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/fold/batch={batch_id - 2}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
            return spark.read.schema(schema).parquet(f"{root}/fold/batch={batch_id}").filter("_new").select(*names)

        return keep

    rows = events.select(*names)
    rows.each_batch = each_batch
    return rows


def latest_rows(rows: DataFrame, *, key: str, order: list[str], n: int, name: str, root: str | None = None) -> DataFrame:
    """After each batch the n newest rows of every key (the last by ``order``), with their place from the newest and the batch.

    The state is the table of the batch before, n rows a key at most; a batch's own rows are cut to n a key before they meet it. Late rows take the place that their order
    gives them. A batch that is run again reads the same state and overwrites its own.
    """
    spark = rows.sparkSession
    root = root or fresh_path(spark, f"stream-{name}")
    newest = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])

    def keep(df: DataFrame, batch_id: int) -> DataFrame:
        top = df.withColumn("nth", F.row_number().over(newest)).filter(F.col("nth") <= n)
        if batch_id:
            before = spark.read.schema(top.schema).parquet(f"{root}/out/batch={batch_id - 1}")
            top = top.unionByName(before).withColumn("nth", F.row_number().over(newest)).filter(F.col("nth") <= n)
        return top

    return run(rows, mode="update", name=name, root=root, batch=keep)


def change_state(log: DataFrame, *, base: str, key: str, value: str, order: list[str]) -> DataFrame:
    """Running state: last writer per (base, key) and number of writes."""
    return log.groupBy(base, key).agg(F.max_by(value, F.struct(*order)).alias("value"), F.count("*").alias("n_writes"))


def change_history(log: DataFrame, *, base: str, key: str, value: str, order: str) -> DataFrame:
    """Every change of a (base, key): number, old and new value, order. ``run`` does it batch by batch.

    Rows of a batch are taken in ``order``; a row that repeats the value is no change. The state, each key's last value and number of changes, is a table that each batch writes anew: it grows
    with the keys, not with the history. A batch that is run again reads the same state and overwrites its own.
    """
    kinds = {c: log.schema[c].dataType.simpleString() for c in (base, key, value, order)}
    out = f"{base} {kinds[base]}, {key} {kinds[key]}, change_no long, old_value {kinds[value]}, new_value {kinds[value]}, {order} {kinds[order]}"
    whole = out + ", _changed boolean, _last boolean"
    w = Window.partitionBy(base, key).orderBy("_new", order, value)

    def each_batch(root: str) -> Callable[[DataFrame, int], DataFrame]:
        def keep(df: DataFrame, batch_id: int) -> DataFrame:
            spark, path = df.sparkSession, f"{root}/fold/batch="
            rows = df.select(base, key, value, order, F.lit(0).cast("long").alias("_n"), F.lit(True).alias("_new"))
            if batch_id:
                state = spark.read.schema(whole).parquet(f"{path}{batch_id - 1}").filter("_last")
                rows = rows.unionByName(state.select(base, key, F.col("new_value").alias(value), order, F.col("change_no").alias("_n"), F.lit(False).alias("_new")))
            rows = rows.withColumns({"old_value": F.lag(value).over(w), "_first": F.row_number().over(w) == 1, "_last": F.lead("_new").over(w).isNull()})
            rows = rows.withColumn("_changed", F.col("_new") & (F.col("_first") | ~F.col(value).eqNullSafe(F.col("old_value"))))
            rows = rows.withColumn("change_no", F.sum(F.col("_n") + F.col("_changed").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
            kept = rows.filter("_changed OR _last").select(base, key, "change_no", "old_value", F.col(value).alias("new_value"), order, "_changed", "_last")
            kept.write.mode("overwrite").parquet(f"{path}{batch_id}")
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}{batch_id - 2}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
            return spark.read.schema(whole).parquet(f"{path}{batch_id}").filter("_changed").drop("_changed", "_last")

        return keep

    rows = log.select(base, key, value, order)
    rows.each_batch, rows.out_schema = each_batch, out
    return rows


def late_rows(events: DataFrame, *, ts: str, delay_s: int, name: str, root: str | None = None) -> DataFrame:
    """All rows with batch and late, which says that a row is older than the largest time of earlier batches less the delay.

    Each batch leaves its largest time in a table beside the output, so a stream that goes on after a crash knows it; a batch that is run
    again overwrites its own entry and reads only those before it.
    """
    spark = events.sparkSession
    root = root or fresh_path(spark, f"stream-{name}")

    def mark(df: DataFrame, batch_id: int) -> DataFrame:
        df.agg(F.max(ts).alias("top")).write.mode("overwrite").parquet(f"{root}/tops/batch={batch_id}")
        tops = spark.read.schema("top timestamp, batch int").parquet(f"{root}/tops").filter(F.col("batch") < batch_id)
        limit = tops.agg((F.max("top") - F.make_dt_interval(secs=F.lit(delay_s))).alias("_limit"))  # one row
        return df.join(F.broadcast(limit)).withColumn("late", F.coalesce(F.col(ts) < F.col("_limit"), F.lit(False))).drop("_limit")

    return run(events.withColumn(ts, F.col(ts).cast("timestamp")), mode="update", name=name, root=root, batch=mark)
