"""Exact deduplication with disk-backed keyed state that never expires.

Documents arrive as a stream. The state, kept in RocksDB and checkpointed to the shared folder, holds for each SHA-256
digest the stable identifier of the row that stays, a content locator (file and row in the file) and the number of rows
seen; there is no watermark, so nothing expires. It is a streaming aggregation, so copies are combined before the
shuffle and a text that makes up a third of all rows reaches the state as one row per task. Full bytes are compared
afterwards where a digest was hit, that is, stands for several rows: those rows are grouped by (digest, text), also combined before the
shuffle, and a digest that stands for more than one text is resolved by its texts. Other texts cross no shuffle.

Defined cases: null text counts as empty; of equal texts the largest id stays, then the largest locator, so of repeated
rows with one id exactly one stays; rows with a null id stay only if no copy has an id; an empty table gives no rows;
other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedge.llm.common import salted_join
from sedge.functions.storage import fresh_path, saved

#: Up to so many digests of several rows are broadcast, as 8 bytes each; more meet the texts in a shuffled join.
BROADCAST_HITS = 1_000_000
#: RocksDB state; it must not reserve megabytes of disk for each of many small stores.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def _located(df: DataFrame, id_col: str, text_col: str, normalise) -> DataFrame:
    text = normalise(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    where = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    return df.select(F.col(id_col).cast("long").alias("id"), where[0].alias("file"), where[1].alias("row"), text.alias("text")).withColumn("digest", F.sha2("text", 256))


def _anchor() -> Column:
    return F.max(F.struct("id", "file", "row"))


def fold_into_state(spark: SparkSession, path: str, *, id_col: str, text_col: str, normalise, checkpoint: str | None = None, max_files: int | None = None) -> DataFrame:
    """Run the stream over all files under ``path`` once; return (digest, anchor, n) as the state holds it.

    With the same ``checkpoint`` a later call reads only files that are new and goes on from the state.
    """
    checkpoint = checkpoint or fresh_path(spark, "dedup-state")
    changes = f"{checkpoint}/changes"
    before = {k: spark.conf.get(k, None) for k in STATE}
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    parent, _, name = path.rstrip("/").rpartition("/")  # as a pattern, since a stream's plain path must be a folder
    seen = _located(reader.parquet(f"{parent}/{{{name}}}"), id_col, text_col, normalise).groupBy("digest").agg(_anchor().alias("anchor"), F.count("*").alias("n"))

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{changes}/batch={batch_id}")  # the same rows again if the batch is run again

    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        seen.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{checkpoint}/log").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    schema = "digest string, anchor struct<id: bigint, file: string, row: bigint>, n bigint, batch int"
    try:
        log = spark.read.schema(schema).parquet(changes)
    except Exception as e:  # no file, so no batch ever ran
        if "PATH_NOT_FOUND" not in str(e):
            raise
        log = spark.createDataFrame([], schema)
    return log.groupBy("digest").agg(F.max(F.struct("n", "anchor")).alias("s")).select("digest", "s.anchor", "s.n")


def exact_dedup(spark: SparkSession, path: str, *, id_col: str = "doc_id", text_col: str = "text", normalise=lambda c: c, checkpoint: str | None = None, max_files: int | None = None) -> DataFrame:
    """One row per row under ``path``: id, keep_id, keep_file, keep_row, group_size, kept, text_sha256.

    ``normalise`` maps the text column before it is hashed and compared.
    """
    state = saved(fold_into_state(spark, path, id_col=id_col, text_col=text_col, normalise=normalise, checkpoint=checkpoint, max_files=max_files), "dedup-anchors")
    rows = _located(spark.read.parquet(path), id_col, text_col, normalise)
    hits = saved(state.filter("n > 1").select("digest", F.xxhash64("digest").alias("code")), "dedup-hits")
    if hits.count() <= BROADCAST_HITS:
        hit_rows = rows.withColumn("code", F.xxhash64("digest")).join(F.broadcast(hits.select("code").distinct()), "code", "left_semi")
    else:
        hit_rows = rows.join(hits, "digest", "left_semi")
    texts = hit_rows.groupBy("digest", "text").agg(F.count("*").alias("t_n")).drop("text")
    clashing = texts.groupBy("digest").agg(F.count("*").alias("n_texts")).filter("n_texts > 1").select("digest", F.lit(False).alias("same"))
    checked = saved(state.join(clashing, "digest", "left").select("digest", "anchor", "n", F.coalesce("same", F.lit(True)).alias("same")), "dedup-checked")
    columns = ["id", "file", "row", "digest", "anchor", "n"]
    out = salted_join(rows.select("id", "file", "row", "digest"), checked.filter("same"), "digest", size="n", salt=["file", "row"]).select(columns)
    clashes = checked.filter("NOT same").select("digest")
    if not clashes.isEmpty():  # a digest of several texts: its groups are those of the texts
        some = rows.join(clashes, "digest", "left_semi")
        groups = some.groupBy("digest", "text").agg(_anchor().alias("anchor"), F.count("*").alias("n"))
        out = out.unionByName(some.join(groups, ["digest", "text"]).select(columns))
    kept = F.col("id").eqNullSafe(F.col("anchor.id")) & (F.col("file") == F.col("anchor.file")) & (F.col("row") == F.col("anchor.row"))
    return out.select("id", F.col("anchor.id").alias("keep_id"), F.col("anchor.file").alias("keep_file"), F.col("anchor.row").alias("keep_row"), F.col("n").alias("group_size"), kept.alias("kept"), F.col("digest").alias("text_sha256"))
