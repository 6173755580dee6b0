"""Small helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Of the rows of a join, a key with more than one in HOT is dealt over DEALS tasks, and one with more than one in HOTTER over HOTTER tasks.
#: So fewer than HOT keys are hot, whatever the number of rows.
HOT, HOTTER, DEALS = 1000, 50, 16
#: A key of so many rows at most is never hot: one task takes it well, and small tables would name most of their keys.
NEVER_HOT = 200


def with_text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts are large rows: hand them to Python in smaller Arrow batches than the default of 10,000 rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "documents":
        with_text_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def salted_join(rows: DataFrame, keys: DataFrame, on: str, *, size: str, salt: Sequence[str], how: str = "inner", sizes: DataFrame | None = None) -> DataFrame:
    """``rows`` joined on ``on`` to ``keys``, which has a row per key and the number of its rows in ``size``; the column ``size`` stays. With ``sizes`` (on, size), that number is there instead.

    The rows of a hot key are dealt by a hash of the columns ``salt``, and the key's row is repeated as often; without hot keys it is a plain join. The driver gets the hashes of
    the hot keys, fewer than HOT numbers. ``keys`` is read several times and should be a table.
    """
    counted = keys if sizes is None else sizes
    seen = counted.agg(F.sum(size).alias("n"), F.max(size).alias("most")).first()
    total, most = seen["n"] or 0, seen["most"] or 0
    is_hot = (F.col(size) * HOT > total) & (F.col(size) > NEVER_HOT)
    hot = []
    if most * HOT > total and most > NEVER_HOT:
        hot = counted.filter(is_hot).select(F.xxhash64(on).alias("h"), (F.col(size) * HOTTER > total).alias("hotter")).collect()
    elif how == "inner":
        return rows.join(keys, on)
    code, deals = F.xxhash64(on), F.lit(1)
    for more, n in ((True, HOTTER), (False, DEALS)):
        if codes := [r["h"] for r in hot if r["hotter"] == more]:
            deals = F.when(code.isin(codes), n).otherwise(deals)
    of_row = F.when(F.col(on).isNull(), HOTTER).otherwise(deals)  # null keys meet nothing
    dealt = rows.withColumn("_salt", F.when(of_row > 1, F.pmod(F.xxhash64(*salt), of_row).cast("int")).otherwise(0))
    spread = keys.withColumn("_salt", F.lit(0))
    if hot:
        hot_keys = keys.filter(deals > 1).withColumn("_salt", F.explode(F.sequence(F.lit(0), deals - 1)))
        spread = keys.filter(deals == 1).withColumn("_salt", F.lit(0)).unionByName(hot_keys)
    return dealt.join(spread, [on, "_salt"], how).drop("_salt")


def safe_names(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns named c0, c1, ..., which clash with no name used here, and the new name of each."""
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names
