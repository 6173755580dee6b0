"""Tables that cut the lineage of iterative operators; they go to the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` as the session has it; a local folder only where it is unset and all runs on one machine, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="sedge-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/sedge/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again, so that a lost executor costs no recomputation. ``forget`` deletes it."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.saved_path = path
    return out


def saved_with(df: DataFrame, name: str, measure: Column) -> tuple[DataFrame, int]:
    """``saved``, and an aggregate of its rows that is taken while they are written."""
    seen = Observation()
    out = saved(df.observe(seen, measure.alias("measure")), name)
    return out, seen.get["measure"] or 0


def forget(*tables: DataFrame | None) -> None:
    """Delete tables made by ``saved`` that no result reads any more."""
    for t in tables:
        if t is not None:
            spark = t.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(t.saved_path)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
