"""Drop lines that many documents share: explode, hash, count distinct documents, drop, reassemble by position.

Lines are split and hashed once, into a table of (row key, position, line hash); lines that may not be dropped, such as blank ones,
are not in it. Counts are combined before the shuffle, and in the join that finds the lines that go a very common line is dealt over many tasks.
Each text is shuffled once, to meet the positions of its lines that go. All expressions are built-in.

Defined cases: null or empty text is one empty line; a line's key is the line stripped of ``strip`` at both ends with A-Z
lower-cased, and keys shorter than ``min_chars`` code points are never dropped; a document counts once for a key however
often it repeats it, rows with one id count as one document and rows with a null id as none, but all lose the shared lines;
repeated rows give repeated results; an empty table gives an empty one; all other columns are kept, and the columns added
here replace columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedge.functions.storage import saved
from sedge.llm.common import safe_names, salted_join

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column, strip: str = BLANKS) -> Column:
    bare = F.btrim(line, F.lit(strip))
    # For ASCII lines lower() does the same and is far cheaper than translate().
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def hash128(c: Column) -> Column:
    """Two independent 64-bit hashes; a false match among n keys has probability about n * n / 2**129."""
    return F.struct(F.xxhash64(c, F.lit(1)).alias("a"), F.xxhash64(c, F.lit(2)).alias("b"))


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, strip: str = BLANKS) -> DataFrame:
    """``docs`` with ``text_col`` reassembled from the lines that stay, and n_lines, n_dropped.

    Lines whose key has at least ``min_chars`` code points and occurs in at least ``min_docs`` documents go everywhere.
    """
    safe, at = safe_names(docs)
    text = F.coalesce(F.col(at[text_col]).cast("string"), F.lit(""))
    row = F.struct(*[F.xxhash64(F.col(at[id_col]).cast("string"), F.col(at[id_col]).isNull(), text, F.lit(seed)).alias(f"h{seed}") for seed in (1, 2)])
    lines = safe.select(F.col(at[id_col]).alias("id"), row.alias("row"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    key = line_key(F.col("line"), strip)
    lines = saved(lines.select("id", "row", "pos", F.length(key).alias("size"), hash128(key).alias("hash")).filter(F.col("size") >= min_chars).drop("size"), "lines")
    counts = lines.groupBy("hash").agg(F.countDistinct("id").alias("n_docs"), F.count("*").alias("n_lines")).filter(F.col("n_docs") >= min_docs)
    shared = saved(counts.select("hash", "n_lines"), "shared-lines")
    gone = salted_join(lines.select("row", "pos", "hash"), shared, "hash", size="n_lines", salt=["row", "pos"])
    gone = gone.groupBy("row").agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    joined = safe.withColumn("row", row).join(gone, "row", "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<int>"))).withColumn("lines", F.split(text, "\n"))
    # What stays are the runs of lines between those that go.
    runs = F.zip_with(F.concat(F.array(F.lit(-1)), "gone"), F.concat("gone", F.array(F.size("lines"))), lambda a, b: F.slice("lines", a + 2, b - a - 1))
    joined = joined.withColumn(at[text_col], F.array_join(F.flatten(runs), "\n"))
    added = {"n_lines": F.size("lines").cast("long"), "n_dropped": F.size("gone").cast("long")}
    return joined.select(*[F.col(at[c]).alias(c) for c in docs.columns if c not in added], *[v.alias(k) for k, v in added.items()])
