"""Sources and sinks: texts, JSON lines with quarantine, artefact folders, model responses, flat and report exports."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedge.functions.rules import RuleSet


def read_documents(spark: SparkSession, path: str, format: str = "parquet", schema: str | None = None) -> DataFrame:
    """Parquet, JSON, CSV or whole text files, with the file a row came from as _file."""
    reader = spark.read.schema(schema) if schema else spark.read
    if format == "text":
        rows = reader.option("wholetext", True).text(path).withColumnRenamed("value", "text")
    else:
        rows = reader.format(format).load(path)
    return rows.withColumn("_file", F.col("_metadata.file_path"))


def doc_class(name: Column, words: Sequence[tuple[str, str]] = (("amendment", "AMENDMENT"), ("exhibit", "EXHIBIT")), default: str = "BASE") -> Column:
    out = None
    for word, kind in words:
        hit = F.contains(F.lower(name), F.lit(word))
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise(default)


def parse_jsonl(df: DataFrame, *, raw: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows that parse, with the schema's columns; rows that do not)."""
    parsed = df.withColumn("_p", F.from_json(raw, f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("_p").isNull() | F.col("_p._corrupt").isNotNull()
    return parsed.filter(~bad).select(*df.columns, "_p.*").drop("_corrupt"), parsed.filter(bad).select(*df.columns)


def read_artifacts(spark: SparkSession, root: str, *, pattern: str = r"([^/]+)\.parquet", expected: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(artefact, n_files, n_bytes) of the files under ``root``, and the expected names that are missing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    found = files.withColumn("artifact", F.regexp_extract("path", pattern, 1)).filter("artifact <> ''").groupBy("artifact").agg(F.count("*").alias("n_files"), F.sum("length").alias("n_bytes"))
    wanted = spark.createDataFrame([(e,) for e in expected], "artifact string")
    return found, wanted.join(found, "artifact", "left_anti")


def artifact_rows(spark: SparkSession, root: str, *, pattern: str = r"/([^/]+)/([^/]+)\.[a-z]+$") -> DataFrame:
    """(doc_id, artifact, n_bytes) of the files under ``root``: the document is the folder that holds the file, by the two groups of ``pattern``. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    return files.filter(F.col("path").rlike(pattern)).select(F.regexp_extract("path", pattern, 1).alias("doc_id"), F.regexp_extract("path", pattern, 2).alias("artifact"), F.col("length").alias("n_bytes"))


def parse_responses(df: DataFrame, *, raw: str) -> DataFrame:
    """Add response (VARIANT): the text as JSON, else its outermost {...} block, else null."""
    block = F.nullif(F.regexp_extract(F.col(raw), r"(?s)\{.*\}", 0), F.lit(""))
    return df.withColumn("response", F.coalesce(F.try_parse_json(raw), F.try_parse_json(block)))


def validate_responses(df: DataFrame, *, response: str = "response") -> DataFrame:
    """Add reject_reason, the first rule broken: category (text), confidence (number in 0..1), risk_flags (array; level high/medium/low and a description each)."""
    v = F.col(response)
    kind = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    number = F.try_variant_get(v, "$.confidence", "double")
    flags = F.try_variant_get(v, "$.risk_flags", "array<struct<level: string, description: string>>")
    good = F.forall(flags, lambda r: r["level"].isin("high", "medium", "low") & F.coalesce(F.length(r["description"]) > 0, F.lit(False)))
    reason = (
        F.when(v.isNull(), "not json").when(~F.coalesce(kind("$.category") == "STRING", F.lit(False)), "category")
        .when(~F.coalesce(kind("$.confidence").rlike("^(DECIMAL|BIGINT|DOUBLE|FLOAT|INT)"), F.lit(False)), "confidence type").when(~number.between(0, 1), "confidence range")
        .when(flags.isNull(), "risk_flags").when(~F.coalesce(good, F.lit(False)), "risk flag")
    )
    return df.withColumn("reject_reason", reason)


def responses_to_clauses(df: DataFrame, *, id: str, response: str = "response", skip: Sequence[str] = ("signature", "certificate")) -> DataFrame:
    """One row per detected clause: key ``<type>_data``, ``_data_2`` ... within a document, confidence, needs_review (under .5)."""
    items = F.try_variant_get(response, "$.detected_clauses", "array<struct<clause_type: string, confidence: double>>")
    rows = df.select(id, F.posexplode(items).alias("pos", "c")).select(id, "pos", F.col("c.clause_type").alias("clause_type"), F.col("c.confidence").alias("confidence"))
    rows = rows.filter(~F.coalesce(F.lower("clause_type").rlike("|".join(skip)), F.lit(False)))
    nth = F.row_number().over(Window.partitionBy(id, "clause_type").orderBy("pos"))
    key = F.concat("clause_type", F.lit("_data"), F.when(nth > 1, F.concat(F.lit("_"), nth.cast("string"))).otherwise(""))
    return rows.withColumn("clause_key", key).withColumn("needs_review", F.col("confidence") < 0.5)


def response_clauses(df: DataFrame, *, id: str, section: str, response: str = "response", kinds: RuleSet | None = None, skip: Sequence[str] = ("signature", "certificate")) -> DataFrame:
    """Clauses of model responses of every shape: id, section, shape, clause_key, clause_type, confidence, inferred, needs_review.

    "detected": ``detected_clauses``, without types of ``skip``; inferred if the type is not in the section's name; for review below .5 or with any risk.
    "loose": texts of ``miscellaneous_clauses``; the first rule of ``kinds`` that fires names the type (confidence .6), else it is "misc" (.7); always inferred. "item": ``extracted_items``, for review below .8.
    Keys are the type and _data, numbered from 2 within a document and type in the order detected, loose, items. A missing confidence counts as 0.
    """
    detected = F.try_variant_get(response, "$.detected_clauses", "array<struct<clause_type: string, confidence: double, risks: array<variant>>>")
    loose = F.try_variant_get(response, "$.miscellaneous_clauses", "array<string>")
    items = F.try_variant_get(response, "$.extracted_items", "array<struct<clause_type: string, confidence: double>>")
    base = [F.col(id).alias("_id"), F.col(section).alias("_section")]
    named = lambda kind: F.contains(F.lower(F.coalesce("_section", F.lit(""))), F.lower(F.replace(kind, F.lit("_"), F.lit(" "))))
    conf = lambda c: F.coalesce(c, F.lit(0.0))
    a = df.select(*base, F.posexplode(detected).alias("_pos", "c")).filter(~F.coalesce(F.lower("c.clause_type").rlike("|".join(skip)), F.lit(False)))
    a = a.select("_id", "_section", F.lit(0).alias("_shape"), "_pos", F.col("c.clause_type").alias("clause_type"), conf(F.col("c.confidence")).alias("confidence"), ~named(F.col("c.clause_type")) | F.col("c.clause_type").isNull(), (conf(F.col("c.confidence")) < 0.5) | (F.coalesce(F.size("c.risks"), F.lit(0)) > 0))
    kind = kinds.first(F.lower("c")) if kinds else F.lit(None).cast("string")
    b = df.select(*base, F.posexplode(loose).alias("_pos", "c")).filter("c IS NOT NULL").withColumn("_k", kind)
    b = b.select("_id", "_section", F.lit(1), "_pos", F.coalesce("_k", F.lit("misc")), F.when(F.col("_k").isNull(), 0.7).otherwise(0.6), F.lit(True), F.lit(False))
    c = df.select(*base, F.posexplode(items).alias("_pos", "c"))
    c = c.select("_id", "_section", F.lit(2), "_pos", "c.clause_type", conf(F.col("c.confidence")), F.lit(False), conf(F.col("c.confidence")) < 0.8)
    rows = a.union(b).union(c).toDF("_id", "_section", "_shape", "_pos", "clause_type", "confidence", "inferred", "needs_review")
    nth = F.row_number().over(Window.partitionBy("_id", "clause_type").orderBy("_shape", "_section", "_pos"))
    key = F.concat(F.coalesce("clause_type", F.lit("unknown")), F.lit("_data"), F.when(nth > 1, F.concat(F.lit("_"), nth.cast("string"))).otherwise(""))
    shape = F.element_at(F.array(F.lit("detected"), F.lit("loose"), F.lit("item")), F.col("_shape") + 1)
    return rows.withColumn("clause_key", key).select(F.col("_id").alias(id), F.col("_section").alias(section), shape.alias("shape"), "clause_key", "clause_type", "confidence", "inferred", "needs_review")


def build_requests(df: DataFrame, *, text: str, most: int = 6000, keep: int = 2000, marker: str = "\n...\n", policy: str = "ends") -> DataFrame:
    """Add content: of texts over ``most`` characters "ends" keeps the first and last ``keep`` around a marker, "head" the first ``most`` and the marker."""
    c = F.col(text)
    cut = F.concat(F.left(c, F.lit(keep)), F.lit(marker), F.right(c, F.lit(keep))) if policy == "ends" else F.concat(F.left(c, F.lit(most)), F.lit(marker))
    return df.withColumn("content", F.when(F.length(c) > most, cut).otherwise(c))


def excerpts(df: DataFrame, *, id: str, text: str, over: int = 10_000, piece: int = 500, head: int = 2000, thirds_over: int | None = None, third: int = 15_000) -> DataFrame:
    """(id, piece_no, excerpt): four pieces (start, one third, two thirds, end) of long texts, the head of others. With ``thirds_over``, texts over so many
    characters give three pieces of ``third``: from the start, around the middle, and up to the end."""
    c, n = F.col(text), F.length(text)
    starts = F.array(F.lit(0), F.floor(n / 3).cast("int"), F.floor(2 * n / 3).cast("int"), (n - piece).cast("int"))
    long = F.transform(starts, lambda s: F.substring(c, s + 1, F.lit(piece)))
    pieces = F.when(n > over, long).otherwise(F.array(F.left(c, F.lit(head))))
    if thirds_over is not None:
        starts = F.array(F.lit(0), F.floor((n - third) / 2).cast("int"), (n - third).cast("int"))
        pieces = F.when(n > thirds_over, F.transform(starts, lambda s: F.substring(c, s + 1, F.lit(third)))).otherwise(pieces)
    return df.select(id, F.posexplode(pieces).alias("piece_no", "excerpt"))


def run_requests(requests: DataFrame, call: Callable[[list[str]], list[str | None]], *, content: str = "content", result: str = "raw", at_once: int = 64) -> DataFrame:
    """Add ``result``: what ``call`` answers to the requests' texts, a list of at most ``at_once`` texts at a time. ``call`` is any function that tasks can load (a client of a model, a rule);
    a call that raises leaves nulls, which ``validate_responses`` reports, and the other calls go on. Null texts are not sent."""

    def answer(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
            known = texts[texts.notna()]
            for i in range(0, len(known), at_once):
                part = known.iloc[i : i + at_once]
                try:
                    out[part.index] = call(part.tolist())
                except Exception:  # noqa: BLE001 a model's failure is a row's result
                    continue
            yield out

    return requests.withColumn(result, F.pandas_udf(answer, "string")(F.col(content)))


def write_outputs(df: DataFrame, path: str, formats: Sequence[str] = ("parquet", "json", "csv"), partition_by: Sequence[str] = ()) -> dict[str, str]:
    """Write the table in each format; returns the folders."""
    out = {}
    for f in formats:
        writer = df.write.mode("overwrite").partitionBy(*partition_by) if partition_by else df.write.mode("overwrite")
        writer.format(f).option("header", True).save(f"{path}/{f}")
        out[f] = f"{path}/{f}"
    return out


def flat_export(df: DataFrame, *, keep: Sequence[str], values: str, risks: str) -> DataFrame:
    """Rows (kept columns, key, value, level, description): per value of a clause with its risk, else per risk, else one General row.

    A key's risk is the first whose description contains the key or a ``_`` part of it, else the only risk there is.
    """
    base = df.select(*keep, F.col(values).alias("_v"), F.coalesce(F.col(risks), F.expr("array()").cast("array<struct<level: string, description: string>>")).alias("_r"))
    has_v = F.coalesce(F.size("_v") > 0, F.lit(False))
    by_value = base.filter(has_v).select(*keep, "_r", F.explode("_v").alias("key", "value"))
    names = F.concat(F.array(F.col("key")), F.split("key", "_"))
    fit = F.get(F.filter("_r", lambda r: F.exists(names, lambda k: (k != "") & F.contains(F.lower(r["description"]), F.lower(k)))), F.lit(0))
    hit = F.coalesce(fit, F.when(F.size("_r") == 1, F.get("_r", F.lit(0))))
    a = by_value.select(*keep, "key", "value", hit["level"].alias("level"), hit["description"].alias("description"))
    b = base.filter(~has_v & (F.size("_r") > 0)).select(*keep, F.explode("_r").alias("r")).select(*keep, F.lit("Risk").alias("key"), F.lit(None).cast("string").alias("value"), F.col("r.level").alias("level"), F.col("r.description").alias("description"))
    c = base.filter(~has_v & (F.size("_r") == 0)).select(*keep, F.lit("General").alias("key"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("level"), F.lit(None).cast("string").alias("description"))
    return a.unionByName(b).unionByName(c)


def flat_export_full(df: DataFrame, *, keep: Sequence[str], values: str, risks: str, confidence: str, page_start: str, page_end: str, truncated: str) -> DataFrame:
    """``flat_export`` with confidence as text of two decimals, page_range ("3", "3-5" or empty) and truncated ("Yes" or "No")."""
    pages = F.when(F.col(page_start).isNull(), "").when(F.coalesce(F.col(page_end), F.col(page_start)) == F.col(page_start), F.col(page_start).cast("string")).otherwise(F.concat_ws("-", page_start, page_end))
    shown = {"confidence": F.coalesce(F.format_string("%.2f", F.col(confidence).cast("double")), F.lit("")), "page_range": pages, "truncated": F.when(F.coalesce(F.col(truncated), F.lit(False)), "Yes").otherwise("No")}
    rows = df.select(*keep, F.col(values).alias("_values"), F.col(risks).alias("_risks"), *[c.alias(f"_{k}") for k, c in shown.items()])
    out = flat_export(rows, keep=[*keep, *[f"_{k}" for k in shown]], values="_values", risks="_risks")
    return out.withColumnsRenamed({f"_{k}": k for k in shown})


def report_markdown(sections: DataFrame, *, doc: str, title: str, body: str, order: str, few: int = 5) -> DataFrame:
    """One text per document: a heading by the number of sections, then the sections in order."""
    part = F.concat(F.lit("## "), F.col(title), F.lit("\n"), F.col(body))
    rows = sections.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), part.alias("p")))).alias("_p"))
    head = F.when(F.size("_p") < few, "# Limited report").otherwise("# Report")
    return rows.select(doc, F.concat(head, F.lit("\n"), F.array_join(F.transform("_p", lambda x: x["p"]), "\n")).alias("report"))
