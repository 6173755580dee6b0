"""Queries of the training-data operators over the driver tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedge.llm.common import table

URL_RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sedge.llm.exact_dedup import exact_dedup

    out = exact_dedup(spark, f"{sf_dir}/documents.parquet")
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


OP1_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def labelled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with the label of the document whose text they hold: a page's path ends in that document's id."""
    pages = table(spark, sf_dir, "pages").withColumn("_doc", F.expr(r"try_cast(regexp_extract(url, '^[^?#]*/([0-9]+)', 1) AS BIGINT)"))
    bad = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("_doc")).agg(F.max(1 - F.col("quality")).alias("bad"))
    return pages.join(bad, "_doc", "left").select("page_id", "url", "bad")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sedge.llm.url_filter import url_verdicts

    out = url_verdicts(labelled_pages(spark, sf_dir), rules=URL_RULES)
    return out.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", "template", "purity")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sedge.llm.mixing import mix_plan

    out = mix_plan(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sedge.llm.near_dedup import near_duplicates

    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i : i + 4], ' ') END AS sh
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
g AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT DISTINCT a AS id, a AS seen FROM g UNION SELECT r.id, g.b FROM r JOIN g ON g.a = r.seen),
m AS (SELECT id, min(seen) AS c FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.c, d.doc_id) AS component_id, d.doc_id = coalesce(m.c, d.doc_id) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.id = d.doc_id
"""


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sedge.llm.token_counts import token_counts

    out = token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sedge.llm.line_dedup import line_dedup

    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP9_SQL = """
WITH l AS (
  SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
k AS (
  SELECT doc_id, pos, ls[pos] AS line,
         translate(trim(ls[pos], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
h AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(h.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE h.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN h USING (key) GROUP BY doc_id
"""


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sedge.llm.packing import pack

    out = pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return out.withColumnRenamed("id", "doc_id")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sedge.llm.toxicity import fit, toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    net = fit(docs, table(spark, sf_dir, "labels").filter(~held_out))
    out = toxicity(docs, net).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "threshold", "toxic")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sedge.llm.quality import quality_scores

    out = quality_scores(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.withColumnRenamed("id", "doc_id")


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sedge.llm.ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sedge.llm.alignment import alignments

    out = alignments(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    return out.withColumnRenamed("id", "doc_id")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sedge.llm.hard_negatives import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label=label)


OP12_SQL = """
WITH u AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.id AS anchor_id, r.id, r.label = a.label AS same,
         CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * r.v[i])) AS BIGINT) AS score
  FROM u a JOIN u r ON a.id <> r.id WHERE a.id % 100 = 0),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id)
QUALIFY row_number() OVER w <= 5
"""


def op13_complement_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sedge.llm.complement_packing import pack_whole

    return pack_whole(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")


def mixing_sql(fills: int = 3, miss: float = 0.002) -> str:
    """The same plan with whole-table windows."""
    fill = ""
    for i in range(fills):
        fill += f"""
m{i} AS (SELECT key, any_value(target) AS target, max(rest) - sum(extra * size) AS missing FROM c{i} GROUP BY key),
f{i} AS (SELECT c.key, c.doc_id, sum(c.size) OVER (PARTITION BY c.key ORDER BY u, c.size, c.doc_id) <= m.missing AS fits
         FROM c{i} c JOIN m{i} m USING (key) WHERE extra = 0 AND c.size > 0 AND m.missing > {miss} * m.target AND c.size <= m.missing),
c{i + 1} AS (SELECT c.* REPLACE (CASE WHEN f.fits THEN 1 ELSE extra END AS extra) FROM c{i} c LEFT JOIN f{i} f USING (doc_id)),"""
    return f"""
WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS key, md5('7:' || doc_id) AS u,
                  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT key, sum(size)::BIGINT AS source_size, 1.0::DOUBLE + (row_number() OVER (ORDER BY key) - 1) % 3 AS weight FROM d GROUP BY key),
r AS (SELECT *, 3.0::DOUBLE * source_size AS cap, 3.0::DOUBLE * source_size / weight AS ratio, (SELECT sum(source_size) FROM s)::DOUBLE AS total FROM s),
l AS (SELECT ratio, (total - coalesce(sum(cap) OVER (ORDER BY ratio, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY ratio, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
t AS (SELECT key, source_size, least(cap, weight * (SELECT level FROM l WHERE level <= ratio ORDER BY ratio LIMIT 1)) AS target FROM r),
t2 AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
t3 AS (SELECT *, greatest(0, target - whole * source_size) AS rest FROM t2),
c0 AS (SELECT d.*, source_size, target, whole, rest,
              CASE WHEN sum(size) OVER (PARTITION BY key ORDER BY u, size, doc_id) <= rest THEN 1 ELSE 0 END AS extra FROM d JOIN t3 USING (key)),{fill}
m AS (SELECT key, max(rest) - sum(extra * size) AS missing FROM c{fills} GROUP BY key),
p AS (SELECT arg_min(doc_id, (abs(c.size - missing), u, c.size, doc_id)) AS doc_id FROM c{fills} c JOIN m USING (key)
      WHERE extra = 0 AND c.size > 0 AND abs(c.size - missing) < missing GROUP BY key)
SELECT c.doc_id, c.size::BIGINT AS size, c.source_size, c.target, ((whole + extra + CASE WHEN p.doc_id IS NULL THEN 0 ELSE 1 END) * c.size)::BIGINT AS taken
FROM c{fills} c LEFT JOIN p USING (doc_id)
"""


QUERIES = {
    f.__name__: f
    for f in (op1_exact_dedup, op2_toxicity, op3_url_filter, op4_mixing, op5_quality, op6_near_dedup, op7_ann, op8_token_counts, op9_line_dedup, op10_packing, op11_alignment, op12_hard_negatives, op13_complement_packing)
}
ORACLE_SQL = {"op1_exact_dedup": OP1_SQL, "op4_mixing": mixing_sql(), "op6_near_dedup": OP6_SQL, "op9_line_dedup": OP9_SQL, "op12_hard_negatives": OP12_SQL}
