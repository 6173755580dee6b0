"""Segmentation queries over ``documents``. A heading here is a short line that ends in a full stop; levels go by its words."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedge.functions.rules import Rule, RuleSet
from sedge.operators import segment
from sedge.plans.base import over, query, t

LINES_SQL = """
ls AS (SELECT doc_id, list_zip(range(len(string_split(text, chr(10)))), string_split(text, chr(10))) AS z FROM documents),
ln AS (SELECT doc_id, u[1] AS line_no, u[2] AS line FROM (SELECT doc_id, unnest(z) AS u FROM ls)),
lines AS (SELECT doc_id, line_no, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start, line FROM ln)"""
ONE, TWO, THREE = r"^[^ ]+\.$", r"^[^ ]+ [^ ]+( [^ ]+)?\.$", r"^[^ ]+( [^ ]+){3,5}\.$"
HEADINGS = RuleSet([Rule("h", ONE, 1.0), Rule("h", TWO, 2.0), Rule("h", THREE, 3.0)])
HEADS_SQL = rf"""{LINES_SQL},
heads AS (SELECT doc_id, line_no, char_start, char_start + length(line) AS char_end, line,
                 CASE WHEN regexp_matches(line, '{THREE}') THEN 3 WHEN regexp_matches(line, '{TWO}') THEN 2 WHEN regexp_matches(line, '{ONE}') THEN 1 END AS level FROM lines
          WHERE regexp_matches(line, '{ONE}') OR regexp_matches(line, '{TWO}') OR regexp_matches(line, '{THREE}'))"""
CUT_SQL = f"""{HEADS_SQL},
cut AS (SELECT h.*, coalesce(lead(char_start) OVER (PARTITION BY h.doc_id ORDER BY char_start), length(text)) AS section_end, text FROM heads h JOIN documents USING (doc_id)),
sections AS (SELECT doc_id, level, char_start, section_end, substring(text, char_start + 1, section_end - char_start) AS content FROM cut
             WHERE length(trim(substring(text, char_start + 1, section_end - char_start), ' ' || chr(10) || chr(9) || chr(13))) >= 50),
tree AS (SELECT *, CASE level WHEN 1 THEN NULL WHEN 2 THEN last_value(CASE WHEN level < 2 THEN char_start END IGNORE NULLS) OVER w ELSE last_value(CASE WHEN level < 3 THEN char_start END IGNORE NULLS) OVER w END AS parent_start
         FROM sections WINDOW w AS (PARTITION BY doc_id ORDER BY char_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def docs(spark, sf):
    return t(spark, sf, "documents").select("doc_id", "text")


def heads(spark, sf):
    return segment.drop_overlaps(segment.headings(segment.lines(docs(spark, sf)), HEADINGS))


def tree(spark, sf):
    return segment.parent_of(segment.section_cut(heads(spark, sf), docs(spark, sf)))


@query("line_table", f"WITH {LINES_SQL} SELECT doc_id, line_no::INT AS line_no, char_start, char_start + length(line) AS char_end, md5(line) AS line_md5 FROM lines")
def line_table(spark, sf):
    return segment.lines(docs(spark, sf)).select("doc_id", "line_no", "char_start", "char_end", F.md5("line").alias("line_md5"))


PAGES_SQL = "pages AS (SELECT doc_id, p::INT AS page_num, ((p - 1) * 3000)::BIGINT AS pos FROM (SELECT doc_id, unnest(range(1, greatest(1, length(text) // 3000) + 1)) AS p FROM documents))"


@query("page_markers", f"WITH {PAGES_SQL} SELECT * FROM pages")
def page_markers(spark, sf):
    return segment.page_markers(docs(spark, sf))


@query("page_of_position", f"WITH {LINES_SQL}, {PAGES_SQL} SELECT l.doc_id, l.line_no::INT AS line_no, l.char_start AS pos, p.page_num FROM lines l ASOF JOIN pages p ON l.doc_id = p.doc_id AND l.char_start >= p.pos")
def page_of_position(spark, sf):
    points = segment.lines(docs(spark, sf)).select("doc_id", "line_no", F.col("char_start").alias("pos"))
    return segment.assign_page(points, segment.page_markers(docs(spark, sf)))


@query("heading_candidates", rf"""WITH {LINES_SQL}
SELECT doc_id, line_no::INT AS line_no, u.l AS level FROM (SELECT doc_id, line_no, unnest(list_filter([
  {{'ok': regexp_matches(line, '{ONE}'), 'l': 1}}, {{'ok': regexp_matches(line, '{TWO}'), 'l': 2}}, {{'ok': regexp_matches(line, '{THREE}'), 'l': 3}}], lambda x: x.ok)) AS u FROM lines)""")
def heading_candidates(spark, sf):
    return segment.headings(segment.lines(docs(spark, sf)), HEADINGS).select("doc_id", "line_no", "level")


@query("overlap_resolution", f"WITH {HEADS_SQL} SELECT doc_id, line_no::INT AS line_no, level, char_start, char_end FROM heads")
def overlap_resolution(spark, sf):
    return heads(spark, sf).select("doc_id", "line_no", "level", "char_start", "char_end")


@query("nearby_merge", f"""WITH {HEADS_SQL},
m AS (SELECT *, CASE WHEN lag(level) OVER w IS NULL OR lag(level) OVER w <> level OR char_start - lag(char_end) OVER w >= 500 THEN 1 ELSE 0 END AS new FROM heads WINDOW w AS (PARTITION BY doc_id ORDER BY char_start)),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY char_start) AS run FROM m)
SELECT doc_id, min(level) AS level, min(char_start) AS char_start, max(char_end) AS char_end, string_agg(line, ' / ' ORDER BY char_start) AS heading FROM r GROUP BY doc_id, run""")
def nearby_merge(spark, sf):
    return segment.merge_nearby(heads(spark, sf))


@query("section_cut", f"WITH {CUT_SQL} SELECT doc_id, level, char_start, section_end, md5(content) AS content_md5 FROM sections")
def section_cut(spark, sf):
    return segment.section_cut(heads(spark, sf), docs(spark, sf)).select("doc_id", "level", "char_start", "section_end", F.md5("content").alias("content_md5"))


@query("heading_tree", f"WITH {CUT_SQL} SELECT doc_id, level, char_start, parent_start FROM tree")
def heading_tree(spark, sf):
    return tree(spark, sf).select("doc_id", "level", "char_start", "parent_start")


@query("heading_paths", f"""WITH {CUT_SQL}, a AS (SELECT x.doc_id, x.char_start, x.level, y.char_start AS up, y.level AS up_level FROM tree x LEFT JOIN tree y ON y.doc_id = x.doc_id AND y.char_start < x.char_start AND y.level < x.level
  AND NOT EXISTS (SELECT 1 FROM tree z WHERE z.doc_id = x.doc_id AND z.char_start > y.char_start AND z.char_start < x.char_start AND z.level <= y.level))
SELECT doc_id, char_start, level, coalesce(string_agg(up::VARCHAR, '>' ORDER BY up), '') AS path FROM a GROUP BY 1, 2, 3""")
def heading_paths(spark, sf):
    out = segment.ancestor_paths(segment.section_cut(heads(spark, sf), docs(spark, sf)))
    return out.select("doc_id", "char_start", "level", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


_TRIM = "' ' || chr(9) || chr(13)"
PARAGRAPHS_SQL = f"""pl AS (SELECT doc_id, line_no, char_start, line, sum((trim(line, {_TRIM}) = '')::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM lines),
pr AS (SELECT doc_id, run, arg_min(char_start + length(line) - length(ltrim(line, {_TRIM})), line_no) AS s, arg_max(char_start + length(rtrim(line, {_TRIM})), line_no) AS e FROM pl WHERE trim(line, {_TRIM}) <> '' GROUP BY 1, 2),
pk AS (SELECT doc_id, s, e, count(*) OVER (PARTITION BY doc_id) AS n FROM pr WHERE e - s >= 50),
para AS (SELECT doc_id, s AS char_start, e AS char_end FROM pk WHERE n >= 3 UNION ALL SELECT doc_id, 0, length(text) FROM documents WHERE text IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM pk WHERE n >= 3))"""


@query("paragraph_rows", f"""WITH {LINES_SQL}, {PARAGRAPHS_SQL} SELECT doc_id, 'F-' || lpad((row_number() OVER (PARTITION BY doc_id ORDER BY char_start))::VARCHAR, 3, '0') AS chunk_id, char_start, char_end, md5(substring(text, char_start + 1, char_end - char_start)) AS content_md5
FROM para JOIN documents USING (doc_id)""")
def paragraph_rows(spark, sf):
    return segment.paragraph_rows(docs(spark, sf)).select("doc_id", "chunk_id", "char_start", "char_end", F.md5("content").alias("content_md5"))


@query("section_table", f"""WITH {CUT_SQL}, {PARAGRAPHS_SQL}, h AS (SELECT doc_id FROM heads GROUP BY 1 HAVING count(*) > 1), long AS (SELECT doc_id, text FROM documents WHERE length(text) >= 500),
a AS (SELECT doc_id, 'sections' AS mode, level, char_start, section_end AS char_end FROM sections WHERE doc_id IN (SELECT doc_id FROM h) AND doc_id IN (SELECT doc_id FROM long)
  UNION ALL SELECT doc_id, 'paragraphs', NULL, char_start, char_end FROM para WHERE doc_id NOT IN (SELECT doc_id FROM h) AND doc_id IN (SELECT doc_id FROM long))
SELECT doc_id, mode, level, char_start, char_end FROM a UNION ALL SELECT doc_id, 'whole', 0, 0, length(text) FROM long WHERE doc_id NOT IN (SELECT doc_id FROM a)""")
def section_table(spark, sf):
    """Sections where there are two headings or more, else paragraphs."""
    return segment.section_table(docs(spark, sf), heads(spark, sf)).select("doc_id", "mode", "level", "char_start", "char_end")


@query("leaves_or_whole", f"""WITH {CUT_SQL} SELECT doc_id, char_start, level FROM tree a WHERE NOT EXISTS (SELECT 1 FROM tree b WHERE b.doc_id = a.doc_id AND b.parent_start = a.char_start)
UNION ALL SELECT doc_id, 0, 0 FROM documents WHERE trim(text, ' ' || chr(10) || chr(9) || chr(13)) <> '' AND doc_id NOT IN (SELECT doc_id FROM tree)""")
def leaves_or_whole(spark, sf):
    return segment.leaves_or_whole(tree(spark, sf), docs(spark, sf)).select("doc_id", "char_start", "level")


#: Candidates that reach over line ends: a line by itself, and two lines that together make few words.
WIDE = RuleSet([Rule("h", ONE, 1.0), Rule("h", r"^[^ \n]+ ?[^ \n]*\n[^ \n]+ [^ \n]+\.$", 2.0), Rule("h", r"^[^\n]{1,12}\n[^\n]{1,12}$", 1.0), Rule("h", TWO, 3.0)])


@query("overlapping_headings")
def overlapping_headings(spark, sf):
    wide = segment.headings(segment.line_windows(segment.lines(docs(spark, sf))), WIDE)
    return segment.drop_overlapping(wide.select("doc_id", "line_no", "char_start", "char_end", "level", "ordinal"))


@query("leaf_sections", f"WITH {CUT_SQL} SELECT doc_id, char_start, level FROM tree a WHERE NOT EXISTS (SELECT 1 FROM tree b WHERE b.doc_id = a.doc_id AND b.parent_start = a.char_start)")
def leaf_sections(spark, sf):
    return segment.leaves(tree(spark, sf)).select("doc_id", "char_start", "level")


@query("paragraph_chunks", """
WITH p AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(10) || chr(9) || chr(13))), lambda x: length(x) >= 20) AS ps FROM documents),
q AS (SELECT doc_id, CASE WHEN len(ps) >= 3 THEN ps ELSE [text] END AS ps FROM p)
SELECT doc_id, (i - 1)::INT AS chunk_no, md5(ps[i]) AS content_md5 FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM q)""")
def paragraph_chunks(spark, sf):
    return segment.paragraphs(docs(spark, sf), separator="\n", min_chars=20).select("doc_id", "chunk_no", F.md5("content").alias("content_md5"))


@query("packed_chunks", """
WITH RECURSIVE d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ps FROM documents), l AS (SELECT doc_id, i, length(ps[i]) AS size, len(ps) AS n FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM d)),
r AS (SELECT doc_id, i, 0 AS chunk_no, size AS total, size AS n_chars, 0::BIGINT AS char_start, size AS char_end FROM l WHERE i = 1
  UNION ALL SELECT doc_id, i, chunk_no + flush::INT, CASE WHEN flush THEN size ELSE total + size END, size, char_end + 1, char_end + 1 + size
  FROM (SELECT r.doc_id, l.i, r.chunk_no, r.total, l.size, r.char_end, r.total + l.size > 3000 OR (r.total >= 1000 AND l.size >= 100) AS flush FROM r JOIN l ON l.doc_id = r.doc_id AND l.i = r.i + 1)),
g AS (SELECT doc_id, chunk_no, min(char_start) AS char_start, max(char_end) AS char_end, sum(n_chars) AS n_chars FROM r GROUP BY 1, 2)
SELECT doc_id, chunk_no, char_start, char_end, n_chars::BIGINT AS n_chars, md5(substring(text, char_start + 1, char_end - char_start)) AS content_md5 FROM g JOIN d USING (doc_id)""")
def packed_chunks(spark, sf):
    out = segment.pack_paragraphs(docs(spark, sf), target=1000, most=3000, small=100)
    return out.select("doc_id", "chunk_no", "char_start", "char_end", "n_chars", F.md5("content").alias("content_md5"))


@query("fixed_chunks", """
SELECT doc_id, i::INT AS chunk_no, i * 2000 AS char_start, md5(substring(text, i * 2000 + 1, 2000)) AS content_md5
FROM (SELECT doc_id, text, unnest(range(0, greatest(0, ceil((length(text) - 2000) / 2000.0))::BIGINT + 1)) AS i FROM documents)""")
def fixed_chunks(spark, sf):
    return segment.fixed_chunks(docs(spark, sf)).select("doc_id", "chunk_no", "char_start", F.md5("content").alias("content_md5"))


@query("sliding_chunks", """
SELECT doc_id, i::INT AS chunk_no, i * 2500 AS char_start, md5(substring(text, i * 2500 + 1, 3000)) AS content_md5
FROM (SELECT doc_id, text, unnest(range(0, greatest(0, ceil((length(text) - 3000) / 2500.0))::BIGINT + 1)) AS i FROM documents)""")
def sliding_chunks(spark, sf):
    return segment.fixed_chunks(docs(spark, sf), size=3000, overlap=500).select("doc_id", "chunk_no", "char_start", F.md5("content").alias("content_md5"))


@query("boundary_islands", """
WITH i AS (SELECT l_orderkey, epoch(l_shipdate)::BIGINT // 86400 AS s, epoch(l_shipdate)::BIGINT // 86400 + l_quantity::BIGINT AS e, l_discount AS c FROM lineitem),
n AS (SELECT *, max(e) OVER (PARTITION BY l_orderkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
r AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM n),
m AS (SELECT l_orderkey, min(s) AS start, max(e) AS "end", count(*) AS n, max(c) AS confidence FROM r GROUP BY l_orderkey, run)
SELECT *, lead(start) OVER (PARTITION BY l_orderkey ORDER BY start) AS next_start FROM m""")
def boundary_islands(spark, sf):
    day = F.unix_date(F.to_date("l_shipdate")).cast("long")
    rows = t(spark, sf, "lineitem").select("l_orderkey", day.alias("s"), (day + F.col("l_quantity").cast("long")).alias("e"), F.col("l_discount").alias("c"))
    return segment.merge_boundaries(rows, key="l_orderkey", start="s", end="e", confidence="c")


SENT_SQL = r"""
sp AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \t\r\n]+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ' || chr(10) || chr(9) || chr(13))), lambda x: length(x) > 0) AS s FROM documents)"""


@query("sentences", f"WITH {SENT_SQL} SELECT doc_id, len(s) AS n_sentences, sum(length(s[i]))::BIGINT AS n_chars, max(length(s[i])) AS longest FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM sp) GROUP BY doc_id, len(s)")
def sentences(spark, sf):
    return segment.sentences(docs(spark, sf)).groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.sum(F.length("sentence")).alias("n_chars"), F.max(F.length("sentence")).alias("longest"))


@query("token_estimate", "SELECT source, sum(ceil(length(text) / 4.0))::BIGINT AS n_tokens, sum(length(text) // 4)::BIGINT AS n_floor FROM documents GROUP BY source")
def token_estimate(spark, sf):
    return t(spark, sf, "documents").groupBy("source").agg(F.sum(segment.token_estimate(F.col("text"))).alias("n_tokens"), F.sum(F.floor(F.length("text") / 4)).alias("n_floor"))


@query("token_budget_truncate", f"""WITH {SENT_SQL},
e AS (SELECT doc_id, i, s[i] AS x FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM sp)),
f AS (SELECT *, sum(ceil(length(x) / 4.0)) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS r FROM e),
k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS kept FROM f WHERE r <= 200 GROUP BY doc_id)
SELECT doc_id, md5(CASE WHEN ceil(length(text) / 4.0) <= 200 THEN text ELSE coalesce(kept, left(text, 800)) END) AS content_md5, ceil(length(text) / 4.0) > 200 AS truncated FROM documents LEFT JOIN k USING (doc_id)""")
def token_budget_truncate(spark, sf):
    return segment.truncate_to_budget(docs(spark, sf), max_tokens=200).select("doc_id", F.md5("content").alias("content_md5"), "truncated")


SECTIONS = RuleSet([Rule("licence", "license"), Rule("the", "^the "), Rule("german", "^(der|die|das) "), Rule("french", "^(le|la|les) ")])


@query("pattern_sections", rf"""WITH {LINES_SQL},
g AS (SELECT *, CASE WHEN contains(lower(line), 'license') THEN 'licence' WHEN regexp_matches(lower(line), '^the ') THEN 'the' WHEN regexp_matches(lower(line), '^(der|die|das) ') THEN 'german' WHEN regexp_matches(lower(line), '^(le|la|les) ') THEN 'french' END AS g FROM lines),
r AS (SELECT *, sum((g IS NOT NULL)::INT) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS section_no FROM g)
SELECT doc_id, section_no::BIGINT AS section_no, coalesce(max(g), 'preamble') AS section, min(char_start) AS char_start, max(char_start + length(line)) AS char_end, sum(length(regexp_replace(line, '[ \t\r\n]', '', 'g')))::BIGINT AS n_solid, count(*) AS n_lines FROM r GROUP BY doc_id, section_no""")
def pattern_sections(spark, sf):
    return segment.pattern_sections(docs(spark, sf), SECTIONS)


@query("hierarchy_tags", """
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_size || '.1' WHEN p_size % 3 = 1 THEN p_size::VARCHAR END AS section_id,
       CASE WHEN p_size % 3 = 0 THEN p_name WHEN p_size % 3 = 1 THEN p_type END AS section_title, CASE WHEN p_size % 3 = 0 THEN 'name' WHEN p_size % 3 = 1 THEN 'parent' ELSE 'none' END AS tag_source FROM part""")
def hierarchy_tags(spark, sf):
    third = F.col("p_size") % 3
    rows = t(spark, sf, "part").select("p_partkey", F.when(third == 0, F.concat(F.col("p_size").cast("string"), F.lit(".1 "), "p_name")).otherwise(F.col("p_name")).alias("name"), F.when(third == 1, F.concat(F.col("p_size").cast("string"), F.lit(". "), "p_type")).otherwise(F.col("p_type")).alias("up"))
    return segment.hierarchy_tags(rows, name="name", parent="up").select("p_partkey", "section_id", "section_title", "tag_source")


NUMBERS = "l_orderkey || CASE WHEN l_linenumber > 1 THEN '.' || (l_linenumber // 2) ELSE '' END || CASE WHEN l_linenumber > 3 THEN '.' || l_linenumber ELSE '' END"


def numbered(spark, sf):
    n = F.col("l_linenumber")
    half = F.floor(n / 2).cast("string")
    number = F.concat(F.col("l_orderkey").cast("string"), F.when(n > 1, F.concat(F.lit("."), half)).otherwise(""), F.when(n > 3, F.concat(F.lit("."), n.cast("string"))).otherwise(""))
    rows = t(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
    return segment.section_keys(rows.select("l_orderkey", "l_linenumber", number.alias("number"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("content")), number="number")


NUM_SQL = f"n AS (SELECT l_orderkey, l_linenumber, {NUMBERS} AS number, 'p' || min(l_partkey) AS content FROM lineitem GROUP BY 1, 2), k AS (SELECT *, list_transform(string_split(number, '.'), lambda x: x::INT) AS sort_key FROM n)"


@query("section_numbers", f"WITH {NUM_SQL} SELECT l_orderkey, l_linenumber, number, array_to_string(sort_key, '-') AS sort_key FROM k")
def section_numbers(spark, sf):
    return numbered(spark, sf).select("l_orderkey", "l_linenumber", "number", F.array_join(F.transform("sort_key", lambda x: x.cast("string")), "-").alias("sort_key"))


@query("section_tree_by_number", f"""WITH {NUM_SQL}
SELECT a.l_orderkey, a.l_linenumber, max(b.l_linenumber) AS parent_pos FROM k a LEFT JOIN k b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber < a.l_linenumber AND len(a.sort_key) > 1 AND b.sort_key = a.sort_key[: len(a.sort_key) - 1] GROUP BY 1, 2""")
def section_tree_by_number(spark, sf):
    return segment.number_tree(numbered(spark, sf), id="l_orderkey", pos="l_linenumber").select("l_orderkey", "l_linenumber", "parent_pos")


#: The lines of an order as headings of mixed styles: an article, dotted numbers, letters, bracketed letters, and some without a number.
OUTLINE = """
ol AS (SELECT l_orderkey AS doc, l_linenumber AS n, min(l_partkey) AS part FROM lineitem GROUP BY l_orderkey, l_linenumber),
oh AS (SELECT doc, n, CASE WHEN n = 1 THEN 'ARTICLE ' || CASE doc % 3 WHEN 0 THEN 'IV' WHEN 1 THEN 'IX' ELSE 'XL' END || ' - Terms' WHEN part % 6 = 0 THEN CAST(part % 4 AS STRING) || '. Rent' WHEN part % 6 = 1 THEN 'Section ' || CAST(part % 4 AS STRING) || '.' || CAST(n AS STRING) || ' Due'
  WHEN part % 6 = 2 THEN CAST(part % 4 AS STRING) || '.' || CAST(n % 3 AS STRING) || '.7 Late' WHEN part % 6 = 3 THEN chr(CAST(64 + n AS INT)) || '. Notes' WHEN part % 6 = 4 THEN '(' || chr(CAST(96 + n AS INT)) || ') more' ELSE 'General words' END AS heading FROM ol)"""


def outline(spark, sf):
    return segment.heading_numbers(over(spark, f"WITH {OUTLINE} SELECT * FROM oh", lineitem=t(spark, sf, "lineitem")), heading="heading")


_STYLES = (("dotted", r"^(?:Section )?([0-9]+(?:\.[0-9]+)*)\.? (.*)$"), ("roman", "^ARTICLE ([IVXL]+) - (.*)$"), ("upper", r"^([A-Z])\. (.*)$"), ("lower", r"^\(([a-z])\) (.*)$"))


@query("heading_numbers", f"""WITH {OUTLINE} SELECT doc, n, CASE {' '.join(f"WHEN regexp_matches(heading, '{p}') THEN '{name}'" for name, p in _STYLES)} END AS style, CASE {' '.join(f"WHEN regexp_matches(heading, '{p}') THEN regexp_extract(heading, '{p}', 1)" for _, p in _STYLES)} END AS number,
CASE {' '.join(f"WHEN regexp_matches(heading, '{p}') THEN regexp_extract(heading, '{p}', 2)" for _, p in _STYLES)} ELSE heading END AS title,
CASE WHEN starts_with(heading, 'ARTICLE') THEN (CASE doc % 3 WHEN 0 THEN 4 WHEN 1 THEN 9 ELSE 40 END)::VARCHAR WHEN regexp_matches(heading, '{_STYLES[0][1]}') THEN replace(regexp_extract(heading, '{_STYLES[0][1]}', 1), '.', '-') WHEN heading <> 'General words' THEN n::VARCHAR END AS sort_key FROM oh""")
def heading_numbers(spark, sf):
    return outline(spark, sf).select("doc", "n", "style", "number", "title", F.array_join(F.transform("sort_key", lambda x: x.cast("string")), "-").alias("sort_key"))


@query("number_outline")
def number_outline(spark, sf):
    """Parents, paths and orphans of headings in mixed styles."""
    return segment.number_outline(outline(spark, sf), id="doc", pos="n")


@query("section_children", f"WITH {NUM_SQL} SELECT a.l_orderkey, a.number AS parent, b.number AS child FROM k a JOIN k b USING (l_orderkey) WHERE len(b.sort_key) = len(a.sort_key) + 1 AND b.sort_key[: len(a.sort_key)] = a.sort_key")
def section_children(spark, sf):
    n = numbered(spark, sf).select("l_orderkey", "number")
    both = n.withColumnRenamed("number", "parent").join(n.withColumnRenamed("number", "child"), "l_orderkey")
    return both.filter(segment.is_child(F.col("parent"), F.col("child")))


@query("subtree_content", f"""WITH {NUM_SQL},
p AS (SELECT DISTINCT l_orderkey, sort_key FROM k)
SELECT p.l_orderkey, array_to_string(p.sort_key, '-') AS key, string_agg(c.content, chr(10) ORDER BY c.sort_key, c.content) AS full_content FROM p JOIN k c ON p.l_orderkey = c.l_orderkey AND c.sort_key[: len(p.sort_key)] = p.sort_key GROUP BY 1, 2""")
def subtree_content(spark, sf):
    full = segment.subtree_content(numbered(spark, sf), id="l_orderkey")
    return full.select("l_orderkey", F.array_join(F.transform("sort_key", lambda x: x.cast("string")), "-").alias("key"), "full_content")


@query("is_hierarchical", f"WITH {NUM_SQL} SELECT l_orderkey, round(avg(regexp_matches(number, '^[0-9]+\\.[0-9]+')::INT), 6) AS share, avg(regexp_matches(number, '^[0-9]+\\.[0-9]+')::INT) > 0.3 AS is_hierarchical FROM k GROUP BY 1")
def is_hierarchical(spark, sf):
    return segment.hierarchical_docs(numbered(spark, sf), id="l_orderkey", name="number")


@query("adjacent_grouping", """
WITH n AS (SELECT user_id, event_id, event_type, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS batch_no FROM n)
SELECT user_id, batch_no::BIGINT AS batch_no, event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM r GROUP BY 1, 2, 3""")
def adjacent_grouping(spark, sf):
    return segment.group_runs(t(spark, sf, "events"), key="user_id", order="event_id", category="event_type")


@query("chunk_telemetry", """
WITH c AS (SELECT lang AS category, CASE WHEN length(text) > 5000 THEN 'high' WHEN length(text) > 1500 THEN 'medium' ELSE 'low' END AS risk, ceil(length(text) / 4.0)::BIGINT AS tokens, contains(text, '!!') AS failed FROM documents)
SELECT category, risk, count(*) AS n_chunks, count(*) FILTER (failed) AS n_failed, sum(tokens)::BIGINT AS n_tokens, round(avg(tokens), 6) AS mean_tokens, count(*) FILTER (tokens > 1000) AS n_long FROM c GROUP BY GROUPING SETS ((category), (risk), ())""")
def chunk_telemetry(spark, sf):
    size = F.length("text")
    rows = t(spark, sf, "documents").select(F.col("lang").alias("category"), F.when(size > 5000, "high").when(size > 1500, "medium").otherwise("low").alias("risk"), segment.token_estimate(F.col("text")).alias("tokens"), F.contains(F.col("text"), F.lit("!!")).alias("failed"))
    return segment.telemetry(rows, category="category", risk="risk", tokens="tokens", failed="failed").drop("set_id")


@query("allcaps_numbered_fallback", rf"""WITH {LINES_SQL},
f AS (SELECT *, regexp_matches(line, '^[^ ]+ [^ ]+\.$') AS c, nullif(regexp_extract(line, '^([A-Z])[a-z]+', 1), '') AS n FROM lines),
m AS (SELECT *, CASE WHEN sum(c::INT) OVER (PARTITION BY doc_id) >= 2 THEN 'caps' WHEN count(n) OVER (PARTITION BY doc_id) >= 5 THEN 'numbered' END AS mode, last_value(n IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM f),
s AS (SELECT *, sum(CASE WHEN mode = 'caps' THEN c::INT ELSE (n IS NOT NULL AND n IS DISTINCT FROM last)::INT END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)::BIGINT AS section_no FROM m WHERE mode IS NOT NULL)
SELECT doc_id, mode, section_no, min(char_start) AS char_start, max(char_start + length(line)) AS char_end, count(*) AS n_lines FROM s WHERE section_no > 0 GROUP BY 1, 2, 3""")
def allcaps_numbered_fallback(spark, sf):
    """Two-word lines stand for headings in capitals, a line's first letter for its number."""
    return segment.fallback_sections(docs(spark, sf), caps=r"^[^ ]+ [^ ]+\.$", numbered="^([A-Z])[a-z]+", least_caps=2)


@query("semantic_chunks")
def semantic_chunks(spark, sf):
    """By the cosine of trigram vectors; see the tests for a plain version."""
    return segment.semantic_chunks(segment.sentences(docs(spark, sf)), id="doc_id", order="sent_no", text="sentence")
