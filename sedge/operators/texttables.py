"""Tables inside texts: runs of delimited lines, their cells, types, checks and roll-ups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def delimited_blocks(lines: DataFrame, *, id: str, least_lines: int = 3, delimiters: Sequence[str] = ("\t", "|")) -> DataFrame:
    """Lines of runs with equal, positive counts of one delimiter: id, block_no, row_no (0 = header), line_no, line, delimiter, head (the header's line).

    A line's delimiter is the first of ``delimiters`` that it holds.
    """
    rows = lines.groupBy(id).agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("_l"))
    return _runs(rows, id=id, least_lines=least_lines, delimiters=delimiters)


def text_blocks(df: DataFrame, *, id: str, text: str = "text", least_lines: int = 3, delimiters: Sequence[str] = ("\t", "|")) -> DataFrame:
    """``delimited_blocks`` of the lines of whole texts, one row each: nothing is shuffled or sorted."""
    held = reduce(or_, (F.contains(F.col(text), F.lit(d)) for d in delimiters))
    split = df.filter(held).select(id, F.split(F.col(text), "\n").alias("_t"))
    rows = split.select(id, F.transform("_t", lambda x, i: F.struct(i.alias("line_no"), x.alias("line"))).alias("_l"))
    return _runs(rows, id=id, least_lines=least_lines, delimiters=delimiters)


def _runs(rows: DataFrame, *, id: str, least_lines: int, delimiters: Sequence[str]) -> DataFrame:
    """Blocks of (id, _l: array of (line_no, line)), found inside each row in time linear in its lines."""

    def kind(x: Column) -> Column:
        count = lambda d: F.length(x["line"]) - F.length(F.replace(x["line"], F.lit(d), F.lit("")))
        return F.coalesce(*[F.when(count(d) > 0, F.struct(F.lit(d).alias("delimiter"), count(d).alias("n"))) for d in delimiters])

    kinds = rows.withColumn("_k", F.transform("_l", kind))
    begins = F.filter(F.sequence(F.lit(0), F.size("_k") - 1), lambda i: (i == 0) | ~F.get("_k", i).eqNullSafe(F.get("_k", i - 1)))
    starts = kinds.withColumn("_s", begins)
    n = lambda s, j: F.coalesce(F.get("_s", j + 1), F.size("_k")) - s
    spans = F.filter(F.transform("_s", lambda s, j: F.struct(s.alias("s"), n(s, j).alias("n"), F.get("_k", s)["delimiter"].alias("delimiter"))), lambda r: r["delimiter"].isNotNull() & (r["n"] >= least_lines))
    found = starts.withColumn("_r", spans)  # no filter here: pushed down, it would put these columns' expressions inside each other's lambdas
    whole = F.transform("_r", lambda r: F.struct(r["delimiter"].alias("delimiter"), F.get("_l", r["s"])["line"].alias("head"), F.slice("_l", r["s"] + 1, r["n"]).alias("rows")))
    blocks = found.select(id, F.posexplode(whole).alias("_b", "_x")).select(id, (F.col("_b") + 1).alias("block_no"), F.col("_x.delimiter").alias("delimiter"), F.col("_x.head").alias("head"), F.col("_x.rows").alias("_rows"))
    each = blocks.select(id, "block_no", "delimiter", "head", F.posexplode("_rows").alias("row_no", "_y"))
    return each.select(id, "block_no", "row_no", F.col("_y.line_no").alias("line_no"), F.col("_y.line").alias("line"), "delimiter", "head")


#: A line of dashes, colons and blanks between pipes.
RULER = r"^[ \t]*\|?[ \t]*:?-+:?[ \t]*(\|[ \t]*:?-+:?[ \t]*)*\|?[ \t\r]*$"


def markdown_blocks(lines: DataFrame, *, id: str) -> DataFrame:
    """Tables of a pipe line, a ruler and pipe lines: id, block_no, row_no (0 = header), line_no, values, head (the header's values).

    Of the pipe lines in a row the first one before a ruler is the header, and all after the ruler are rows.

    Blank cells go; a row stays if it has as many cells as the header, and a table if any row stays.
    """
    w = Window.partitionBy(id).orderBy("line_no")
    pipe = F.contains("line", F.lit("|"))
    ruler = pipe & F.col("line").rlike(RULER)
    values = F.filter(F.transform(F.split("line", r"\|"), lambda c: F.btrim(c, F.lit(" \t\r"))), lambda c: c != "")
    rows = lines.withColumn("_pipe", pipe).withColumn("_ruler", ruler).withColumn("_head", F.col("_pipe") & ~F.col("_ruler") & F.coalesce(F.lead("_ruler").over(w), F.lit(False)))
    rows = rows.withColumn("_run", F.sum((~F.col("_pipe")).cast("int")).over(w)).filter("_pipe").withColumn("values", values)
    whole, run = Window.partitionBy(id, "_run"), Window.partitionBy(id, "_run").orderBy("line_no")
    rows = rows.withColumn("_at", F.col("line_no") - F.min(F.when(F.col("_head"), F.col("line_no"))).over(whole)).filter("_at >= 0 AND _at <> 1")
    rows = rows.withColumn("_n", F.max(F.when(F.col("_at") == 0, F.size("values"))).over(whole)).filter(F.size("values") == F.col("_n"))
    rows = rows.withColumn("_size", F.count("*").over(whole)).filter("_size > 1")
    number = F.dense_rank().over(Window.partitionBy(id).orderBy("_run")).alias("block_no")
    return rows.select(id, number, (F.row_number().over(run) - 1).alias("row_no"), "line_no", "values", F.first("values").over(run).alias("head"))


def cells(blocks: DataFrame, *, id: str) -> DataFrame:
    """(id, block_no, row_no, col_no, header, value): trimmed cells under the block's first line. ``blocks`` is of either kind."""
    if "values" in blocks.columns:
        parts = lambda c: F.col("values" if c == "line" else c)
    else:
        parts = lambda c: F.transform(F.split(c, F.concat(F.lit("\\Q"), "delimiter", F.lit("\\E"))), lambda x: F.btrim(x, F.lit(" \t\r")))
    long = blocks.filter("row_no > 0").select(id, "block_no", "row_no", parts("line").alias("_p"), parts("head").alias("_h"))
    both = F.slice(F.arrays_zip(F.col("_h").alias("header"), F.col("_p").alias("value")), 1, F.least(F.size("_h"), F.size("_p")))
    return long.select(id, "block_no", "row_no", F.posexplode(both).alias("col_no", "_c")).select(id, "block_no", "col_no", "row_no", F.col("_c.value").alias("value"), F.col("_c.header").alias("header"))


def dedup_tables(cells_df: DataFrame, *, id: str) -> DataFrame:
    """(id, block_no, n_copies, digest, n_cells): the first table of each group with the same headers and rows in a document.

    A digest joins four 64-bit sums over a table's cells, each hashed with its place, so no task holds a table's cells.
    """
    lanes = [F.bit_xor(F.xxhash64(F.lit(i), "row_no", "col_no", F.coalesce("header", F.lit("")), F.col("header").isNull(), F.coalesce("value", F.lit("")), F.col("value").isNull())).alias(f"_h{i}") for i in range(4)]
    sums = cells_df.groupBy(id, "block_no").agg(*lanes, F.count("*").alias("n_cells"))
    tables = sums.withColumn("digest", F.sha2(F.concat_ws(",", "n_cells", *[f"_h{i}" for i in range(4)]), 256))
    return tables.groupBy(id, "digest").agg(F.min("block_no").alias("block_no"), F.count("*").alias("n_copies"), F.min("n_cells").alias("n_cells"))


def type_score(cells_df: DataFrame, kinds: Sequence[tuple[str, Sequence[str], Sequence[str]]], *, id: str) -> DataFrame:
    """(id, block_no, kind, score): .6 x share of a kind's header words found + .4 x share of its content words in the first rows; the best, ties to the first.

    Words are sought in each cell; only one with a blank, which may lie across cells, needs a table's distinct cells in one string.
    """
    sought = {("header", w.lower()) for _, heads, _ in kinds for w in heads} | {("value", w.lower()) for _, _, words in kinds for w in words}
    names = {pair: f"_w{i}" for i, pair in enumerate(sorted(sought))}

    def seen(column: str, word: str) -> Column:
        cell = F.col("header") if column == "header" else F.when(F.col("row_no") <= 3, F.col("value"))
        if not word or " " in word:
            return F.contains(F.lower(F.concat_ws(" ", F.array_sort(F.collect_set(cell)))), F.lit(word))
        return F.coalesce(F.bool_or(F.contains(F.lower(cell), F.lit(word))), F.lit(False))

    rows = cells_df.groupBy(id, "block_no").agg(*[seen(*pair).alias(name) for pair, name in names.items()])
    share = lambda c, ws: sum((F.col(names[c, w.lower()]).cast("double") for w in ws), F.lit(0.0)) / max(len(ws), 1)
    scored = [F.struct(F.round(0.6 * share("header", h) + 0.4 * share("value", b), 6).alias("score"), F.lit(-i).alias("rank"), F.lit(k).alias("kind")) for i, (k, h, b) in enumerate(kinds)]
    return rows.withColumn("_t", F.array_max(F.array(*scored))).select(id, "block_no", F.col("_t.kind").alias("kind"), F.col("_t.score").alias("score"))


#: Words that mark a cell as vacant.
VACANT = ("", "vacant", "available", "empty", "tbd", "n/a")


def typed_tables(cells_df: DataFrame, kinds: Sequence[tuple[str, Sequence[str], Sequence[str]]], *, id: str, least: float = 0.5, low: float = 0.2, boost: float = 1.2) -> DataFrame:
    """(id, block_no, kind, score, confidence): tables whose type is known well enough. Confidence is the score if it is over ``least``, else ``low``; tables
    cut at delimiters, as all ``cells`` are, get ``boost`` times that, 1 at most; those not over ``least`` go."""
    scored = type_score(cells_df, kinds, id=id)
    confidence = F.least(F.lit(1.0), boost * F.when(F.col("score") > least, F.col("score")).otherwise(low))
    return scored.withColumn("confidence", F.round(confidence, 6)).filter(F.col("confidence") > least)


def validate_typed(cells_df: DataFrame, types: DataFrame, numeric: Sequence[str], *, id: str) -> DataFrame:
    """``validate`` with kind (of ``types``: id, block_no, kind): a table of one of the ``numeric`` kinds must also hold a digit in some cell."""
    digit = F.bool_or(F.col("value").rlike("[0-9]")).alias("_digit")
    rows = _validated(cells_df, digit, id=id).join(types.select(id, "block_no", "kind"), [id, "block_no"], "left")
    needs = F.coalesce(F.col("kind").isin(*numeric), F.lit(False))
    return rows.withColumn("valid", F.col("valid") & (~needs | F.col("_digit"))).drop("_digit")


def cost_shares(cells_df: DataFrame, *, id: str, near: float = 0.01) -> DataFrame:
    """(id, block_no, percent_total, fully_allocated): the sum of the percentages in a table's cells, and whether it is 100 but for ``near``. Tables without any are left out."""
    share = F.expr(r"try_cast(nullif(regexp_extract(value, '([0-9]+(?:\\.[0-9]+)?) ?%', 1), '') as decimal(38, 6))")
    sums = cells_df.withColumn("_p", share).filter("_p IS NOT NULL").groupBy(id, "block_no").agg(F.sum("_p").alias("_s"))
    return sums.select(id, "block_no", F.col("_s").cast("double").alias("percent_total"), (F.abs(F.col("_s") - 100) <= F.lit(near).cast("decimal(18,6)")).alias("fully_allocated"))


def occupancy(cells_df: DataFrame, *, id: str, area: str = "area|sq|feet|size", vacant_words: Sequence[str] = VACANT) -> DataFrame:
    """(id, block_no, total_area, occupied_area, rate): a row's area is the first number under a header that fits ``area``; rows with a vacant cell are not occupied. Tables without an area are left out."""
    number = F.expr(r"try_cast(nullif(regexp_replace(value, '[^0-9.]', ''), '') as decimal(38, 6))")
    hit = F.lower("header").rlike(area)
    rows = cells_df.withColumn("_x", F.when(hit, number)).groupBy(id, "block_no", "row_no").agg(
        F.min_by("_x", F.when(F.col("_x").isNotNull(), F.col("col_no"))).alias("_a"), F.bool_or(~hit & F.lower("value").isin(*vacant_words)).alias("_v")
    )
    sums = rows.groupBy(id, "block_no").agg(F.sum("_a").alias("_t"), F.coalesce(F.sum(F.when(~F.col("_v"), F.col("_a"))), F.lit(0)).alias("_o")).filter("_t IS NOT NULL")
    return sums.select(id, "block_no", F.col("_t").cast("double").alias("total_area"), F.col("_o").cast("double").alias("occupied_area"), F.round(F.try_divide(F.col("_o").cast("double"), F.col("_t").cast("double")), 6).alias("rate"))


def validate(cells_df: DataFrame, *, id: str) -> DataFrame:
    """(id, block_no, n_rows, n_cols, valid): two rows and columns at least, 80 % of headers distinct, 30 % of cells filled."""
    return _validated(cells_df, id=id)


def _validated(cells_df: DataFrame, *more: Column, id: str) -> DataFrame:
    """``validate`` with ``more`` aggregates of a table's cells."""
    v = cells_df.groupBy(id, "block_no").agg(F.max("row_no").cast("long").alias("n_rows"), F.countDistinct("col_no").alias("n_cols"), F.countDistinct("header").alias("_h"), F.avg((F.col("value") != "").cast("int")).alias("_f"), *more)
    ok = (F.col("n_rows") >= 2) & (F.col("n_cols") >= 2) & (F.col("_h") >= 0.8 * F.col("n_cols")) & (F.col("_f") >= 0.3)
    return v.select(id, "block_no", "n_rows", "n_cols", ok.alias("valid"), *v.columns[6:])


def top_tables(tables: DataFrame, *, id: str, score: str, k: int = 10) -> DataFrame:
    w = Window.partitionBy(id).orderBy(F.desc(score), "block_no")
    return tables.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= k)


def rollups(cells_df: DataFrame, *, id: str, vacant_words: Sequence[str] = VACANT) -> DataFrame:
    """Per block: sum and mean of the positive numbers in its cells, and cells that are vacant."""
    number = F.expr(r"try_cast(regexp_replace(value, '[^0-9.-]', '') as decimal(38, 6))")
    rows = cells_df.withColumn("_x", F.when(number > 0, number))
    vacant = F.lower("value").isin(*vacant_words)
    return rows.groupBy(id, "block_no").agg(F.sum("_x").cast("double").alias("total"), F.round(F.avg(F.col("_x").cast("double")), 6).alias("mean"), F.count_if(vacant).alias("n_vacant"), F.count("*").alias("n_cells"))


def tables_as_clauses(tables: DataFrame, clauses: DataFrame, *, doc: str, key: str, confidence: str, more_than: int = 5) -> DataFrame:
    """One clause row per table (kind, score, block_no) of documents with more than ``more_than`` clauses, under the clauses' columns."""
    many = clauses.groupBy(doc).agg(F.count("*").alias("_n")).filter(F.col("_n") > more_than).select(doc)
    rows = tables.join(many, doc, "left_semi").select(doc, F.concat_ws("_", F.lit("table"), "kind", F.col("block_no").cast("string")).alias(key), F.col("score").alias(confidence), (F.col("score") < 0.5).alias("needs_review"))
    return clauses.select(doc, key, confidence, (F.col(confidence) < 0.5).alias("needs_review")).unionByName(rows)
