"""Table functions for SQL: ``register`` makes them known to a session. The DataFrame operators do the same without Python."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


class TextTables:
    """``text_tables(text, least_lines)``: the cells of the delimited blocks of a text under their headers."""

    def eval(self, text: str, least_lines: int):
        runs, last = [], None
        for line in (text or "").split("\n"):
            sep = "\t" if "\t" in line else "|" if "|" in line else None
            kind = sep and (sep, line.count(sep))
            if kind and kind == last:
                runs[-1][1].append(line)
            elif kind:
                runs.append((sep, [line]))
            last = kind
        for block_no, (sep, lines) in enumerate((r for r in runs if len(r[1]) >= least_lines), 1):
            rows = [[c.strip(" \t\r") for c in line.split(sep)] for line in lines]
            for row_no, row in enumerate(rows[1:], 1):
                for col_no, (header, value) in enumerate(zip(rows[0], row, strict=True)):
                    yield block_no, row_no, col_no, header, value


class FlatValues:
    """``flat_values(values)``: key and value of each entry of a map, in the order of keys; one General row for an empty one."""

    def eval(self, values: dict):
        if not values:
            yield "General", None
        for key in sorted(values or {}):
            yield key, values[key]


def register(spark: SparkSession) -> None:
    cells = "block_no int, row_no int, col_no int, header string, value string"
    spark.udtf.register("text_tables", F.udtf(TextTables, returnType=cells))
    spark.udtf.register("flat_values", F.udtf(FlatValues, returnType="key string, value string"))
