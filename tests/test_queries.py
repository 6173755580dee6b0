"""Every query of the library against DuckDB on the smallest tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

from sedge.plans import catalogue


#: What SQL does not express is compared with plain versions in test_library.py.
PLAIN_VERSIONS = ("artifact_rows", "label_communities", "number_outline", "overlapping_headings", "refined_communities", "scan_artifacts", "semantic_chunks", "standard_clauses")


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(name, spark, sf_dir, duck):
    got = catalogue.QUERIES[name](spark, sf_dir)
    rows = got.collect()
    if name not in catalogue.ORACLE_SQL:
        assert name in PLAIN_VERSIONS
        return
    want = duck.execute(catalogue.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert rows_of(got.columns, rows) == rows_of(names, want.fetchall())


def test_no_python_in_gates_and_risks(spark, sf_dir):
    for name in ("text_quality_gate", "weighted_doc_classifier", "rule_risks", "missing_categories"):
        plan = catalogue.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Cartesian" not in plan
