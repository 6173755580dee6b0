"""Joins that deal hot keys: nothing is hot in a small table, and hot keys lose no row."""

from __future__ import annotations

import pytest

from sedge.llm.common import salted_join


def _tables(spark, counts):
    rows = spark.createDataFrame([(k, i) for k, n in counts.items() for i in range(n)], "k long, i long")
    keys = spark.createDataFrame([(k, f"v{k}") for k in counts if k is not None], "k long, v string")
    return rows, keys, rows.groupBy("k").count().withColumnRenamed("count", "m")


def test_small_tables_are_joined_plainly(spark):
    rows, keys, sizes = _tables(spark, {k: k % 5 + 1 for k in range(100)})  # each key holds more than a thousandth of the rows
    for out in (salted_join(rows, keys.join(sizes, "k"), "k", size="m", salt=["i"]).drop("m"), salted_join(rows, keys, "k", size="m", salt=["i"], sizes=sizes)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "_salt" not in plan and "Union" not in plan
        assert sorted(map(tuple, out.collect())) == sorted((k, i, f"v{k}") for k in range(100) for i in range(k % 5 + 1))


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("most", [5, 900])
def test_hot_and_null_keys(spark, how, most):
    counts = {1: most, 2: 3, 3: 1, None: 4}
    rows, keys, sizes = _tables(spark, counts)
    out = salted_join(rows, keys, "k", size="m", salt=["i"], how=how, sizes=sizes.filter("k IS NOT NULL"))
    assert ("sequence" in out._jdf.queryExecution().analyzed().toString()) == (most > 200)
    want = [(str(k), i, f"v{k}" if k else "None") for k, n in counts.items() for i in range(n) if k or how == "left"]
    assert sorted((str(r.k), r.i, str(r.v)) for r in out.collect()) == sorted(want)
