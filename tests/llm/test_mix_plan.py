"""Plans of the mix hold no step twice."""

from __future__ import annotations

from sedge.llm.mixing import mix_plan


def test_last_step_reads_tables(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 9), "abc"[i % 3]) for i in range(60)], "doc_id long, text string, source string")
    plan = mix_plan(docs)
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 1  # the last document per source
    assert plan.count() == 60
