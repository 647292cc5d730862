"""Texts of CHECK rules are cut once, and by all cores."""

from __future__ import annotations

from rowloom.operators import checks


def test_long_rules_are_cut_once_and_spread(spark):
    rule = " AND ".join(f"((a{i} = 1 AND b{i} = 'it''s') OR a{i} = {i})" for i in range(30))
    texts = spark.createDataFrame([("t", rule), ("t", "a = 1"), ("t", "a > 1 AND b > 2")], "table_name string, expr string").coalesce(1)
    for found, rows in ((checks.value_factors(texts), 90), (checks.value_combinations(texts.where("expr = 'a = 1'")), 0)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract_all") <= 2
        assert found.count() == rows
    assert checks.plain_spelling(texts).rdd.getNumPartitions() > 1
