"""Queries give the same rows whatever is asked of them, and plans keep their shape."""

import re

import pytest

from govaudit.plans.registry import QUERIES, load_all

load_all()


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("partitions", [8, 200])
@pytest.mark.parametrize("name", ["round_outcomes", "kept_rounds", "rating_history", "weakness_states", "persona_panel", "reward_log"])
def test_actions_agree(spark, name, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        df = QUERIES[name](spark, "/root/testdata/sf0.01")
        rows = df.collect()
        assert df.count() == len(rows)
        column = df.columns[0]
        assert sum(r["count"] for r in df.groupBy(column).count().collect()) == len(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_reviews_reach_all_packets(spark):
    packets = {r.packet_id for r in QUERIES["review_states"](spark, "/root/testdata/sf0.01").select("packet_id").collect()}
    assert max(packets) > 1000 and len(packets) > 300


def test_rules_are_evaluated_once(spark, sf_dir):
    count = lambda name: len(re.findall(r"lower\(", plan_of(QUERIES[name](spark, sf_dir))))
    assert count("rule_results") <= count("violations_by_sector") + 1


def test_one_row_per_review_in_the_panel(spark, sf_dir):
    panel = QUERIES["persona_panel"](spark, sf_dir)
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert panel.count() == documents.selectExpr("floor(doc_id / 3) AS e").distinct().count()
