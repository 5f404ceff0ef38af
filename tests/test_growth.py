"""What a task holds doesn't grow with the tables."""

import datetime

import pytest

from govaudit.plans import reviews, streams
from govaudit.sources import bridge


@pytest.fixture(scope="module")
def customers(spark):
    """Enough customers for three tasks, in one part."""
    return spark.range(2 * bridge.PACKETS_PER_TASK + 1).coalesce(1).selectExpr(
        "id AS c_custkey", "CAST(id % 25 AS INT) AS c_nationkey", "'BUILDING' AS c_mktsegment")


@pytest.fixture(scope="module")
def tables(customers, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("growth"))
    customers.write.parquet(f"{folder}/customer.parquet")
    customers.selectExpr("c_custkey AS p_partkey", "'SMALL TIN' AS p_type").write.parquet(f"{folder}/part.parquet")
    return folder


def test_packets_are_dealt_over_tasks(spark, tables, customers):
    for packets in (bridge.packets(spark, tables), bridge.template_packets(spark, tables)):
        assert packets.rdd.getNumPartitions() == 3
        assert packets.select("packet_id").exceptAll(customers.select("c_custkey")).count() == 0 and packets.count() == customers.count()
    assert bridge.dealt(customers.limit(5)).rdd.getNumPartitions() == 1


@pytest.mark.parametrize("name", ["planned_reviews", "planned_reviews_of_templates", "approving_reviewer", "rejecting_reviewer"])
def test_planned_logs_are_dealt_by_their_number(spark, tables, name):
    plan = getattr(reviews, name)(spark, tables)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [episode_id" in plan and "], 3" in plan


def test_a_checkpoint_of_steps_keeps_what_is_used(spark, sf_dir, monkeypatch):
    kept = []
    monkeypatch.setattr(reviews, "cut_lineage", lambda df: kept.append(df.columns) or df)
    for query in (reviews.every_action, reviews.reward_log, reviews.reward_log_with_short_limit):
        query(spark, sf_dir)
    assert len(kept) == 3 and not {"raw", "note", "artifact_names", "inspected", "parts"} & {c for columns in kept for c in columns}
    assert "reason" not in kept[0]


def test_packets_are_scanned_before_the_stream(spark, customers):
    day = datetime.datetime(2024, 1, 1)
    orders = spark.createDataFrame([(1, 3, day)], "o_orderkey BIGINT, o_custkey BIGINT, o_orderdate TIMESTAMP")
    lines = spark.createDataFrame([(1, "R", day)], "l_orderkey BIGINT, l_returnflag STRING, l_shipdate TIMESTAMP")
    found = streams.decided_violations(orders, lines, bridge.packets_from(customers.limit(9)))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "logging" not in plan and "strategy=merge" in plan
    assert {(r.code, r.decision, r.n_violations) for r in found.collect()} == {("PII-001", "reject", 1), ("ACCESS-002", "reject", 1)}
