"""The same questions asked of streams, over the data that is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from govaudit import catalog as cat
from govaudit.functions.actions import parse_actions
from govaudit.operators import replay, scan
from govaudit.plans import sql
from govaudit.plans.history import ROUNDS, WEAKNESS, _HISTORY
from govaudit.plans.registry import SQL, query
from govaudit.session import written
from govaudit.sources import bridge
from govaudit.streaming import activity, incremental, scorer, summary_tree
from govaudit.streaming.files import run_available, stream_table


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return stream_table(spark, sf_dir, f"{name}.parquet")


def _actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    actions = parse_actions(bridge.actions_from(_stream(spark, sf_dir, "events")))
    return actions.withColumn("ts", F.col("ts").cast("timestamp"))


@query(sql.query("SELECT packet_id, sector, array_to_string(detected, ',') AS detected FROM scan", "scan"))
def streamed_packet_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    packets = bridge.packets_from(_stream(spark, sf_dir, "customer"))
    found = scan.scan(packets).select("packet_id", "sector", F.array_join("detected", ",").alias("detected"))
    return run_available(found, "packet-scan")


@query(sql.query("""
  SELECT a.episode_id, a.seq,
    CASE WHEN s.seq IS NOT NULL THEN 'scored' WHEN a.seq > e.end_seq THEN 'post_terminal_action' ELSE 'invalid' END AS status,
    round(CASE WHEN s.seq IS NOT NULL THEN s.reward WHEN a.seq > e.end_seq THEN 0.0 ELSE -0.5 END, 6) AS reward
  FROM actions a LEFT JOIN steps s ON s.episode_id = a.episode_id AND s.seq = a.seq
  LEFT JOIN (SELECT episode_id, seq AS end_seq FROM steps WHERE terminal) e ON e.episode_id = a.episode_id""",
    "actions", "steps"))
def streamed_review_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned = replay.assignments(bridge.reviews(spark, sf_dir), bridge.packets(spark, sf_dir))
    scored = scorer.score_stream(_actions(spark, sf_dir), assigned)
    return (scored.filter("status <> 'silent'")
            .select("episode_id", "seq", "status", F.round("reward", 6).alias("reward")))


@query(sql.query("SELECT agent, round(elo_after, 4) AS rating, CAST(n AS BIGINT) AS n_rounds FROM history WHERE age = 1",
                 extra={"rounds": ROUNDS, "history": _HISTORY}))
def streamed_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounds = bridge.rounds_from(_stream(spark, sf_dir, "orders"))
    state = incremental.streamed_ratings(rounds, bridge.ROUND_ORDER)
    return state.select("agent", F.round("rating", 4).alias("rating"), "n_rounds")


@query(sql.query("SELECT agent, code, total, missed, CAST(rate AS BIGINT) AS rate FROM rates", extra={
    k: WEAKNESS[k] for k in ("misses", "rates")}))
def streamed_weakness(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = bridge.miss_outcomes_from(_stream(spark, sf_dir, "lineitem"))
    return incremental.streamed_weakness(outcomes, bridge.MISS_ORDER)


@query(SQL["streamed_weakness"])
def streamed_weakness_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same state from a stored tree of summaries, a leaf for every 360 days."""
    outcomes = bridge.miss_outcomes_from(_stream(spark, sf_dir, "lineitem"))
    rows = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in outcomes.schema)
    return summary_tree.streamed_weakness(outcomes, rows, bridge.MISS_ORDER, F.expr("unix_date(CAST(seen_at AS DATE)) DIV 360"))


@query(sql.query("""
  SELECT strftime(day, '%Y-%m-%d') AS day, coalesce(action_type, 'invalid') AS action_type, CAST(count(*) AS BIGINT) AS n_actions
  FROM (SELECT *, date_trunc('day', ts) AS day, max(ts) OVER () - INTERVAL 1 HOUR AS mark FROM actions)
  WHERE day + INTERVAL 1 DAY <= mark GROUP BY ALL""", "actions"))
def streamed_action_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = run_available(activity.action_counts(_actions(spark, sf_dir)), "action-counts")
    return counts.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "action_type", "n_actions")


@query(sql.query("""
  SELECT agent, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, CAST(count(*) AS BIGINT) AS n_actions
  FROM (SELECT *, sum(is_new) OVER (PARTITION BY agent ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS session FROM (
    SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY agent ORDER BY ts, seq) + INTERVAL 12 HOUR OR
        lag(ts) OVER (PARTITION BY agent ORDER BY ts, seq) IS NULL THEN 1 ELSE 0 END AS is_new,
      max(ts) OVER () - INTERVAL 1 HOUR AS mark FROM actions))
  GROUP BY agent, session HAVING max(ts) + INTERVAL 12 HOUR <= max(mark)""", "actions"))
def streamed_reviewer_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = run_available(activity.reviewer_sessions(_actions(spark, sf_dir)), "sessions")
    return sessions.select("agent", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "n_actions")


DECISION_OF = {"A": cat.DECISIONS[0], "R": cat.DECISIONS[1], "N": cat.DECISIONS[2]}


def decided_violations(orders: DataFrame, lineitem: DataFrame, packets: DataFrame) -> DataFrame:
    """Violations of submitted packets per 30 days of decision time. An order submits its customer's
    packet, a line decides about its order; ``packets`` is a table, scanned and written once before the
    stream begins, and joined by a merge: not each batch's work, and nobody holds it whole."""
    submissions = orders.select(F.col("o_orderkey").alias("submission_id"), F.col("o_custkey").alias("packet_id"),
                                F.col("o_orderdate").cast("timestamp").alias("submitted_at"))
    decisions = lineitem.select(F.col("l_orderkey").alias("submission_id"), F.element_at(cat.literal_map(DECISION_OF), F.col("l_returnflag")).alias("decision"),
                                F.col("l_shipdate").cast("timestamp").alias("decided_at"))
    decided = activity.decided_submissions(submissions, decisions, "submission_id")
    scanned = written(scan.scan(packets).select("packet_id", "detected"), "scanned-packets")
    found = decided.join(scanned.hint("merge"), "packet_id")
    return activity.violation_counts(found, "decided_at", "30 days", "decision")


@query(sql.query(f"""
  SELECT strftime(start, '%Y-%m-%d') AS window_start, code, decision, CAST(count(*) AS BIGINT) AS n_violations FROM (
    SELECT unnest(s.detected) AS code, {sql.case_map('l_returnflag', DECISION_OF, 'NULL')} AS decision,
      TIMESTAMP '1970-01-01' + to_days(CAST(30 * (date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) // 30) AS INTEGER)) AS start
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 90 DAY
    JOIN scan s ON s.packet_id = o_custkey)
  WHERE start + INTERVAL 30 DAY <= (SELECT least((SELECT max(o_orderdate) FROM orders), (SELECT max(l_shipdate) FROM lineitem)) - INTERVAL 1 HOUR - INTERVAL 90 DAY)
  GROUP BY ALL""", "scan"))
def streamed_violations_by_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = run_available(decided_violations(_stream(spark, sf_dir, "orders"), _stream(spark, sf_dir, "lineitem"), bridge.packets(spark, sf_dir)),
                           "violation-windows")
    return counts.select(F.date_format("window_start", "yyyy-MM-dd").alias("window_start"), "code", "decision", "n_violations")
