"""Queries over agents' histories: ratings, miss rates, rounds, memory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from govaudit import catalog as cat
from govaudit.operators import judge, leaderboard as board, memory, rating, weakness
from govaudit.plans import sql
from govaudit.plans.registry import SQL, query
from govaudit.plans.reviews import VERDICT, graded_reviews, joined, rounded
from govaudit.plans.sql import band, q
from govaudit.operators import grade, scan
from govaudit.session import new_path, written
from govaudit.sources import bridge, keyed_runs, state
from govaudit.sources.bridge import MISS_ORDER, ROUND_ORDER

# Means of at most 20 scores have up to 11 decimals that end; rounding there
# never meets a tie, which the two engines would round differently.

# --- ratings -----------------------------------------------------------------

_R = cat.RATING
ROUNDS = "SELECT o_custkey AS agent, o_orderdate AS played_at, o_orderkey AS round_id, o_totalprice / 500000.0::DOUBLE AS overall FROM orders"


def _task(r: str) -> str:
    return f"CASE WHEN {r} + 100 < 1100 THEN 1 WHEN {r} + 100 < 1400 THEN 2 ELSE 3 END"


def _gain(r: str, won: str) -> str:
    opponent = f"CASE WHEN {r} + 100 < 1100 THEN 950.0 WHEN {r} + 100 < 1400 THEN 1250.0 ELSE 1550.0 END"
    return f"32.0::DOUBLE * ({won} - 1 / (1 + pow(10.0::DOUBLE, (({opponent}) - {r}) / 400.0::DOUBLE)))"


def _fold(items: str) -> str:
    return f"list_reduce({items}, lambda r, x: greatest(400.0::DOUBLE, r + {_gain('r', 'x')}), 1000.0::DOUBLE)"


_ROUND_SORT = "played_at, round_id, overall"
_HISTORY = f"""
  SELECT *, {_fold('upto[:-2]')} AS rating, {_fold('upto')} AS elo_after FROM (
    SELECT *, list(CASE WHEN overall >= 0.75 THEN 1.0 ELSE 0.0 END::DOUBLE) OVER (PARTITION BY agent ORDER BY {_ROUND_SORT}
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
      row_number() OVER (PARTITION BY agent ORDER BY {_ROUND_SORT}) AS n,
      row_number() OVER (PARTITION BY agent ORDER BY played_at DESC, round_id DESC, overall DESC) AS age FROM rounds)"""


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rating.round_pieces(bridge.rounds(spark, sf_dir), ROUND_ORDER)


@query(sql.query(f"""
  SELECT agent, round(elo_after, 4) AS rating, CAST(n AS BIGINT) AS n_rounds, {band('elo_after', cat.RATING_BANDS, cat.RATING_LOW)} AS band,
    {_task('elo_after')} AS recommended_task FROM history WHERE age = 1""", extra={"rounds": ROUNDS, "history": _HISTORY}))
def rating_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = rating.rating_state(rating.piece_ratings(_pieces(spark, sf_dir)))
    return state.select("agent", F.round("rating", 4).alias("rating"), "n_rounds", "band", "recommended_task")


_SHOWN_BEFORE = f"elo_after - {_gain('rating', 'CASE WHEN overall >= 0.75 THEN 1.0 ELSE 0.0 END')}"


@query(sql.query(f"""
  SELECT agent, round_id, round({_SHOWN_BEFORE}, 4) AS elo_before, round(elo_after, 4) AS elo_after,
    round(overall, 8) AS score, {_task('rating')} AS task_id, overall >= 0.75 AS won FROM history WHERE age <= 50""",
    extra={"rounds": ROUNDS, "history": _HISTORY}))
def rating_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = _pieces(spark, sf_dir)
    history = rating.rating_history(rating.latest_pieces(pieces, cat.HISTORY_KEPT), rating.piece_ratings(pieces))
    kept = rating.latest(history, ROUND_ORDER)
    return kept.select("agent", "round_id", F.round("elo_before", 4).alias("elo_before"),
                       F.round("elo_after", 4).alias("elo_after"), F.round("overall", 8).alias("score"), "task_id", "won")


# --- rounds ------------------------------------------------------------------

_OUTCOMES = f"""
  SELECT agent, round_id, round, CASE WHEN overall >= 0.75 THEN 'reviewer' ELSE 'maker' END AS outcome, reviewer_wins,
    round - reviewer_wins AS maker_wins, round(reviewer_wins / round, 6) AS reviewer_win_rate FROM (
    SELECT *, CAST(row_number() OVER w AS BIGINT) AS round,
      CAST(count(*) FILTER (WHERE overall >= 0.75) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS reviewer_wins
    FROM rounds WINDOW w AS (PARTITION BY agent ORDER BY {_ROUND_SORT}))"""


@query(sql.query(_OUTCOMES, extra={"rounds": ROUNDS}))
def round_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return board.round_outcomes(bridge.rounds(spark, sf_dir), ROUND_ORDER).select(
        "agent", "round_id", "round", "outcome", "reviewer_wins", "maker_wins", *rounded("reviewer_win_rate"))


@query(sql.query(f"SELECT agent, round_id, round, reviewer_wins FROM (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY "
                 f"round DESC) AS age FROM ({_OUTCOMES})) WHERE age <= 20", extra={"rounds": ROUNDS}))
def kept_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounds = board.round_outcomes(bridge.rounds(spark, sf_dir), ROUND_ORDER, keep=cat.ROUNDS_KEPT)
    return rating.latest(rounds, ["round"], cat.ROUNDS_KEPT).select("agent", "round_id", "round", "reviewer_wins")


@query(sql.query(f"""
  SELECT agent, CAST(count(*) AS BIGINT) AS total_rounds, CAST(count(*) FILTER (WHERE won) AS BIGINT) AS reviewer_wins,
    CAST(count(*) FILTER (WHERE NOT won) AS BIGINT) AS maker_wins,
    round(count(*) FILTER (WHERE won) / greatest(1, count(*)), 6) AS reviewer_win_rate,
    round(count(*) FILTER (WHERE NOT won) / greatest(1, count(*)), 6) AS maker_win_rate,
    CASE WHEN count(*) FILTER (WHERE won AND age <= 5) >= 3 THEN {q(cat.TREND_UP)} ELSE {q(cat.TREND_DOWN)} END AS trend,
    round(avg(overall) FILTER (WHERE age <= 10), 11) AS avg_score
  FROM (SELECT *, overall >= 0.75 AS won FROM history) GROUP BY 1""", extra={"rounds": ROUNDS, "history": _HISTORY}))
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = board.leaderboard(bridge.rounds(spark, sf_dir), ROUND_ORDER)
    return table.select("agent", "total_rounds", "reviewer_wins", "maker_wins",
                        *rounded("reviewer_win_rate", "maker_win_rate"), "trend", F.round("avg_score", 11).alias("avg_score"))


@query(sql.query("""
  SELECT agent, round(recent_avg, 11) AS recent_avg, n_recent, CAST(task_id AS BIGINT) AS task_id,
    CAST(CASE WHEN n_recent >= 5 AND recent_avg > 0.72 AND task_id < 3 THEN task_id + 1 ELSE task_id END AS BIGINT) AS next_task
  FROM (SELECT agent, avg(overall) AS recent_avg, CAST(count(*) AS BIGINT) AS n_recent, agent % 3 + 1 AS task_id
        FROM history WHERE age <= 5 GROUP BY agent)""", extra={"rounds": ROUNDS, "history": _HISTORY}))
def mastery_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = bridge.rounds(spark, sf_dir).withColumn("task_id", F.col("agent") % 3 + 1)
    return memory.mastery_gate(scores, ROUND_ORDER).select(
        "agent", F.round("recent_avg", 11).alias("recent_avg"), "n_recent", "task_id", "next_task")


@query(sql.query("SELECT agent, CAST(count(*) AS BIGINT) AS total_episodes, round(avg(overall) FILTER (WHERE age <= 20), 11) "
                 "AS avg_grader_score FROM history GROUP BY 1", extra={"rounds": ROUNDS, "history": _HISTORY}))
def rolling_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = memory.rolling_score(bridge.rounds(spark, sf_dir), ROUND_ORDER, score="overall")
    return scores.select("agent", "total_episodes", F.round("avg_grader_score", 11).alias("avg_grader_score"))


# --- miss rates --------------------------------------------------------------

_MISSES = f"""
  SELECT l_suppkey AS agent, ({sql.CODES})[(l_partkey % 8) + 1] AS code, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS missed,
    l_shipdate AS seen_at, l_orderkey AS k1, l_linenumber AS k2, l_partkey AS k3 FROM lineitem"""
_RATES = """
  SELECT agent, code, CAST(count(*) AS BIGINT) AS total, CAST(sum(missed) AS BIGINT) AS missed,
    list_reduce(list(missed::BIGINT ORDER BY seen_at, k1, k2, k3, missed),
      lambda m, x: (30000 * x + 7 * m + 5) // 10, 5000::BIGINT) AS rate FROM misses GROUP BY 1, 2"""
_WEAKNESS = f"""
  SELECT a.agent, c.code, c.ord, coalesce(r.total, 0) AS total, coalesce(r.missed, 0) AS missed, coalesce(r.rate, 5000) AS rate
  FROM (SELECT DISTINCT agent FROM misses) a
  CROSS JOIN (SELECT unnest({sql.CODES}) AS code, unnest(range(8)) AS ord) c
  LEFT JOIN rates r ON r.agent = a.agent AND r.code = c.code"""
WEAKNESS = {"misses": _MISSES, "rates": _RATES, "weakness": _WEAKNESS}


def weakness_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weakness.weakness_state(bridge.miss_outcomes(spark, sf_dir), MISS_ORDER)


@query(sql.query("SELECT agent, code, total, missed, CAST(rate AS BIGINT) AS rate FROM weakness", extra=WEAKNESS))
def weakness_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weakness_table(spark, sf_dir).select("agent", "code", "total", "missed", "rate")


@query(sql.query("""
  SELECT agent, round(avg_miss_rate, 8) AS avg_miss_rate,
    CASE WHEN avg_miss_rate > 0.6 THEN 'easy' WHEN avg_miss_rate > 0.35 THEN 'medium' ELSE 'hard' END AS difficulty,
    array_to_string(ranked[1:4], ',') AS top_weaknesses
  FROM (SELECT agent, avg(rate) / 10000 AS avg_miss_rate, list(code ORDER BY rate DESC, ord) AS ranked FROM weakness GROUP BY 1)""",
    extra=WEAKNESS))
def curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = weakness.curriculum(weakness_table(spark, sf_dir))
    return found.select("agent", F.round("avg_miss_rate", 8).alias("avg_miss_rate"), "difficulty", *joined("top_weaknesses"))


@query(sql.query("""
  SELECT agent, code, CAST(row_number() OVER (PARTITION BY agent ORDER BY rate DESC, ord) AS INTEGER) AS place,
    '  ' || rpad(code, 16, ' ') || ' ' || repeat('█', CAST(rate * 10 // 10000 AS INTEGER)) || repeat('░', CAST(10 - rate * 10 // 10000 AS INTEGER))
    || ' ' || CAST(round_even(rate / 100.0::DOUBLE, 0) AS INTEGER) || '% miss (' || missed || '/' || total || ' episodes)' AS line
  FROM weakness""", extra=WEAKNESS))
def weakness_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weakness.weakness_lines(weakness_table(spark, sf_dir))


# --- episode memory ----------------------------------------------------------

_JUDGES = ", ".join(name for name, _, _ in cat.PERSONAS)
_OK = "decision IS NOT DISTINCT FROM expected_decision"
_MEMORY = f"""
  SELECT *, {_OK} AS decision_correct, row_number() OVER (PARTITION BY agent ORDER BY bucket DESC) AS age,
    row_number() OVER (PARTITION BY agent ORDER BY bucket) AS i,
    {q('Judged by: ' + _JUDGES + '. Missed: ')} || '[' || array_to_string(list_transform(missed, lambda c: '''' || c || ''''), ', ')
      || ']. Decision ' || CASE WHEN {_OK} THEN '✓' ELSE '✗' END || '.' AS feedback
  FROM verdicts"""
MEMORY = {"verdicts": VERDICT, "memory": _MEMORY}


def episode_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge.rule_based_verdict(graded_reviews(spark, sf_dir)).withColumn("judge_feedback", judge.feedback())
    return memory.episode_memory(judged)


@query(sql.query(f"""
  SELECT agent, episode_id, round(overall, 6) AS grader_overall, round(safety, 6) AS grader_safety,
    {sql.listed('caught')} AS caught_violations, {sql.listed('missed')} AS missed_violations, {sql.listed('false_codes')} AS false_positives,
    decision AS final_decision, expected_decision, decision_correct, judge_grade, feedback AS judge_feedback FROM memory""",
    "grades", extra=MEMORY))
def episode_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return episode_memories(spark, sf_dir).select(
        "agent", "episode_id", *rounded("grader_overall", "grader_safety"),
        *joined("caught_violations", "missed_violations", "false_positives"),
        "final_decision", "expected_decision", "decision_correct", "judge_grade", "judge_feedback")


def _frequent(column: str, top: int) -> str:
    return f"""
      SELECT * FROM (SELECT agent, code, CAST(n AS BIGINT) AS n,
        CAST(row_number() OVER (PARTITION BY agent ORDER BY n DESC, first_i, first_j) AS INTEGER) AS place FROM (
        SELECT agent, code, count(*) AS n, min(i) AS first_i, arg_min(j, i * 1000 + j) AS first_j FROM (
          SELECT agent, i, unnest({column}) AS code, unnest(range(len({column}))) AS j FROM memory WHERE age <= 10)
        GROUP BY 1, 2)) WHERE place <= {top}"""


@query(sql.query(_frequent("missed", 3), "grades", extra=MEMORY))
def frequently_missed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.frequent_codes(episode_memories(spark, sf_dir), ["bucket"], "missed_violations", 3)


@query(sql.query(_frequent("false_codes", 2), "grades", extra=MEMORY))
def frequent_false_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.frequent_codes(episode_memories(spark, sf_dir), ["bucket"], "false_positives", 2)


@query(sql.query("""
  SELECT agent, CAST(count(*) AS BIGINT) AS n_decided, CAST(count(*) FILTER (WHERE decision_correct) AS BIGINT) AS n_correct,
    round(avg(decision_correct::INT), 6) AS accuracy FROM memory WHERE age <= 5 AND decision IS NOT NULL GROUP BY 1""",
    "grades", extra=MEMORY))
def decision_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = memory.decision_accuracy(episode_memories(spark, sf_dir), ["bucket"])
    return found.select("agent", "n_decided", "n_correct", *rounded("accuracy"))


@query(sql.query("SELECT agent, left(feedback, 200) AS feedback FROM memory WHERE age = 1", "grades", extra=MEMORY))
def latest_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.latest_feedback(episode_memories(spark, sf_dir), ["bucket"])


# --- state tables, written and read back -------------------------------------

@query(SQL["rating_history"])
def saved_rating_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kept ratings from the table that a run leaves for the next one."""
    found = rating_history(spark, sf_dir)
    path = new_path(spark, "rating-history")
    state.save_history(found, path, ["round_id"], cat.HISTORY_KEPT)
    return state.load_or_empty(spark, path, found.schema.simpleString()[7:-1].replace(":", " "))


@query(SQL["episode_memory"])
def saved_episode_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews remembered in two runs, read back as one table."""
    found = episode_memory(spark, sf_dir)
    path = new_path(spark, "memory")
    first = F.pmod(F.xxhash64("episode_id"), F.lit(2)) == 0
    for part in (found.filter(first), found.filter(~first)):
        state.append_memory(part, path)
    return spark.read.parquet(path).select(found.columns)


@query(SQL["episode_memory"])
def remembered_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews remembered in three runs, the last of them made twice, and put into one base in between: every
    review is there once, as its newest run has it."""
    found = written(episode_memory(spark, sf_dir), "reviews")
    path = new_path(spark, "memory-runs")
    late = F.pmod(F.xxhash64("episode_id"), F.lit(2)) == 0
    keyed_runs.append_run(found.withColumn("judge_feedback", F.lit("to be judged")), path, 1)
    keyed_runs.append_run(found.filter(~late), path, 2)
    keyed_runs.compact(spark, path, found.schema, ["episode_id"])
    for _ in range(2):
        keyed_runs.append_run(found.filter(late), path, 3)
    return keyed_runs.read_newest(spark, path, found.schema, ["episode_id"])


@query(sql.query("SELECT packet_id, sector, unnest(detected) AS code FROM scan", "scan"))
def saved_audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit results written as JSON lines by sector, read back."""
    path = new_path(spark, "audits")
    state.save_audits(scan.violations(bridge.packets(spark, sf_dir)).select("packet_id", "sector", "code"), path)
    return spark.read.schema("packet_id BIGINT, code STRING, sector STRING").json(path)


_GIVEN = ("o_orderkey AS round_id, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice / 400000.0 END AS safety, "
          "o_totalprice / 600000.0 AS compliance, o_totalprice / 250000.0 - 0.1 AS completeness, "
          "o_totalprice / 700000.0 AS precision, o_totalprice / 800000.0 AS mitigation_quality, o_totalprice / 900000.0 AS overall")


@query(f"""SELECT round_id, round(safety, 9) AS safety, round(completeness, 9) AS completeness FROM (SELECT {_GIVEN} FROM orders)
  WHERE safety IS NULL OR safety > 1 OR completeness > 1 OR completeness < 0""")
def rejected_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores that are missing or out of range."""
    given = bridge.table(spark, sf_dir, "orders").selectExpr(*_GIVEN.split(", "))
    return given.filter(~grade.in_range()).select("round_id", F.round("safety", 9).alias("safety"), F.round("completeness", 9).alias("completeness"))
