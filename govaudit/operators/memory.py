"""What an agent's recent reviews say about it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from govaudit import catalog as cat
from govaudit.operators.judge import decision_correct
from govaudit.operators.rating import latest


def episode_memory(judged: DataFrame) -> DataFrame:
    """One remembered row per graded review."""
    return judged.select(
        "agent", "episode_id", "bucket", "packet_id", F.col("overall").alias("grader_overall"),
        F.col("safety").alias("grader_safety"), F.col("caught").alias("caught_violations"),
        F.col("missed").alias("missed_violations"), F.col("false_codes").alias("false_positives"),
        F.col("decision").alias("final_decision"), "expected_decision",
        decision_correct().alias("decision_correct"), "judge_grade", "judge_feedback")


def rolling_score(memory: DataFrame, order: list[str], score: str = "grader_overall", last: int = 20) -> DataFrame:
    """Mean of the last 20 scores per agent, and how many reviews there are."""
    n = memory.groupBy("agent").agg(F.count(F.lit(1)).alias("total_episodes"))
    recent = latest(memory, order, last).groupBy("agent").agg(F.avg(score).alias("avg_grader_score"))
    return n.join(recent, "agent")


def mastery_gate(scores: DataFrame, order: list[str], score: str = "overall") -> DataFrame:
    """Next task per agent: one up after five scores averaging above 0.72.

    ``scores`` carries the agent's current ``task_id``.
    """
    gate = cat.MASTERY
    recent = latest(scores, order, gate["window"]).groupBy("agent").agg(
        F.avg(score).alias("recent_avg"), F.count(F.lit(1)).alias("n_recent"), F.max("task_id").alias("task_id"))
    up = ((F.col("n_recent") >= gate["window"]) & (F.col("recent_avg") > gate["threshold"])
          & (F.col("task_id") < gate["top_task"]))
    return recent.withColumn("next_task", F.when(up, F.col("task_id") + 1).otherwise(F.col("task_id")))


def frequent_codes(memory: DataFrame, order: list[str], column: str, top: int, last: int = 10) -> DataFrame:
    """Most frequent codes of a list column over the last reviews of an agent;
    ties go to the code seen first."""
    window = latest(memory, order, last)
    oldest_first = Window.partitionBy("agent").orderBy(*order)
    rows = (window.withColumn("_i", F.row_number().over(oldest_first))
            .select("agent", "_i", F.posexplode(column).alias("_j", "code")))
    counts = rows.groupBy("agent", "code").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("_i", "_j")).alias("_first"))
    place = F.row_number().over(Window.partitionBy("agent").orderBy(F.desc("n"), "_first"))
    return counts.withColumn("place", place).filter(F.col("place") <= top).select("agent", "code", "n", "place")


def decision_accuracy(memory: DataFrame, order: list[str], last: int = 5) -> DataFrame:
    """Share of right decisions among the decided of the last reviews."""
    decided = latest(memory, order, last).filter(F.col("final_decision").isNotNull())
    return decided.groupBy("agent").agg(
        F.count(F.lit(1)).alias("n_decided"), F.sum(F.col("decision_correct").cast("bigint")).alias("n_correct"),
        F.avg(F.col("decision_correct").cast("double")).alias("accuracy"))


def latest_feedback(memory: DataFrame, order: list[str], last: int = 5) -> DataFrame:
    """Newest non-empty judge feedback among the last reviews, cut to 200."""
    spoken = latest(memory, order, last).filter(F.coalesce(F.col("judge_feedback"), F.lit("")) != "")
    newest = F.max_by("judge_feedback", F.struct(*order))
    return spoken.groupBy("agent").agg(F.left(newest, F.lit(200)).alias("feedback"))
