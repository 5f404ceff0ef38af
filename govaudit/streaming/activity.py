"""Activity over event time: tumbling windows and reviewer sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def action_counts(actions: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Actions per window and type; malformed ones count as ``invalid``."""
    kind = F.coalesce("action_type", F.lit("invalid")).alias("action_type")
    return (actions.withWatermark("ts", late)
            .groupBy(F.window("ts", window), kind).agg(F.count(F.lit(1)).alias("n_actions"))
            .select(F.col("window.start").alias("window_start"), "action_type", "n_actions"))


def reviewer_sessions(actions: DataFrame, gap: str = "12 hours", late: str = "1 hour") -> DataFrame:
    """Spells of activity per agent that no gap interrupts."""
    return (actions.withWatermark("ts", late)
            .groupBy("agent", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n_actions"))
            .select("agent", F.col("session_window.start").alias("session_start"),
                    F.col("session_window.end").alias("session_end"), "n_actions"))


def decided_submissions(submissions: DataFrame, decisions: DataFrame, key: str, within: str = "90 days", late: str = "1 hour") -> DataFrame:
    """Submissions with the decisions made of them between ``submitted_at`` and ``within`` later.

    Two streams with a watermark each, joined by the key and a range of event
    time: Spark drops a submission from its state once no decision in range can
    come any more, and a decision once no earlier submission can, so the state
    holds what arrives within ``within`` and ``late``, not the history.
    """
    sent = submissions.withWatermark("submitted_at", late)
    made = decisions.withColumnRenamed(key, "_key").withWatermark("decided_at", late)
    return sent.join(made, F.expr(
        f"{key} = _key AND decided_at >= submitted_at AND decided_at <= submitted_at + INTERVAL {within}")).drop("_key")


def violation_counts(found: DataFrame, at: str, window: str, *by: str) -> DataFrame:
    """Violations per window of the time ``at``, code and the columns ``by``; ``found`` has ``detected``, an array of codes.

    ``at`` must carry a watermark; a window comes out when it is closed.
    """
    return (found.select(at, *by, F.explode("detected").alias("code"))
            .groupBy(F.window(at, window), "code", *by).agg(F.count(F.lit(1)).alias("n_violations"))
            .select(F.col("window.start").alias("window_start"), "code", *by, "n_violations"))
