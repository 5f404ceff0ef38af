"""Reviewer against maker: outcomes, running counts, leaderboard."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from govaudit import catalog as cat
from govaudit.operators.folds import PIECE_BITS, ordered_pieces, running_offsets
from govaudit.operators.rating import latest_pieces, won
from govaudit.session import cut_lineage


def round_outcomes(rounds: DataFrame, order: list[str], bits: int = PIECE_BITS, keep: int | None = None) -> DataFrame:
    """Every round with its number, winner and the running win counts.

    Starts a job. Counts run inside pieces of bounded length on top of per-piece offsets, so
    a session of any length is spread over many tasks. ``keep``: only pieces that
    hold an agent's last ``keep`` rounds are taken apart.
    """
    item = F.struct(*[F.col(c) for c in order], won(F.col("overall")).alias("won"))
    # numbered once: two evaluations of the pieces need not agree
    pieces = cut_lineage(ordered_pieces(rounds, ["agent"], order, item, bits))
    wins = F.size(F.filter("items", lambda x: x.getField("won"))).cast("bigint")
    placed = running_offsets(pieces, ["agent"], {"rounds": F.col("n").cast("bigint"), "wins": wins}, bits)
    placed = placed if keep is None else latest_pieces(placed, keep)
    rows = (placed.repartition("agent", "piece")
            .select("agent", "piece", "rounds_before", "wins_before", F.posexplode("items").alias("pos", "item")))
    inside = Window.partitionBy("agent", "piece").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = rows.select(
        "agent", "item.*", (F.col("rounds_before") + F.col("pos") + 1).alias("round"),
        (F.col("wins_before") + F.sum(F.col("item.won").cast("bigint")).over(inside)).alias("reviewer_wins"))
    return (counted
            .withColumn("outcome", F.when(F.col("won"), "reviewer").otherwise("maker"))
            .withColumn("maker_wins", F.col("round") - F.col("reviewer_wins"))
            .withColumn("reviewer_win_rate", F.col("reviewer_wins") / F.col("round"))
            .drop("won"))


def leaderboard(rounds: DataFrame, order: list[str]) -> DataFrame:
    """Totals, win rates, mean of the last ten scores and the recent trend.

    Totals are map-side combined; the recent part keeps ten rounds per agent
    before and after the shuffle.
    """
    reviewer = won(F.col("overall"))
    totals = rounds.groupBy("agent").agg(
        F.count(F.lit(1)).alias("total_rounds"), F.sum(reviewer.cast("bigint")).alias("reviewer_wins"))
    newest = Window.partitionBy("agent").orderBy(*[F.desc(c) for c in order])
    recent = (rounds.withColumn("age", F.row_number().over(newest)).filter(F.col("age") <= 10)
              .groupBy("agent").agg(
                  F.avg("overall").alias("avg_score"),
                  F.sum(F.when((F.col("age") <= 5) & reviewer, 1).otherwise(0)).alias("recent_wins")))
    return (totals.join(recent, "agent")
            .withColumn("maker_wins", F.col("total_rounds") - F.col("reviewer_wins"))
            .withColumn("reviewer_win_rate", F.col("reviewer_wins") / F.greatest(F.lit(1), F.col("total_rounds")))
            .withColumn("maker_win_rate", F.col("maker_wins") / F.greatest(F.lit(1), F.col("total_rounds")))
            .withColumn("trend", F.when(F.col("recent_wins") >= 3, cat.TREND_UP).otherwise(cat.TREND_DOWN))
            .drop("recent_wins"))
