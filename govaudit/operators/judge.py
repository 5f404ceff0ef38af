"""Verdicts over graded reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govaudit import catalog as cat
from govaudit.operators.grade import ratio


def judge_grade(score: Column) -> Column:
    return cat.band(score, cat.JUDGE_BANDS, cat.JUDGE_FAIL)


def is_unsafe_approval() -> Column:
    return F.coalesce((F.col("expected_decision") == "reject") & (F.col("decision") == "approve"), F.lit(False))


def decision_correct() -> Column:
    return F.col("decision").eqNullSafe(F.col("expected_decision"))


def rule_based_verdict(graded: DataFrame) -> DataFrame:
    """Verdict without a panel: detection 40 %, a neutral 0.5 for reasoning
    20 %, the decision 40 %."""
    decision = (F.when(decision_correct(), 1.0).when(is_unsafe_approval(), 0.05).otherwise(0.35))
    scored = graded.select(
        "*", ratio(F.size("caught"), F.size("truth")).alias("detection_accuracy"),
        F.lit(0.5).alias("reasoning_quality"), decision.alias("decision_appropriateness"))
    names = ["detection_accuracy", "reasoning_quality", "decision_appropriateness"]
    weights = [0.4, 0.2, 0.4]
    total = sum((F.col(n) * F.lit(w) for n, w in zip(names, weights)), F.lit(0.0))
    return (scored.withColumn("judge_overall", F.least(F.lit(1.0), total))
            .withColumn("judge_grade", judge_grade(F.round("judge_overall", 4))))


def persona_pool(persona_scores: DataFrame, reviews: DataFrame) -> DataFrame:
    """Weighted panel score per episode.

    ``persona_scores``: episode_id, persona (focus), score.  A missing score
    counts 0.5, others are clamped to [0, 1]; so does a review without any.
    ``reviews``: episode_id, decision, expected_decision.  The three personas are summed in one map-side
    combined aggregation.
    """
    weights = {focus: weight for _, focus, weight in cat.PERSONAS}
    aggregates = []
    for focus in weights:
        # greatest and least skip NULLs, so a missing score is kept out of them.
        given = (F.col("persona") == focus) & F.col("score").isNotNull()
        own = F.when(given, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score"))))
        aggregates.append(F.coalesce(F.max(own), F.lit(0.5)).alias(focus))
    pooled = persona_scores.groupBy("episode_id").agg(*aggregates)
    total = sum((F.col(n) * F.lit(w) for n, w in weights.items()), F.lit(0.0))
    return (reviews.join(pooled, "episode_id", "left").fillna(0.5, list(weights))
            .withColumn("pooled", F.when(is_unsafe_approval(), F.least(total, F.lit(0.2))).otherwise(total))
            .withColumn("pooled", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("pooled"))))
            .withColumn("judge_grade", judge_grade(F.round("pooled", 4))))


def feedback() -> Column:
    """Summary line of a panel verdict."""
    missed = F.concat(F.lit("["), F.array_join(F.transform("missed", lambda c: F.concat(F.lit("'"), c, F.lit("'"))), ", "),
                      F.lit("]"))
    judges = ", ".join(name for name, _, _ in cat.PERSONAS)
    return F.concat(F.lit(f"Judged by: {judges}. Missed: "), missed,
                    F.lit(". Decision "), F.when(decision_correct(), "✓").otherwise("✗"), F.lit("."))
