"""Grading reviews: five dimensions, letter bands, regret, explanation."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govaudit import catalog as cat
from govaudit.operators.replay import causal_hints

DIMENSIONS = list(cat.SCORE_WEIGHTS)


def clamp(value: Column) -> Column:
    return F.greatest(F.lit(cat.SCORE_MIN), F.least(F.lit(cat.SCORE_MAX), value))


def ratio(part: Column, whole: Column) -> Column:
    """part / max(1, whole)."""
    return part / F.greatest(F.lit(1), whole)


def caught(truth: Column, flagged: Column) -> Column:
    return F.filter(truth, lambda c: F.array_contains(flagged, c))


def missed(truth: Column, flagged: Column) -> Column:
    return F.filter(truth, lambda c: ~F.array_contains(flagged, c))


def is_safe(truth: Column, flagged: Column) -> Column:
    """Every critical or high code of the truth was flagged (also if none)."""
    return ~F.exists(truth, lambda c: cat.severity_of(c).isin(*cat.SEVERE) & ~F.array_contains(flagged, c))


def grade(state: DataFrame) -> DataFrame:
    """Adds the five dimensions, ``overall``, ``is_safe``, ``caught`` and ``missed``."""
    truth, flagged = F.col("truth"), F.col("flagged")
    found = state.select(
        "*", is_safe(truth, flagged).alias("is_safe"),
        caught(truth, flagged).alias("caught"), missed(truth, flagged).alias("missed"))
    n_caught = F.size("caught")
    with_dimensions = found.select(
        "*",
        clamp(F.when(F.col("is_safe"), 1.0).otherwise(0.0)).alias("safety"),
        clamp(ratio(n_caught, F.size(truth))).alias("compliance"),
        clamp(ratio(F.size("inspected"), F.size("artifact_names"))).alias("completeness"),
        clamp(ratio(F.size(flagged), F.size(flagged) + F.size("false_codes"))).alias("precision"),
        clamp(ratio(F.size(caught(F.col("caught"), F.col("mitigated"))), n_caught)).alias("mitigation_quality"))
    overall = functools.reduce(operator.add, [F.col(n) * F.lit(w) for n, w in cat.SCORE_WEIGHTS.items()])
    return with_dimensions.withColumn("overall", clamp(overall))


def review_grade(overall: Column) -> Column:
    return cat.band(overall, cat.REVIEW_BANDS, cat.REVIEW_FAIL)


def in_range(*scores: str) -> Column:
    """All six scores present and within [0, 1]; false sends a row to rejects."""
    checks = [F.coalesce(F.col(s).between(0.0, 1.0), F.lit(False)) for s in (scores or [*DIMENSIONS, "overall"])]
    return functools.reduce(operator.and_, checks)


def optimal_reward(n_artifacts: Column, n_truth: Column) -> Column:
    """What a perfect review is credited with: inspections, flags with
    mitigations, the risk, the decision, minus the tax on the fewest steps."""
    steps = n_artifacts + n_truth * 2 + 3
    return F.lit(0.2) * n_artifacts + F.lit(0.7) + F.lit(2.5) * n_truth + F.lit(6.5) - F.lit(0.05) * steps


def with_regret(graded: DataFrame) -> DataFrame:
    best = graded.withColumn("optimal_reward", F.round(optimal_reward(F.size("artifact_names"), F.size("truth")), 3))
    gap = best.withColumn("regret", F.round(F.greatest(F.lit(0.0), F.col("optimal_reward") - F.col("total_reward")), 3))
    return gap.withColumn("regret_pct", F.col("regret") / F.greatest(F.lit(0.01), F.col("optimal_reward")) * 100)


def explain(graded: DataFrame) -> DataFrame:
    """One explanation row per review.

    The verdict uses the plain safety fact; the clamped score never reaches 1.
    """
    missed_list = F.concat(F.lit("["), F.array_join(F.transform("missed", lambda c: F.concat(F.lit("'"), c, F.lit("'"))), ", "),
                           F.lit("]"))
    return (with_regret(graded)
            .withColumn("causal_hints", causal_hints())
            .withColumn("safety_verdict", F.when(F.col("is_safe"), F.lit("✅ SAFE — caught all critical violations"))
                        .otherwise(F.concat(F.lit("🚨 UNSAFE — missed: "), missed_list))))


def step_breakdown(log: DataFrame) -> DataFrame:
    """Reward log per episode as one ordered array (bounded by the step limit)."""
    return log.groupBy("episode_id").agg(F.array_sort(F.collect_list(
        F.struct("seq", "step", "action_type", "detail", "reward", "reason"))).alias("step_breakdown"))


def rule_scan_baseline(scanned: DataFrame) -> DataFrame:
    """Scores of the plain rule scan against the declared truth, per packet.

    Completeness counts as full and mitigation as half; nothing is clamped
    except the upper end of ``overall``.
    """
    truth, found = F.col("truth"), F.col("detected")
    scored = scanned.select(
        "*", F.when(is_safe(truth, found), 1.0).otherwise(0.0).alias("safety"),
        ratio(F.size(caught(found, truth)), F.size(truth)).alias("compliance"),
        ratio(F.size(caught(found, truth)), F.size(found)).alias("precision"),
        F.lit(1.0).alias("completeness"), F.lit(0.5).alias("mitigation_quality"))
    w = cat.SCORE_WEIGHTS
    total = functools.reduce(operator.add, [F.col(n) * F.lit(w[n]) for n in w])
    return scored.withColumn("overall", F.least(F.lit(1.0), total))
