"""Replaying review logs: what each action earned and where it left the review.

Shape of the plan (one row per action throughout, no UDF):

1. ``live_actions`` keeps, per episode, the first ``max_steps`` well-formed and
   the first ``max_steps`` malformed actions.  That is always enough: a review
   ends at the latest with its ``max_steps``-th well-formed action.  Spark runs
   the limit before the shuffle as well, so an episode holding a third of a
   huge log sends at most ``2 * max_steps`` rows per map task.
2. Everything after that partitions by episode and shares one exchange.

Results that need every row (exact step counts, the fate of each logged action)
come from ``episode_lengths`` and ``every_action``, which join the log to one
row per episode and leave hot episodes to the skew join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from govaudit import catalog as cat
from govaudit.catalog import REWARD, STEP_MESSAGES, severity_sql
from govaudit.functions.sqltext import mapping, text, texts

DECIDES = "(action_type IN ('approve', 'reject', 'escalate'))"
SEVERE = "('critical', 'high')"
MISSED = "filter(truth, m -> NOT array_contains(flagged, m))"


def assignments(reviews: DataFrame, packets: DataFrame) -> DataFrame:
    """One row per episode with what the review is measured against."""
    field = packets.schema["artifacts"].dataType
    if isinstance(field, T.StructType):
        names = F.array_compact(F.array(*[
            F.when(F.col("artifacts").getField(n).isNotNull(), F.lit(n)) for n in field.fieldNames()]))
    else:
        names = F.map_keys("artifacts")
    facts = packets.select("packet_id", "truth", "expected_risk", "expected_decision", names.alias("artifact_names"))
    return reviews.join(facts, "packet_id")


def live_actions(actions: DataFrame, max_steps: int = cat.MAX_STEPS) -> DataFrame:
    """Actions up to the end of each review, with ``step`` and ``terminal``.

    ``step`` counts malformed actions too.  It is exact up to ``max_steps``; for
    a review that outlasts it on malformed actions see ``episode_lengths``.
    """
    by_kind = Window.partitionBy("episode_id", "valid").orderBy("seq")
    by_seq = Window.partitionBy("episode_id").orderBy("seq")
    earlier = by_seq.rowsBetween(Window.unboundedPreceding, -1)
    decides = F.col("action_type").isin(cat.DECISIONS)
    return (actions
            .withColumn("_rank", F.row_number().over(by_kind))
            .filter(F.col("_rank") <= max_steps).drop("_rank")
            .withColumn("step", F.row_number().over(by_seq))
            .withColumn("terminal", F.col("valid") & (decides | (F.col("step") >= max_steps)))
            .withColumn("_ended", F.coalesce(F.max("terminal").over(earlier), F.lit(False)))
            .filter(~F.col("_ended")).drop("_ended"))


def replay(actions: DataFrame, assigned: DataFrame, max_steps: int = cat.MAX_STEPS) -> DataFrame:
    """One row per counted action: reward, reason and the state after it.

    State columns: ``inspected``, ``flagged``, ``false_codes``, ``mitigated``
    (arrays in order of occurrence) and ``risk``.  ``parts`` splits the reward.
    """
    counted = live_actions(actions, max_steps).filter("valid").selectExpr("*", f"""CASE action_type
        WHEN '{cat.INSPECT}' THEN coalesce(target, '') WHEN '{cat.FLAG}' THEN coalesce(issue_code, '')
        WHEN '{cat.MITIGATE}' THEN coalesce(nullif(issue_code, ''), target, '') ELSE '' END AS key""")
    # Both sides are partitioned by episode already or for this join only; a
    # merge join keeps that partitioning for all windows that follow.
    rows = counted.join(assigned.hint("merge"), "episode_id")

    by_key = "(PARTITION BY episode_id, key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    so_far = "(PARTITION BY episode_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"

    def seen(flag: str) -> str:
        return f"coalesce(max({flag}) OVER {by_key}, false)"

    def running(flag: str, name: str) -> str:
        return f"collect_list(CASE WHEN {flag} THEN key END) OVER {so_far} AS {name}"

    rows = (
        rows.selectExpr(
            "*", f"action_type = '{cat.INSPECT}' AND array_contains(artifact_names, key) AS _inspect",
            f"action_type = '{cat.FLAG}' AND array_contains(truth, key) AS _flag")
        .selectExpr("*", f"{seen('_inspect')} AS _inspected", f"{seen('_flag')} AS _flagged")
        .selectExpr("*", f"action_type = '{cat.MITIGATE}' AND _flagged AS _mitigate")
        .selectExpr(
            "*", "_inspect AND NOT _inspected AS new_inspect", "_flag AND NOT _flagged AS new_flag",
            f"_mitigate AND NOT {seen('_mitigate')} AS new_mitigation",
            f"action_type = '{cat.FLAG}' AND key <> '' AND NOT _flag AS wrong_flag",
            f"coalesce(severity = {severity_sql('key')}, false) AS right_severity")
        .selectExpr(
            "*", running("new_inspect", "inspected"), running("new_flag", "flagged"),
            running("wrong_flag", "false_codes"), running("new_mitigation", "mitigated"),
            f"last(CASE WHEN action_type = '{cat.SET_RISK}' THEN severity END, true) OVER {so_far} AS risk",
            f"terminal AND NOT {DECIDES} AS timed_out"))
    # The parts first, then their sum: a CASE per part is evaluated once.
    return (rows.selectExpr("*", f"{_parts()} AS parts")
            .selectExpr("*", " + ".join(f"parts.{p}" for p in PARTS) + " AS reward")
            .selectExpr("*", f"sum(reward) OVER {so_far} AS total_so_far")
            .selectExpr("*", f"{_reason()} AS reason")
            .drop("_inspect", "_flag", "_inspected", "_flagged", "_mitigate"))


PARTS = ["inspection", "flagging", "false_positive", "mitigation", "risk", "decision", "missed", "tax"]


def _parts() -> str:
    """The reward of a row by category; the fields add up to the reward."""
    r = {name: f"{amount}D" for name, amount in REWARD.items()}
    missed = (f"aggregate({MISSED}, 0D, (a, c) -> a + CASE WHEN {severity_sql('c')} IN {SEVERE} "
              f"THEN {r['missed_severe']} ELSE {r['missed']} END)")
    values = {
        "inspection": f"""CASE WHEN action_type <> '{cat.INSPECT}' THEN 0D WHEN NOT _inspect THEN {r['inspect_unknown']}
            WHEN NOT new_inspect THEN 0D ELSE {r['inspect']}
              + CASE WHEN size(inspected) = 1 THEN {r['inspect_first']} ELSE 0D END
              + CASE WHEN size(inspected) = size(artifact_names) THEN {r['inspect_last']} ELSE 0D END END""",
        "flagging": f"""CASE WHEN action_type = '{cat.FLAG}' AND key = '' THEN {r['flag_empty']}
            WHEN new_flag AND right_severity THEN {r['flag_severity']} WHEN new_flag THEN {r['flag']} ELSE 0D END""",
        "false_positive": f"""CASE WHEN wrong_flag THEN {r['flag_wrong']}
            WHEN {DECIDES} THEN size(false_codes) * {r['final_fp']} ELSE 0D END""",
        "mitigation": f"""CASE WHEN action_type = '{cat.MITIGATE}' AND NOT _flagged THEN {r['mitigate_early']}
            WHEN new_mitigation THEN {r['mitigate']}
            WHEN {DECIDES} THEN size(mitigated) * {r['final_mitigated']} ELSE 0D END""",
        "risk": f"""CASE WHEN action_type = '{cat.SET_RISK}' AND severity IS NULL THEN {r['risk_missing']}
            WHEN action_type = '{cat.SET_RISK}' AND severity = expected_risk THEN {r['risk']}
            WHEN action_type = '{cat.SET_RISK}' THEN {r['risk_wrong']}
            WHEN {DECIDES} AND risk <=> expected_risk THEN {r['final_risk']}
            WHEN {DECIDES} THEN {r['final_risk_wrong']} ELSE 0D END""",
        "decision": f"""CASE WHEN action_type = '{cat.FINALIZE}' THEN {r['finalize']} WHEN NOT {DECIDES} THEN 0D
            WHEN action_type = expected_decision THEN {r['decide']}
            WHEN action_type = 'approve' AND expected_decision = 'reject' THEN {r['decide_unsafe']}
            ELSE {r['decide_wrong']} END""",
        "missed": f"CASE WHEN {DECIDES} THEN {missed} ELSE 0D END",
        "tax": f"CASE WHEN {DECIDES} THEN 0D ELSE {r['tax']} END + CASE WHEN timed_out THEN {r['timeout']} ELSE 0D END",
    }
    return "named_struct(" + ", ".join(f"'{n}', {values[n]}" for n in PARTS) + ")"


def _reason() -> str:
    def say(name: str, *values: str) -> str:
        message = text(STEP_MESSAGES[name])
        return f"format_string({', '.join([message, *values])})" if values else message

    verdict = (f"CASE WHEN action_type = expected_decision THEN {say('decide', 'action_type')} "
               f"WHEN action_type = 'approve' AND expected_decision = 'reject' THEN {say('decide_unsafe')} "
               f"ELSE {say('decide_wrong', 'action_type', 'expected_decision')} END")
    risk_line = (f"CASE WHEN risk <=> expected_risk THEN {say('final_risk', 'risk')} "
                 f"ELSE {say('final_risk_wrong', chr(99) + 'oalesce(risk, ' + text('None') + ')', 'expected_risk')} END")
    penalty = f"CASE WHEN {severity_sql('c')} IN {SEVERE} THEN '1.5' ELSE '0.5' END"
    lines = f"""concat(array({verdict}, {risk_line}),
        transform({MISSED}, c -> {say('missed', 'c', severity_sql('c'), penalty)}),
        transform(false_codes, c -> {say('final_fp', 'c')}),
        transform(filter(flagged, f -> array_contains(mitigated, f)), c -> {say('final_mitigated', 'c')}))"""
    return f"""CASE
        WHEN timed_out THEN {say('timeout')}
        WHEN {DECIDES} THEN {say('decided', f"array_join({lines}, chr(10))", 'total_so_far')}
        WHEN action_type = '{cat.INSPECT}' THEN CASE
            WHEN NOT _inspect THEN {say('inspect_unknown', 'key', "array_join(artifact_names, ', ')")}
            WHEN NOT new_inspect THEN {say('inspect_again', 'key')}
            ELSE {say('inspect', 'key', 'size(inspected)', 'size(artifact_names)')} END
        WHEN action_type = '{cat.FLAG}' THEN CASE
            WHEN key = '' THEN {say('flag_empty')} WHEN wrong_flag THEN {say('flag_wrong', 'key')}
            WHEN NOT new_flag THEN {say('flag_again', 'key')} WHEN right_severity THEN {say('flag_severity', 'key')}
            ELSE {say('flag', 'key')} END
        WHEN action_type = '{cat.MITIGATE}' THEN CASE
            WHEN NOT _flagged THEN {say('mitigate_early', 'key')} WHEN NOT new_mitigation THEN {say('mitigate_again', 'key')}
            ELSE {say('mitigate', 'key')} END
        WHEN action_type = '{cat.SET_RISK}' THEN CASE
            WHEN severity IS NULL THEN {say('risk_missing')} WHEN severity = expected_risk THEN {say('risk', 'severity')}
            ELSE {say('risk_wrong', 'severity', 'expected_risk')} END
        ELSE {say('finalize')} END"""


def reward_log(steps: DataFrame) -> DataFrame:
    """The explainable log: step, action type, detail, reward, reason."""
    detail = F.coalesce(F.nullif(F.col("target"), F.lit("")), F.nullif(F.col("issue_code"), F.lit("")), F.lit(""))
    return steps.select("episode_id", "seq", "step", "action_type", detail.alias("detail"),
                        F.round("reward", 3).alias("reward"), "reason")


def episode_ends(steps: DataFrame) -> DataFrame:
    """episode_id, end_seq for reviews that ended."""
    return steps.filter("terminal").select("episode_id", F.col("seq").alias("end_seq"))


def episode_lengths(actions: DataFrame, steps: DataFrame) -> DataFrame:
    """Exact counts over the whole log: steps, malformed and post-terminal rows."""
    over = F.coalesce(F.col("seq") > F.col("end_seq"), F.lit(False))
    return (actions.select("episode_id", "seq", "valid").join(episode_ends(steps), "episode_id", "left")
            .groupBy("episode_id")
            .agg(F.sum(F.when(over, 0).otherwise(1)).alias("step_count"),
                 F.sum(F.when(~over & ~F.col("valid"), 1).otherwise(0)).alias("n_invalid"),
                 F.sum(F.when(over, 1).otherwise(0)).alias("n_post_terminal")))


def with_exact_steps(steps: DataFrame, lengths: DataFrame) -> DataFrame:
    """``step`` of the last row replaced by the exact count of its episode."""
    exact = lengths.select("episode_id", "step_count")
    return (steps.join(exact, "episode_id")
            .withColumn("step", F.when(F.col("terminal"), F.col("step_count")).otherwise(F.col("step")))
            .drop("step_count"))


def every_action(actions: DataFrame, steps: DataFrame) -> DataFrame:
    """The fate of every logged row: scored, invalid or post_terminal_action."""
    scored = steps.select("episode_id", "seq", F.lit("scored").alias("status"), "reward")
    over = F.coalesce(F.col("seq") > F.col("end_seq"), F.lit(False))
    rest = (actions.select("episode_id", "seq", "valid").join(episode_ends(steps), "episode_id", "left")
            .filter(over | ~F.col("valid"))
            .select("episode_id", "seq",
                    F.when(over, "post_terminal_action").otherwise("invalid").alias("status"),
                    F.when(over, 0.0).otherwise(REWARD["invalid"]).alias("reward")))
    return scored.unionByName(rest)


def stage(n_inspected: Column, n_artifacts: Column, n_flagged: Column, risk: Column) -> Column:
    return (F.when((n_flagged > 0) & risk.isNotNull(), "decision")
            .when(n_inspected >= n_artifacts * 0.5, "evaluation").otherwise("inspection"))


def review_state(steps: DataFrame, assigned: DataFrame) -> DataFrame:
    """Where each review stands after its last counted action.

    Every assigned episode appears, also those without a well-formed action.
    """
    last = F.max_by(
        F.struct("inspected", "flagged", "false_codes", "mitigated", "risk", "terminal", "timed_out", "action_type"),
        "seq").alias("last")
    seen = steps.groupBy("episode_id").agg(
        last, F.sum("reward").alias("total_reward"), F.count(F.lit(1)).alias("n_valid"))
    none = F.expr("CAST(array() AS ARRAY<STRING>)")
    arrays = [F.coalesce(F.col(f"last.{n}"), none).alias(n)
              for n in ("inspected", "flagged", "false_codes", "mitigated")]
    decided = F.col("last.action_type").isin(cat.DECISIONS)
    state = assigned.join(seen, "episode_id", "left").select(
        *assigned.columns, *arrays, F.col("last.risk").alias("risk"),
        F.when(decided, F.col("last.action_type")).alias("decision"),
        F.coalesce(F.col("last.terminal"), F.lit(False)).alias("done"),
        F.coalesce(F.col("last.timed_out"), F.lit(False)).alias("timed_out"),
        F.coalesce(F.col("total_reward"), F.lit(0.0)).alias("total_reward"),
        F.coalesce(F.col("n_valid"), F.lit(0)).alias("n_valid"))
    return state.withColumn("review_stage", stage(
        F.size("inspected"), F.size("artifact_names"), F.size("flagged"), F.col("risk")))


def open_questions(state: DataFrame) -> DataFrame:
    """Adds ``open_questions``: what a reviewer has still to do."""
    said = cat.OPEN_QUESTIONS
    left_over = "filter(artifact_names, a -> NOT array_contains(inspected, a))"
    listed = f"concat('[', array_join(transform({left_over}, a -> concat({text(chr(39))}, a, {text(chr(39))})), ', '), ']')"
    return state.selectExpr("*", f"""array_compact(array(
        CASE WHEN size({left_over}) > 0 THEN format_string({text(said['uninspected'])}, {listed}) END,
        CASE WHEN risk IS NULL THEN {text(said['risk'])} END,
        CASE WHEN size(flagged) = 0 THEN {text(said['flags'] % ', '.join(cat.CODES))} END,
        CASE WHEN size(flagged) > 0 AND size(mitigated) = 0 THEN {text(said['mitigations'])} END)) AS open_questions""")


def causal_hints(flagged: str = "flagged") -> Column:
    """One hint per flagged code whose likely effects are not all flagged yet."""
    effects = "map(" + ", ".join(f"{text(c)}, {texts(ds)}" for c, ds in cat.CAUSES.items()) + ")"
    names = mapping({c: f"{c} ({n})" for c, n in cat.RULE_NAME.items()})
    still_open = f"filter(coalesce(try_element_at({effects}, c), array()), e -> NOT array_contains({flagged}, e))"
    hint = (f"CASE WHEN size({still_open}) > 0 THEN format_string({text(STEP_MESSAGES['hint'])}, c, "
            f"array_join(transform({still_open}, e -> element_at({names}, e)), ', ')) END")
    return F.expr(f"array_compact(transform({flagged}, c -> {hint}))")


def reward_breakdown(steps: DataFrame) -> DataFrame:
    """Total reward per episode split by category."""
    names = {"inspection": "inspection_reward", "flagging": "flagging_reward",
             "false_positive": "false_positive_penalty", "mitigation": "mitigation_reward",
             "risk": "risk_assessment_reward", "decision": "decision_reward",
             "missed": "missed_issue_penalty", "tax": "time_tax"}
    return steps.groupBy("episode_id").agg(
        F.sum("reward").alias("total_reward"),
        *[F.sum(F.col("parts").getField(p)).alias(names[p]) for p in PARTS])


def transcripts(steps: DataFrame, state: DataFrame, packets: DataFrame, lengths: DataFrame) -> DataFrame:
    """Nested record per episode.  A review has at most ``max_steps`` counted
    actions, so the collected arrays are bounded."""
    action = F.struct("action_type", "target", "severity", "issue_code", "note")
    flag = F.when(F.col("new_flag"), F.struct(
        F.col("seq"), F.col("key").alias("code"), F.coalesce("severity", F.lit("unknown")).alias("severity"),
        F.coalesce("note", F.lit("")).alias("note"), F.lit(True).alias("correct"),
        F.col("right_severity").alias("severity_correct")))
    mitigation = F.when(F.col("new_mitigation"), F.struct(
        F.col("seq"), F.col("key").alias("issue_code"), F.coalesce("note", F.lit("")).alias("note")))
    lists = steps.groupBy("episode_id").agg(
        F.array_sort(F.collect_list(F.struct(
            "seq", "step", action.alias("action"), "reward",
            F.left("reason", F.lit(200)).alias("message")))).alias("steps"),
        F.array_sort(F.collect_list(flag)).alias("final_flagged_issues"),
        F.array_sort(F.collect_list(mitigation)).alias("final_mitigations"))
    text = packets.select("packet_id", "feature_name", "feature_summary", "artifacts")
    return (state.join(lists, "episode_id", "left").join(lengths.select("episode_id", "step_count"), "episode_id", "left")
            .join(text, "packet_id")
            .select("episode_id", "packet_id", "feature_name", "feature_summary", "artifacts", "truth",
                    "expected_risk", "expected_decision", "steps", "final_flagged_issues", "final_mitigations",
                    F.col("risk").alias("final_risk"), F.col("decision").alias("final_decision"),
                    "total_reward", F.coalesce("step_count", F.lit(0)).alias("total_steps"),
                    F.col("agent").alias("reviewer_model")))
