"""Queries over review logs: validation, replay, grading, verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from govaudit import catalog as cat
from govaudit.functions.actions import parse_actions
from govaudit.operators import grade, judge, plan, replay, scan
from govaudit.plans import sql
from govaudit.plans.registry import query
from govaudit.plans.sql import listed, q
from govaudit.session import cut_lineage
from govaudit.sources import bridge


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    actions = parse_actions(bridge.raw_actions(spark, sf_dir))
    return actions, replay.assignments(bridge.reviews(spark, sf_dir), bridge.packets(spark, sf_dir))


def _steps(spark: SparkSession, sf_dir: str, max_steps: int = cat.MAX_STEPS) -> DataFrame:
    actions, assigned = _inputs(spark, sf_dir)
    return replay.replay(actions, assigned, max_steps)


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    actions, assigned = _inputs(spark, sf_dir)
    return replay.review_state(replay.replay(actions, assigned), assigned)


def graded_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grade.grade(_state(spark, sf_dir))


def rounded(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


def r6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def joined(*names: str):
    return [F.array_join(n, ",").alias(n) for n in names]


def lists(*names: str) -> str:
    return ", ".join(f"{listed(n)} AS {n}" for n in names)


# --- validation --------------------------------------------------------------

@query(sql.query("SELECT episode_id, seq, valid, action_type, target, severity, issue_code, note FROM actions", "actions"))
def validated_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (parse_actions(bridge.raw_actions(spark, sf_dir))
            .select("episode_id", "seq", "valid", "action_type", "target", "severity", "issue_code", "note"))


@query(sql.query("""
  SELECT agent, CAST(count(*) AS BIGINT) AS n_actions, CAST(count(*) FILTER (WHERE NOT valid) AS BIGINT) AS n_dead_letters
  FROM actions GROUP BY 1""", "actions"))
def dead_letters_by_agent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (parse_actions(bridge.raw_actions(spark, sf_dir)).groupBy("agent")
            .agg(F.count(F.lit(1)).alias("n_actions"), F.count(F.when(~F.col("valid"), 1)).alias("n_dead_letters")))


# --- replay ------------------------------------------------------------------

_LOG = ("SELECT episode_id, seq, CAST(step AS BIGINT) AS step, action_type, "
        "coalesce(nullif(target, ''), nullif(issue_code, ''), '') AS detail, round(reward, 3) AS reward, reason FROM {0}")


_LOGGED = ["episode_id", "seq", "step", "action_type", "target", "issue_code", "reward", "reason", "terminal"]


def _log(steps: DataFrame) -> DataFrame:
    return replay.reward_log(steps).withColumn("step", F.col("step").cast("bigint"))


@query(sql.query(_LOG.format("steps"), "steps"))
def reward_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    actions, assigned = _inputs(spark, sf_dir)
    steps = cut_lineage(replay.replay(actions, assigned).select(_LOGGED))  # used twice
    return _log(replay.with_exact_steps(steps, replay.episode_lengths(actions, steps)))


@query(sql.query(_LOG.format("short"), "actions", "assigned", extra={"short": sql.replayed(12)}))
def reward_log_with_short_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    actions, assigned = _inputs(spark, sf_dir)
    steps = cut_lineage(replay.replay(actions, assigned, max_steps=12).select(_LOGGED))
    return _log(replay.with_exact_steps(steps, replay.episode_lengths(actions, steps)))


@query(sql.query("""
  SELECT a.episode_id, a.seq,
    CASE WHEN s.seq IS NOT NULL THEN 'scored' WHEN a.seq > e.end_seq THEN 'post_terminal_action' ELSE 'invalid' END AS status,
    round(CASE WHEN s.seq IS NOT NULL THEN s.reward WHEN a.seq > e.end_seq THEN 0.0 ELSE -0.5 END, 6) AS reward
  FROM actions a LEFT JOIN steps s ON s.episode_id = a.episode_id AND s.seq = a.seq
  LEFT JOIN (SELECT episode_id, seq AS end_seq FROM steps WHERE terminal) e ON e.episode_id = a.episode_id""",
    "actions", "steps"))
def every_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    actions, assigned = _inputs(spark, sf_dir)
    steps = replay.replay(actions, assigned).select("episode_id", "seq", "reward", "terminal")  # the windows carry and the checkpoint keeps no more
    fates = replay.every_action(actions, cut_lineage(steps))
    return fates.select("episode_id", "seq", "status", *rounded("reward"))


@query(sql.query("SELECT episode_id, step_count, n_invalid, n_post_terminal FROM lengths", "lengths"))
def episode_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    actions, assigned = _inputs(spark, sf_dir)
    return replay.episode_lengths(actions, replay.replay(actions, assigned))


@query(sql.query("SELECT episode_id, step_count, n_invalid, n_post_terminal FROM short_lengths", "actions", "assigned",
                 extra={"short": sql.replayed(3), "short_lengths": sql.lengths_of("short")}))
def episode_lengths_with_tiny_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    actions, assigned = _inputs(spark, sf_dir)
    return replay.episode_lengths(actions, replay.replay(actions, assigned, max_steps=3))


_STATE = ("episode_id", "packet_id", "risk", "decision", "done", "timed_out", "review_stage")


@query(sql.query(f"SELECT {', '.join(_STATE)}, {lists('inspected', 'flagged', 'false_codes', 'mitigated')}, "
                 f"CAST(n_valid AS BIGINT) AS n_valid, {r6('total_reward')} FROM state", "state"))
def review_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _state(spark, sf_dir).select(
        *_STATE, *joined("inspected", "flagged", "false_codes", "mitigated"), "n_valid", *rounded("total_reward"))


_SAID = cat.OPEN_QUESTIONS
_OPEN = f"""array_to_string(list_filter([
    CASE WHEN len(todo) > 0 THEN printf({q(_SAID['uninspected'])}, '[' || array_to_string(list_transform(todo, lambda t: '''' || t || ''''), ', ') || ']') END,
    CASE WHEN risk IS NULL THEN {q(_SAID['risk'])} END,
    CASE WHEN len(flagged) = 0 THEN {q(_SAID['flags'] % ', '.join(cat.CODES))} END,
    CASE WHEN len(flagged) > 0 AND len(mitigated) = 0 THEN {q(_SAID['mitigations'])} END], lambda x: x IS NOT NULL), ' | ')"""


@query(sql.query(f"SELECT episode_id, {_OPEN} AS open_questions FROM (SELECT *, list_filter(artifact_names, "
                 "lambda a: NOT list_contains(inspected, a)) AS todo FROM state)", "state"))
def open_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (replay.open_questions(_state(spark, sf_dir))
            .select("episode_id", F.array_join("open_questions", " | ").alias("open_questions")))


_PART_NAMES = {"inspection": "inspection_reward", "flagging": "flagging_reward",
               "false_positive": "false_positive_penalty", "mitigation": "mitigation_reward",
               "risk": "risk_assessment_reward", "decision": "decision_reward",
               "missed": "missed_issue_penalty", "tax": "time_tax"}


@query(sql.query("SELECT episode_id, round(sum(reward), 6) AS total_reward, "
                 + ", ".join(f"round(sum(p_{p}), 6) AS {n}" for p, n in _PART_NAMES.items())
                 + " FROM steps GROUP BY 1", "steps"))
def reward_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = replay.reward_breakdown(_steps(spark, sf_dir))
    return parts.select("episode_id", *rounded("total_reward", *_PART_NAMES.values()))


def _hints(flagged: str) -> str:
    effect_of = "CASE c " + " ".join(f"WHEN {q(s)} THEN {sql.qlist(d)}" for s, d in cat.CAUSES.items()) + f" ELSE {sql.NONE} END"
    named = sql.case_map("e", {c: f"{c} ({n})" for c, n in cat.RULE_NAME.items()}, "e")
    left = f"list_filter({effect_of}, lambda e: NOT list_contains({flagged}, e))"
    return (f"list_transform(list_filter({flagged}, lambda c: len({left}) > 0), lambda c: printf("
            f"{q(cat.STEP_MESSAGES['hint'])}, c, array_to_string(list_transform({left}, lambda e: {named}), ', ')))")


@query(sql.query(f"SELECT episode_id, array_to_string(hints, ' | ') AS hints, array_to_string(hints[:2], ' | ') AS shown "
                 f"FROM (SELECT *, {_hints('flagged')} AS hints FROM state)", "state"))
def causal_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    hinted = _state(spark, sf_dir).withColumn("hints", replay.causal_hints())
    return hinted.select("episode_id", F.array_join("hints", " | ").alias("hints"),
                         F.array_join(F.slice("hints", 1, 2), " | ").alias("shown"))


@query(sql.query("""
  SELECT episode_id, CAST(count(*) AS BIGINT) AS n_early, round(sum(reward), 6) AS farmed FROM steps
  WHERE action_type = 'request_mitigation' AND NOT flagged_before GROUP BY 1""", "steps"))
def mitigations_before_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unflagged mitigations pay every time; this finds who lives on them."""
    early = _steps(spark, sf_dir).filter(
        (F.col("action_type") == cat.MITIGATE) & (F.col("parts.mitigation") == cat.REWARD["mitigate_early"]))
    return early.groupBy("episode_id").agg(
        F.count(F.lit(1)).alias("n_early"), F.round(F.sum("reward"), 6).alias("farmed"))


_STEP_TEXT = "step || ':' || action_type || ':' || coalesce(target, '') || ':' || coalesce(issue_code, '') || ':' || left(reason, 200)"
_TRANSCRIPT = f"""
  SELECT s.episode_id, p.feature_name, {listed('s.truth')} AS truth, s.risk AS final_risk, s.decision AS final_decision,
    round(s.total_reward, 6) AS total_reward, l.step_count AS total_steps, s.agent AS reviewer_model,
    coalesce(t.steps, '') AS steps, coalesce(t.flags, '') AS flags, coalesce(t.fixes, '') AS fixes,
    CAST(length(p.product_spec_md) AS BIGINT) AS spec_chars
  FROM state s JOIN packets p USING (packet_id) JOIN lengths l ON l.episode_id = s.episode_id
  LEFT JOIN (SELECT episode_id, string_agg({_STEP_TEXT}, chr(10) ORDER BY seq) AS steps,
      string_agg(key || '/' || coalesce(severity, 'unknown') || '/' || coalesce(note, '') || '/' || right_severity, chr(10) ORDER BY seq)
        FILTER (WHERE new_flag) AS flags,
      string_agg(key, chr(10) ORDER BY seq) FILTER (WHERE new_mitigation) AS fixes
    FROM steps GROUP BY 1) t ON t.episode_id = s.episode_id"""


@query(sql.query(_TRANSCRIPT, "state", "lengths", "packets", "steps"))
def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    actions, assigned = _inputs(spark, sf_dir)
    steps = cut_lineage(replay.replay(actions, assigned))  # used four times below
    records = replay.transcripts(steps, replay.review_state(steps, assigned), bridge.packets(spark, sf_dir),
                                 replay.episode_lengths(actions, steps))
    line = lambda s: F.concat_ws(
        ":", s.step.cast("string"), s.action.action_type, F.coalesce(s.action.target, F.lit("")),
        F.coalesce(s.action.issue_code, F.lit("")), s.message)
    flag = lambda f: F.concat_ws("/", f.code, f.severity, f.note, f.severity_correct.cast("string"))
    text = lambda array: F.coalesce(F.array_join(array, "\n"), F.lit(""))
    return records.select(
        "episode_id", "feature_name", *joined("truth"), "final_risk", "final_decision", *rounded("total_reward"),
        "total_steps", "reviewer_model", text(F.transform("steps", line)).alias("steps"),
        text(F.transform("final_flagged_issues", flag)).alias("flags"),
        text(F.transform("final_mitigations", lambda m: m.issue_code)).alias("fixes"),
        F.char_length(F.col("artifacts").getField("product_spec.md")).cast("bigint").alias("spec_chars"))


# --- grading -----------------------------------------------------------------

_DIMENSIONS = (*grade.DIMENSIONS, "overall")


@query(sql.query(f"SELECT episode_id, {r6(*_DIMENSIONS)}, is_safe, {sql.band('overall', cat.REVIEW_BANDS, cat.REVIEW_FAIL)} "
                 "AS grade, true AS in_range FROM grades", "grades"))
def review_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = graded_reviews(spark, sf_dir)
    return graded.select("episode_id", *rounded(*_DIMENSIONS), "is_safe",
                         grade.review_grade(F.col("overall")).alias("grade"), grade.in_range().alias("in_range"))


_OPTIMAL = "round(0.2::DOUBLE * na + 0.7::DOUBLE + 2.5::DOUBLE * nt + 6.5::DOUBLE - 0.05::DOUBLE * (na + nt * 2 + 3), 3)"
_REGRET = f"""
  SELECT *, round(greatest(0.0, optimal_reward - total_reward), 3) AS regret FROM (
    SELECT *, {_OPTIMAL} AS optimal_reward FROM (SELECT *, len(artifact_names) AS na, len(truth) AS nt FROM grades))"""
_MISSED_TEXT = "'[' || array_to_string(list_transform(missed, lambda c: '''' || c || ''''), ', ') || ']'"


@query(sql.query(f"""
  SELECT episode_id, {r6('total_reward', 'optimal_reward')}, round(regret, 2) AS regret,
    round(regret / greatest(0.01, optimal_reward) * 100, 1) AS regret_pct, {lists('missed', 'false_codes')},
    array_to_string({_hints('flagged')}, ' | ') AS causal_hints, {r6('overall')},
    CASE WHEN is_safe THEN '✅ SAFE — caught all critical violations' ELSE '🚨 UNSAFE — missed: ' || {_MISSED_TEXT} END AS safety_verdict
  FROM regrets""", "grades", extra={"regrets": _REGRET}))
def review_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = grade.explain(graded_reviews(spark, sf_dir))
    return told.select("episode_id", *rounded("total_reward", "optimal_reward"), F.round("regret", 2).alias("regret"),
                       F.round("regret_pct", 1).alias("regret_pct"), *joined("missed", "false_codes"),
                       F.array_join("causal_hints", " | ").alias("causal_hints"), *rounded("overall"), "safety_verdict")


@query(sql.query("""
  SELECT episode_id, string_agg(step || '|' || action_type || '|' || coalesce(nullif(target, ''), nullif(issue_code, ''), '')
    || '|' || reason, chr(10) ORDER BY seq) AS breakdown FROM steps GROUP BY 1""", "steps"))
def step_breakdowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = grade.step_breakdown(replay.reward_log(_steps(spark, sf_dir)))
    line = lambda s: F.concat_ws("|", s.step.cast("string"), s.action_type, s.detail, s.reason)
    return told.select("episode_id", F.array_join(F.transform("step_breakdown", line), "\n").alias("breakdown"))


# --- verdicts ----------------------------------------------------------------

UNSAFE = "coalesce(expected_decision = 'reject' AND decision = 'approve', false)"
VERDICT = f"""
  SELECT *, {sql.band('round(judge_overall, 4)', cat.JUDGE_BANDS, cat.JUDGE_FAIL)} AS judge_grade FROM (
    SELECT *, least(1.0, det * 0.4::DOUBLE + 0.5::DOUBLE * 0.2::DOUBLE + dec * 0.4::DOUBLE) AS judge_overall FROM (
      SELECT *, len(caught)::DOUBLE / greatest(1, len(truth)) AS det,
        CASE WHEN decision IS NOT DISTINCT FROM expected_decision THEN 1.0 WHEN {UNSAFE} THEN 0.05 ELSE 0.35 END::DOUBLE AS dec
      FROM grades))"""


@query(sql.query("SELECT episode_id, round(det, 6) AS detection_accuracy, round(dec, 6) AS decision_appropriateness, "
                 "round(judge_overall, 6) AS judge_overall, judge_grade FROM verdicts", "grades", extra={"verdicts": VERDICT}))
def rule_based_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge.rule_based_verdict(graded_reviews(spark, sf_dir))
    return judged.select("episode_id", *rounded("detection_accuracy", "decision_appropriateness", "judge_overall"),
                         "judge_grade")


def persona_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel scores from labelled documents: three documents make an episode,
    each scored by one persona from its length and quality."""
    documents = bridge.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    labels = bridge.table(spark, sf_dir, "labels")
    focuses = [f for _, f, _ in cat.PERSONAS]
    score = F.when(F.col("doc_id") % 7 == 0, None).otherwise(
        F.col("quality") * 0.5 + (F.col("n_chars") % 100) / 100.0 - F.col("toxic") * 0.25)
    return documents.join(labels, "doc_id").select(
        F.floor(F.col("doc_id") / 3).alias("episode_id"),
        bridge.pick(focuses, F.col("doc_id") % 3).alias("persona"), score.alias("score"))


_FOCUSES = [f for _, f, _ in cat.PERSONAS]
_POOL = "SELECT episode_id, " + ", ".join(
    f"coalesce(max(CASE WHEN persona = {q(f)} AND score IS NOT NULL THEN greatest(0.0, least(1.0, score)) END), 0.5) AS {f}" for f in _FOCUSES) + f"""
  FROM (SELECT doc_id // 3 AS episode_id, ({sql.qlist(_FOCUSES)})[(doc_id % 3) + 1] AS persona,
      CASE WHEN doc_id % 7 = 0 THEN NULL ELSE quality * 0.5::DOUBLE + (n_chars % 100) / 100.0::DOUBLE - toxic * 0.25::DOUBLE END AS score
    FROM documents JOIN labels USING (doc_id)) GROUP BY 1"""
_TOTAL = " + ".join(f"{f} * {w}::DOUBLE" for _, f, w in cat.PERSONAS)
_PANEL = ("SELECT doc_id // 3 AS episode_id, CASE WHEN min(doc_id) % 2 = 0 THEN 'approve' ELSE 'reject' END AS decision, "
          "'reject' AS expected_decision FROM documents GROUP BY 1")


@query(sql.query(f"""
  SELECT episode_id, decision, {', '.join(f'round({f}, 6) AS {f}' for f in _FOCUSES)}, round(pooled, 6) AS pooled,
    {sql.band('round(pooled, 4)', cat.JUDGE_BANDS, cat.JUDGE_FAIL)} AS judge_grade
  FROM (SELECT *, greatest(0.0, least(1.0, CASE WHEN {UNSAFE} THEN least({_TOTAL}, 0.2) ELSE {_TOTAL} END)) AS pooled
        FROM (SELECT episode_id, decision, expected_decision, {', '.join(f'coalesce(max(s.{f}), 0.5) AS {f}' for f in _FOCUSES)}
              FROM panel LEFT JOIN pool s USING (episode_id) GROUP BY 1, 2, 3))""", extra={"pool": _POOL, "panel": _PANEL}))
def persona_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = bridge.table(spark, sf_dir, "documents")
    reviews = (documents.groupBy(F.floor(F.col("doc_id") / 3).alias("episode_id")).agg(F.min("doc_id").alias("first"))
               .select("episode_id", F.when(F.col("first") % 2 == 0, "approve").otherwise("reject").alias("decision"),
                       F.lit("reject").alias("expected_decision")))
    pooled = judge.persona_pool(persona_scores(spark, sf_dir), reviews)
    return pooled.select("episode_id", "decision", *rounded(*_FOCUSES, "pooled"), "judge_grade")


# --- planned reviews ---------------------------------------------------------

_PLAN_RULES = " UNION ALL ".join(
    f"SELECT packet_id, {100 + i} AS pos, 'flag_issue' AS action_type, {q(cat.ARTIFACT_OF[c])} AS target, "
    f"{q(cat.SEVERITY[c])} AS severity, {q(c)} AS issue_code, left(m{i}, 120) AS note FROM {{0}} WHERE m{i} IS NOT NULL "
    f"UNION ALL SELECT packet_id, {200 + i}, 'request_mitigation', NULL, NULL, {q(c)}, 'Remediate {c} before launch' "
    f"FROM {{0}} WHERE m{i} IS NOT NULL AND list_contains(truth, {q(c)})" for i, c in enumerate(cat.CODES))
_PLAN_LOOKS = " UNION ALL ".join(
    f"SELECT packet_id, {i} AS pos, 'inspect_artifact' AS action_type, {q(a)} AS target, NULL::VARCHAR AS severity, "
    f"NULL::VARCHAR AS issue_code, NULL::VARCHAR AS note FROM {{0}}" for i, a in enumerate(cat.ARTIFACTS))
_CONFIRMED = "list_filter(detected, lambda c: list_contains(truth, c))"
_WORST = (f"CASE WHEN {sql.has_severity(_CONFIRMED, 'critical')} THEN 'critical' "
          f"WHEN {sql.has_severity(_CONFIRMED, 'high')} THEN 'high' ELSE 'medium' END")


def _plan_sql(source: str, decision: str) -> dict[str, str]:
    """Blocks for the action log, replay, state and grades of planned reviews."""
    rows = " UNION ALL ".join([_PLAN_LOOKS.format(source), _PLAN_RULES.format(source), f"""
      SELECT packet_id, 300, 'set_risk', NULL, {_WORST}, NULL, NULL FROM {source} WHERE len({_CONFIRMED}) > 0
      UNION ALL SELECT packet_id, 400, {decision}, NULL, NULL, NULL, NULL FROM {source}"""])
    return _plan_blocks(rows, source)


def _plan_blocks(rows: str, source: str) -> dict[str, str]:
    return {
        "plan": f"SELECT packet_id::VARCHAR AS episode_id, pos AS seq, 0 AS agent, true AS valid, action_type, target, "
                f"severity, issue_code, note FROM ({rows})",
        "passigned": f"SELECT packet_id::VARCHAR AS episode_id, packet_id, truth, expected_risk, expected_decision, "
                     f"{sql.qlist(list(cat.ARTIFACTS))} AS artifact_names FROM {source}",
        "psteps": sql.replayed(actions="plan", assigned="passigned"),
        "pstate": sql.state_of("psteps", "passigned"),
        "grades": sql.graded("pstate"),
        "regrets": _REGRET}


_BY_RISK = (f"CASE WHEN len({_CONFIRMED}) = 0 THEN 'approve' WHEN ({_WORST}) IN ('critical', 'high') THEN 'reject' "
            "ELSE 'escalate' END")
_ALWAYS = f"CASE WHEN len({_CONFIRMED}) = 0 THEN 'approve' ELSE 'reject' END"
_OUTCOME = (f"SELECT packet_id, decision, CAST(n_valid AS BIGINT) AS n_steps, {r6('total_reward', 'optimal_reward')}, "
            "round(regret, 2) AS regret, round(overall, 6) AS overall FROM regrets")


def _planned(scanned: DataFrame, review_plan, source_columns: list[str]) -> DataFrame:
    with_names = scanned.withColumn("artifact_names", F.array(*[F.lit(a) for a in cat.ARTIFACTS]))
    # Logs are short and as many as packets: dealt by their number, a task replays the same share of them however many there are.
    log = plan.planned_actions(with_names, review_plan).repartition(bridge.tasks_for(scanned), "episode_id")
    assigned = with_names.select(F.col("packet_id").cast("string").alias("episode_id"), "packet_id", *source_columns,
                                 "artifact_names")
    state = replay.review_state(replay.replay(log, assigned), assigned)
    return grade.with_regret(grade.grade(state)).select(
        "packet_id", "decision", F.col("n_valid").alias("n_steps"), *rounded("total_reward", "optimal_reward"),
        F.round("regret", 2).alias("regret"), *rounded("overall"))


_FACTS = ["truth", "expected_risk", "expected_decision"]


@query(sql.query(_OUTCOME, "scan", extra=_plan_sql("scan", _BY_RISK)))
def planned_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = scan.scan(bridge.packets(spark, sf_dir))
    return _planned(scanned, plan.rule_based_plan("by_risk"), _FACTS)




def _template_blocks() -> dict[str, str]:
    from govaudit.plans.packets import TEMPLATE_BLOCKS
    expected = (f"SELECT *, {sql.risk_of('truth', 2)} AS expected_risk, {sql.decision_of('truth')} AS expected_decision "
                "FROM tscan")
    return {**TEMPLATE_BLOCKS, "texpected": expected}


@query(sql.query(_OUTCOME, extra={**_template_blocks(), **_plan_sql("texpected", _ALWAYS)}))
def planned_reviews_of_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Template packets hide some codes and show undeclared ones."""
    scanned = scan.scan(bridge.template_packets(spark, sf_dir))
    return _planned(scanned, plan.rule_based_plan("reject"), _FACTS)


@query(sql.query(_OUTCOME, "scan", extra=_plan_blocks(
    _PLAN_LOOKS.format("scan") + " UNION ALL SELECT packet_id, 400, 'approve', NULL, NULL, NULL, NULL FROM scan", "scan")))
def approving_reviewer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _planned(scan.scan(bridge.packets(spark, sf_dir)), plan.approve_all_plan(), _FACTS)


@query(sql.query(_OUTCOME, "scan", extra=_plan_blocks(
    _PLAN_LOOKS.format("scan") + " UNION ALL SELECT packet_id, 399, 'set_risk', NULL, 'high', NULL, NULL FROM scan "
    "UNION ALL SELECT packet_id, 400, 'reject', NULL, NULL, NULL, NULL FROM scan", "scan")))
def rejecting_reviewer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _planned(scan.scan(bridge.packets(spark, sf_dir)), plan.reject_all_plan(), _FACTS)
