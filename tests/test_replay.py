"""Validation, replay, grading and plans against a sequential model."""

import json
import random

import pytest
from pyspark.sql import functions as F

from govaudit import catalog as cat
from govaudit.functions.actions import parse_actions, recovered_json, split_valid
from govaudit.operators import grade, judge, plan, replay, scan
from tests import model
from tests.test_scan import GOLDEN

VALID = ['{"action_type":"approve"}', ' {"action_type":"approve"}\n', '{"action_type":"approve","target":null}',
         '{"action_type":"approve","extra":{"target":5}}', '{"action_type":"approve","x":[1,{"note":2}],"note":"a]}"}',
         '{"action_type":"approve","my target":5}', '{"action_type":"inspect_artifact","target":"' + "x" * 100 + '"}']
MALFORMED = ['not valid json', '{"action_type":"approve"} x', '{"action_type":"approve"}] x', '{"action_type":"approve"}, null',
             '{"action_type":"approve"}} x', "", "null", "5", '"approve"', '["approve"]', "{}", '{"action_type":5}',
             '{"action_type":null}', '{"action_type":"approve","target":{"a":1}}', '{"action_type":"approve","note":true}',
             '{"action_type":"set_risk","severity":"HIGH"}', "{'action_type':'approve'}", '{"action_type":"approve","target":1.5}',
             '{"action_type":"inspect_artifact","target":"' + "x" * 101 + '"}',
             '{"action_type":"approve","x":{"y":1},"note":7}', '{"action_type":"flag_issue","issue_code":"' + "x" * 51 + '"}']


def test_validation(spark):
    df = spark.createDataFrame([(r,) for r in VALID + MALFORMED + [None]], "raw STRING")
    good, bad = split_valid(parse_actions(df))
    assert sorted(r.raw for r in good.collect()) == sorted(VALID)
    assert {r.raw for r in bad.collect()} == {*MALFORMED, None}
    assert all(model.parse(r) is not None for r in VALID) and all(model.parse(r) is None for r in MALFORMED)


def test_recovery(spark):
    cases = {"```json\n{\"a\": 1}\n```": '{"a": 1}', "say {\"a\": 1} or {\"b\": 2}": '{"a": 1}', " [1, 2] ": "[1, 2]",
             "nothing": "{}", "``` no ``` {\"a\": 1}": '{"a": 1}', "{\"a\": {\"b\": 2} x": '{"b": 2}'}
    df = spark.createDataFrame([(k,) for k in cases], "t STRING").select("t", recovered_json("t").alias("j"))
    assert {r.t: r.j for r in df.collect()} == cases


def random_episode(rng, n):
    packet = {"truth": [c for c in cat.CODES if rng.random() < 0.4],
              "expected_risk": rng.choice(cat.SEVERITIES), "expected_decision": rng.choice(cat.DECISIONS)}
    raws = []
    for _ in range(n):
        kind = rng.choices([*cat.ACTION_TYPES, "bad"], [6, 6, 5, 3, .3, .3, .3, .5, 3])[0]
        action = {"action_type": kind}
        if kind == cat.INSPECT:
            action["target"] = rng.choice([*cat.ARTIFACTS, "other.txt"])
        elif kind == cat.FLAG:
            action["issue_code"] = rng.choice([*cat.CODES, "", "GHOST"])
            action["severity"] = rng.choice([*cat.SEVERITIES, None])
        elif kind == cat.MITIGATE:
            action[rng.choice(["issue_code", "target"])] = rng.choice(cat.CODES)
        elif kind == cat.SET_RISK:
            action["severity"] = rng.choice([*cat.SEVERITIES, None])
        raws.append("oops" if kind == "bad" else json.dumps(action))
    return packet, raws


@pytest.fixture(scope="module")
def episodes(spark):
    """Random reviews; some start with more malformed actions than steps allowed."""
    rng = random.Random(11)
    data = {f"e{i}": random_episode(rng, rng.randint(0, 30)) for i in range(150)}
    for i in range(5):
        packet, raws = random_episode(rng, 20)
        data[f"late{i}"] = packet, ["oops"] * (15 + i) + raws
    log = [(e, s, r) for e, (_, raws) in data.items() for s, r in enumerate(raws)]
    rng.shuffle(log)
    names = list(cat.ARTIFACTS)
    facts = [(e, "agent", 0, p["truth"], p["expected_risk"], p["expected_decision"], names) for e, (p, _) in data.items()]
    actions = parse_actions(spark.createDataFrame(log, "episode_id STRING, seq BIGINT, raw STRING")).cache()
    assigned = spark.createDataFrame(facts, "episode_id STRING, agent STRING, packet_id INT, truth ARRAY<STRING>, "
                                            "expected_risk STRING, expected_decision STRING, artifact_names ARRAY<STRING>").cache()
    return data, actions, assigned


LIMIT = 12


@pytest.fixture(scope="module")
def played(episodes):
    data, actions, assigned = episodes
    return replay.replay(actions, assigned, LIMIT).cache()


def test_every_action_against_model(episodes, played):
    data, actions, _ = episodes
    got = {(r.episode_id, r.seq): (r.status, round(r.reward, 6)) for r in replay.every_action(actions, played).collect()}
    want = {(e, i): (status, round(reward, 6)) for e, (p, raws) in data.items()
            for i, (status, _, reward) in enumerate(model.play(raws, p, LIMIT)[0])}
    assert got == want


def test_exact_steps_against_model(episodes, played):
    data, actions, _ = episodes
    exact = replay.with_exact_steps(played, replay.episode_lengths(actions, played))
    got = {(r.episode_id, r.seq): r.step for r in exact.select("episode_id", "seq", "step").collect()}
    want = {(e, i): step for e, (p, raws) in data.items()
            for i, (status, step, _) in enumerate(model.play(raws, p, LIMIT)[0]) if status == "scored"}
    assert got == want


def test_state_and_grades_against_model(episodes, played):
    data, _, assigned = episodes
    graded = {r.episode_id: r for r in grade.grade(replay.review_state(played, assigned)).collect()}
    assert len(graded) == len(data)
    for e, (p, raws) in data.items():
        s, r = model.play(raws, p, LIMIT)[1], graded[e]
        assert (r.inspected, r.flagged, r.false_codes, r.mitigated, r.risk, r.decision, r.done) == (
            s["inspected"], s["flagged"], s["false"], s["mitigated"], s["risk"], s["decision"], s["done"])
        assert abs(r.total_reward - s["total"]) < 1e-9
        clamp = lambda x: max(0.01, min(0.99, x))
        safe = all(c in s["flagged"] for c in p["truth"] if cat.SEVERITY[c] in cat.SEVERE)
        n = len(s["flagged"])
        dims = [clamp(1.0 if safe else 0.0), clamp(n / max(1, len(p["truth"]))), clamp(len(s["inspected"]) / 9),
                clamp(n / max(1, n + len(s["false"]))), clamp(len(s["mitigated"]) / max(1, n))]
        overall = clamp(sum(d * w for d, w in zip(dims, cat.SCORE_WEIGHTS.values())))
        assert abs(r.overall - overall) < 1e-9


def test_breakdown_adds_up(played):
    parts = replay.reward_breakdown(played).collect()
    names = [c for c in parts[0].__fields__ if c not in ("episode_id", "total_reward")]
    assert all(abs(sum(r[n] for n in names) - r.total_reward) < 1e-9 for r in parts)


def test_hot_episodes_are_cut_before_the_shuffle(episodes):
    _, actions, assigned = episodes
    plan_text = replay.replay(actions, assigned)._jdf.queryExecution().executedPlan().toString()
    assert "row_number(), 50, Partial" in plan_text and "Python" not in plan_text


def score(spark, review_plan, packets):
    facts = [(i, t, a, risk, decision, list(cat.ARTIFACTS)) for i, (t, a, risk, decision) in enumerate(packets, 1)]
    df = spark.createDataFrame(facts, "packet_id INT, truth ARRAY<STRING>, artifacts MAP<STRING,STRING>, "
                                      "expected_risk STRING, expected_decision STRING, artifact_names ARRAY<STRING>")
    scanned = scan.scan(df)
    assigned = scanned.select(F.col("packet_id").cast("string").alias("episode_id"), "packet_id", "truth", "expected_risk",
                              "expected_decision", "artifact_names")
    log = parse_actions(plan.as_json(plan.planned_actions(scanned, review_plan)))
    return grade.with_regret(grade.grade(replay.review_state(replay.replay(log, assigned), assigned))).orderBy("packet_id").collect()


EXPECTED = [("high", "reject"), ("medium", "escalate"), ("critical", "reject")]


def test_planned_reviews_reproduce_known_totals(spark):
    packets = [(t, a, *EXPECTED[i]) for i, (t, a, _) in enumerate(GOLDEN[:3])]
    rows = score(spark, plan.rule_based_plan("by_risk"), packets)
    assert [r.n_valid for r in rows] == [13, 15, 17]
    assert [round(r.total_reward, 2) for r in rows] == [8.5, 5.4, 17.2]
    assert [round(r.optimal_reward, 2) for r in rows] == [10.8, 13.2, 15.6]
    assert [round(r.regret_pct, 1) for r in rows] == [21.3, 59.1, 0.0]
    assert [round(r.overall, 2) for r in rows] == [0.99] * 3


def test_weak_reviewer_scores_low(spark):
    packets = [(t, a, *EXPECTED[i]) for i, (t, a, _) in enumerate(GOLDEN[:3])]
    rows = score(spark, plan.reject_all_plan(), packets)
    assert all(abs(r.overall - 0.206) < 1e-6 and r.n_valid == 11 for r in rows)


def test_verdict_and_panel(spark):
    reviews = spark.createDataFrame([(1, "approve", "reject"), (2, "reject", "reject")],
                                    "episode_id INT, decision STRING, expected_decision STRING")
    scores = spark.createDataFrame([(1, "detection", 1.0), (1, "reasoning_quality", 1.0), (1, "decision_appropriateness", 2.0),
                                    (2, "detection", None), (2, "reasoning_quality", 0.9), (2, "decision_appropriateness", -1.0)],
                                   "episode_id INT, persona STRING, score DOUBLE")
    got = {r.episode_id: (round(r.pooled, 4), r.judge_grade) for r in judge.persona_pool(scores, reviews).collect()}
    assert got == {1: (0.2, "F"), 2: (0.46, "F")}


def test_causal_hints(spark):
    row = spark.createDataFrame([(["PII-001", "RETENTION-005"],)], "flagged ARRAY<STRING>").select(
        replay.causal_hints().alias("h")).first()
    assert len(row.h) == 2 and "TRAINING-006 (No Training on Sensitive Prompts)" in row.h[0] and "RETENTION" not in row.h[0][12:]
