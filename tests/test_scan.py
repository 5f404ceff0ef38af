"""Rules, negation, planted packets, label audit."""

import random

import pytest
from pyspark.sql import functions as F

from govaudit import catalog as cat
from govaudit.functions import packet_text
from govaudit.functions.text import asserted_occurrences, asserts
from govaudit.operators import audit, grade, scan, synth
from govaudit.operators.rules import phrase_rule, with_rule
from govaudit.sources import bridge
from govaudit.sources.packets import intake, load_by_id, read_packets, write_packets
from tests import model


def packets(spark, rows):
    return spark.createDataFrame(rows, "packet_id INT, artifacts MAP<STRING,STRING>")


def failing(spark, artifacts):
    row = scan.scan(packets(spark, [(1, artifacts)])).select("detected", "results").first()
    return row.detected, {r.code: r.message for r in row.results}


OK = {"eval_report.json": "adversarial"}
CASES = [
    ("PII-001", {"logging_policy.yaml": "capture: full\nraw_prompt_capture: enabled\npii_filter: disabled"}, True),
    ("PII-001", {"logging_policy.yaml": "capture: redacted\npii_filter: enabled"}, False),
    ("PII-001", {"logging_policy.yaml": "raw_prompt_capture: enabled"}, True),
    ("PII-001", {"logging_policy.yaml": "raw_prompt_capture: enabled\npii_filter: normal"}, True),
    ("PII-001", {"logging_policy.yaml": "raw_prompt_capture: enabled\npii_filter: active"}, False),
    ("RETENTION-005", {"retention_policy.yaml": "retention_days: 120"}, True),
    ("RETENTION-005", {"retention_policy.yaml": "retention_days: 90"}, False),
    ("RETENTION-005", {"retention_policy.yaml": "retention_days: 091"}, True),
    ("RETENTION-005", {"retention_policy.yaml": "retention_days: " + "9" * 30}, True),
    ("RETENTION-005", {"retention_policy.yaml": "retention_days: " + "9" * 60}, True),
    ("RETENTION-005", {"retention_policy.yaml": "log_retention_days: 200"}, True),
    ("RETENTION-005", {"retention_policy.yaml": "retention_days: 30\nretention_days: 300"}, False),
    ("DOMAIN-004", {"product_spec.md": "This copilot provides personalized investment advice"}, True),
    ("DOMAIN-004", {"product_spec.md": "- Cannot provide legal advice"}, False),
    ("DOMAIN-004", {"product_spec.md": "Cannot give legal advice. " + "x" * 60 + " Gives legal advice."}, True),
    ("ESCALATION-003", {"model_card.json": '"risk_level": "high"', "human_oversight.md": "no plan"}, True),
    ("ESCALATION-003", {"model_card.json": '"risk_level": "high"',
                        "human_oversight.md": "Escalation: desk lead" + " " * 300 + "pending"}, False),
    ("ESCALATION-003", {"model_card.json": '"risk_level": "high"', "human_oversight.md": "Escalation: n/a"}, True),
    ("ESCALATION-003", {"model_card.json": "medium", "human_oversight.md": "Escalation: pending"}, False),
    ("ACCESS-002", {"data_sources.json": '{"sensitive": true}'}, True),
    ("ACCESS-002", {"data_sources.json": '{"sensitive":true, "note": "no least_privilege yet"}'}, False),
    ("TRAINING-006", {"model_card.json": '"provider": "external", "training on prompts": "enabled"'}, True),
    ("TRAINING-006", {"model_card.json": '"provider": "external", "training on prompts": "disabled"'}, False),
    ("AUDIT-007", {"product_spec.md": "takes action", "security_review.md": "audit trail"}, True),
    ("AUDIT-007", {"product_spec.md": "Drug interaction checking, read-only"}, False),
    ("AUDIT-007", {"product_spec.md": "admin", "security_review.md": "audit trail, rollback"}, False),
    ("EVAL-008", {"eval_report.json": '{"accuracy": 1}'}, True),
]


@pytest.mark.parametrize("code,artifacts,fails", CASES)
def test_rule(spark, code, artifacts, fails):
    detected, messages = failing(spark, {**OK, **artifacts})
    assert (code in detected) is fails
    assert messages[code].startswith(code) is fails


def test_messages_carry_evidence(spark):
    _, messages = failing(spark, {"retention_policy.yaml": "retention_days: 0120",
                                  "logging_policy.yaml": "capture: full\nraw_prompt_capture: enabled"})
    assert "120 days" in messages["RETENTION-005"] and "raw_prompt_capture: enabled" in messages["PII-001"]


def test_empty_packet_fails_only_eval(spark):
    detected, messages = failing(spark, {})
    assert detected == ["EVAL-008"] and len(messages) == 8


def test_map_and_struct_packets_agree(spark, sf_dir):
    structs = bridge.packets(spark, sf_dir).select("packet_id", "artifacts")
    maps = structs.select("packet_id", packet_text.as_map("artifacts").alias("artifacts"))
    a = {r.packet_id: r.detected for r in scan.scan(structs).select("packet_id", "detected").collect()}
    b = {r.packet_id: r.detected for r in scan.scan(maps).select("packet_id", "detected").collect()}
    assert a == b and len(a) == 150
    back = maps.select(packet_text.as_struct("artifacts").alias("artifacts"))
    assert back.schema["artifacts"].dataType.fieldNames() == list(cat.ARTIFACTS)


def test_all_256_planted_sets_are_found(spark):
    masks = spark.range(256).select("id", bridge.codes_of_mask("id").alias("truth"))
    planted = masks.select("id", "truth", packet_text.planted_artifacts(
        "truth", "'Insurance'", "CASE WHEN array_contains(truth, 'RETENTION-005') THEN 91 ELSE 90 END").alias("artifacts"))
    assert scan.scan(planted).filter("truth <> detected").count() == 0


def test_scan_is_narrow_and_jvm_only(spark, sf_dir):
    plan = scan.scan(bridge.packets(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_negation_against_model(spark):
    rng = random.Random(5)
    words = ["not", "no", "never.", "(cannot)", "does", "will", "advice", "legal advice", "legal  advice", "x" * 30,
             "can't", "é", "legal advicelegal advice", "\tlegal advice\n"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING").selectExpr(
        "t", f"{asserted_occurrences('t', 'legal advice')} AS n", f"{asserts('t', 'legal advice')} AS any")
    for row in df.collect():
        want = model.asserted(row.t, "legal advice", cat.NEGATORS)
        assert (row.n, row.any) == (want, want > 0), row.t


def test_overlapping_phrase_is_refused():
    with pytest.raises(ValueError):
        asserts("t", "abab")


def test_registry_takes_more_rules(spark):
    registry = with_rule("X-1", phrase_rule("product_spec.md", "blue", "X-1: blue"))
    rows = packets(spark, [(1, {**OK, "product_spec.md": "It is blue"}), (2, {**OK, "product_spec.md": "not blue"})])
    assert [r.detected for r in scan.scan(rows, registry).orderBy("packet_id").collect()] == [["X-1"], []]


# Four packets of our own with the features of four known cases:
# the last hides three declared codes and shows one that is not declared.
GOLDEN = [
    (["PII-001"], {"logging_policy.yaml": "capture: full\nraw_prompt_capture: enabled\npii_filter: disabled",
                   "eval_report.json": "harmful"}, ["PII-001"]),
    (["RETENTION-005", "ESCALATION-003"],
     {"retention_policy.yaml": "retention_days: 120", "model_card.json": "high", "product_spec.md": "Cannot provide legal advice",
      "human_oversight.md": "escalation under review", "eval_report.json": "red team"}, ["ESCALATION-003", "RETENTION-005"]),
    (["DOMAIN-004", "TRAINING-006", "PII-001"],
     {"product_spec.md": "offers investment allocation", "model_card.json": '"provider": "external", training on prompts',
      "logging_policy.yaml": "capture: full", "eval_report.json": "failure mode",
      "data_sources.json": '"sensitive": true, "note": "least_privilege planned"'}, ["PII-001", "DOMAIN-004", "TRAINING-006"]),
    (["PII-001", "TRAINING-006", "EVAL-008", "DOMAIN-004"],
     {"product_spec.md": "gives a medical diagnosis", "logging_policy.yaml": "capture: comprehensive",
      "model_card.json": '"provider": "internal"', "eval_report.json": "adversarial_testing",
      "data_sources.json": '"sensitive": true'}, ["ACCESS-002", "DOMAIN-004"]),
]


def golden(spark):
    return spark.createDataFrame([(i + 1, t, a) for i, (t, a, _) in enumerate(GOLDEN)],
                                 "packet_id INT, truth ARRAY<STRING>, artifacts MAP<STRING,STRING>")


def test_golden_packets(spark):
    found = scan.scan(golden(spark)).orderBy("packet_id").collect()
    assert [r.detected for r in found] == [want for _, _, want in GOLDEN]


def test_label_audit_and_sets(spark):
    scanned = scan.scan(golden(spark).filter("packet_id = 4"))
    verdicts = {r.code: r.verdict for r in audit.label_audit(scanned).collect()}
    assert verdicts == {"PII-001": "undetectable", "TRAINING-006": "undetectable", "EVAL-008": "undetectable",
                        "DOMAIN-004": "confirmed", "ACCESS-002": "undeclared"}
    sets = audit.set_comparison(scanned).first()
    assert sets.both == ["DOMAIN-004"] and sets.only_detected == ["ACCESS-002"]


def test_baseline_scores(spark):
    rows = grade.rule_scan_baseline(scan.scan(golden(spark))).orderBy("packet_id").collect()
    assert [round(r.overall, 6) for r in rows[:3]] == [0.95, 0.95, 0.95]


def test_template_packets_have_known_faults(spark):
    rows = spark.createDataFrame([(1, ["ESCALATION-003", "AUDIT-007"], "travel desk")],
                                 "packet_id INT, truth ARRAY<STRING>, domain STRING")
    found = scan.scan(synth.template_with_patches(rows)).first()
    assert found.detected == ["ACCESS-002", "EVAL-008"] and found.feature_name == "Travel Desk Copilot"


def test_lookup_falls_back_and_intake_keeps_columns(spark, sf_dir):
    known = spark.createDataFrame([(1, "a"), (2, "b")], "packet_id INT, feature_name STRING")
    asked = spark.createDataFrame([(2,), (9,)], "packet_id INT")
    got = {r.packet_id: (r.loaded_id, r.feature_name) for r in load_by_id(asked, known, 1).collect()}
    assert got == {2: (2, "b"), 9: (1, "a")}
    both = intake(bridge.packets(spark, sf_dir), bridge.template_packets(spark, sf_dir))
    assert both.columns[:7] == ["packet_id", "feature_name", "feature_summary", "truth", "expected_risk",
                                "expected_decision", "artifacts"]


def test_packet_files_prune_to_the_artifacts_in_use(spark, sf_dir, tmp_path):
    path = str(tmp_path / "packets")
    write_packets(bridge.packets(spark, sf_dir), path)
    back = read_packets(spark, path)
    registry = {"RETENTION-005": scan.REGISTRY["RETENTION-005"]}
    found = scan.scan(back, registry).select("packet_id", "detected")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "retention_policy.yaml:string" in plan and "product_spec.md:string" not in plan
    assert found.count() == 150


def test_preview(spark):
    row = spark.createDataFrame([("a.md", "x" * 301)], "n STRING, c STRING").select(
        scan.preview(F.col("n"), F.col("c"), F.lit(True)).alias("seen"),
        scan.preview(F.col("n"), F.col("c"), F.lit(False)).alias("closed")).first()
    assert row.seen == "x" * 300 + "..." and row.closed == "[MD file — 301 chars] Use inspect_artifact to view content."
