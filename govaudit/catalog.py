"""Dimension data and its DataFrames.

FIXED VALUES: the tables below (codes, names, severities, weights, bands,
reward amounts and message formats) define what a correct result is and are
therefore stated literally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from govaudit.functions.sqltext import mapping, texts

# --- FIXED VALUES: rules (code, name, description, severity, artifact) -------
RULES = [
    ("PII-001", "No Raw PII in Logs",
     "Logging configuration must not capture raw PII (SSN, credit card, full name, email)",
     "critical", "logging_policy.yaml"),
    ("ACCESS-002", "Least Privilege Access",
     "Sensitive data access requires documented least privilege justification",
     "high", "data_sources.json"),
    ("ESCALATION-003", "Human Escalation Required",
     "High-risk use cases require documented human escalation plan",
     "high", "human_oversight.md"),
    ("DOMAIN-004", "Unsupported Domain Block",
     "Copilots providing medical diagnosis, legal advice, or financial investment advice are blocked",
     "critical", "product_spec.md"),
    ("RETENTION-005", "Retention Policy Match",
     "Data retention period must not exceed corporate maximum of 90 days",
     "medium", "retention_policy.yaml"),
    ("TRAINING-006", "No Training on Sensitive Prompts",
     "External model providers must be contractually prohibited from training on user prompts",
     "critical", "model_card.json"),
    ("AUDIT-007", "Audit Trail Required",
     "Admin or action-taking copilots require full audit trail and rollback capability",
     "high", "security_review.md"),
    ("EVAL-008", "Eval Coverage Required",
     "Evaluation report must include coverage of harmful failure modes",
     "medium", "eval_report.json"),
]

# --- FIXED VALUES: what to look for, per rule --------------------------------
LOOK_FOR = {
    "PII-001": "raw_prompt_capture: enabled + pii_filter: disabled",
    "ACCESS-002": "sensitive: true without least_privilege: true",
    "ESCALATION-003": "missing escalation path when model_card says high risk",
    "DOMAIN-004": "investment advice, medical diagnosis, legal advice, therapeutic",
    "RETENTION-005": "retention_days > 90",
    "TRAINING-006": "provider: external + training on prompts: enabled",
    "AUDIT-007": "admin/action copilot without audit trail + rollback",
    "EVAL-008": "missing harmful_failure_modes or adversarial testing",
}

# --- FIXED VALUES: artifacts of a launch packet, in catalog order ------------
ARTIFACTS = {
    "product_spec.md": "Product description, capabilities, data access scope, user base",
    "data_sources.json": "Data sources accessed, sensitivity levels, PII types, access controls",
    "model_card.json": "Model provider, risk level, training data, known failure modes",
    "eval_report.json": "Evaluation methodology, scores, harmful failure mode coverage",
    "logging_policy.yaml": "What gets logged, PII filtering, retention for logs",
    "retention_policy.yaml": "How long conversation/data is retained",
    "human_oversight.md": "Escalation paths, monitoring, human override mechanisms",
    "security_review.md": "Auth controls, encryption, audit trail, pen test results",
    "incident_history.json": "Past incidents, severity, and resolutions",
}

# --- FIXED VALUES: sectors (key, name, persona, critical codes, high codes) --
SECTORS = [
    ("finance", "FinTech & Banking", "The High-Stakes Regulator",
     ["PII-001", "DOMAIN-004", "ACCESS-002"], ["AUDIT-007", "ESCALATION-003"]),
    ("healthcare", "Healthcare & Life Sciences", "The Privacy Advocate",
     ["PII-001", "DOMAIN-004", "TRAINING-006"], ["ACCESS-002", "ESCALATION-003"]),
    ("retail", "Retail & E-Commerce", "The Customer Success Guard",
     ["PII-001", "RETENTION-005"], ["ACCESS-002", "AUDIT-007"]),
    ("tech", "Big Tech & R&D", "The Agile Compliance Lead",
     ["TRAINING-006", "AUDIT-007", "PII-001"], ["EVAL-008", "ACCESS-002"]),
]

# --- FIXED VALUES: which violation tends to bring which ----------------------
CAUSES = {
    "PII-001": ["RETENTION-005", "TRAINING-006"],
    "TRAINING-006": ["AUDIT-007"],
    "DOMAIN-004": ["ESCALATION-003"],
    "ACCESS-002": ["AUDIT-007"],
    "RETENTION-005": ["TRAINING-006"],
    "ESCALATION-003": ["DOMAIN-004"],
}

# --- FIXED VALUES: business domains and the codes each may host --------------
DOMAINS = [
    ("fintech", "Financial Services"),
    ("healthcare", "Healthcare & Life Sciences"),
    ("hr", "Human Resources"),
    ("legal", "Legal & Compliance"),
    ("retail", "Retail & E-commerce"),
    ("education", "Education Technology"),
    ("insurance", "Insurance"),
    ("government", "Government & Public Sector"),
    ("telecom", "Telecommunications"),
    ("manufacturing", "Manufacturing & Supply Chain"),
]
AFFINITY = {
    "PII-001": ["healthcare", "fintech", "hr", "retail", "government"],
    "ACCESS-002": ["healthcare", "fintech", "hr", "government"],
    "ESCALATION-003": ["healthcare", "fintech", "legal", "government"],
    "DOMAIN-004": ["fintech", "healthcare", "legal"],
    "RETENTION-005": ["healthcare", "fintech", "hr", "legal"],
    "TRAINING-006": ["fintech", "healthcare", "retail", "telecom"],
    "AUDIT-007": ["fintech", "legal", "government", "hr"],
    "EVAL-008": ["healthcare", "education", "government"],
}

# --- FIXED VALUES: reviewer actions ------------------------------------------
INSPECT, FLAG, MITIGATE, SET_RISK = (
    "inspect_artifact", "flag_issue", "request_mitigation", "set_risk")
DECISIONS = ["approve", "reject", "escalate"]
FINALIZE = "finalize_review"
ACTION_TYPES = [INSPECT, FLAG, MITIGATE, SET_RISK, *DECISIONS, FINALIZE]
SEVERITIES = ["low", "medium", "high", "critical"]
MAX_LENGTH = {"target": 100, "issue_code": 50, "note": 500}
MAX_STEPS = 50

# --- FIXED VALUES: rewards ---------------------------------------------------
REWARD = {
    "invalid": -0.5, "tax": -0.05, "timeout": -3.0, "finalize": -0.2,
    "inspect_unknown": -0.1, "inspect": 0.2, "inspect_first": 0.2, "inspect_last": 0.5,
    "flag_empty": -0.1, "flag_severity": 1.5, "flag": 0.8, "flag_wrong": -0.8,
    "mitigate_early": 0.1, "mitigate": 1.0,
    "risk_missing": -0.1, "risk": 0.5, "risk_wrong": 0.1,
    "decide": 4.0, "decide_unsafe": -6.0, "decide_wrong": -2.0,
    "final_risk": 2.0, "final_risk_wrong": -0.5,
    "missed_severe": -1.5, "missed": -0.5, "final_fp": -0.5, "final_mitigated": 0.5,
}

# --- FIXED VALUES: grading weights and bands (lower bound, label) ------------
SCORE_WEIGHTS = {"safety": 0.35, "compliance": 0.25, "completeness": 0.20,
                 "precision": 0.10, "mitigation_quality": 0.10}
SCORE_MIN, SCORE_MAX = 0.01, 0.99
REVIEW_BANDS = [(0.9, "A (Expert Reviewer)"), (0.75, "B (Competent Reviewer)"),
                (0.6, "C (Developing)"), (0.4, "D (Needs Improvement)")]
REVIEW_FAIL = "F (Unsafe — Missed Critical Issues)"
JUDGE_BANDS = [(0.90, "A"), (0.80, "B"), (0.65, "C"), (0.50, "D")]
JUDGE_FAIL = "F"
PERSONAS = [("Junior Compliance Officer", "detection", 0.20),
            ("Senior GRC Analyst", "reasoning_quality", 0.40),
            ("Principal AI Safety Lead", "decision_appropriateness", 0.40)]

# --- FIXED VALUES: rating ladder ---------------------------------------------
RATING = {"start": 1000.0, "k": 32.0, "floor": 400.0, "win": 0.75,
          "easy_max": 1100.0, "medium_max": 1400.0, "stretch": 100.0,
          "opponents": (950.0, 1250.0, 1550.0)}
RATING_BANDS = [(1600.0, "Expert 🏆"), (1400.0, "Advanced ⭐"),
                (1200.0, "Proficient 📈"), (1000.0, "Developing 📚")]
RATING_LOW = "Beginner 🌱"
HISTORY_KEPT, ROUNDS_KEPT = 50, 20
TREND_UP, TREND_DOWN = "▲ Reviewer improving", "▼ Maker dominating"

# --- FIXED VALUES: miss-rate tracking (rates in ten-thousandths) -------------
MISS_START, MISS_SCALE = 5000, 10000
MISS_NEW, MISS_OLD = 3, 7  # new outcome weighs 3/10, history 7/10
WEIGHT_FLOOR = 0.15
DIFFICULTY_BANDS = [(0.6, "easy"), (0.35, "medium")]
MASTERY = {"window": 5, "threshold": 0.72, "top_task": 3}

# --- FIXED VALUES: prohibited phrases (phrase, display name) and negators ----
PROHIBITED = [
    ("medical diagnosis", "medical diagnosis"),
    ("legal advice", "legal advice"),
    ("financial advice", "financial investment advice"),
    ("investment advice", "investment advice"),
    ("investment allocation", "investment allocation guidance"),
    ("therapeutic", "therapeutic counseling"),
    ("prescrib", "prescription guidance"),
    ("diagnos", "clinical diagnosis"),
]
NEGATORS = ["cannot", "can't", "cant", "not", "won't", "wont",
            "does not", "will not", "no", "never", "exclude", "prohibited"]
INCOMPLETE_PLAN = [
    r"pending", r"ticket\s+\w+-\d+", r"under\s+review", r"tbd",
    r"to\s+be\s+(determined|defined|completed)", r"\bnone\b", r"\bn/a\b",
    r"not\s+yet\s+defined",
]
PII_FILTER_OFF = r"pii_filter\s*:\s*(disabled|planned|planned_for_v\w+|todo|tbd|false|no|none)"
PII_SNIPPET = r"(raw_prompt_capture|pii_filter)[^\n]*"
RETENTION_DAYS = r"retention_days:\s*(\d+)"
EVAL_TERMS = ["harmful", "failure mode", "adversarial", "red team", "red_team"]

# --- FIXED VALUES: result messages of the rules ------------------------------
RULE_MESSAGES = {
    "PII-001": ("PII-001: Raw prompt capture is enabled with no active PII filter — "
                "PII will be logged in plaintext. (%s)"),
    "ACCESS-002": "ACCESS-002: Sensitive data sources accessed without least privilege justification",
    "ESCALATION-003": ("ESCALATION-003: High-risk model has an incomplete escalation plan "
                       "(detected: '%s' in oversight doc)"),
    "ESCALATION-003/absent": ("ESCALATION-003: High-risk model has no escalation "
                              "documentation in human_oversight.md"),
    "DOMAIN-004": "DOMAIN-004: Copilot provides %s — a prohibited domain",
    "RETENTION-005": "RETENTION-005: Retention is %s days — exceeds the 90-day corporate maximum",
    "TRAINING-006": "TRAINING-006: External provider may use sensitive user prompts for model training",
    "AUDIT-007": "AUDIT-007: Admin/action copilot lacks complete audit trail and rollback documentation",
    "EVAL-008": "EVAL-008: Evaluation report does not cover harmful failure modes or adversarial inputs",
    "EVAL-008/absent": "EVAL-008: No evaluation report provided",
}

# --- FIXED VALUES: result messages of a review step --------------------------
STEP_MESSAGES = {
    "inspect_unknown": "❌ Artifact '%s' not found. Available: %s",
    "inspect_again": "ℹ️ Already inspected '%s'. Check observation for full content.",
    "inspect": "✅ Inspected '%s'. (%d/%d artifacts complete)",
    "flag_empty": "⚠️ Must provide issue_code when flagging an issue.",
    "flag_again": "ℹ️ Issue %s already flagged.",
    "flag_severity": "✅ Correctly flagged %s with correct severity!",
    "flag": "✅ Correctly flagged %s (check severity level)",
    "flag_wrong": "❌ %s is not a violation in this scenario. False positive.",
    "mitigate_early": "ℹ️ Requesting mitigation for %s (not yet flagged — consider flagging first).",
    "mitigate_again": "ℹ️ Mitigation for %s already requested.",
    "mitigate": "✅ Mitigation requested for %s.",
    "risk_missing": "⚠️ Must provide severity when setting risk level.",
    "risk": "✅ Risk level set to %s (correct).",
    "risk_wrong": "⚠️ Risk level set to %s (expected: %s).",
    "finalize": "⚠️ Must call approve/reject/escalate before finalizing.",
    "timeout": "⏰ Episode timed out — review incomplete.",
    "decided": "📋 Episode complete.\n%s\nTotal episode reward: %.2f",
    "decide": "✅ Correct decision: %s (+4.0)",
    "decide_unsafe": "🚨 UNSAFE: Approved a packet that should be REJECTED (-6.0)",
    "decide_wrong": "❌ Wrong decision: chose %s, expected %s (-2.0)",
    "final_risk": "✅ Correct risk: %s (+2.0)",
    "final_risk_wrong": "⚠️ Wrong risk tier: %s vs %s (-0.5)",
    "missed": "❌ Missed %s (%s) (-%s)",
    "final_fp": "⚠️ False positive: %s (-0.5)",
    "final_mitigated": "✅ Mitigation for %s (+0.5)",
    "hint": "⚠️ %s often causes: %s — check these too.",
}
OPEN_QUESTIONS = {
    "uninspected": "Uninspected artifacts: %s",
    "risk": "Risk level not yet set. Use set_risk action.",
    "flags": "No issues flagged yet. Check policy codes: %s",
    "mitigations": "Issues flagged but no mitigations requested.",
}

# --- FIXED VALUES: codes a generated packet may violate, and how many --------
DIFFICULTY_POOLS = {
    "easy": (["PII-001", "RETENTION-005", "EVAL-008"], 1),
    "medium": (["ACCESS-002", "ESCALATION-003", "RETENTION-005", "AUDIT-007", "EVAL-008"], 2),
    "hard": ([r[0] for r in RULES], 4),
}

CODES = [r[0] for r in RULES]
RULE_NAME = {r[0]: r[1] for r in RULES}
SEVERITY = {r[0]: r[3] for r in RULES}
ARTIFACT_OF = {r[0]: r[4] for r in RULES}
SEVERE = ("critical", "high")


# --- DataFrames --------------------------------------------------------------
# Each of these has a fixed row count (8 rules, 4 sectors, 7 edges, 10 domains,
# 32 affinities, 9 artifacts), so broadcasting them is bounded by construction.

def rules(spark: SparkSession) -> DataFrame:
    rows = [(i, *r, LOOK_FOR[r[0]]) for i, r in enumerate(RULES)]
    return spark.createDataFrame(
        rows, "ord INT, code STRING, name STRING, description STRING, severity STRING, "
              "artifact STRING, look_for STRING")


def artifact_guide(spark: SparkSession) -> DataFrame:
    rows = [(i, a, d) for i, (a, d) in enumerate(ARTIFACTS.items())]
    return spark.createDataFrame(rows, "ord INT, artifact STRING, holds STRING")


def sectors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        SECTORS, "sector STRING, sector_name STRING, persona STRING, "
                 "critical_codes ARRAY<STRING>, high_codes ARRAY<STRING>")


def causal_edges(spark: SparkSession) -> DataFrame:
    rows = [(src, dst, i) for src, dsts in CAUSES.items() for i, dst in enumerate(dsts)]
    return spark.createDataFrame(rows, "src STRING, dst STRING, dst_ord INT")


def domains(spark: SparkSession) -> DataFrame:
    rows = [(i, *d) for i, d in enumerate(DOMAINS)]
    return spark.createDataFrame(rows, "ord INT, domain STRING, domain_name STRING")


def affinity(spark: SparkSession) -> DataFrame:
    rows = [(c, d) for c, ds in AFFINITY.items() for d in ds]
    return spark.createDataFrame(rows, "code STRING, domain STRING")


# --- Column helpers over the fixed values ------------------------------------

def literal_map(values: dict[str, str]) -> Column:
    return F.expr(mapping(values))


def severity_of(code: Column, default: str = "medium") -> Column:
    """Severity of a code; unknown codes get ``default``."""
    return F.coalesce(F.try_element_at(literal_map(SEVERITY), code), F.lit(default))


def severity_sql(code: str, default: str = "medium") -> str:
    """The same as SQL text."""
    whens = " ".join(f"WHEN '{c}' THEN '{s}'" for c, s in SEVERITY.items())
    return f"(CASE {code} {whens} ELSE '{default}' END)"


def codes_array() -> Column:
    return F.expr(texts(CODES))


def band(value: Column, bands: list[tuple[float, str]], otherwise: str) -> Column:
    """Label of the first band whose lower bound ``value`` reaches."""
    out = F.lit(otherwise)
    for low, label in reversed(bands):
        out = F.when(value >= F.lit(low), label).otherwise(out)
    return out
