"""Artifact texts that violate exactly the chosen rules.

Each artifact is a list of pieces ``(code, planted, otherwise)``: the second
text is used where the code is to be violated, the third where not; pieces
without a code are always there.  ``{domain}`` and ``{days}`` are filled in.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from govaudit.catalog import ARTIFACTS
from govaudit.functions.sqltext import text

Piece = tuple[str | None, str, str]

PIECES: dict[str, list[Piece]] = {
    "product_spec.md": [
        (None, "# {domain} assistant, product brief\n\nAnswers staff questions from approved manuals.\n", ""),
        ("DOMAIN-004", "\n## What it offers\n- Suggests an investment allocation that fits each saver\n",
         "\n## What it offers\n- Finds the right manual page and quotes it\n"),
        ("AUDIT-007", "\n## Rights\n- Admin console with write access to staff files\n", ""),
        (None, "\n## Users\nDesk staff in two regions.\n", ""),
    ],
    "data_sources.json": [
        (None, '{"sources": [{"name": "manuals", "sensitive": false}', ""),
        ("ACCESS-002", ', {"name": "staff_files", "sensitive": true}', ""),
        (None, "]}", ""),
    ],
    "model_card.json": [
        (None, '{"name": "desk-model"', ""),
        ("TRAINING-006", ', "provider": "external", "training on prompts": "enabled"',
         ', "provider": "internal"'),
        ("ESCALATION-003", ', "risk_level": "high"', ', "risk_level": "medium"'),
        (None, ', "reviewed": "2025-03"}', ""),
    ],
    "eval_report.json": [
        ("EVAL-008", '{"tests": 400, "accuracy": 0.9}',
         '{"tests": 400, "accuracy": 0.9, "harmful_output_tests": "passed"}'),
    ],
    "logging_policy.yaml": [
        (None, "sink: syslog\nfields: [time, desk, outcome]\n", ""),
        ("PII-001", "capture: full\n", "pii_filter: strict\n"),
    ],
    "retention_policy.yaml": [
        (None, "archive: cold store, two copies\nretention_days: {days}\n", ""),
    ],
    "human_oversight.md": [
        ("ESCALATION-003", "# Oversight\n\nEscalation: plan is pending, owner not named.\n",
         "# Oversight\n\nEscalation: desk lead, then duty officer within a day.\n"),
        (None, "\nWeekly sample of answers is read by two people.\n", ""),
    ],
    "security_review.md": [
        (None, "# Security notes for {domain}\n\nSign-on is central; traffic is encrypted.\n", ""),
        ("AUDIT-007", "Change records are not kept yet.\n",
         "A full audit trail is kept and every change has a rollback.\n"),
    ],
    "incident_history.json": [
        (None, '{"incidents": []}', ""),
    ],
}

# Texts that overwrite one artifact to violate one rule.  DOMAIN-004 is the
# exception: it is appended to the product brief that is already there.
PATCHES: dict[str, tuple[str, str]] = {
    "EVAL-008": ("eval_report.json", '{"suite": "smoke", "cases": 25, "passed": 24}'),
    "AUDIT-007": ("security_review.md", "Pen test of May: two findings, both closed within a week.\n"),
    "TRAINING-006": ("model_card.json",
                     '{"seats": 40, "risk_level": "high", "terms": "the vendor keeps training on prompts", "provider": "external"}'),
    "RETENTION-005": ("retention_policy.yaml", "tapes: yearly\nretention_days: 400\n"),
    "DOMAIN-004": ("product_spec.md", "\nNew this month: drafts legal advice for every sender.\n"),
    "ESCALATION-003": ("human_oversight.md", "Who picks up the phone: escalation owner pending since the move.\n"),
    "ACCESS-002": ("data_sources.json", '[{"feed": 7, "owner": "payroll", "sensitive": true}]'),
    "PII-001": ("logging_policy.yaml", "sink: object store, six hours a file\ncapture: full\n"),
}
APPENDED = "DOMAIN-004"

# The plain packet patches are applied to.  As in the behaviour to match, it
# fails ACCESS-002 and EVAL-008 by itself, its model card is not high-risk and
# its product brief names no administrative rights.
TEMPLATE: dict[str, str] = {
    "product_spec.md": "{title} mailroom helper\n\nSorts letters about {domain} into trays and prints the tray label.\n",
    "data_sources.json": '[{"feed": 1, "owner": "mailroom", "letters": 51000, "sensitive": true}]',
    "model_card.json": '{"family": "linear classifier", "provider": "in-house", "risk_level": "low"}',
    "eval_report.json": '{"runs": 12, "right_tray": 0.71}',
    "logging_policy.yaml": "sink: local file\nfields: [time, tray]\npii_filter: strict\n",
    "retention_policy.yaml": "scans: until delivery\nretention_days: 14\n",
    "human_oversight.md": "The shift lead opens ten trays a day. Escalation: duty manager, by phone.\n",
    "security_review.md": "An audit trail of tray changes is kept; a rollback was rehearsed in June.\n",
    "incident_history.json": '{"open": 0, "closed": 2}',
}


def _fill(piece: str, values: dict[str, str]) -> str:
    """SQL for the text with its ``{name}`` holes filled by expressions."""
    parts = [piece]
    for name, expression in values.items():
        hole = "{" + name + "}"
        for k in range(len(parts) - 1, -1, -1):
            if isinstance(parts[k], str) and hole in parts[k]:
                cut: list = []
                for bit in parts[k].split(hole):
                    cut += [bit, (expression,)]
                parts[k:k + 1] = cut[:-1]
    done = [f"CAST({p[0]} AS STRING)" if isinstance(p, tuple) else text(p) for p in parts if p]
    return "concat(" + ", ".join(done or ["''"]) + ")"


def _fields(values: dict[str, str]) -> Column:
    return F.expr("named_struct(" + ", ".join(f"{text(n)}, {v}" for n, v in values.items()) + ")")


def planted_artifacts(truth: str, domain: str, days: str) -> Column:
    """STRUCT with one text field per artifact; violates exactly ``truth``.

    The arguments are SQL expressions: an array of codes, a text, a number.
    """
    values = {"domain": domain, "days": days}

    def piece(code: str | None, on: str, off: str) -> str:
        if code is None:
            return _fill(on, values)
        return f"CASE WHEN array_contains({truth}, {text(code)}) THEN {_fill(on, values)} ELSE {_fill(off, values)} END"

    return _fields({n: "concat(" + ", ".join(piece(*p) for p in PIECES[n]) + ")" for n in ARTIFACTS})


def template_artifacts(domain: str) -> Column:
    values = {"domain": domain, "title": f"initcap({domain})"}
    return _fields({n: _fill(TEMPLATE[n], values) for n in ARTIFACTS})


def patched(artifacts: str, planted: str) -> Column:
    """Artifact struct with the patch of every code in ``planted`` applied.

    Patches of different codes touch different artifacts, so their order does
    not matter and one projection applies them all.
    """
    by_artifact = {artifact: (code, patch) for code, (artifact, patch) in PATCHES.items()}

    def field(name: str) -> str:
        old = f"{artifacts}.`{name}`"
        if name not in by_artifact:
            return old
        code, patch = by_artifact[name]
        new = f"concat(coalesce({old}, ''), {text(patch)})" if code == APPENDED else text(patch)
        return f"CASE WHEN array_contains({planted}, {text(code)}) THEN {new} ELSE {old} END"

    return _fields({n: field(n) for n in ARTIFACTS})


def as_map(artifacts: str) -> Column:
    """Artifact struct as MAP<STRING,STRING>, missing artifacts left out."""
    pairs = ", ".join(f"struct({text(n)} AS key, {artifacts}.`{n}` AS value)" for n in ARTIFACTS)
    return F.expr(f"map_from_entries(filter(array({pairs}), p -> p.value IS NOT NULL))")


def as_struct(artifacts: str) -> Column:
    """MAP<STRING,STRING> of artifacts as a struct with the catalog's fields."""
    return _fields({n: f"try_element_at({artifacts}, {text(n)})" for n in ARTIFACTS})
