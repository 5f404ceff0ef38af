"""Policy rules as Spark SQL expressions.

A rule is ``fn(artifact) -> SQL text`` where ``artifact(name)`` is the name of
the column with the raw text of an artifact ('' when missing) and
``artifact(name, lower=True)`` that of its lower-cased text.  The expression
yields the violation message, or NULL for a pass.  New rules are added by
passing a larger registry to the scan.
"""

from __future__ import annotations

from collections.abc import Callable

from govaudit import catalog as cat
from govaudit.functions.sqltext import text
from govaudit.functions.text import asserts, contains_any

Artifact = Callable[..., str]
Rule = Callable[[Artifact], str]


def raw_pii_logged(artifact: Artifact) -> str:
    raw, low = artifact("logging_policy.yaml"), artifact("logging_policy.yaml", lower=True)
    captured = contains_any(low, ["raw_prompt_capture: enabled", "capture: full"])
    unfiltered = f"({low} RLIKE {text(cat.PII_FILTER_OFF)} OR NOT contains({low}, 'pii_filter'))"
    evidence = f"left(regexp_extract({raw}, {text(cat.PII_SNIPPET)}, 0), 80)"
    return f"CASE WHEN {captured} AND {unfiltered} THEN format_string({text(cat.RULE_MESSAGES['PII-001'])}, {evidence}) END"


def unjustified_access(artifact: Artifact) -> str:
    low = artifact("data_sources.json", lower=True)
    sensitive = contains_any(low, ['"sensitive": true', '"sensitive":true'])
    return (f"CASE WHEN {sensitive} AND NOT contains({low}, 'least_privilege') "
            f"THEN {text(cat.RULE_MESSAGES['ACCESS-002'])} END")


def missing_escalation(artifact: Artifact) -> str:
    risky = contains_any(artifact("model_card.json", lower=True), ["high", "critical"])
    oversight = artifact("human_oversight.md", lower=True)
    section = f"substring({oversight}, locate('escalation', {oversight}), 300)"
    message = cat.RULE_MESSAGES["ESCALATION-003"]
    signs = " ".join(f"WHEN {section} RLIKE {text(p)} THEN {text(message.replace('%s', p))}" for p in cat.INCOMPLETE_PLAN)
    return (f"CASE WHEN NOT {risky} THEN NULL WHEN NOT contains({oversight}, 'escalation') "
            f"THEN {text(cat.RULE_MESSAGES['ESCALATION-003/absent'])} {signs} END")


def prohibited_domain(artifact: Artifact) -> str:
    spec = artifact("product_spec.md", lower=True)
    message = cat.RULE_MESSAGES["DOMAIN-004"]
    return "CASE " + " ".join(
        f"WHEN {asserts(spec, phrase)} THEN {text(message.replace('%s', shown))}" for phrase, shown in cat.PROHIBITED) + " END"


def retention_too_long(artifact: Artifact) -> str:
    # Compared as digit strings: no cast, so no length of number can overflow.
    digits = f"regexp_extract({artifact('retention_policy.yaml')}, {text(cat.RETENTION_DAYS)}, 1)"
    days = f"regexp_replace({digits}, {text(chr(94) + '0+(?=' + chr(92) + 'd)')}, '')"
    return (f"CASE WHEN length({days}) > 2 OR (length({days}) = 2 AND {days} > '90') "
            f"THEN format_string({text(cat.RULE_MESSAGES['RETENTION-005'])}, {days}) END")


def trains_on_prompts(artifact: Artifact) -> str:
    card = artifact("model_card.json", lower=True)
    external = contains_any(card, ['"provider": "external"', '"provider":"external"'])
    opted_out = contains_any(card, ["disabled", "opted_out"])
    return (f"CASE WHEN {external} AND contains({card}, 'training on prompts') AND NOT {opted_out} "
            f"THEN {text(cat.RULE_MESSAGES['TRAINING-006'])} END")


def no_audit_trail(artifact: Artifact) -> str:
    spec = artifact("product_spec.md", lower=True)
    review = artifact("security_review.md", lower=True)
    acts = (f"({contains_any(spec, ['admin', 'write access'])} OR "
            f"(contains({spec}, 'action') AND NOT contains({spec}, 'read-only')))")
    documented = " AND ".join(f"contains({review}, {text(n)})" for n in ("audit", "trail", "rollback"))
    return f"CASE WHEN {acts} AND NOT ({documented}) THEN {text(cat.RULE_MESSAGES['AUDIT-007'])} END"


def harms_not_evaluated(artifact: Artifact) -> str:
    report = artifact("eval_report.json", lower=True)
    return (f"CASE WHEN {report} = '' THEN {text(cat.RULE_MESSAGES['EVAL-008/absent'])} "
            f"WHEN NOT {contains_any(report, cat.EVAL_TERMS)} THEN {text(cat.RULE_MESSAGES['EVAL-008'])} END")


REGISTRY: dict[str, Rule] = {
    "PII-001": raw_pii_logged,
    "ACCESS-002": unjustified_access,
    "ESCALATION-003": missing_escalation,
    "DOMAIN-004": prohibited_domain,
    "RETENTION-005": retention_too_long,
    "TRAINING-006": trains_on_prompts,
    "AUDIT-007": no_audit_trail,
    "EVAL-008": harms_not_evaluated,
}


def with_rule(code: str, rule: Rule, registry: dict[str, Rule] = REGISTRY) -> dict[str, Rule]:
    """A registry with one more (or one replaced) rule, appended in order."""
    return {**registry, code: rule}


def phrase_rule(name: str, phrase: str, message: str, negators: list[str] = cat.NEGATORS) -> Rule:
    """A rule built from configuration: fails when the phrase is asserted."""
    return lambda artifact: f"CASE WHEN {asserts(artifact(name, lower=True), phrase, negators)} THEN {text(message)} END"
