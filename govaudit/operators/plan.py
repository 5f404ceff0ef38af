"""Deterministic review plans: from scan results to an action log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govaudit import catalog as cat

ACTION = ("struct<action_type:string, target:string, severity:string, "
          "issue_code:string, note:string>")


def _action(kind: str, target: Column | None = None, severity: Column | None = None,
            code: Column | None = None, note: Column | None = None) -> Column:
    null = F.lit(None).cast("string")
    fields = [(F.lit(kind), "action_type"), (target, "target"), (severity, "severity"),
              (code, "issue_code"), (note, "note")]
    return F.struct(*[(null if value is None else value).cast("string").alias(name) for value, name in fields])


def _inspections(names: Column) -> Column:
    return F.transform(names, lambda a: _action(cat.INSPECT, target=a))


def rule_based_plan(decide: str = "by_risk") -> Column:
    """Actions of the rule-following reviewer for a scanned packet.

    Inspect everything, flag each failed rule once, mitigate what the truth
    confirms, set the risk to the worst severity among those, decide.  A wrong
    flag earns no further step: the log has it once.  ``decide``: ``by_risk``
    rejects high and critical risks and escalates others; ``reject`` always
    rejects; both approve when nothing was confirmed.
    """
    failed = F.filter("results", lambda r: ~r.passed)
    flags = F.transform(failed, lambda r: _action(
        cat.FLAG, target=F.try_element_at(cat.literal_map(cat.ARTIFACT_OF), r.code),
        severity=cat.severity_of(r.code, "high"), code=r.code, note=F.left(r.message, F.lit(120))))
    confirmed = F.filter("detected", lambda c: F.array_contains("truth", c))
    fixes = F.transform(confirmed, lambda c: _action(
        cat.MITIGATE, code=c, note=F.concat(F.lit("Remediate "), c, F.lit(" before launch"))))
    worst = (F.when(F.exists(confirmed, lambda c: cat.severity_of(c) == "critical"), "critical")
             .when(F.exists(confirmed, lambda c: cat.severity_of(c) == "high"), "high").otherwise("medium"))
    risk = F.when(F.size(confirmed) > 0, F.array(_action(cat.SET_RISK, severity=worst))).otherwise(
        F.array().cast(f"array<{ACTION}>"))
    firm = F.lit(True) if decide == "reject" else worst.isin("critical", "high")
    decision = (F.when(F.size(confirmed) == 0, _action("approve", note=F.lit("No policy violations found")))
                .when(firm, _action("reject", note=F.lit("Violations found")))
                .otherwise(_action("escalate", note=F.lit("Violations found"))))
    return F.concat(_inspections(F.col("artifact_names")), flags, fixes, risk, F.array(decision))


def approve_all_plan() -> Column:
    """Weak baseline: look at everything, approve."""
    return F.concat(_inspections(F.col("artifact_names")), F.array(_action("approve", note=F.lit("All clear."))))


def reject_all_plan() -> Column:
    """Weak baseline: look at everything, call it high risk, reject."""
    return F.concat(_inspections(F.col("artifact_names")),
                    F.array(_action(cat.SET_RISK, severity=F.lit("high")), _action("reject")))


def planned_actions(scanned: DataFrame, plan: Column) -> DataFrame:
    """Action log (episode_id, seq, five fields, valid), one episode per packet.

    ``scanned`` needs packet_id, truth, results, detected and artifact_names.
    """
    return (scanned.select(F.col("packet_id").cast("string").alias("episode_id"), F.posexplode(plan).alias("pos", "action"))
            .select("episode_id", F.col("pos").cast("bigint").alias("seq"), "action.*", F.lit(True).alias("valid")))


def as_json(actions: DataFrame) -> DataFrame:
    """The log as raw JSON texts, as a reviewer would send them."""
    fields = ["action_type", "target", "severity", "issue_code", "note"]
    return actions.select("episode_id", "seq", F.to_json(F.struct(*fields)).alias("raw"))
