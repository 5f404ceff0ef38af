"""Scanning packets with a rule registry.  Everything here is a narrow
projection: no exchange, no Python worker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from govaudit import catalog as cat
from govaudit.functions.sqltext import text
from govaudit.operators.rules import REGISTRY, Rule

PREVIEW_CHARS = 300


def artifact_text(packets: DataFrame, name: str) -> Column:
    """Text of one artifact, '' when missing.

    ``artifacts`` may be a MAP<STRING,STRING> or a STRUCT with one field per
    artifact.  The struct form lets Parquet read only the artifacts the rules
    in use need, so large packet tables should be stored that way.
    """
    field = packets.schema["artifacts"].dataType
    if isinstance(field, T.StructType):
        value = F.col("artifacts").getField(name) if name in field.fieldNames() else F.lit(None)
    else:
        value = F.try_element_at(F.col("artifacts"), F.lit(name))
    return F.coalesce(value.cast("string"), F.lit(""))


def rule_results(packets: DataFrame, registry: dict[str, Rule] = REGISTRY) -> DataFrame:
    """Adds ``results``: ARRAY<STRUCT<ord, code, passed, message>> in registry order."""
    used: dict[str, None] = {}

    def artifact(name: str, lower: bool = False) -> str:
        used.setdefault(name)
        return f"_{'low' if lower else 'text'}_{list(used).index(name)}"

    messages = [(code, rule(artifact)) for code, rule in registry.items()]
    # First the texts, once each; then all rules over them in one projection.
    raw = [artifact_text(packets, name).alias(f"_text_{i}") for i, name in enumerate(used)]
    low = [F.lower(artifact_text(packets, name)).alias(f"_low_{i}") for i, name in enumerate(used)]
    results = ", ".join(
        f"named_struct('ord', {i}, 'code', {text(code)}, 'passed', {_message(i)} IS NULL, "
        f"'message', coalesce({_message(i)}, ''))" for i, (code, _) in enumerate(messages))
    return (packets.select("*", *raw, *low)
            .select(*packets.columns, *[F.expr(m).alias(_message(i)) for i, (_, m) in enumerate(messages)])
            .select(*packets.columns, F.expr(f"array({results})").alias("results")))


def _message(index: int) -> str:
    return f"_message_{index}"


def detected_codes(results: Column) -> Column:
    return F.transform(F.filter(results, lambda r: ~r.passed), lambda r: r.code)


def scan(packets: DataFrame, registry: dict[str, Rule] = REGISTRY) -> DataFrame:
    """Packets plus ``results`` and ``detected`` (violated codes in order)."""
    return rule_results(packets, registry).withColumn("detected", detected_codes(F.col("results")))


def violations(packets: DataFrame, registry: dict[str, Rule] = REGISTRY) -> DataFrame:
    """One row per packet and violated code."""
    return (rule_results(packets, registry)
            .withColumn("result", F.explode(F.filter("results", lambda r: ~r.passed)))
            .select(*packets.columns, "result.ord", "result.code", "result.message"))


def all_checks(packets: DataFrame, registry: dict[str, Rule] = REGISTRY) -> DataFrame:
    """One row per packet and rule, passed or not."""
    return (rule_results(packets, registry)
            .select(*packets.columns, F.inline_outer("results")))  # never empty; without "outer" Spark filters on its size first


def first_failure(packets: DataFrame, registry: dict[str, Rule] = REGISTRY) -> DataFrame:
    """Adds the first failing rule in registry order (NULL when none fails)."""
    first = F.try_element_at(F.filter("results", lambda r: ~r.passed), F.lit(1))
    return (rule_results(packets, registry)
            .withColumn("first_code", first.code)
            .withColumn("first_severity", F.when(first.code.isNotNull(), cat.severity_of(first.code, "high")))
            .withColumn("first_artifact", F.try_element_at(cat.literal_map(cat.ARTIFACT_OF), first.code))
            .withColumn("first_note", F.left(first.message, F.lit(120)))
            .drop("results"))


def artifacts_long(packets: DataFrame, *keep: str) -> DataFrame:
    """One row per packet and artifact: ``keep`` columns, artifact, content."""
    columns = [F.col(c) for c in (keep or ("packet_id",))]
    field = packets.schema["artifacts"].dataType
    if isinstance(field, T.StructType):
        pairs = F.array(*[
            F.struct(F.lit(n).alias("key"), F.col("artifacts").getField(n).alias("value"))
            for n in field.fieldNames()])
        return (packets.select(*columns, F.inline(pairs).alias("artifact", "content"))
                .filter(F.col("content").isNotNull()))
    return packets.select(*columns, F.explode("artifacts").alias("artifact", "content"))


def artifact_content(packets: DataFrame, name: str) -> DataFrame:
    """Content of one artifact per packet; ``found`` is false where missing."""
    field = packets.schema["artifacts"].dataType
    if isinstance(field, T.StructType):
        value = F.col("artifacts").getField(name) if name in field.fieldNames() else F.lit(None)
    else:
        value = F.try_element_at(F.col("artifacts"), F.lit(name))
    return packets.select("packet_id", F.lit(name).alias("artifact"),
                          value.isNotNull().alias("found"), value.cast("string").alias("content"))


def preview(name: Column, content: Column, inspected: Column) -> Column:
    """What a reviewer sees of an artifact before and after inspecting it."""
    cut = F.when(F.char_length(content) > PREVIEW_CHARS,
                 F.concat(F.left(content, F.lit(PREVIEW_CHARS)), F.lit("..."))).otherwise(content)
    kind = F.when(name.contains("."), F.upper(F.substring_index(name, ".", -1))).otherwise(F.lit("UNKNOWN"))
    closed = F.format_string("[%s file — %d chars] Use inspect_artifact to view content.",
                             kind, F.char_length(content))
    return F.when(inspected, cut).otherwise(closed)


def violation_rollup(packets: DataFrame, registry: dict[str, Rule] = REGISTRY) -> DataFrame:
    """Violations per sector, severity and code with subtotals (NULL = all)."""
    return (violations(packets, registry)
            .select("sector", cat.severity_of(F.col("code")).alias("severity"), "code")
            .rollup("sector", "severity", "code")
            .agg(F.count(F.lit(1)).alias("n_violations")))
