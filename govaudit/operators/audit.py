"""Declared against detected violations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govaudit import catalog as cat


def label_audit(scanned: DataFrame, *keep: str) -> DataFrame:
    """One row per packet and code that is declared, detected or both.

    The two lists lie in the same row, so the full outer join on (packet, code)
    is a projection followed by an explode: no exchange.
    """
    every = F.array_union("truth", "detected")
    return (scanned.select(*(keep or ("packet_id",)), "truth", "detected", F.explode(every).alias("code"))
            .withColumn("declared", F.array_contains("truth", F.col("code")))
            .withColumn("found", F.array_contains("detected", F.col("code")))
            .withColumn("verdict", F.when(F.col("declared") & F.col("found"), "confirmed")
                        .when(F.col("declared"), "undetectable").otherwise("undeclared"))
            .drop("truth", "detected"))


def set_comparison(scanned: DataFrame) -> DataFrame:
    """Truth and detection as sets: both, only declared, only detected, codes
    still free to plant, everything named."""
    return scanned.select(
        "*",
        F.array_intersect("truth", "detected").alias("both"),
        F.array_except("truth", "detected").alias("only_declared"),
        F.array_except("detected", "truth").alias("only_detected"),
        F.array_except(cat.codes_array(), "truth").alias("available"),
        F.array_union("truth", "detected").alias("named"))


def sector_worklist(violations: DataFrame, sectors: DataFrame) -> DataFrame:
    """Violations with the severity the packet's sector gives them, most urgent
    first in ``urgency`` (1 = critical for the sector)."""
    code = F.col("code")
    urgency = (F.when(F.array_contains("critical_codes", code), 1)
               .when(F.array_contains("high_codes", code), 2).otherwise(3))
    own = cat.severity_of(code)
    return (violations.join(sectors, "sector")
            .withColumn("urgency", urgency)
            .withColumn("sector_severity", F.when(F.col("urgency") == 1, "critical")
                        .when(F.col("urgency") == 2, "high").otherwise(own)))


def open_for_code(violations: DataFrame, rules: DataFrame, guide: DataFrame) -> DataFrame:
    """Which artifact to open for a violation, and what to look for there."""
    return (violations.join(rules.select("code", "name", "severity", "artifact", "look_for"), "code", "left")
            .join(guide.select("artifact", "holds"), "artifact", "left"))
