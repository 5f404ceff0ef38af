"""Packet tables: reading, lookup by id, intake of generated packets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from govaudit.catalog import ARTIFACTS

PACKET_SCHEMA = (
    "packet_id BIGINT, feature_name STRING, feature_summary STRING, truth ARRAY<STRING>, "
    "expected_risk STRING, expected_decision STRING, artifacts STRUCT<"
    + ", ".join(f"`{a}`: STRING" for a in ARTIFACTS) + ">")

INTAKE_COLUMNS = ["packet_id", "feature_name", "feature_summary", "truth",
                  "expected_risk", "expected_decision", "artifacts"]


def read_packets(spark: SparkSession, path: str, fmt: str = "parquet", schema: str = PACKET_SCHEMA) -> DataFrame:
    """Packets from any file source, with a declared schema (no inference pass)."""
    return spark.read.schema(schema).format(fmt).load(path)


def write_packets(packets: DataFrame, path: str, by: str = "sector", fmt: str = "parquet") -> None:
    """Partitioned by sector, so sector filters prune whole folders."""
    packets.write.mode("overwrite").partitionBy(by).format(fmt).save(path)


def load_by_id(requests: DataFrame, packets: DataFrame, fallback_id: int) -> DataFrame:
    """Packet for every requested id; ids that do not exist get ``fallback_id``.

    The fallback row is looked up once (a scalar subquery), so any number of
    unknown ids costs no join on one hot key.
    """
    columns = [c for c in packets.columns if c != "packet_id"]
    known = packets.select("packet_id", F.struct(*columns).alias("packet"))
    fallback = (packets.filter(F.col("packet_id") == fallback_id).limit(1)
                .select(F.struct(*columns).alias("fallback")).scalar())
    hit = F.col("packet").isNotNull()
    return (requests.join(known, "packet_id", "left")
            .withColumn("loaded_id", F.when(hit, F.col("packet_id")).otherwise(F.lit(fallback_id)))
            .withColumn("packet", F.coalesce(F.col("packet"), fallback))
            .select(*requests.columns, "loaded_id", *[f"packet.{c}" for c in columns]))


def intake(static: DataFrame, generated: DataFrame) -> DataFrame:
    """Static and generated packets in one table.

    The seven core columns come first; provenance columns that only generated
    packets have are NULL for static ones.
    """
    both = static.unionByName(generated, allowMissingColumns=True)
    extra = [c for c in both.columns if c not in INTAKE_COLUMNS]
    return both.select(*INTAKE_COLUMNS, *extra)


def outcome_for(truth: Column, flavour: str = "generator") -> tuple[Column, Column]:
    """(expected_risk, expected_decision) of a set of planted codes.

    Flavours differ in when a critical code makes the risk critical:
    ``generator`` from two codes on, ``mutator`` from three, ``adversarial``
    always.
    """
    from govaudit.catalog import severity_of
    needed = {"generator": 2, "mutator": 3, "adversarial": 1}[flavour]
    critical = F.exists(truth, lambda c: severity_of(c) == "critical")
    high = F.exists(truth, lambda c: severity_of(c) == "high")
    risk = (F.when(critical & (F.size(truth) >= needed), "critical")
            .when(critical | high, "high").otherwise("medium"))
    return risk, F.when(critical, "reject").otherwise("escalate")
