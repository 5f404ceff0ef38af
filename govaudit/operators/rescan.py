"""Scanning again only what changed.

A rule's verdict depends on the rule and on the texts it reads, so a digest of
both names it. ``rescan`` takes the verdicts of earlier scans, keeps those whose
packet and digest it meets again, and evaluates the rest: rules that are new or
have another SQL text, and packets one of whose artifacts that the rule reads has
changed. Other artifacts of a packet may change without any evaluation.

The digests cost a pass over the artifacts that rules read; only ids and digests
are shuffled. The texts of packets with something to evaluate are found by a join
on the id, whose small side Spark broadcasts by its size checks. Of a packet id
with several rows each row is told by its digests; a null id is an id like others.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govaudit.functions.sqltext import text
from govaudit.operators.rules import REGISTRY, Rule
from govaudit.operators.scan import artifact_text, rule_results
from govaudit.session import written


def _identity(rule: Rule) -> tuple[str, list[str]]:
    """A digest of a rule's SQL text, and the artifacts that it reads."""
    read: dict[str, None] = {}

    def artifact(name: str, lower: bool = False) -> str:
        read.setdefault(name)
        return f"<{name}|{lower}>"

    return hashlib.sha256(rule(artifact).encode()).hexdigest(), list(read)


def _with_digests(packets: DataFrame, registry: dict[str, Rule]) -> DataFrame:
    """``packets`` with ``_digests``: per rule its ord, code and the digest of the rule and the texts it reads."""
    rules = [(code, *_identity(rule)) for code, rule in registry.items()]
    used = {name: f"_sha_{i}" for i, name in enumerate(dict.fromkeys(name for *_, read in rules for name in read))}
    texts = packets.select("*", *[F.sha2(artifact_text(packets, name), 256).alias(column) for name, column in used.items()])
    entries = [F.struct(F.lit(i).alias("ord"), F.lit(code).alias("code"),
                        F.unhex(F.sha2(F.concat(F.lit(identity), *[F.col(used[name]) for name in read]), 256)).alias("digest"))
               for i, (code, identity, read) in enumerate(rules)]
    return texts.select(*packets.columns, F.array(*entries).alias("_digests"))


def digests(packets: DataFrame, registry: dict[str, Rule] = REGISTRY) -> DataFrame:
    """One row per packet and rule: packet_id, ord, code, digest."""
    return _with_digests(packets, registry).select("packet_id", F.inline_outer("_digests"))


def _gated(code: str, rule: Rule) -> Rule:
    """``rule``, evaluated only where its code is among those to evaluate."""
    return lambda artifact: f"CASE WHEN array_contains(_stale, {text(code)}) THEN {rule(artifact)} END"


def _same(other: DataFrame) -> tuple[DataFrame, Column]:
    """``other`` with its id and digest out of the way, and the condition that they are those of a row."""
    renamed = other.withColumnsRenamed({"packet_id": "_id", "digest": "_digest"})
    return renamed, F.col("packet_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))


def evaluated(packets: DataFrame, before: DataFrame, registry: dict[str, Rule] = REGISTRY) -> DataFrame:
    """packet_id, digest, message ('' if passed) of the verdicts that ``before`` doesn't hold, each once."""
    missing = digests(packets, registry).join(*_same(before.select("packet_id", "digest")), "left_anti")
    # at most one entry per rule, combined before the shuffle
    stale = missing.groupBy(F.col("packet_id").alias("_id")).agg(F.collect_set("code").alias("_stale"))
    due = packets.join(stale, F.col("packet_id").eqNullSafe(F.col("_id"))).select("packet_id", "artifacts", "_stale")
    results = rule_results(_with_digests(due, registry), {code: _gated(code, rule) for code, rule in registry.items()})
    verdicts = F.filter(F.arrays_zip("_digests", "results"), lambda x: F.array_contains(F.col("_stale"), x.results.code))
    return (results.select("packet_id", F.explode(verdicts).alias("x"))
            .select("packet_id", "x._digests.digest", "x.results.message").dropDuplicates(["packet_id", "digest"]))


def rescan(packets: DataFrame, before: DataFrame, registry: dict[str, Rule] = REGISTRY) -> DataFrame:
    """One row per packet and rule, as a full scan has it: packet_id, ord, code, passed, message, digest, and
    whether the verdict was ``evaluated`` now.

    ``before``: verdicts of earlier scans (packet_id, digest, message; more columns are left out), maybe empty.
    What comes back can be the next scan's ``before``. Starts a job: the new verdicts are written once.
    """
    new = written(evaluated(packets, before, registry), "verdicts")
    verdicts = (before.select("packet_id", "digest", "message").dropDuplicates(["packet_id", "digest"]).withColumn("evaluated", F.lit(False))
                .unionByName(new.withColumn("evaluated", F.lit(True))))
    known, same = _same(verdicts)
    # each digest is known once by now: where one id's rows fell due together, some were known before
    known = known.groupBy("_id", "_digest").agg(F.min("message").alias("message"), F.min("evaluated").alias("evaluated"))
    return digests(packets, registry).join(known, same).select(
        "packet_id", "ord", "code", (F.col("message") == "").alias("passed"), "message", "digest", "evaluated")
