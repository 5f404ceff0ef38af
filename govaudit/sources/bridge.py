"""Packets, review logs and outcome histories derived from star-schema tables.

Every derivation is a narrow projection of one table (plus, for ``reviews``,
a map-side combined distinct, and for packets an even deal of the table's rows
over tasks), so it grows with the table it reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from govaudit import catalog as cat
from govaudit.functions.packet_text import planted_artifacts
from govaudit.functions.sqltext import mapping, text, texts
from govaudit.sources.packets import outcome_for

SECTOR_OF = {"AUTOMOBILE": "finance", "BUILDING": "healthcare", "FURNITURE": "retail",
             "HOUSEHOLD": "tech", "MACHINERY": "tech"}
BUCKET_DAYS = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


PACKETS_PER_TASK = 8000


def tasks_for(df: DataFrame) -> int:
    """How many tasks share the work on ``df``, a packet a row: their number grows with the rows, a task's share doesn't. Counts the rows."""
    return max(1, -(-df.count() // PACKETS_PER_TASK))


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` dealt evenly over tasks: a packet is made of a few bytes, so that files are split into too few tasks for the texts."""
    tasks = tasks_for(rows)
    return rows.repartition(tasks) if tasks > 1 else rows


def pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.expr(texts(values)), (index + 1).cast("int"))


def codes_of_mask(mask: str) -> Column:
    """Codes whose bit is set in a BIGINT expression, in registry order."""
    bits = ", ".join(f"CASE WHEN (shiftright({mask}, {i}) & 1) = 1 THEN {text(c)} END" for i, c in enumerate(cat.CODES))
    return F.expr(f"array_compact(array({bits}))")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets_from(dealt(table(spark, sf_dir, "customer")))


def packets_from(customers: DataFrame) -> DataFrame:
    """One launch packet per customer; planted codes are the low byte of its key.

    Works on a batch or a stream of customers.
    """
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    days = "CASE WHEN array_contains(truth, 'RETENTION-005') THEN 91 + 10 * c_nationkey ELSE 30 + 2 * c_nationkey END"
    risk, decision = outcome_for(F.col("truth"))
    approve = F.size("truth") == 0
    return (customers
            .select(key, nation, "c_mktsegment", codes_of_mask("c_custkey").alias("truth"))
            .withColumn("domain", pick([d[1] for d in cat.DOMAINS], nation % 10))
            .select(
                key.alias("packet_id"),
                F.concat(F.lit("Assistant "), key.cast("string")).alias("feature_name"),
                F.concat(F.lit("Desk assistant for "), F.lower("domain")).alias("feature_summary"),
                "truth",
                F.when(approve, "low").otherwise(risk).alias("expected_risk"),
                F.when(approve, "approve").otherwise(decision).alias("expected_decision"),
                planted_artifacts("truth", "domain", days).alias("artifacts"),
                F.element_at(cat.literal_map(SECTOR_OF), F.col("c_mktsegment")).alias("sector"),
                "domain"))


def template_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One patched template packet per part; codes are the low byte of its key."""
    from govaudit.operators.synth import template_with_patches
    return template_with_patches(
        dealt(table(spark, sf_dir, "part"))
        .select(F.col("p_partkey").alias("packet_id"), codes_of_mask("p_partkey").alias("truth"),
                F.lower("p_type").alias("domain")))


def _props_k() -> Column:
    return F.regexp_extract("props", r'"k": *(\d+)', 1).cast("int")


def _episode() -> tuple[Column, Column]:
    bucket = F.floor(F.datediff(F.to_date("ts"), F.to_date(F.lit("2024-01-01"))) / BUCKET_DAYS)
    return bucket, F.concat_ws("-", F.col("user_id").cast("string"), bucket.cast("string"))


AGENT_STRIDE, BUCKET_STRIDE = 7919, 3571  # primes that spread episodes over all packets


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which packet each review episode is about, and who reviews it.

    Packets are numbered from 0 on, so their count (a scalar subquery) is the modulus.
    """
    return reviews_of(table(spark, sf_dir, "events"), table(spark, sf_dir, "customer"))


def reviews_of(events: DataFrame, packets: DataFrame) -> DataFrame:
    bucket, episode = _episode()
    count = packets.agg(F.nullif(F.count(F.lit(1)), F.lit(0))).scalar()
    return (events
            .select(episode.alias("episode_id"), F.col("user_id").alias("agent"), bucket.alias("bucket"))
            .distinct()
            .select("episode_id", "agent", "bucket",
                    ((F.col("agent") * AGENT_STRIDE + F.col("bucket") * BUCKET_STRIDE) % count).alias("packet_id")))


MALFORMED = [
    "not valid json",
    '{"action_type": "approve"} trailing',
    "{'action_type': 'approve'}",
    '["approve"]',
    '"approve"',
    "{}",
    '{"action_type": "inspect_artifact", "target": 5}',
    '{"action_type": "set_risk", "severity": "HIGH"}',
    '{"action_type": "inspect_artifact", "target": "' + "x" * 101 + '"}',
    '{"action_type": "inspect_artifact", "target": "model_card.json", "extra": 1}',  # valid
]
TARGETS = [*cat.ARTIFACTS, "release_notes.txt"]
FLAG_CODES = [*cat.CODES, "", "GHOST-999"]
DECIDE = [*cat.DECISIONS, cat.FINALIZE]


def raw_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return actions_from(table(spark, sf_dir, "events"))


def actions_from(events: DataFrame) -> DataFrame:
    """Review log with one raw JSON action per event: episode_id, seq, ts, agent, k (the event's number), raw.

    Works on a batch or a stream of events.
    """
    _, episode = _episode()

    def choose(values: list[str], index: str) -> str:
        return f"element_at({texts(values)}, CAST({index} AS INT) + 1)"

    def field(name: str, value: str) -> str:
        return f"""concat(', "{name}": "', {value}, '"')"""

    def act(kind: str, *rest: str) -> str:
        return "concat(" + ", ".join([text('{"action_type": "' + kind + '"'), *rest, "'}'"]) + ")"

    tens = "(k DIV 10)"
    severity = (f"CASE WHEN {tens} % 5 = 4 THEN '' "
                f"ELSE {field('severity', choose([*cat.SEVERITIES, ''], tens + ' % 5'))} END")
    code = choose(FLAG_CODES, "k % 10")
    own = field("severity", f"element_at({mapping({**cat.SEVERITY, '': 'low', 'GHOST-999': 'high'})}, {code})")
    inspect = act(cat.INSPECT, field("target", choose(TARGETS, "k % 10")))
    mitigated = choose(cat.CODES, "k % 8")
    flag = act(cat.FLAG, field("issue_code", code), f"CASE WHEN {tens} % 2 = 0 THEN {own} ELSE {severity} END",
               field("note", "concat('seen ', k)"))
    raw = F.expr(f"""CASE
        WHEN event_type = 'view' THEN {inspect}
        WHEN event_type = 'click' THEN {flag}
        WHEN event_type = 'signup' AND k < 80 THEN {act(cat.MITIGATE, field("issue_code", mitigated))}
        WHEN event_type = 'signup' THEN {act(cat.MITIGATE, field("issue_code", "''"), field("target", mitigated))}
        WHEN event_type = 'purchase' THEN {act(cat.SET_RISK, severity)}
        WHEN k % 10 = 0 THEN concat('{{"action_type": "', {choose(DECIDE, tens + ' % 4')}, '"}}')
        WHEN k % 10 = 1 THEN {choose(MALFORMED, tens)}
        ELSE {inspect} END""")
    return (events
            .withColumn("k", _props_k())
            .select(episode.alias("episode_id"), F.col("event_id").alias("seq"), "ts",
                    F.col("user_id").alias("agent"), "k", raw.alias("raw")))


def rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds_from(table(spark, sf_dir, "orders"))


def rounds_from(orders: DataFrame) -> DataFrame:
    """Scored review rounds per agent: agent, played_at, round_id, overall."""
    return (orders
            .select(F.col("o_custkey").alias("agent"), F.col("o_orderdate").alias("played_at"),
                    F.col("o_orderkey").alias("round_id"),
                    (F.col("o_totalprice") / 500000.0).alias("overall")))


def miss_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return miss_outcomes_from(table(spark, sf_dir, "lineitem"))


def miss_outcomes_from(lineitem: DataFrame) -> DataFrame:
    """One row per agent and planted code: was it missed?  Ordered by four keys."""
    return (lineitem
            .select(F.col("l_suppkey").alias("agent"),
                    pick(cat.CODES, F.col("l_partkey") % 8).alias("code"),
                    F.col("l_shipdate").alias("seen_at"), F.col("l_orderkey").alias("k1"),
                    F.col("l_linenumber").alias("k2"), F.col("l_partkey").alias("k3"),
                    F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("missed")))


MISS_ORDER = ["seen_at", "k1", "k2", "k3", "missed"]
ROUND_ORDER = ["played_at", "round_id", "overall"]
