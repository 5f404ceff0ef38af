"""Queries over synthesised packets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from govaudit import catalog as cat
from govaudit.operators import reservoir, scan, synth, weakness
from govaudit.plans import sql
from govaudit.plans.history import WEAKNESS, weakness_table
from govaudit.plans.packets import TEMPLATE_BLOCKS
from govaudit.plans.registry import query
from govaudit.plans.reviews import joined
from govaudit.plans.sql import listed, q, qlist
from govaudit.sources import bridge
from govaudit.sources.packets import outcome_for

SEED = "launch"
LEVELS = list(cat.DIFFICULTY_POOLS)


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generation requests from orders: difficulty and 1 to 4 violations."""
    key = F.col("o_orderkey")
    return bridge.table(spark, sf_dir, "orders").select(
        key.alias("packet_id"), bridge.pick(LEVELS, key % 3).alias("difficulty"),
        (F.floor(key / 3) % 4 + 1).cast("int").alias("requested"), "o_custkey")


_REQUESTS = (f"SELECT o_orderkey AS packet_id, ({qlist(LEVELS)})[(o_orderkey % 3) + 1] AS difficulty, "
             "o_orderkey // 3 % 4 + 1 AS requested, o_custkey FROM orders")


def _drawn(pool: str, k: str, seed: str = SEED) -> str:
    """k codes of a pool list by the order of their hashed keys."""
    ranked = f"list_sort(list_transform({pool}, lambda c: {{'rank': md5('{seed}|' || packet_id || '|' || c), 'code': c}}))"
    return f"list_transform({ranked}[1:{k}], lambda r: r.code)"


_POOL = "CASE difficulty " + " ".join(f"WHEN {q(d)} THEN {qlist(p)}" for d, (p, _) in cat.DIFFICULTY_POOLS.items()) + " END"
_MOST = "CASE difficulty " + " ".join(f"WHEN {q(d)} THEN {n}" for d, (_, n) in cat.DIFFICULTY_POOLS.items()) + " END"


@query(sql.query(f"SELECT packet_id, difficulty, {listed(_drawn(_POOL, f'least(requested, {_MOST})'))} AS chosen FROM requests",
                 extra={"requests": _REQUESTS}))
def codes_by_difficulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = synth.by_difficulty(F.col("difficulty"), F.col("requested"), F.col("packet_id"), SEED)
    return (_requests(spark, sf_dir).withColumn("chosen", chosen)
            .select("packet_id", "difficulty", *joined("chosen")))


def _agent_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selection weights per agent as one map (eight entries)."""
    state = weakness_table(spark, sf_dir)
    order = F.array_position(cat.codes_array(), F.col("code"))
    return state.groupBy("agent").agg(F.map_from_entries(F.transform(
        F.array_sort(F.collect_list(F.struct(order.alias("ord"), "code", weakness.selection_weight(F.col("rate")).alias("w")))),
        lambda r: F.struct(r.code, r.w))).alias("weights"))


def targeted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per agent a targeted packet: codes by weakness, domain by affinity."""
    weights = F.col("weights")
    wanted = (F.col("agent") % 4 + 1).cast("int")
    picked = _agent_weights(spark, sf_dir).withColumn(
        "chosen", synth.weighted_sample(weights, wanted, F.col("agent"), SEED))
    forced = F.when(F.col("agent") % 10 == 0, F.lit("telecom"))
    return picked.withColumn("domain", synth.best_domain(F.col("chosen"), weights, forced))


_U = "(('0x' || substr(md5('launch|' || agent || '|' || c), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE"
_AFFINE = ("CASE d " + " ".join(
    f"WHEN {q(d)} THEN {qlist([c for c, ds in cat.AFFINITY.items() if d in ds]) if any(d in ds for ds in cat.AFFINITY.values()) else sql.NONE}"
    for d, _ in cat.DOMAINS) + " END")
_TARGETED = {
    **WEAKNESS,
    "weighted": "SELECT agent, code, code AS c, greatest(1500, rate) AS w FROM weakness",
    "waits": f"SELECT *, row_number() OVER (PARTITION BY agent ORDER BY -ln({_U}) / w) AS place FROM weighted",
    "taken": "SELECT * FROM waits WHERE place <= agent % 4 + 1",
    "chosen": "SELECT agent, list(code ORDER BY place) AS chosen FROM taken GROUP BY 1",
    "hosted": f"""
      SELECT agent, d, ord, coalesce(sum(w) FILTER (WHERE list_contains({_AFFINE}, code)), 0) AS score FROM taken
      CROSS JOIN (SELECT unnest({qlist([d for d, _ in cat.DOMAINS])}) AS d, unnest(range({len(cat.DOMAINS)})) AS ord)
      GROUP BY ALL""",
    "best": "SELECT agent, d FROM hosted QUALIFY row_number() OVER (PARTITION BY agent ORDER BY score DESC, ord) = 1"}


@query(sql.query(f"""
  SELECT agent, {listed('chosen')} AS chosen, CASE WHEN agent % 10 = 0 THEN 'telecom' ELSE d END AS domain
  FROM chosen JOIN best USING (agent)""", extra=_TARGETED))
def targeted_codes_and_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targeted(spark, sf_dir).select("agent", *joined("chosen"), "domain")


SAMPLED = 40
_DRAWN = "(('0x' || substr(md5('launch|' || packet_id), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE"


@query(sql.query(f"""
  SELECT sector, packet_id, weight, CAST(place AS INTEGER) AS place FROM (
    SELECT sector, packet_id, weight, row_number() OVER (PARTITION BY sector ORDER BY -ln({_DRAWN}) / weight, packet_id) AS place FROM (
      SELECT p.packet_id, p.sector, CAST(1500 + coalesce(sum(r.rate), 0) AS BIGINT) AS weight
      FROM (SELECT packet_id, sector, unnest(CASE WHEN len(truth) = 0 THEN [NULL] ELSE truth END) AS code FROM packets) p
      LEFT JOIN (SELECT code, sum(missed) * 10000 // count(*) AS rate FROM misses GROUP BY 1) r ON r.code = p.code
      GROUP BY 1, 2)) WHERE place <= {SAMPLED}""", "packets", extra={"misses": WEAKNESS["misses"]}))
def packets_drawn_by_miss_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per sector a sample for training reviewers: packets whose planted codes are often missed come rather than others."""
    rates = (bridge.miss_outcomes(spark, sf_dir).groupBy("code").agg((F.floor(F.sum("missed") * 10000 / F.count(F.lit(1)))).cast("bigint").alias("rate"))
             .agg(F.map_from_entries(F.collect_list(F.struct("code", "rate")))).scalar())  # eight entries
    weighted = (bridge.packets(spark, sf_dir).select("packet_id", "sector", "truth").withColumn("rates", rates)
                .withColumn("weight", F.expr("aggregate(truth, 1500L, (sum, code) -> sum + coalesce(rates[code], 0L))")))
    return (reservoir.weighted_reservoir(weighted, ["sector"], F.col("weight"), SAMPLED, "packet_id", SEED)
            .select("sector", "packet_id", "weight", "place"))


@query(sql.query("SELECT packet_id, " + ", ".join(
    f"{sql.risk_of('truth', n)} AS {f}_risk, {sql.decision_of('truth')} AS {f}_decision"
    for f, n in (("generator", 2), ("mutator", 3), ("adversarial", 1))) + " FROM packets WHERE len(truth) > 0", "packets"))
def expected_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = bridge.packets(spark, sf_dir).filter(F.size("truth") > 0)
    columns: list[Column] = []
    for flavour in ("generator", "mutator", "adversarial"):
        risk, decision = outcome_for(F.col("truth"), flavour)
        columns += [risk.alias(f"{flavour}_risk"), decision.alias(f"{flavour}_decision")]
    return planted.select("packet_id", *columns)


@query(sql.query(f"""
  SELECT {listed('truth')} AS planted, CAST(count(*) AS BIGINT) AS n_packets,
    CAST(count(*) FILTER (WHERE truth = detected) AS BIGINT) AS n_exact FROM scan GROUP BY 1""", "scan"))
def planted_sets_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = scan.scan(bridge.packets(spark, sf_dir))
    return (scanned.groupBy(F.array_join("truth", ",").alias("planted"))
            .agg(F.count(F.lit(1)).alias("n_packets"), F.count(F.when(F.col("truth") == F.col("detected"), 1)).alias("n_exact")))


@query(sql.query("SELECT packet_id, product_spec_md AS spec, model_card_json AS card, human_oversight_md AS oversight, "
                 "logging_policy_yaml AS logging FROM template", extra={"template": TEMPLATE_BLOCKS["template"]}))
def patched_template_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = F.col("artifacts")
    return bridge.template_packets(spark, sf_dir).select(
        "packet_id", texts.getField("product_spec.md").alias("spec"), texts.getField("model_card.json").alias("card"),
        texts.getField("human_oversight.md").alias("oversight"), texts.getField("logging_policy.yaml").alias("logging"))


# Packets whose text hides some chosen codes: planted by the low byte of the
# key, chosen by the low byte of three times the key.
_CHOSEN = sql.codes_of_mask("(packet_id * 3)")
_LATE = "list_filter(chosen, lambda c: NOT list_contains(detected, c))"
_PATCHED = ", ".join(f"{sql.patched_text(a, sql.col_of(a), 'late')} AS {sql.col_of(a)}" for a in cat.ARTIFACTS)


@query(sql.query(f"""
  SELECT packet_id, {listed('list_concat(list_filter(chosen, lambda c: list_contains(first_found, c)), late)')} AS truth,
    {listed('late')} AS patched_codes, {listed('detected')} AS detected FROM rescan""", "scan", extra={
        "late": f"SELECT * EXCLUDE (m0, m1, m2, m3, m4, m5, m6, m7), {_LATE} AS late, detected AS first_found "
                f"FROM (SELECT *, {_CHOSEN} AS chosen FROM scan)",
        "fixed": f"SELECT packet_id, chosen, late, first_found, {_PATCHED} FROM late",
        "rescan": sql.scanned("fixed")}))
def verified_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = bridge.packets(spark, sf_dir).withColumn("truth", bridge.codes_of_mask("(packet_id * 3)"))
    return (scan.scan(synth.verify_and_patch(chosen))
            .select("packet_id", *joined("truth", "patched_codes", "detected")))


_FREE = f"list_filter({sql.CODES}, lambda c: NOT list_contains(truth, c))"
_SEVERE = f"list_filter({_FREE}, lambda c: list_contains({qlist([c for c, s in cat.SEVERITY.items() if s in cat.SEVERE])}, c))"
def _mutants(extra: int, boost: bool) -> dict[str, str]:
    pool = f"(CASE WHEN len({_SEVERE}) > 0 THEN {_SEVERE} ELSE {_FREE} END)" if boost else _FREE
    return {
        "mutants": f"""
          SELECT * EXCLUDE (m0, m1, m2, m3, m4, m5, m6, m7, detected, truth), truth AS old_truth, list_concat(truth, added) AS truth
          FROM (SELECT *, {_drawn(pool, str(extra))} AS added FROM scan)""",
        "mutated": "SELECT packet_id, feature_name, old_truth, added, truth, " + ", ".join(
            f"{sql.patched_text(a, sql.col_of(a), 'added')} AS {sql.col_of(a)}" for a in cat.ARTIFACTS) + " FROM mutants",
        "mscan": sql.scanned("mutated")}


_WHERE = sql.case_map("c", cat.ARTIFACT_OF, "NULL")


_MUTATED = f"""
  SELECT packet_id, feature_name || ' [Mutated]' AS feature_name, {listed('truth')} AS truth, {listed('detected')} AS detected,
    {sql.risk_of('truth', 3)} AS expected_risk, {sql.decision_of('truth')} AS expected_decision,
    'Base: ' || packet_id || '. Added: [' || array_to_string(added, ', ') || ']. Notes: ' ||
      array_to_string(list_transform(added, lambda c: 'Template patched ' || {_WHERE} || ' for ' || c), '; ') AS mutation_description
  FROM mscan"""


def _mutated(spark: SparkSession, sf_dir: str, extra: int, boost: bool) -> DataFrame:
    mutants = synth.mutate(bridge.packets(spark, sf_dir), extra=extra, seed=SEED, boost=boost)
    return scan.scan(mutants).select(
        "packet_id", "feature_name", *joined("truth", "detected"), "expected_risk", "expected_decision",
        "mutation_description")


@query(sql.query(_MUTATED, "scan", extra=_mutants(2, True)))
def mutated_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mutated(spark, sf_dir, 2, True)


@query(sql.query(_MUTATED, "scan", extra=_mutants(1, False)))
def lightly_mutated_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mutated(spark, sf_dir, 1, False)


@query(sql.query(_MUTATED, "scan", extra=_mutants(3, True)))
def heavily_mutated_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mutated(spark, sf_dir, 3, True)
