"""Synthesising packets with planted violations.

All choices are drawn from keyed hashes, so a packet's content depends on its
id and the seed only: no shuffle, no state, the same on every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govaudit import catalog as cat
from govaudit.functions.packet_text import PATCHES, patched, template_artifacts
from govaudit.operators.scan import scan
from govaudit.sources.packets import outcome_for

TEXTS = "array<string>"


def _key(packet: Column, code: Column, seed: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), packet.cast("string"), code))


def _uniform(packet: Column, code: Column, seed: str) -> Column:
    """A number in (0, 1) from the first 32 bits of the key."""
    head = F.conv(F.substring(_key(packet, code, seed), 1, 8), 16, 10).cast("double")
    return (head + 0.5) / 4294967296.0


def _smallest(pool: Column, rank, k: Column) -> Column:
    ranked = F.array_sort(F.transform(pool, lambda c: F.struct(rank(c).alias("rank"), c.alias("code"))))
    return F.transform(F.slice(ranked, F.lit(1), k), lambda r: r.getField("code"))


def sampled(pool: Column, k: Column, packet: Column, seed: str) -> Column:
    """k codes of the pool, uniformly without replacement."""
    return _smallest(pool, lambda c: _key(packet, c, seed), F.least(k, F.size(pool)))


def weighted_sample(weights: Column, k: Column, packet: Column, seed: str) -> Column:
    """k codes drawn one after the other with the given weights.

    ``weights``: MAP<code, weight>.  The k smallest exponential waiting times
    have the same distribution as k successive weighted draws.
    """
    pool = F.map_keys(weights)
    wait = lambda c: -F.log(_uniform(packet, c, seed)) / F.element_at(weights, c)
    return _smallest(pool, wait, F.least(k, F.size(pool)))


def by_difficulty(difficulty: Column, requested: Column, packet: Column, seed: str) -> Column:
    """Codes for a new packet: the difficulty sets the pool and the maximum."""
    pools = {d: F.array(*[F.lit(c) for c in pool]) for d, (pool, _) in cat.DIFFICULTY_POOLS.items()}
    most = {d: n for d, (_, n) in cat.DIFFICULTY_POOLS.items()}
    pool = F.when(difficulty == "easy", pools["easy"]).when(difficulty == "medium", pools["medium"]).otherwise(pools["hard"])
    cap = F.when(difficulty == "easy", most["easy"]).when(difficulty == "medium", most["medium"]).otherwise(most["hard"])
    return sampled(pool, F.least(requested, cap), packet, seed)


def best_domain(selected: Column, weights: Column, forced: Column | None = None) -> Column:
    """Domain that may host most of the selected weight; ties in catalog order.

    ``weights``: MAP<code, BIGINT> in ten-thousandths, so sums are exact.
    """
    def weight_hosted(domain: str) -> Column:
        codes = [c for c, ds in cat.AFFINITY.items() if domain in ds]
        if not codes:
            return F.lit(0).cast("bigint")
        return F.aggregate(
            F.filter(selected, lambda c: c.isin(*codes)), F.lit(0).cast("bigint"),
            lambda a, c: a + F.coalesce(F.try_element_at(weights, c), F.lit(0)).cast("bigint"))

    scores = F.array(*[
        F.struct(weight_hosted(d).alias("score"), F.lit(-i).alias("up"), F.lit(d).alias("domain"))
        for i, (d, _) in enumerate(cat.DOMAINS)])
    best = F.array_max(scores).getField("domain")
    return best if forced is None else F.coalesce(forced, best)


def with_outcome(packets: DataFrame, flavour: str) -> DataFrame:
    risk, decision = outcome_for(F.col("truth"), flavour)
    return packets.withColumn("expected_risk", risk).withColumn("expected_decision", decision)


def template_with_patches(requests: DataFrame) -> DataFrame:
    """Plain packets with the patches of their chosen codes.

    ``requests``: packet_id, domain, truth.  The plain packet violates two
    rules by itself and two patches have no effect on it; ``label_audit`` shows
    which declared codes cannot be found and which come undeclared.
    """
    built = requests.select(
        "*", F.lit("generated").alias("source"),
        F.concat(F.initcap("domain"), F.lit(" Copilot")).alias("feature_name"),
        F.concat(F.lit("AI copilot for "), F.col("domain")).alias("feature_summary"),
        template_artifacts("domain").alias("artifacts"))
    return with_outcome(built.withColumn("artifacts", patched("artifacts", "truth")), "generator")


def verify_and_patch(packets: DataFrame) -> DataFrame:
    """Rescans packets and patches chosen codes the scan does not find.

    Truth becomes the found codes followed by the patched ones; other columns
    stay.  ``patched_codes`` says what had to be patched.
    """
    found = scan(packets)
    late = F.array_except("truth", "detected")
    return (found.withColumn("patched_codes", late)
            .withColumn("truth", F.concat(
                F.filter("truth", lambda c: F.array_contains(F.col("detected"), c)), F.col("patched_codes")))
            .withColumn("artifacts", patched("artifacts", "patched_codes"))
            .select(*packets.columns, "patched_codes"))


def mutate(packets: DataFrame, extra: int, seed: str, boost: bool = True) -> DataFrame:
    """Existing packets with ``extra`` (1 to 3) more codes patched in.

    With ``boost`` critical and high codes are taken while there are any.
    """
    if not 1 <= extra <= 3:
        raise ValueError("extra must be 1, 2 or 3")
    free = F.array_except(cat.codes_array(), "truth")
    severe = F.filter(free, lambda c: cat.severity_of(c).isin(*cat.SEVERE))
    pool = F.when(F.size(severe) > 0, severe).otherwise(free) if boost else free
    targets = cat.literal_map({c: a for c, (a, _) in PATCHES.items()})
    notes = F.transform("added", lambda c: F.concat(
        F.lit("Template patched "), F.element_at(targets, c), F.lit(" for "), c))
    chosen = packets.withColumn("added", sampled(pool, F.lit(extra), F.col("packet_id"), seed))
    return with_outcome(
        chosen.withColumn("artifacts", patched("artifacts", "added"))
        .withColumn("truth", F.concat("truth", "added"))
        .withColumn("feature_name", F.concat("feature_name", F.lit(" [Mutated]")))
        .withColumn("mutation_description", F.concat(
            F.lit("Base: "), F.col("packet_id").cast("string"), F.lit(". Added: ["), F.array_join("added", ", "),
            F.lit("]. Notes: "), F.array_join(notes, "; ")))
        .withColumn("source", F.lit("mutated")).withColumn("domain", F.lit("enterprise"))
        .withColumn("difficulty", F.lit("hard")),
        "mutator")
