"""Choosing codes and domains, patching, mutating."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from govaudit import catalog as cat
from govaudit.operators import scan, synth
from govaudit.sources import bridge
from govaudit.sources.packets import outcome_for


def test_difficulty_bounds_pool_and_number(spark):
    df = spark.range(3000).select("id", bridge.pick(list(cat.DIFFICULTY_POOLS), F.col("id") % 3).alias("d"))
    rows = df.select("d", synth.by_difficulty(F.col("d"), F.lit(4), F.col("id"), "s").alias("c")).collect()
    seen = Counter()
    for r in rows:
        pool, most = cat.DIFFICULTY_POOLS[r.d]
        assert len(r.c) == most == len(set(r.c)) and set(r.c) <= set(pool)
        seen.update((r.d, c) for c in r.c)
    assert min(seen["hard", c] for c in cat.CODES) > 400  # 500 expected


def test_weighted_sampling_prefers_heavy_codes(spark):
    weights = F.expr("map('a', 6000L, 'b', 3000L, 'c', 1000L)")
    rows = spark.range(20000).select(synth.weighted_sample(weights, F.lit(2), F.col("id"), "s").alias("c")).collect()
    first = Counter(r.c[0] for r in rows)
    assert abs(first["a"] / 20000 - 0.6) < 0.02 and abs(first["c"] / 20000 - 0.1) < 0.02
    second = Counter(r.c[1] for r in rows if r.c[0] == "a")
    assert abs(second["b"] / sum(second.values()) - 0.75) < 0.02


def test_best_domain(spark):
    weights = F.expr("map('DOMAIN-004', 5000L, 'EVAL-008', 9000L, 'AUDIT-007', 1500L)")
    pick = lambda codes, forced=None: synth.best_domain(F.array(*[F.lit(c) for c in codes]), weights, forced)
    row = spark.range(1).select(
        pick(["DOMAIN-004"]).alias("a"), pick(["EVAL-008", "AUDIT-007"]).alias("b"), pick(["NONE"]).alias("c"),
        pick(["EVAL-008"], F.lit("hr")).alias("d")).first()
    assert tuple(row) == ("fintech", "government", "fintech", "hr")


@pytest.mark.parametrize("truth,want", [
    (["EVAL-008"], {"generator": ("medium", "escalate"), "mutator": ("medium", "escalate"), "adversarial": ("medium", "escalate")}),
    (["AUDIT-007"], {"generator": ("high", "escalate"), "mutator": ("high", "escalate"), "adversarial": ("high", "escalate")}),
    (["PII-001"], {"generator": ("high", "reject"), "mutator": ("high", "reject"), "adversarial": ("critical", "reject")}),
    (["PII-001", "EVAL-008"], {"generator": ("critical", "reject"), "mutator": ("high", "reject"),
                               "adversarial": ("critical", "reject")}),
])
def test_outcomes(spark, truth, want):
    df = spark.createDataFrame([(truth,)], "truth ARRAY<STRING>")
    for flavour, expected in want.items():
        assert tuple(df.select(*outcome_for(F.col("truth"), flavour)).first()) == expected


def test_verified_packets_show_what_patches_can_show(spark, sf_dir):
    chosen = bridge.packets(spark, sf_dir).withColumn("truth", cat.codes_array())
    rows = scan.scan(synth.verify_and_patch(chosen)).select("truth", "detected").collect()
    assert all(sorted(r.truth) == sorted(cat.CODES) for r in rows)
    assert all({"PII-001", "ACCESS-002", "DOMAIN-004", "RETENTION-005", "TRAINING-006", "EVAL-008"} <= set(r.detected) for r in rows)


def test_mutation_prefers_severe_codes(spark, sf_dir):
    base = bridge.packets(spark, sf_dir)
    rows = synth.mutate(base, 2, "s").select("added", "truth", "mutation_description", "source").collect()
    for r in rows:
        free_severe = [c for c in cat.CODES if cat.SEVERITY[c] in cat.SEVERE and c not in r.truth[:len(r.truth) - len(r.added)]]
        if len(free_severe) >= 2:
            assert all(cat.SEVERITY[c] in cat.SEVERE for c in r.added)
        assert len(set(r.truth)) == len(r.truth) and r.source == "mutated"
    with pytest.raises(ValueError):
        synth.mutate(base, 4, "s")
