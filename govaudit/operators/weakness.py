"""Per-code miss rates: counters, ordered moving average, curriculum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from govaudit import catalog as cat
from govaudit.operators.folds import MonotoneFold, ordered_pieces

# The rate is held in ten-thousandths and rounded half-up at every step, so it
# is an integer fold: rate' = (3 * 10000 * missed + 7 * rate + 5) div 10.
NEW, OLD = cat.MISS_NEW * cat.MISS_SCALE, cat.MISS_OLD


def next_rate(rate: Column, missed: Column) -> Column:
    return F.floor((missed * NEW + rate * OLD + 5) / 10)


def _smallest_rate(bound: Column, missed: Column) -> Column:
    return F.ceil((bound * 10 - 5 - missed * NEW) / OLD)


MISS_RATE = MonotoneFold(next_rate, _smallest_rate, low=0, high=cat.MISS_SCALE, start=cat.MISS_START)


def miss_counts(outcomes: DataFrame) -> DataFrame:
    """total and missed per agent and code; map-side combined."""
    return outcomes.groupBy("agent", "code").agg(
        F.count(F.lit(1)).alias("total"), F.sum("missed").cast("bigint").alias("missed"))


def miss_rates(outcomes: DataFrame, order: list[str], earlier: DataFrame | None = None) -> DataFrame:
    """(agent, code, rate) after the ordered history; rate in ten-thousandths.
    ``earlier`` (agent, code, rate) is where the fold goes on from."""
    key = ["agent", "code"]
    pieces = ordered_pieces(outcomes, key, order, F.col("missed"))
    starts = None if earlier is None else earlier.select(*key, F.col("rate").alias("state"))
    return MISS_RATE.final_states(pieces, key, starts).withColumnRenamed("state", "rate")


def observed_state(outcomes: DataFrame, order: list[str], earlier: DataFrame | None = None) -> DataFrame:
    """agent, code, total, missed, rate for codes with new history."""
    key = ["agent", "code"]
    seen = miss_counts(outcomes).join(miss_rates(outcomes, order, earlier), key)
    if earlier is None:
        return seen
    return (earlier.alias("old").join(seen.alias("new"), key, "full")
            .select(*key, *[(F.coalesce(f"new.{n}", F.lit(0)) + F.coalesce(f"old.{n}", F.lit(0))).alias(n)
                            for n in ("total", "missed")],
                    F.coalesce("new.rate", "old.rate").alias("rate")))


def weakness_state(outcomes: DataFrame, order: list[str]) -> DataFrame:
    """All eight codes per agent; codes without history get 0, 0, 0.5."""
    return with_default_rows(observed_state(outcomes, order))


def with_default_rows(state: DataFrame) -> DataFrame:
    """Fills in missing codes.  Works inside one row per agent (eight codes and
    whatever unknown ones the agent has), so nothing is multiplied out."""
    entry = F.struct("code", "total", "missed", "rate")
    per_agent = state.groupBy("agent").agg(F.collect_list(entry).alias("known"))
    codes = F.transform("known", lambda k: k.getField("code"))
    defaults = F.transform(F.array_except(cat.codes_array(), codes), lambda c: F.struct(
        c.alias("code"), F.lit(0).cast("bigint").alias("total"), F.lit(0).cast("bigint").alias("missed"),
        F.lit(cat.MISS_START).cast("bigint").alias("rate")))
    return per_agent.select("agent", F.inline(F.concat("known", defaults)))


def ranked_codes(state: DataFrame) -> Column:
    """Codes of an agent by miss rate, ties in registry order (aggregate)."""
    order = F.element_at(F.create_map(*[x for i, c in enumerate(cat.CODES) for x in (F.lit(c), F.lit(i))]), F.col("code"))
    return F.array_sort(F.collect_list(F.struct((-F.col("rate")).alias("down"), order.alias("ord"), "code", "rate")))


def curriculum(state: DataFrame) -> DataFrame:
    """Mean miss rate, the difficulty it calls for and the four weakest codes."""
    per_agent = state.groupBy("agent").agg(
        (F.avg("rate") / cat.MISS_SCALE).alias("avg_miss_rate"), ranked_codes(state).alias("ranked"))
    above = F.lit("hard")
    for low, label in reversed(cat.DIFFICULTY_BANDS):
        above = F.when(F.col("avg_miss_rate") > low, label).otherwise(above)
    return per_agent.select(
        "agent", "avg_miss_rate", above.alias("difficulty"),
        F.transform(F.slice("ranked", 1, 4), lambda r: r.getField("code")).alias("top_weaknesses"))


def selection_weight(rate: Column) -> Column:
    """Weight of a code for targeted packets, in ten-thousandths."""
    return F.greatest(F.lit(int(cat.WEIGHT_FLOOR * cat.MISS_SCALE)), rate)


def weakness_lines(state: DataFrame) -> DataFrame:
    """Report line per code, ranked within the agent (eight rows per agent)."""
    order = F.element_at(F.create_map(*[x for i, c in enumerate(cat.CODES) for x in (F.lit(c), F.lit(i))]), F.col("code"))
    worst_first = Window.partitionBy("agent").orderBy(F.desc("rate"), order)
    cells = F.floor(F.col("rate") * 10 / cat.MISS_SCALE).cast("int")
    line = F.concat(
        F.lit("  "), F.rpad("code", 16, " "), F.lit(" "), F.repeat(F.lit("█"), cells), F.repeat(F.lit("░"), 10 - cells),
        F.lit(" "), F.bround(F.col("rate") / 100).cast("int").cast("string"), F.lit("% miss ("),
        F.col("missed").cast("string"), F.lit("/"), F.col("total").cast("string"), F.lit(" episodes)"))
    return state.select("agent", "code", F.row_number().over(worst_first).alias("place"), line.alias("line"))
