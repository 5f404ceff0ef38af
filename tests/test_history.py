"""Folds, ratings, miss rates, leaderboard and memory against models."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from govaudit import catalog as cat
from govaudit.operators import leaderboard, memory, rating, weakness
from govaudit.operators.folds import ordered_pieces, running_offsets
from govaudit.sources import state
from govaudit.streaming.incremental import RATING_SCHEMA, WEAKNESS_SCHEMA, next_ratings, next_weakness
from tests import model


@pytest.fixture(scope="module")
def rounds(spark):
    """One agent owns most rounds; others have a few."""
    rng = random.Random(3)
    data = {1: [rng.random() for _ in range(3000)], **{a: [rng.random() for _ in range(a)] for a in range(2, 30)},
            40: [1.0] * 200, 41: [0.0] * 200}
    rows = [(a, i, float(s)) for a, scores in data.items() for i, s in enumerate(scores)]
    rng.shuffle(rows)
    return data, spark.createDataFrame(rows, "agent BIGINT, n BIGINT, overall DOUBLE").cache()


ORDER = ["n", "overall"]


def test_pieces_are_bounded_and_ordered(rounds):
    data, df = rounds
    rows = ordered_pieces(df, ["agent"], ORDER, F.col("n"), bits=4).collect()
    assert max(r.n for r in rows) <= 16
    hot = [x for r in sorted((r for r in rows if r.agent == 1), key=lambda r: r.piece) for x in r["items"]]
    assert hot == list(range(3000))


def test_offsets(rounds):
    _, df = rounds
    pieces = ordered_pieces(df, ["agent"], ORDER, F.col("n"), bits=4)
    rows = running_offsets(pieces, ["agent"], {"n": F.col("n")}, bits=4).collect()
    assert all(r.n_before == r["items"][0] for r in rows)


@pytest.mark.parametrize("piece, block", [(5, 10), (5, 5), (2, 2)])
def test_rating_history_against_model(rounds, piece, block):
    """One block, blocks that couple, blocks that mostly don't: same result."""
    data, df = rounds
    pieces = rating.round_pieces(df, ORDER, bits=piece)
    ratings = rating.piece_ratings(pieces, bits=block)
    got = {(r.agent, r.n): r.elo_after for r in rating.rating_history(pieces, ratings).collect()}
    for agent, scores in data.items():
        for i, want in enumerate(model.rate([s >= 0.75 for s in scores])):
            assert abs(got[agent, i] - want) < 1e-6
    final = {r.agent: r.rating for r in rating.rating_state(ratings).collect()}
    assert abs(final[1] - model.rate([s >= 0.75 for s in data[1]])[-1]) < 1e-6
    assert round(got[40, 0], 1) == 1025.9 and round(got[40, 59], 1) == 1844.7 and round(got[41, 59], 1) == 562.2


def test_blocks_couple_and_start_no_jobs(spark):
    """A long history is folded in as many rows as it has blocks, in a number of jobs that doesn't follow them."""
    rows = spark.range(60_000).selectExpr("1L AS agent", "id AS n", "CAST(pmod(xxhash64(id), 2) AS DOUBLE) AS overall")
    pieces = rating.round_pieces(rows, ORDER)
    wins = [r.overall >= 0.75 for r in rows.orderBy("n").collect()]
    want = model.rate(wins)[-1]
    jobs = {}
    for bits in (2, 3, 10):
        spark.sparkContext.setJobGroup(f"coupling-{bits}", "")
        ratings = rating.piece_ratings(pieces, bits=bits)
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup(f"coupling-{bits}")
        assert abs(rating.rating_state(ratings).first().rating - want) < 1e-6
        jobs[bits] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"coupling-{bits}"))
    spark.sparkContext.setJobGroup("", "")
    assert jobs[2] <= jobs[10] + 2
    blocks = rating._from_state(pieces.select("agent", F.shiftright("piece", 2).alias("block"), F.struct(
        "piece", "n", F.transform("items", lambda x: x.won).alias("wins")).alias("part")).groupBy("agent", "block").agg(
        F.array_sort(F.collect_list("part")).alias("parts")), None)
    assert rating._runs(blocks).agg(F.max(F.size("parts"))).first()[0] <= 8


@pytest.mark.parametrize("result", [0.0, 1.0])
def test_steps_keep_the_order_of_ratings(spark, result):
    """What coupling rests on, over all ratings from the floor to the ceiling, thresholds included."""
    ratings = spark.range(0, 761_000).select((F.lit(cat.RATING["floor"]) + F.col("id") / 100).alias("r"))
    after = ratings.select("r", rating.next_rating(F.col("r"), F.lit(result == 1.0)).alias("s"))
    steps = after.select((F.col("s") - F.lag("s").over(Window.orderBy("r"))).alias("rise"))
    assert steps.where("rise < 0").isEmpty()
    top = spark.range(1).select(rating.next_rating(F.lit(rating.CEILING), F.lit(True)).alias("s")).first().s
    assert top == rating.CEILING


def test_ratings_continue_from_state(spark, rounds):
    data, df = rounds
    first = next_ratings(spark.createDataFrame([], RATING_SCHEMA), df.filter("n < 7"), ORDER)
    both = {r.agent: r for r in next_ratings(first, df.filter("n >= 7"), ORDER).collect()}
    for agent, scores in data.items():
        assert both[agent].n_rounds == len(scores)
        assert abs(both[agent].rating - model.rate([s >= 0.75 for s in scores])[-1]) < 1e-6


@pytest.fixture(scope="module")
def outcomes(spark):
    rng = random.Random(8)
    data = {(1, "PII-001"): [rng.randint(0, 1) for _ in range(4000)], (2, "PII-001"): [1, 0, 0, 1],
            (2, "EVAL-008"): [1] * 300, (3, "AUDIT-007"): [0] * 300, (3, "EVAL-008"): [0, 1] * 100}
    rows = [(a, c, i, m) for (a, c), misses in data.items() for i, m in enumerate(misses)]
    rng.shuffle(rows)
    return data, spark.createDataFrame(rows, "agent BIGINT, code STRING, n BIGINT, missed INT").cache()


@pytest.mark.parametrize("bits", [3, 6, 10])
def test_miss_rates_against_model(outcomes, bits):
    data, df = outcomes
    pieces = ordered_pieces(df, ["agent", "code"], ["n", "missed"], F.col("missed"), bits)
    got = {(r.agent, r.code): r.state for r in weakness.MISS_RATE.final_states(pieces, ["agent", "code"], bits=bits).collect()}
    assert got == {k: model.miss_rate(v) for k, v in data.items()}
    assert got[2, "PII-001"] == 5230


def test_staircases_stand_for_any_state(outcomes):
    """A summary of a long piece gives the fold's value from every start."""
    _, df = outcomes
    pieces = ordered_pieces(df.filter("code = 'PII-001' AND agent = 1"), ["agent", "code"], ["n", "missed"], F.col("missed"), 6)
    for p, s in zip(pieces.orderBy("piece").collect(),
                    weakness.MISS_RATE.summaries(pieces, ["agent", "code"]).orderBy("piece").collect()):
        if s["items"] is None:
            for start in range(0, 10001, 37):
                assert s.base + sum(start >= c for c in s.cuts) == model.miss_rate(p["items"], start)


def test_weakness_continues_from_state(spark, outcomes):
    data, df = outcomes
    order = ["n", "missed"]
    first = next_weakness(spark.createDataFrame([], WEAKNESS_SCHEMA), df.filter("n < 50"), order)
    both = next_weakness(first, df.filter("n >= 50"), order).collect()
    assert {(r.agent, r.code): (r.total, r.missed, r.rate) for r in both} == {
        k: (len(v), sum(v), model.miss_rate(v)) for k, v in data.items()}


def test_weakness_state_has_all_codes(outcomes):
    _, df = outcomes
    rows = weakness.weakness_state(df, ["n", "missed"])
    assert rows.count() == 24
    report = weakness.curriculum(rows).filter("agent = 2").first()
    assert report.top_weaknesses[:2] == ["EVAL-008", "PII-001"] and report.difficulty == "medium"


def test_round_outcomes_against_model(rounds):
    data, df = rounds
    got = {(r.agent, r.n): r for r in leaderboard.round_outcomes(df, ORDER, bits=4).collect()}
    for agent, scores in data.items():
        wins = 0
        for i, s in enumerate(scores):
            wins += s >= 0.75
            r = got[agent, i]
            assert (r.round, r.reviewer_wins, r.maker_wins) == (i + 1, wins, i + 1 - wins)


def test_leaderboard(rounds):
    data, df = rounds
    rows = {r.agent: r for r in leaderboard.leaderboard(df, ORDER).collect()}
    assert rows[40].trend == cat.TREND_UP and rows[41].trend == cat.TREND_DOWN
    assert abs(rows[1].avg_score - sum(data[1][-10:]) / 10) < 1e-9


def test_last_k_is_limited_before_the_shuffle(rounds):
    _, df = rounds
    text = rating.latest(df, ORDER, 20)._jdf.queryExecution().executedPlan().toString()
    assert "row_number(), 20, Partial" in text


def test_mastery_and_rolling(spark):
    df = spark.createDataFrame([(1, i, 0.9, 1) for i in range(6)] + [(2, i, 0.9, 3) for i in range(6)] + [(3, 0, 1.0, 1)],
                               "agent INT, n INT, overall DOUBLE, task_id INT")
    assert {r.agent: r.next_task for r in memory.mastery_gate(df, ["n"]).collect()} == {1: 2, 2: 3, 3: 1}


def test_frequent_codes_break_ties_by_first_seen(spark):
    df = spark.createDataFrame([(1, 0, ["B", "A"]), (1, 1, ["A", "B", "C"])], "agent INT, n INT, missed ARRAY<STRING>")
    rows = memory.frequent_codes(df, ["n"], "missed", 2).orderBy("place").collect()
    assert [(r.code, r.n) for r in rows] == [("B", 2), ("A", 2)]


def test_state_tables(spark, rounds, tmp_path):
    _, df = rounds
    path = str(tmp_path / "rounds")
    assert state.load_or_empty(spark, path, "agent BIGINT, n BIGINT, overall DOUBLE").count() == 0
    state.save_history(df, path, ORDER, cat.ROUNDS_KEPT)
    back = state.load_or_empty(spark, path, "agent BIGINT, n BIGINT, overall DOUBLE")
    assert back.filter("agent = 1").agg(F.min("n")).first()[0] == 2980
    state.append_memory(df.limit(3), str(tmp_path / "memory"))
    state.append_memory(df.limit(2), str(tmp_path / "memory"))
    assert spark.read.parquet(str(tmp_path / "memory")).filter("remembered_at IS NOT NULL").count() == 5
    audits = spark.createDataFrame([("tech", 3, 0.5), ("retail", 2, 0.7)], "sector STRING, steps INT, score DOUBLE")
    state.save_audits(audits, str(tmp_path / "audits"))
    assert spark.read.json(str(tmp_path / "audits")).filter("sector = 'tech'").first().score == 0.5
    assert state.default_weakness(spark).filter("rate = 5000 AND total = 0").count() == 8
