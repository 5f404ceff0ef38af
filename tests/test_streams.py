"""Streams over several micro-batches give what the batch operators give."""

import pytest
from pyspark.sql import functions as F

from govaudit.functions.actions import parse_actions
from govaudit.operators import rating, replay, scan, weakness
from govaudit.sources import bridge
from govaudit.streaming import activity, incremental, scorer
from govaudit.streaming.files import run_available, stream_table


@pytest.fixture(scope="module")
def folders(spark, sf_dir, tmp_path_factory):
    """Tables cut into files along their order, one file per micro-batch."""
    root = tmp_path_factory.mktemp("streams")

    def split(name, order, parts):
        df = bridge.table(spark, sf_dir, name)
        bounds = df.approxQuantile(order, [i / parts for i in range(1, parts)], 0.0)
        folder = str(root / name)
        for low, high in zip([None, *bounds], [*bounds, None]):
            part = df
            part = part if low is None else part.filter(F.col(order) > low)
            part = part if high is None else part.filter(F.col(order) <= high)
            part.coalesce(1).write.mode("append").parquet(folder)
        return folder

    return {"events": split("events", "event_id", 3), "customer": split("customer", "c_custkey", 2)}


def test_packet_scan(spark, sf_dir, folders):
    packets = bridge.packets_from(stream_table(spark, folders["customer"], "*.parquet"))
    got = run_available(scan.scan(packets).select("packet_id", "detected"), "scan")
    want = scan.scan(bridge.packets(spark, sf_dir)).select("packet_id", "detected")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def assigned_of(spark, sf_dir):
    return replay.assignments(bridge.reviews(spark, sf_dir), bridge.packets(spark, sf_dir))


def test_online_scores_carry_state_over_batches(spark, sf_dir, folders):
    actions = parse_actions(bridge.actions_from(stream_table(spark, folders["events"], "*.parquet")))
    actions = actions.withColumn("ts", F.col("ts").cast("timestamp"))
    assigned = assigned_of(spark, sf_dir)
    got = scorer.score_stream(actions, assigned, max_steps=8, silence_ms=10**12)
    batch = parse_actions(bridge.raw_actions(spark, sf_dir))
    want = replay.every_action(batch, replay.replay(batch, assigned, 8))
    as_rows = lambda df: sorted((r.episode_id, r.seq, r.status, round(r.reward, 6)) for r in df.collect())
    assert as_rows(got) == as_rows(want)


def test_silent_reviews_are_closed(spark, sf_dir, folders):
    actions = parse_actions(bridge.actions_from(stream_table(spark, folders["events"], "*.parquet")))
    actions = actions.withColumn("ts", F.col("ts").cast("timestamp"))
    closed = scorer.score_stream(actions, assigned_of(spark, sf_dir), silence_ms=3600 * 1000).filter("status = 'silent'")
    assert closed.count() > 0 and closed.filter("reward <> 0").count() == 0


def test_incremental_state_equals_batch(spark, sf_dir, folders):
    def rounds_of(events):
        return events.select(F.col("user_id").alias("agent"), F.col("event_id").alias("played_at"),
                             F.col("event_id").alias("round_id"), (F.col("value") / 60).alias("overall"))

    def misses_of(events):
        return events.select(F.col("user_id").alias("agent"), F.col("event_type").alias("code"),
                             F.col("event_id").alias("n"), (F.col("value") > 20).cast("int").alias("missed"))

    stream = lambda: stream_table(spark, folders["events"], "*.parquet")
    events = bridge.table(spark, sf_dir, "events")
    got = incremental.streamed_ratings(rounds_of(stream()), bridge.ROUND_ORDER)
    pieces = rating.round_pieces(rounds_of(events), bridge.ROUND_ORDER)
    want = rating.rating_state(rating.piece_ratings(pieces))
    assert sorted((r.agent, round(r.rating, 6), r.n_rounds) for r in got.collect()) == \
        sorted((r.agent, round(r.rating, 6), r.n_rounds) for r in want.collect())
    got = incremental.streamed_weakness(misses_of(stream()), ["n", "missed"])
    want = weakness.observed_state(misses_of(events), ["n", "missed"])
    key = lambda df: sorted((r.agent, r.code, r.total, r.missed, r.rate) for r in df.collect())
    assert key(got) == key(want)


@pytest.fixture(scope="module")
def shuffled(spark, sf_dir, tmp_path_factory):
    """The orders in a folder of part files, in no order of any agent."""
    folder = tmp_path_factory.mktemp("shuffled")
    bridge.table(spark, sf_dir, "orders").repartition(3, "o_orderkey").write.parquet(f"{folder}/orders.parquet")
    return folder


def states(df):
    return sorted((r.agent, round(r.rating, 6), r.n_rounds) for r in df.collect())


def test_files_in_any_order_equal_batch(spark, sf_dir, shuffled):
    rounds = bridge.rounds(spark, sf_dir)
    want = rating.rating_state(rating.piece_ratings(rating.round_pieces(rounds, bridge.ROUND_ORDER)))
    stream = bridge.rounds_from(stream_table(spark, str(shuffled), "orders.parquet"))
    assert states(incremental.streamed_ratings(stream, bridge.ROUND_ORDER)) == states(want)


def test_a_second_run_goes_on(spark, sf_dir, shuffled, tmp_path):
    parts = sorted(shuffled.glob("orders.parquet/*.parquet"))
    folder = tmp_path / "orders.parquet"
    folder.mkdir()
    path = str(tmp_path / "state")
    for part in parts:  # each run sees one file more and nothing twice
        (folder / part.name).write_bytes(part.read_bytes())
        stream = bridge.rounds_from(stream_table(spark, str(tmp_path), "orders.parquet"))
        got = incremental.streamed_ratings(stream, bridge.ROUND_ORDER, path)
    rounds = bridge.rounds(spark, sf_dir)
    want = rating.rating_state(rating.piece_ratings(rating.round_pieces(rounds, bridge.ROUND_ORDER)))
    assert states(got) == states(want)
    assert len(list((tmp_path / "state").glob("version=*"))) <= 2


def test_late_actions_change_their_reviews(spark, sf_dir, tmp_path):
    bridge.table(spark, sf_dir, "events").repartition(3, "event_id").write.parquet(f"{tmp_path}/events.parquet")
    actions = parse_actions(bridge.actions_from(stream_table(spark, str(tmp_path), "events.parquet")))
    assigned = assigned_of(spark, sf_dir)
    got = scorer.score_stream(actions.withColumn("ts", F.col("ts").cast("timestamp")), assigned, silence_ms=10**12)
    batch = parse_actions(bridge.raw_actions(spark, sf_dir))
    want = replay.every_action(batch, replay.replay(batch, assigned))
    as_rows = lambda df: sorted((r.episode_id, r.seq, r.status, round(r.reward, 6)) for r in df.collect())
    assert as_rows(got) == as_rows(want)


def test_activity_windows(spark, folders):
    actions = parse_actions(bridge.actions_from(stream_table(spark, folders["events"], "*.parquet")))
    actions = actions.withColumn("ts", F.col("ts").cast("timestamp"))
    counts = run_available(activity.action_counts(actions), "counts")
    assert counts.agg(F.sum("n_actions")).first()[0] > 900
    sessions = run_available(activity.reviewer_sessions(actions), "sessions")
    assert sessions.filter("session_end <= session_start").count() == 0 and sessions.count() > 100
