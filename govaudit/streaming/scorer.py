"""Scoring reviews while they happen.

Each micro-batch replays the open reviews that it touches, with the same
expressions as the batch replay, and writes the fate of all their rows so far.
Rows that come late or out of order so change what was said before: a review's
newest scores count. Below the named path: ``progress``, ``open`` (the rows of open
reviews, a version per batch, the last two kept), ``closed`` and ``scores``.

A review that falls silent for longer than the timeout, measured against the
newest row seen, is closed with a ``silent`` row unless it had ended; rows of a
closed review get reward 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govaudit import catalog as cat
from govaudit.operators import replay
from govaudit.session import cut_lineage, new_path
from govaudit.streaming.files import children, committed, exists, remove, run_batches

ROWS = ["episode_id", "seq", "ts", "valid", "action_type", "target", "severity", "issue_code", "note"]
SCORES = "episode_id STRING, seq BIGINT, status STRING, reward DOUBLE, batch BIGINT"
CLOSED = "episode_id STRING, batch BIGINT"


def score_stream(actions: DataFrame, assigned: DataFrame, path: str | None = None, max_steps: int = cat.MAX_STEPS,
                 silence_ms: int = 7 * 24 * 3600 * 1000) -> DataFrame:
    """episode_id, seq, status, reward of every row, after the data that is there.

    ``actions``: a stream of parsed actions with ``ts``. ``assigned``: one row per
    episode with the packet's facts. A second run with the same path goes on.
    """
    spark = actions.sparkSession
    path = path or new_path(spark, "scores")

    def each(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        rows = cut_lineage(batch.select(*ROWS))
        versions = [int(x.removeprefix("version=")) for x in children(session, f"{path}/open")]
        before = max((v for v in versions if v < batch_id and committed(session, f"{path}/open/version={v}")), default=None)
        held = rows.limit(0) if before is None else session.read.schema(rows.schema).parquet(f"{path}/open/version={before}")
        closed = session.createDataFrame([], CLOSED)
        if exists(session, f"{path}/closed"):
            closed = session.read.schema(CLOSED).parquet(f"{path}/closed").where(F.col("batch") < batch_id)
        closed = closed.select("episode_id").distinct()

        fresh = rows.join(closed, "episode_id", "left_anti")
        opened = cut_lineage(held.unionByName(fresh))
        touched = fresh.select("episode_id").distinct()
        mine = opened.join(touched, "episode_id", "left_semi")
        steps = cut_lineage(replay.replay(mine, assigned.join(touched, "episode_id", "left_semi"), max_steps))
        fates = replay.every_action(mine, steps)
        gone = rows.join(closed, "episode_id", "left_semi").select(
            "episode_id", "seq", F.lit("post_terminal_action").alias("status"), F.lit(0.0).alias("reward"))

        # one number: the newest row seen
        newest = opened.agg(F.max("ts").alias("ts")).scalar()
        last = opened.groupBy("episode_id").agg(F.max("ts").alias("ts"))
        silent = cut_lineage(last.where(F.unix_millis("ts") + silence_ms < F.unix_millis(newest)).select("episode_id"))
        # a review that had ended earlier than this batch says so in its open rows as well
        quiet = opened.join(silent, "episode_id", "left_semi")
        ended = replay.episode_ends(replay.replay(quiet, assigned.join(silent, "episode_id", "left_semi"), max_steps)).select("episode_id")
        closing = silent.join(ended, "episode_id", "left_anti").select(
            "episode_id", F.lit(-1).cast("long").alias("seq"), F.lit("silent").alias("status"), F.lit(0.0).alias("reward"))

        scored = fates.unionByName(gone).unionByName(closing)
        scored.write.mode("overwrite").parquet(f"{path}/scores/batch={batch_id}")
        silent.write.mode("overwrite").parquet(f"{path}/closed/batch={batch_id}")
        opened.join(silent, "episode_id", "left_anti").write.mode("overwrite").parquet(f"{path}/open/version={batch_id}")
        for v in versions:
            if before is not None and v < before:
                remove(session, f"{path}/open/version={v}")

    run_batches(actions, path, each)
    if not exists(spark, f"{path}/scores"):
        return spark.createDataFrame([], SCORES).drop("batch")
    scores = spark.read.schema(SCORES).parquet(f"{path}/scores")
    # the newest word on each row; map-side combined
    return (scores.groupBy("episode_id", "seq").agg(F.max_by(F.struct("status", "reward"), "batch").alias("s"))
            .select("episode_id", "seq", "s.status", "s.reward"))
