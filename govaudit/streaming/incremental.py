"""Ratings and miss rates kept up to date batch by batch.

A named path holds what a run needs to go on from the last one: ``progress``
(which files have been seen), ``history`` (the rows of each batch) and
``version=N`` (the state after batch N; the last two are kept). A repeated batch
overwrites its own history and version.

Rows may come in any order. The state remembers each group's last order key.
Groups whose new rows all come later are folded on from their state; groups with
earlier rows are folded again from their whole history.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from govaudit.operators import rating, weakness
from govaudit.session import cut_lineage, new_path
from govaudit.streaming.files import children, committed, remove, run_batches

Fold = Callable[[DataFrame, DataFrame], DataFrame]

RATING_SCHEMA = "agent BIGINT, rating DOUBLE, n_rounds BIGINT"
WEAKNESS_SCHEMA = "agent BIGINT, code STRING, total BIGINT, missed BIGINT, rate BIGINT"


def next_ratings(earlier: DataFrame, rounds: DataFrame, order: list[str]) -> DataFrame:
    """State after a batch of rounds that follow the earlier ones: agent, rating, n_rounds."""
    ratings = rating.piece_ratings(rating.round_pieces(rounds, order), earlier)
    seen = rating.rating_state(ratings)
    return (earlier.alias("old").join(seen.alias("new"), "agent", "full")
            .select("agent", F.coalesce("new.rating", "old.rating").alias("rating"),
                    (F.coalesce("new.n_rounds", F.lit(0)) + F.coalesce("old.n_rounds", F.lit(0))).alias("n_rounds")))


def next_weakness(earlier: DataFrame, outcomes: DataFrame, order: list[str]) -> DataFrame:
    return weakness.observed_state(outcomes, order, earlier)


def _newest(spark: SparkSession, path: str, below: int | None = None) -> int | None:
    versions = [int(x.removeprefix("version=")) for x in children(spark, path) if x.startswith("version=")]
    ready = [v for v in versions if (below is None or v < below) and committed(spark, f"{path}/version={v}")]
    return max(ready, default=None)


def _advance(earlier: DataFrame | None, nothing: DataFrame, batch: DataFrame, history: Callable[[], DataFrame], key: list[str], order: list[str],
             fold: Fold) -> DataFrame:
    """The state after a batch. ``nothing``: an empty state; ``history``: all rows so far, the batch's included."""
    last = F.max(F.struct(*order)).alias("last")
    ends = batch.groupBy(*key).agg(F.min(F.struct(*order)).alias("first"), last)
    if earlier is None:
        return fold(nothing, batch).join(ends.select(*key, "last"), key)
    known = ends.select(*key, "first").join(earlier.select(*key, "last"), key, "left")
    behind = cut_lineage(known.where("last IS NOT NULL AND first <= last").select(*key))  # one row per group
    ahead = batch.join(behind, key, "left_anti")
    before = earlier.drop("last").join(ahead.select(*key).distinct(), key, "left_semi")
    folded = fold(before, ahead).join(ahead.groupBy(*key).agg(last), key)
    again = history().join(behind, key, "left_semi")
    refolded = fold(nothing, again).join(again.groupBy(*key).agg(last), key)
    changed = folded.unionByName(refolded)
    return earlier.join(ends.select(*key), key, "left_anti").unionByName(changed)


def _keep_state(stream: DataFrame, path: str, schema: str, key: list[str], order: list[str], fold: Fold) -> DataFrame:
    spark = stream.sparkSession

    def each(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/history/batch={batch_id}")
        rows = session.read.schema(batch.schema).parquet(f"{path}/history/batch={batch_id}")
        before = _newest(session, path, batch_id)
        earlier = None if before is None else session.read.parquet(f"{path}/version={before}")

        def history() -> DataFrame:
            return session.read.parquet(f"{path}/history").where(F.col("batch") <= batch_id).drop("batch")

        nothing = session.createDataFrame([], schema)
        _advance(earlier, nothing, rows, history, key, order, fold).write.mode("overwrite").parquet(f"{path}/version={batch_id}")
        for name in children(session, path):
            if name.startswith("version=") and int(name.removeprefix("version=")) < (batch_id if before is None else before):
                remove(session, f"{path}/{name}")

    run_batches(stream, path, each)
    newest = _newest(spark, path)
    if newest is None:
        return spark.createDataFrame([], schema)
    return spark.read.parquet(f"{path}/version={newest}").drop("last")


def streamed_ratings(rounds: DataFrame, order: list[str], path: str | None = None) -> DataFrame:
    """Runs over the rounds that no earlier run with this path has seen; returns the state."""
    return _keep_state(rounds, path or new_path(rounds.sparkSession, "ratings"), RATING_SCHEMA, ["agent"], order,
                       lambda old, new: next_ratings(old, new, order))


def streamed_weakness(outcomes: DataFrame, order: list[str], path: str | None = None) -> DataFrame:
    return _keep_state(outcomes, path or new_path(outcomes.sparkSession, "weakness"), WEAKNESS_SCHEMA, ["agent", "code"], order,
                       lambda old, new: next_weakness(old, new, order))
