"""Ratings of agents over their ordered rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from govaudit import catalog as cat
from govaudit.operators.folds import PIECE_BITS, ordered_pieces
from govaudit.session import cut_lineage

R = cat.RATING
#: No rating climbs past this: from here on a double no longer tells the expectation from 1, so a win gains nothing.
CEILING = 8000.0


def task_for(rating: Column) -> Column:
    """Task slightly above the rating: 1 easy, 2 medium, 3 hard."""
    target = rating + R["stretch"]
    return F.when(target < R["easy_max"], 1).when(target < R["medium_max"], 2).otherwise(3)


def rating_gain(rating: Column, won: Column) -> Column:
    """K times (result minus expectation against the task's opponent)."""
    easy, medium, hard = R["opponents"]
    task = task_for(rating)
    opponent = F.when(task == 1, easy).when(task == 2, medium).otherwise(hard)
    expected = 1 / (1 + F.pow(F.lit(10.0), (opponent - rating) / 400))
    return R["k"] * (F.when(won, 1.0).otherwise(0.0) - expected)


def next_rating(rating: Column, won: Column) -> Column:
    return F.greatest(F.lit(R["floor"]), rating + rating_gain(rating, won))


def rating_band(rating: Column) -> Column:
    return cat.band(rating, cat.RATING_BANDS, cat.RATING_LOW)


def won(overall: Column) -> Column:
    return overall >= R["win"]


def _after(wins: Column, rating: Column) -> Column:
    return F.aggregate(wins, rating, lambda r, x: next_rating(r, x))


def _piece_starts(agents: DataFrame) -> DataFrame:
    """From rows with ordered ``parts`` and a ``start`` to one row per piece
    with the rating before and after it."""
    marks = F.aggregate(
        F.col("parts"), F.array("start"),
        lambda acc, p: F.concat(acc, F.array(_after(p.getField("wins"), F.element_at(acc, -1)))))
    return (agents.withColumn("marks", marks)
            .select("agent", F.posexplode("parts").alias("i", "part"), "marks")
            .select("agent", "part.piece", "part.n",
                    F.element_at("marks", F.col("i") + 1).alias("start"),
                    F.element_at("marks", F.col("i") + 2).alias("end")))


def _from_state(df: DataFrame, earlier: DataFrame | None) -> DataFrame:
    """Adds ``start``: the agent's earlier rating, or the common one."""
    if earlier is None:
        return df.withColumn("start", F.lit(R["start"]))
    return (df.join(earlier.select("agent", F.col("rating").alias("_rating")), "agent", "left")
            .withColumn("start", F.coalesce("_rating", F.lit(R["start"]))).drop("_rating"))


def _runs(blocks: DataFrame) -> DataFrame:
    """(agent, run, parts, start): rows to fold whose start is known.

    A step never lowers the higher of two ratings below the lower one: the
    expectation rises by less than a rating does, and a harder task lowers it.
    So what a block makes of any start lies between what it makes of the floor
    and of ``CEILING``. Where both ends are one number the block's end doesn't
    depend on its start. Blocks between two such ends, the last one included,
    form a run, which is folded in one row from the first end. A block of 2**20
    rounds couples unless hardly a round of it is lost or won.
    """
    spans = blocks.groupBy("agent").agg(F.min("block").alias("first"), F.count(F.lit(1)).alias("n_blocks"))
    placed = blocks.join(spans, "agent")

    def end(start: Column) -> Column:
        # the end of an agent's only block is asked by nobody
        return F.when(F.col("n_blocks") > 1, F.aggregate("parts", start, lambda r, p: _after(p.getField("wins"), r)))

    opening = F.col("block") == F.col("first")
    ends = placed.select(
        "agent", "block", "start",
        end(F.when(opening, F.col("start")).otherwise(F.lit(R["floor"]))).alias("low"),
        end(F.when(opening, F.col("start")).otherwise(F.greatest("start", F.lit(CEILING)))).alias("high"))
    # numbers alone go through the window by agent, never the blocks' rounds
    coupled = F.col("low") == F.col("high")
    before = Window.partitionBy("agent").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    known = F.last(F.when(coupled, F.struct("block", F.col("low").alias("end"))), ignorenulls=True).over(before)
    runs = (ends.withColumn("known", known)
            .select("agent", "block", F.col("known.block").alias("run"), F.coalesce("known.end", "start").alias("start")))
    return (blocks.drop("start").join(runs, ["agent", "block"])
            .groupBy("agent", "run", "start").agg(F.flatten(F.transform(
                F.array_sort(F.collect_list(F.struct("block", "parts"))), lambda b: b.getField("parts"))).alias("parts")))


def round_pieces(rounds: DataFrame, order: list[str], bits: int = PIECE_BITS) -> DataFrame:
    """Checkpointed history pieces; items hold the order columns and ``won``."""
    item = F.struct(*[F.col(c) for c in order], won(F.col("overall")).alias("won"))
    return cut_lineage(ordered_pieces(rounds, ["agent"], order, item, bits))


def piece_ratings(pieces: DataFrame, earlier: DataFrame | None = None, bits: int = PIECE_BITS) -> DataFrame:
    """(agent, piece, n, start, end): exact rating around every piece.

    ``earlier`` (agent, rating) is where the fold goes on from.

    Histories are folded in blocks of 2**bits pieces, one boolean per round; how
    a block gets its start is said in ``_runs``. No jobs, no passes.
    """
    part = F.struct("piece", "n", F.transform("items", lambda x: x.getField("won")).alias("wins"))
    blocks = (pieces.select("agent", F.shiftright("piece", bits).alias("block"), part.alias("part"))
              .groupBy("agent", "block").agg(F.array_sort(F.collect_list("part")).alias("parts")))
    return _piece_starts(_runs(_from_state(blocks, earlier)))


def rating_state(ratings: DataFrame) -> DataFrame:
    """Rating, band and next task per agent, from ``piece_ratings``."""
    last = ratings.groupBy("agent").agg(F.max_by("end", "piece").alias("rating"), F.sum("n").alias("n_rounds"))
    return last.select("agent", "rating", "n_rounds", rating_band(F.col("rating")).alias("band"),
                       task_for(F.col("rating")).alias("recommended_task"))


def rating_history(pieces: DataFrame, ratings: DataFrame) -> DataFrame:
    """One row per round: ratings before and after, task, result.

    ``elo_before`` is the value after the floor minus the gain, which differs
    from the true rating before (``rating``) when the floor was hit.
    """
    before = F.aggregate(
        F.col("items"), F.array("start"),
        lambda acc, x: F.concat(acc, F.array(next_rating(F.element_at(acc, -1), x.getField("won")))))
    started = pieces.join(ratings.select("agent", "piece", "start"), ["agent", "piece"])
    rows = (started.withColumn("before", before)
            .select("agent", "piece", F.posexplode("items").alias("pos", "item"), "before")
            .select("agent", "item.*", F.element_at("before", F.col("pos") + 1).alias("rating"),
                    F.element_at("before", F.col("pos") + 2).alias("elo_after")))
    return (rows.withColumn("elo_before", F.col("elo_after") - rating_gain(F.col("rating"), F.col("won")))
            .withColumn("task_id", task_for(F.col("rating"))))


def latest_pieces(pieces: DataFrame, keep: int) -> DataFrame:
    """Of each agent's pieces (agent, piece, n, ...) the newest that hold its last ``keep`` rows.

    A piece has a row at least, so ``keep`` pieces per agent suffice; Spark applies
    that limit before the shuffle as well.
    """
    newest = Window.partitionBy("agent").orderBy(F.desc("piece"))
    newer = F.coalesce(F.sum("n").over(newest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (pieces.withColumn("_age", F.row_number().over(newest)).filter(F.col("_age") <= keep)
            .withColumn("_newer", newer).filter(F.col("_newer") < keep).drop("_age", "_newer"))


def latest(history: DataFrame, order: list[str], keep: int = cat.HISTORY_KEPT, by: str = "agent") -> DataFrame:
    """The last ``keep`` rows per agent.  Limited before the shuffle as well, so
    a hot agent sends at most ``keep`` rows per task."""
    newest = Window.partitionBy(by).orderBy(*[F.desc(c) for c in order])
    return history.withColumn("_age", F.row_number().over(newest)).filter(F.col("_age") <= keep).drop("_age")
