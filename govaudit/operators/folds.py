"""Ordered folds that never put one long group into one task.

A rating or a miss rate depends on the order of an agent's whole history, and
one agent may own a third of all rows.  The history is therefore cut into
pieces of at most ``PIECE`` consecutive rows of one group:

* rows are range-partitioned and sorted by (group, order), so a long group
  spreads over as many tasks as it needs;
* consecutive rows of a task form pieces; a piece is one row with an array of
  bounded length;
* pieces are summarised, and summaries of 1024 pieces are combined again, so
  that even 10**11 rows of one group end as about 10**5 small rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIECE_BITS = 10
PIECE = 1 << PIECE_BITS


def ordered_pieces(df: DataFrame, group: list[str], order: list[str], value: Column,
                   bits: int = PIECE_BITS) -> DataFrame:
    """(group..., piece, n, items): ``items`` holds up to 2**bits ordered values.

    ``order`` must be total within a group.  ``piece`` grows with the order and
    is comparable across tasks; it is unique per group, not dense.
    """
    keys = [F.col(c) for c in [*group, *order]]
    rows = (df.select(*[F.col(c) for c in dict.fromkeys([*group, *order])], value.alias("_item"))
            .repartitionByRange(*keys).sortWithinPartitions(*keys)
            .withColumn("_row", F.monotonically_increasing_id()))
    pieces = rows.groupBy(*group, F.shiftright("_row", bits).alias("piece")).agg(
        F.array_sort(F.collect_list(F.struct("_row", "_item"))).alias("_items"))
    return pieces.select(*group, "piece", F.size("_items").alias("n"),
                         F.transform("_items", lambda r: r.getField("_item")).alias("items"))


def running_offsets(pieces: DataFrame, group: list[str], counts: dict[str, Column],
                    bits: int = PIECE_BITS) -> DataFrame:
    """Adds, per piece, what the group counted before it.

    Two levels: windows see at most 2**bits pieces of one block, or one row per
    block, never all pieces of a long group at once.
    """
    counted = pieces.select("*", *[c.alias(f"_{n}") for n, c in counts.items()],
                            F.shiftright("piece", bits).alias("_block"))
    blocks = counted.groupBy(*group, "_block").agg(*[F.sum(f"_{n}").alias(f"_sum_{n}") for n in counts])
    before_block = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*group, "_block", *[
        F.coalesce(F.sum(f"_sum_{n}").over(before_block), F.lit(0)).alias(f"_base_{n}") for n in counts])
    inside = Window.partitionBy(*group, "_block").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = [(F.col(f"_base_{n}") + F.coalesce(F.sum(f"_{n}").over(inside), F.lit(0))).alias(f"{n}_before") for n in counts]
    return (counted.join(blocks, [*group, "_block"])
            .select(*pieces.columns, *offsets))


# --- folds of monotone integer steps -----------------------------------------

class MonotoneFold:
    """A fold ``state' = step(state, item)`` over integer states low..high.

    ``step`` must not decrease with the state and must keep it in the range;
    ``back(bound, item)`` is the smallest state whose successor reaches
    ``bound``.  Then a whole piece acts as a staircase: its value at the lowest
    state plus the number of ``cuts`` the incoming state reaches.  Cuts come
    from walking the bounds backwards, so pieces are summarised independently
    and combined exactly, whatever came before them.
    """

    SHORT = 32  # pieces below this length keep their items instead

    def __init__(self, step: Callable[[Column, Column], Column], back: Callable[[Column, Column], Column],
                 low: int, high: int, start: int) -> None:
        self.step, self.back = step, back
        self.low, self.high, self.start = low, high, start

    def _whole(self, value: int | Column) -> Column:
        return (F.lit(value) if isinstance(value, int) else value).cast("bigint")

    def _forward(self, items: Column, state: int | Column) -> Column:
        return F.aggregate(items, self._whole(state), lambda s, x: self._whole(self.step(s, x)))

    def _backward(self, items: Column, bound: Column) -> Column:
        def one(b: Column, x: Column) -> Column:
            return self._whole(F.greatest(F.lit(self.low), F.least(F.lit(self.high + 1), self.back(b, x))))
        return F.aggregate(F.reverse(items), self._whole(bound), one)

    def _through(self, summary: Column, state: Column) -> Column:
        stairs = summary.getField("base") + F.size(F.filter(summary.getField("cuts"), lambda c: state >= c))
        return F.when(summary.getField("items").isNotNull(), self._forward(summary.getField("items"), state)
                      ).otherwise(self._whole(stairs))

    def _back_through(self, summary: Column, bound: Column) -> Column:
        index = bound - summary.getField("base")
        cut = (F.when(index <= 0, F.lit(self.low)).when(index > F.size(summary.getField("cuts")), F.lit(self.high + 1))
               .otherwise(F.try_element_at(summary.getField("cuts"), index.cast("int"))))
        return F.when(summary.getField("items").isNotNull(), self._backward(summary.getField("items"), bound)
                      ).otherwise(self._whole(cut))

    def _staircase(self, base: Column, top: Column, cut: Callable[[Column], Column]) -> Column:
        return F.when(top > base, F.transform(F.sequence(base + 1, top), cut)).otherwise(
            F.array().cast("array<bigint>"))

    def summaries(self, pieces: DataFrame, group: list[str]) -> DataFrame:
        """(group..., piece, n, items | base + cuts) per piece."""
        long = F.col("n") >= self.SHORT
        # ``_all``: an output alias named like an input column would be taken
        # for it inside the lambdas.
        ends = pieces.select(
            *group, "piece", "n", F.col("items").alias("_all"),
            F.when(long, self._forward(F.col("items"), self.low)).alias("base"),
            F.when(long, self._forward(F.col("items"), self.high)).alias("_top"))
        cuts = F.when(long, self._staircase(
            F.col("base"), F.col("_top"), lambda b: self._backward(F.col("_all"), b)))
        return ends.select(*group, "piece", F.col("n").cast("bigint").alias("n"),
                           F.when(~long, F.col("_all")).alias("items"), "base", cuts.alias("cuts"))

    def combined(self, summaries: DataFrame, group: list[str], bits: int = PIECE_BITS) -> DataFrame:
        """One summary per 2**bits neighbouring summaries of a group."""
        blocks = summaries.groupBy(*group, F.shiftright("piece", bits).alias("block")).agg(
            F.sum("n").alias("n"),
            F.array_sort(F.collect_list(F.struct("piece", F.struct("items", "base", "cuts").alias("s")))).alias("_p"))
        parts = F.transform("_p", lambda p: p.getField("s"))
        walk = lambda state: F.aggregate(
            F.col("_parts"), self._whole(state), lambda s, p: self._through(p, s))
        long = F.col("n") >= self.SHORT
        ends = (blocks.withColumn("_parts", parts)
                .withColumn("base", F.when(long, walk(self.low)))
                .withColumn("_top", F.when(long, walk(self.high))))
        cuts = F.when(long, self._staircase(
            F.col("base"), F.col("_top"),
            lambda b: F.aggregate(F.reverse(F.col("_parts")), self._whole(b), lambda t, p: self._back_through(p, t))))
        items = F.when(~long, F.flatten(F.transform("_parts", lambda p: p.getField("items"))))
        return ends.select(*group, F.col("block").alias("piece"), "n", items.alias("items"), "base", cuts.alias("cuts"))

    def applied(self, summary: Column) -> Column:
        """The state after what ``summary`` (a struct of items, base and cuts) stands for, from ``start``."""
        return self._through(summary, self._whole(self.start))

    def final_states(self, pieces: DataFrame, group: list[str], starts: DataFrame | None = None,
                     bits: int = PIECE_BITS) -> DataFrame:
        """(group..., state) after the ordered history of each group.

        ``starts`` (group..., state) continues from earlier states; groups
        without one begin at ``start``.
        """
        blocks = self.combined(self.summaries(pieces, group), group, bits)
        whole = blocks.groupBy(*group).agg(F.array_sort(F.collect_list(
            F.struct("piece", F.struct("items", "base", "cuts").alias("s")))).alias("_b"))
        begin = self._whole(self.start)
        if starts is not None:
            whole = whole.join(starts.select(*group, F.col("state").alias("_from")), group, "left")
            begin = F.coalesce(self._whole(F.col("_from")), begin)
        return whole.select(*group, F.aggregate(
            F.transform("_b", lambda b: b.getField("s")), begin, lambda s, p: self._through(p, s)).alias("state"))
