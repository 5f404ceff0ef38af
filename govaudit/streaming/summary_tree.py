"""Miss rates from a stored tree of summaries: a late row costs one leaf and its ancestors.

A history that depends on its order is cut into leaves by a number that each
row has of itself (say, the month). A leaf's rows are summarised by an exact
staircase (``MonotoneFold``), 2**bits neighbouring summaries by another one, and
so on up to a root per group, from which the state follows. A batch reads and
rewrites the leaves that it has rows for, then on each level the folder with
their parents' children. What that reads depends on the batch and on the
tree's depth, not on how long the history is; in which order rows come doesn't
matter.

Below the named path, ``rows/node=LEAF/bucket=B/version=N`` holds a leaf's rows
for a hash bucket of groups after batch N, and ``level=L/node=PARENT/bucket=B/
version=N`` the summaries of a parent's children. Only the touched folders are
listed. Batch N reads versions before N and writes its own anew, so a repeated
batch changes nothing, and one that was cut off leaves nothing that is read.
The version that a batch read is kept until the next one is there.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from govaudit.operators import weakness
from govaudit.operators.folds import MonotoneFold, ordered_pieces
from govaudit.session import new_path, written
from govaudit.streaming.files import _file_system, children, remove, run_batches

SUMMARY = "n BIGINT, hits BIGINT, items ARRAY<INT>, base BIGINT, cuts ARRAY<BIGINT>"


class SummaryTree:
    """Summaries of ordered histories of 0/1 values, per group.

    rows: the schema (DDL) of what is kept of a row: group, order and value
    columns. Leaf numbers lie between 0 and 2**(bits * levels) - 1 and must not
    fall as the order rises.
    """

    def __init__(self, spark: SparkSession, path: str, fold: MonotoneFold, rows: str, group: list[str], order: list[str], value: str,
                 bits: int = 6, levels: int = 2, buckets: int = 4) -> None:
        self.spark, self.path, self.fold = spark, path, fold
        self.rows, self.group, self.order, self.value = StructType.fromDDL(rows), group, order, value
        self.bits, self.levels, self.buckets = bits, levels, buckets
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in self.rows if f.name in group)
        self.summaries = StructType.fromDDL(f"{kinds}, piece BIGINT, {SUMMARY}")
        self.read_bytes = 0  # of the last batch

    def _versions(self, folder: str, batch: int | None) -> Iterator[int]:
        for name in children(self.spark, folder):
            if name.startswith("version=") and (batch is None or int(name.removeprefix("version=")) < batch):
                yield int(name.removeprefix("version="))

    def _read(self, part: str, folders: list[tuple[int, int]], schema: StructType, batch: int | None) -> DataFrame:
        """The newest rows before a batch in some folders (node, bucket) of a part."""
        paths = []
        for node, bucket in folders:
            folder = f"{self.path}/{part}/node={node}/bucket={bucket}"
            newest = max(self._versions(folder, batch), default=None)
            if newest is not None:
                paths.append(f"{folder}/version={newest}")
                system, hadoop_path = _file_system(self.spark, paths[-1])
                self.read_bytes += system.getContentSummary(hadoop_path).getLength()
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write(self, part: str, df: DataFrame, folders: list[tuple[int, int]], batch: int) -> None:
        """Writes a batch's version of some folders; ``df`` has node and bucket. Of the earlier ones the newest stays."""
        for node, bucket in folders:
            folder = f"{self.path}/{part}/node={node}/bucket={bucket}"
            remove(self.spark, f"{folder}/version={batch}")
            for old in sorted(self._versions(folder, batch))[:-1]:
                remove(self.spark, f"{folder}/version={old}")
        # a folder's rows meet in a task, or in several where they are many
        (df.withColumn("version", F.lit(batch)).hint("rebalance", "node", "bucket")
         .write.mode("append").partitionBy("node", "bucket", "version").parquet(f"{self.path}/{part}"))

    def _written(self, part: str, folders: list[tuple[int, int]], schema: StructType, batch: int) -> DataFrame:
        """What a batch has written to some folders."""
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{part}/node={node}/bucket={bucket}/version={batch}" for node, bucket in folders])

    def _bucket(self) -> Column:
        return F.pmod(F.hash(*self.group), F.lit(self.buckets))

    def _folders(self, df: DataFrame) -> list[tuple[int, int]]:
        """The folders that a batch touches: at most its leaves times the buckets."""
        return [(r.node, r.bucket) for r in df.select("node", "bucket").distinct().collect()]

    def _leaves(self, rows: DataFrame) -> DataFrame:
        """A summary per group and leaf (``node``)."""
        key = [*self.group, "node"]
        parts = self.fold.summaries(ordered_pieces(rows, key, self.order, F.col(self.value)), key)
        one = self.fold.combined(self.fold.combined(parts, key), key, bits=62)
        hits = rows.groupBy(*key).agg(F.sum(self.value).cast("bigint").alias("hits"))
        return one.drop("piece").join(hits, key).withColumnRenamed("node", "piece")

    def _parents(self, summaries: DataFrame) -> DataFrame:
        """From children to their parents."""
        hits = summaries.groupBy(*self.group, F.shiftright("piece", self.bits).alias("piece")).agg(F.sum("hits").alias("hits"))
        return self.fold.combined(summaries, self.group, self.bits).join(hits, [*self.group, "piece"])

    def add(self, rows: DataFrame, leaf: Column, batch: int) -> None:
        """Adds a batch's rows, in any order. They are read three times, twice only their groups and leaves."""
        self.read_bytes = 0
        names = self.rows.names
        top = (1 << self.bits * self.levels) - 1
        placed = rows.select(*names, F.greatest(F.lit(0), F.least(F.lit(top), leaf.cast("bigint"))).alias("leaf"))
        folders = self._folders(placed.withColumn("node", F.col("leaf")).withColumn("bucket", self._bucket()))
        if not folders:
            return
        # the leaves' rows with those of the batch; other groups of a bucket go along
        numbered = StructType.fromDDL(", ".join(f"{f.name} {f.dataType.simpleString()}" for f in self.rows) + ", leaf BIGINT")
        before = self._read("rows", folders, numbered, batch)
        every = before.unionByName(placed).select(numbered.names)
        self._write("rows", every.withColumn("node", F.col("leaf")).withColumn("bucket", self._bucket()), folders, batch)
        every = self._written("rows", folders, numbered, batch).withColumnRenamed("leaf", "node")
        if self.read_bytes:  # else the folders hold the batch's rows alone
            touched = placed.select(*self.group, F.col("leaf").alias("node")).distinct()
            every = every.join(touched, [*self.group, "node"], "left_semi")
        fresh = written(self._leaves(every).select(self.summaries.names), "leaves")
        for level in range(self.levels + 1):
            part = f"level={level}"
            folders = self._folders(fresh.withColumn("node", F.shiftright("piece", self.bits)).withColumn("bucket", self._bucket()))
            held = self._read(part, folders, self.summaries, batch)
            now = held.join(fresh.select(*self.group, "piece"), [*self.group, "piece"], "left_anti").select(self.summaries.names).unionByName(fresh)
            self._write(part, now.withColumn("node", F.shiftright("piece", self.bits)).withColumn("bucket", self._bucket()), folders, batch)
            if level < self.levels:
                changed = self._written(part, folders, self.summaries, batch).withColumn("_up", F.shiftright("piece", self.bits)).join(
                    fresh.select(*self.group, F.shiftright("piece", self.bits).alias("_up")).distinct(), [*self.group, "_up"], "left_semi").drop("_up")
                fresh = written(self._parents(changed).select(self.summaries.names), "parents")

    def state(self) -> DataFrame:
        """group..., n, hits, state: from the roots alone."""
        roots = self._read(f"level={self.levels}", [(0, b) for b in range(self.buckets)], self.summaries, None)
        return roots.select(*self.group, "n", "hits", self.fold.applied(F.struct("items", "base", "cuts")).alias("state"))


def streamed_weakness(outcomes: DataFrame, rows: str, order: list[str], leaf: Column, path: str | None = None) -> DataFrame:
    """agent, code, total, missed, rate after the outcomes that no earlier run with this path has seen.

    rows: DDL of agent, code, the order columns and missed (INT). leaf: a number that rises with the order.
    """
    spark = outcomes.sparkSession
    path = path or new_path(spark, "weakness-tree")

    def tree(session: SparkSession) -> SummaryTree:
        return SummaryTree(session, path, weakness.MISS_RATE, rows, ["agent", "code"], order, "missed")

    run_batches(outcomes, path, lambda batch, number: tree(batch.sparkSession).add(batch, leaf, number))
    return tree(spark).state().select("agent", "code", F.col("n").alias("total"), F.col("hits").alias("missed"), F.col("state").alias("rate"))
