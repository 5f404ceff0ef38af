"""Line deduplication with levelled sorted runs of line hashes.

A store of runs counts in how many documents a line was found. A run is a table
(hash, n) in hash buckets, sorted by hash. A new batch of documents is merged
against the runs: lines that a run already knows in enough documents are settled
and leave by an anti-join; the others are counted and become a run of level 0.
When a level has ``fan`` runs, they are compacted into one of the next level, so
a hash is rewritten once per level. A line's total is the sum over the runs, and
a settled line has enough in one of them, so the answer doesn't depend on how
the documents are dealt to batches, as long as a document is in one batch only.

A line is known by its key, without white space (space, 9 to 13) at both ends
and with A-Z in lower case, and the key by 128 bits of its SHA-256. Empty keys
are never counted nor dropped.

Nothing is gathered but the places of one text's dropped lines. A line that a
third of the documents hold is counted before it is shuffled; the join of lines
to the common ones is split by the skew join. A text is split within its row,
which takes a few times the text's size.

A null or empty text is one empty line, which stays. Rows of the same doc_id are
one document in the counts, and so are all rows without doc_id; each row gets
its own result, equal for equal rows. Other columns are ignored. An empty table
gives an empty table.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from govaudit.llm.common import stored
from govaudit.session import new_path

WHITE = " \t\n\x0b\x0c\r"


def digest(text: Column) -> Column:
    """128 bits of the SHA-256."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(WHITE)), string.ascii_uppercase, string.ascii_lowercase)


def text_lines(text: str = "text") -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def line_hashes(docs: DataFrame, batches: int) -> DataFrame:
    """doc_id, mark (the text's digest), hashes (one per line, null for an empty key), batch; all of a doc_id in one batch."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), digest(F.coalesce("text", F.lit(""))).alias("mark"),
        F.transform(F.transform(text_lines(), line_key), lambda key: F.when(key != "", digest(key))).alias("hashes"),
        F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(batches)).cast("int").alias("batch"))


class LineRuns:
    """In how many documents each line was found, in levelled sorted runs.

    fan: runs of a level that are compacted into one. least: documents from which
    on a line counts as common. buckets: of a run; each is merged in one task, so
    give as many as the shuffles of the session have (the default).
    """

    def __init__(self, spark: SparkSession, least: int = 10, fan: int = 3, buckets: int | None = None):
        self.spark, self.least, self.fan = spark, least, fan
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, lines: DataFrame) -> None:
        """Merges a batch (doc_id, hash; a row for each line) with the runs. Documents of earlier batches must not be in it."""
        counted = (lines.where("hash IS NOT NULL").distinct().groupBy("hash").agg(F.count("*").alias("part"))
                   .repartition(self.buckets, "hash").groupBy("hash").agg(F.sum("part").alias("n")))
        for run in self.runs():
            counted = counted.join(run.where(F.col("n") >= self.least).select("hash"), "hash", "left_anti")
        self._put(0, counted)

    def _put(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(self._written(run))
        if len(self.levels[level]) == self.fan:
            merged = self._sums(self.levels[level])
            self.levels[level] = []
            self._put(level + 1, merged)

    def _written(self, run: DataFrame) -> DataFrame:
        """The run as a table in sorted buckets below the shared folder; its catalog entry goes at once, its files stay."""
        path = new_path(self.spark, "line-run")
        entry = path.rsplit("/", 1)[1].replace("-", "_")
        run.select("hash", "n").write.format("parquet").bucketBy(self.buckets, "hash").sortBy("hash").option("path", path).saveAsTable(entry)
        back = self.spark.table(entry)
        self.spark.sql(f"DROP TABLE {entry}")
        return back

    def _sums(self, runs: list[DataFrame]) -> DataFrame:
        every = runs[0]
        for run in runs[1:]:
            every = every.unionByName(run)
        return every.repartition(self.buckets, "hash").groupBy("hash").agg(F.sum("n").alias("n"))

    def common(self) -> DataFrame:
        """hash of the lines found in enough documents, each once."""
        if not self.runs():
            return self.spark.createDataFrame([], "hash binary")
        return self._sums(self.runs()).where(F.col("n") >= self.least).select("hash")


def without_common_lines(docs: DataFrame, least: int = 10, batches: int = 6, fan: int = 3) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept (the lines that stay, joined by newlines) for each row of ``docs`` (doc_id, text). Starts jobs.

    The documents are dealt to ``batches`` by id, as if they came one batch after
    the other; their lines are hashed once.
    """
    spark = docs.sparkSession
    lines = stored(line_hashes(docs, batches), "line-hashes", partition_by="batch")
    runs = LineRuns(spark, least, fan)
    for batch in range(batches):
        runs.add(lines.where(F.col("batch") == batch).select("doc_id", F.explode("hashes").alias("hash")))
    places = lines.select("doc_id", "mark", F.posexplode("hashes").alias("place", "hash")).where("hash IS NOT NULL")
    gone = (places.join(runs.common(), "hash", "left_semi").groupBy("doc_id", "mark").agg(F.collect_set("place").alias("gone"))
            .select(F.col("doc_id").alias("its_id"), F.col("mark").alias("its_mark"), "gone"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("mark", digest(F.coalesce("text", F.lit(""))))
    joined = texts.join(gone, F.expr("doc_id <=> its_id AND mark = its_mark"), "left")
    split = joined.select("doc_id", text_lines().alias("lines"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    return split.select(
        "doc_id", F.size("lines").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_dropped"),
        F.expr("array_join(transform(array_except(sequence(0, size(lines) - 1), gone), i -> lines[i]), '\n')").alias("kept"))
