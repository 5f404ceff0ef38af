"""State tables: histories, memory, miss rates, audit results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from govaudit import catalog as cat
from govaudit.operators.rating import latest


def save_history(history: DataFrame, path: str, order: list[str], keep: int) -> None:
    """Keeps the last ``keep`` rows per agent (50 ratings, 20 rounds)."""
    latest(history, order, keep).write.mode("overwrite").parquet(path)


def load_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table, or an empty one of that schema where nothing was saved yet."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)
    return spark.read.schema(schema).parquet(path) if exists else spark.createDataFrame([], schema)


def append_memory(memory: DataFrame, path: str) -> None:
    """Appends reviews with the time they were remembered."""
    memory.withColumn("remembered_at", F.current_timestamp()).write.mode("append").parquet(path)


def save_audits(audits: DataFrame, path: str, by: str = "sector") -> None:
    """Audit results as JSON lines, one folder per sector."""
    audits.write.mode("overwrite").partitionBy(by).json(path)


def default_weakness(spark: SparkSession) -> DataFrame:
    """Cold start: every code at 0 seen, 0 missed, rate 0.5."""
    rows = [(c, 0, 0, cat.MISS_START) for c in cat.CODES]
    return spark.createDataFrame(rows, "code STRING, total BIGINT, missed BIGINT, rate BIGINT")
