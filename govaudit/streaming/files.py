"""Reading tables as streams and running a stream over what is there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from govaudit.session import new_path


def _file_system(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def exists(spark: SparkSession, path: str) -> bool:
    system, hadoop_path = _file_system(spark, path)
    return system.exists(hadoop_path)


def committed(spark: SparkSession, path: str) -> bool:
    """Whether a Parquet table was written there to its end."""
    return exists(spark, path + "/_SUCCESS")


def children(spark: SparkSession, path: str) -> list[str]:
    """Names below a folder; none where there is no folder."""
    system, hadoop_path = _file_system(spark, path)
    return sorted(x.getPath().getName() for x in system.listStatus(hadoop_path)) if system.exists(hadoop_path) else []


def remove(spark: SparkSession, path: str) -> None:
    system, hadoop_path = _file_system(spark, path)
    system.delete(hadoop_path, True)


def stream_table(spark: SparkSession, folder: str, pattern: str, files_per_batch: int = 1) -> DataFrame:
    """A table of a folder as a stream: either a folder of part files of that name, or
    the folder's files that match; ``files_per_batch`` bounds a batch."""
    system, hadoop_path = _file_system(spark, f"{folder}/{pattern}")
    if "*" not in pattern and system.exists(hadoop_path) and system.getFileStatus(hadoop_path).isDirectory():
        folder, pattern = f"{folder}/{pattern}", "*.parquet"
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    return (spark.readStream.schema(schema).option("pathGlobFilter", pattern)
            .option("maxFilesPerTrigger", files_per_batch).parquet(folder))


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs the stream over the data that is there into a Parquet table."""
    spark = stream.sparkSession
    out = new_path(spark, name)
    (stream.writeStream.format("parquet").outputMode(mode).trigger(availableNow=True)
     .option("checkpointLocation", out + "-progress").start(out).awaitTermination())
    return spark.read.schema(stream.schema).parquet(out)


def run_batches(stream: DataFrame, path: str, each: Callable[[DataFrame, int], None]) -> None:
    """Calls ``each`` per micro-batch over the data that is there and hasn't been seen by an
    earlier run with this path."""
    (stream.writeStream.foreachBatch(each).trigger(availableNow=True)
     .option("checkpointLocation", path + "/progress").start().awaitTermination())
