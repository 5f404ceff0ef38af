"""A layout for point reads: some rows of a table by key, without reading the rest.

Rows lie in the order of their key's 64-bit hash: its first bits name the folder,
in a folder rows are sorted by hash and key, in row groups of ``block_rows`` rows.
A lookup names the folders (partition pruning: other files aren't even opened);
then row groups and pages are left out by their least and greatest hashes. Hashes
spread keys of any shape evenly, so a key is looked for in one row group; sorted
by key alone, keys of other folders would fall into the ranges of this one's.
Equal hashes of different keys do no harm: the key is compared as well.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from govaudit.streaming.files import children

#: Keys in one lookup: each is a predicate. For more, join (``packets.load_by_id``).
MOST_KEYS = 1000


HASH = "key_hash"


def _folder(key_hash: Column, bits: int) -> Column:
    return F.shiftrightunsigned(key_hash, 64 - bits).cast("int")


def write_for_lookup(df: DataFrame, path: str, key: str = "packet_id", bits: int = 6, block_rows: int = 4096) -> None:
    """Writes ``df`` in the layout, in up to 2**bits folders (bits from 1 to 20).

    Ranges of (hash, key, task that read the row) are dealt to tasks, so a key of
    very many rows, or rows without key, aren't one task's.
    """
    clash = {"bits", "folder", "_task", HASH} & set(df.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are taken")
    placed = (df.withColumn(HASH, F.xxhash64(key)).withColumn("_task", F.spark_partition_id())
              .withColumn("bits", F.lit(bits)).withColumn("folder", _folder(F.col(HASH), bits)))
    (placed.repartitionByRange(HASH, key, "_task").sortWithinPartitions("folder", HASH, key).drop("_task").write
     .option("parquet.block.row.count.limit", str(block_rows))
     .option("parquet.page.row.count.limit", str(max(1, block_rows // 4)))
     .partitionBy("bits", "folder").parquet(path))


def _any(conditions: list[Column]) -> Column:
    """Their disjunction, as a balanced tree; a long IN list would reach the scan as one range only."""
    while len(conditions) > 1:
        conditions = [reduce(lambda a, b: a | b, conditions[k: k + 2]) for k in range(0, len(conditions), 2)]
    return conditions[0]


def look_up(spark: SparkSession, path: str, schema: StructType, keys: list, key: str = "packet_id") -> DataFrame:
    """The rows with these keys; keys that don't exist, and null, give none. All rows of a repeated key come."""
    wanted = sorted({k for k in keys if k is not None})
    if len(wanted) > MOST_KEYS:
        raise ValueError(f"{len(wanted)} keys in one lookup, {MOST_KEYS} at most; join for more")
    layouts = [int(x.removeprefix("bits=")) for x in children(spark, path) if x.startswith("bits=")]
    if not wanted or not layouts:
        return spark.createDataFrame([], schema)
    values = [F.lit(k).cast(schema[key].dataType) for k in wanted]
    rows = (spark.read.schema(StructType([*schema.fields, StructField(HASH, LongType())])).option("basePath", path)
            .parquet(f"{path}/bits={layouts[0]}"))
    folders = _any([F.col("folder") == _folder(F.xxhash64(v), layouts[0]) for v in values])
    same = _any([(F.col(HASH) == F.xxhash64(v)) & (F.col(key) == v) for v in values])
    return rows.where(folders).where(same).drop("bits", "folder", HASH)
