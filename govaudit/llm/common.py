"""Reading texts as Arrow buffers, hashing stretches of bytes, shared helpers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

from govaudit.session import new_path, ship_package

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
#: A fixed random 64-bit value for each byte.
BYTE_CODES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
#: Upper-case ASCII to lower case; all else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The white space of the word contracts: space and 9 to 13.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; the package goes to the workers on the way."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """``df`` written as Parquet below the shared folder and read back: lineage ends here."""
    path = new_path(df.sparkSession, name)
    writer = df.write
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_in_buckets(df: DataFrame, name: str, column: str, buckets: int) -> DataFrame:
    """``df`` written below the shared folder in hash buckets of a column, and read back: a join or a grouping
    by that column with as many partitions reads it where it is. The files stay, the catalog entry doesn't."""
    spark = df.sparkSession
    path = new_path(spark, name)
    entry = path.rsplit("/", 1)[1].replace("-", "_")
    df.write.format("parquet").bucketBy(buckets, column).option("path", path).saveAsTable(entry)
    back = spark.table(entry)
    spark.sql(f"DROP TABLE {entry}")
    return back


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, and n + 1 offsets; a null is an empty text."""
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    if column.null_count:
        column = pc.fill_null(column, b"" if kind == pa.large_binary() else "")
    column = column.cast(kind).cast(pa.large_binary())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset: column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2] or b"", dtype=np.uint8)[offsets[0]: offsets[-1]] if len(offsets) and buffers[2] else np.zeros(0, np.uint8)
    return data, (offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64))


def slices(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Row ranges holding about ``size`` bytes each; a longer row stands alone."""
    begin, n = 0, len(offsets) - 1
    while begin < n:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + size, "right")) - 1)
        yield begin, end
        begin = end


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash's base and of its inverse, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 21)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finish that spreads every input bit."""
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """n + 1 running sums from which the hash of any stretch follows."""
    up, _ = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE_CODES[data] * up[: len(data)], out=sums[1:])
    return sums


def stretch_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes from each start to each end, equal for equal bytes wherever they stand."""
    _, down = powers(len(sums))
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


#: Bytes up to which the polynomial tells stretches apart; of longer ones, texts of a simple pattern (two
#: complementary Thue-Morse texts of 1,024 letters, say) agree modulo 2**64 whatever the base.
SHORT_STRETCH = 64


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes from each start to each end, by polynomial if short, else by XXH3."""
    hashes = stretch_hashes(prefix_sums(data), starts, ends)
    long = np.flatnonzero(ends - starts > SHORT_STRETCH)
    if len(long):
        raw = memoryview(np.ascontiguousarray(data))
        hashes[long] = [xxhash.xxh3_64_intdigest(raw[s:e]) for s, e in zip(starts[long].tolist(), ends[long].tolist())]
    return hashes


def spread(counts: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Positions starts[i] … starts[i] + counts[i] - 1 for all i, one after the other."""
    total = int(counts.sum())
    before = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, counts)
