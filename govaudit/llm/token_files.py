"""Token files: frequency-ranked ids in a byte-aligned variable-length code with separate control bytes.

A file is a Parquet table of blocks, so every store that Spark writes will do.
A block holds consecutive documents in ascending id order (null ids first,
repeated ids by text):

* ``table``: the block's ids by falling frequency (ties: smaller id first), as
  little-endian 32-bit integers. A token is stored as its place in this table.
* ``control``: two bits per token, four tokens a byte, lowest bits first: the
  number of data bytes less one.
* ``data``: the places, each in as many little-endian bytes as it needs.
* ``doc_ids``, ``lengths``: the documents and their numbers of tokens.
* ``shard``, ``start``: the part in doc_id order, and the tokens before the
  block in that part.

Blocks end after a document, at about ``BLOCK`` tokens. A null text is empty,
and an empty text has the end id alone. An empty table gives no blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from govaudit.llm.common import slices, spread, text_bytes
from govaudit.llm.subwords import subword_table
from govaudit.session import ship_package

#: Tokens after which a block is closed.
BLOCK = 1 << 20
BLOCKS = "shard long, start long, doc_ids array<long>, lengths array<long>, table binary, control binary, data binary"
DOCUMENTS = "doc_id long, shard long, start long, n_tokens long, ids binary"

#: For each control byte the data bytes of its four tokens.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1


def ranked(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The table of ids by falling frequency, and each token's place in it."""
    distinct, which, counts = np.unique(ids, return_inverse=True, return_counts=True)
    order = np.lexsort((distinct, -counts))
    places = np.empty(len(distinct), dtype=np.uint32)
    places[order] = np.arange(len(distinct), dtype=np.uint32)
    return distinct[order].astype("<u4"), places[which]


def put(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of 32-bit values."""
    values = np.asarray(values, dtype="<u4")
    sizes = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    codes = np.zeros(-(-len(values) // 4) * 4, dtype=np.uint8)
    codes[: len(values)] = sizes - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    kept = np.arange(4, dtype=np.uint8) < sizes[:, None]
    return control.astype(np.uint8).tobytes(), values.view(np.uint8).reshape(-1, 4)[kept].tobytes()


def get(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values that ``put`` was given."""
    sizes = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(sizes) - sizes
    raw = np.append(np.frombuffer(data, np.uint8), np.zeros(3, np.uint8))
    values = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        longer = sizes > k
        if longer.any():
            values[longer] |= raw[at[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return values


def _blocks(path: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, shard, start = subword_table(path), TaskContext.get().partitionId(), 0
        held: list[tuple[list, np.ndarray, np.ndarray]] = []

        def close() -> pa.RecordBatch:
            nonlocal start
            ids = np.concatenate([x[1] for x in held])
            names, places = ranked(ids)
            control, data = put(places)
            row = {"shard": [shard], "start": [start], "doc_ids": [[y for x in held for y in x[0]]],
                   "lengths": [np.concatenate([x[2] for x in held]).tolist()],
                   "table": [names.tobytes()], "control": [control], "data": [data]}
            start += len(ids)
            held.clear()
            return pa.RecordBatch.from_pydict(row, SCHEMA)

        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            names = batch.column(0).to_pylist()
            for a, b in slices(offsets, 2 * BLOCK):
                ids, bounds = tokens.encode(data[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a])
                lengths = np.diff(bounds) + 1
                whole = np.full(int(lengths.sum()), end_id, dtype=np.uint32)
                whole[spread(lengths - 1, np.cumsum(lengths) - lengths)] = ids
                held.append((names[a:b], whole, lengths))
                if sum(len(x[1]) for x in held) >= BLOCK:
                    yield close()
        if held:
            yield close()

    return write


SCHEMA = pa.schema([("shard", pa.int64()), ("start", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                    ("lengths", pa.list_(pa.int64())), ("table", pa.binary()), ("control", pa.binary()), ("data", pa.binary())])
READ = pa.schema([("doc_id", pa.int64()), ("shard", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def write_token_files(docs: DataFrame, to: str, tokenizer: str, end_id: int = 0) -> None:
    """Encodes every text of ``docs`` (doc_id, text) and writes token files to ``to``."""
    ship_package(docs.sparkSession)
    ordered = (docs.select(F.col("doc_id").cast("long"), F.col("text"))
               .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text"))
    ordered.mapInArrow(_blocks(tokenizer, end_id), BLOCKS).write.parquet(to)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            lengths = np.array(row["lengths"], dtype=np.int64)
            names = np.frombuffer(row["table"], "<u4")
            ids = names[get(row["control"], row["data"], int(lengths.sum()))].astype("<u4")
            ends = np.cumsum(lengths)
            starts = ends - lengths
            for a, b in slices(np.append(0, ends), BLOCK):
                offsets = np.append(starts[a:b], ends[b - 1]) - starts[a]
                packed = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer((offsets * 4).astype(np.int64)),
                                                                          pa.py_buffer(np.ascontiguousarray(ids[starts[a]: ends[b - 1]]))])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"][a:b], pa.int64()), pa.array([row["shard"]] * (b - a), pa.int64()),
                     pa.array(row["start"] + starts[a:b]), pa.array(lengths[a:b]), packed.cast(pa.binary())], schema=READ)


def read_token_files(spark, path: str) -> DataFrame:
    """One row per document: doc_id, start (tokens of all documents before it), n_tokens,
    ids (little-endian unsigned 32-bit integers)."""
    ship_package(spark)
    blocks = spark.read.schema(BLOCKS).parquet(path)
    # one row per part, however many documents: its tokens, then those of all parts before it
    parts = (blocks.select("shard", "start", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
             .groupBy("shard").agg(F.max(F.col("start") + F.col("n")).alias("n")))
    before = parts.select("shard", (F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    documents = blocks.mapInArrow(_documents, DOCUMENTS)
    # a row per part of the writing job: bounded by its number of partitions
    return documents.join(F.broadcast(before), "shard").select("doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids")


def ids_crc32(ids: F.Column) -> F.Column:
    """Unsigned crc32 of the bytes."""
    return F.crc32(ids)


def crc32_of(ids: np.ndarray) -> int:
    """The same for an array of ids."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())
