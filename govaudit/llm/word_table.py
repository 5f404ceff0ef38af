"""A table of distinct words: each word of the corpus is worked on once, and what comes of it
goes back to the places where it stands.

``word_chunks`` splits texts into words (stretches without space or bytes 9 to
13) and writes one row per chunk of about 8 MB of text: the documents, for each
word of their texts its number in the chunk's list of distinct words, and that
list, dealt to hash buckets. ``answered`` sends the lists to their buckets, lets
a function work on all lists of a bucket, and brings its answers back to the
chunks. The chunks are written in hash buckets, so answers come to them and they
stay where they are; lists and answers are compressed. A task holds the
lists of one bucket, so the number of buckets bounds its memory; a frequent word
is there once per chunk.

``encode_decode`` uses it for a tokenizer that drops white space: a word's ids
don't depend on its neighbours. A null or empty text has no ids and decodes to
''. Repeated rows give repeated results.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govaudit.llm.common import LOWER, SPACE, U64, byte_hashes, slices, stored_in_buckets, text_bytes
from govaudit.session import ship_package

CHUNK, HASHED = 1 << 23, 1 << 21  # bytes of text in a chunk, and those hashed at a time
CHUNKS = ("chunk long, doc_ids array<long>, n_words array<long>, places binary, lists array<binary>, counts array<binary>, sizes array<long>")
CHUNK_SCHEMA = pa.schema([("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64())), ("places", pa.binary()),
                          ("lists", pa.list_(pa.binary())), ("counts", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int64()))])


def packed(raw: bytes, level: int = 6) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(raw)


def unpacked(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word; none crosses a text's end."""
    inside = ~SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = offsets[:-1] < offsets[1:]
    first[offsets[:-1][full]] |= inside[offsets[:-1][full]]
    last[offsets[1:][full] - 1] |= inside[offsets[1:][full] - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _hashes(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The words' hashes, worked out for a few texts at a time."""
    out = np.zeros(len(starts), dtype=np.uint64)
    for a, b in slices(offsets, HASHED):
        low, high = np.searchsorted(starts, (offsets[a], offsets[b]))
        out[low:high] = byte_hashes(data[offsets[a]: offsets[b]], starts[low:high] - offsets[a], ends[low:high] - offsets[a])
    return out


def _chunks(buckets: int, lower: bool, counted: Callable | None, size: int):
    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            names = batch.column(0).to_pylist()
            for a, b in slices(offsets, size):
                part, bounds = data[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a]
                if lower:
                    part = LOWER[part]
                starts, ends = word_bounds(part, bounds)
                hashes, seen_at, which = np.unique(_hashes(part, bounds, starts, ends), return_index=True, return_inverse=True)
                raw = part.tobytes()
                words = [raw[x:y] for x, y in zip(starts[seen_at].tolist(), ends[seen_at].tolist())]
                bucket = ((hashes >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)
                edges = np.searchsorted(bucket, np.arange(buckets + 1))
                order = [k for x, y in zip(edges[:-1].tolist(), edges[1:].tolist()) for k in sorted(range(x, y), key=words.__getitem__)]
                rank = np.empty(len(words), dtype=np.int64)
                rank[order] = np.arange(len(words))
                places = rank[which] if len(words) else np.zeros(0, np.int64)
                n_words = np.diff(np.searchsorted(starts, bounds))
                weights = np.zeros(len(words), dtype=np.int64)
                if counted is not None:
                    use = np.repeat(np.array([counted(x) for x in names[a:b]], dtype=bool), n_words)
                    weights = np.bincount(places[use], minlength=len(words))
                lists = [packed(b"\n".join(words[k] for k in order[x:y])) for x, y in zip(edges[:-1], edges[1:])]
                counts = [packed(weights[x:y].astype("<u4").tobytes()) if counted is not None else None for x, y in zip(edges[:-1], edges[1:])]
                yield pa.RecordBatch.from_pydict(
                    {"chunk": [task + count], "doc_ids": [names[a:b]], "n_words": [n_words.tolist()], "places": [packed(places.astype("<u4").tobytes())],
                     "lists": [lists], "counts": [counts], "sizes": [np.diff(edges).tolist()]}, CHUNK_SCHEMA)
                count += 1

    return chunks


def word_chunks(docs: DataFrame, lower: bool = False, counted: Callable | None = None, size: int = CHUNK) -> DataFrame:
    """The chunk table of ``docs`` (doc_id, text), written. lower: A-Z become lower case. counted: whether the words
    of a doc_id are counted; then each list comes with its words' counts. size: bytes of text in a chunk."""
    spark = docs.sparkSession
    ship_package(spark)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_chunks(buckets, lower, counted, size), CHUNKS)
    return stored_in_buckets(chunks, "word-chunks", "chunk", buckets)


def answered(chunks: DataFrame, answer: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """chunk, bucket, answer: ``answer`` gets a table (chunk, bucket, list, counts) of a bucket and returns those columns."""
    sent = chunks.select("chunk", F.posexplode(F.arrays_zip("lists", "counts")).alias("bucket", "x")).select(
        "chunk", F.col("bucket").cast("long").alias("bucket"), F.col("x.lists").alias("list"), F.col("x.counts").alias("counts"))
    return sent.groupBy("bucket").applyInArrow(answer, "chunk long, bucket long, answer binary")


def with_answers(chunks: DataFrame, answers: DataFrame) -> DataFrame:
    """Each chunk with its buckets' answers (a list per chunk, as long as the chunk's own)."""
    mine = answers.where("chunk IS NOT NULL").groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "answer"))).alias("answers"))
    return chunks.select("chunk", "doc_ids", "n_words", "places", "sizes").join(mine, "chunk").withColumn("answers", F.expr("transform(answers, x -> x.answer)"))


def put_lists(lists: list[np.ndarray]) -> bytes:
    """Lists of ids as bytes: their lengths, then the ids."""
    counts = np.array([len(x) for x in lists], dtype="<u4")
    every = np.concatenate(lists).astype("<u4") if lists else np.zeros(0, "<u4")
    return packed(np.array([len(lists)], "<u4").tobytes() + counts.tobytes() + every.tobytes())


def get_lists(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and ids."""
    values = np.frombuffer(unpacked(raw), "<u4")
    n = int(values[0])
    return values[1: 1 + n].astype(np.int64), values[1 + n:]


_tokenizers: dict = {}


def tokenizer_of(path: str):
    """This worker's tokenizer for a file."""
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
        _tokenizers[path].no_truncation()
        _tokenizers[path].no_padding()
    return _tokenizers[path]


def split_lists(group: pa.Table) -> list[list[bytes]]:
    """The words of each row."""
    return [raw.split(b"\n") if raw else [] for raw in map(unpacked, group["list"].to_pylist())]


def _encoded(path: str):
    def encode(group: pa.Table) -> pa.Table:
        lists = split_lists(group)
        words = sorted({w for x in lists for w in x})  # each distinct word once
        ids: dict[bytes, np.ndarray] = {}
        for k in range(0, len(words), 10_000):
            part = words[k: k + 10_000]
            for w, e in zip(part, tokenizer_of(path).encode_batch([w.decode("utf-8", "replace") for w in part], add_special_tokens=False)):
                ids[w] = np.array(e.ids, dtype=np.uint32)
        return pa.table({"chunk": group["chunk"], "bucket": group["bucket"], "answer": pa.array([put_lists([ids[w] for w in x]) for x in lists], pa.binary())})

    return encode


def pieces(spark, path: str) -> DataFrame:
    """id, piece: a tokenizer's table, one row per id."""
    vocabulary = tokenizer_of(path).get_vocab(with_added_tokens=True)
    return spark.createDataFrame(sorted((i, p) for p, i in vocabulary.items()), "id long, piece string")


def _placed(piece_of: list[bytes | None]):
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, text, sizes = [], [], []
                for raw in row["answers"]:
                    lengths, flat = get_lists(raw)
                    ends = np.cumsum(lengths)
                    named = flat.tolist()
                    packed_ids = flat.astype("<u4").tobytes()
                    for a, b in zip((ends - lengths).tolist(), ends.tolist()):
                        ids.append(packed_ids[4 * a: 4 * b])
                        text.append(b" ".join([piece_of[x] for x in named[a:b]]))  # the join of id and piece
                        sizes.append(b - a)
                places = np.frombuffer(unpacked(row["places"]), "<u4").astype(np.int64)
                bounds = np.append(0, np.cumsum(np.array(row["n_words"], dtype=np.int64))).astype(np.int64)
                running = np.append(0, np.cumsum(np.array(sizes, dtype=np.int64)[places])) if len(places) else np.zeros(1, np.int64)
                tokens = np.diff(running[bounds])
                for a, b in slices(bounds, 200_000):
                    these = [places[x:y].tolist() for x, y in zip(bounds[a:b].tolist(), bounds[a + 1: b + 1].tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(row["doc_ids"][a:b], pa.int64()), pa.array(tokens[a:b]), pa.array([b"".join([ids[k] for k in x]) for x in these], pa.binary()),
                         pa.array([b" ".join([text[k] for k in x if sizes[k]]).decode("utf-8", "replace") for x in these], pa.string())], schema=schema)

    return place


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), decoded for each row of ``docs`` (doc_id, text). Starts a job.

    The decoded text is what the tokenizer's own decode gives where it has no
    decoder: the pieces with a space between them.
    """
    chunks = word_chunks(docs)
    # one row per id of the vocabulary file: its size is the tokenizer's
    rows = pieces(docs.sparkSession, path).orderBy("id").collect()
    piece_of: list[bytes | None] = [None] * (rows[-1].id + 1)
    for r in rows:
        piece_of[r.id] = r.piece.encode()
    return with_answers(chunks, answered(chunks, _encoded(path))).select("chunk", "doc_ids", "n_words", "places", "sizes", "answers").mapInArrow(
        _placed(piece_of), "doc_id long, n_tokens long, ids binary, decoded string")
