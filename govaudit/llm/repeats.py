"""Exact removal of repeated passages by prefix-free parsing.

A byte goes if it lies in a string of ``LENGTH`` = 100 bytes of its document
that also starts earlier in the corpus: in a smaller doc_id (null first), or
further left in the same document. (Among rows with one id, or without id, the
order is that of their chunks, which is fixed once the first table is written.)

* **Parse.** Triggers come from a rolling hash of ``GRAM`` = 32 bytes: in each
  100-byte string the gram with the smallest hash (the leftmost of equals) is
  its trigger. The strings that share a trigger follow each other; together they
  are one phrase. A string's trigger depends on its own bytes only, so equal
  strings have equal triggers at equal distances: phrases that hold a common
  string have the same gram.
* **Which grams repeat.** Chunks of documents send the hashes of their grams to
  hash buckets (48 bits each), with the number of distinct phrases of each, and get
  back whether it occurs again and whether it is crowded: whether the numbers of all
  chunks come to more than ``CROWDED``. Phrases of a gram that occurs once in the
  corpus repeat nothing and stay where they are.
* **Dictionary.** The other phrases, each distinct one once per chunk, meet by
  gram. Of each distinct phrase the earliest occurrence stays; in all later ones
  every string is repeated. The distinct phrases are the dictionary.
* **Suffix array.** Where a gram has several phrases, the suffixes of the
  dictionary are sorted by their first 100 bytes and then by their phrase's
  place in the parse (its earliest occurrence): corpus order. In each run of
  equal strings the first is the original, the others repeat it.
* **Crowded grams** (at the edges of a passage that many documents share each
  phrase reaches into a document's own text, so there may be as many as documents)
  aren't sent by gram. Their phrases are cut into their strings of 100 bytes, each
  distinct one is sent once per chunk and by its own hash, and of equal ones
  (compared by bytes) the earliest is the original.
* The repeated ranges go back to their chunks.

A task holds a bucket's hashes (6 bytes for each distinct gram of a chunk) or
at most ``CROWDED`` distinct phrases of one gram (168 bytes each) beside ``SORTED``
others, however many there are. Null and empty texts, and those under 100 bytes, lose nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from govaudit.llm.common import U64, mixed, powers, prefix_sums, slices, spread, stored, stretch_hashes, text_bytes
from govaudit.session import ship_package

LENGTH, GRAM = 100, 32
CHUNK, PARSED = 1 << 22, 1 << 19  # bytes of text in a chunk, and those parsed at a time
#: Dictionary phrases that are sorted at a time.
SORTED = 1 << 14
#: Phrases of one gram, counted by chunk, beyond which they are compared string by string.
CROWDED = 1 << 13
REACH = LENGTH - GRAM  # grams to the right of a string's first one
WIDTH = REACH + LENGTH  # bytes of the longest phrase



def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, count, squeeze = TaskContext.get().partitionId() << 32, 0, zstandard.ZstdCompressor(level=6)
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        names = batch.column(0).to_pylist()
        for a, b in slices(offsets, CHUNK):
            text = squeeze.compress(data[offsets[a]: offsets[b]].tobytes())
            rows = pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), batch.column(2).slice(a, b - a))
            yield pa.RecordBatch.from_arrays([pa.array([task + count]), pa.array([names[a:b]], pa.list_(pa.int64())),
                                              pa.array([np.diff(offsets[a: b + 1]).tolist()], pa.list_(pa.int64())), pa.array([text], pa.binary()), rows],
                                             names=["chunk", "doc_ids", "lengths", "text", "carried"])
            count += 1


def _text(row: dict) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(row["text"], max_output_size=max(1, sum(row["lengths"])))
    return np.frombuffer(raw, np.uint8), np.append(0, np.cumsum(np.array(row["lengths"], dtype=np.int64))).astype(np.int64)


def parse(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Phrases in order: the first string's start, the number of strings, the trigger's place, the
    hash of its gram. ``offsets`` bound the documents; no phrase crosses one, so a few are parsed at a time."""
    found = [_parse(data[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a], offsets[a]) for a, b in slices(offsets, PARSED)]
    return tuple(np.concatenate(x) for x in zip(*found)) if found else _parse(data, offsets, 0)


def _parse(data: np.ndarray, offsets: np.ndarray, before: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The phrases of a few documents that stand ``before`` bytes into their chunk."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none.astype(np.uint64)
    sums = prefix_sums(data)
    _, down = powers(len(sums))
    grams = mixed((sums[GRAM:] - sums[:-GRAM]) * down[: len(data) - GRAM + 1])
    least = (grams & U64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    width = 1  # least covers so many grams from each place on
    while width * 2 <= REACH + 1:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = REACH + 1 - width
    if rest:
        least = np.minimum(least[: len(least) - rest], least[rest:])
    trigger = (least & U64(0xFFFFFFFF)).astype(np.int64)
    document = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    starts = np.flatnonzero(document[: len(trigger)] == document[LENGTH - 1:])
    if not len(starts):
        return none, none, none, none.astype(np.uint64)
    of = trigger[starts]
    # a new phrase where the trigger changes; another document's trigger is another place
    first = np.flatnonzero(np.append(True, (of[1:] != of[:-1])))
    counts = np.diff(np.append(first, len(starts)))
    return starts[first] + before, counts, of[first] + before, grams[of[first]]


def _six(hashes: np.ndarray) -> bytes:
    """The upper six bytes of each."""
    return np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()


def _of_six(raw: bytes) -> np.ndarray:
    rows = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return np.concatenate([np.zeros((len(rows), 2), np.uint8), rows], axis=1).view("<u8").ravel()


def _grams(buckets: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data, offsets = _text(row)
                start, n, _, gram = parse(data, offsets)
                # 48 bits; a chance agreement is only looked at in vain
                hashes, which, times = np.unique(gram >> U64(16) << U64(16), return_inverse=True, return_counts=True)
                several = np.flatnonzero((times > 1)[which])
                raw = data.tobytes()
                phrases = {(k, raw[a:b]) for k, a, b in zip(which[several].tolist(), start[several].tolist(), (start + n + LENGTH - 1)[several].tolist())}
                number = np.bincount(np.array([k for k, _ in phrases], dtype=np.int64), minlength=len(hashes))
                bounds = np.searchsorted((hashes >> U64(32)) * U64(buckets) >> U64(32), np.arange(buckets + 1))
                more = [np.flatnonzero(number[a:b] > 1) for a, b in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_pydict(
                    {"chunk": [row["chunk"]] * buckets, "bucket": list(range(buckets)),
                     "hashes": [_six(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:])],
                     "more": [np.stack([k, number[a + k]], 1).astype("<u4").tobytes() for a, k in zip(bounds[:-1], more)]},
                    pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("hashes", pa.binary()), ("more", pa.binary())]))

    return send


def _answer(crowded: int):
    def answer(group: pa.Table) -> pa.Table:
        sent = [_of_six(x) for x in group["hashes"].to_pylist()]
        distinct, which, counts = np.unique(np.concatenate(sent), return_inverse=True, return_counts=True)
        again = (counts > 1)[which]
        ends = np.cumsum([len(x) for x in sent])
        phrases = counts.copy()
        for e, x, raw in zip(ends, sent, group["more"].to_pylist()):  # a chunk's hashes are distinct
            at, n = np.frombuffer(raw, "<u4").reshape(-1, 2).astype(np.int64).T
            phrases[which[e - len(x) + at]] += n - 1
        crowds = (phrases > crowded)[which]
        return pa.table({"chunk": group["chunk"], "bucket": group["bucket"],
                         "again": pa.array([np.packbits(again[e - len(x): e]).tobytes() for e, x in zip(ends, sent)], pa.binary()),
                         "crowds": pa.array([np.flatnonzero(crowds[e - len(x): e]).astype("<u4").tobytes() for e, x in zip(ends, sent)], pa.binary()),
                         "size": pa.array([len(x) for x in sent], pa.int64())})

    return answer


#: Rows without a phrase are ranges known to repeat, n strings long; their gram only spreads them.
PHRASES = pa.schema([("gram", pa.int64()), ("phrase", pa.binary()), ("doc_id", pa.int64()), ("chunk", pa.int64()), ("start", pa.int64()), ("n", pa.int64())])


def _strings(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the strings that start at ``at`` (in corpus order) their hashes, and which equal an earlier one."""
    hashes = stretch_hashes(prefix_sums(data), at, at + LENGTH)
    _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    first, again = first[which], np.zeros(len(at), dtype=bool)
    later, strings = np.flatnonzero(first != np.arange(len(at))), np.lib.stride_tricks.sliding_window_view(data, LENGTH)
    for k in (later[i: i + (1 << 16)] for i in range(0, len(later), 1 << 16)):
        again[k] = (strings[at[k]] == strings[at[first[k]]]).all(1)
    return hashes, again


def _phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            data, offsets = _text(row)
            start, n, _, gram = parse(data, offsets)
            hashes, which, times = np.unique(gram >> U64(16), return_inverse=True, return_counts=True)
            answers = sorted(row["answers"], key=lambda x: x["bucket"])
            bits = [np.unpackbits(np.frombuffer(x["again"], np.uint8), count=x["size"]) for x in answers]
            again = np.concatenate(bits).astype(bool) if bits else np.zeros(0, bool)
            crowded, before = np.zeros(len(hashes), dtype=bool), 0
            for x in answers:
                crowded[before + np.frombuffer(x["crowds"], "<u4").astype(np.int64)] = True
                before += x["size"]
            kept = np.flatnonzero((again | (times > 1))[which])
            if not len(kept):
                continue
            start, n, gram, crowded = start[kept], n[kept], gram[kept], crowded[which[kept]]
            raw = data.tobytes()
            names = np.array([-1 << 63 if x is None else x for x in row["doc_ids"]], dtype=np.int64)
            document = np.searchsorted(offsets, start, "right") - 1
            ids, seen, sent, repeated = names[document], set(), [], []
            phrases = [raw[a:b] for a, b in zip(start.tolist(), (start + n + LENGTH - 1).tolist())]
            for k in np.lexsort((start, ids)).tolist():  # corpus order within the chunk
                (repeated if phrases[k] in seen else sent).append(k)
                seen.add(phrases[k])
            sent, repeated = np.array(sent, dtype=np.int64), np.sort(np.array(repeated, dtype=np.int64))
            chunk = row["chunk"]
            sent, cut = sent[~crowded[sent]], sent[crowded[sent]]
            at, owner = spread(n[cut], start[cut]), np.repeat(ids[cut], n[cut])
            route, twice = _strings(data, at) if len(cut) else (np.zeros(0, np.uint64), np.zeros(0, bool))
            once = np.flatnonzero(~twice)
            for part in (once[i: i + 20_000] for i in range(0, len(once), 20_000)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(route[part].view(np.int64)), pa.array([raw[k: k + LENGTH] for k in at[part].tolist()], pa.binary()), pa.array(owner[part]),
                     pa.array(np.full(len(part), chunk)), pa.array(at[part]), pa.array(np.ones(len(part), np.int64))],
                    schema=PHRASES)
            for part in (sent[i: i + 20_000] for i in range(0, len(sent), 20_000)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram[part].view(np.int64)), pa.array([phrases[k] for k in part.tolist()], pa.binary()), pa.array(ids[part]),
                     pa.array(np.full(len(part), chunk)), pa.array(start[part]), pa.array(n[part])],
                    schema=PHRASES)
            if len(repeated) or twice.any():  # known already; as few ranges as possible
                a = np.append(start[repeated], at[twice])
                b = a + np.append(n[repeated], np.ones(int(twice.sum()), np.int64))
                order = np.argsort(a)
                a, b = a[order], b[order]
                first = np.flatnonzero(np.append(True, a[1:] != b[:-1]))
                a, b = a[first], b[np.append(first[1:] - 1, len(b) - 1)]
                size, nothing = len(a), pa.nulls(len(a), pa.int64())
                route = mixed(a.astype(np.uint64) ^ U64(chunk & 0xFFFFFFFFFFFFFFFF)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(route), pa.nulls(size, pa.binary()), nothing, pa.array(np.full(size, chunk)),
                                                  pa.array(a), pa.array(b - a)], schema=PHRASES)


def sort_suffixes(phrases: list[bytes], groups: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the dictionary's suffixes of 100 bytes and more, those that an earlier phrase of the same
    group holds: the phrase, and the suffix's place in it. ``order`` is the phrases' corpus order."""
    sizes = np.array([len(p) for p in phrases], dtype=np.int64)
    text = np.frombuffer(b"".join(phrases), np.uint8)
    counts = sizes - LENGTH + 1
    phrase = np.repeat(np.arange(len(phrases)), counts)
    place = spread(counts, np.zeros(len(phrases), np.int64))
    at = (np.cumsum(sizes) - sizes)[phrase] + place
    padded = np.append(text, np.zeros(8, np.uint8))
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    keys = [np.ascontiguousarray(words[at + k]).view(">u8").ravel() for k in [*range(0, LENGTH - 8, 8), LENGTH - 8]]
    ranked = np.lexsort((order[phrase], *keys[::-1], groups[phrase]))
    same = groups[phrase[ranked]][1:] == groups[phrase[ranked]][:-1]
    for key in keys:
        key = key[ranked]
        same &= key[1:] == key[:-1]
    repeated = ranked[1:][same]
    return phrase[repeated], place[repeated]


RANGES = pa.schema([("chunk", pa.int64()), ("ranges", pa.binary())])


def _by_chunk(chunk: np.ndarray, start: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((start, chunk))
    chunk, pairs = chunk[order], np.stack([start[order], n[order]], 1).astype("<u4")
    first = np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1])) if len(chunk) else np.zeros(0, np.int64)
    ends = np.append(first[1:], len(chunk))
    return pa.RecordBatch.from_arrays([pa.array(chunk[first]), pa.array([pairs[a:b].tobytes() for a, b in zip(first, ends)], pa.binary())], schema=RANGES)


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by gram, phrase and corpus order; phrases of different grams may be sorted together."""
    book: dict[str, list] = {k: [] for k in ("phrase", "group", "doc_id", "chunk", "start")}
    last: tuple = (None, None)
    pending = 0

    def close() -> pa.RecordBatch | None:
        if not book["phrase"]:
            return None
        group, chunk, start = (np.array(book[k], dtype=np.int64) for k in ("group", "chunk", "start"))
        order = np.empty(len(group), np.int64)
        order[np.lexsort((start, chunk, np.array(book["doc_id"], dtype=np.int64)))] = np.arange(len(group))
        k, place = sort_suffixes(book["phrase"], group, order)
        for x in book.values():
            x.clear()
        return _by_chunk(chunk[k], start[k] + place, np.ones(len(k), np.int64))

    held: list[tuple] = []  # the distinct phrases of the gram at hand
    for batch in batches:
        known = np.asarray(batch.column(1).is_null())
        if known.any():
            rows = batch.filter(pa.array(known))
            yield _by_chunk(rows.column(3).to_numpy(), rows.column(4).to_numpy(), rows.column(5).to_numpy())
            batch = batch.filter(pa.array(~known))
        later = []
        for gram, phrase, doc_id, chunk, start, n in zip(*(batch.column(k).to_pylist() for k in range(6))):
            if (gram, phrase) == last:
                later.append((chunk, start, n))
                continue
            if gram != last[0]:
                if len(held) > 1:
                    for x in held:
                        for key, value in zip(book, x):
                            book[key].append(value)
                    if len(book["phrase"]) >= SORTED:
                        yield close()
                held.clear()
                pending += 1
            last = (gram, phrase)
            held.append((phrase, pending, doc_id, chunk, start))
        if later:
            yield _by_chunk(*(np.array(x, dtype=np.int64) for x in zip(*later)))
    if len(held) > 1:
        for x in held:
            for key, value in zip(book, x):
                book[key].append(value)
    end = close()
    if end is not None:
        yield end


def _cut(as_text: bool):
    kind = pa.string() if as_text else pa.binary()
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "carried"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            carried = batch.column(5)
            for at, row in enumerate(batch.select(range(5)).to_pylist()):
                data, offsets = _text(row)
                ranges = np.frombuffer(b"".join(row["ranges"] or []), "<u4").reshape(-1, 2).astype(np.int64)
                edges = np.zeros(len(data) + 1, dtype=np.int32)
                np.add.at(edges, ranges[:, 0], 1)
                np.add.at(edges, ranges[:, 0] + ranges[:, 1] + LENGTH - 1, -1)
                gone = np.cumsum(edges[:-1], dtype=np.int32) > 0
                del edges
                opens = gone.copy()
                opens[1:] &= ~gone[:-1]
                inner = offsets[:-1][offsets[:-1] < offsets[1:]]
                opens[inner] = gone[inner]  # spans don't cross documents
                removed, spans = (np.append(0, np.cumsum(x))[offsets] for x in (gone, opens))
                kept = [data[a:b][~gone[a:b]].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
                sizes = np.diff(offsets)
                for a, b in slices(offsets, 1 << 20):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(row["doc_ids"][a:b], pa.int64()), pa.array(sizes[a:b]), pa.array(np.diff(removed[a: b + 1])),
                         pa.array(np.diff(spans[a: b + 1])),
                         pa.array([x.decode("utf-8", "ignore") for x in kept[a:b]] if as_text else kept[a:b], kind), carried[at].values.slice(a, b - a)],
                        names=names)

    return cut


def remove_repeats(docs: DataFrame, as_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept (the remaining bytes; as_text:
    as text, without what is left of characters cut in two) for each row of ``docs`` (doc_id, text), and
    carried, a struct of the columns ``carry``. Starts a job."""
    spark = docs.sparkSession
    ship_package(spark)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    read = docs.select(F.col("doc_id").cast("long"), "text", F.struct(*(F.col(f"`{c}`") for c in carry), F.lit(0).alias("_")).alias("carried"))
    kind = read.schema["carried"].dataType
    shape = (StructType().add("chunk", "long").add("doc_ids", ArrayType(LongType())).add("lengths", ArrayType(LongType()))
             .add("text", "binary").add("carried", ArrayType(kind)))
    chunks = stored(read.mapInArrow(_chunks, shape), "chunks")
    texts = chunks.select("chunk", "doc_ids", "lengths", "text")
    sent = texts.mapInArrow(_grams(buckets), "chunk long, bucket long, hashes binary, more binary")
    answers = sent.groupBy("bucket").applyInArrow(_answer(CROWDED), "chunk long, bucket long, again binary, crowds binary, size long")
    per_chunk = answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "again", "crowds", "size")).alias("answers"))
    phrases = texts.join(per_chunk, "chunk").select("chunk", "doc_ids", "lengths", "text", "answers").mapInArrow(
        _phrases, "gram long, phrase binary, doc_id long, chunk long, start long, n long")
    ranges = (phrases.repartition("gram").sortWithinPartitions("gram", "phrase", "doc_id", "chunk", "start")
              .mapInArrow(_repeated, "chunk long, ranges binary").groupBy("chunk").agg(F.collect_list("ranges").alias("ranges")))
    kept = StructType().add("doc_id", "long").add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add(
        "kept", "string" if as_text else "binary").add("carried", kind)
    return chunks.join(ranges, "chunk", "left").select("chunk", "doc_ids", "lengths", "text", "ranges", "carried").mapInArrow(_cut(as_text), kept)
