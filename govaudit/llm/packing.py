"""Hierarchical packing of documents into training sequences of several lengths.

Every length in ``TIERS`` is a power of two. A document gives as many full
windows as it holds; its rest is routed to the smallest tier that holds it.
Longest first, a rest opens a sequence of its tier, and the gap is filled from
what is left, mostly of shorter tiers: always the longest piece that fits, and
where none fits, a part cut from the longest one, so the sequence ends full.
Only what a group of documents leaves at its very end is too short to fill a
tier; it is cut into sequences of powers of two. So no sequence needs padding.

Sequences are dealt to steps of ``STEP`` tokens, longest tier first, so that
the steps of a group hold the same number of tokens, and mostly one length.

A task packs its documents in groups of about ``GROUP`` tokens. Ids are kept
only for the group at hand, so memory doesn't grow with the partition. Groups
need no shuffle and hot sources don't matter. sequence_id and step_id hold the
task's number in the upper half, so they are unique.

A null or empty text has the end id alone. Repeated rows are packed as often as
they occur. An empty table gives no pieces.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govaudit.llm.common import slices, spread, text_bytes
from govaudit.llm.subwords import subword_table
from govaudit.llm.token_files import crc32_of
from govaudit.session import ship_package

WINDOW = 2048
TIERS = (128, 256, 512, 1024, 2048)
GROUP = 1 << 20
STEP = 1 << 16
PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "tier long, step_id long")
SCHEMA = pa.schema([(x.split()[0], pa.int64()) for x in PIECES.split(", ")])


def arrange(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length) that hold every token of the documents once."""
    window, sequences = tiers[-1], []
    pool: list[tuple[int, int, int]] = []  # length, document, start; ascending
    for k, n in enumerate(lengths):
        full = n // window
        sequences += [[(k, x * window, window)] for x in range(full)]
        if n % window:
            pool.append((n % window, k, full * window))
    pool.sort()
    while pool:
        size, k, start = pool.pop()
        tier = tiers[bisect.bisect_left(tiers, size)]
        held, gap = [(k, start, size)], tier - size
        while gap and pool:
            at = bisect.bisect_right(pool, (gap, len(lengths), 0)) - 1
            if at >= 0:
                size, k, start = pool.pop(at)
            else:
                longest, k, start = pool.pop()
                size = gap
                bisect.insort(pool, (longest - gap, k, start + gap))
            held.append((k, start, size))
            gap -= size
        sequences += [held] if not gap else _powers(held, tier - gap)
    return sequences


def _powers(held: list[tuple[int, int, int]], total: int) -> list[list[tuple[int, int, int]]]:
    """The same pieces as sequences whose lengths are powers of two."""
    out, rest = [], list(reversed(held))
    while total:
        room = 1 << (total.bit_length() - 1)
        total -= room
        sequence = []
        while room:
            k, start, size = rest.pop()
            taken = min(size, room)
            sequence.append((k, start, taken))
            room -= taken
            if taken < size:
                rest.append((k, start + taken, size - taken))
        out.append(sequence)
    return out


def _pack(path: str, end_id: int, tiers: tuple[int, ...], step: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, high = subword_table(path), TaskContext.get().partitionId() << 32
        names: list = []
        held: list[np.ndarray] = []
        lengths: list[int] = []
        count = {"sequence": 0, "step": 0}

        def close() -> pa.RecordBatch:
            ids = np.concatenate(held)
            begins = np.cumsum(lengths) - lengths
            sequences = arrange(lengths, tiers)
            sequences.sort(key=lambda s: -sum(x[2] for x in s))
            rows, filled = [], 0
            for sequence in sequences:
                size, offset = sum(x[2] for x in sequence), 0
                if filled + size > step and filled:
                    count["step"] += 1
                    filled = 0
                filled += size
                for k, start, n in sequence:
                    at = int(begins[k]) + start
                    rows.append((names[k], start, n, crc32_of(ids[at: at + n]), lengths[k], high + count["sequence"], offset, size, high + count["step"]))
                    offset += n
                count["sequence"] += 1
            count["step"] += 1
            names.clear()
            held.clear()
            lengths.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], schema=SCHEMA)

        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            doc_ids = batch.column(0).to_pylist()
            for a, b in slices(offsets, GROUP):
                ids, bounds = tokens.encode(data[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a])
                sizes = np.diff(bounds) + 1
                whole = np.full(int(sizes.sum()), end_id, dtype=np.uint32)
                whole[spread(sizes - 1, np.cumsum(sizes) - sizes)] = ids
                names += doc_ids[a:b]
                held.append(whole)
                lengths += sizes.tolist()
                if sum(map(len, held)) >= GROUP:
                    yield close()
        if held:
            yield close()

    return pack


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, tiers: tuple[int, ...] = TIERS, step: int = STEP) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text); see the module's text."""
    ship_package(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(_pack(tokenizer, end_id, tiers, step), PIECES)
