"""Exact k nearest binary codes by Hamming distance: incremental multi-index hashing.

A vector becomes ``BITS`` = 64 bits: the signs of its coordinates, or, where it
hasn't 64 of them, of its projections on fixed random directions. A code is cut
into ``SEGMENTS`` of 16 bits. Codes within distance SEGMENTS * (r + 1) - 1 of a
query differ from it in some segment by at most r bits. So a search looks up each segment
with radius 0, then 1, 2, ... and verifies whole codes as it meets them; it ends
once the k-th verified distance is at most SEGMENTS * (r + 1) - 1: no code
unseen can be nearer, and ties have all been seen.

Equal codes are searched once: for each distinct code its k smallest ids stand
for all (ties go by id, so no other can be among the k nearest). Codes are dealt
to blocks by hash, queries to chunks; a task holds one block with its segment
tables and one chunk of queries, which it answers on its own. The k nearest of
each block then meet per query: k rows a block. Block and chunk sizes are fixed,
so a task's memory doesn't grow.

A query's own row takes part (distance 0). Null vectors, and vectors with a null
or not a number, have no code: they are neither queries nor answers. Fewer than
k rows give fewer neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from govaudit.llm.common import spread, stored
from govaudit.session import ship_package

BITS, SEGMENTS = 64, 4
WIDTH = BITS // SEGMENTS
BLOCK, CHUNK = 1 << 14, 1 << 10


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = batch.column(1).to_pylist()
        good = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) for v in vectors]
        codes = []
        for size in sorted({len(v) for v, g in zip(vectors, good) if g}):
            which = [k for k, (v, g) in enumerate(zip(vectors, good)) if g and len(v) == size]
            directions = np.eye(BITS) if size == BITS else np.random.default_rng(size).standard_normal((size, BITS))
            # one product per row, so that equal vectors get equal codes however rows are batched
            bits = np.stack([np.asarray(vectors[k], dtype=np.float64) @ directions > 0 for k in which])
            codes += zip(which, np.packbits(bits, axis=1, bitorder="little").view("<i8").ravel().tolist())
        codes.sort()
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([k for k, _ in codes], pa.int64())), pa.array([c for _, c in codes], pa.int64())],
                                         names=["id", "code"])


def binary_codes(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """id, code (64 bits as a long) of each vector."""
    ship_package(vectors.sparkSession)
    return vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column)).mapInArrow(_codes, "id long, code long")


def masks(radius: int) -> np.ndarray:
    """All segment values with ``radius`` bits set."""
    return np.array([sum(1 << b for b in bits) for bits in combinations(range(WIDTH), radius)] or [0], dtype=np.int64)


def search(codes: np.ndarray, queries: np.ndarray, needed: np.ndarray, k: int) -> list[np.ndarray]:
    """For each query the places of all distinct ``codes`` that are among its nearest, with ties,
    until ``needed`` (rows standing behind each code, at most k) adds up to k."""
    segments = [(codes >> np.uint64(WIDTH * s) & np.uint64((1 << WIDTH) - 1)).astype(np.int64) for s in range(SEGMENTS)]
    orders = [np.argsort(x, kind="stable") for x in segments]
    bounds = [np.searchsorted(x[o], np.arange((1 << WIDTH) + 1)) for x, o in zip(segments, orders)]
    found: list[np.ndarray] = []
    flips = [masks(r) for r in range(WIDTH + 1)]
    for query in queries:
        seen = np.zeros(len(codes), dtype=bool)
        at: list[np.ndarray] = []
        far: list[np.ndarray] = []
        for radius in range(WIDTH + 1):
            for s in range(SEGMENTS):
                values = (int(query) >> (WIDTH * s) & ((1 << WIDTH) - 1)) ^ flips[radius]
                a, b = bounds[s][values], bounds[s][values + 1]
                hit = a < b
                if not hit.any():
                    continue
                new = orders[s][spread(b[hit] - a[hit], a[hit])]
                new = new[~seen[new]]
                seen[new] = True
                at.append(new)
                far.append(np.bitwise_count(codes[new] ^ query).astype(np.int64))
            if at:
                places, distance = np.concatenate(at), np.concatenate(far)
                order = np.argsort(distance, kind="stable")
                enough = np.searchsorted(np.cumsum(needed[places[order]]), k)
                if enough < len(order):
                    limit = distance[order[enough]]
                    if limit <= SEGMENTS * (radius + 1) - 1:
                        found.append(places[distance <= limit])
                        break
        else:
            found.append(np.concatenate(at) if at else np.zeros(0, np.int64))
    return found


def _answers(k: int):
    def answer(key: tuple, index: pa.Table, asked: pa.Table) -> pa.Table:
        codes = index["code"].to_numpy().view(np.uint64)
        behind = index["ids"].to_pylist()
        needed = np.array([len(x) for x in behind], dtype=np.int64)
        queries, who = asked["code"].to_numpy().view(np.uint64), asked["ids"].to_pylist()
        rows: tuple[list, list, list] = ([], [], [])
        if len(codes) and len(queries):
            for q, ids, places in zip(queries, who, search(codes, queries, needed, k)):
                near = sorted((int(np.bitwise_count(codes[p] ^ q)), x) for p in places.tolist() for x in behind[p])[:k]
                for distance, x in near:
                    rows[0].append(int(q.view(np.int64)))
                    rows[1].append(x)
                    rows[2].append(distance)
        return pa.table([pa.array(x, pa.int64()) for x in rows], names=["code", "id", "distance"])

    return answer


def nearest(codes: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), id, distance: the k nearest rows of ``codes`` (id, code) for each row of
    ``queries`` (id, code), by distance and then id. Starts jobs."""
    # the k smallest ids of each code; Spark applies the limit before the shuffle as well
    place = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    distinct = (codes.where("id IS NOT NULL").distinct().withColumn("place", place).where(F.col("place") <= k)
                .groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    distinct = stored(distinct, "codes")
    asked = stored(queries.where("id IS NOT NULL").select("code").distinct().withColumn("ids", F.array(F.lit(0).cast("long"))), "asked")
    blocks = max(1, -(-distinct.count() // BLOCK))
    chunks = max(1, -(-asked.count() // CHUNK))
    index = distinct.select("code", "ids", F.expr(f"pmod(xxhash64(code), {blocks})").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    probes = asked.select("code", "ids", F.expr(f"pmod(xxhash64(code, 1), {chunks})").cast("int").alias("chunk"),
                          F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    near = index.groupBy("block", "chunk").cogroup(probes.groupBy("block", "chunk")).applyInArrow(_answers(k), "code long, id long, distance long")
    best = near.groupBy("code").agg(F.expr(f"slice(array_sort(collect_list(struct(distance, id))), 1, {k})").alias("near"))  # k rows a block
    return (queries.where("id IS NOT NULL").select(F.col("id").alias("query_id"), "code").join(best, "code")
            .select("query_id", F.posexplode("near").alias("rank", "n"))
            .select("query_id", (F.col("rank") + 1).cast("long").alias("rank"), F.col("n.id").alias("id"), F.col("n.distance").alias("distance")))
