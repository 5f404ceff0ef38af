"""Near-duplicate documents by HyperMinHash.

A document's set holds its distinct shingles of ``SHINGLE`` = 5 lower-cased
words (64-bit hashes). A shingle's hash picks one of ``REGISTERS`` buckets; a
bucket keeps the smallest of its shingles' second hashes, compressed to its
number of leading zeros and the ``MANTISSA`` bits that follow, 16 bits in all.

1. Documents with equal sets form a class, which has a number of its own; the
   text of one of its rows (known by doc_id and a hash of the text) stands for it.
2. The registers are cut into ``BANDS`` bands of ``BAND``. Representatives that
   agree in a band share a bin. Empty registers take part, all-empty bands
   don't. A pair of likeness 0.75 shares none of the 64 bins with a chance of
   (1 - 0.75^5)^64 = 3e-8, and less where it is more alike.
3. First documents are compared with the smallest of a bin if they meet it in
   ``OFTEN`` bins; what is confirmed gives a first set of components. Bins that lie within one component are
   done: no pair of theirs can change anything.
4. In the other bins each pair from different components is compared, if the
   bin has at most ``CROWD`` documents. Documents that meet only in crowded bins
   meet in two or more (one of likeness 0.75 in fewer than two with a chance of
   6e-7); for those in at least two such bins, and for small sets in one, an
   exact prefix filter finds the pairs: with a document's shingles in ascending order of frequency, the first
   one that a pair shares stands so early in both that what follows suffices for
   the threshold. Common passages come last in that order, and so do words that
   a group of copies has in common, so neither brings its documents together.
   Of a shingle's documents only those outside its most frequent component are
   joined with all of them, so a large component isn't paired with itself.
   Nothing is dropped, and no group is expanded into all its pairs.

Comparing means: the likeness estimated from the registers, corrected for
registers that agree by chance, discards pairs that lie six standard errors
below the threshold; the others are confirmed on their full sets, recomputed
from the texts: 100 * intersection >= 75 * union.

Null and empty texts and texts without words have an empty set and link with
nothing. Texts of fewer than five words have one shingle, the whole sequence.
Rows with equal texts link whatever their ids; of a row without id, kept is true
only if no row with an id is in its component. Rows of one id with different
texts are documents of their own, each with the component that its text is in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from govaudit.llm.common import LOWER, SPACE, U64, byte_hashes, mixed, slices, stored, text_bytes
from govaudit.llm.components import components
from govaudit.session import ship_package

SHINGLE = 5
PERCENT = 75
BANDS, BAND, MANTISSA = 64, 5, 10
REGISTERS = BANDS * BAND
#: Documents in a bin up to which its pairs are formed; beyond, the prefix filter finds them.
CROWD = 16
#: Bins that a document shares with their smallest one for the first comparison (fewer for small sets).
OFTEN = 4
#: Shingles under which one crowded bin suffices for the prefix filter.
FEW = 32

_RANDOM = np.random.default_rng(75)
_PLACE = _RANDOM.integers(1, 2**63, max(SHINGLE, BAND), dtype=np.uint64) * U64(2) + U64(1)
_BAND_SALT = _RANDOM.integers(1, 2**63, BANDS, dtype=np.uint64)
_SECOND = U64(0xA0761D6478BD642F)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, ascending."""
    sets: list[np.ndarray] = []
    for a, b in slices(offsets, 1 << 21):
        part, bounds = LOWER[data[offsets[a]: offsets[b]]], offsets[a: b + 1] - offsets[a]
        gap = SPACE[part]
        begins = bounds[:-1][bounds[:-1] < bounds[1:]]
        first = ~gap
        first[1:] &= gap[:-1]
        first[begins] |= ~gap[begins]
        last = ~gap
        last[:-1] &= gap[1:]
        last[bounds[1:][bounds[:-1] < bounds[1:]] - 1] |= ~gap[bounds[1:][bounds[:-1] < bounds[1:]] - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        words = byte_hashes(part, starts, ends)
        at = np.searchsorted(starts, bounds)
        n = max(0, len(words) - SHINGLE + 1)
        shingles = np.zeros(n, dtype=np.uint64)
        for k in range(SHINGLE):
            shingles += words[k: k + n] * _PLACE[k]
        shingles = mixed(shingles)
        for x, y in zip(at[:-1].tolist(), at[1:].tolist()):
            if y - x >= SHINGLE:
                sets.append(np.unique(shingles[x: y - SHINGLE + 1]))
            elif y > x:
                sets.append(mixed(np.array([(words[x:y] * _PLACE[: y - x]).sum(dtype=np.uint64) + U64(y - x)], dtype=np.uint64)))
            else:
                sets.append(np.zeros(0, dtype=np.uint64))
    return sets


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """A row of registers per set: 0 is empty, else 1 + 1024 * leading zeros + mantissa."""
    out = np.zeros((len(sets), REGISTERS), dtype="<u2")
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    if not sizes.sum():
        return out
    every = np.concatenate(sets)
    # sets ascend, so a set's buckets follow each other
    bucket = ((every >> U64(32)) * U64(REGISTERS) >> U64(32)).astype(np.int64) + np.repeat(np.arange(len(sets)) * REGISTERS, sizes)
    starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    least = np.minimum.reduceat(mixed(every ^ _SECOND), starts)
    fraction, exponent = np.frexp(least.astype(np.float64))
    zeros = np.clip(64 - exponent, 0, 62)
    bits = np.minimum(((fraction - 0.5) * 2 * (1 << MANTISSA)).astype(np.int64), (1 << MANTISSA) - 1).clip(0)
    out.reshape(-1)[bucket[starts]] = 1 + (zeros << MANTISSA) + bits
    return out


def chance_agreement(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The chance that registers of unrelated sets of n and m shingles agree without holding the same shingle."""
    a, b = (np.maximum(np.asarray(x, float) / REGISTERS, 1e-9)[..., None] for x in (n, m))
    zeros = np.arange(63)
    high = 2.0 ** -zeros
    low = np.where(zeros == 62, 0.0, high / 2)
    cell = (high - low) / (1 << MANTISSA)
    mass = a * b / (a + b) * (np.exp(-(a + b) * low) - np.exp(-(a + b) * high))
    return (cell * mass).sum(-1)


def estimated_likeness(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The corrected estimate for each pair of register rows, and the number of registers that it rests on."""
    used = ((x > 0) | (y > 0)).sum(1)
    agree = ((x == y) & (x > 0)).sum(1)
    by_chance = chance_agreement(n, m) * REGISTERS / np.maximum(used, 1)
    raw = agree / np.maximum(used, 1)
    return np.clip((raw - by_chance) / np.maximum(1 - by_chance, 1e-9), 0, 1), used


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_bytes(batch.column(2))
        for a, b in slices(offsets, 1 << 23):
            sets = shingle_sets(data[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                 pa.array([r.tobytes() for r in registers(sets)], pa.binary())],
                names=["doc_id", "mark", "n_shingles", "digest", "registers"])


def _rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u2").reshape(-1, REGISTERS)


def _bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = _rows(batch.column(1)).reshape(-1, BANDS, BAND)
        keys = mixed((rows.astype(np.uint64) * _PLACE[:BAND]).sum(2, dtype=np.uint64) + _BAND_SALT)
        full = rows.any(2)
        which = np.repeat(np.arange(len(rows)), full.sum(1))
        yield pa.RecordBatch.from_arrays([pa.array(keys[full].view(np.int64)), batch.column(0).take(pa.array(which)),
                                          batch.column(2).take(pa.array(which))], names=["bin", "rep", "n"])


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_bytes(batch.column(2))
        for a, b in slices(offsets, 1 << 21):
            sets = shingle_sets(data[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a])
            which = np.repeat(np.arange(a, b), [len(x) for x in sets])
            sizes = np.repeat(np.array([len(x) for x in sets], dtype=np.int64), [len(x) for x in sets])
            every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which)), batch.column(1).take(pa.array(which)),
                                              pa.array(sizes), pa.array(every.view(np.int64))], names=["rep", "label", "n", "shingle"])


def _maybe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        n, m = batch.column(2).to_numpy(), batch.column(4).to_numpy()
        estimate, used = estimated_likeness(_rows(batch.column(3)), _rows(batch.column(5)), n, m)
        near = estimate + 6 * np.sqrt(0.1875 / np.maximum(used, 1)) >= PERCENT / 100
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(near)), batch.column(1).filter(pa.array(near))], names=["u", "v"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: tuple = (None, None)
    for batch in batches:
        if not batch.num_rows:
            continue
        u, v = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        first = shingle_sets(*text_bytes(batch.column(2)))
        data, offsets = text_bytes(batch.column(3))
        keep = []
        for k, s in enumerate(first):
            if held[0] != v[k]:  # pairs come sorted by v
                held = (v[k], shingle_sets(data[offsets[k]: offsets[k + 1]], offsets[k: k + 2] - offsets[k])[0])
            t = held[1]
            common = len(np.intersect1d(s, t, assume_unique=True))
            keep.append(100 * common >= PERCENT * (len(s) + len(t) - common))
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["u", "v"])


def _fits(n: str, m: str) -> str:
    """SQL: sets of these sizes can reach the threshold."""
    return f"100 * least({n}, {m}) >= {PERCENT} * greatest({n}, {m})"


def _likely(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs (u, v) whose registers don't rule them out."""
    left = reps.select(F.col("rep").alias("u"), F.col("n_shingles").alias("n"), F.col("registers").alias("x"))
    right = reps.select(F.col("rep").alias("v"), F.col("n_shingles").alias("m"), F.col("registers").alias("y"))
    sized = pairs.join(left, "u").join(right, "v").where(_fits("n", "m")).select("u", "v", "n", "x", "m", "y")
    return sized.mapInArrow(_maybe, "u long, v long")


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, mark (a hash of the text: with doc_id it names a row) and text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")


def _placed(rows: DataFrame, rep: str, classes: DataFrame) -> DataFrame:
    """``rows`` with the names of the rows that stand for the classes in the column ``rep``."""
    return rows.join(classes.select(F.col("rep").alias(rep), F.col("own_id").alias(f"{rep}_id"), F.col("own_mark").alias(f"{rep}_mark")), rep)


def _with_text(placed: DataFrame, rep: str, texts: DataFrame, name: str) -> DataFrame:
    """Placed rows with the text that their names stand for."""
    named = texts.select("doc_id", "mark", F.col("text").alias(name))
    same = F.col(f"{rep}_id").eqNullSafe(F.col("doc_id")) & (F.col(f"{rep}_mark") == F.col("mark"))
    return placed.join(named, same).drop(f"{rep}_id", f"{rep}_mark", "doc_id", "mark")


def prefix_pairs(members: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (u, v), u > v, of ``members`` (rep, label) with different labels that can reach the
    threshold; exact. ``classes`` (rep, own_id, own_mark) name rows of ``texts`` (doc_id, mark, text)."""
    ship_package(members.sparkSession)
    rows = (_with_text(_placed(members.select("rep", "label"), "rep", classes), "rep", texts, "text").dropDuplicates(["rep"])
            .select("rep", "label", "text").mapInArrow(_shingle_rows, "rep long, label long, n long, shingle long"))
    often = rows.groupBy("shingle").agg(F.count("*").alias("often"))
    # a document's own shingles, so no more rows than its words
    order = Window.partitionBy("rep").orderBy("often", "shingle")
    prefix = (rows.join(often, "shingle").withColumn("place", F.row_number().over(order))
              .where(f"place <= n - ceil(n * {PERCENT} / 100) + 1 AND often > 1"))
    prefix = stored(prefix.select("shingle", "rep", "label", "n", "place"), "prefixes")
    by_label = prefix.groupBy("shingle", "label").agg(F.count("*").alias("size"))
    main = (by_label.groupBy("shingle").agg(F.max_by("label", F.struct("size", "label")).alias("main"), F.count("*").alias("labels"))
            .where("labels > 1").select("shingle", "main"))
    prefix = prefix.join(main, "shingle")
    # one of two documents with different labels isn't of the shingle's main label
    minor = prefix.where("label <> main").select("shingle", F.col("rep").alias("other"), F.col("label").alias("its"), F.col("n").alias("m"), F.col("place").alias("at"))
    enough = f"{100 + PERCENT} * (1 + least(n - place, m - at)) >= {PERCENT} * (n + m)"
    return (prefix.join(minor, "shingle").where(f"label <> its AND {_fits('n', 'm')} AND {enough}")
            .select(F.greatest("rep", "other").alias("u"), F.least("rep", "other").alias("v")).distinct())


def _confirmed(pairs: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (u, v) that are alike on their full sets."""
    # both rows are named before the first text comes in, so that texts are shuffled by nothing but those names
    both = _with_text(_with_text(_placed(_placed(pairs, "u", classes), "v", classes), "u", texts, "a"), "v", texts, "b")
    return both.select("u", "v", "a", "b").mapInArrow(_linked, "u long, v long")


def near_duplicate_rows(docs: DataFrame) -> DataFrame:
    """doc_id, mark, n_shingles, component (its number; null for an empty set), component_id and kept for each
    row of ``docs`` (doc_id, text), see ``near_duplicates``. Starts jobs."""
    ship_package(docs.sparkSession)
    texts = marked(docs)
    sketches = stored(texts.mapInArrow(_sketch, "doc_id long, mark long, n_shingles long, digest binary, registers binary"), "sketches")
    one = sketches.where("digest IS NOT NULL").groupBy("digest").agg(
        F.min("doc_id").alias("smallest"), F.min(F.struct("doc_id", "mark")).alias("own"), F.min("n_shingles").alias("n_shingles"))
    # numbers rise with the smallest doc_id: the first of a group of copies is the likeliest to be near them all
    classes = stored(one.orderBy(F.col("smallest").asc_nulls_last(), "own").select(F.monotonically_increasing_id().alias("rep"), "digest", "smallest", F.col("own.doc_id").alias("own_id"),
                                F.col("own.mark").alias("own_mark"), "n_shingles"), "classes")
    its = classes.select("rep", F.col("digest").alias("its"), "own_id", "own_mark")
    own = (sketches.digest == its.its) & sketches.doc_id.eqNullSafe(its.own_id) & (sketches.mark == its.own_mark)
    reps = sketches.join(its, own).select("rep", "n_shingles", "registers").dropDuplicates(["rep"])
    bins = reps.select("rep", "registers", "n_shingles").mapInArrow(_bins, "bin long, rep long, n long")
    counts = bins.groupBy("bin").agg(F.min("rep").alias("centre"), F.count("*").alias("size")).where("size > 1")
    shared = stored(bins.join(counts, "bin"), "bins")
    sizes = classes.select(F.col("rep").alias("v"), F.col("n_shingles").alias("m"))

    # those that meet their centre often; step 4 compares what is left out here
    stars = (shared.where("rep > centre").groupBy(F.col("rep").alias("u"), "n", F.col("centre").alias("v")).agg(F.count("*").alias("bins"))
             .where(f"bins >= greatest(1, least({OFTEN}, n div 2))").join(sizes, "v").where(_fits("n", "m")).select("u", "v"))
    links = stored(_confirmed(stored(_likely(stars, reps), "pairs"), classes, texts), "links")
    first = stored(components(links), "labels")

    labelled = shared.join(first, shared.rep == first.node, "left").select(
        "bin", "rep", "n", "centre", "size", F.coalesce("label", "rep").alias("label"))
    open_bins = labelled.groupBy("bin").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select("bin")
    left = stored(labelled.join(open_bins, "bin"), "open-bins")
    small = left.where(f"size <= {CROWD}")
    other = small.select("bin", F.col("rep").alias("v"), F.col("label").alias("its"), F.col("n").alias("m"))
    pairs = (small.join(other, "bin").where(f"rep > v AND label <> its AND {_fits('n', 'm')}")
             .select(F.col("rep").alias("u"), "v"))
    crowd = (left.where(f"size > {CROWD}").groupBy("rep", "label", "n").agg(F.count("*").alias("bins"))
             .where(f"bins > 1 OR n < {FEW}").select("rep", "label"))
    pairs = stored(pairs.union(prefix_pairs(crowd, classes, texts)).distinct(), "pairs")
    more = stored(_confirmed(stored(_likely(pairs, reps), "pairs"), classes, texts), "links")
    labels = stored(components(links.union(more)), "labels")

    numbered = classes.join(labels, classes.rep == labels.node, "left").select("digest", "smallest", F.coalesce("label", "rep").alias("component"))
    smallest = numbered.groupBy("component").agg(F.min("smallest").alias("component_id"))
    member = sketches.select("doc_id", "mark", "n_shingles", "digest").join(numbered.join(smallest, "component").drop("smallest"), "digest", "left")
    return member.select("doc_id", "mark", "n_shingles", "component", F.expr("if(component IS NULL, doc_id, component_id)").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable), kept (doc_id = component_id)
    for each row of ``docs`` (doc_id, text). Starts jobs."""
    return near_duplicate_rows(docs).select("doc_id", "n_shingles", "component_id", "kept")
