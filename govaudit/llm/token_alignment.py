"""Alignment of two tokenizers' tokens by the bytes they stand for.

A stretch's tokens of both tokenizers are intervals of its bytes. Interval
coalescing puts them into groups: all intervals are sorted by start (lexsort),
``maximum.accumulate`` carries the ends, and a group breaks where a start reaches
the running maximum, that is where tokens of both end. Within a group the
overlapping pairs are expanded: the B tokens that an A token meets are a stretch
of the group, found by binary search.

Texts are cut into stretches before a space that follows anything but white
space; the tokens of both tokenizers end there (``Aligner`` checks that no piece
of B has a space inside), so a text's alignment is that of its stretches one
after the other. Each distinct stretch of a chunk of text is aligned once, and
workers remember some; equal stretches are found by their bytes.

``aligned`` writes one row per document with its links; ``pair_counts`` counts
them over the corpus, map-side first. Of two tokens that end together one is a
suffix of the other, so there are at most as many id pairs as bytes in both
vocabularies (times the ids that stand for equal bytes): that table has a proven
bound and is broadcast. Nothing else leaves the tasks but those counts. A task
holds a chunk of text or a single longer text, and about 100 bytes per token of
it.

A null or empty text, and one whose joined token bytes differ from a space and
the text, has no tokens. Repeated rows count each time. Rows without doc_id are
like others. Other columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govaudit.llm.common import slices, spread, stored, text_bytes
from govaudit.llm.subwords import byte_letters, stretch_starts
from govaudit.session import ship_package

CHUNK, REMEMBERED, LEARNED = 1 << 20, 300_000, 4096  # bytes of text aligned at a time; stretches that a worker remembers, and aligns at a time
TOGETHER = 64  # stretches that A encodes as one text, at most
LINK = np.dtype([("a", "<u4"), ("b", "<u4")])


def coalesce(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the intervals by start, and the group number of each interval in that order: a group ends where the next start
    reaches the largest end so far."""
    order = np.lexsort((ends, starts))
    if not len(order):
        return order, order
    reach = np.maximum.accumulate(ends[order])
    return order, np.cumsum(np.append(False, starts[order][1:] >= reach[:-1]))


def overlaps(a_starts: np.ndarray, a_ends: np.ndarray, b_starts: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of overlapping intervals; both lists are gapless and ascend."""
    low, high = np.searchsorted(b_ends, a_starts, "right"), np.searchsorted(b_starts, a_ends, "left")
    n = np.maximum(high - low, 0)
    return np.repeat(np.arange(len(a_starts)), n), spread(n, low)


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids, and how many each list has."""
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(n.sum())), n


def _joined(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens' bytes, one after the other, and each one's start and length."""
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(lengths) - lengths, lengths


def _spells(ids: np.ndarray, n: np.ndarray, side: tuple[np.ndarray, np.ndarray, np.ndarray], raw: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether each stretch's tokens (n of ``ids``) spell its bytes (sizes of ``raw``)."""
    data, starts, lengths = side
    running = np.append(0, np.cumsum(lengths[ids]))
    same = np.diff(running[np.append(0, np.cumsum(n))]) == sizes
    mine = ids[np.repeat(same, n)]
    wrong = data[spread(lengths[mine], starts[mine])] != raw[np.repeat(same, sizes)]
    running = np.append(0, np.cumsum(wrong))
    same[same] = np.diff(running[np.append(0, np.cumsum(sizes[same]))]) == 0
    return same


class Aligner:
    """Two tokenizer files: A for the tokenizers library (byte-level), B for sentencepiece (byte fallback, space in front)."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        byte_of = {letter: byte for byte, letter in byte_letters().items()}
        names = {i: x for x, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.a_bytes = [bytes(byte_of[c] for c in names[i]) if all(c in byte_of for c in names.get(i, "\0")) else b"" for i in range(max(names) + 1)]
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(pieces)]
        self.sides = [_joined(self.a_bytes), _joined(self.b_bytes)]
        # a token of the groups' text by its number: A's ids, then B's, each before another token of its side and as the last of its group
        self.written = [f"{i}{x}" for n, last in ((len(self.a_bytes), "|"), (len(self.b_bytes), ";")) for i in range(n) for x in (",", last)]
        #: No piece has a space behind other characters, so no token crosses a cut.
        self.cuttable = not any("▁" in x.lstrip("▁") for x in pieces)
        self.known: dict[bytes, int] = {}
        self.clear()

    def clear(self) -> None:
        """Forgets all stretches."""
        self.known.clear()
        self.counts = np.zeros((1 << 12, 3), dtype=np.int64)  # n_a, n_b, n_groups of a stretch; n_a is -1 for one that doesn't come back
        self.texts: list[str] = []  # its groups
        self.links: list[bytes] = []

    def _a_ids(self, texts: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A's ids of all stretches and how many each has. Neighbours are encoded together, as they might stand in a text:
        a cut is before a space that follows no white space."""
        apart = np.array([k % TOGETHER == 0 or x[-1].isspace() for k, x in enumerate(["  ", *texts[:-1]])])
        edges = [*np.flatnonzero(apart).tolist(), len(texts)]
        found = self.a.encode_batch_fast(["".join(texts[x:y]) for x, y in zip(edges, edges[1:])], add_special_tokens=False)
        flat = np.fromiter(chain.from_iterable(e.ids for e in found), np.int64)
        ends, goals = np.cumsum(self.sides[0][2][flat]), np.cumsum(sizes)
        bounds = np.searchsorted(ends, goals, "right")
        if len(flat) and bounds[0] and bounds[-1] == len(flat) and (ends[bounds - 1] == goals).all():
            return flat, np.diff(bounds, prepend=0)
        return _flat([e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)])

    def learn(self, stretches: list[bytes]) -> None:
        """Aligns new stretches, all at once. Each begins with a space."""
        texts = [x.decode("utf-8", "replace") for x in stretches]
        raw, sizes = np.frombuffer(b"".join(stretches), np.uint8), np.fromiter(map(len, stretches), np.int64, len(stretches))
        b = self.b.encode([x[1:] for x in texts], num_threads=1)
        b = [q if len(x) > 1 else [self.b.piece_to_id("▁")] for x, q in zip(texts, b)]  # a space at a text's end
        coded = [self._a_ids(texts, sizes), _flat(b)]
        whole = np.logical_and(*[_spells(ids, n, side, raw, sizes) for (ids, n), side in zip(coded, self.sides)])
        sides = []
        for (ids, n), (_, _, lengths) in zip(coded, self.sides):
            ids, n = ids[np.repeat(whole, n)], n[whole]
            ends = np.cumsum(lengths[ids])
            sides.append((ids, ends - lengths[ids], ends, np.append(0, np.cumsum(n))))
        (a_ids, a_starts, a_ends, a_bounds), (b_ids, b_starts, b_ends, b_bounds) = sides
        starts, ends = np.concatenate([a_starts, b_starts]), np.concatenate([a_ends, b_ends])
        order, group = coalesce(starts, ends)
        group_of = np.empty(len(order), dtype=np.int64)
        group_of[order] = group
        left, right = overlaps(a_starts, a_ends, b_starts, b_ends)
        together = a_ends[left] == b_ends[right]  # of the overlapping pairs, those that end together
        left, right = left[together], right[together]
        links = np.empty(len(left), dtype=LINK)
        links["a"], links["b"] = a_ids[left], b_ids[right]
        links, link_bounds = links.tobytes(), (np.searchsorted(left, a_bounds) * LINK.itemsize).tolist()
        last = np.concatenate([np.diff(x, append=-1) != 0 for x in (group_of[: len(a_ids)], group_of[len(a_ids):])])
        tokens = (np.concatenate([a_ids, b_ids + len(self.a_bytes)]) * 2 + last)[np.argsort(group_of, kind="stable")]  # by group, A's before B's
        written = list(map(self.written.__getitem__, tokens.tolist()))
        bounds = (a_bounds + b_bounds).tolist()
        firsts = np.append(group_of[a_bounds[:-1]], group[-1] + 1 if len(group) else 0)  # each stretch's first group
        at = len(self.texts)
        while at + len(stretches) > len(self.counts):
            self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
        new = self.counts[at: at + len(stretches)]
        new[:] = (-1, 0, 0)
        new[whole] = np.stack([np.diff(a_bounds), np.diff(b_bounds), np.diff(firsts)], axis=1)
        which = iter(range(len(bounds)))
        for k, (x, ok) in enumerate(zip(stretches, whole.tolist())):
            self.known[x] = at + k
            j = next(which) if ok else None
            self.texts.append("".join(written[bounds[j]: bounds[j + 1]])[:-1] if ok else "")
            self.links.append(links[link_bounds[j]: link_bounds[j + 1]] if ok else b"")

    def align(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple]:
        """(n_a, n_b, n_groups, groups, links) per text; zeros and empty where a text has no tokens."""
        n = len(offsets) - 1
        sizes = np.diff(offsets)
        full = np.flatnonzero(sizes > 0)
        spaced = np.full(len(data) + len(full), 32, dtype=np.uint8)  # a space before each text
        before = np.cumsum(sizes > 0)
        bounds = offsets + np.append(0, before)
        where = np.repeat(before, sizes) + np.arange(len(data))
        spaced[where] = data
        starts = stretch_starts(spaced, bounds)
        begin = np.zeros(len(spaced) + 1, dtype=bool)
        begin[bounds] = True
        starts = starts[(spaced[starts] == 32) & self.cuttable | begin[starts]]
        edges = np.append(starts, len(spaced)).astype(np.int64)
        column = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges.tobytes()), pa.py_buffer(spaced.tobytes())])
        coded = column.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.texts) > REMEMBERED:
            self.clear()
        new = [x for x in distinct if x not in self.known]
        for k in range(0, len(new), LEARNED):
            self.learn(new[k: k + LEARNED])
        numbers = list(map(self.known.__getitem__, distinct))
        texts, links = (list(map(x.__getitem__, numbers)) for x in (self.texts, self.links))
        which = coded.indices.to_numpy()
        first = np.searchsorted(starts, bounds)
        counts = self.counts[np.array(numbers, dtype=np.int64)]
        counts = np.concatenate([counts, counts[:, :1] < 0], axis=1)
        totals = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(counts[which], axis=0)])
        totals = (totals[first[1:]] - totals[first[:-1]]).tolist()
        out = []
        which, first = which.tolist(), first.tolist()
        for k in range(n):
            mine = which[first[k]: first[k + 1]]
            if not mine or totals[k][3]:  # a stretch that doesn't come back
                out.append((0, 0, 0, "", b""))
            else:
                out.append((*totals[k][:3], ";".join(map(texts.__getitem__, mine)), b"".join(map(links.__getitem__, mine))))
        return out


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """This worker's aligner for two files."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = Aligner(a_path, b_path)
    return _aligners[a_path, b_path]


def _rows(a_path: str, b_path: str, as_text: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = aligner(a_path, b_path)
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for x, y in slices(offsets, CHUNK):
                found = mine.align(data[offsets[x]: offsets[y]], offsets[x: y + 1] - offsets[x])
                groups = [f[3] if as_text or not f[3] else hashlib.sha256(f[3].encode()).hexdigest() for f in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(x, y - x), *(pa.array([f[k] for f in found], pa.int64()) for k in range(3)), pa.array(groups, pa.string()),
                     pa.array([f[4] for f in found], pa.binary())], names=["doc_id", "n_a", "n_b", "n_groups", "groups", "links"])

    return rows


def aligned(docs: DataFrame, a_path: str, b_path: str, as_text: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups, links for each row of ``docs`` (doc_id, text).

    groups: `a1,a2|b1;a3|b2` in order, or its SHA-256 in hexadecimal (as_text
    false); '' without tokens. links: the pairs of tokens that end together, as
    unsigned 32-bit ids, A's and B's in turn.
    """
    ship_package(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _rows(a_path, b_path, as_text), "doc_id long, n_a long, n_b long, n_groups long, groups string, links binary")


def pair_counts(links: DataFrame) -> DataFrame:
    """a, b, n: how many links of the corpus hold an id pair."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, _ = text_bytes(batch.column(0))
            pairs, n = np.unique(np.frombuffer(data.tobytes(), "<u8"), return_counts=True)  # A's id is the lower half
            yield pa.RecordBatch.from_pydict({"a": (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64), "b": (pairs >> np.uint64(32)).astype(np.int64), "n": n})

    return links.select("links").mapInArrow(count, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _scored(shared):
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = shared.value
        for batch in batches:
            data, offsets = text_bytes(batch.column(5))
            sums = []
            for x, y in slices(offsets, CHUNK):
                codes = np.frombuffer(data[offsets[x]: offsets[y]].tobytes(), "<u8")
                at = np.searchsorted(pairs, codes)
                bounds = (offsets[x: y + 1] - offsets[x]) // LINK.itemsize
                running = [np.append(0, np.cumsum(v[at] if len(at) else np.zeros(0, np.int64)))[bounds] for v in (n, best)]
                sums.append([np.diff(bounds), *(np.diff(r) for r in running)])
            n_links, count_sum, n_best = (np.concatenate([s[k] for s in sums]) if sums else np.zeros(0, np.int64) for k in range(3))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(n_links.astype(np.int64)), pa.array(n_best.astype(np.int64)), pa.array(count_sum.astype(np.int64)), batch.column(4)],
                                             names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])

    return scored


def align_documents(docs: DataFrame, a_path: str, b_path: str, as_text: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups for each row of ``docs`` (doc_id, text). Starts jobs.

    n_best: links whose pair is the most frequent of its B id (ties count).
    count_sum: the links' counts added up.
    """
    spark = docs.sparkSession
    rows = stored(aligned(docs, a_path, b_path, as_text), "aligned")
    counts = pair_counts(rows).toPandas()  # bounded by the vocabularies, see above
    codes = counts["a"].to_numpy(np.uint64) | counts["b"].to_numpy(np.uint64) << np.uint64(32)
    order = np.argsort(codes)
    most = counts.groupby("b")["n"].transform("max").to_numpy()
    n = counts["n"].to_numpy(np.int64)
    shared = spark.sparkContext.broadcast((codes[order], n[order], (n == most)[order].astype(np.int64)))
    return rows.mapInArrow(_scored(shared), "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")
