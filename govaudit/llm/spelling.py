"""Grouping of spelling variants with a trie of letter-group counts.

Letters are dealt to groups of about equal frequency. A word's vector is its
length, then how many of its letters are in each group. Words at an edit
distance of one differ in their vectors by at most one surplus and one deficit:
an inserted letter adds one to a group, a replaced one moves one. So the near
words of a word stand below the paths of the trie of vectors that spend a budget
of one surplus and one deficit. A pair is searched from the word with the smaller
vector, where the first difference is a surplus; a deficit can be spent after it.

The upper levels of the trie deal the words to tasks: a word is indexed under its
vector's first counts and sent to the parts that the budget reaches from there
(``parts``). The number of levels is the least with which no part indexes more
than ``PART`` words. In a part, numpy searches depth first: a frame holds many
searches at one level, is split when it is large, and the deepest frame is
expanded first, so what waits is bounded. A node with few words is a leaf; its
words are verified. A leaf of many words (same counts throughout) is matched by
the words without one letter instead of word by word. Each part reports per word
the number of near words and the best of them, not the pairs.

Words beyond ``PART`` with one and the same full vector would stay in one task;
that is the only part that levels can't split.

``corpus_words`` counts the words of texts, by chunks of text in numpy and then
in Spark. A null text has no words; a row without doc_id has an empty id in what
is hashed. Repeated rows count each time. No words give an empty table. Other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govaudit.llm.common import LOWER, slices, spread, stored, text_bytes
from govaudit.session import ship_package

CHUNK = 1 << 22  # bytes of text whose words are counted at a time
GROUPS, PART = 18, 150_000
LEAF, WIDE = 4, 64  # words of a node that is a leaf; words of a full leaf that is matched by shortened words
FRAME = 1 << 17  # searches in a frame
WIDTH = 48  # letters of words that are compared in a matrix; longer ones one by one
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True


def _crc_steps() -> np.ndarray:
    steps = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        steps = np.where(steps & 1, (steps >> 1) ^ np.uint32(0xEDB88320), steps >> 1)
    return steps


_CRC = _crc_steps()


def _crc32(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, begun: np.ndarray) -> np.ndarray:
    """crc32 of each stretch, going on from a crc32; stretches by falling length."""
    state = begun ^ np.uint32(0xFFFFFFFF)
    for k in range(int(lengths[0]) if len(lengths) else 0):
        n = int(np.searchsorted(-lengths, -k, "left"))  # those longer than k
        state[:n] = _CRC[(state[:n] ^ data[starts[:n] + k]) & np.uint32(255)] ^ (state[:n] >> np.uint32(8))
    return state ^ np.uint32(0xFFFFFFFF)


def _runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every run of A-Z, a-z and U+00C0 to U+00FF, and its code points. These take one byte, or two of which the first is C3."""
    second = np.zeros(len(data), dtype=bool)
    second[1:] = data[:-1] == 0xC3
    inside = np.append(_LETTER[data] | second | (data == 0xC3), False)
    first, last = inside[:-1].copy(), inside[:-1] & ~inside[1:]
    first[1:] &= ~inside[:-2]
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[begins] |= inside[begins]
    last[begins[begins > 0] - 1] |= inside[begins[begins > 0] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    points = np.append(0, np.cumsum(~second))
    return starts, ends, points[ends] - points[starts]


def _words_of(ids: list, data: np.ndarray, offsets: np.ndarray, least: int, drop: int) -> pa.Array:
    """The words of at least ``least`` code points of some texts, as a binary array."""
    starts, ends, points = _runs(data, offsets)
    owner = np.searchsorted(offsets, starts, "right") - 1
    keep = points >= least
    starts, ends, points, owner = starts[keep], ends[keep], points[keep], owner[keep]
    order = np.argsort(starts - ends, kind="stable")
    starts, ends, points, owner = starts[order], ends[order], points[order], owner[order]
    data = LOWER[data]
    raw = data.tobytes()
    named = np.array([zlib.crc32(b"%s:" % (b"" if i is None else str(i).encode())) for i in ids], dtype=np.uint32)[owner] if len(starts) else np.zeros(0, np.uint32)
    long = int(np.searchsorted(starts - ends, -64, "left"))  # those of more than 64 bytes come first
    hashes = np.concatenate([np.array([zlib.crc32(raw[s:e], int(h)) for s, e, h in zip(starts[:long].tolist(), ends[:long].tolist(), named[:long])], dtype=np.uint32),
                             _crc32(data, starts[long:], (ends - starts)[long:], named[long:])])
    cut = hashes % np.uint32(drop) == 0
    plain, lengths = starts[~cut], (ends - starts)[~cut]
    edited = []
    for s, e, h, n in zip(starts[cut].tolist(), ends[cut].tolist(), hashes[cut].tolist(), points[cut].tolist()):
        if n > least:
            word = raw[s:e].decode()
            edited.append((word[: h % n] + word[h % n + 1:]).encode())
    bounds = np.append(0, np.cumsum(lengths)).astype(np.int64)
    whole = pa.Array.from_buffers(pa.large_binary(), len(plain), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(data[spread(lengths, plain)].tobytes())])
    return pa.concat_arrays([whole, pa.array(edited, pa.large_binary())])


def _counted(least: int, drop: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            ids = batch.column(0).to_pylist()
            for a, b in slices(offsets, CHUNK):
                found = _words_of(ids[a:b], data[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a], least, drop)
                values = pc.value_counts(found)
                yield pa.RecordBatch.from_arrays([values.field(0).cast(pa.large_string()).cast(pa.string()), values.field(1)], names=["word", "n"])

    return count


def corpus_words(docs: DataFrame, least_points: int = 7, least: int = 2, drop: int = 31) -> DataFrame:
    """word, n: the lower-cased runs of letters (A-Z, a-z, U+00C0 to U+00FF) of ``docs`` (doc_id, text) with at least
    ``least_points`` code points and ``least`` occurrences. Where ``drop`` divides the crc32 h of "doc_id:run", the run
    loses its code point h modulo its length, which gives the corpus its misspellings."""
    ship_package(docs.sparkSession)
    counted = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_counted(least_points, drop), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One byte per code point (all are below U+0100), and n + 1 offsets."""
    data, offsets = text_bytes(words)
    lead = data == 0xC3
    second = np.append(False, lead)[: len(data)]
    return np.where(second, data + np.uint8(64), data)[~lead], np.append(0, np.cumsum(~lead))[offsets]


def letter_groups(words: DataFrame, groups: int = GROUPS) -> np.ndarray:
    """The group of each code point below U+0100: letters by falling frequency, each to the group with the fewest so far. Starts a job."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, dtype=np.int64)
        for batch in batches:
            total += np.bincount(_letters(batch.column(0))[0], minlength=256)
        yield pa.RecordBatch.from_pydict({"letter": np.arange(256), "n": total})

    found = words.select("word").mapInArrow(counted, "letter long, n long").groupBy("letter").agg(F.sum("n").alias("n")).collect()  # 256 rows
    group, load = np.zeros(256, dtype=np.int64), [0] * groups
    for r in sorted(found, key=lambda r: (-r.n, r.letter)):
        lightest = min(range(groups), key=load.__getitem__)
        group[r.letter] = lightest
        load[lightest] += r.n + 1
    return group


def vectors(words: pa.Array, group: np.ndarray) -> np.ndarray:
    """A row per word: its length, then its letters in each group."""
    letters, offsets = _letters(words)
    n, groups, lengths = len(offsets) - 1, int(group.max()) + 1, np.diff(offsets)
    counts = np.bincount(np.repeat(np.arange(n), lengths) * groups + group[letters], minlength=n * groups).reshape(n, groups)
    return np.concatenate([lengths[:, None], counts], axis=1)


def _reached(levels: int) -> np.ndarray:
    """The changes of a vector's first counts that the budget allows, first difference a surplus; the first row is no change."""
    steps = [np.zeros(levels, dtype=np.int64)]
    for longer in (0, 1):
        for plus in range(1, levels + 1):  # levels: a letter more further down
            for minus in ((levels,) if longer else (levels, *range(plus + 1, levels))):
                step = np.zeros(levels + 1, dtype=np.int64)
                step[0], step[plus] = longer, 1
                if minus < levels:
                    step[minus] = -1
                steps.append(step[:levels])
    return np.unique(np.array(steps), axis=0)


def _parted(group: np.ndarray, levels: int, searched: bool):
    steps = _reached(levels)
    still = ~steps.any(axis=1)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = vectors(batch.column(0), group)[:, :levels]
            for step, own in zip(steps, still.tolist()):
                if own or searched:
                    there = counts + step
                    real = np.flatnonzero((there >= 0).all(axis=1))
                    keys = pa.ListArray.from_arrays(np.arange(len(real) + 1, dtype=np.int32) * levels, there[real].astype(np.int32).ravel())
                    yield pa.RecordBatch.from_arrays([keys, pa.array(np.full(len(real), own)), batch.column(0).take(pa.array(real)), batch.column(1).take(pa.array(real))],
                                                     names=["part", "own", "word", "n"])

    return part


def parts(words: DataFrame, group: np.ndarray, levels: int, searched: bool = True) -> DataFrame:
    """part (a vector's first counts), own, word, n: every word in its own part, and (searched) in those that its budget reaches."""
    return words.select("word", "n").mapInArrow(_parted(group, levels, searched), "part array<int>, own boolean, word string, n long")


class Trie:
    """The trie of sorted vectors: a node at a level is a stretch of rows with equal first counts."""

    def __init__(self, sorted_vectors: np.ndarray):
        n, self.depth = sorted_vectors.shape
        self.width = int(sorted_vectors.max()) + 3 if n else 3
        new = np.zeros(n, dtype=bool)
        new[:1] = True
        parent = np.zeros(n, dtype=np.int64)
        self.keys, self.starts, self.ends = [], [], []
        for d in range(self.depth):
            new[1:] |= sorted_vectors[1:, d] != sorted_vectors[:-1, d]
            starts = np.flatnonzero(new)
            self.keys.append(parent[starts] * self.width + sorted_vectors[starts, d] + 1)
            self.starts.append(starts)
            self.ends.append(np.append(starts[1:], n))
            parent = np.cumsum(new) - 1

    def search(self, asked: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row of ``asked``, first and end row of a leaf) for leaves within the budget, a frame at a time."""
        nothing = np.zeros(len(asked), dtype=np.int64)
        stack = [(0, np.arange(len(asked)), nothing, nothing + 1, nothing + 1)]
        while stack:
            d, query, node, surplus, deficit = stack.pop()
            if len(query) > FRAME:
                half = len(query) // 2
                stack.append((d, *(x[:half] for x in (query, node, surplus, deficit))))
                stack.append((d, *(x[half:] for x in (query, node, surplus, deficit))))
                continue
            found = []
            for change in (0, 1, -1):
                may = np.ones(len(query), dtype=bool) if change == 0 else surplus == 1 if change == 1 else (deficit == 1) & (surplus == 0)
                if d == 0 and change == -1:
                    continue
                chosen = np.flatnonzero(may)
                key = node[chosen] * self.width + asked[query[chosen], d] + change + 1
                at = np.minimum(np.searchsorted(self.keys[d], key), len(self.keys[d]) - 1)
                hit = self.keys[d][at] == key
                chosen, at = chosen[hit], at[hit]
                more, less = surplus[chosen], deficit[chosen]
                if d == 0 and change == 1:
                    less = less * 0  # a longer word: one letter more, none less
                elif change == 1:
                    more = more - 1
                elif change == -1:
                    less = less - 1
                found.append((query[chosen], at, more, less))
            query, node, surplus, deficit = (np.concatenate(x) for x in zip(*found))
            low, high = self.starts[d][node], self.ends[d][node]
            leaf = (high - low <= LEAF) | (d == self.depth - 1)
            if leaf.any():
                yield query[leaf], low[leaf], high[leaf]
            if not leaf.all():
                stack.append((d + 1, query[~leaf], node[~leaf], surplus[~leaf], deficit[~leaf]))


class Words:
    """Words as bytes per code point, compared from both ends."""

    def __init__(self, letters: np.ndarray, offsets: np.ndarray):
        self.letters, self.offsets, self.lengths = letters, offsets, np.diff(offsets)
        n, short = len(offsets) - 1, np.minimum(np.diff(offsets), WIDTH)
        width = int(short.max()) if n else 0
        row, col = np.repeat(np.arange(n), short), spread(short, np.zeros(n, dtype=np.int64))
        self.ahead, self.back = np.zeros((n, width), np.uint8), np.zeros((n, width), np.uint8)
        self.ahead[row, col] = letters[spread(short, offsets[:-1])]
        self.back[row, col] = letters[np.repeat(offsets[1:] - 1, short) - col]

    def __getitem__(self, k: int) -> bytes:
        return self.letters[self.offsets[k]: self.offsets[k + 1]].tobytes()

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the words differ by exactly one inserted, deleted or replaced code point."""
        least, most = np.minimum(self.lengths[a], self.lengths[b]), np.maximum(self.lengths[a], self.lengths[b])
        out = (most - least <= 1) & (a != b)
        for k in range(0, len(a), 1 << 16):
            x, y = a[k: k + (1 << 16)], b[k: k + (1 << 16)]
            width = self.ahead.shape[1]
            equal = np.zeros(len(x), dtype=np.int64)
            for side in (self.ahead, self.back):
                differ = side[x] != side[y]
                equal += np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), width), least[k: k + (1 << 16)])
            out[k: k + (1 << 16)] &= (equal >= most[k: k + (1 << 16)] - 1) & ~((most == least)[k: k + (1 << 16)] & (equal >= 2 * least[k: k + (1 << 16)]))
        for k in np.flatnonzero((most > WIDTH) & (most - least <= 1)).tolist():
            out[k] = _near(self[a[k]], self[b[k]])
        return out


def _near(a: bytes, b: bytes) -> bool:
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a != b and len(b) - len(a) <= 1 and a[k + (len(a) == len(b)):] == b[k + 1:]


def _shortened(words: Words, queries: list[int], low: int, high: int) -> tuple[list[int], list[int]]:
    """Candidates in a wide leaf: words that are the same without one code point."""
    book: dict[bytes, list[int]] = {}
    for t in range(low, high):
        word = words[t]
        for short in {word[:k] + word[k + 1:] for k in range(len(word))}:
            book.setdefault(short, []).append(t)
    left, right = [], []
    for q in queries:
        word = words[q]
        found = set(book.get(word, ())).union(*(book.get(s, ()) for s in {word[:k] + word[k + 1:] for k in range(len(word))}))
        left += [q] * len(found)
        right += found
    return left, right


def near_words(words: Words, counts: np.ndarray, own: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of near words: the first ``own`` rows (sorted by vector) are indexed, all are searched. A pair of indexed words comes once."""
    if not own:
        return
    trie = Trie(counts[:own])
    for query, low, high in trie.search(counts):
        wide = high - low > WIDE
        spans, asked = [(query[~wide], low[~wide], (high - low)[~wide])], np.flatnonzero(wide)
        pairs = [(np.repeat(q, n), spread(n, s)) for q, s, n in spans]
        asked = asked[np.argsort(low[asked], kind="stable")]
        for same in np.split(asked, np.flatnonzero(np.diff(low[asked])) + 1) if len(asked) else []:
            left, right = _shortened(words, query[same].tolist(), int(low[same[0]]), int(high[same[0]]))
            pairs.append((np.array(left, dtype=np.int64), np.array(right, dtype=np.int64)))
        for a, b in pairs:
            once = (a >= own) | (a < b)
            a, b = a[once], b[once]
            a, b = a[(words.lengths[b] >= words.lengths[a])], b[(words.lengths[b] >= words.lengths[a])]
            hit = words.near(a, b)
            yield a[hit], b[hit]


def _searched(group_of: np.ndarray):
    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])

    def search(table: pa.Table) -> pa.Table:
        column = pa.concat_arrays(table["word"].chunks)
        counts, mine = vectors(column, group_of), table["own"].to_numpy(zero_copy_only=False).astype(bool)
        order = np.lexsort((*counts.T[::-1], ~mine))
        column, counts = column.take(pa.array(order)), counts[order]
        n = table["n"].to_numpy()[order]
        found = list(near_words(Words(*_letters(column)), counts, int(mine.sum())))
        a, b = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        who, other = np.concatenate([a, b]), np.concatenate([b, a])
        first = pc.rank(column, sort_keys="ascending", tiebreaker="dense").to_numpy().astype(np.int64) if len(column) else np.zeros(0, np.int64)
        best = np.lexsort((first[other], -n[other], who))
        who, other = who[best], other[best]
        heads = np.flatnonzero(np.append(True, who[1:] != who[:-1])) if len(who) else np.zeros(0, np.int64)
        return pa.table([column.take(pa.array(who[heads])), pa.array(np.diff(np.append(heads, len(who)))), pa.array(n[other[heads]]), column.take(pa.array(other[heads]))], schema=schema)

    return search


def near_counts(words: DataFrame, groups: int = GROUPS, part: int = PART) -> DataFrame:
    """word, n_near, best (struct of n and word): for every word with near words. Starts jobs; ``words`` (word, n) is read several times."""
    group = letter_groups(words, groups)
    for levels in range(1, groups + 2):
        sizes = parts(words, group, levels, searched=False).groupBy("part").count()
        if levels == groups + 1 or (sizes.agg(F.max("count")).first()[0] or 0) <= part:
            break
    found = parts(words, group, levels).groupBy("part").applyInArrow(_searched(group), "word string, n_near long, best_n long, best string")
    return (found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("first"))
            .select("word", "n_near", F.expr("named_struct('n', -first.less, 'word', first.best)").alias("best")))


def roots(forms: DataFrame) -> DataFrame:
    """word, root for ``forms`` (word, form): forms followed to the last. Each form is much more frequent than its word, so
    chains are short; a round per step, with those still on their way. Starts jobs."""
    forms = forms.select("word", "form")
    step = forms.select(F.col("word").alias("here"), F.col("form").alias("there"))
    going, done = stored(forms.select("word", F.col("form").alias("root")), "roots"), []
    while not going.isEmpty():
        now = stored(going.join(step, F.col("root") == F.col("here"), "left").select("word", "root", "there"), "roots")
        done.append(now.where("there IS NULL").select("word", "root"))
        going = now.where("there IS NOT NULL").select("word", F.col("there").alias("root"))
    out = forms.select("word", F.col("form").alias("root")).limit(0)
    for part in done:
        out = out.unionByName(part)
    return out


def variants(words: DataFrame, ratio: int = 10, groups: int = GROUPS, part: int = PART) -> DataFrame:
    """word, form, root, n, n_near, form_n for each row of ``words`` (word, n; words distinct). Starts jobs.

    form: the near word of largest n (ties: the first in code-point order), if its n is at least ``ratio`` times the word's.
    """
    found = near_counts(words, groups, part)
    formed = stored(words.join(found, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.expr(f"if(best.n >= {ratio} * n, best, null)").alias("best")), "forms")
    last = roots(formed.where("best IS NOT NULL").select("word", F.col("best.word").alias("form")))
    return formed.join(last, "word", "left").select(
        "word", F.col("best.word").alias("form"), F.coalesce("root", "word").alias("root"), "n", "n_near", F.col("best.n").alias("form_n"))
