"""Language-model scores by a causal self-attention model over subword ids.

* **Tokens.** Texts are lower-cased (A-Z) and split into words; a word's subword
  ids are those of a byte-level BPE for a space and the word; each text ends with
  one end id. Each distinct word is encoded once (``word_table``). The training
  documents are those whose crc32(doc_id as text) modulo 7 isn't 2.
* **Counts** cover every training document: of words (for the base score), of subword
  ids, and of the classes that follow each frequent id and each pair of classes.
* **Model.** Ids fall into ``CLASSES`` classes by the company they keep. The network
  predicts the next id's class; within its class an id has its share of the counts
  (plus ``SMOOTH``): p(id | context) = p(class | context) p(id | class).
  The network: embeddings of class, of the ``OWN`` most frequent ids, and of
  position; one causal attention head with a residual, each place with a query of its
  own; a softmax over all classes. What the counts say of the last id and the last two
  classes is added before the softmax; they take no place of the network. It is written
  in numpy.
* **Training.** ``ROUNDS`` passes over the windows of every training document. In each,
  every task takes Adam steps over its windows (those of about ``PART`` ids in memory at
  a time) from common weights; Spark averages the weights, by the number of windows. The
  first pass starts from weights that one task learns from the first chunk's documents:
  weights that start apart don't average well. What a task holds depends on the
  partitioning, and so do the averages, not what is learned from.
* **Scoring.** Windows of ``WINDOW`` ids overlap by ``CONTEXT``: those only serve
  as context, so every id is scored once. Many windows go through masked attention
  at a time.

A word's probability is an even mixture of the product of its subwords'
probabilities and its own share of the training words (unknown: that of base), with
the end of text as a word. A text's probability is an even mixture again, of the
product over its words and of the base model's: where a corpus is too small to train
on, a text loses no more than a factor of two. The score is its logarithm (base 10).

The driver holds weights and per-id counts, whose size the vocabulary bounds.
A null text is empty: it has the end alone. Without training documents every
class and id is equally likely.
"""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govaudit.llm.common import slices, spread, stored
from govaudit.llm.subwords import SubwordTable
from govaudit.llm.word_table import answered, packed, split_lists, unpacked, with_answers, word_chunks

CLASSES, OWN, WIDTH = 64, 1024, 16
BEFORE, PAIRS = OWN + CLASSES + 1, (CLASSES + 1) ** 2  # rows of the tables of shares
WINDOW, CONTEXT = 64, 8
ROUNDS, BATCH, STEP = 2, 128, 32  # BATCH, STEP: windows scored and learned from at a time
RATE, SLOWER = 0.03, 128  # steps after which a task's learning rate has fallen by the square root of two
PART = 1 << 18  # ids of training documents that a task takes windows of at a time
SMOOTH, BACK = 0.5, 5
CHUNK = 1 << 22  # bytes of text that a task scores at a time
FACES = 64  # most frequent ids whose neighbourhood describes an id
END = 50256


def trained_on(doc_id) -> bool:
    """Whether a document is learned from; one without id is."""
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 7 != 2


_encoders: dict[str, SubwordTable] = {}


def _answer(path: str):
    """For each list the words' counts over all lists, and their ids."""
    def answer(group: pa.Table) -> pa.Table:
        if path not in _encoders:
            _encoders[path] = SubwordTable(path)
        encoder = _encoders[path]
        lists = split_lists(group)
        counts = [np.frombuffer(unpacked(x), "<u4").astype(np.int64) for x in group["counts"].to_pylist()]
        number: dict[bytes, int] = {}
        places = [np.array([number.setdefault(w, len(number)) for w in x], dtype=np.int64) for x in lists]
        total = np.zeros(len(number), dtype=np.int64)
        for at, n in zip(places, counts):
            np.add.at(total, at, n)
        ids = [encoder.ids_of(" " + w.decode("utf-8", "replace")) for w in number]
        encoder.words.clear()
        lengths = np.array([len(x) for x in ids], dtype=np.int64)
        flat = np.fromiter((y for x in ids for y in x), dtype=np.int64, count=int(lengths.sum()))
        firsts = np.cumsum(lengths) - lengths
        out = []
        for at in places:
            n = lengths[at]
            out.append(packed(np.concatenate([np.array([len(at)]), total[at], n, flat[spread(n, firsts[at])]]).astype("<u4").tobytes(), 3))
        # the bucket's own sums, under no chunk: words, distinct words, counts of ids
        used = np.bincount(flat, np.repeat(total, lengths), minlength=END + 1).astype("<i8") if len(flat) else np.zeros(END + 1, "<i8")
        out.append(packed(np.concatenate([np.array([total.sum(), (total > 0).sum()], "<i8"), used]).tobytes()))
        bucket = group["bucket"].to_pylist()
        return pa.table({"chunk": pa.array([*group["chunk"].to_pylist(), None], pa.int64()), "bucket": pa.array([*bucket, bucket[0]], pa.int64()),
                         "answer": pa.array(out, pa.binary())})

    return answer


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of all buckets of a task; -1: words, -2: distinct words, else the count of an id."""
    total = np.zeros(END + 3, dtype=np.int64)
    for batch in batches:
        for raw in batch.column(0).to_pylist():
            total += np.frombuffer(unpacked(raw), "<i8")
    keys = np.append([-1, -2], np.arange(END + 1))
    some = total > 0
    yield pa.RecordBatch.from_arrays([pa.array(keys[some]), pa.array(total[some])], names=["key", "n"])


def _ids(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk: words' counts and numbers of ids by place, places, words a document, all subword ids with
    an end id after each document, and their bounds."""
    counts, lengths, flats = [], [], []
    for raw in row["answers"]:
        values = np.frombuffer(unpacked(raw), "<u4").astype(np.int64)
        n = int(values[0])
        counts.append(values[1: 1 + n])
        lengths.append(values[1 + n: 1 + 2 * n])
        flats.append(values[1 + 2 * n:])
    count, length, flat = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (counts, lengths, flats))
    places = np.frombuffer(unpacked(row["places"]), "<u4").astype(np.int64)
    n_words = np.array(row["n_words"], dtype=np.int64)
    each = length[places] if len(places) else np.zeros(0, np.int64)
    firsts = (np.cumsum(length) - length)[places] if len(places) else np.zeros(0, np.int64)
    stream = flat[spread(each, firsts)]
    running = np.append(0, np.cumsum(each))
    words = np.append(0, np.cumsum(n_words))
    sizes = np.diff(running[words]) + 1
    bounds = np.append(0, np.cumsum(sizes))
    ids = np.full(int(bounds[-1]), END, dtype=np.int64)
    ids[spread(sizes - 1, bounds[:-1])] = stream
    return count, each, places, n_words, ids, bounds


def windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For documents of these sizes each window's document and start. The first begins at 0 and scores all its
    ids, the others score those after their first CONTEXT."""
    counts = 1 + np.maximum(0, -(-(sizes - WINDOW) // (WINDOW - CONTEXT)))
    return np.repeat(np.arange(len(sizes)), counts), spread(counts, np.zeros(len(sizes), np.int64)) * (WINDOW - CONTEXT)


class Network:
    """Weights as a list of float32 arrays, in a fixed order.

    ``lead``: how many places at the front of each window only serve as context. ``table``: log-shares of the classes
    after each frequent id or class, and what a pair of classes adds to them (``_shares``); the network adds to both."""

    SHAPES = [(CLASSES + 1, WIDTH), (OWN + 1, WIDTH), (WINDOW, WIDTH), (WIDTH, WIDTH), (WIDTH, WIDTH), (WIDTH, WIDTH), (WIDTH, WIDTH),
              (WIDTH, CLASSES), (CLASSES,)]

    @classmethod
    def start(cls, prior: np.ndarray) -> list[np.ndarray]:
        rng = np.random.default_rng(8)
        out = [(rng.standard_normal(s) * (0.3 if k < 3 else WIDTH**-0.5)).astype(np.float32) for k, s in enumerate(cls.SHAPES)]
        out[7] *= np.float32(0.1)  # the classes' shares at first
        out[8] = np.log(prior).astype(np.float32)
        return out

    @staticmethod
    def states(w: list[np.ndarray], classes: np.ndarray, own: np.ndarray, lead: int = 0) -> tuple:
        """The states (a row for each place after ``lead``) that tell the next class, and what led to them; classes and
        own are those of the ids before: place 0 has none (CLASSES, OWN). Context gives keys and values only."""
        n, t = classes.shape
        x = w[0].take(classes, axis=0)
        x += w[1].take(own, axis=0)
        x += w[2][:t]
        late = np.ascontiguousarray(x[:, lead:])
        kv = _flat(x) @ np.concatenate([w[4], w[5]], axis=1)
        k, v = (kv[:, j: j + WIDTH].reshape(n, t, WIDTH) for j in (0, WIDTH))
        q = (_flat(late) @ (w[3] * x.dtype.type(WIDTH**-0.5))).reshape(late.shape)
        e = q @ k.transpose(0, 2, 1)
        _exponentials(e, _seen(lead, t))
        r = 1 / _sums_of_rows(_flat(e))
        u = _flat(e @ v)
        u *= r  # cheaper than to divide e
        return _flat(late) + u @ w[6], x, late, q, k, v, e, r, u

    @staticmethod
    def _told(w: list[np.ndarray], h: np.ndarray, before: list[np.ndarray], table: list | None) -> np.ndarray:
        """Of states: values of all classes."""
        z = h @ w[7]
        z += w[8]
        for shares, row in zip(table or [], before):
            z += shares.take(row, axis=0)
        return z

    @classmethod
    def forward(cls, w: list[np.ndarray], classes: np.ndarray, own: np.ndarray) -> tuple[np.ndarray]:
        """Log-probabilities (windows, WINDOW, CLASSES) of the class at each place from the places before it."""
        z = cls._told(w, cls.states(w, classes, own)[0], [], None)
        z -= z.max(-1, keepdims=True)
        z -= np.log(np.exp(z).sum(-1, keepdims=True))
        return (z.reshape(*classes.shape, CLASSES),)

    @classmethod
    def told(cls, w: list[np.ndarray], classes: np.ndarray, own: np.ndarray, target: np.ndarray, used: np.ndarray, lead: int = 0,
             table: list | None = None) -> np.ndarray:
        """Log-probabilities of the classes in ``target`` at the places in ``used`` after ``lead``, in order."""
        at = np.flatnonzero(used[:, lead:])
        before = [x[:, lead:].ravel()[at] for x in (_before(classes, own), _pairs(classes))] if table else []
        z = cls._told(w, cls.states(w, classes, own, lead)[0].take(at, axis=0), before, table)
        return _log_shares(z, np.arange(len(at)), target[:, lead:].ravel()[at])

    @classmethod
    def gradients(cls, w: list[np.ndarray], classes: np.ndarray, own: np.ndarray, target: np.ndarray, used: np.ndarray, lead: int = 0,
                  table: list | None = None, class_of: np.ndarray | None = None) -> list[np.ndarray]:
        """Of the mean loss over the places in ``used`` after ``lead``. class_of: the class of each frequent id, where
        these have one."""
        h, x, late, q, k, v, e, r, u = cls.states(w, classes, own, lead)
        kind = x.dtype.type
        at = np.flatnonzero(used[:, lead:])  # padding has no loss of its own
        before = [y[:, lead:].ravel()[at] for y in (_before(classes, own), _pairs(classes))] if table else []
        told = h.take(at, axis=0)
        z = cls._told(w, told, before, table)
        g, each = [np.zeros(shape, x.dtype) for shape in cls.SHAPES], kind(1 / max(1, len(at)))
        _exponentials(z)
        z *= each / _sums_of_rows(z)
        z.ravel()[np.arange(len(at)) * CLASSES + target[:, lead:].ravel()[at]] -= each
        g[7], g[8] = told.T @ z, np.ones(len(at), x.dtype) @ z
        dtold = z @ w[7].T
        if len(at) == len(h):
            dh = dtold
        else:
            dh = np.zeros_like(h)
            dh[at] = dtold
        g[6] = u.T @ dh
        du = dh @ w[6].T
        du *= r
        ds = du.reshape(q.shape) @ v.transpose(0, 2, 1)
        ds -= _sums_of_rows(du * u).reshape(*q.shape[:2], 1)  # for each row that of ds * e
        ds *= e
        dq = _flat(ds @ k)
        dq *= kind(WIDTH**-0.5)  # q holds the factor of the products; its own gradient needs it once more
        dk, dv = _flat(ds.transpose(0, 2, 1) @ q), _flat(e.transpose(0, 2, 1) @ du.reshape(q.shape))
        g[3], g[4], g[5] = _flat(late).T @ dq, _flat(x).T @ dk, _flat(x).T @ dv
        dx = dk @ w[4].T
        dx += dv @ w[5].T
        dx = dx.reshape(x.shape)
        dx[:, lead:] += (dh + dq @ w[3].T).reshape(late.shape)
        flat = _flat(dx)
        g[1] = _row_sums(own.ravel(), flat, OWN + 1)
        if class_of is None:
            g[0] = _row_sums(classes.ravel(), flat, CLASSES + 1)
        else:  # sums of frequent ids are those of their classes
            rare = np.flatnonzero(own.ravel() == OWN)
            g[0] = _row_sums(np.append(class_of, classes.ravel()[rare]), np.concatenate([g[1][:OWN], flat[rare]]), CLASSES + 1)
        g[2][: dx.shape[1]] = dx.sum(0)
        return g


def _row_sums(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """For each of n numbers the sum of the rows that have it in ``index``."""
    cells = np.arange(n * rows.shape[1]).reshape(n, -1).take(index, axis=0)
    return np.bincount(cells.ravel(), rows.ravel(), minlength=n * rows.shape[1]).reshape(n, -1).astype(rows.dtype)


def _pairs(classes: np.ndarray) -> np.ndarray:
    """The numbers of the pairs of classes before each place of windows."""
    out = classes.astype(np.int64)
    out[:, 1:] += classes[:, :-1] * np.int64(CLASSES + 1)
    out[:, 0] += CLASSES * (CLASSES + 1)
    return out


def _before(classes: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The row of the table of shares: that of the id before, or of its class if it isn't frequent."""
    return np.where(own < OWN, own, OWN + classes).astype(np.int64)


def _log_shares(z: np.ndarray, rows: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Log-probabilities of the chosen columns; z is used up."""
    if z.size and max(z.max(), -z.min()) > 40:
        z -= z.max(-1, keepdims=True)
    out = z.ravel().take(rows * z.shape[1] + chosen)
    np.exp(z, out=z)
    out -= np.log(_sums_of_rows(z)[:, 0])
    return out


def _flat(a: np.ndarray) -> np.ndarray:
    return a.reshape(-1, a.shape[-1])


def _sums_of_rows(a: np.ndarray) -> np.ndarray:
    """The sums over the last axis, which stays; a product is several times as fast as numpy's sum of short rows."""
    return (_flat(a) @ np.ones((a.shape[-1], 1), a.dtype)).reshape(*a.shape[:-1], 1)


def _exponentials(z: np.ndarray, kept: np.ndarray | None = None) -> None:
    """exp(z) in place, 0 where not ``kept``. A row's largest value is taken off first where any could overflow."""
    if z.size and max(z.max(), -z.min()) > 40:
        if kept is not None:
            np.copyto(z, -1e9, where=kept == 0)
        z -= z.max(-1, keepdims=True)
    np.exp(z, out=z)
    if kept is not None:
        z *= kept


def _keep_memory() -> None:
    """Lets the C library keep blocks of up to 4 MB for the next array: to get them from the system for each
    batch takes as long as the batch's products. Where there is no mallopt, nothing changes."""
    try:
        set_option = ctypes.CDLL(None).mallopt
    except (AttributeError, OSError, TypeError):
        return
    set_option(-3, 1 << 22)  # M_MMAP_THRESHOLD
    set_option(-1, 1 << 26)  # M_TRIM_THRESHOLD


_masks: dict[tuple[int, int], np.ndarray] = {}


def _seen(lead: int, t: int) -> np.ndarray:
    """1 where a place after ``lead`` may look at another one, else 0."""
    if (lead, t) not in _masks:
        _masks[lead, t] = np.tril(np.ones((t, t), np.float32))[lead:].copy()
    return _masks[lead, t]


class Model:
    """What scoring needs: classes and ids' own embeddings, log-shares within classes, classes' log-shares by the id before,
    weights, sums."""

    def __init__(self, class_of: np.ndarray, own_of: np.ndarray, share: np.ndarray, table: list[np.ndarray], weights: list[np.ndarray],
                 words: int, distinct: int, ends: int):
        self.class_of, self.own_of, self.share, self.table, self.weights = class_of, own_of, share, table, weights
        self.words, self.distinct, self.ends = words, distinct, ends
        self.class_of_own = np.full(OWN, CLASSES, dtype=np.int64)
        self.class_of_own[own_of[own_of < OWN]] = class_of[own_of < OWN]

    def inputs(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Windows over documents: the ids' places (padding: the last place), the inputs' classes and own
        embeddings, and which places are scored."""
        sizes = np.diff(bounds)
        document, start = windows(sizes)
        at = start[:, None] + np.arange(WINDOW)
        used = (at < sizes[document][:, None]) & ((at >= start[:, None] + CONTEXT) | (start[:, None] == 0))
        place = np.minimum(at + bounds[document][:, None], bounds[document + 1][:, None] - 1)
        classes, own = (np.append(none, of[ids[:-1]]).astype(np.uint16) for none, of in ((CLASSES, self.class_of), (OWN, self.own_of)))
        classes[bounds[:-1]], own[bounds[:-1]] = CLASSES, OWN
        return place, classes.take(place), own.take(place), used

    def log_probabilities(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Natural logarithm of each id's probability, given those before it in its document and window."""
        out = np.zeros(len(ids))
        for a, b in slices(bounds, 1 << 16):
            part = ids[bounds[a]: bounds[b]]
            place, classes, own, used = self.inputs(part, bounds[a: b + 1] - bounds[a])
            target = self.class_of[part].take(place)
            for lead, pick in _alike(used, BATCH):
                u = used[pick]
                out[bounds[a] + place[pick][u]] = Network.told(self.weights, classes[pick], own[pick], target[pick], u, lead, self.table)
        return out + self.share[ids]


def _alike(used: np.ndarray, size: int, rng: np.random.Generator | None = None) -> list[tuple[int, np.ndarray]]:
    """All windows, ``size`` at a time, with the number of places that only serve as context: none in the first window of
    a document. With ``rng`` in random order."""
    out = []
    for lead, pick in ((0, np.flatnonzero(used[:, 0])), (CONTEXT, np.flatnonzero(~used[:, 0]))):
        pick = pick if rng is None else rng.permutation(pick)
        out += [(lead, pick[k: k + size]) for k in range(0, len(pick), size)]
    return out if rng is None else [out[k] for k in rng.permutation(len(out))]


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and bounds of training documents, about PART ids at a time."""
    for batch in batches:
        for raw, sizes in zip(batch.column(0), batch.column(1)):
            yield np.frombuffer(unpacked(raw.as_py()), "<u2").astype(np.int64), np.append(0, np.cumsum(sizes.values.to_numpy()))


def _faces(top: np.ndarray):
    """Counts of an id with each frequent id before and after it, over the training documents of a task."""
    rank = np.full(END + 1, FACES, dtype=np.int64)
    rank[top] = np.arange(len(top))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((END + 1) * 2 * (FACES + 1), dtype=np.int64)
        for ids, bounds in _documents(batches):
            inner = np.ones(max(0, len(ids) - 1), dtype=bool)
            inner[bounds[1:-1] - 1] = False  # neighbours don't cross documents
            a, b = ids[:-1][inner], ids[1:][inner]
            np.add.at(total, b * 2 * (FACES + 1) + rank[a], 1)
            np.add.at(total, a * 2 * (FACES + 1) + FACES + 1 + rank[b], 1)
        keys = np.flatnonzero(total)
        for k in range(0, len(keys), 1 << 16):
            part = keys[k: k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], names=["key", "n"])

    return count


def classes_of(used: np.ndarray, rows: np.ndarray, columns: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A class for each id: the most frequent ids' neighbourhoods are centres at first, then 12 rounds of
    weighted k-means on the square roots of the shares. Ids never seen share the last class."""
    features = np.zeros((END + 1, 2 * (FACES + 1)))
    features[rows, columns] = n
    features /= np.maximum(features.sum(1, keepdims=True), 1)
    features = np.sqrt(features)
    out = np.full(END + 1, CLASSES - 1, dtype=np.int64)
    seen = np.flatnonzero(features.any(1) & (used > 0))
    if not len(seen):
        return out
    x, weight = features[seen], used[seen].astype(float)
    centres = x[np.argsort(-weight, kind="stable")[: CLASSES - 1]]
    for _ in range(12):
        nearest = np.argmin((centres**2).sum(1) - 2 * x @ centres.T, 1)
        for k in range(len(centres)):
            mine = nearest == k
            if mine.any():
                centres[k] = np.average(x[mine], axis=0, weights=weight[mine])
    out[seen] = nearest
    return out


def _followers(class_of: np.ndarray, own_of: np.ndarray):
    """Counts of classes after each frequent id, class of the others, or start, then after each pair of classes, over the
    training documents of a task."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BEFORE + PAIRS) * CLASSES, dtype=np.int64)
        for ids, bounds in _documents(batches):
            classes, firsts = class_of[ids], bounds[:-1]
            last, own = np.append(CLASSES, classes[:-1]), np.append(OWN, own_of[ids[:-1]])
            last[firsts], own[firsts] = CLASSES, OWN
            previous = np.append(CLASSES, last[:-1])
            previous[firsts] = CLASSES
            for row in (_before(last, own), BEFORE + previous * (CLASSES + 1) + last):
                total += np.bincount(row * CLASSES + classes, minlength=len(total))
        keys = np.flatnonzero(total)
        for k in range(0, len(keys), 1 << 16):
            part = keys[k: k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], names=["key", "n"])

    return count


def _shares(counts: np.ndarray, mass: np.ndarray) -> list[np.ndarray]:
    """Two tables, whose values add up: logarithms of the classes' shares after each id; what these gain, after each pair
    of classes, over those after the last class alone. ``BACK`` counts of what is less exact are added."""
    def shares(counts, less):
        return np.log((counts + BACK * less) / (counts.sum(-1, keepdims=True) + BACK)).astype(np.float32)

    pairs = counts[BEFORE:].reshape(CLASSES + 1, CLASSES + 1, CLASSES)
    last = pairs.sum(0)
    less = (last + BACK * mass / mass.sum()) / (last.sum(1, keepdims=True) + BACK)
    return [shares(counts[:BEFORE], mass / mass.sum()), (shares(pairs, less) - shares(last, mass / mass.sum())).reshape(PAIRS, CLASSES)]


def _learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ids of all training documents of a chunk, one after the other, and each document's number of them."""
    for batch in batches:
        for row in batch.to_pylist():
            *_, ids, bounds = _ids(row)
            chosen = np.array([trained_on(x) for x in row["doc_ids"]], dtype=bool)
            sizes = np.diff(bounds)
            ids, sizes = ids[np.repeat(chosen, sizes)].astype("<u2"), sizes[chosen]
            bounds = np.append(0, np.cumsum(sizes))
            for a, b in slices(bounds, PART):
                yield pa.RecordBatch.from_arrays([pa.array([packed(ids[bounds[a]: bounds[b]].tobytes(), 1)], pa.binary()),
                                                  pa.array([sizes[a:b].tolist()], pa.list_(pa.int64())), pa.array([row["chunk"]], pa.int64())],
                                                 names=["ids", "sizes", "chunk"])


def _trained(model: Model, rate: float):
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _keep_memory()
        flat = np.concatenate([x.ravel() for x in model.weights])
        w = [part.reshape(shape) for part, shape in zip(np.split(flat, np.cumsum([x.size for x in model.weights])[:-1]), Network.SHAPES)]  # views of flat
        m, v, t, seen = np.zeros_like(flat), np.zeros_like(flat), 0, 0
        for ids, bounds in _documents(batches):
            place, classes, own, used = model.inputs(ids, bounds)
            target = model.class_of[ids].take(place)
            for lead, pick in _alike(used, STEP, np.random.default_rng(len(place))):
                g = np.concatenate([x.ravel() for x in Network.gradients(w, classes[pick], own[pick], target[pick], used[pick], lead, model.table,
                                                                         model.class_of_own)])
                t += 1
                m += np.float32(0.1) * (g - m)
                v += np.float32(0.01) * (g * g - v)
                flat -= np.float32(rate / (1 + t / SLOWER) ** 0.5 / (1 - 0.9**t)) * m / (np.sqrt(v * np.float32(1 / (1 - 0.99**t))) + np.float32(1e-8))
                seen += len(pick)
        if seen:
            for k in range(0, len(flat), 4096):
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([float(seen)]), pa.array([flat[k: k + 4096].tolist()], pa.list_(pa.float32()))], names=["part", "n", "w"])

    return train


def fit(words: DataFrame, answers: DataFrame) -> Model:
    """The model from chunks with answers, and all answers. Starts jobs."""
    sums = {r.key: r.n for r in answers.where("chunk IS NULL").select("answer").mapInArrow(_sums, "key long, n long")
            .groupBy("key").agg(F.sum("n").alias("n")).collect()}  # a row per id of the vocabulary at most
    n_docs = words.select(F.explode("doc_ids").alias("d")).where("d IS NULL OR crc32(CAST(CAST(d AS STRING) AS BINARY)) % 7 <> 2").count()
    used = np.array([sums.get(k, 0) for k in range(END + 1)], dtype=np.int64)
    used[END] += n_docs
    learned = stored(words.mapInArrow(_learned, "ids binary, sizes array<long>, chunk long"), "lm-learned")
    top = np.argsort(-used, kind="stable")[:FACES]
    faces = learned.mapInArrow(_faces(top), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    faces = faces.toArrow()  # ids of the vocabulary times 2 * (FACES + 1) at most
    key, n = faces["key"].to_numpy(), faces["n"].to_numpy()
    class_of = classes_of(used, key // (2 * (FACES + 1)), key % (2 * (FACES + 1)), n)
    own_of = np.full(END + 1, OWN, dtype=np.int64)
    frequent = np.argsort(-used, kind="stable")[:OWN]
    own_of[frequent] = np.arange(OWN)
    mass = np.bincount(class_of, used + SMOOTH, minlength=CLASSES)
    share = np.log(used + SMOOTH) - np.log(mass[class_of])
    after = learned.mapInArrow(_followers(class_of, own_of), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()  # a table's cells
    counts = np.zeros((BEFORE + PAIRS, CLASSES))
    counts.ravel()[after["key"].to_numpy()] = after["n"].to_numpy()
    model = Model(class_of, own_of, share, _shares(counts, mass + 1), Network.start(np.full(CLASSES, 1 / CLASSES)), sums.get(-1, 0), sums.get(-2, 0), n_docs)
    first = learned.agg(F.min("chunk")).first()[0]
    if first is not None:  # a start that the tasks' weights have in common; without it their average is worse than each
        _learn(model, learned.where(F.col("chunk") == first), RATE)
    for r in range(ROUNDS):
        _learn(model, learned, RATE / (3 + 6 * r))
    return model


def _learn(model: Model, learned: DataFrame, rate: float) -> None:
    """Puts the tasks' weights, averaged, in place of the model's."""
    parts = (learned.mapInArrow(_trained(model, rate), "part long, n double, w array<float>")
             .select("part", "n", F.posexplode("w").alias("k", "w")).groupBy("part", "k").agg((F.sum(F.expr("n * w")) / F.sum("n")).alias("w"))
             .groupBy("part").agg(F.sort_array(F.collect_list(F.struct("k", "w"))).alias("w")).orderBy("part").collect())  # the weights once
    if parts:
        flat, at = np.array([x.w for p in parts for x in p.w], dtype=np.float32), 0
        for i, shape in enumerate(Network.SHAPES):
            size = int(np.prod(shape))
            model.weights[i] = flat[at: at + size].reshape(shape)
            at += size


def _scored(model: Model):
    total = model.words + model.ends
    distinct = model.distinct + (model.ends > 0)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()),
                        ("base_score", pa.float64()), ("score", pa.float64())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _keep_memory()
        for batch in batches:
            for row in batch.to_pylist():
                count, each, places, n_words, ids, bounds = _ids(row)
                n = len(n_words)
                size = n_words + 1  # words and the end, in the order of the text
                begins = np.append(0, np.cumsum(size))
                c = np.full(int(begins[-1]), model.ends, dtype=np.int64)
                inner = spread(n_words, begins[:-1])
                c[inner] = count[places] if len(places) else 0
                pieces = np.ones(len(c), dtype=np.int64)
                pieces[inner] = each
                base = np.log10((c + 1) / (total + distinct + 1))
                p = np.add.reduceat(model.log_probabilities(ids, bounds), np.cumsum(pieces) - pieces)
                mixture = np.logaddexp(p, base * np.log(10)) / np.log(10) + np.log10(0.5)
                by_base, by_words = (np.add.reduceat(x, begins[:-1]) for x in (base, mixture))
                texts = np.logaddexp(by_base * np.log(10), by_words * np.log(10)) / np.log(10) + np.log10(0.5)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array([not trained_on(x) for x in row["doc_ids"]]), pa.array(size),
                     pa.array(np.add.reduceat(c > 0, begins[:-1], dtype=np.int64)), pa.array(np.full(n, total)),
                     pa.array(by_base), pa.array(texts)], schema=schema)

    return score


def score_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of ``docs`` (doc_id, text).
    Trains first; starts jobs."""
    chunks = word_chunks(docs, lower=True, counted=trained_on, size=CHUNK)
    answers = stored(answered(chunks, _answer(path)), "lm-answers")
    words = with_answers(chunks, answers).select("chunk", "doc_ids", "n_words", "places", "answers")
    model = fit(words, answers)
    return words.mapInArrow(_scored(model), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
