"""Spelling variants, line deduplication and token alignment on awkward rows and on the small tables, against plain versions."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from govaudit.llm import line_runs, queries, spelling, token_alignment
from tests.llm import brute
from tests.llm.test_operators import awkward_rows

BYTE_BPE, PIECES = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = awkward_rows() + [(None, "with no id"), (None, "with no id"), (None, None)]
#: Columns whose names the operators use themselves.
CLASHING = "doc_id long, text string, hash string, word int, mark double, links string, n long, `a.b c` int"


def framed(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2.0, None, 3, 4) for i, t in rows], CLASHING).repartition(3)


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, str(r[0]), tuple(map(str, r[1:]))))


# --- spelling ---


def test_corpus_words(spark):
    rng = random.Random(5)
    say = lambda: " ".join(rng.choice(["Zürichsee", "harbour", "lighthouse", "ÀÉÎÕÜàé", "x×y÷zabcd", "ab" * 60]) for _ in range(30))
    rows = ODD + [(k, say()) for k in range(200, 260)] + [(300, "letters,letters;letters"), (300, "letters,letters;letters")]
    got = {r.word: r.n for r in spelling.corpus_words(framed(spark, rows)).collect()}
    assert got == brute.corpus_words(rows) and len(got) > 10


def test_words_end_with_their_texts(spark):
    rows = [(1, "seventh"), (2, "letters"), (3, "seventh"), (4, "letters"), (5, "É"), (6, "clairvoyant")]
    assert {r.word for r in spelling.corpus_words(framed(spark, rows).coalesce(1), least=1, drop=2**31).collect()} == {"seventh", "letters", "clairvoyant"}


def families(seed, letters, n, length):
    """Counts of random words and of words made from them by edits."""
    rng = random.Random(seed)
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(7, length))) for _ in range(n)]
    for word in list(words):
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(word))
            word = rng.choice([word[:k] + word[k + 1:], word[:k] + rng.choice(letters) + word[k:], word[:k] + rng.choice(letters) + word[k + 1:]])
            words.append(word)
    return {w: rng.choice([2, 3, 5, 20, 30, 50, 300, 4000]) for w in words if w}


@pytest.mark.parametrize("letters, n, length, part", [("abcdefghijklmnopqrstuvwxyzéßÿ", 300, 12, 40), ("ab", 150, 10, 60), ("xyzé", 100, 60, 30), ("etaoin", 400, 9, 10**6)])
def test_variants(spark, letters, n, length, part):
    counts = families(len(letters), letters, n, length)
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    assert {tuple(r) for r in spelling.variants(words, groups=6, part=part).collect()} == brute.variants(counts)


def test_wide_leaves(monkeypatch):
    """Many words with the same letters, matched by shortened words."""
    rng = random.Random(8)
    counts = {"".join(rng.sample("abcdaabb", 8)): rng.choice([2, 30, 400]) for _ in range(400)}
    counts |= {w + "a": 5 for w in list(counts)[:50]}
    monkeypatch.setattr(spelling, "WIDE", 2)
    vectors = spelling.vectors(pa.array(list(counts)), np.arange(256) % 3)
    order = np.lexsort(vectors.T[::-1])
    names = [list(counts)[k] for k in order.tolist()]
    words = spelling.Words(*spelling._letters(pa.array(names)))
    found = [frozenset((names[x], names[y])) for a, b in spelling.near_words(words, vectors[order], len(names)) for x, y in zip(a.tolist(), b.tolist())]
    want = {frozenset((a, b)) for a in counts for b in counts if brute.near(a, b)}
    assert set(found) == want and len(found) == len(want) > 50


def test_long_words_and_none(spark):
    long = "ab" * 100
    counts = {long: 50, long + "c": 3, long[:70] + "x" + long[71:]: 4, long[::-1]: 2, "ab" * 30: 7, "ab" * 29 + "b": 90}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert {tuple(r) for r in spelling.variants(words).collect()} == brute.variants(counts)
    assert spelling.variants(words.limit(0)).collect() == []
    assert spelling.corpus_words(framed(spark, [(1, None)]).where("doc_id > 5")).collect() == []


def test_forms_are_followed_to_the_last(spark):
    counts = {"abcdefgh": 20_000, "abcdefgi": 1500, "abcdefii": 100, "abcdeiii": 7, "abcdefg": 7, "qqqqqqqq": 7}
    rows = {r.word: r for r in spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert rows["abcdeiii"].root == "abcdefgh" and rows["abcdeiii"].form == "abcdefii" and rows["qqqqqqqq"].root == "qqqqqqqq"
    assert {tuple(r) for r in rows.values()} == brute.variants(counts)


def test_budget_reaches_every_near_vector():
    """The parts a word is sent to are those where a near word with a larger vector can be indexed."""
    rng = random.Random(2)
    steps = {tuple(s) for s in spelling._reached(3).tolist()}
    for _ in range(3000):
        a = "".join(rng.choice("abcde") for _ in range(7))
        k = rng.randrange(7)
        b = rng.choice([a[:k] + rng.choice("abcde") + a[k + 1:], a[:k] + rng.choice("abcde") + a[k:], a[:k] + a[k + 1:]])
        x, y = ((len(w), *(w.count(c) for c in "abcde")) for w in (a, b))
        if x <= y:
            assert tuple(np.subtract(y[:3], x[:3]).tolist()) in steps


# --- lines ---


LINES = ["Common line", "  common LINE\t", "rare", "", "   ", "Ünïcode  line", "x" * 5000, "\rcarriage\r", "\x85not white\x85"]


def line_rows(n=80):
    rng = random.Random(3)
    return [(k, "\n".join(rng.choice([*LINES, f"own {k}", f"few {k % 13}"]) for _ in range(rng.randint(0, 12)))) for k in range(n)]


@pytest.mark.parametrize("least, batches, fan", [(10, 6, 3), (3, 1, 2), (2, 9, 2)])
def test_common_lines_go(spark, least, batches, fan):
    rows = ODD + line_rows() + [(3, "common line\nagain"), (7, "rare\nrare"), (None, "few 3")]
    got = [tuple(r) for r in line_runs.without_common_lines(framed(spark, rows), least, batches, fan).collect()]
    assert ordered(got) == ordered(brute.without_common_lines(rows, least))
    assert sum(r[2] for r in got) > 20


def test_lines_of_one_document_count_once(spark):
    rows = [(1, "again\n" * 50), (1, "again"), (2, "again"), (None, "lost"), (None, "lost"), (None, "lost\nkept")]
    got = line_runs.without_common_lines(framed(spark, rows), least=3).collect()
    assert sum(r.n_dropped for r in got) == 0
    assert line_runs.without_common_lines(framed(spark, rows).where("doc_id > 9")).collect() == []


def test_runs_are_levelled(spark):
    """Nine batches at a fan of three leave one run; its counts are those of the whole."""
    runs = line_runs.LineRuns(spark, least=4, fan=3, buckets=4)
    rows = [(batch * 10 + k, bytes([line])) for batch in range(9) for k in range(3) for line in range(batch, 12)]
    for batch in range(9):
        part = [r for r in rows if r[0] // 10 == batch]
        runs.add(spark.createDataFrame(part, "doc_id long, hash binary"))
        assert [len(level) for level in runs.levels] == {0: [1], 1: [2], 2: [0, 1], 3: [1, 1], 4: [2, 1], 5: [0, 2], 6: [1, 2], 7: [2, 2], 8: [0, 0, 1]}[batch]
    assert sorted(r.hash[0] for r in runs.common().collect()) == list(range(1, 12))
    counts = {r.hash[0]: r.n for r in runs.runs()[0].collect()}
    assert counts[11] < 27 and counts[0] == 3  # settled lines aren't counted on


def test_settled_lines_are_merged_without_a_shuffle_of_the_runs(spark):
    """The anti-join reads a run's buckets where they are."""
    runs = line_runs.LineRuns(spark, least=2, buckets=4)
    runs.add(spark.createDataFrame([(k, b"%d" % (k % 5)) for k in range(40)], "doc_id long, hash binary"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        run = runs.runs()[0]
        counted = spark.createDataFrame([(b"1",), (b"7",)], "hash binary").repartition(4, "hash")
        plan = counted.join(run.where("n >= 2").select("hash"), "hash", "left_anti")
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert text.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" in text
        assert [r.hash for r in plan.collect()] == [b"7"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


# --- tokens ---


def token_rows(n=300):
    rng = random.Random(3)
    parts = [" ", "  ", "\n", "a", "é", "日", "\u2581", "\u00a0", "\u3000", "\u2003", "'s", "1", "!", "<s>", "<0x41>", "<|endoftext|>", "\u0300", "\r\n", "\t", " the", "😀", "ation"]
    return [(1000 + k, "".join(rng.choice(parts) for _ in range(rng.randint(1, 25)))) for k in range(n)]


def test_alignments(spark, monkeypatch):
    monkeypatch.setattr(token_alignment, "CHUNK", 2000)
    rows = ODD + token_rows() + [(500, "the end "), (501, " "), (502, "  lead"), (503, "\x1c x \x85 y"), (504, "word" * 5000)]
    got = [tuple(r) for r in token_alignment.align_documents(framed(spark, rows), BYTE_BPE, PIECES, as_text=True).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups").collect()]
    want = brute.alignments(rows)
    assert ordered(got) == ordered(want)
    assert sum(r[1] > 0 for r in want) > 100 < sum(r[1] == 0 for r in want)
    assert token_alignment.align_documents(framed(spark, rows).where("doc_id > 99999"), BYTE_BPE, PIECES).where("doc_id < 2").collect() == []


def test_forgotten_stretches_come_back():
    aligner = token_alignment.Aligner(BYTE_BPE, PIECES)
    texts = ["one two three", "two three four", "", "three\nfour five"]
    data, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.append(0, np.cumsum([len(x) for x in texts]))
    first = aligner.align(data, offsets)
    aligner.clear()
    assert aligner.align(data, offsets) == first == aligner.align(data, offsets)


def test_stretches_are_encoded_together(monkeypatch):
    """A gets neighbouring stretches as one text, those after white space alone; all is as for each stretch by itself."""
    stretches = [f" w{k}{'ation' * (k % 3)}".encode() for k in range(500)] + [" ", "  lead", " x\u3000", " y\n", " z'", " 's", " é😀", " \x1c", " end\x85", " 日本"]
    stretches = [x if isinstance(x, bytes) else x.encode() for x in stretches]
    aligner, alone, seen = token_alignment.Aligner(BYTE_BPE, PIECES), token_alignment.Aligner(BYTE_BPE, PIECES), []

    class Counted:
        def encode_batch_fast(self, texts, **more):
            seen.append(len(texts))
            return inner.encode_batch_fast(texts, **more)

    inner, aligner.a = aligner.a, Counted()
    data, offsets = np.frombuffer(b"".join(x[1:] for x in stretches), np.uint8), np.append(0, np.cumsum([len(x) - 1 for x in stretches]))
    together = aligner.align(data, offsets)
    assert together == [alone.align(np.frombuffer(x[1:], np.uint8), np.array([0, len(x) - 1]))[0] for x in stretches]
    assert sum(seen) < 50


def test_intervals_coalesce():
    """Groups and overlaps of random tilings, against their definitions."""
    rng = np.random.default_rng(4)
    for _ in range(200):
        a, b = (np.append(np.unique(rng.integers(1, 40, rng.integers(0, 12))), 40) for _ in range(2))
        a_starts, b_starts = np.append(0, a[:-1]), np.append(0, b[:-1])
        order, group = token_alignment.coalesce(np.concatenate([a_starts, b_starts]), np.concatenate([a, b]))
        ends = np.concatenate([a, b])[order]
        both = np.intersect1d(a, b)
        assert group.tolist() == np.searchsorted(both, ends).tolist()
        pairs = set(zip(*(x.tolist() for x in token_alignment.overlaps(a_starts, a, b_starts, b))))
        assert pairs == {(i, j) for i in range(len(a)) for j in range(len(b)) if a_starts[i] < b[j] and b_starts[j] < a[i]}


def test_pair_table_is_bounded_by_the_vocabularies(spark, sf_dir):
    """Of two tokens that end together one is a suffix of the other."""
    links = token_alignment.aligned(spark.read.parquet(f"{sf_dir}/documents.parquet"), BYTE_BPE, PIECES)
    mine = token_alignment.Aligner(BYTE_BPE, PIECES)
    pairs = token_alignment.pair_counts(links).collect()
    assert pairs and all(mine.a_bytes[r.a].endswith(mine.b_bytes[r.b]) or mine.b_bytes[r.b].endswith(mine.a_bytes[r.a]) for r in pairs)


def test_query_on_the_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op13_token_alignment(spark, sf_dir).collect()
    want = [(*r[:7], brute.sha(r[7].encode()) if r[7] else "") for r in brute.alignments(rows)]
    assert ordered([tuple(r) for r in got]) == ordered(want)
