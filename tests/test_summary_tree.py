"""The stored tree gives the batch result whatever the order of rows, and reads no more for a longer history."""

import random

from pyspark.sql import functions as F

from govaudit.operators import weakness
from govaudit.streaming import summary_tree
from govaudit.streaming.summary_tree import SummaryTree

ROWS = "agent BIGINT, code STRING, n BIGINT, missed INT"


def tree(spark, path, **sizes):
    return SummaryTree(spark, str(path), weakness.MISS_RATE, ROWS, ["agent", "code"], ["n", "missed"], "missed", **sizes)


def states(df):
    return {(r.agent, r.code): (r.n, r.hits, r.state) for r in df.collect()}


def batch_states(spark, rows):
    found = weakness.observed_state(spark.createDataFrame(rows, ROWS), ["n", "missed"])
    return {(r.agent, r.code): (r.total, r.missed, r.rate) for r in found.collect()}


def test_rows_in_any_order_and_repeated_batches(spark, tmp_path):
    rng = random.Random(9)
    rows = [(rng.choice([1, 1, 1, 2, None]), rng.choice("ab"), n, rng.randint(0, 1)) for n in range(900)]
    rng.shuffle(rows)
    parts = [rows[:500], rows[500:899], rows[899:]]
    mine = tree(spark, tmp_path, bits=1, levels=3, buckets=2)
    leaf = F.expr("n DIV 150")
    known = [r for r in rows if r[0] is not None]
    for number, part in enumerate(parts):
        part = [r for r in part if r[0] is not None]
        mine.add(spark.createDataFrame(part, ROWS), leaf, number)
        if number == 1:
            mine.add(spark.createDataFrame(part, ROWS), leaf, number)  # the batch comes again
            assert states(mine.state()) == batch_states(spark, [r for p in parts[:2] for r in p if r[0] is not None])
    assert states(mine.state()) == batch_states(spark, known)
    mine.add(spark.createDataFrame([], ROWS), leaf, 9)
    assert states(tree(spark, tmp_path, bits=1, levels=3, buckets=2).state()) == batch_states(spark, known)


def test_a_late_row_reads_one_leaf_and_its_ancestors(spark, tmp_path):
    """Eight times the history: the bytes read for a late row stay the same."""
    read = {}
    for leaves in (8, 64):
        rng = random.Random(leaves)
        rows = [(1, "a", n, rng.randint(0, 1)) for n in range(30 * leaves)]
        mine = tree(spark, tmp_path / str(leaves), bits=1, levels=6, buckets=1)
        mine.add(spark.createDataFrame(rows, ROWS), F.expr("n DIV 30"), 0)
        mine.add(spark.createDataFrame([(1, "a", 45, 1)], ROWS), F.expr("n DIV 30"), 1)
        read[leaves] = mine.read_bytes
        assert states(mine.state()) == batch_states(spark, [*rows, (1, "a", 45, 1)])
    assert 0 < read[64] < 1.3 * read[8]


def test_a_batch_copies_no_rows(spark, tmp_path, monkeypatch):
    """Rows are written to their leaves alone; what is kept on the way are summaries."""
    rng, copied, frame = random.Random(4), [], type(spark.range(1))
    rows = [(n % 3, "a", n, rng.randint(0, 1)) for n in range(3000)]
    checkpoint, write = frame.checkpoint, getattr(summary_tree, "written", None)
    monkeypatch.setattr(frame, "checkpoint", lambda df, *more: copied.append(df.count()) or checkpoint(df, *more))
    monkeypatch.setattr(summary_tree, "written", lambda df, name: copied.append(df.count()) or write(df, name), raising=False)
    mine = tree(spark, tmp_path, bits=1, levels=3, buckets=2)
    for number in range(2):
        mine.add(spark.createDataFrame(rows[number::2], ROWS), F.expr("n DIV 500"), number)
    assert copied and sum(copied) < 300
    assert states(mine.state()) == batch_states(spark, rows)
