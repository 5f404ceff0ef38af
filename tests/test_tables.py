"""Point reads, repeat-safe runs, weighted samples."""

import random

import pytest
from pyspark.sql import functions as F

from govaudit.operators.reservoir import weighted_reservoir
from govaudit.session import new_path
from govaudit.sources import keyed_runs, lookup
from govaudit.streaming.files import children


def scanned_rows(df):
    """Rows that the scan of a plan without exchange handed on."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaf = plan.collectLeaves().head()
    return leaf.metrics().apply("numOutputRows").value(), leaf.metrics().apply("numFiles").value()


@pytest.fixture(scope="module")
def layout(spark):
    """200,000 sparse ids, one of which has 3,000 rows."""
    rows = (spark.range(200_000).selectExpr("id * id * 7 AS packet_id", "CAST(id AS STRING) AS text", "id AS `odd.name`")
            .unionByName(spark.range(3000).selectExpr("63L AS packet_id", "CAST(id AS STRING) AS text", "id AS `odd.name`"))
            .unionByName(spark.createDataFrame([(None, None, 1)], "packet_id BIGINT, text STRING, `odd.name` BIGINT")))
    path = new_path(spark, "layout")
    lookup.write_for_lookup(rows, path, bits=6, block_rows=64)
    return path, rows


def test_a_lookup_reads_few_row_groups(spark, layout):
    path, rows = layout
    ids = random.Random(1).sample(range(10_000, 200_000), 100)
    found = lookup.look_up(spark, path, rows.schema, [i * i * 7 for i in ids])
    read, _ = scanned_rows(found)
    assert sorted(int(r.text) for r in found.collect()) == sorted(ids)
    assert read < 0.05 * rows.count()


def test_a_lookup_opens_only_its_folders(spark, layout):
    path, rows = layout
    whole = spark.read.parquet(path)
    _, files = scanned_rows(whole)
    few = lookup.look_up(spark, path, rows.schema, [7 * 49])
    read, its = scanned_rows(few)
    assert [r.text for r in few.collect()] == ["7"]
    assert its <= files / 16 and read <= 128


def test_awkward_lookups(spark, layout, tmp_path):
    path, rows = layout
    get = lambda keys: sorted(r.text for r in lookup.look_up(spark, path, rows.schema, keys).collect())
    assert get([]) == get([None]) == get([-5, 6]) == []
    assert len(get([63])) == 3001 and get([0, 0]) == ["0"]
    assert lookup.look_up(spark, str(tmp_path / "none"), rows.schema, [1]).count() == 0
    with pytest.raises(ValueError):
        lookup.look_up(spark, path, rows.schema, list(range(lookup.MOST_KEYS + 1)))
    with pytest.raises(ValueError):
        lookup.write_for_lookup(rows.withColumnRenamed("text", "folder"), str(tmp_path / "clash"))
    empty = str(tmp_path / "empty")
    lookup.write_for_lookup(rows.limit(0), empty)
    assert lookup.look_up(spark, empty, rows.schema, [7]).count() == 0


@pytest.fixture
def run_table(spark):
    def rows(*some):
        return spark.createDataFrame(list(some), "k STRING, v BIGINT")

    path = new_path(spark, "runs")
    schema = rows(("", 0)).schema
    return path, rows, lambda: sorted(((r.k, r.v) for r in keyed_runs.read_newest(spark, path, schema, ["k"]).collect()), key=str), schema


def test_a_repeated_run_leaves_one_copy(run_table):
    path, rows, read, _ = run_table
    assert read() == []
    keyed_runs.append_run(rows(("a", 1), ("b", 1), (None, 1)), path, 1)
    keyed_runs.append_run(rows(("b", 2), ("c", 2), ("c", 3)), path, 2)
    want = [("a", 1), ("b", 2), ("c", 2), ("c", 3), (None, 1)]
    assert read() == want
    keyed_runs.append_run(rows(("b", 2), ("c", 2), ("c", 3)), path, 2)
    keyed_runs.append_run(rows(("a", 1), ("b", 1), (None, 1)), path, 1)  # a late repeat doesn't overtake run 2
    assert read() == want
    keyed_runs.append_run(rows(("b", 9), (None, 5)), path, 2)
    assert read() == [("a", 1), ("b", 9), (None, 5)]


def test_a_killed_run_changes_nothing(spark, run_table):
    path, rows, read, _ = run_table
    keyed_runs.append_run(rows(("a", 1)), path, 1)
    # killed before the end: files without the mark of a finished write
    unfinished = spark.conf.get("mapreduce.fileoutputcommitter.marksuccessfuljobs", None)
    rows(("a", 7), ("z", 7)).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{path}/run=1/attempt=2")
    rows(("y", 7)).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{path}/run=2/attempt=1")
    assert unfinished is None and read() == [("a", 1)]
    # killed between the write and the removal of what it replaces
    rows(("a", 8)).write.parquet(f"{path}/run=1/attempt=3")
    assert read() == [("a", 8)]
    keyed_runs.append_run(rows(("a", 8)), path, 1)
    keyed_runs.append_run(rows(("y", 1)), path, 2)
    assert read() == [("a", 8), ("y", 1)]
    assert children(spark, f"{path}/run=1") == ["attempt=4"] and children(spark, f"{path}/run=2") == ["attempt=2"]


def test_compaction(spark, run_table):
    path, rows, read, schema = run_table
    for run in range(5):
        keyed_runs.append_run(rows(("a", run), (f"k{run}", run)), path, run)
        if run in (1, 3):
            before = read()
            keyed_runs.compact(spark, path, schema, ["k"])
            keyed_runs.compact(spark, path, schema, ["k"])
            assert read() == before
            assert children(spark, path) == [f"base={run}"]
    assert read() == [("a", 4), *[(f"k{i}", i) for i in range(5)]]
    with pytest.raises(ValueError):
        keyed_runs.append_run(rows(("a", 0)), path, 3)
    # an unfinished base isn't read
    rows(("x", 0)).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{path}/base=4/attempt=1")
    assert read() == [("a", 4), *[(f"k{i}", i) for i in range(5)]]


def test_reservoir_sizes_and_awkward_weights(spark):
    rows = spark.createDataFrame([("a", i, 1.0) for i in range(50)] + [("b", i, 1.0) for i in range(3)] + [
        ("c", 1, 0.0), ("c", 2, None), ("c", 3, -1.0), (None, 9, 2.0), ("d", None, 2.0)], "s STRING, id BIGINT, w DOUBLE")
    got = weighted_reservoir(rows, ["s"], F.col("w"), 5, "id", "x")
    assert {r.s: r["count"] for r in got.groupBy("s").count().collect()} == {"a": 5, "b": 3, None: 1, "d": 1}
    want = sorted(map(str, got.collect()))
    assert want == sorted(map(str, weighted_reservoir(rows.repartition(7), ["s"], F.col("w"), 5, "id", "x").collect()))
    assert want != sorted(map(str, weighted_reservoir(rows, ["s"], F.col("w"), 5, "id", "y").collect()))
    assert weighted_reservoir(rows.limit(0), ["s"], F.col("w"), 5, "id", "x").count() == 0
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


def test_reservoir_includes_by_weight(spark):
    """2,000 strata of weights 1, 1, 2, 4: the first draw takes each in proportion, the second from what is left."""
    rows = spark.range(8000).selectExpr("id div 4 AS s", "id", "element_at(array(1, 1, 2, 4), CAST(id % 4 + 1 AS INT)) AS w")
    drawn = weighted_reservoir(rows, ["s"], F.col("w"), 2, "id", "draw").groupBy("place", (F.col("id") % 4).alias("i")).count().collect()
    share = {(r.place, r.i): r["count"] / 2000 for r in drawn}
    weights = [1, 1, 2, 4]
    for i, w in enumerate(weights):
        second = sum(v / 8 * w / (8 - v) for j, v in enumerate(weights) if j != i)
        assert abs(share[1, i] - w / 8) < 0.045 and abs(share[2, i] - second) < 0.045
