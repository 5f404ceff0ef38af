"""Two streams joined over event time: results, late rows and the size of the state."""

import datetime
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from govaudit.streaming import activity
from govaudit.streaming.files import run_available

DAY0 = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
DAYS = 120


def write_days(folder, days_of_files, column, others):
    """A file per list of days; rows (key, time) that ``others`` completes."""
    os.makedirs(folder)
    for number, days in enumerate(days_of_files):
        rows = [others(key, day) | {"submission_id": key, column: DAY0 + datetime.timedelta(days=day)} for key, day in days]
        path = f"{folder}/part-{number:03}.parquet"
        pq.write_table(pa.Table.from_pylist(rows, schema=pa.schema([
            ("submission_id", pa.int64()), (column, pa.timestamp("us", "UTC")), *((k, pa.list_(pa.string()) if isinstance(v, list) else pa.string())
                                                                                 for k, v in others(0, 0).items())])), path)
        os.utime(path, (1_700_000_000 + 10 * number,) * 2)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Five submissions a day, each decided on 3, 12 and 40 days later; ten days to a file. The last file also
    holds a submission and a decision of the first day."""
    top = tmp_path_factory.mktemp("windows")
    sent = [[(day * 5 + k, day) for day in range(first, first + 10) for k in range(5)] for first in range(0, DAYS, 10)]
    made = [[(key, day + gap) for key, day in ((d * 5 + k, d) for d in range(DAYS) for k in range(5)) for gap in (3, 12, 40) if first <= day + gap < first + 10]
            for first in range(0, DAYS, 10)]
    sent[-1].append((10_000, 1))
    made[-1].append((10_000, 2))
    write_days(f"{top}/sent", sent, "submitted_at", lambda key, day: {"detected": ["A"] if key % 2 else ["A", "B"]})
    write_days(f"{top}/made", made, "decided_at", lambda key, day: {"decision": "approve" if key % 3 else "reject"})
    return str(top)


def joined(spark, folder):
    sent, made = (spark.readStream.schema(spark.read.parquet(f"{folder}/{name}").schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/{name}")
                  for name in ("sent", "made"))
    return activity.decided_submissions(sent, made, "submission_id", within="20 days", late="1 day")


def test_windows_equal_a_batch_join(spark, folder):
    counts = run_available(activity.violation_counts(joined(spark, folder), "decided_at", "10 days", "decision"), "windows")
    got = {(r.window_start.replace(tzinfo=None), r.code, r.decision): r.n_violations for r in counts.collect()}
    sent, made = spark.read.parquet(f"{folder}/sent").where("submission_id < 10000"), spark.read.parquet(f"{folder}/made")
    batch = sent.join(made, "submission_id").where("decided_at >= submitted_at AND decided_at <= submitted_at + INTERVAL 20 DAYS")
    want = {(r.window_start.replace(tzinfo=None), r.code, r.decision): r.n_violations
            for r in activity.violation_counts(batch, "decided_at", "10 days", "decision").collect()}
    assert got and all(want[k] == n for k, n in got.items())
    last = DAY0.replace(tzinfo=None) + datetime.timedelta(days=DAYS - 1 - 1 - 20)  # newest row less lateness and range
    assert got.keys() == {k for k in want if k[0] + datetime.timedelta(days=10) <= last}


def test_late_pairs_are_left_out_and_state_is_bounded(spark, folder, tmp_path):
    query = (joined(spark, folder).writeStream.format("parquet").trigger(availableNow=True)
             .option("checkpointLocation", str(tmp_path / "progress")).start(str(tmp_path / "out")))
    query.awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out"))
    assert found.where("submission_id = 10000").count() == 0
    assert found.count() == spark.read.parquet(f"{folder}/made").join(
        spark.read.parquet(f"{folder}/sent"), "submission_id").where("submission_id < 10000 AND datediff(decided_at, submitted_at) <= 20").count()
    held = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    rows = spark.read.parquet(f"{folder}/sent").count() + spark.read.parquet(f"{folder}/made").count()
    # 20 days of submissions (5 a day) and a day of decisions (15), and the file at hand, whatever came before
    assert len(held) > 10 and max(held) <= 5 * (20 + 1 + 20) + 15 * (1 + 20) < rows / 3
    assert found.where(F.col("decided_at") < F.col("submitted_at")).count() == 0
