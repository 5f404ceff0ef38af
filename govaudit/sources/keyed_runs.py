"""Tables that grow run by run and survive a repeated or killed run.

A run writes its rows below ``path/run=N/attempt=K``. An attempt counts once it
is there to its end, and only a run's newest one does; those before it go
afterwards. So a run that is repeated replaces itself, one that was killed leaves
what was there before, and no row is doubled by either. Of a key's rows those of
the newest run that has the key are read.

``compact`` writes what the runs so far amount to as ``path/base=N/attempt=K``, so
that a reader opens one base and the runs after it. A run in a base is closed.
The driver lists runs, never rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from govaudit.streaming.files import children, committed, remove


def _numbers(spark: SparkSession, folder: str, kind: str) -> list[int]:
    return sorted(int(name.removeprefix(f"{kind}=")) for name in children(spark, folder) if name.startswith(f"{kind}="))


def _newest_attempt(spark: SparkSession, folder: str) -> str | None:
    """The folder's last attempt that was written to its end."""
    done = (f"{folder}/attempt={k}" for k in reversed(_numbers(spark, folder, "attempt")))
    return next((path for path in done if committed(spark, path)), None)


def _write(df: DataFrame, folder: str) -> None:
    spark = df.sparkSession
    before = _numbers(spark, folder, "attempt")
    df.write.parquet(f"{folder}/attempt={max(before, default=0) + 1}")
    for k in before:
        remove(spark, f"{folder}/attempt={k}")


def _base(spark: SparkSession, path: str) -> tuple[int, str | None]:
    """The newest base and the last run in it."""
    for n in reversed(_numbers(spark, path, "base")):
        found = _newest_attempt(spark, f"{path}/base={n}")
        if found is not None:
            return n, found
    return -1, None


def append_run(df: DataFrame, path: str, run: int) -> None:
    """Adds a run's rows, or replaces those that an earlier attempt at this run left."""
    if run < 0 or run <= _base(df.sparkSession, path)[0]:
        raise ValueError(f"run {run} is closed")
    _write(df, f"{path}/run={run}")


def read_newest(spark: SparkSession, path: str, schema: StructType, keys: list[str]) -> DataFrame:
    """Of each key's rows those of the newest run that has the key; empty where nothing was written.

    A null is a key like others. Rows that a run holds several times stay so.
    """
    closed, base = _base(spark, path)
    sources = [(closed, base)] if base else []
    sources += [(n, _newest_attempt(spark, f"{path}/run={n}")) for n in _numbers(spark, path, "run") if n > closed]
    marks = {"run", "base", "attempt", "_run", "_last"} & set(schema.names)
    if marks:
        raise ValueError(f"columns {sorted(marks)} are taken")
    paths = [p for _, p in sources if p]
    if not paths:
        return spark.createDataFrame([], schema)
    kinds = {"base": [p for p in paths if p == base], "run": [p for p in paths if p != base]}
    # the folders' names give each row its run
    parts = [spark.read.schema(schema).option("basePath", path).parquet(*some)
             .withColumn("_run", F.col(kind).cast("bigint")).drop(kind, "attempt") for kind, some in kinds.items() if some]
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    # the newest run per key is combined before the shuffle; the join splits a key of very many rows
    newest = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max("_run").alias("_last"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col("_run") == F.col("_last")]
    return rows.join(newest, same, "left_semi").drop("_run")


def compact(spark: SparkSession, path: str, schema: StructType, keys: list[str]) -> None:
    """Puts all runs so far into one base. Killed anywhere, it leaves what is read as it was."""
    runs = [n for n in _numbers(spark, path, "run") if _newest_attempt(spark, f"{path}/run={n}")]
    closed = _base(spark, path)[0]
    if runs and runs[-1] > closed:
        _write(read_newest(spark, path, schema, keys), f"{path}/base={runs[-1]}")
        closed = runs[-1]
    for kind, until in (("run", closed + 1), ("base", closed)):
        for n in _numbers(spark, path, kind):
            if n < until:
                remove(spark, f"{path}/{kind}={n}")
