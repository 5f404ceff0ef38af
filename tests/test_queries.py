"""Every registered query runs and equals its SQL twin."""

import math
import os
import re

import duckdb
import pytest

import __spark_entry__  # noqa: F401  registers the queries
import bench
from govaudit.plans.registry import QUERIES, SQL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


@pytest.fixture(scope="module")
def views(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def shown(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf_dir, views, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(shown(v) for v in row) for row in df.select(*[f"`{c}`" for c in columns]).collect())
    result = views.execute(SQL[name])
    names = [c[0] for c in result.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    assert [names[i] for i in order] == columns
    want = sorted(tuple(shown(row[i]) for i in order) for row in result.fetchall())
    assert got == want and got


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(bench.HEADLINE) <= set(QUERIES)


def test_no_python_in_batch_plans(spark, sf_dir):
    for name, query in QUERIES.items():
        if not name.startswith("streamed_"):
            text = query(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
            assert not re.search(r"Python|Pandas|CartesianProduct|BroadcastNestedLoop", text), name


def test_sources_use_no_local_checkpoint():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, files in os.walk(os.path.join(root, "govaudit")):
        for file in files:
            if file.endswith(".py"):
                with open(os.path.join(folder, file), encoding="utf8") as f:
                    assert "localCheckpoint" not in f.read(), file
