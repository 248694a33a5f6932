"""Every registered query on the smallest tables, against its SQL where it has one; and its plan."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from check_oracle import TABLES, rows_of

QUERIES = entry_points.queries()
ORACLE = entry_points.oracle_sql()

# Python runs in these only: dense vector arithmetic, the K x K assignment.
PYTHON = {
    "a07", "a08", "a09", "a10", "a11", "a12", "a13", "a15", "j20", "m02", "m03", "m04", "m05", "m06", "m07", "m08", "m09", "m10",
    "m11", "m12", "m13", "m18", "m19", "m25", "m27",
}


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def test_names():
    assert set(ORACLE) <= set(QUERIES)
    assert len(QUERIES) >= 150


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, db, name):
    df = QUERIES[name](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name.split("_")[0] not in PYTHON:
        assert "Python" not in plan and "InPandas" not in plan and "ArrowEval" not in plan
    mine = rows_of(df.columns, df.collect())
    assert mine
    if name in ORACLE:
        cursor = db.execute(ORACLE[name])
        names = [d[0] for d in cursor.description]
        assert sorted(names) == sorted(df.columns)
        assert mine == rows_of(names, cursor.fetchall())


@pytest.mark.parametrize("name", ["w01_top_per_cluster", "w02_sample_per_cluster", "s07_export_cluster_json"])
def test_groups_are_cut_before_the_shuffle(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_first_per_key_is_combined_before_the_shuffle(spark, sf):
    plan = QUERIES["d02_distinct_pairs"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan


def test_vector_scans_read_only_what_they_use(spark, sf):
    plan = QUERIES["m07_hard_assign"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in plan


def test_right_cluster_always_has_the_answer(spark, sf):
    row = QUERIES["a18_qa_scores"](spark, sf).first()
    assert row["accuracy_given_cluster"] == 1.0


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
