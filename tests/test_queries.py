"""Every registered query with SQL gives the rows that DuckDB gives."""

import math

import duckdb
import pytest

from cohortloom.plans import queries as plans

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings labels".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def shown(v):
    return ("nan" if math.isnan(v) else repr(v + 0.0)) if isinstance(v, float) else repr(v)


#: Queries whose answer has to be empty, and those that SQL has no equal for.
EMPTY, NO_SQL = {"ids_to_fetch_none"}, {"neighbour_communities"}


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - NO_SQL))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    found = sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())
    r = duck.execute(plans.ORACLE_SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == columns and bool(found) != (name in EMPTY)
    assert found == sorted(tuple(shown(row[names.index(c)]) for c in columns) for row in r.fetchall())


def test_every_query_has_sql():
    assert set(plans.QUERIES) == set(plans.ORACLE_SQL) | NO_SQL


def test_neighbour_communities(spark):
    """Every vector with a neighbour is in one; tests of the operator hold communities against a greedy pass."""
    found = plans.QUERIES["neighbour_communities"](spark, DIR)
    n = spark.read.parquet(f"{DIR}/embeddings.parquet").count()
    assert found.select("id").distinct().count() == found.count() == n and 1 < found.select("community").distinct().count() < n / 4


def test_native_plans_run_no_python(spark):
    for name in ("mic_parse", "antibiogram", "stratified_sample", "split_70_10_20"):
        plan = plans.QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan, name


def test_measurements_of_more_decimals_than_they_keep(spark, tmp_path):
    """Doubles become cents as DuckDB's cast makes them: halves away from zero, of the product with 100."""
    values = [k / 1000 for k in range(-3000, 6000)] + [k + 0.005 for k in range(2000)] + [k / 8 for k in range(2000)] + [0.0, -0.0, 0.004999999999999999, 1e-9, 123456.785, 99999999.99]
    rows = [(k, None, k % 977, "view", float(v), "") for k, v in enumerate(values)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    with duckdb.connect() as c:
        c.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
        for name in ("mic_parse", "mic_rejects"):
            found = sorted(tuple(map(shown, r)) for r in plans.QUERIES[name](spark, str(tmp_path)).collect())
            assert found and found == sorted(tuple(map(shown, r)) for r in c.execute(plans.ORACLE_SQL[name]).fetchall())
