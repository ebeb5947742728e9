"""Every query with SQL gives the same rows as DuckDB; none of those with pairs or thresholds is empty."""

import glob
import os

import pytest

from keepsake.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
MAY_BE_EMPTY = {"link_spatial", "search_by_location", "conversation", "timeline_day", "incremental_dedup", "link_semantic", "link_quote"}


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def shown(value):
    import datetime
    import decimal

    if value is None:
        return ""
    if isinstance(value, bool) or not isinstance(value, int | float | decimal.Decimal):
        return value.isoformat() if isinstance(value, datetime.date) else str(value)
    return f"{float(value):.9g}"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    want = duck.sql(catalogue.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = sorted(df.columns)
    ours = sorted(tuple(shown(r[c]) for c in order) for r in df.collect())
    at = [want.columns.index(c) for c in order]
    theirs = sorted(tuple(shown(r[k]) for k in at) for r in want.fetchall())
    assert ours == theirs
    assert ours or name in MAY_BE_EMPTY


def test_queries_without_sql_run(spark):
    for name in catalogue.QUERIES.keys() - catalogue.ORACLES.keys():
        assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_range_filters_reach_the_scan_of_every_part(spark):
    from keepsake.operators import entities
    from keepsake.plans import queries_rollups

    plan = entities.timeline(queries_rollups._view(spark, SF), ("2024-01-05", "2024-01-07"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("GreaterThanOrEqual(") >= 3


def test_stream_queries_read_files_and_folders_alike(spark, tmp_path):
    import shutil

    for name in ("events", "documents"):
        spark.read.parquet(f"{SF}/{name}.parquet").repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    for name in ("stream_tumbling", "stream_sliding", "stream_sessions", "stream_dedup"):
        want = sorted(map(str, catalogue.QUERIES[name](spark, SF).collect()))
        assert sorted(map(str, catalogue.QUERIES[name](spark, str(tmp_path)).collect())) == want and want
    shutil.rmtree(tmp_path / "events.parquet")
    with pytest.raises(Exception):  # noqa: B017  nothing is there
        catalogue.QUERIES["stream_tumbling"](spark, str(tmp_path)).collect()
