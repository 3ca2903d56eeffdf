"""Every catalog query against its SQL on the smallest tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from brandloom.plans import adapters, catalog, oracle

DATA = "/root/testdata/sf0.001"
TABLES = ("part", "supplier", "benchmark", "documents")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(str([round(v, 6) if isinstance(v, float) else v for v in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*columns).collect()]
    if name not in oracle.oracle_sql():
        assert rows
        return
    found = duck.execute(f"SELECT {', '.join(columns)} FROM ({oracle.oracle_sql()[name]})").fetchall()
    assert plain(rows) == plain(found)


def test_plans_push_down_and_prune(spark):
    df = catalog.queries()["block_keys_native"](spark, DATA)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<item_id:bigint,text:string>" in plan and "Python" not in plan
    df = catalog.queries()["rank_top50"](spark, DATA)
    assert "TakeOrderedAndProject" in df._jdf.queryExecution().executedPlan().toString()


def test_one_shuffle_serves_both_sides_of_the_pair_join(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = catalog.queries()["candidate_pairs_native"](spark, DATA)
        df.collect()
        assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_the_tables_bite(spark):
    """Every normalising step changes something in the tables that the queries read."""
    names = adapters.products(spark, DATA)
    rx = lambda column, pattern: names.where(F.col(column).rlike(pattern)).count()
    assert rx("name", r"5mg/\d+mg/30mg") and rx("name", r"\d mg") and rx("name", r"-\d+ Forte")
    parsed = catalog.queries()["molecule_inventory"](spark, DATA)
    found = {r["molecule"] for r in parsed.collect()}
    assert {"paracetamol", "furosemide", "amoxicillin", "calcium carbonate", "ferrous sulphate"} <= found
    roots = adapters.roots(spark, DATA)
    assert roots.where(F.col("brand_root").rlike("[0-9]")).count()
    stats = catalog.queries()["scan_stats"](spark, DATA).first()
    assert stats["eligible"] < stats["scanned"]
    assert catalog.queries()["block_stats_maxblock"](spark, DATA).first()["skipped_blocks"] > 0
    assert adapters.products(spark, DATA).where("manufacturer_name IS NOT NULL").count()
    assert catalog.queries()["wide_block_stats"](spark, DATA).first()["n_roots"] > 10_000


def test_products_join_spreads(spark):
    assert adapters.products(spark, "/root/testdata/sf0.1").select(F.expr("row_id % 1009")).distinct().count() == 1009
