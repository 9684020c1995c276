"""Every query with SQL gives what DuckDB gives on the same tables, whatever the partitions are."""

import math

import duckdb
import pytest

from factloom.plans import articles, facts, runs, scores, streams, texts  # noqa: F401
from factloom.plans.registry import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    v = v.tolist() if hasattr(v, "tolist") else v
    return int(v) if isinstance(v, float) and v == int(v) else v


def rows(pdf):
    names = sorted(pdf.columns)
    return names, sorted(repr([cell(v) for v in r]) for r in pdf[names].astype(object).where(pdf[names].notna(), None).values.tolist())


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = rows(QUERIES[name](spark, FOLDER).toPandas())
    assert got[1]
    if name in SQL:
        assert got == rows(duck.sql(SQL[name]).df())


@pytest.mark.parametrize("name", ["near_dup_pairs", "greedy_pack", "cosine_components", "fact_routing", "bullet_entries"])
def test_results_do_not_depend_on_partitions(spark, name):
    first = rows(QUERIES[name](spark, FOLDER).toPandas())
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert rows(QUERIES[name](spark, FOLDER).toPandas()) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
