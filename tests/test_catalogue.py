"""Every query that has SQL gives the rows of that SQL on the smallest tables."""

import math

import duckdb
import pytest

from lodestone.plans import catalogue, pixels, studies  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(frame):
    def cell(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        try:
            return f"{float(v):.6f}"
        except (TypeError, ValueError):
            return "null" if str(v) in ("<NA>", "NaT") else str(v)

    return sorted(tuple(map(cell, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    assert plain(catalogue.QUERIES[name](spark, SF).toPandas()) == plain(duck.execute(catalogue.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_gives_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0
