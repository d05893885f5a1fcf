"""Queries through files and over lines, against their SQL."""

import math

import duckdb
import pytest

from strandwise import evidence_queries, file_queries, oracles

QUERIES = file_queries.QUERIES | evidence_queries.QUERIES
TABLES = ("region", "nation", "customer", "supplier", "part", "events", "documents")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    rows, columns = df.collect(), sorted(df.columns)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = con.execute(oracles.SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == columns and rows
    want = sorted(tuple(plain(float(r[names.index(c)]) if "Decimal" in type(r[names.index(c)]).__name__ else r[names.index(c)]) for c in columns) for r in got.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in rows) == want
