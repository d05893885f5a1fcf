import math

import duckdb
import pytest

from strandwise.llm.queries import ORACLE_SQL, QUERIES


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0])))
def test_query(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    rows, columns = df.collect(), sorted(df.columns)
    assert rows
    if name in ORACLE_SQL:
        con = duckdb.connect()
        for t in ("documents", "conversations"):
            con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
        got = con.execute(ORACLE_SQL[name])
        names = [d[0] for d in got.description]
        assert sorted(names) == columns
        want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in got.fetchall())
        assert sorted(tuple(plain(r[c]) for c in columns) for r in rows) == want
