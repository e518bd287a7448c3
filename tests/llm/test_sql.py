"""Queries of the subpackage that SQL can express, against it."""

import duckdb
import pytest

from tracewell.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "conversations", "labels", "pages"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    cur = c.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(r[names.index(k)] for k in cols) for r in cur.fetchall()), key=repr)
    assert sorted(map(tuple, df.select(*cols).collect()), key=repr) == want
