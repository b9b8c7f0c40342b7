"""The SQL twins of this folder's queries on the smallest tables, and all queries' names."""

from pathlib import Path

import duckdb
import pytest

from ctxengine.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        db.sql(f"create view {p.stem} as select * from '{p}'")
    got = queries.QUERIES[name](spark, SF)
    want = db.sql(queries.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    key = lambda r: repr([float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r])
    mine = sorted(key([r[c] for c in columns]) for r in got.collect())
    at = [list(want.columns).index(c) for c in columns]
    assert mine == sorted(key([r[i] for i in at]) for r in want.fetchall())


def test_one_query_for_each_operator():
    import __spark_entry__ as entry

    names = list(entry.queries())
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names
