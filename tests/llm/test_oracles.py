"""Queries against their SQL."""

import duckdb
import pytest

from tests.conftest import SF
from veilspan.llm.oracles import ORACLES
from veilspan.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark", "conversations"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    theirs = con.execute(ORACLES[name])
    columns = [c[0] for c in theirs.description]
    mine = QUERIES[name](spark, SF)
    assert sorted(mine.columns) == sorted(columns)
    assert sorted(map(tuple, mine.select(*columns).collect())) == sorted(theirs.fetchall())
