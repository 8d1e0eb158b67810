"""Queries of the subpackage against their SQL twins, over whole tables."""

import duckdb
import pytest

from loomstate.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    told = con.execute(queries.ORACLE_SQL[name]).df()
    columns = sorted(told.columns)
    found = queries.QUERIES[name](spark, SF).toPandas()
    assert sorted(found.columns) == columns
    plain = lambda x: sorted(map(str, x[columns].astype(object).where(x[columns].notna(), None).values.tolist()))
    assert plain(found) == plain(told)
