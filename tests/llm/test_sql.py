"""Queries of this subpackage that have SQL, against it."""

import duckdb

from quern.llm import registry

DIR = "/root/testdata/sf0.001"


def test_queries_match_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    for name, sql in registry.ORACLE_SQL.items():
        df = registry.QUERIES[name](spark, DIR)
        res = con.execute(sql)
        cols = [d[0] for d in res.description]
        assert sorted(cols) == sorted(df.columns)
        assert sorted(map(repr, res.fetchall())) == sorted(repr(tuple(r)) for r in df.select(*cols).collect())
