"""Registry of the queries over the driver's tables: name -> (spark, sf_dir) -> DataFrame, and their DuckDB SQL."""

from __future__ import annotations

from quern.plans import builds, curated, dataset, drive, flows, memory, ops, retrieval, texts

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _m in (retrieval, texts, ops, curated, drive, memory, dataset, builds, flows):
    QUERIES |= _m.QUERIES
    ORACLE_SQL |= _m.ORACLE_SQL
