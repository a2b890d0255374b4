"""All registered queries: name -> (spark, sf_dir) -> DataFrame, and the DuckDB SQL of each."""

from __future__ import annotations

from sluice.plans import queries, queries_more, queries_sources  # noqa: F401  all register with the first

FLAGSHIP = "flagship_gate"
QUERIES: dict = dict(queries.QUERIES)
ORACLE_SQL: dict = dict(queries.ORACLE_SQL)
