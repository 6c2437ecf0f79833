"""Every query of the library by name, with the SQL that DuckDB can hold it against."""

from __future__ import annotations

from . import chain_queries, check_queries, feature_queries, file_queries, manifest_queries, model_queries, report_queries

QUERIES = manifest_queries.QUERIES | report_queries.QUERIES | model_queries.QUERIES | check_queries.QUERIES | file_queries.QUERIES | chain_queries.QUERIES | feature_queries.QUERIES
ORACLES = manifest_queries.ORACLES | report_queries.ORACLES | model_queries.ORACLES | check_queries.ORACLES | file_queries.ORACLES | chain_queries.ORACLES | feature_queries.ORACLES
FLAGSHIP = manifest_queries.split_summary
