"""All registered queries of the library and their DuckDB twins."""

from __future__ import annotations

from . import checked_queries, evidence_queries, head_queries, json_queries, metric_queries, more_queries, overlay_queries, report_queries, sample_queries

QUERIES = {**metric_queries.Q, **sample_queries.Q, **more_queries.Q, **report_queries.Q, **head_queries.Q, **evidence_queries.Q, **overlay_queries.Q, **json_queries.Q, **checked_queries.Q}
ORACLE_SQL = {**metric_queries.SQL, **sample_queries.SQL, **more_queries.SQL, **report_queries.SQL, **head_queries.SQL, **evidence_queries.SQL, **overlay_queries.SQL, **json_queries.SQL, **checked_queries.SQL}
