"""Registered query of the JSON audit; its twin walks the texts by json_tree."""

from __future__ import annotations

from ..operators import json_audit
from .views import table

Q, SQL = {}, {}

Q["json_path_audit"] = lambda spark, d: json_audit.json_paths(table(spark, d, "clicks"), "props", ["kind"])
SQL["json_path_audit"] = r"""WITH texts AS (
  SELECT kind, props, CASE WHEN json_valid(props) THEN props END AS good FROM clicks
), found AS (
  SELECT kind, regexp_replace(replace(t.fullkey, '"', ''), '\[\d+\]', '[*]', 'g') AS shape, t.type AS kind_of, t.atom ->> '$' AS value FROM texts, json_tree(texts.good) t WHERE good IS NOT NULL
)
SELECT kind, shape, CASE WHEN kind_of IN ('UBIGINT', 'BIGINT', 'HUGEINT') THEN 'integer' WHEN kind_of = 'DOUBLE' THEN 'number' WHEN kind_of = 'VARCHAR' THEN 'string' ELSE lower(kind_of) END AS type,
  count(*) AS n, count(*) FILTER (kind_of = 'VARCHAR' AND regexp_matches(value, '^\s*$'))::BIGINT AS n_blank
FROM found GROUP BY ALL
UNION ALL
SELECT kind, '$', CASE WHEN props IS NULL THEN 'missing' ELSE 'malformed' END, count(*), 0 FROM texts WHERE good IS NULL GROUP BY ALL"""
