"""Queries of the corpus part against their SQL twins, on the smallest tables."""

import duckdb
import pytest

from verdictlake.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_twin(spark, small, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "sale_lines"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    df = QUERIES[name](spark, small)
    columns = sorted(df.columns)
    text = lambda v: f"{v:.3f}" if isinstance(v, float) else str(v)
    result = c.execute(ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(tuple(text(r[names.index(x)]) for x in columns) for r in result.fetchall())
    assert sorted(tuple(map(text, r)) for r in df.select(*columns).collect()) == want
