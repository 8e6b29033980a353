"""Every registered query with a SQL twin, on the smallest tables, in both engines."""

import math

import duckdb
import pytest

from verdictlake.plans.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks".split()


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


def comparable(rows):
    def cell(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "~"
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f"{float(v):.5f}"
        return str(v)

    return sorted(tuple(map(cell, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, small, name):
    df = QUERIES[name](spark, small)
    columns = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*columns).collect()]
    if name not in ORACLE_SQL:
        assert rows
        return
    result = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert comparable(rows) == comparable(tuple(r[i] for i in at) for r in result.fetchall())


@pytest.mark.parametrize("gone", [("llm",), ("llm", "corpus_pipeline.py")])
def test_entry_imports_without_the_corpus_part(tmp_path, gone):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__", *gone))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not any(n.startswith('op') for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env={**os.environ, "PYTHONPATH": str(tmp_path / "r")})
