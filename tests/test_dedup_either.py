"""dedup_either against its SQL where source and length run together, and where they are null."""

import duckdb

from verdictlake.plans.queries import ORACLE_SQL, QUERIES


def test_source_and_length_are_one_text(spark, tmp_path):
    rows = [(1, "a", "src1", 234), (2, "b", "src12", 34), (3, "c", None, 7), (4, "d", "-", 7), (5, "e", "src1", None), (6, "f", "src1", None), (7, "e", "src2", 9), (8, "a", "src12", 34), (9, "b", "src3", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(duck.execute(ORACLE_SQL["dedup_either"]).fetchall())
    assert [x for x, _ in want] == [2, 4, 7, 8]
    assert sorted(tuple(r) for r in QUERIES["dedup_either"](spark, str(tmp_path)).collect()) == want
