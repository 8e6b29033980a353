"""Registered query of checked writes: predictions as calibrated rows, written once, with the counts that the write observed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checked
from ..session import new_folder
from .views import predictions, with_views

Q, SQL = {}, {}


def checked_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """split, rows, hits, reviewed as they are in the table that a checked write made, beside what the write observed over all splits."""
    p = predictions(spark, sf_dir)
    rows = p.select(
        F.col("id").cast("string").alias("id"), "dataset", F.lit("open_qa").alias("task_type"), "split", F.lit("pairwise").alias("head"), F.col("gold").alias("human_label"),
        F.col("predicted").alias("predicted_label"), F.col("confidence").alias("final_score"), "confidence", "risk_score", (F.col("risk_score") > 0.5).alias("review_flag"),
        F.lit(None).cast("string").alias("review_reason"), F.create_map(F.lit("A>B"), F.col("probs")[0], F.lit("B>A"), F.col("probs")[1], F.lit("Tie"), F.col("probs")[2]).alias("label_probabilities"),
    )
    hits, reviewed = (F.coalesce(F.sum(c.cast("long")), F.lit(0)) for c in (F.col("human_label") == F.col("predicted_label"), F.col("review_flag")))
    path, counts = new_folder(spark, "calibrated"), [F.count("*").alias("rows"), hits.alias("hits"), reviewed.alias("reviewed")]
    gates = [("no more hits than rows", lambda c: c["hits"] <= c["rows"])]
    seen = checked.checked_write(rows, path, checked.prediction_rules(), "id", counts, gates)
    there = spark.read.schema(rows.schema).parquet(path).groupBy("split").agg(*counts)
    return there.withColumns({f"observed_{name}": F.lit(seen[name]).cast("long") for name in ("rows", "hits", "reviewed")})


Q["checked_predictions"] = checked_predictions
SQL["checked_predictions"] = with_views(
    """SELECT split, count(*) AS rows, sum(correct::BIGINT)::BIGINT AS hits, sum((risk_score > 0.5)::BIGINT)::BIGINT AS reviewed,
  (SELECT count(*) FROM pred) AS observed_rows, (SELECT sum(correct::BIGINT) FROM pred)::BIGINT AS observed_hits, (SELECT sum((risk_score > 0.5)::BIGINT) FROM pred)::BIGINT AS observed_reviewed
FROM pred GROUP BY split""",
    "pred",
)
