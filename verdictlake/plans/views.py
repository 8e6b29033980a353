"""Judge data derived from the star schema by fixed rules, so that every operator has deterministic input.

Each view has a DuckDB twin in VIEWS_SQL that oracle queries start from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, customer, dataset, split, gold, probs (A>B, B>A, Tie), base_margin and what follows from probs, one row for each order."""
    o = table(spark, sf_dir, "orders")
    status, key, cust = F.col("o_orderstatus"), F.col("o_orderkey"), F.col("o_custkey")
    a = (1 + cust % 7 + F.when(status == "O", 4).otherwise(0)).cast("double")
    b = (1 + key % 5 + F.when(status == "F", 4).otherwise(0)).cast("double")
    t = (1 + (key + cust) % 3 + F.when(status == "P", 2).otherwise(0)).cast("double")
    total = a + b + t
    bucket = key % 100
    rows = o.select(
        key.alias("id"),
        cust.alias("customer"),
        F.col("o_orderpriority").alias("dataset"),
        F.when(bucket < 70, "train").when(bucket < 85, "dev").otherwise("test").alias("split"),
        F.when(status == "O", "A>B").when(status == "F", "B>A").otherwise("Tie").alias("gold"),
        F.array(a / total, b / total, t / total).alias("probs"),
        ((key * 7 + cust) % 21 / 20).alias("base_margin"),
    )
    return metrics.with_derived(rows)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", (F.col("conv_id") * 1000 + F.col("turn")).alias("ordinal"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, dataset, prompt, answer_a, answer_b, context, human_label, bias_type: the first user turn of a conversation, the reply to it, the reply of the next conversation, a whole document as context."""
    m = messages(spark, sf_dir)
    prompt = m.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("prompt"))
    reply = m.where("role = 'assistant'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("answer"))
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id")).alias("conv_id"), F.col("text").alias("context"))
    other = reply.select((F.col("conv_id") - 1).alias("conv_id"), F.col("answer").alias("answer_b"))
    rows = prompt.join(reply.withColumnRenamed("answer", "answer_a"), "conv_id").join(other, "conv_id", "left").join(docs, "conv_id", "left")
    k = F.col("conv_id")
    return rows.select(
        k.alias("id"),
        F.concat(F.lit("d"), (k % 3).cast("string")).alias("dataset"),
        "prompt",
        "answer_a",
        "answer_b",
        "context",
        F.when(k % 4 == 0, "Tie").when(k % 4 == 1, "B>A").otherwise("A>B").alias("human_label"),
        F.when(k % 5 == 0, "position").when(k % 5 == 1, "format").when(k % 5 == 2, "rubric_sensitivity").otherwise("none").alias("bias_type"),
        F.when(k % 6 == 0, F.lit(None).cast("string")).when(k % 6 < 3, "A>B").when(k % 6 == 3, "Tie").otherwise("B>A").alias("predicted"),
    )


VIEWS_SQL = {
    "pred": """pred0 AS (
  SELECT o_orderkey AS id, o_custkey AS customer, o_orderpriority AS dataset,
    CASE WHEN o_orderkey % 100 < 70 THEN 'train' WHEN o_orderkey % 100 < 85 THEN 'dev' ELSE 'test' END AS split,
    CASE o_orderstatus WHEN 'O' THEN 'A>B' WHEN 'F' THEN 'B>A' ELSE 'Tie' END AS gold,
    (1 + o_custkey % 7 + CASE WHEN o_orderstatus = 'O' THEN 4 ELSE 0 END)::DOUBLE AS wa,
    (1 + o_orderkey % 5 + CASE WHEN o_orderstatus = 'F' THEN 4 ELSE 0 END)::DOUBLE AS wb,
    (1 + (o_orderkey + o_custkey) % 3 + CASE WHEN o_orderstatus = 'P' THEN 2 ELSE 0 END)::DOUBLE AS wt,
    ((o_orderkey * 7 + o_custkey) % 21) / 20.0::DOUBLE AS base_margin
  FROM orders
), pred1 AS (
  SELECT id, customer, dataset, split, gold, base_margin, wa / (wa + wb + wt) AS pa, wb / (wa + wb + wt) AS pb, wt / (wa + wb + wt) AS pt FROM pred0
), pred2 AS (
  SELECT *, greatest(pa, pb, pt) AS confidence, CASE WHEN pa >= pb AND pa >= pt THEN 'A>B' WHEN pb >= pt THEN 'B>A' ELSE 'Tie' END AS predicted FROM pred1
), pred AS (
  SELECT *, 1 - confidence AS risk_score, gold = predicted AS correct, least(9, floor(confidence * 10))::INTEGER AS bin,
    CASE gold WHEN 'A>B' THEN pa WHEN 'B>A' THEN pb ELSE pt END AS pgold FROM pred2
)""",
    "samples": """prompt AS (
  SELECT conv_id, arg_min(text, turn) AS prompt FROM conversations WHERE role = 'user' GROUP BY conv_id
), reply AS (
  SELECT conv_id, arg_min(text, turn) AS answer FROM conversations WHERE role = 'assistant' GROUP BY conv_id
), samples AS (
  SELECT p.conv_id AS id, 'd' || (p.conv_id % 3)::VARCHAR AS dataset, prompt, r.answer AS answer_a, s.answer AS answer_b, d.text AS context,
    CASE p.conv_id % 4 WHEN 0 THEN 'Tie' WHEN 1 THEN 'B>A' ELSE 'A>B' END AS human_label,
    CASE p.conv_id % 5 WHEN 0 THEN 'position' WHEN 1 THEN 'format' WHEN 2 THEN 'rubric_sensitivity' ELSE 'none' END AS bias_type,
    CASE WHEN p.conv_id % 6 = 0 THEN NULL WHEN p.conv_id % 6 < 3 THEN 'A>B' WHEN p.conv_id % 6 = 3 THEN 'Tie' ELSE 'B>A' END AS predicted
  FROM prompt p JOIN reply r ON r.conv_id = p.conv_id LEFT JOIN reply s ON s.conv_id = p.conv_id + 1 LEFT JOIN documents d ON d.doc_id = p.conv_id
)""",
}


def normalised(c: str) -> str:
    """DuckDB's twin of text.normalize for inputs without wide spaces."""
    return f"trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g'))"


def with_views(sql: str, *views: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(VIEWS_SQL[v] for v in views) + "\n" + sql


