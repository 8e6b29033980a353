"""Joins keyed by id: coverage, repair, pairs of replies, annotations. Joins carry keys and what is asked for, no more."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """The last row of each key by ordinal; combined before the shuffle."""
    others = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*others), ordinal).alias("_r")).select(key, *(F.col(f"_r.{c}").alias(c) for c in others))


def uncovered(required: DataFrame, judged: DataFrame, key: str = "id") -> DataFrame:
    """Required keys without a judgement."""
    return required.select(key).distinct().join(judged.select(key).distinct(), key, "left_anti")


def coverage_report(required: DataFrame, judged: DataFrame, key: str = "id") -> DataFrame:
    """One row: required and judged keys, covered ones and their share."""
    have = judged.select(key).distinct().withColumn("_have", F.lit(1))
    rows = required.select(key).distinct().join(have, key, "left")
    return rows.agg(F.count("*").alias("required"), F.count("_have").alias("covered"), F.coalesce(F.try_divide(F.count("_have").cast("double"), F.count("*")), F.lit(0.0)).alias("coverage"))


def repair_merge(required: DataFrame, original: DataFrame, retry: DataFrame, valid: str, key: str = "id", columns: tuple[str, ...] = ()) -> DataFrame:
    """A row for each required key: the valid retry, else the valid original; resolution says which, or unresolved."""
    take = lambda df, name: df.where(valid).select(key, F.struct(*(columns or [c for c in df.columns if c != key])).alias(name))
    joined = required.select(key).join(take(retry, "_retry"), key, "left").join(take(original, "_original"), key, "left")
    chosen = F.coalesce("_retry", "_original")
    names = columns or [c for c in original.columns if c != key]
    how = F.when(F.col("_retry").isNotNull(), "retry").when(F.col("_original").isNotNull(), "original").otherwise("unresolved")
    return joined.select(key, *(chosen[c].alias(c) for c in names), how.alias("resolution"))


def reply_pairs(messages: DataFrame, parent_role: str = "user", reply_role: str = "assistant") -> DataFrame:
    """Prompt messages with their replies: (conv_id, turn) joined with the reply one turn later."""
    prompts = messages.where(F.col("role") == parent_role).select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("prompt"))
    replies = messages.where(F.col("role") == reply_role).select("conv_id", "turn", F.col("text").alias("reply"))
    return prompts.join(replies, ["conv_id", "turn"])


def with_gaps(samples: DataFrame, predictions: DataFrame, gaps: DataFrame) -> DataFrame:
    """Samples with their prediction, if any, and their dataset's accuracy gap, if any."""
    return samples.join(predictions, "id", "left").join(F.broadcast(gaps), "dataset", "left")  # a row for each dataset


def transitions(first: DataFrame, second: DataFrame, key: str = "id") -> DataFrame:
    """before, after, n: how predictions of one run turn into those of another."""
    a, b = first.select(key, F.col("predicted").alias("before")), second.select(key, F.col("predicted").alias("after"))
    return a.join(b, key).groupBy("before", "after").agg(F.count("*").alias("n"))
