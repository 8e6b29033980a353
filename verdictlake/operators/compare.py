"""Comparison of systems and runs: deltas, review capture, swap consistency, ablation of policies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from .ranking import joined


def deltas(metrics: DataFrame, system: str, baseline: str, columns: list[str]) -> DataFrame:
    """Every system's metrics with their differences from the baseline's."""
    base = metrics.where(F.col(system) == baseline).select(*(F.col(c).alias(f"_{c}") for c in columns))
    rows = metrics.join(F.broadcast(base.limit(1)), how="left")  # one row
    return rows.select(*metrics.columns, *((F.col(c) - F.col(f"_{c}")).alias(f"{c}_delta") for c in columns))


def review_capture(df: DataFrame, by: list[str], threshold: float) -> DataFrame:
    """by, n, review_rate, the share of errors among reviewed rows and the accuracy of the rest."""
    flag = F.col("risk_score") >= threshold
    one = lambda c: F.sum(c.cast("long"))
    parts = df.groupBy(*by).agg(F.count("*").alias("n"), one(flag).alias("reviewed"), one(~F.col("correct")).alias("errors"), one(flag & ~F.col("correct")).alias("captured"))
    rest, left = F.col("n") - F.col("reviewed"), F.col("errors") - F.col("captured")
    return parts.select(*by, "n", (F.col("reviewed") / F.col("n")).alias("review_rate"), F.try_divide(F.col("captured").cast("double"), F.col("errors")).alias("capture_rate"), F.try_divide((rest - left).cast("double"), rest).alias("auto_accuracy"))


def swap_consistency(original: DataFrame, swapped: DataFrame, key: str = "id") -> DataFrame:
    """dataset (all: every one), n, consistent, always_first: verdicts on exchanged answers against the original ones."""
    a = original.select(key, "dataset", F.col("predicted").alias("p"))
    b = swapped.select(key, F.col("predicted").alias("q"))
    rows = a.join(b, key).select("dataset", (F.col("p") == S.invert(F.col("q"))).alias("same"), ((F.col("p") == "A>B") & (F.col("q") == "A>B")).alias("first"))
    out = rows.rollup("dataset").agg(F.count("*").alias("n"), F.avg(F.col("same").cast("double")).alias("consistent"), F.avg(F.col("first").cast("double")).alias("always_first"), F.grouping("dataset").alias("g"))
    return out.select(F.when(F.col("g") == 1, "all").otherwise(F.col("dataset")).alias("dataset"), "n", "consistent", "always_first")


def error_taxonomy(df: DataFrame, by: list[str]) -> DataFrame:
    """by, gold, predicted, n and the share among the gold label's rows; correct rows left out."""
    counts = df.groupBy(*by, "gold", "predicted").agg(F.count("*").alias("n"))
    total = df.groupBy(*by, "gold").agg(F.count("*").alias("of"))
    return joined(counts.where("gold <> predicted"), total, [*by, "gold"]).select(*by, "gold", "predicted", "n", (F.col("n") / F.col("of")).alias("share"))


def unpivot_metrics(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    return df.unpivot(keys, columns, "metric", "value")
