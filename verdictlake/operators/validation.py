"""Validation, completeness and quality control: rules as columns, evaluated in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that a row breaks, ok if none."""
    out = None
    for name, broken in rules:
        out = F.when(broken, name) if out is None else out.when(broken, name)
    return out.otherwise("ok") if out is not None else F.lit("ok")


def issues(rules: list[tuple[str, Column]]) -> Column:
    """The names of all rules that a row breaks."""
    return F.array_compact(F.array(*(F.when(broken, name) for name, broken in rules)))


def rule_counts(df: DataFrame, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """rule, severity and how many rows break it, for every rule; one aggregation."""
    found = df.agg(*(F.sum(F.coalesce(broken, F.lit(False)).cast("long")).alias(f"r{i}") for i, (_, _, broken) in enumerate(rules)))
    pairs = F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity"), F.coalesce(F.col(f"r{i}"), F.lit(0)).alias("rows")) for i, (name, severity, _) in enumerate(rules)))
    return found.select(F.explode(pairs).alias("p")).select("p.*")


def completeness(df: DataFrame, columns: list[str]) -> DataFrame:
    """field, n and how many values are null, empty, white space only, present; one aggregation."""
    aggregates = []
    for i, c in enumerate(columns):
        kind = T.missing_kind(F.col(c).cast("string"))
        aggregates += [F.sum(F.when(kind == k, 1).otherwise(0)).alias(f"{k}{i}") for k in ("null", "empty", "whitespace")]
    row = df.agg(F.count("*").alias("n"), *aggregates)
    cells = F.array(*(F.struct(F.lit(c).alias("field"), *(F.coalesce(F.col(f"{k}{i}"), F.lit(0)).alias(f"{k}_count") for k in ("null", "empty", "whitespace"))) for i, c in enumerate(columns)))
    out = row.select("n", F.explode(cells).alias("x")).select("x.field", "n", "x.null_count", "x.empty_count", "x.whitespace_count")
    return out.withColumn("present", F.col("n") - F.col("null_count") - F.col("empty_count") - F.col("whitespace_count"))


def distributions(df: DataFrame, columns: list[str]) -> DataFrame:
    """dimension, value, n for each value of each column; one pass over the rows."""
    rows = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("dimension"), F.coalesce(F.col(c).cast("string"), F.lit("none")).alias("value")) for c in columns))).alias("x"))
    return rows.groupBy("x.dimension", "x.value").agg(F.count("*").alias("n"))


def dataset_statistics(df: DataFrame, group: str, text: str) -> DataFrame:
    """group, n, mean, least and greatest length of a text, and the share of empty ones."""
    n = F.length(F.coalesce(F.col(text), F.lit("")))
    return df.groupBy(group).agg(F.count("*").alias("n"), F.avg(n.cast("double")).alias("mean_chars"), F.min(n).alias("min_chars"), F.max(n).alias("max_chars"), F.avg((n == 0).cast("double")).alias("empty_share"))
