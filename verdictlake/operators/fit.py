"""Scaling of feature columns, and fitted softmax weights as column expressions; heads.py and calibration.py hold the fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def standardise(df: DataFrame, columns: list[str], train: Column) -> DataFrame:
    """columns scaled by mean and population deviation of the rows where train holds (a deviation of nearly 0 counts as 1)."""
    stats = df.where(train).agg(*(x for c in columns for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))))
    scaled = df.crossJoin(F.broadcast(stats))  # one row
    return scaled.select(*(c for c in df.columns if c not in columns), *(((F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") < 1e-8, 1.0).otherwise(F.col(f"s_{c}"))).alias(c) for c in columns))


def apply_softmax(features: str, weights: list[float], classes: int) -> Column:
    """Class probabilities of a feature array by fitted weights, as a column expression."""
    from ..functions import scores as S

    width = len(weights) // classes
    z = []
    for k in range(classes):
        row = F.array(*(F.lit(float(v)) for v in weights[k * width : (k + 1) * width - 1])).cast("array<double>")
        dot = F.aggregate(F.zip_with(F.col(features), row, lambda a, b: a.cast("double") * b), F.lit(float(weights[(k + 1) * width - 1])), lambda s, v: s + F.coalesce(v, F.lit(0.0)))
        z.append(dot)
    return S.softmax(F.array(*z))
