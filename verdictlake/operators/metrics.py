"""Metrics of predictions, each one grouped aggregation over the rows.

A prediction frame has gold and predicted (labels), probs (array in the order of labels) and
confidence. Every operator first reduces the rows to counts per group, label pair and confidence
bin, combined before the shuffle; what follows works on that small table.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..schemas import PAIRWISE
from ..session import map_batches
from .ranking import joined


def with_derived(df: DataFrame, labels=PAIRWISE) -> DataFrame:
    """Adds predicted (by argmax), confidence, risk_score, correct and bin from gold and probs."""
    names = F.array(*(F.lit(x) for x in labels))
    return (
        df.withColumn("predicted", F.get(names, S.argmax(F.col("probs"))))
        .withColumn("confidence", F.array_max("probs"))
        .withColumn("risk_score", 1 - F.col("confidence"))
        .withColumn("correct", F.col("gold") == F.col("predicted"))
        .withColumn("bin", S.bin_of(F.col("confidence")))
    )


def _f1(counts: Column, gold_total: Column, predicted_total: Column) -> Column:
    return F.coalesce(F.try_divide(2.0 * counts, gold_total + predicted_total), F.lit(0.0))


def metric_bundle(df: DataFrame, by: list[str], labels=PAIRWISE, tie: str = "Tie") -> DataFrame:
    """by, n, accuracy, macro_f1 (labels absent from both sides skipped), ece, brier, nll and tie_recall.

    Two aggregations: rows to (group, bin) partial sums, these to groups. Shuffles carry at most
    ten rows for each group and task.
    """
    gold_at = F.array_position(F.array(*(F.lit(x) for x in labels)), F.col("gold")).cast("int") - 1
    rows = df.withColumn("_brier", S.brier(F.col("probs"), gold_at)).withColumn("_nll", -F.ln(F.get("probs", gold_at) + 1e-12))
    one = lambda c: F.sum(c.cast("long"))
    parts = [F.count("*").alias("n"), one(F.col("correct")).alias("hits"), F.sum("confidence").alias("conf"), F.sum("_brier").alias("brier"), F.sum("_nll").alias("nll")]
    for k, label in enumerate(labels):
        parts += [
            one((F.col("gold") == label) & (F.col("predicted") == label)).alias(f"both{k}"),
            one(F.col("gold") == label).alias(f"gold{k}"),
            one(F.col("predicted") == label).alias(f"pred{k}"),
        ]
    binned = rows.groupBy(*by, "bin").agg(*parts)
    total = F.sum("n")
    sums = [total.alias("n"), (F.sum("hits") / total).alias("accuracy"), (F.sum(F.abs(F.col("hits") - F.col("conf"))) / total).alias("ece"), (F.sum("brier") / total).alias("brier"), (F.sum("nll") / total).alias("nll")]
    sums += [F.sum(f"{name}{k}").alias(f"{name}{k}") for k in range(len(labels)) for name in ("both", "gold", "pred")]
    out = binned.groupBy(*by).agg(*sums)
    present = [F.when(F.col(f"gold{k}") + F.col(f"pred{k}") > 0, _f1(F.col(f"both{k}"), F.col(f"gold{k}"), F.col(f"pred{k}"))) for k in range(len(labels))]
    f1 = reduce(lambda a, b: a + b, (F.coalesce(x, F.lit(0.0)) for x in present)) / F.greatest(F.lit(1), reduce(lambda a, b: a + b, (x.isNotNull().cast("int") for x in present)))
    t = labels.index(tie) if tie in labels else None
    recall = F.try_divide(F.col(f"both{t}").cast("double"), F.col(f"gold{t}")) if t is not None else F.lit(None).cast("double")
    return out.select(*by, "n", "accuracy", f1.alias("macro_f1"), "ece", "brier", "nll", recall.alias("tie_recall"))


def confusion(df: DataFrame, labels=PAIRWISE) -> DataFrame:
    """One row for each gold label with a count for each predicted one, zeros included."""
    counts = df.groupBy("gold").agg(*(F.sum((F.col("predicted") == x).cast("long")).alias(f"pred_{k}") for k, x in enumerate(labels)))
    every = df.sparkSession.range(1).select(F.explode(F.array(*(F.lit(x) for x in labels))).alias("gold"))
    return every.join(counts, "gold", "left").na.fill(0)


def reliability_bins(df: DataFrame, bins: int = 10) -> DataFrame:
    """bin, n, accuracy, confidence and gap for every bin, empty ones included."""
    found = df.groupBy("bin").agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy"), F.avg("confidence").alias("confidence"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    joined = every.join(found, "bin", "left").na.fill(0)
    return joined.withColumn("gap", F.abs(F.col("accuracy") - F.col("confidence")))


def calibration_metrics(df: DataFrame) -> DataFrame:
    """One row: n, accuracy, ece, mce."""
    bins = df.groupBy("bin").agg(F.count("*").alias("n"), F.sum(F.col("correct").cast("double")).alias("hits"), F.sum("confidence").alias("conf"))
    gap = F.abs(F.col("hits") - F.col("conf"))
    return bins.agg(F.sum("n").alias("n"), (F.sum("hits") / F.sum("n")).alias("accuracy"), (F.sum(gap) / F.sum("n")).alias("ece"), F.max(gap / F.col("n")).alias("mce"))


def accuracy_gaps(df: DataFrame) -> DataFrame:
    """dataset and the difference of its accuracy from that of all rows."""
    per = df.groupBy("dataset").agg(F.count("*").alias("n"), F.sum(F.col("correct").cast("long")).alias("hits"))
    whole = Window.partitionBy()  # over a row for each dataset
    return per.select("dataset", "n", (F.col("hits") / F.col("n") - F.sum("hits").over(whole) / F.sum("n").over(whole)).alias("gap"))


def summary_by_sets(df: DataFrame, sets: list[str]) -> DataFrame:
    """section, key, n, accuracy, tie_rate: all rows and each value of each column, one pass over the rows."""
    rows = df.select(F.explode(F.array(F.struct(F.lit("overall").alias("section"), F.lit("all").alias("key")), *(F.struct(F.lit(c).alias("section"), F.coalesce(F.col(c).cast("string"), F.lit("none")).alias("key")) for c in sets))).alias("s"), "correct", "predicted")
    return rows.groupBy("s.section", "s.key").agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy"), F.avg((F.col("predicted") == "Tie").cast("double")).alias("tie_rate"))


def kappa(df: DataFrame, first: str, second: str, by: list[str]) -> DataFrame:
    """Cohen's kappa of two label columns, from their joint counts; 1 where chance agreement is complete. Null is a label and a group like others."""
    joint = df.groupBy(*by, F.col(first).alias("x"), F.col(second).alias("y")).agg(F.count("*").alias("c"))
    n = joint.groupBy(*by).agg(F.sum("c").alias("n"), F.sum(F.when(F.col("x").eqNullSafe(F.col("y")), F.col("c")).otherwise(0)).alias("agree"))
    xs = joint.groupBy(*by, F.col("x").alias("label")).agg(F.sum("c").alias("nx"))
    ys = joint.groupBy(*by, F.col("y").alias("label")).agg(F.sum("c").alias("ny"))
    chance = joined(xs, ys, [*by, "label"]).groupBy(*by).agg(F.sum(F.col("nx").cast("double") * F.col("ny")).alias("chance"))
    po, pe = F.col("agree") / F.col("n"), F.coalesce(F.col("chance"), F.lit(0.0)) / (F.col("n").cast("double") * F.col("n"))
    return (joined(n, chance, by, "left") if by else n.crossJoin(chance)).select(*by, "n", po.alias("agreement"), F.when(pe == 1, 1.0).otherwise((po - pe) / (1 - pe)).alias("kappa"))


def seed_summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean, std (sample; 0 for a single value), min and max of a column."""
    return df.groupBy(*by).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.min(value).alias("min"), F.max(value).alias("max")
    )


def discordant(df: DataFrame, a: str, b: str) -> DataFrame:
    """Of two systems' correctness columns: rows, and how often only the one or the other is right (as for McNemar's test)."""
    count = lambda c: F.sum(c.cast("long"))
    return df.agg(F.count("*").alias("n"), count(F.col(a) & ~F.col(b)).alias("only_a"), count(~F.col(a) & F.col(b)).alias("only_b"))


def mcnemar_p(only_a: int, only_b: int, exact_up_to: int = 200) -> float:
    """Two-sided p of McNemar's test: binomial for few discordant pairs, else chi-square with continuity correction."""
    from math import comb, erfc, sqrt

    n = only_a + only_b
    if n == 0:
        return 1.0
    if n <= exact_up_to:
        return min(1.0, 2 * sum(comb(n, k) for k in range(min(only_a, only_b) + 1)) / 2**n)
    return erfc(sqrt((abs(only_a - only_b) - 1) ** 2 / n / 2))


#: Resamples, and the seed of the hash from which rows draw their weights.
RESAMPLES, SEED = 1000, 7


def _resampled(df: DataFrame, by: list[str], parts: list[Column], width: int, resamples: int, seed: int, identity: str) -> DataFrame:
    """by, resample and sums s0, s1, ...: weighted sums of each row's parts for every resample by the Poisson bootstrap.

    A row's weight in a resample is drawn from a hash of its id, so reruns agree. Weights are made and
    used up a batch at a time: what is shuffled are the sums of a task, resamples rows a group.
    """

    def add(batches):
        totals: dict[tuple, np.ndarray] = {}
        cuts, mass, total = [], math.exp(-1), 0.0
        for k in range(9):  # Poisson(1) by inversion
            total += mass
            cuts.append(min(2**64 - 1, int(total * 2**64)))
            mass /= k + 1
        steps = np.arange(1, resamples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                keys = list(zip(*(part.column(i).to_pylist() for i in range(len(by))))) if by else [()] * part.num_rows
                h = part.column(len(by)).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                z = h[:, None] + steps[None, :]  # splitmix64
                z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                z ^= z >> np.uint64(31)
                weight = np.zeros(z.shape)
                for c in cuts:
                    weight += z >= np.uint64(c)
                values = np.array(part.column(len(by) + 1).to_pylist(), float).reshape(part.num_rows, width)
                for key in set(keys):
                    rows = [i for i, k in enumerate(keys) if k == key]
                    totals[key] = totals.get(key, 0) + weight[rows].T @ values[rows]
        for key, sums in totals.items():
            columns = [pa.array([k] * resamples, pa.string()) for k in key] + [pa.array(np.arange(resamples, dtype=np.int32))]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(sums[:, i]) for i in range(width))], names=[*by, "resample", *(f"s{i}" for i in range(width))])

    rows = df.select(*(F.col(c).cast("string").alias(c) for c in by), F.xxhash64(F.col(identity), F.lit(seed)).alias("h"), F.array(*(x.cast("double") for x in parts)).alias("parts"))
    schema = ", ".join([*(f"`{c}` string" for c in by), "resample int", *(f"s{i} double" for i in range(width))])
    sums = map_batches(rows, add, schema)
    return sums.groupBy(*by, "resample").agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(width)))


def _cells(predicted: str, labels) -> list[Column]:
    return [(F.col("gold") == g) & (F.col(predicted) == p) for g in labels for p in labels]


def _from_cells(at: int, n: int) -> tuple[Column, Column, list[Column], list[Column]]:
    """accuracy and macro-F1 (labels on neither side skipped) from the sums of _cells, with the counts of right and of gold labels."""
    c = [[F.col(f"s{at + g * n + p}") for p in range(n)] for g in range(n)]
    add = lambda xs: reduce(lambda a, b: a + b, xs)
    both, gold, pred = [c[k][k] for k in range(n)], [add(c[k]) for k in range(n)], [add([c[g][k] for g in range(n)]) for k in range(n)]
    f1 = [F.try_divide(2.0 * both[k], gold[k] + pred[k]) for k in range(n)]
    macro = add([F.coalesce(x, F.lit(0.0)) for x in f1]) / F.greatest(F.lit(1), add([x.isNotNull().cast("int") for x in f1]))
    return F.try_divide(add(both), add(gold)), macro, both, gold


def _intervals(values: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    quantiles = [F.percentile(x, F.array(F.lit(0.025), F.lit(0.975))).alias(x) for x in names]  # linear between order statistics
    wide = values.groupBy(*by).agg(*quantiles) if by else values.agg(*quantiles)
    cells = F.explode(F.array(*(F.struct(F.lit(x).alias("metric"), F.col(x)[0].alias("low"), F.col(x)[1].alias("high")) for x in names)))
    return wide.select(*by, cells.alias("c")).select(*by, "c.*")


METRICS = ("accuracy", "macro_f1", "ece", "brier", "tie_recall")


def bootstrap_metrics(df: DataFrame, by: list[str], labels=PAIRWISE, tie: str = "Tie", resamples: int = RESAMPLES, seed: int = SEED, identity: str = "id") -> DataFrame:
    """by, metric, point, low, high and n: 95 % percentile intervals of accuracy, macro-F1, ECE, Brier score and tie recall.

    Resamples without a gold tie have no tie recall. Groups come back as strings.
    """
    gold_at = F.array_position(F.array(*(F.lit(x) for x in labels)), F.col("gold")).cast("int") - 1
    k = len(labels)
    rows = df.withColumn("_brier", S.brier(F.col("probs"), gold_at))
    parts = _cells("predicted", labels) + [F.col("_brier")]
    parts += [F.when(F.col("bin") == b, F.col("correct").cast("double") - F.col("confidence")).otherwise(0.0) for b in range(10)]
    sums = _resampled(rows, by, parts, k * k + 11, resamples, seed, identity)
    accuracy, macro, both, gold = _from_cells(0, k)
    n = reduce(lambda a, b: a + b, gold)
    ece = F.try_divide(reduce(lambda a, b: a + b, (F.abs(F.col(f"s{k * k + 1 + b}")) for b in range(10))), n)
    recall = F.try_divide(both[labels.index(tie)], gold[labels.index(tie)]) if tie in labels else F.lit(None).cast("double")
    values = sums.select(*by, accuracy.alias("accuracy"), macro.alias("macro_f1"), ece.alias("ece"), F.try_divide(F.col(f"s{k * k}"), n).alias("brier"), recall.alias("tie_recall"))
    point = metric_bundle(df.select(*(F.col(c).cast("string").alias(c) if c in by else F.col(c) for c in df.columns)), by, labels, tie)
    cells = F.explode(F.array(*(F.struct(F.lit(x).alias("metric"), F.col(x).alias("point")) for x in METRICS)))
    long = point.select(*by, "n", cells.alias("c")).select(*by, "n", "c.*")
    return long.join(_intervals(values, by, list(METRICS)), [*by, "metric"])


def bootstrap_deltas(df: DataFrame, other: str, by: list[str], labels=PAIRWISE, resamples: int = RESAMPLES, seed: int = SEED, identity: str = "id") -> DataFrame:
    """by, metric, delta, low and high: accuracy and macro-F1 of predicted less those of the column other, resampled in pairs."""
    k = len(labels)
    width = 2 * k * k
    parts = _cells("predicted", labels) + _cells(other, labels)
    first, second = _from_cells(0, k), _from_cells(k * k, k)
    delta = [(first[i] - second[i]).alias(name) for i, name in enumerate(("accuracy", "macro_f1"))]
    values = _resampled(df, by, parts, width, resamples, seed, identity).select(*by, *delta)
    whole = df.groupBy(*(F.col(c).cast("string").alias(c) for c in by)).agg(*(F.sum(x.cast("double")).alias(f"s{i}") for i, x in enumerate(parts))).select(*by, *delta)
    cells = F.explode(F.array(*(F.struct(F.lit(x).alias("metric"), F.col(x).alias("delta")) for x in ("accuracy", "macro_f1"))))
    long = whole.select(*by, cells.alias("c")).select(*by, "c.*")
    return long.join(_intervals(values, by, ["accuracy", "macro_f1"]), [*by, "metric"])
