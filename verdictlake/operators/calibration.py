"""Calibration of class probabilities by fits that no task holds whole: Newton sums, pooled ranges, gradient sums.

A fit reads df with probs (array) and gold; rows whose gold is no label are left out. What is
fitted is a few numbers for each class, or the blocks of a step function.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from ..schemas import PAIRWISE
from ..session import map_batches, stored
from . import heads, metrics, policy

LEAST = 1e-12
# Limits of the fits.
NEWTON_ROUNDS, NEWTON_STEP, RIDGE = 50, 1e-6, 1e-6
VECTOR_RATE, VECTOR_STEPS, VECTOR_PATIENCE, VECTOR_GAIN = 0.05, 200, 20, 1e-6


def log_probabilities(probs: str = "probs") -> Column:
    return F.transform(F.col(probs), lambda p: F.ln(F.least(F.greatest(p, F.lit(LEAST)), F.lit(1.0))))


def normalised(values: Column) -> Column:
    """Values of LEAST at least, divided by their sum."""
    safe = F.transform(values, lambda v: F.greatest(v, F.lit(LEAST)))
    return F.transform(safe, lambda v: v / F.aggregate(safe, F.lit(0.0), lambda s, x: s + x))


def _gold(labels: tuple[str, ...]) -> Column:
    return F.array_position(F.array(*(F.lit(x) for x in labels)), F.col("gold")).cast("int") - 1


def _sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def platt(df: DataFrame, labels: tuple[str, ...] = PAIRWISE, rounds: int = NEWTON_ROUNDS) -> DataFrame:
    """k, a, b, rounds: for each class the logistic of its log-probability, by Newton's method from a = 1, b = 0.

    A round is one aggregation to five sums for each class that still moves; the 2 x 2 system is solved where the job was started.
    """
    rows = stored(df.where(F.col("gold").isin(*labels)).select(log_probabilities().alias("s"), _gold(labels).alias("y")), "platt")
    now = {k: (1.0, 0.0, 0, True) for k in range(len(labels))}
    for _ in range(rounds):
        moving = [k for k, v in now.items() if v[3]]
        if not moving:
            break
        sums = []
        for k in moving:
            s = F.get("s", F.lit(k))
            p = _sigmoid(F.lit(now[k][0]) * s + F.lit(now[k][1]))
            d, w = p - (F.col("y") == k).cast("double"), p * (1 - p)
            sums += [F.sum(d * s), F.sum(d), F.sum(w * s * s), F.sum(w * s), F.sum(w)]
        row = [float(v or 0) for v in rows.agg(*sums).first()]
        for i, k in enumerate(moving):
            ga, gb, haa, hab, hbb = row[5 * i : 5 * i + 5]
            haa, hbb, (a, b, n, _) = haa + RIDGE, hbb + RIDGE, now[k]
            det = haa * hbb - hab * hab
            if abs(det) < 1e-12:
                now[k] = (a, b, n, False)
                continue
            da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
            moves = not (abs(da) < NEWTON_STEP and abs(db) < NEWTON_STEP) and math.isfinite(a - da) and math.isfinite(b - db)
            now[k] = (a - da, b - db, n + 1, moves)
    return df.sparkSession.createDataFrame([(k, a, b, n) for k, (a, b, n, _) in now.items()], "k int, a double, b double, rounds int")


def with_platt(df: DataFrame, fitted: DataFrame) -> DataFrame:
    """df with probs scaled class by class and normalised; fitted has a row for each class."""
    ab = {r.k: (r.a, r.b) for r in fitted.collect()}
    s = log_probabilities()
    return df.withColumn("probs", normalised(F.array(*(_sigmoid(F.lit(ab[k][0]) * F.get(s, F.lit(k)) + F.lit(ab[k][1])) for k in sorted(ab)))))


def pool(blocks: Iterator[tuple[int, float, float, int, int]]) -> list[tuple[int, float, float, int, int]]:
    """(class, low, high, hits, n) in order, pooled while the share of hits of a class does not rise; integers are compared."""
    out: list[tuple[int, float, float, int, int]] = []
    for k, low, high, hits, n in blocks:
        while out and out[-1][0] == k and out[-1][3] * n >= hits * out[-1][4]:
            _, low, _, h, m = out.pop()
            hits, n = hits + h, n + m
        out.append((k, low, high, hits, n))
    return out


_BLOCKS = "k int, low double, high double, hits long, n long"


def _pooled(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, kinds)], names=["k", "low", "high", "hits", "n"])


def isotonic(df: DataFrame, labels: tuple[str, ...] = PAIRWISE) -> DataFrame:
    """k, low, high, value, n: the blocks of each class's isotonic regression of its hits on its probability.

    Equal probabilities are merged, ranges of them pooled side by side, then the blocks of the ranges of a
    class. Hits and rows are whole numbers, so n rows leave n ** (2 / 3) blocks at most (sides of a
    convex lattice polygon), and only these meet.
    """
    cells = F.array(*(F.struct(F.lit(k).alias("k"), F.get("probs", F.lit(k)).alias("p"), (_gold(labels) == k).cast("long").alias("hit")) for k in range(len(labels))))
    each = df.where(F.col("gold").isin(*labels)).select(F.explode(cells).alias("c")).select("c.*")
    merged = each.groupBy("k", "p").agg(F.sum("hit").alias("hits"), F.count("*").alias("n"))
    ranges = merged.select("k", F.col("p").alias("low"), F.col("p").alias("high"), "hits", "n").repartitionByRange("k", "low").sortWithinPartitions("k", "low")

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _pooled(pool(row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns))))

    def met(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("k", "low", "high", "hits", "n"))))
        return pa.Table.from_batches([_pooled(pool(iter(rows)))])

    whole = map_batches(ranges, pooled, _BLOCKS).groupBy("k").applyInArrow(met, _BLOCKS)
    return whole.select("k", "low", "high", (F.col("hits") / F.col("n")).alias("value"), "n")


def with_isotonic(df: DataFrame, blocks: DataFrame) -> DataFrame:
    """df with each class's probability read off its blocks (straight lines between them, ends held), then normalised."""
    knots: dict[int, list[tuple[float, float]]] = {}
    for r in blocks.orderBy("k", "low").collect():  # n ** (2 / 3) blocks for n fitted rows at most
        knots.setdefault(r.k, []).extend([(r.low, r.value), (r.high, r.value)])
    lines = {k: tuple(np.array(v).T) for k, v in knots.items()}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("probs")
            column = batch.column(at)
            p = column.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1) if len(batch) else np.zeros((0, 1))
            out = np.column_stack([np.interp(p[:, k], *lines[k]) if k in lines else np.zeros(len(p)) for k in range(p.shape[1])])
            out = np.clip(out, LEAST, None)
            out /= out.sum(1, keepdims=True)
            lists = pa.ListArray.from_arrays(np.arange(0, out.size + 1, out.shape[1], dtype=np.int32), pa.array(out.ravel()))
            yield batch.set_column(at, "probs", lists)

    return map_batches(df, read, ", ".join(f"`{n}` {t}" for n, t in df.dtypes))


def vector_scaling(df: DataFrame, labels: tuple[str, ...] = PAIRWISE, key: str = "id", steps: int = VECTOR_STEPS, part: int = heads.PART) -> tuple[list[float], list[float]]:
    """(scales, shifts) of log-probabilities by gradient descent, stopped early on a tenth of the rows that a hash of key holds out.

    A step reads the packed parts once: each gives its gradient sums and its loss on held out rows, a few numbers, which Spark adds up.
    """
    classes, rows = len(labels), df.where(F.col("gold").isin(*labels))
    held = (F.pmod(F.xxhash64(key, F.lit("held")), F.lit(10)) == 0).cast("int")
    parts = heads.packed(rows, log_probabilities(), _gold(labels), held, key, classes, part)
    w, b, best, since = np.ones(classes), np.zeros(classes), (math.inf, np.ones(classes), np.zeros(classes)), 0
    names = [f"v{k}" for k in range(2 * classes + 3)]
    for step in range(steps + 1):
        now = (w, b)

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for n, x, y, s in zip(*(batch.column(k).to_pylist() for k in range(4))):
                    x, y, out = np.frombuffer(x).reshape(n, classes), np.frombuffer(y, np.int32), np.frombuffer(s, np.int32) == 1
                    z = x * now[0] + now[1]
                    z = np.exp(z - z.max(1, keepdims=True))
                    p = z / z.sum(1, keepdims=True)
                    d = (p - np.eye(classes)[y])[~out]
                    loss = -np.log(p[np.arange(n), y] + LEAST)[out].sum()
                    values = [*(d * x[~out]).sum(0), *d.sum(0), float((~out).sum()), loss, float(out.sum())]
                    yield pa.RecordBatch.from_arrays([pa.array([float(v)]) for v in values], names=names)

        each = map_batches(parts.select("rows", "x", "y", "s"), sums, ", ".join(f"{v} double" for v in names))
        row = np.array([float(v or 0) for v in each.agg(*(F.sum(v) for v in names)).first()])
        n, loss, out = row[2 * classes :]
        if step and out:
            if loss / out < best[0] - VECTOR_GAIN:
                best, since = (loss / out, w.copy(), b.copy()), 0
            else:
                since += 1
                if since >= VECTOR_PATIENCE:
                    break
        w, b = w - VECTOR_RATE * row[:classes] / max(n, 1), b - VECTOR_RATE * row[classes : 2 * classes] / max(n, 1)
    return (best[1].tolist(), best[2].tolist()) if math.isfinite(best[0]) else (w.tolist(), b.tolist())


def with_vector(df: DataFrame, scales: list[float], shifts: list[float]) -> DataFrame:
    s = log_probabilities()
    return df.withColumn("probs", S.softmax(F.array(*(F.lit(w) * F.get(s, F.lit(k)) + F.lit(b) for k, (w, b) in enumerate(zip(scales, shifts))))))


METHODS = ("none", "temperature", "platt", "isotonic", "vector_scaling")


def calibrated(df: DataFrame, method: str, labels: tuple[str, ...] = PAIRWISE, key: str = "id") -> DataFrame:
    """df (all splits) with probs calibrated by a method that was fitted on its dev rows."""
    dev = df.where("split = 'dev'")
    if method == "none":
        return df
    if method == "temperature":
        t = policy.best_temperature(policy.temperature_search(dev, labels=labels)).first().temperature
        return df.withColumn("probs", S.temperature(F.col("probs"), F.lit(t or 1.0)))
    if method == "platt":
        return with_platt(df, platt(dev, labels))
    if method == "isotonic":
        return with_isotonic(df, isotonic(dev, labels))
    if method == "vector_scaling":
        return with_vector(df, *vector_scaling(dev, labels, key))
    raise ValueError(f"no calibration method {method}; there are {', '.join(METHODS)}")


def comparison(df: DataFrame, methods: tuple[str, ...] = METHODS, labels: tuple[str, ...] = PAIRWISE, key: str = "id") -> DataFrame:
    """method, split, n, accuracy, ece, mce, brier and nll on the dev and test rows of df (key, split, gold, probs)."""
    rows = df.where(F.col("split").isin("dev", "test") & F.col("gold").isin(*labels)).select(key, "split", "gold", "probs")
    every = reduce(DataFrame.unionByName, (calibrated(rows, m, labels, key).select(F.lit(m).alias("method"), "split", "gold", "probs") for m in methods))
    every = metrics.with_derived(every, labels)
    bins = every.groupBy("method", "split", "bin").agg(F.avg(F.col("correct").cast("double")).alias("a"), F.avg("confidence").alias("c"))
    mce = bins.groupBy("method", "split").agg(F.max(F.abs(F.col("a") - F.col("c"))).alias("mce"))
    return metrics.metric_bundle(every, ["method", "split"], labels).join(mce, ["method", "split"]).select("method", "split", "n", "accuracy", "ece", "mce", "brier", "nll")
