"""Judge heads: softmax classifiers trained for a whole grid of settings at once, over rows that no task holds together.

Rows are packed once into parts of about PART rows, dealt by a hash. In a round every part goes
through EPOCHS epochs of mini-batches for all settings of the grid together (the settings of a batch size are the
rows of one matrix product, and a task of their own while parts are few), from the same weights; the parts' weights are averaged by rows, in a tree,
and start the next round. A split of up to PART rows is thus plain mini-batch descent. What
travels is the weights: settings x classes x features, whatever the number of rows. Scoring reduces rows to
(setting, bin, gold, predicted) counts in one pass for the whole grid.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from ..schemas import PAIRWISE
from ..session import map_batches, ship_package, stored
from . import metrics, policy
from .fit import apply_softmax

#: Rows of a part, epochs between two averages, sums of averages that reach the driver, and the seed of weights and orders.
PART, EPOCHS, FAN, SEED = 50_000, 20, 32, 20260518

#: Below so many parts for each core, the settings of each batch size are work of their own.
PARTS_A_CORE = 4

# The settings of the grids, and the gates of a dataset's own temperature.
LEARNING_RATES, BATCHES, L2S, EPOCH_COUNTS = (0.08, 0.04, 0.02, 0.01), (16, 32, 64), (0.0, 1e-4, 1e-3, 5e-3), (80, 140)
UNSUPPORTED_WEIGHTS, RAGTRUTH_WEIGHTS = (1.5, 2.0, 2.25, 2.5), (1.25, 1.5, 1.75)
TEMPERATURE_ROWS = 5


@dataclass(frozen=True)
class Setting:
    learning_rate: float
    batch: int
    l2: float
    epochs: int
    by_label: tuple[tuple[str, float], ...] = ()
    by_source: tuple[tuple[str, float], ...] = ()


def grid() -> list[Setting]:
    return [Setting(*s) for s in product(LEARNING_RATES, BATCHES, L2S, EPOCH_COUNTS)]


def weight_grid(label: str = "unsupported", source: str = "ragtruth") -> list[tuple]:
    """(by_label, by_source) of the factuality head: a factor for one label and one for one source."""
    return [(((label, a),), ((source, b),)) for a in UNSUPPORTED_WEIGHTS for b in RAGTRUTH_WEIGHTS]


def with_weights(settings: list[Setting], weights: list[tuple]) -> list[Setting]:
    return [replace(s, by_label=a, by_source=b) for s in settings for a, b in weights]


@dataclass(frozen=True)
class Scaler:
    mean: list[float]
    deviation: list[float]

    def scaled(self, x: str) -> Column:
        """Values less their mean over their deviation; missing ones count as 0 before that."""
        if not self.mean:
            return F.array().cast("array<double>")
        numbers = F.array(*(F.struct(F.lit(m).alias("m"), F.lit(s).alias("s")) for m, s in zip(self.mean, self.deviation)))
        return F.zip_with(F.col(x), numbers, lambda v, n: (F.coalesce(v.cast("double"), F.lit(0.0)) - n["m"]) / n["s"])


def scaler(train: DataFrame, x: str = "x") -> Scaler:
    """Means and population deviations (nearly 0 counts as 1) of an array column, in one aggregation to one row."""
    width = train.select(F.max(F.size(x))).first()[0] or 0
    value = [F.coalesce(F.get(x, F.lit(k)).cast("double"), F.lit(0.0)) for k in range(width)]
    row = train.agg(F.count("*"), *(F.avg(v) for v in value), *(F.stddev_pop(v) for v in value)).first()
    mean, deviation = row[1 : width + 1], row[width + 1 :]
    return Scaler([float(m or 0) for m in mean], [float(s) if s and s >= 1e-8 else 1.0 for s in deviation])


def _arrays(table, width: int) -> np.ndarray:
    flat = table.combine_chunks() if isinstance(table, pa.ChunkedArray) else table
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(flat), width)


def packed(df: DataFrame, x: Column, y: Column, source: Column, key: str, width: int, part: int = PART) -> DataFrame:
    """(part, rows, x, y, s): the rows as matrices, in order of a hash of key, which tells rows apart."""
    ship_package(df.sparkSession)
    rows = df.select(F.xxhash64(key).alias("h"), x.alias("x"), y.cast("int").alias("y"), source.cast("int").alias("s"))
    parts = max(1, -(-rows.count() // part))

    def pack(table: pa.Table) -> pa.Table:
        matrix, h, y, s = _arrays(table.column("x"), width), *(table.column(c).to_numpy() for c in ("h", "y", "s"))
        order = np.lexsort((*matrix.T, y, h))
        out = {"part": [table.column("part")[0].as_py()], "rows": [len(h)], "x": [matrix[order].tobytes()], "y": [y[order].astype(np.int32).tobytes()], "s": [s[order].astype(np.int32).tobytes()]}
        return pa.table({k: pa.array(v, {"part": pa.int64(), "rows": pa.int64()}.get(k, pa.binary())) for k, v in out.items()})

    dealt = rows.withColumn("part", F.pmod("h", F.lit(parts)))
    return stored(dealt.groupBy("part").applyInArrow(pack, "part long, rows long, x binary, y binary, s binary"), "packed")


def start(settings: int, width: int, classes: int, seed: int = SEED) -> np.ndarray:
    """Weights (features and a bias, settings, classes): the same small random ones for every setting, no bias."""
    first = np.random.default_rng(seed).normal(0.0, 0.01, (width, classes))
    return np.repeat(np.append(first, np.zeros((1, classes)), 0)[:, None, :], settings, 1)


def _softmax(z: np.ndarray) -> None:
    """Turns scores of all classes but the first, less the first one's, into probabilities, in place; the first axis is the class."""
    p = np.exp(z)
    total = np.add.reduce(p, 0)
    total += 1
    if np.maximum.reduce(total, None) < np.inf:
        np.reciprocal(total, out=total)
        np.multiply(p, total, out=z)
    else:  # far apart: less the largest score
        top = np.maximum(z.max(0), 0)
        np.exp(z - top, out=z)
        z /= z.sum(0) + np.exp(-top)


@np.errstate(over="ignore")
def descend(theta: np.ndarray, x: np.ndarray, y: np.ndarray, weights: np.ndarray, settings: list[Setting], epochs: range, seed: tuple[int, ...]) -> np.ndarray:
    """theta after the epochs over one part, for all settings that have them; weights has a column for each setting.

    Gradients of a row add up to 0 over the classes, so the weights' sum over the classes only decays, and what is stepped
    are the classes' differences from the first one. They lie by class, setting and feature: every step is a few passes over whole
    arrays. Where all rows weigh 1, the labels' side of the gradient is the same for all settings and is summed for all batches at once.
    """
    theta, n, classes = theta.copy(), len(x), theta.shape[2]
    x, hot, even = np.append(x, np.ones((n, 1)), 1), np.eye(classes)[y][:, 1:], bool((weights == 1).all())
    width = x.shape[1]
    for epoch in epochs:
        order = np.random.default_rng((*seed, epoch)).permutation(n)
        xs, hots, ws = x[order], hot[order], None if even else weights[order]
        for batch in sorted({s.batch for s in settings}):
            own = [k for k, s in enumerate(settings) if s.batch == batch and s.epochs > epoch]
            if not own or not n:
                continue
            rate = np.array([settings[k].learning_rate for k in own])[:, None]
            keep = 1 - rate * np.array([settings[k].l2 for k in own])[:, None] * np.append(np.ones(width - 1), 0)
            flat = np.ascontiguousarray(theta[:, own, :].transpose(2, 1, 0))  # classes, settings, features
            total, flat = flat.sum(0), flat[1:] - flat[0]
            rows, starts = flat.reshape(-1, width), range(0, n, batch)
            if even:
                said = np.stack([np.add.reduceat(xs * hots[:, c : c + 1], starts) for c in range(classes - 1)], 1)[:, :, None, :]
            full = rate / batch
            for k, at in enumerate(starts):
                xb = xs[at : at + batch]
                z = rows @ xb.T
                each = z.reshape(classes - 1, len(own), len(xb))
                _softmax(each)
                if even:
                    g = (z @ xb).reshape(flat.shape)
                    g -= said[k]
                    step = full if len(xb) == batch else rate / len(xb)
                else:
                    wb = ws[at : at + batch, own].T
                    each -= hots[at : at + batch].T[:, None, :]
                    each *= wb / np.maximum(wb.sum(1, keepdims=True), 1e-12)
                    g = (z @ xb).reshape(flat.shape)
                    step = rate
                g += np.add.reduce(g, 0)
                g *= step
                flat *= keep
                flat -= g
            first = (total * keep ** len(starts) - flat.sum(0)) / classes
            theta[:, own, :] = np.concatenate([first[None], flat + first]).transpose(2, 1, 0)
    return theta


def _factors(settings: list[Setting], labels: tuple[str, ...], sources: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Factors of labels and of sources for each setting; the last row of sources is for all others."""
    by_label = np.array([[dict(s.by_label).get(x, 1.0) for s in settings] for x in labels])
    by_source = np.array([[dict(s.by_source).get(x, 1.0) for s in settings] for x in sources] + [[1.0] * len(settings)])
    return np.maximum(by_label, 0), np.maximum(by_source, 0)


def fit(parts: DataFrame, settings: list[Setting], width: int, labels: tuple[str, ...], sources: list[str], every: int = EPOCHS, seed: int = SEED) -> np.ndarray:
    """Weights (features and a bias, settings, classes) after all epochs of each setting over packed rows."""
    theta = start(len(settings), width, len(labels), seed)
    by_label, by_source = _factors(settings, labels, sources)
    last = max((s.epochs for s in settings), default=0)
    works, number = [[k for k, s in enumerate(settings) if s.batch == batch] for batch in sorted({s.batch for s in settings})], parts.count()
    if number >= PARTS_A_CORE * parts.sparkSession.sparkContext.defaultParallelism:
        works = [list(range(len(settings)))]
    parts = parts.withColumn("work", F.explode(F.array(*(F.lit(k) for k in range(len(works))))))
    if len(works) > 1:  # a file for each
        parts = stored(parts.repartition(max(1, number * len(works))), "packed")

    def total(table: pa.Table) -> pa.Table:
        sums = sum(np.frombuffer(b, float) for b in table.column("theta").to_pylist())
        return pa.table({"work": pa.array([table.column("work")[0].as_py()], pa.int32()), "rows": [sum(table.column("rows").to_pylist())], "theta": pa.array([sums.tobytes()], pa.binary())})

    for begin in range(0, last, every):
        now, epochs = theta.copy(), range(begin, min(last, begin + every))

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, n, x, y, s, work in zip(*(batch.column(k).to_pylist() for k in range(6))):
                    y, s, own = np.frombuffer(y, np.int32), np.frombuffer(s, np.int32), works[work]
                    weights = by_label[:, own][y] * by_source[:, own][s]
                    weights[:, weights.sum(0) <= 0] = 1.0
                    out = descend(now[:, own], np.frombuffer(x).reshape(n, width), y, weights, [settings[k] for k in own], epochs, (seed, part))
                    yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([n]), pa.array([(out * n).tobytes()], pa.binary()), pa.array([work], pa.int32())], names=["part", "rows", "theta", "work"])

        each = map_batches(parts.select("part", "rows", "x", "y", "s", "work"), step, "part long, rows long, theta binary, work int")
        sums = each.groupBy("work", F.pmod("part", F.lit(FAN))).applyInArrow(total, "work int, rows long, theta binary").collect()  # FAN rows at most for each of works
        if not sums:
            return theta
        for k, own in enumerate(works):
            found = [r for r in sums if r.work == k]
            theta[:, own] = (sum(np.frombuffer(r.theta, float) for r in found) / sum(r.rows for r in found)).reshape(theta[:, own].shape)
    return theta


def trial_metrics(df: DataFrame, theta: np.ndarray, x: Column, y: Column, labels: tuple[str, ...]) -> DataFrame:
    """setting, n, accuracy, macro_f1 (labels absent from both sides skipped), ece (all at four places) and objective of every setting over df."""
    width, settings, classes = theta.shape[0] - 1, theta.shape[1], len(labels)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = (settings, 10, classes, classes)
        n, conf = np.zeros(shape, np.int64).ravel(), np.zeros(shape).ravel()
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                values, gold = np.append(_arrays(part.column(0), width), np.ones((part.num_rows, 1)), 1), part.column(1).to_numpy(zero_copy_only=False)
                z = (values @ theta.reshape(width + 1, -1)).reshape(-1, settings, classes)
                z = np.exp(z - z.max(2, keepdims=True))
                p = z / z.sum(2, keepdims=True)
                top, said = p.max(2), p.argmax(2)
                place = np.ravel_multi_index((np.arange(settings)[None, :], np.minimum(9, (top * 10).astype(int)), gold[:, None], said), shape)
                n += np.bincount(place.ravel(), minlength=len(n))
                conf += np.bincount(place.ravel(), top.ravel(), len(n))
        full = np.flatnonzero(n)
        names = ["setting", "bin", "gold", "said"]
        yield pa.RecordBatch.from_arrays([*(pa.array(a.astype(np.int32)) for a in np.unravel_index(full, shape)), pa.array(n[full]), pa.array(conf[full])], names=[*names, "n", "conf"])

    found = map_batches(df.select(x.alias("x"), y.cast("int").alias("y")), cells, "setting int, bin int, gold int, said int, n long, conf double")
    hit = F.when(F.col("gold") == F.col("said"), F.col("n")).otherwise(0)
    one = lambda c, v=None: F.sum(F.when(c, F.col("n") if v is None else v).otherwise(0))
    sums = [one(F.col("gold") == k, hit).alias(f"both{k}") for k in range(classes)] + [one(F.col("gold") == k).alias(f"gold{k}") for k in range(classes)] + [one(F.col("said") == k).alias(f"said{k}") for k in range(classes)]
    binned = found.groupBy("setting", "bin").agg(F.sum("n").alias("n"), F.sum(hit).alias("hits"), F.sum("conf").alias("conf"), *sums)
    n = F.sum("n")
    whole = binned.groupBy("setting").agg(n.alias("n"), (F.sum("hits") / n).alias("accuracy"), (F.sum(F.abs(F.col("hits") - F.col("conf"))) / n).alias("ece"), *(F.sum(f"{a}{k}").alias(f"{a}{k}") for a in ("both", "gold", "said") for k in range(classes)))
    f1 = [F.try_divide(2.0 * F.col(f"both{k}"), F.col(f"gold{k}") + F.col(f"said{k}")) for k in range(classes)]
    macro = F.aggregate(F.array_compact(F.array(*f1)), F.lit(0.0), lambda a, b: a + b) / F.size(F.array_compact(F.array(*f1)))
    out = whole.select("setting", "n", F.round("accuracy", 4).alias("accuracy"), F.round(macro, 4).alias("macro_f1"), F.round("ece", 4).alias("ece"))
    return out.withColumn("objective", F.col("macro_f1") + 0.25 * F.col("accuracy") - 0.05 * F.col("ece"))


@dataclass(frozen=True)
class Head:
    """A trained head: what apply() needs to turn features into calibrated, decided rows."""

    labels: tuple[str, ...]
    scaler: Scaler
    weights: list[float]
    setting: Setting
    temperature: float = 1.0
    by_dataset: dict[str, float] = field(default_factory=dict)
    min_tie: float | None = None
    max_margin: float | None = None
    max_base_margin: float | None = None
    review_threshold: float = 1.1

    def raw(self, df: DataFrame, x: str = "x") -> DataFrame:
        """df with probs, before calibration."""
        return df.withColumn("_x", self.scaler.scaled(x)).withColumn("probs", apply_softmax("_x", self.weights, len(self.labels))).drop("_x")

    def calibrated(self, df: DataFrame, x: str = "x") -> DataFrame:
        """df with probs after the temperature of all rows and that of the row's dataset."""
        out = self.raw(df, x).withColumn("probs", S.temperature(F.col("probs"), F.lit(self.temperature)))
        if not self.by_dataset:
            return out
        own = F.lit(None).cast("double")
        for name, value in self.by_dataset.items():
            own = F.when(F.col("dataset") == name, F.lit(value)).otherwise(own)
        return out.withColumn("probs", F.when(own.isNull(), F.col("probs")).otherwise(S.temperature(F.col("probs"), own)))

    def apply(self, df: DataFrame, x: str = "x") -> DataFrame:
        """df with probs, predicted, confidence, risk_score, correct, bin, review_flag and final_score (1, 0.5 and 0 for the labels' first, last and second)."""
        out = metrics.with_derived(self.calibrated(df, x), self.labels)
        if self.min_tie is not None:
            p = [F.get("probs", F.lit(k)) for k in range(3)]
            tied = (p[2] >= self.min_tie) & (F.abs(p[0] - p[1]) <= self.max_margin)
            if self.max_base_margin is not None:
                tied &= F.col("base_margin") <= self.max_base_margin
            tied = F.coalesce(tied, F.lit(False))
            out = out.withColumn("_t", tied).withColumn("predicted", F.when(F.col("_t"), self.labels[2]).otherwise(F.col("predicted"))).withColumn("confidence", F.when(F.col("_t"), p[2]).otherwise(F.col("confidence"))).drop("_t")
            out = out.withColumn("risk_score", 1 - F.col("confidence")).withColumn("correct", F.col("gold") == F.col("predicted")).withColumn("bin", S.bin_of(F.col("confidence")))
        score = F.when(F.col("predicted") == self.labels[0], 1.0).when(F.col("predicted") == self.labels[1], 0.0).otherwise(0.5)
        return out.withColumn("review_flag", F.col("risk_score") >= self.review_threshold).withColumn("final_score", score)


def _dataset_temperatures(dev: DataFrame, labels: tuple[str, ...]) -> dict[str, float]:
    """A temperature for each dataset, 1 below TEMPERATURE_ROWS rows; none at all unless the error of calibration falls."""
    sizes = dev.groupBy("dataset").agg(F.count("*").alias("n"))
    search = policy.temperature_search(dev, ["dataset"], labels=labels).withColumn("objective", F.round("objective", 6))
    found = policy.best_temperature(search, ["dataset"]).join(sizes, "dataset").collect()  # a row for each dataset
    own = {r.dataset: r.temperature if r.n >= TEMPERATURE_ROWS else 1.0 for r in found}
    if not own:
        return own
    value = F.lit(1.0)
    for name, t in own.items():
        value = F.when(F.col("dataset") == name, F.lit(t)).otherwise(value)
    ece = lambda df: metrics.metric_bundle(metrics.with_derived(df, labels), [], labels).first().ece
    after = dev.select("gold", S.temperature(F.col("probs"), value).alias("probs"))
    return own if round(ece(after), 4) < round(ece(dev), 4) else {}


def train(df: DataFrame, labels: tuple[str, ...] = PAIRWISE, settings: list[Setting] | None = None, key: str = "id", x: str = "x", part: int = PART, every: int = EPOCHS, seed: int = SEED, ties: bool = True) -> tuple[Head, DataFrame]:
    """The head with the best objective on the dev rows, calibrated, and a table of all settings.

    df has key, x (array), gold, dataset, split ('train', 'dev' and others) and, for policies, base_margin. Rows
    whose gold is no label are left out, as are rows of other splits. Of equal objectives the first
    setting is taken. With no train rows the weights stay at their start.
    """
    settings = settings or grid()
    known = df.where(F.col("gold").isin(*labels))
    train_rows, dev = known.where("split = 'train'"), known.where("split = 'dev'")
    sizes = scaler(train_rows, x)
    width = len(sizes.mean)
    sources = sorted({name for s in settings for name, _ in s.by_source})
    place = lambda column, values: F.coalesce(F.array_position(F.array(*(F.lit(v) for v in values)), F.col(column)).cast("int") - 1, F.lit(-1)) if values else F.lit(-1)
    parts = packed(train_rows, sizes.scaled(x), place("gold", labels), place("dataset", sources), key, width, part)
    theta = fit(parts, settings, width, labels, sources, every, seed)
    frame = df.sparkSession.createDataFrame([(k, s.learning_rate, s.batch, s.l2, s.epochs, str(dict(s.by_label)), str(dict(s.by_source))) for k, s in enumerate(settings)], "setting int, learning_rate double, batch int, l2 double, epochs int, by_label string, by_source string")
    trials = stored(frame.join(trial_metrics(dev, theta, sizes.scaled(x), place("gold", labels), labels), "setting", "left"), "trials")
    best = trials.orderBy(F.desc_nulls_last("objective"), "setting").first().setting
    # A row of weights for each class: its features, then its bias.
    head = Head(labels, sizes, theta[:, best, :].T.ravel().tolist(), settings[best])
    scored = stored(head.raw(dev, x), "dev")
    found = policy.best_temperature(policy.temperature_search(scored, labels=labels)).first()
    head = replace(head, temperature=found.temperature or 1.0)
    if ties:
        head = replace(head, by_dataset=_dataset_temperatures(head.calibrated(dev, x), labels))
        decided = stored(metrics.with_derived(head.calibrated(dev, x), labels), "dev")
        tie = policy.best_tie_policy(policy.tie_policy_search(decided)).first()
        if tie:
            head = replace(head, min_tie=tie.min_tie, max_margin=tie.max_margin, max_base_margin=tie.max_base_margin)
    review = policy.review_threshold(stored(head.apply(dev, x).select("risk_score", "correct"), "dev")).first()
    if review and review.threshold is not None:
        head = replace(head, review_threshold=review.threshold)
    return head, trials.withColumn("chosen", F.col("setting") == best)
