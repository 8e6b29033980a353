"""Heads and calibration against plain numpy loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdictlake.operators import calibration, heads, metrics
from verdictlake.plans.head_queries import features
from verdictlake.plans.views import predictions

LABELS = ("A>B", "B>A", "Tie")


@pytest.fixture(scope="module")
def frame(spark, small):
    return features(spark, small)


def matrices(df, scaler):
    rows = df.select(F.xxhash64("id").alias("h"), scaler.scaled("x").alias("x"), (F.array_position(F.array(*map(F.lit, LABELS)), "gold") - 1).alias("y"), "dataset").collect()
    x, y, h = np.array([r.x for r in rows]), np.array([int(r.y) for r in rows]), np.array([r.h for r in rows])
    order = np.lexsort((*x.T, y, h))
    return x[order], y[order], h[order], np.array([r.dataset for r in rows])[order]


def plain(x, y, w, s, part, epochs, weights, bias):
    """One setting at a time, as a textbook writes mini-batch descent."""
    x = x.copy()
    for epoch in epochs:
        if epoch >= s.epochs:
            break
        order = np.random.default_rng((heads.SEED, part, epoch)).permutation(len(x))
        for at in range(0, len(x), s.batch):
            k = order[at : at + s.batch]
            z = x[k] @ weights + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = (p - np.eye(3)[y[k]]) * w[k, None] / w[k].sum()
            weights = weights - s.learning_rate * (x[k].T @ g + s.l2 * weights)
            bias = bias - s.learning_rate * g.sum(0)
    return weights, bias


@pytest.mark.parametrize("part", [50_000, 300])
def test_weights_equal_a_plain_loop(spark, frame, part):
    settings = [heads.Setting(0.08, 16, 1e-3, 4), heads.Setting(0.02, 64, 0.0, 7, (("Tie", 2.0),), (("5-LOW", 3.0), ("1-URGENT", 0.5))), heads.Setting(0.04, 16, 0.0, 7)]
    train = frame.where("split = 'train'")
    scaler = heads.scaler(train)
    raw = np.array([r.x for r in train.select("x").collect()])
    assert np.allclose(scaler.mean, raw.mean(0)) and np.allclose(scaler.deviation, raw.std(0))
    y = F.array_position(F.array(*map(F.lit, LABELS)), "gold") - 1
    sources = ["1-URGENT", "5-LOW"]
    parts = heads.packed(train, scaler.scaled("x"), y, F.coalesce(F.array_position(F.array(*map(F.lit, sources)), F.col("dataset")) - 1, F.lit(-1)), "id", raw.shape[1], part)
    theta = heads.fit(parts, settings, raw.shape[1], LABELS, sources, every=3)
    x, gold, h, dataset = matrices(train, scaler)
    number = max(1, -(-len(x) // part))
    assert number == (1 if part > 1000 else parts.count())
    for k, s in enumerate(settings):
        weights, bias = heads.start(1, x.shape[1], 3)[:-1, 0], np.zeros(3)
        w = np.array([dict(s.by_label).get(LABELS[g], 1.0) * dict(s.by_source).get(d, 1.0) for g, d in zip(gold, dataset)])
        for begin in range(0, 7, 3):
            each = [(own.sum(), plain(x[own], gold[own], w[own], s, p, range(begin, min(7, begin + 3)), weights, bias)) for p in range(number) for own in [h % number == p]]
            weights, bias = (sum(n * v[i] for n, v in each) / len(x) for i in (0, 1))
        assert np.allclose(theta[:-1, k], weights, atol=1e-9) and np.allclose(theta[-1, k], bias, atol=1e-9)


def test_the_chosen_setting_is_the_best(spark, frame):
    settings = [heads.Setting(lr, 32, 0.0, 6) for lr in (0.001, 0.08, 0.02)]
    head, trials = heads.train(frame, settings=settings)
    rows = {r.setting: r for r in trials.collect()}
    best = max(rows.values(), key=lambda r: (r.objective, -r.setting))
    assert best.chosen and sum(r.chosen for r in rows.values()) == 1 and head.setting == settings[best.setting]
    dev = metrics.with_derived(head.raw(frame.where("split = 'dev'")))
    m = metrics.metric_bundle(dev, []).first()
    assert (round(m.accuracy, 4), round(m.macro_f1, 4), round(m.ece, 4)) == pytest.approx((best.accuracy, best.macro_f1, best.ece), abs=1e-4)
    done = head.apply(frame)
    assert done.count() == frame.count()
    r = done.agg(F.avg((F.col("predicted") == F.col("gold")).cast("double")).alias("a"), F.avg(F.col("correct").cast("double")).alias("c"), F.min("final_score").alias("low"), F.max("confidence").alias("high")).first()
    assert r.a == r.c > 0.5 and r.low == 0.0 and r.high <= 1.0
    sums = done.select(F.aggregate("probs", F.lit(0.0), lambda s, v: s + v).alias("s")).agg(F.min("s"), F.max("s")).first()
    assert sums[0] == pytest.approx(1) and sums[1] == pytest.approx(1)


def test_grids():
    assert len(set(heads.grid())) == 96 and len(heads.weight_grid()) == 12
    assert len(heads.with_weights(heads.grid(), heads.weight_grid())) == 96 * 12


def test_rows_without_a_label_and_no_rows(spark, frame):
    odd = frame.withColumn("gold", F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("gold")))
    head, trials = heads.train(odd, settings=[heads.Setting(0.05, 64, 0.0, 2)])
    assert trials.first().n == odd.where("split = 'dev' and gold is not null").count()
    none, trials = heads.train(frame.where("false"), settings=[heads.Setting(0.05, 64, 0.0, 2)])
    assert trials.first().n is None and none.temperature == 1.0 and none.review_threshold == 1.1


def sequential(x, y):
    """Pool adjacent violators, one value after the other."""
    out = []
    for v in sorted(set(x)):
        own = [b for a, b in zip(x, y) if a == v]
        out.append([v, v, sum(own), len(own)])
        while len(out) > 1 and out[-2][2] * out[-1][3] >= out[-1][2] * out[-2][3]:
            _, high, h, n = out.pop()
            out[-1] = [out[-1][0], high, out[-1][2] + h, out[-1][3] + n]
    return [(a, b, h / n, n) for a, b, h, n in out]


@pytest.mark.parametrize("kind", ["random", "falling", "rising", "blocks"])
def test_isotonic_equals_the_sequential_algorithm(spark, kind):
    rng = np.random.default_rng(len(kind))
    n = 900
    p = rng.permutation(n) / n if kind != "blocks" else rng.integers(0, 40, n) / 40
    hit = {"random": rng.random(n) < p, "falling": p < 0.5, "rising": p >= 0.5, "blocks": (p * 10 % 2 < 1)}[kind]
    df = spark.createDataFrame([(i, [float(a), float(1 - a) / 2, float(1 - a) / 2], "A>B" if h else "Tie") for i, (a, h) in enumerate(zip(p, hit))], "id long, probs array<double>, gold string").repartition(7)
    got = calibration.isotonic(df).where("k = 0").orderBy("low").collect()
    assert [(r.low, r.high, pytest.approx(r.value), r.n) for r in got] == sequential(p.tolist(), hit.tolist())
    read = {r.id: r.probs for r in calibration.with_isotonic(df, calibration.isotonic(df)).collect()}
    lines = [sequential(v, [g == x for g in np.where(hit, "A>B", "Tie")]) for v, x in zip((p.tolist(), ((1 - p) / 2).tolist(), ((1 - p) / 2).tolist()), LABELS)]
    want = np.array([np.interp(v, [z for r in line for z in r[:2]], [r[2] for r in line for _ in (0, 1)]) for v, line in zip((p, (1 - p) / 2, (1 - p) / 2), lines)]).T
    want = np.clip(want, 1e-12, None)
    assert np.allclose([read[i] for i in range(n)], want / want.sum(1, keepdims=True))


def test_vector_scaling_equals_a_plain_loop(spark, small):
    dev = predictions(spark, small).where("split = 'dev'")
    rows = dev.select("probs", "gold", (F.pmod(F.xxhash64("id", F.lit("held")), F.lit(10)) == 0).alias("held")).collect()
    x, y, held = np.log([r.probs for r in rows]), np.array([LABELS.index(r.gold) for r in rows]), np.array([r.held for r in rows])
    w, b, best = np.ones(3), np.zeros(3), (np.inf, None, None)
    soft = lambda z: np.exp(z - z.max(1, keepdims=True)) / np.exp(z - z.max(1, keepdims=True)).sum(1, keepdims=True)
    for _ in range(12):
        d = soft(x[~held] * w + b) - np.eye(3)[y[~held]]
        w, b = w - 0.05 * (d * x[~held]).mean(0), b - 0.05 * d.mean(0)
        loss = -np.log(soft(x[held] * w + b)[np.arange(held.sum()), y[held]] + 1e-12).mean()
        if loss < best[0] - 1e-6:
            best = (loss, w, b)
    for part in (50_000, 40):
        scales, shifts = calibration.vector_scaling(dev, steps=12, part=part)
        assert np.allclose(scales, best[1]) and np.allclose(shifts, best[2])


def test_comparison(spark, small):
    p = predictions(spark, small)
    rows = {(r.method, r.split): r for r in calibration.comparison(p, ("none", "temperature", "platt", "isotonic")).collect()}
    assert len(rows) == 8
    whole = {r.split: r for r in metrics.metric_bundle(p, ["split"]).collect()}
    for split in ("dev", "test"):
        assert rows["none", split].ece == pytest.approx(whole[split].ece) and rows["none", split].nll == pytest.approx(whole[split].nll)
        assert all(r.mce >= r.ece - 1e-12 for (_, s), r in rows.items() if s == split)
    assert rows["isotonic", "dev"].brier < rows["none", "dev"].brier and rows["platt", "dev"].ece < rows["none", "dev"].ece
    with pytest.raises(ValueError):
        calibration.calibrated(p, "magic")
