"""What a head's row costs, and how its settings are dealt out."""

import numpy as np
from pyspark.sql import functions as F

from verdictlake.functions import scores as S
from verdictlake.operators import heads
from verdictlake.plans.head_queries import features

LABELS = ("A>B", "B>A", "Tie")


def test_chained_scalings_compute_their_scores_once(spark):
    df = spark.createDataFrame([([1.0, -2.0, 0.5],), ([900.0, -900.0, 899.0],), (None,)], "scores array<double>")
    chained = df.select(S.temperature(S.temperature(S.softmax(F.col("scores")), F.lit(2.0)), F.lit(0.7)).alias("p"))
    assert chained._jdf.queryExecution().optimizedPlan().toString().split("\n")[0].count("scores#") == 1
    rows = chained.collect()
    for r, z in zip(rows, ([1.0, -2.0, 0.5], [900.0, -900.0, 899.0])):
        e = np.maximum(np.exp(np.array(z) - max(z)) / np.exp(np.array(z) - max(z)).sum(), 1e-12) ** 0.5
        e = np.maximum(e / e.sum(), 1e-12) ** (1 / 0.7)
        assert np.allclose(r.p, e / e.sum())
    assert rows[2].p is None


def test_weights_do_not_depend_on_how_settings_are_dealt(spark, small, monkeypatch):
    settings = [heads.Setting(0.08, 16, 1e-3, 3), heads.Setting(0.02, 64, 0.0, 5), heads.Setting(0.04, 16, 0.0, 5)]
    train = features(spark, small).where("split = 'train'")
    y = F.array_position(F.array(*map(F.lit, LABELS)), "gold") - 1
    parts = heads.packed(train, heads.scaler(train).scaled("x"), y, F.lit(-1), "id", 9, 300)
    apart = heads.fit(parts, settings, 9, LABELS, [], every=2)
    monkeypatch.setattr(heads, "PARTS_A_CORE", 0)
    assert np.allclose(heads.fit(parts, settings, 9, LABELS, [], every=2), apart, atol=1e-12)


def test_scores_far_apart():
    scores = np.array([[0.0, 0.0, 0.0], [800.0, -900.0, 3.0], [1.0, 790.0, 1e4]])
    want = np.exp(scores - scores.max(0)) / np.exp(scores - scores.max(0)).sum(0)
    found = scores[1:].copy()
    with np.errstate(over="ignore"):
        heads._softmax(found)
    assert np.allclose(found, want[1:])
