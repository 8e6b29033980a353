"""Overlays and policies over seeds against plain loops over all rows."""

import random

import pytest
from pyspark.sql import functions as F

from verdictlake.operators import metrics, overlays, policy

LABELS = ["A>B", "B>A", "Tie"]


def rows(n, seed, datasets=("a", "b", "c")):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        w = [rng.random() + 0.05 for _ in range(3)]
        out.append((i, datasets[0] if i % 5 < 2 else datasets[1] if i % 5 < 4 else datasets[2], LABELS[min(2, int(rng.random() * 4))], [x / sum(w) for x in w], rng.randint(0, 24) / 20))
    return out


def frame(spark, data):
    return metrics.with_derived(spark.createDataFrame(data, "id long, dataset string, gold string, probs array<double>, base_margin double"))


def plain(data, said):
    """accuracy, macro f1, ece and tie recall of (row, label, confidence)."""
    n, hits = len(data), sum(r[2] == s for r, (s, _) in zip(data, said))
    f1 = []
    for x in LABELS:
        both, gold, out = sum(r[2] == x == s for r, (s, _) in zip(data, said)), sum(r[2] == x for r in data), sum(s == x for s, _ in said)
        if gold + out:
            f1.append(2 * both / (gold + out))
    bins = {}
    for r, (s, c) in zip(data, said):
        b = bins.setdefault(min(9, int(c * 10)), [0, 0.0])
        b[0] += r[2] == s
        b[1] += c
    ties = sum(r[2] == "Tie" for r in data)
    return hits / n, sum(f1) / len(f1), sum(abs(h - c) for h, c in bins.values()) / n, sum(r[2] == s == "Tie" for r, (s, _) in zip(data, said)) / ties


def base(r):
    k = max(range(3), key=lambda i: (r[3][i], -i))
    return LABELS[k], r[3][k]


def test_overlay_equals_all_rows(spark):
    data = rows(150, 4) + [(900, None, "Tie", [0.3, 0.3, 0.4], 0.1)]
    df = policy.apply_tie_policy(frame(spark, data), 0.40, 0.10).withColumn("bin", F.col("bin"))
    found = overlays.overlay_tie_search(df).collect()
    sizes = {d: (sum(r[1] == d for r in data), sum(r[1] == d and r[2] == "Tie" for r in data)) for d in "abc"}
    able = {d for d, (n, t) in sizes.items() if n >= 40 and t >= 8}
    assert able and able != set("abc") and {r.dataset for r in found} == able and len(found) == 280 * len(able)
    first = [("Tie", r[3][2]) if r[3][2] >= 0.40 and abs(r[3][0] - r[3][1]) <= 0.10 else base(r) for r in data]
    for r in random.Random(1).sample(found, 25):
        over = lambda x, r=r: x[1] == r.dataset and x[3][2] >= r.min_tie and abs(x[3][0] - x[3][1]) <= r.max_margin and (r.max_base_margin is None or x[4] <= r.max_base_margin)
        want = plain(data, [("Tie", x[3][2]) if over(x) else s for x, s in zip(data, first)])
        assert (r.accuracy, r.macro_f1, r.ece, r.tie_recall) == pytest.approx(want, abs=6e-5) and r.n == len(data)
    best = overlays.best_overlay(overlays.overlay_tie_search(df), 0.0, 0.0, 1.0, 0.0).collect()
    assert len(best) == 1 and best[0].tie_recall == max(r.tie_recall for r in found)
    assert overlays.best_overlay(overlays.overlay_tie_search(df), 2.0, 0.0, 1.0, 0.0).count() == 0


def test_overlay_without_base_margins_and_without_rows(spark):
    df = frame(spark, rows(150, 5)).drop("base_margin")
    assert overlays.overlay_tie_search(df).count() % 70 == 0
    assert overlays.overlay_tie_search(df.where("false")).count() == 0


def test_one_policy_for_seeds(spark):
    sets = {s: [(i, d, g, p, m) for i, d, g, p, m in rows(120, 10 + s)] for s in range(3)}
    parts = [frame(spark, v).withColumn("seed", F.lit(s)).withColumn("split", F.when(F.col("id") % 3 == 0, "dev").when(F.col("id") % 3 == 1, "test").otherwise("train")) for s, v in sets.items()]
    df = parts[0].unionByName(parts[1]).unionByName(parts[2])
    for dataset in (None, "a"):
        found = overlays.seed_policy_search(df, dataset, accuracy_floor=0.2).collect()
        assert len(found) == 80 and sum(r.chosen for r in found) == 1
        for r in random.Random(2).sample(found, 12):
            each = {}
            for s, v in sets.items():
                for name, k in (("dev", 0), ("test", 1)):
                    own = [x for x in v if x[0] % 3 == k]
                    hit = lambda x, r=r: base(x)[0] != "Tie" and x[3][2] >= r.min_tie and abs(x[3][0] - x[3][1]) <= r.max_margin and base(x)[1] <= r.max_confidence and dataset in (None, x[1])
                    each.setdefault(name, []).append(plain(own, [("Tie", x[3][2]) if hit(x) else base(x) for x in own]))
            for name, v in each.items():
                for i, c in enumerate(("accuracy", "macro_f1", "ece", "tie_recall")):
                    assert r[f"{name}_{c}"] == pytest.approx(sum(x[i] for x in v) / 3, abs=6e-5)
            assert r.worst_dev_accuracy == pytest.approx(min(x[0] for x in each["dev"]), abs=6e-5)
        chosen = next(r for r in found if r.chosen)
        assert chosen.dev_tie_recall == max(r.dev_tie_recall for r in found if r.eligible)
        out = overlays.rescued(df, chosen.min_tie, chosen.max_margin, chosen.max_confidence, dataset)
        dev = metrics.metric_bundle(out.where("split = 'dev'"), ["seed"]).agg(F.avg("accuracy")).first()[0]
        assert dev == pytest.approx(chosen.dev_accuracy, abs=6e-5)
    assert not any(r.chosen for r in overlays.seed_policy_search(df, accuracy_floor=1.1).collect())
