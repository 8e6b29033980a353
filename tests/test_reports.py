"""Hand-worked cases of verdicts, policies, intervals, evidence and backends."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdictlake.functions import scores as S
from verdictlake.operators import backends, metrics, policy, profiles, reports

VERDICTS = {
    "Response A is better than Response B.": "A>B",
    "Based on the rubric, I find that response B is the stronger one.": "B>A",
    "Response A fails to answer the question.": "B>A",
    "Response B lacks detail, and response A correctly identifies the cause.": "A>B",
    "Response A is accurate. Response B is accurate.": None,
    "Both responses are equally good.": "Tie",
    "Both responses correctly answer, but response A is more detailed.": None,
    "Overall, response B": "B>A",
    "feedback ... [RESULT]  b": "B>A",
    "[result] TIE": "Tie",
    "answer a is better": None,
    "so A>B": "A>B",
    "tie": "Tie",
    "": None,
    None: None,
}


def test_verdicts(spark):
    rows = spark.createDataFrame([(k,) for k in VERDICTS], "raw string").select("raw", S.parse_label("raw").alias("label")).collect()
    assert {r.raw: r.label for r in rows} == VERDICTS


def predictions(spark, rows):
    """(id, dataset, gold, probabilities, base margin)"""
    return metrics.with_derived(spark.createDataFrame(rows, "id long, dataset string, gold string, probs array<double>, base_margin double"))


def test_tie_policy_with_base_margins(spark):
    rows = [(i, "d", "A>B", [0.8, 0.1, 0.1], 0.9) for i in range(20)]
    rows += [(100 + i, "d", "Tie", [0.40, 0.38, 0.22], 0.04) for i in range(5)]  # ties that a policy with a small base margin finds
    rows += [(200 + i, "d", "A>B", [0.41, 0.37, 0.22], 0.40) for i in range(5)]  # the same probabilities, but the base judge was sure
    df = predictions(spark, rows)
    search = {(r.min_tie, r.max_margin, r.max_base_margin): r for r in policy.tie_policy_search(df).collect()}
    assert len(search) == 1 + 14 * 13 * 6
    assert search[None, None, None].tie_recall == 0 and search[None, None, None].gold_ties == 5
    assert search[0.22, 0.05, 0.05].accuracy == 1.0 and search[0.22, 0.05, None].accuracy == round(25 / 30, 4)
    assert search[0.25, 0.05, None].tie_recall == 0 and search[0.22, 0.05, 0.25].tie_recall == 1.0
    best = policy.best_tie_policy(policy.tie_policy_search(df), ece_slack=1.0).first()
    assert (best.accuracy, best.tie_recall) == (1.0, 1.0) and best.max_base_margin in (0.05, 0.10, 0.25)
    # Without slack in calibration error no candidate is near enough, and the best objective wins.
    assert policy.best_tie_policy(policy.tie_policy_search(df.drop("base_margin"))).first().max_base_margin is None


def test_dataset_policies_have_gates(spark):
    few = [(i, "few", "Tie", [0.40, 0.38, 0.22], 0.04) for i in range(19)]
    rare = [(100 + i, "rare", "A>B", [0.8, 0.1, 0.1], 0.9) for i in range(30)] + [(200 + i, "rare", "Tie", [0.40, 0.38, 0.22], 0.04) for i in range(2)]
    enough = [(300 + i, "enough", "A>B", [0.9, 0.05, 0.05], 0.9) for i in range(30)] + [(400 + i, "enough", "Tie", [0.48, 0.05, 0.47], 0.04) for i in range(3)]
    df = predictions(spark, few + rare + enough)
    chosen = policy.dataset_tie_policies(df).collect()
    assert [r.dataset for r in chosen] == ["enough"] and chosen[0].tie_recall == 1.0 and chosen[0].min_tie == 0.05
    after = {r.id: r for r in policy.with_dataset_policies(df, policy.dataset_tie_policies(df)).collect()}
    assert after[400].predicted == "Tie" and after[400].correct and after[400].confidence == 0.47 and after[0].predicted == "A>B" and after[300].predicted == "A>B"


def test_intervals_against_numpy(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(600):
        p = rng.dirichlet([2, 2, 1])
        rows.append((i, "x" if i % 2 else "y", ["A>B", "B>A", "Tie"][rng.choice(3, p=0.5 * p + 0.5 / 3)], p.tolist(), 0.0))
    df = predictions(spark, rows)
    found = {(r.dataset, r.metric): r for r in metrics.bootstrap_metrics(df, ["dataset"]).collect()}
    assert len(found) == 10
    point = {r.dataset: r for r in metrics.metric_bundle(df, ["dataset"]).collect()}
    data = df.toPandas()
    for name, group in data.groupby("dataset"):
        hits, ties = group["correct"].to_numpy(float), (group["gold"] == "Tie").to_numpy()
        draws = rng.integers(0, len(group), (2000, len(group)))
        accuracy = hits[draws].mean(1)
        recall = np.array([hits[d][ties[d]].mean() for d in draws])
        brier = np.array([sum((p[k] - (g == label)) ** 2 for k, label in enumerate(("A>B", "B>A", "Tie"))) for p, g in zip(group["probs"], group["gold"])])[draws].mean(1)
        for metric, values in (("accuracy", accuracy), ("tie_recall", recall), ("brier", brier)):
            r = found[name, metric]
            assert r.point == pytest.approx(getattr(point[name], metric)) and r.n == 300
            assert np.allclose([r.low, r.high], np.quantile(values, [0.025, 0.975]), atol=0.02), (metric, r)
        for metric in ("macro_f1", "ece"):
            r = found[name, metric]
            assert r.point == pytest.approx(getattr(point[name], metric)) and r.low < r.high
    again = {(r.dataset, r.metric): (r.low, r.high) for r in metrics.bootstrap_metrics(df.repartition(7), ["dataset"]).collect()}
    assert all(np.allclose(again[k], (r.low, r.high)) for k, r in found.items())


def test_paired_deltas(spark):
    rows = [(i, "x", "A>B", [0.6, 0.3, 0.1], 0.0) for i in range(200)]
    df = predictions(spark, rows).withColumn("other", F.when(F.col("id") < 50, "B>A").otherwise("A>B"))
    found = {r.metric: r for r in metrics.bootstrap_deltas(df, "other", []).collect()}
    assert found["accuracy"].delta == 0.25 and 0.17 < found["accuracy"].low < 0.25 < found["accuracy"].high < 0.33
    same = {r.metric: r for r in metrics.bootstrap_deltas(df.withColumn("other", F.col("predicted")), "other", []).collect()}
    assert all((r.delta, r.low, r.high) == (0, 0, 0) for r in same.values())


def test_evidence_without_sentences(spark):
    df = spark.createDataFrame([(1, "It is larger than before and more costly.", None), (2, "It is larger than before.", ""), (3, "No numbers.", None)], "id long, answer_a string, context string")
    rows = {r.id: r for r in profiles.evidence_profile(df).collect()}
    assert rows[1].comparative_mismatch == 1.0 and rows[2].comparative_mismatch == 1.0 and rows[3].comparative_mismatch == 0.0
    assert rows[1].negation_mismatch == 0.0 and "comparative_mismatch" in rows[1].reasons and rows[1].evidence_risk >= 0.65


def test_pairwise_contradiction(spark):
    cases = [("A>B", 0.2, 0.4, 1.0), ("A>B", 0.38, 0.4, 0.0), ("B>A", 0.9, 0.1, 1.0), ("Tie", 0.9, 0.1, 0.5), ("Tie", 0.4, 0.3, 0.0), ("A>B", 0.9, 0.1, 0.0)]
    df = spark.createDataFrame(cases, "label string, a double, b double, want double")
    for r in df.select("want", profiles.pairwise_contradiction(F.col("label"), F.col("a"), F.col("b")).alias("c")).collect():
        assert r.c.contradiction == r.want and (r.c.reason is None) == (r.want == 0)


def test_backends(spark):
    df = spark.createDataFrame([(1, "What is it?", "A long answer, with words. And more.", "No.", "ctx")], "id long, prompt string, answer_a string, answer_b string, context string")
    r = backends.evaluate(df, backends.mock("[RESULT] Tie")).first()
    assert (r.label, r.score_a, r.score_b, r.parse_status, r.fallback_from) == ("Tie", 0.5, 0.5, "ok", None)
    r = backends.evaluate(df, backends.mock("nothing")).first()
    assert r.label is None and r.parse_status == "failed" and r.score_a is None
    r = backends.evaluate(df, backends.make_backend("evaluator")).first()
    assert r.fallback_from == "evaluator" and r.backend == "heuristic" and r.label in ("A>B", "B>A", "Tie")
    with pytest.raises(RuntimeError):
        backends.evaluate(df, backends.make_backend("evaluator"), allow_fallback=False)
    own = backends.make_backend("evaluator", "m", lambda d, prompt: d.withColumn("raw_output", F.when(F.length(prompt) > 0, "Overall, response B")))
    assert backends.evaluate(df, own).first().label == "B>A"


def test_gates(spark):
    m = spark.createDataFrame([("pairwise", 0.5, 0.4, 0.1), ("factuality", 0.8, 0.69, 0.1)], "head string, accuracy double, macro_f1 double, ece double")
    found = {r.check: r.passed for r in reports.gate(m, "head").collect()}
    assert found["pairwise_accuracy_min_0.400"] and not found["factuality_macro_f1_min_0.695"] and not found["all"] and len(found) == 6
    assert not any(r.passed for r in reports.gate(m.where("false"), "head").collect())


def test_risk_coverage_counts(spark):
    rows = [(i, "x", "A>B", [0.5 + i / 100, 0.3 - i / 200, 0.2 - i / 200], 0.0) for i in range(7)]
    from verdictlake.operators import ranking

    found = {r.review_rate: r for r in ranking.risk_coverage(predictions(spark, rows)).collect()}
    assert [found[x].reviewed for x in (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.75, 1.0)] == [1, 1, 1, 2, 3, 4, 5, 7]  # halves go to the even number
    assert found[1.0].auto_accept_accuracy is None and found[0.05].error_capture is None and found[0.5].auto_accept_accuracy == 1.0
