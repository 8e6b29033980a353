"""Evidence of pairs: cases worked out by hand, and every pair of sentences compared in plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from verdictlake.functions import text as T
from verdictlake.operators import evidence

SCHEMA = "id long, answer_a string, answer_b string, context string, reference string, human_label string"


def profile(spark, *rows, **more):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)
    return [r.asDict() for r in evidence.pair_profiles(df, reference="reference", **more).orderBy("id").collect()]


def test_by_hand(spark):
    full, lost, single, alone, none, alike, also = profile(
        spark,
        ("The river rose by 30 meters.", "The river fell by 12 meters.", "In spring the river rose by 30 meters. Nobody was hurt.", "river", "B>A"),
        ("It was not closed.", None, "It was closed early today.", None, "supported"),
        ("The Anna bridge holds.", "", "The Anna bridge holds.", "", "supported"),
        ("More wagons came in 1999.", None, None, None, None),
        (None, None, None, None, None),
        ("same text here", "same text here", "same text here", None, "Tie"),
        ("same text here", "same text here", "same text here", None, "Tie"),
    )
    assert full["form"] == "pairwise" and full["context_support_a"] == 1.0 and full["numeric_evidence_gap_b"] == 1.0
    assert full["pairwise_support_contradiction"] == 1.0 and full["evidence_risk"] == 0.8 and full["review_required"]
    assert {"pairwise_support_contradiction", "numeric_evidence_gap_b"} <= set(full["reasons"]) and full["reasons"] == sorted(full["reasons"])
    assert 0 < full["reference_support_a"] < 0.25
    assert lost["form"] == "single_answer" and lost["negation_mismatch_a"] == 1.0 and lost["context_support_b"] is None and lost["evidence_risk"] >= 0.85
    assert single["evidence_risk"] == 0.0 and single["reasons"] == [] and single["support_delta_a_minus_b"] is None
    assert (alone["comparative_mismatch_a"], alone["low_support_sentence_ratio_a"], alone["numeric_evidence_gap_a"], alone["max_low_support_anchor_gap_a"], alone["anchored_hallucination_severity_a"]) == (1.0, 1.0, 1.0, 1.0, 1.0)
    assert none["evidence_risk"] == 0.0 and all(none[f"{m}_a"] == 0.0 for m in evidence.MEASURES)
    assert {**alike, "id": 0} == {**also, "id": 0} and alike["pairwise_support_contradiction"] == 0.0 and alike["form"] == "pairwise"


def test_vector_form_and_signal(spark):
    df = spark.createDataFrame([(1, "a b", None, "a b", None, "supported", "factuality_rag", "Pairwise"), (2, "a", None, None, None, "A>B", "factuality_rag", None), (3, "a", None, None, None, None, "factuality_rag", None), (4, "a", "b", None, None, "Tie", "open_qa", None), (5, "a", None, "a", None, "ambiguous", "factuality_rag", "")], f"{SCHEMA}, task_type string, said string")
    signal = df.select("id", evidence.decision_signal(F.col("task_type"), F.col("human_label"), evidence.task_form(df, "said")).alias("s")).orderBy("id").collect()
    assert [r.s for r in signal] == ["pairwise_factuality", "pairwise_factuality", "non_factuality", "non_factuality", "single_answer_factuality"]
    v = evidence.vector(evidence.pair_profiles(df, form="said"))
    assert len(v.columns) == 37 and all(x is not None for r in v.collect() for x in r)
    assert evidence.pair_profiles(df.where("false")).count() == 0


def test_best_sentences_equal_all_pairs(spark):
    rng = random.Random(5)
    words = "river bridge seven 12 1999 anna BERLIN holds carries wagons more less not the of 40".split()
    sentence = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 7))) + rng.choice(".!?")
    text = lambda n: " ".join(sentence() for _ in range(rng.randint(0, n)))
    rows = [(text(4), text(3), text(12), text(3), "Tie") for _ in range(60)]
    split = lambda t: [s for s in re.split(r"(?<=[.!?])\s+", t.strip()) if s]
    tokens = lambda t: {w for w in re.findall("[a-z0-9]+", t.lower()) if w not in T.STOPWORDS}
    digits = lambda t: set(re.findall(r"\d+", t))

    def support(s, e):
        a, b, n = tokens(s), tokens(e), digits(s)
        long_ = {w for w in a if w.isdigit() or len(w) > 3}
        share, more = len(a & b) / len(a) if a else 0, len(long_ & b) / len(long_) if long_ else 0
        return 0.45 * share + 0.30 * more + 0.25 * len(n & digits(e)) / len(n) if n else 0.65 * share + 0.35 * more

    for r, (a, b, c, ref, _) in zip(profile(spark, *rows), rows):
        for side, x in (("a", a), ("b", b)):
            if side == "b" and not b:
                continue
            mine, theirs = split(x), split(f"{c} {ref}")
            best = [max([support(s, e) for e in theirs], default=0.0) for s in mine]
            assert r[f"sentence_max_support_{side}"] == pytest.approx(max(best, default=0), abs=1e-6)
            assert r[f"sentence_mean_support_{side}"] == pytest.approx(sum(best) / len(best) if best else 0, abs=1e-6)
            pick = [(s, max(theirs, key=lambda e, s=s: support(s, e))) for s, v in zip(mine, best) if v >= 0.20 - 1e-12]
            wrong = [("not" in s.lower()[:-1].split()) != ("not" in e.lower()[:-1].split()) for s, e in pick]
            assert r[f"negation_mismatch_{side}"] == pytest.approx(sum(wrong) / len(wrong) if wrong else 0, abs=1e-6)
