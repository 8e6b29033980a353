"""Queries over whole documents against plain Python: evidence beyond the 400th character counts."""

import re

import pytest

from verdictlake.plans.queries import ORACLE_SQL, QUERIES

ANSWER = "The bridge near Odense carries 7341 wagons daily."
OTHER = "Nothing was measured there."
FILLER = "Quiet river water flows along green banks. " * 20
TEXT = FILLER + ANSWER


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("whole"))
    turns = [(1, 1, "user", "How many wagons does the bridge carry?"), (1, 2, "assistant", ANSWER), (2, 1, "user", "And there?"), (2, 2, "assistant", OTHER)]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{d}/conversations.parquet")
    spark.createDataFrame([(1, TEXT), (2, TEXT)], "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    return d


def row(spark, folder, name):
    return QUERIES[name](spark, folder).where("id = 1").first()


def words(text, least):
    return set(re.findall(rf"[a-z0-9]{{{least},}}", text.lower()))


def test_evidence_beyond_the_cut(spark, folder):
    assert len(FILLER) > 400
    found = row(spark, folder, "evidence_support")
    assert found.support == 1.0 and found.numeric_gap == 0.0
    e = row(spark, folder, "evidence_profile")
    assert e.context_support == 1.0 and e.sentence_max_support == 1.0
    assert (e.numeric_evidence_gap, e.entity_evidence_gap, e.evidence_risk, e.reasons) == (0.0, 0.0, 0.0, "")


def test_overlaps_and_judges(spark, folder):
    found = row(spark, folder, "pairwise_features")
    c = words(TEXT, 2)
    for side, answer in (("a", ANSWER), ("b", OTHER)):
        own = words(answer, 2)
        assert found[f"overlap_{side}_context"] == pytest.approx(len(own & c) / len(own | c), abs=1e-6)
    own = words(ANSWER, 2)
    assert row(spark, folder, "heuristic_direct_judge").factuality == pytest.approx(1 + 4 * max(0.25, len(c & own) / len(c)), abs=1e-4)
    prompt = "How many wagons does the bridge carry?"
    p, q, n = words(prompt, 3), words(TEXT, 3), (len(prompt), len(TEXT))
    common = len(p & q) / len(p) * 0.1 + (1 - min(1, abs(n[0] - n[1]) / max(n))) * 0.05
    assert row(spark, folder, "heuristic_pairwise_judge").score_a == pytest.approx(0.2 + 0.05 + 0.15 + common, abs=1e-6)


def test_twins_read_whole_documents():
    assert not [n for n, sql in ORACLE_SQL.items() if "substr(d.text" in sql]
