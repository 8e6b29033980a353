"""Schemas of samples, judge scores and predictions, and the enumerations that they use."""

from __future__ import annotations

from pyspark.sql.types import BooleanType, DoubleType, MapType, StringType, StructField, StructType

# Labels, tasks, splits and the mark for a missing second answer.
PAIRWISE = ("A>B", "B>A", "Tie")
FACTUALITY = ("supported", "unsupported", "ambiguous")
TASKS = ("open_qa", "pairwise_bias", "factuality_rag")
SPLITS = ("train", "dev", "test")
LANGUAGES = ("en", "zh")
NO_SECOND_ANSWER = "[SINGLE_ANSWER_FACTUALITY_TASK]"


def _strings(*names: str) -> list[StructField]:
    return [StructField(n, StringType()) for n in names]


_TEXT_MAP = MapType(StringType(), StringType())

SAMPLE = StructType(
    _strings("id", "dataset", "task_type", "prompt", "context", "answer_a", "answer_b", "reference")
    + [StructField("human_score", _TEXT_MAP), *_strings("human_label", "language", "split"), StructField("metadata", _TEXT_MAP)]
)
SCORE = StructType(
    _strings("id", "dataset", "task_type", "gold_label", "pred_label")
    + [StructField("gold_score", DoubleType()), StructField("pred_score", DoubleType()), *_strings("raw_output", "judge_backend", "parse_status")]
    + [StructField("parsed_scores", StructType([StructField("score_a", DoubleType()), StructField("score_b", DoubleType())]))]
)
PREDICTION = StructType(
    _strings("id", "dataset", "task_type", "split", "head", "human_label", "predicted_label")
    + [StructField(n, DoubleType()) for n in ("final_score", "confidence", "risk_score")]
    + [StructField("review_flag", BooleanType()), StructField("review_reason", StringType()), StructField("label_probabilities", MapType(StringType(), DoubleType()))]
)
