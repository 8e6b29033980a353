"""Judge backends: what scores pairs of answers, and what is done when one is not available."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import scores as S

COLUMNS = "label, score_a, score_b, backend, parse_status"


@dataclass(frozen=True)
class Backend:
    """A named scorer: score maps samples to samples with label and raw_output; status tells whether it can run."""

    name: str
    score: Callable[[DataFrame], DataFrame]
    available: bool = True
    reason: str = ""

    def judge(self, samples: DataFrame) -> DataFrame:
        """samples with label, score_a, score_b, backend and parse_status (ok or failed)."""
        pair = S.final_score(F.col("label"))
        out = self.score(samples).withColumn("backend", F.lit(self.name))
        out = out.withColumn("score_a", F.when(F.col("label").isNotNull(), pair)).withColumn("score_b", F.when(F.col("label").isNotNull(), 1 - pair))
        return out.withColumn("parse_status", F.when(F.col("label").isNull(), "failed").otherwise("ok"))


def heuristic() -> Backend:
    return Backend("heuristic", lambda d: d.withColumn("label", S.heuristic_pairwise()["label"]).withColumn("raw_output", F.lit(None).cast("string")))


def mock(output: str = "[RESULT] A", name: str = "mock") -> Backend:
    """Answers every sample with the same text, which goes through the parser."""
    return Backend(name, lambda d: d.withColumn("raw_output", F.lit(output)).withColumn("label", S.parse_label("raw_output")))


def generated(name: str, generate: Callable[[DataFrame, str], DataFrame] | None) -> Backend:
    """A model that writes its verdict: generate fills raw_output from the prompt column; without one the backend is unavailable."""
    if generate is None:
        return Backend(name, lambda d: d, False, "no model is given")

    def score(samples: DataFrame) -> DataFrame:
        prompted = samples.withColumn("judge_prompt", L.pairwise_prompt("prompt", "answer_a", "answer_b"))
        return generate(prompted, "judge_prompt").drop("judge_prompt").withColumn("label", S.parse_label("raw_output"))

    return Backend(name, score)


def make_backend(kind: str, model: str | None = None, generate: Callable[[DataFrame, str], DataFrame] | None = None) -> Backend:
    """The backend of a kind: heuristic, or a generating one (model ``mock``: a fixed answer)."""
    if kind == "heuristic":
        return heuristic()
    return mock(name=kind) if model == "mock" else generated(kind, generate)


def evaluate(samples: DataFrame, backend: Backend, allow_fallback: bool = True) -> DataFrame:
    """judge() of a backend; where that is unavailable all samples go to the heuristic judge, with fallback_from and fallback_reason, or an error is raised."""
    none = F.lit(None).cast("string")
    if backend.available:
        return backend.judge(samples).withColumn("fallback_from", none).withColumn("fallback_reason", none)
    if not allow_fallback:
        raise RuntimeError(f"{backend.name} is unavailable: {backend.reason}")
    return heuristic().judge(samples).withColumn("fallback_from", F.lit(backend.name)).withColumn("fallback_reason", F.lit(backend.reason))
