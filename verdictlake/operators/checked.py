"""Checks inside the plan that writes: a broken row stops the write by name, gates read counts that the same pass observed."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..schemas import PREDICTION
from .validation import first_reason

Rules = list[tuple[str, Column]]
Gates = list[tuple[str, Callable[[dict], bool]]]


class GateError(ValueError):
    """Counts of a written table that don't pass; failed names the gates."""

    def __init__(self, failed: list[str]):
        super().__init__(f"gates not passed: {', '.join(failed)}")
        self.failed = failed


def prediction_rules() -> Rules:
    """What every calibrated row has to meet: an id and labels, some probabilities, confidence and risk within 0 and 1."""
    inside = lambda c: F.coalesce(F.col(c).between(0.0, 1.0), F.lit(False))
    rules = [(f"{c} missing", F.col(c).isNull()) for c in ("id", "dataset", "task_type", "split", "head", "human_label", "predicted_label", "final_score", "review_flag")]
    rules += [("label_probabilities empty", F.coalesce(F.size("label_probabilities") <= 0, F.lit(True)))]
    return rules + [(f"{c} outside [0, 1]", ~inside(c) | F.isnan(c)) for c in ("confidence", "risk_score")]


def missing_columns(df: DataFrame) -> list[str]:
    """Columns that calibrated rows need and df lacks, in order of the name."""
    return sorted({f.name for f in PREDICTION.fields} - set(df.columns))


def checked(df: DataFrame, rules: Rules, key: str) -> DataFrame:
    """df, whose first row that breaks a rule stops the job with the rule's name and the row's key; a rule that is null is not broken."""
    rules = [(name, F.coalesce(broken, F.lit(False))) for name, broken in rules]
    reason = first_reason(rules)
    message = F.concat(reason, F.lit(": "), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null")))
    return df.where(F.when(reason == "ok", True).otherwise(F.raise_error(message).cast("boolean")))


def checked_write(df: DataFrame, path: str, rules: Rules, key: str, counts: list[Column], gates: Gates) -> dict:
    """Writes df as Parquet to a new folder, path, in one pass that checks every row and observes counts (named aggregates); returns the counts.

    A broken row fails the job, and nothing is committed. A gate that the counts don't pass raises GateError with the names of all
    such gates; the table is there then, and is the caller's to remove. Counts are taken in the stage that writes, where a task that runs again counts once. An empty table gives counts of no rows.
    """
    seen = Observation(f"checked-{uuid.uuid4().hex}")
    # Observed first: a filter isn't pushed below, so the rules read columns and don't repeat what these are made of.
    checked(df.observe(seen, *counts), rules, key).write.parquet(path)
    found = seen.get
    if failed := [name for name, passed in gates if not passed(found)]:
        raise GateError(failed)
    return found
