"""Gates, audits, tables and selections that reports are made of. All are small grouped aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# The least or greatest value of a metric of a head that lets a trained model pass.
TRAINING_GATES = (
    ("pairwise", "accuracy", ">=", 0.40),
    ("pairwise", "macro_f1", ">=", 0.35),
    ("factuality", "accuracy", ">=", 0.70),
    ("factuality", "macro_f1", ">=", 0.695),
    ("factuality", "ece", "<=", 0.20),
)


def _meets(value: Column, sign: str, bound) -> Column:
    return {">=": value >= bound, "<=": value <= bound, ">": value > bound, "<": value < bound}[sign]


def gate(metrics: DataFrame, key: str, rules=TRAINING_GATES) -> DataFrame:
    """check, passed for each rule (key's value, metric, sign, bound), and a last row ``all``; a missing metric doesn't pass."""
    checks = [
        (f"{head}_{metric}_{'min' if '>' in sign else 'max'}_{bound:.3f}", F.coalesce(F.bool_or(F.when(F.col(key) == head, _meets(F.col(metric), sign, bound))), F.lit(False)))
        for head, metric, sign, bound in rules
    ]
    one = metrics.agg(*(c.alias(f"c{i}") for i, (_, c) in enumerate(checks)))
    every = F.lit(True)
    for i in range(len(checks)):
        every = every & F.col(f"c{i}")
    cells = [F.struct(F.lit(name).alias("check"), F.col(f"c{i}").alias("passed")) for i, (name, _) in enumerate(checks)]
    return one.select(F.explode(F.array(*cells, F.struct(F.lit("all").alias("check"), every.alias("passed")))).alias("r")).select("r.*")


def submission_gate(points: DataFrame, key: str, baseline: str, accuracy_point: str, tie_point: str) -> DataFrame:
    """check, passed: two operating points against a baseline, rows of one metrics table; and a last row ``all``."""
    at = lambda who, metric: F.max(F.when(F.col(key) == who, F.col(metric)))
    rules = [("accuracy_point_macro_f1_above_baseline", accuracy_point, "macro_f1", ">"), ("accuracy_point_accuracy_above_baseline", accuracy_point, "accuracy", ">"), ("accuracy_point_ece_below_baseline", accuracy_point, "ece", "<")]
    rules += [("tie_point_macro_f1_above_baseline", tie_point, "macro_f1", ">"), ("tie_point_tie_recall_above_baseline", tie_point, "tie_recall", ">"), ("tie_point_ece_below_baseline", tie_point, "ece", "<")]
    one = points.agg(*(F.coalesce(_meets(at(who, metric), sign, at(baseline, metric)), F.lit(False)).alias(name) for name, who, metric, sign in rules))
    every = F.lit(True)
    for name, *_ in rules:
        every = every & F.col(name)
    cells = [F.struct(F.lit(name).alias("check"), F.col(name).alias("passed")) for name, *_ in rules]
    return one.select(F.explode(F.array(*cells, F.struct(F.lit("all").alias("check"), every.alias("passed")))).alias("r")).select("r.*")


def core_audit(samples: DataFrame, split: str = "split", least_chars: int = 10) -> DataFrame:
    """check, count and status of a sample set: labels, second answers, short answers, phone-like text, repeated prompts, prompts in several splits, repeated contents.

    status is pass at a count of 0; short answers and phone-like text are for review, the others fail.
    """
    key = [T.content_key("dataset", "prompt", "answer_a", "answer_b")]
    blank = lambda c: (F.trim(F.coalesce(F.col(c), F.lit(""))) == "").cast("long")
    phones = F.coalesce(F.size(T.phone_numbers("answer_a")), F.lit(0)) > 0
    rows = samples.agg(
        F.sum(F.col("human_label").isNull().cast("long")).alias("null_labels"),
        F.sum(blank("answer_b")).alias("empty_answer_b"),
        F.sum((F.length(F.trim(F.coalesce("answer_a", F.lit("")))) < least_chars).cast("long")).alias("short_answers"),
        F.sum(phones.cast("long")).alias("phone_like"),
    )
    prompts = samples.groupBy("dataset", "prompt").agg(F.count("*").alias("n"), F.min(split).alias("low"), F.max(split).alias("high"))
    prompts = prompts.agg(F.sum((F.col("n") > 1).cast("long")).alias("repeated_prompts"), F.sum((F.col("low") < F.col("high")).cast("long")).alias("prompts_in_splits"))
    contents = samples.groupBy(*(k.alias("k") for k in key)).agg(F.count("*").alias("n")).agg(F.sum(F.col("n") - 1).alias("repeated_contents"))
    one = rows.crossJoin(F.broadcast(prompts)).crossJoin(F.broadcast(contents))  # one row each
    names = {"null_labels": "fail", "empty_answer_b": "fail", "short_answers": "review", "phone_like": "review", "repeated_prompts": "review", "prompts_in_splits": "fail", "repeated_contents": "fail"}
    cells = [F.struct(F.lit(n).alias("check"), F.coalesce(F.col(n), F.lit(0)).cast("long").alias("count"), F.when(F.coalesce(F.col(n), F.lit(0)) == 0, "pass").otherwise(bad).alias("status")) for n, bad in names.items()]
    return one.select(F.explode(F.array(*cells)).alias("r")).select("r.*")


def selection_reasons(gold: str = "gold", predicted: str = "predicted", base: str = "base_predicted", confidence: str = "confidence", low: float = 0.5) -> Column:
    """Why a row is worth probing: its error, low confidence, disagreement with the base judge, a tie on any side."""
    known = lambda c: F.col(c).isin("A>B", "B>A", "Tie")
    tie = F.lit(False)
    for c in (gold, predicted, base):
        tie = tie | F.coalesce(F.col(c) == "Tie", F.lit(False))
    return F.array_compact(
        F.array(
            F.when(known(gold) & known(predicted) & (F.col(gold) != F.col(predicted)), "calibrated_error"),
            F.when(F.coalesce(F.col(confidence), F.lit(0.0)) <= low, "low_confidence"),
            F.when(known(base) & known(predicted) & (F.col(base) != F.col(predicted)), "base_calibrated_disagreement"),
            F.when(tie, "tie_case"),
        )
    )


def tie_recall_table(df: DataFrame, by: list[str]) -> DataFrame:
    """by, gold_tie, pred_tie, tie_recall and accuracy."""
    tie = lambda c: F.sum((F.col(c) == "Tie").cast("long"))
    both = F.sum(((F.col("gold") == "Tie") & (F.col("predicted") == "Tie")).cast("double"))
    return df.groupBy(*by).agg(tie("gold").alias("gold_tie"), tie("predicted").alias("pred_tie"), F.try_divide(both, tie("gold")).alias("tie_recall"), F.avg(F.col("correct").cast("double")).alias("accuracy"))


def margin_candidates(df: DataFrame, value: Column, steps: int = 20) -> DataFrame:
    """step, margin: order statistics of a value at steps + 1 evenly spaced places of the sorted rows, the first and the last included."""
    n = df.count()
    places = sorted({round((n - 1) * k / steps) for k in range(steps + 1)}) if n else []
    if not places:
        return df.sparkSession.createDataFrame([], "place long, margin double")
    # Values that are alike are counted first; a place is in the run of a value.
    runs = df.select(value.cast("double").alias("v")).groupBy("v").agg(F.count("*").alias("n"))
    quantiles = F.percentile("v", F.array(*(F.lit(k / max(1, n - 1)) for k in places)), F.col("n")).alias("q")
    pairs = F.explode(F.arrays_zip(F.array(*(F.lit(k).cast("long") for k in places)).alias("place"), F.col("q").alias("margin"))).alias("r")
    return runs.agg(quantiles).select(pairs).select("r.place", "r.margin")


def subset_metadata(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, value and n for each of the columns, one pass over the rows."""
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("none")).alias("value")) for c in columns)))
    return df.select(cells.alias("c")).groupBy("c.column", "c.value").agg(F.count("*").alias("n"))


def means_pass(df: DataFrame, by: list[str], floors: dict[str, float], ceilings: dict[str, float]) -> DataFrame:
    """by, the means of the metrics, and whether all reach their floors and stay under their ceilings."""
    means = df.groupBy(*by).agg(*(F.avg(c).alias(c) for c in [*floors, *ceilings]))
    ok = F.lit(True)
    for c, v in floors.items():
        ok = ok & (F.col(c) >= v)
    for c, v in ceilings.items():
        ok = ok & (F.col(c) <= v)
    return means.withColumn("passed", F.coalesce(ok, F.lit(False)))


def source_provenance(rows: DataFrame, manifest: DataFrame, source: str = "source") -> DataFrame:
    """Every source of a manifest with the rows it gave, 0 without any."""
    return manifest.join(rows.groupBy(source).agg(F.count("*").alias("accepted")), source, "left").na.fill(0, ["accepted"])
