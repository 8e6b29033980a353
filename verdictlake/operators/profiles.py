"""Bias and evidence profiles of samples, as column expressions over one row each; no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as T
from . import evidence


def _risk(risk: float, reason: str | None) -> Column:
    return F.struct(F.lit(risk).alias("risk"), F.lit(reason).cast("string").alias("reason"))


def _longer_side(ratio: float = 1.15) -> Column:
    a, b = F.length(T.normalize("answer_a")), F.length(T.normalize("answer_b"))
    uneven = (a > 0) & (b > 0) & (F.greatest(a, b) / F.greatest(F.lit(1), F.least(a, b)) >= ratio)
    return F.when(uneven, F.when(a > b, "a").otherwise("b"))


def bias_profile(df: DataFrame, review_at: float = 0.5) -> DataFrame:
    """Risks of position, length, format, rubric and source bias in 0 to 1, the largest, whether to review, and sorted reasons.

    df has answer_a, answer_b, human_label, bias_type, predicted (null: none) and optionally gap.
    """
    side, predicted, gold = _longer_side(), S.favoured(F.col("predicted")), S.favoured(F.col("human_label"))
    wrong = F.col("predicted").isNotNull() & ~F.col("predicted").eqNullSafe(F.col("human_label"))
    length = (
        F.when(side.isNull(), _risk(0.0, None))
        .when((predicted == side) & ~F.coalesce(gold.isin("tie"), F.lit(False)) & ~gold.eqNullSafe(side), _risk(1.0, "prediction_favors_longer_answer_against_gold"))
        .when((predicted == side) & (gold == "tie"), _risk(0.7, "prediction_favors_longer_answer_on_gold_tie"))
        .when(predicted.isNull(), _risk(0.25, "length_imbalance_present_without_prediction"))
        .otherwise(_risk(0.0, None))
    )

    def perturbed(kind: str, name: str) -> Column:
        return (
            F.when((F.col("bias_type") == kind) & wrong, _risk(1.0, f"{name}_prediction_mismatch"))
            .when(F.col("bias_type") == kind, _risk(0.35, f"{name}_present"))
            .otherwise(_risk(0.0, None))
        )

    gap = F.round(S.clip01(F.abs(F.coalesce(F.col("gap"), F.lit(0.0)))), 6) if "gap" in df.columns else F.lit(0.0)
    rows = df.select(
        *df.columns,
        length.alias("_length"),
        perturbed("position", "position_perturbation").alias("_position"),
        perturbed("format", "format_perturbation").alias("_format"),
        perturbed("rubric_sensitivity", "rubric_sensitivity").alias("_rubric"),
        gap.alias("source_risk"),
    )
    kinds = ("position", "length", "format", "rubric")
    reasons = F.array(*(F.col(f"_{k}.reason") for k in kinds), F.when(F.col("source_risk") > 0, "dataset_accuracy_gap"))
    out = rows.select(*df.columns, *(F.col(f"_{k}.risk").alias(f"{k}_risk") for k in kinds), "source_risk", F.array_sort(F.array_distinct(F.array_compact(reasons))).alias("reasons"))
    out = out.withColumn("overall_risk", F.greatest(*(F.col(f"{k}_risk") for k in kinds), F.col("source_risk")))
    return out.withColumn("review_required", F.col("overall_risk") >= review_at)


def bias_summary(profiles: DataFrame) -> DataFrame:
    """section, key, n, review_rate, avg_risk over all, each dataset and each bias type, and counts of reasons; one pass over rows."""
    key = lambda section, value: F.struct(F.lit(section).alias("section"), F.coalesce(value, F.lit("none")).alias("key"))
    sections = F.concat(
        F.array(key("overall", F.lit("all")), key("dataset", F.col("dataset")), key("bias_type", F.col("bias_type"))),
        F.transform("reasons", lambda r: F.struct(F.lit("reason").alias("section"), r.alias("key"))),
    )
    rows = profiles.select(F.explode(sections).alias("s"), "overall_risk", "review_required")
    return rows.groupBy("s.section", "s.key").agg(F.count("*").alias("n"), F.avg(F.col("review_required").cast("double")).alias("review_rate"), F.avg("overall_risk").alias("avg_risk"))


SIDES = ("context_support", "claim_support_rate", "numeric_evidence_gap", "date_evidence_gap", "entity_evidence_gap", "entity_alias_gap", "negation_mismatch", "comparative_mismatch", "sentence_max_support", "sentence_mean_support", "low_support_sentence_ratio", "low_support_anchor_ratio", "max_low_support_anchor_gap", "anchored_severity", "local_hallucination_risk")


#: Measures of evidence.measures under the names that single profiles have.
_NAMES = {"low_support_anchor_ratio": "low_support_anchor_sentence_ratio", "anchored_severity": "anchored_hallucination_severity"}


def evidence_profile(df: DataFrame, answer: str = "answer_a", context: str = "context", reference: str | None = None) -> DataFrame:
    """df with the measures of one answer as columns; evidence_risk and sorted reasons after them."""
    rows = evidence.measures(df, {"_m": answer}, context, reference)
    rows = rows.select(*df.columns, *(F.col(f"_m.{_NAMES.get(c, c)}").alias(c) for c in SIDES[:-1]))
    local = F.greatest(*(F.col(c) for c in ("low_support_sentence_ratio", "entity_evidence_gap", "entity_alias_gap", "date_evidence_gap", "numeric_evidence_gap", "negation_mismatch", "comparative_mismatch")))
    rows = rows.withColumn("local_hallucination_risk", local)
    parts = [
        ("low_context_support", (T.normalize(context) != "") & (F.col("context_support") < 0.35), 0.70 * (1 - F.col("context_support"))),
        ("numeric_evidence_gap", F.col("numeric_evidence_gap") > 0, 0.90 * F.col("numeric_evidence_gap")),
        ("date_evidence_gap", F.col("date_evidence_gap") > 0, 0.85 * F.col("date_evidence_gap")),
        ("entity_evidence_gap", F.col("entity_evidence_gap") > 0.45, 0.60 * F.col("entity_evidence_gap")),
        ("entity_alias_gap", F.col("entity_alias_gap") > 0.45, 0.60 * F.col("entity_alias_gap")),
        ("negation_mismatch", F.col("negation_mismatch") > 0, 0.85 * F.col("negation_mismatch")),
        ("comparative_mismatch", F.col("comparative_mismatch") > 0, 0.65 * F.col("comparative_mismatch")),
        ("low_support_sentence_ratio", F.col("low_support_sentence_ratio") > 0.35, 0.70 * F.col("low_support_sentence_ratio")),
        ("low_support_anchor_ratio", F.col("low_support_anchor_ratio") > 0, F.lit(0.0)),
        ("max_low_support_anchor_gap", F.col("max_low_support_anchor_gap") > 0, F.lit(0.0)),
        ("anchored_severity", F.col("anchored_severity") > 0, F.lit(0.0)),
        ("local_hallucination_risk", F.col("local_hallucination_risk") > 0.45, 0.75 * F.col("local_hallucination_risk")),
    ]
    risk = F.greatest(F.lit(0.0), *(F.when(ok, weight).otherwise(0.0) for _, ok, weight in parts))
    return rows.withColumn("evidence_risk", F.least(F.lit(1.0), risk)).withColumn("reasons", F.array_sort(F.array_compact(F.array(*(F.when(ok, name) for name, ok, _ in parts)))))


def pairwise_contradiction(label: Column, support_a: Column, support_b: Column) -> Column:
    """How far a label contradicts the support of two answers (1 or 0.5, else 0), and why: struct of contradiction and reason."""
    margin = support_a - support_b
    against = ((label == "A>B") & (margin < -0.05)) | ((label == "B>A") & (margin > 0.05))
    uneven = (label == "Tie") & (F.abs(margin) > 0.35)
    return F.struct(
        F.when(against, 1.0).when(uneven, 0.5).otherwise(0.0).alias("contradiction"),
        F.when(against, "pairwise_support_contradiction").when(uneven, "pairwise_support_tie_imbalance").alias("reason"),
    )


def evidence_summary(profiles: DataFrame) -> DataFrame:
    """section, key, n, supported_rate, review_rate, avg_evidence_risk and avg_claim_support: all profiles, by dataset, form, label, and for each reason.

    profiles has dataset, form, label, claim_support_rate, evidence_risk, review_required and reasons.
    supported_rate is the share of supported among factuality labels, null without one. One pass over the rows.
    """
    one = lambda section, key: F.struct(F.lit(section).alias("section"), F.coalesce(key.cast("string"), F.lit("none")).alias("key"))
    fixed = F.array(one("overall", F.lit("all")), *(one(c, F.col(c)) for c in ("dataset", "form", "label")))
    rows = profiles.select(F.explode(F.concat(fixed, F.transform("reasons", lambda r: one("reason", r)))).alias("s"), "label", "claim_support_rate", "evidence_risk", "review_required")
    factual = F.col("label").isin("supported", "unsupported", "ambiguous")
    return rows.groupBy("s.section", "s.key").agg(
        F.count("*").alias("n"),
        F.try_divide(F.sum((F.col("label") == "supported").cast("double")), F.sum(factual.cast("int"))).alias("supported_rate"),
        F.avg(F.col("review_required").cast("double")).alias("review_rate"),
        F.avg("evidence_risk").alias("avg_evidence_risk"),
        F.avg("claim_support_rate").alias("avg_claim_support"),
    )


def pairwise_features(df: DataFrame) -> DataFrame:
    """id and numeric features of two answers against prompt and context."""
    a, b, p, c = (T.word_set(x) for x in ("answer_a", "answer_b", "prompt", "context"))
    la, lb = F.length(T.normalize("answer_a")), F.length(T.normalize("answer_b"))
    return df.select(
        "id",
        la.alias("len_a"),
        lb.alias("len_b"),
        (la - lb).alias("len_diff"),
        F.coalesce(F.try_divide(la.cast("double"), lb), F.lit(0.0)).alias("len_ratio"),
        T.sentence_count("answer_a").alias("sentences_a"),
        T.sentence_count("answer_b").alias("sentences_b"),
        T.number_count("answer_a").alias("numbers_a"),
        T.number_count("answer_b").alias("numbers_b"),
        T.jaccard(a, b).alias("overlap_ab"),
        T.jaccard(a, p).alias("overlap_a_prompt"),
        T.jaccard(b, p).alias("overlap_b_prompt"),
        T.jaccard(a, c).alias("overlap_a_context"),
        T.jaccard(b, c).alias("overlap_b_context"),
    )
