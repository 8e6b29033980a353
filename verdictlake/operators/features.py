"""Feature frames of the two heads: wide columns, named by group so that ablations are column selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import profiles

#: Feature groups by prefix; an ablation drops or keeps whole groups.
GROUPS = ("base", "text", "bias", "evidence", "meta")
#: Words in names of evidence features that belong to a part of them.
EVIDENCE_PARTS = {"overlap": ("support",), "gaps": ("numeric", "date", "entity"), "sentence": ("sentence", "local", "negation", "comparative")}


def base_features(scored: DataFrame, a: str = "score_a", b: str = "score_b") -> list[Column]:
    """Scores of a base judge, their margin, and what label they imply."""
    margin = F.col(a) - F.col(b)
    return [
        F.coalesce(F.col(a), F.lit(0.0)).alias("base_score_a"),
        F.coalesce(F.col(b), F.lit(0.0)).alias("base_score_b"),
        F.coalesce(margin, F.lit(0.0)).alias("base_margin"),
        F.coalesce(F.abs(margin), F.lit(0.0)).alias("base_abs_margin"),
        F.coalesce((margin > 0).cast("double"), F.lit(0.0)).alias("base_prefers_a"),
        F.coalesce((margin < 0).cast("double"), F.lit(0.0)).alias("base_prefers_b"),
        F.coalesce((margin == 0).cast("double"), F.lit(0.0)).alias("base_tie"),
    ]


def one_hot(column: str, values: tuple[str, ...], prefix: str = "meta") -> list[Column]:
    return [F.coalesce((F.col(column) == v).cast("double"), F.lit(0.0)).alias(f"{prefix}_{column}_{v}") for v in values]


def pairwise(df: DataFrame, datasets: tuple[str, ...]) -> DataFrame:
    """id and all features of a pair of answers; df is a sample frame with scores of a base judge. The label is no input."""
    unlabelled = df.withColumn("predicted", F.lit(None).cast("string")).withColumn("_gold", F.lit(None).cast("string"))
    biased = profiles.bias_profile(unlabelled.drop("human_label").withColumnRenamed("_gold", "human_label"))
    text = profiles.pairwise_features(df)
    numbers = [F.col(c).cast("double").alias(f"text_{c}") for c in text.columns if c != "id"]
    bias = [F.col(f"{k}_risk").alias(f"bias_{k}_risk") for k in ("position", "length", "format", "rubric", "source")]
    own = df.select("id", *base_features(df), *one_hot("dataset", datasets))
    return own.join(text.select("id", *numbers), "id").join(biased.select("id", *bias), "id")


def factuality(df: DataFrame, datasets: tuple[str, ...], answer: str = "answer_a") -> DataFrame:
    """id and all features of one answer against its context."""
    e = profiles.evidence_profile(df, answer)
    own, context = T.word_set(answer), T.word_set("context")
    return e.select(
        "id",
        *(F.coalesce(F.col(c), F.lit(0.0)).alias(f"evidence_{c}") for c in profiles.SIDES),
        F.length(T.normalize(answer)).cast("double").alias("text_chars"),
        T.sentence_count(answer).cast("double").alias("text_sentences"),
        T.number_count(answer).cast("double").alias("text_numbers"),
        T.jaccard(own, context).alias("text_overlap"),
        T.coverage(own, context).alias("text_coverage"),
        *one_hot("dataset", datasets),
    )


def without(df: DataFrame, *groups: str) -> DataFrame:
    """A feature frame without the named groups."""
    return df.select(*(c for c in df.columns if c.split("_")[0] not in groups))


def only(df: DataFrame, groups: tuple[str, ...], evidence_parts: tuple[str, ...] | None = None) -> DataFrame:
    """id and the named groups; of evidence features only the named parts, if any are named."""
    words = [w for p in evidence_parts or () for w in EVIDENCE_PARTS[p]]
    keep = [c for c in df.columns if c == "id" or c.split("_")[0] in groups and (not words or not c.startswith("evidence_") or any(w in c for w in words))]
    return df.select(*keep)


def matrix(df: DataFrame, identity: str = "id") -> DataFrame:
    """identity and x, the other columns in order of their names as one array, nulls as 0."""
    columns = sorted(c for c in df.columns if c != identity)
    return df.select(identity, F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns)).alias("x"))


def weighted(df: DataFrame, label: str, source: str, by_label: dict[str, float], by_source: dict[str, float]) -> DataFrame:
    """Adds weight, the product of a label's and a source's factor (1 where there is none)."""

    def factor(column: str, table: dict[str, float]) -> Column:
        out = F.lit(1.0)
        for k, v in table.items():
            out = F.when(F.col(column) == k, float(v)).otherwise(out)
        return out

    return df.withColumn("weight", factor(label, by_label) * factor(source, by_source))


def pair_probabilities(a: Column, b: Column, band: float = 0.5, sharpness: float = 1.0) -> Column:
    """Probabilities of A>B, B>A and Tie from two scores: a logistic of their difference, the band's share to Tie."""
    up, down = 1 / (1 + F.exp(-sharpness * (a - b - band))), 1 / (1 + F.exp(-sharpness * (b - a - band)))
    tie = F.greatest(F.lit(0.0), 1 - up - down)
    total = up + down + tie
    return F.array(up / total, down / total, tie / total)


def margin_label(a: Column, b: Column, margin: float) -> Column:
    return F.when(F.abs(a - b) <= margin, "Tie").when(a > b, "A>B").otherwise("B>A")


