"""Building samples: perturbed variants, swaps, flattening of nested rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StructType

from ..functions import scores as S
from ..functions import text as T

KINDS = ("position", "length", "format", "rubric_sensitivity")


def perturb(df: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """A variant of each sample for each kind, with parent_id and bias_type: answers exchanged, the first padded, bulleted, or the prompt extended."""
    rows = df.withColumn("kind", F.explode(F.array(*(F.lit(k) for k in kinds))))
    is_ = lambda k: F.col("kind") == k
    bullets = F.array_join(F.transform(T.sentences("answer_a"), lambda s: F.concat(F.lit("- "), s)), "\n")
    changed = {
        "answer_a": F.when(is_("position"), F.col("answer_b")).when(is_("length"), F.concat_ws(" ", "answer_a", F.lit("In other words, this holds as stated above."))).when(is_("format"), bullets).otherwise(F.col("answer_a")),
        "answer_b": F.when(is_("position"), F.col("answer_a")).otherwise(F.col("answer_b")),
        "prompt": F.when(is_("rubric_sensitivity"), F.concat_ws(" ", "prompt", F.lit("Judge by correctness alone."))).otherwise(F.col("prompt")),
        "human_label": F.when(is_("position"), S.invert(F.col("human_label"))).otherwise(F.col("human_label")),
    }
    keep = [c for c in df.columns if c not in (*changed, "id", "bias_type", "parent_id")]
    return rows.select(
        F.concat_ws("__", F.col("id").cast("string"), "kind").alias("id"), F.col("id").alias("parent_id"), F.col("kind").alias("bias_type"), *(c.alias(n) for n, c in changed.items() if n in df.columns), *keep
    )


def swap(df: DataFrame) -> DataFrame:
    """Every sample with its answers exchanged and its label inverted."""
    swapped = {"answer_a": F.col("answer_b"), "answer_b": F.col("answer_a"), "human_label": S.invert(F.col("human_label"))}
    return df.select(*(swapped[c].alias(c) if c in swapped else F.col(c) for c in df.columns))


def leaves(schema: StructType, prefix: str = "") -> list[str]:
    """Dotted paths of a nested schema's leaf fields."""
    out = []
    for f in schema:
        path = f"{prefix}{f.name}"
        out += leaves(f.dataType, f"{path}.") if isinstance(f.dataType, StructType) and f.dataType.fields else [path]
    return out


def flatten(df: DataFrame) -> DataFrame:
    """A column for each leaf, named by its path; maps become their JSON text."""
    kinds = dict(_leaf_types(df.schema))
    return df.select(*((F.to_json(p) if isinstance(kinds[p], MapType) else F.col(p)).alias(p.replace(".", "_")) for p in leaves(df.schema)))


def _leaf_types(schema: StructType, prefix: str = ""):
    for f in schema:
        if isinstance(f.dataType, StructType) and f.dataType.fields:
            yield from _leaf_types(f.dataType, f"{prefix}{f.name}.")
        else:
            yield f"{prefix}{f.name}", f.dataType


def first_per_label(df: DataFrame, label: str, ordinal: str, n: int) -> DataFrame:
    from .ranking import top_per_group

    return top_per_group(df, [label], [F.col(ordinal)], n)


def votes_to_label(a: Column, b: Column, arbiter: Column) -> Column:
    """Two annotators, and an arbiter where they differ."""
    return F.when(a == b, a).otherwise(arbiter)
