"""Readers: wrapped and plain JSON, JSON lines, CSV, TSV, Parquet, canonical nested samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..schemas import SAMPLE

#: Keys under which wrapped files keep their rows, in order of preference.
LIST_KEYS = ("samples", "records", "data", "items", "train")
CANONICAL = {"id", "source", "task", "input", "answers", "label", "quality", "metadata"}


def read_any(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """A file or folder by its suffix: .jsonl, .json (a list, or an object with a list of rows), .csv, .tsv, else Parquet."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    low = path.lower().rstrip("/")
    if low.endswith(".jsonl"):
        return reader.json(path)
    if low.endswith(".json"):
        return unwrap(spark.read.option("multiLine", True).json(path))
    if low.endswith((".csv", ".tsv")):
        return reader.option("header", True).option("sep", "\t" if low.endswith(".tsv") else ",").option("multiLine", True).option("escape", '"').csv(path)
    return reader.parquet(path)


def unwrap(df: DataFrame) -> DataFrame:
    """The rows of a wrapped file; a file that isn't wrapped stays as it is."""
    for key in LIST_KEYS:
        if key in df.columns and isinstance(df.schema[key].dataType, ArrayType) and isinstance(df.schema[key].dataType.elementType, StructType):
            return df.select(F.explode(key).alias("_row")).select("_row.*")
    return df


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Flat samples of a dataset file, nested canonical ones flattened."""
    return to_flat(read_any(spark, path))


def is_canonical(df: DataFrame) -> bool:
    return CANONICAL <= set(df.columns) and isinstance(df.schema["task"].dataType, StructType)


def _path(df: DataFrame, path: str) -> Column:
    """A nested field, null where the schema lacks it."""
    kind = df.schema
    for part in path.split("."):
        if not isinstance(kind, StructType) or part not in kind.fieldNames():
            return F.lit(None)
        kind = kind[part].dataType
    return F.col(path)


def _text_map(df: DataFrame, path: str) -> Column:
    c = _path(df, path)
    return F.from_json(F.to_json(c), "map<string,string>") if path.split(".")[0] in df.columns else F.lit(None).cast("map<string,string>")


def to_flat(df: DataFrame) -> DataFrame:
    """The flat sample schema; metadata of nested samples gains source and form where it has no such keys."""
    if not is_canonical(df):
        have = set(df.columns)
        columns = []
        for f in SAMPLE:
            if f.name not in have:
                columns.append(F.lit(None).cast(f.dataType).alias(f.name))
            elif f.dataType.typeName() == "map" and df.schema[f.name].dataType.typeName() != "map":
                columns.append(_text_map(df, f.name).alias(f.name))
            else:
                columns.append(F.col(f.name).cast(f.dataType).alias(f.name))
        return df.select(*columns)
    text = lambda path: _path(df, path).cast("string")
    defaults = F.create_map(F.lit("source_url"), text("source.source_url"), F.lit("source_record_id"), text("source.source_record_id"), F.lit("task_form"), text("task.form"))
    own = F.coalesce(_text_map(df, "metadata"), F.create_map().cast("map<string,string>"))
    metadata = F.map_concat(F.map_filter(defaults, lambda k, v: ~F.map_contains_key(own, k) & v.isNotNull()), own)
    score = text("label.score")
    kind = text("label.type")
    human = F.create_map(F.lit("scoring_system"), kind, F.when(kind == "pairwise", "pairwise_preference").otherwise("label"), text("label.value"), F.lit("score"), score)
    return df.select(
        text("id").alias("id"),
        text("source.dataset").alias("dataset"),
        text("task.type").alias("task_type"),
        text("input.prompt").alias("prompt"),
        text("input.context").alias("context"),
        text("answers.a").alias("answer_a"),
        text("answers.b").alias("answer_b"),
        text("input.reference").alias("reference"),
        human.alias("human_score"),
        text("label.value").alias("human_label"),
        text("task.language").alias("language"),
        text("task.split").alias("split"),
        metadata.alias("metadata"),
    )


def to_canonical(df: DataFrame) -> DataFrame:
    """The nested form of flat samples, with the repairs that were made: empty texts become null with a reason."""
    blank = lambda c: F.when(F.trim(c) != "", F.col(c))
    fields = ("context", "reference", "answer_b")
    missing = F.map_filter(F.create_map(*(x for c in fields for x in (F.lit(c), F.when(F.col(c).isNull(), "absent").when(F.trim(c) == "", "empty")))), lambda k, v: v.isNotNull())
    form = F.when(F.col("human_label").isin("A>B", "B>A", "Tie"), "pairwise").when(blank("answer_b").isNotNull(), "pairwise").otherwise("single_answer")
    repairs = F.array_compact(F.array(*(F.when(F.trim(c) == "", F.lit(f"{c}_empty_to_null")) for c in fields)))
    get = lambda k: F.try_element_at("metadata", F.lit(k))
    return df.select(
        "id",
        F.struct(F.lower("dataset").alias("dataset"), get("source_url").alias("source_url"), get("source_record_id").alias("source_record_id")).alias("source"),
        F.struct(F.col("task_type").alias("type"), form.alias("form"), "language", "split").alias("task"),
        F.struct("prompt", blank("context").alias("context"), blank("reference").alias("reference")).alias("input"),
        F.struct(F.col("answer_a").alias("a"), blank("answer_b").alias("b")).alias("answers"),
        F.struct(F.when(form == "pairwise", "pairwise").otherwise("factuality").alias("type"), F.col("human_label").alias("value"), F.expr("try_cast(human_score['score'] as double)").alias("score")).alias("label"),
        F.struct((F.size(missing) == 0).alias("complete"), missing.alias("missing_reason")).alias("quality"),
        "metadata",
        repairs.alias("repairs"),
    )


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """path, length and sha256 of files, read by Spark."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def line_count(spark: SparkSession, path: str) -> DataFrame:
    """One row: how many lines aren't blank."""
    return spark.read.text(path).where(F.trim("value") != "").agg(F.count("*").alias("lines"))
