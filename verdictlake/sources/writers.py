"""Writers: JSON lines, CSV with nested values as JSON, Markdown, splits, partitioned results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for formats without nesting."""
    return df.select(*((F.to_json(c).alias(c) if t.startswith(("struct", "map", "array")) else F.col(c)) for c, t in df.dtypes))


def write_jsonl(df: DataFrame, path: str, limit: int | None = None, sort_keys: bool = False) -> None:
    df = df.select(*sorted(df.columns)) if sort_keys else df
    (df.limit(limit) if limit is not None else df).write.mode("errorifexists").json(path)


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, sep: str = ",") -> None:
    flat(df.select(*columns) if columns else df).write.mode("errorifexists").option("header", True).option("sep", sep).option("escape", '"').csv(path)


def markdown(df: DataFrame, columns: list[str] | None = None) -> str:
    """A small report table as Markdown; rows are fetched one partition at a time."""
    columns = columns or df.columns
    cell = lambda v: "" if v is None else (f"{v:g}" if isinstance(v, float) else str(v)).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    lines += ["| " + " | ".join(cell(r[c]) for c in columns) + " |" for r in flat(df.select(*columns)).toLocalIterator()]
    return "\n".join(lines) + "\n"


def write_results(df: DataFrame, path: str, by: tuple[str, ...] = ("split", "head"), format: str = "parquet") -> None:
    """Results in a folder for each value of the partition columns that df has."""
    df.write.mode("errorifexists").partitionBy(*(c for c in by if c in df.columns)).format(format).save(path)


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    df.write.mode("errorifexists").partitionBy(split).json(path)


def split_index(df: DataFrame, group_key: str = "group_key") -> DataFrame:
    return df.select("id", "split", "task_type", "dataset", group_key)
