"""Audit of nested JSON: every value with its path and type, whatever the depth, as variants opened level by level."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import stored


def _type(schema: Column) -> Column:
    name = F.regexp_extract(schema, r"^[A-Z_]+", 0)
    out = F.when(schema.rlike(r"^(BIGINT|DECIMAL\(\d+,0\))"), "integer").when(name.isin("DECIMAL", "DOUBLE", "FLOAT"), "number")
    return out.when(name == "VOID", "null").otherwise(F.lower(name))


def json_values(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """keep, path, shape, type, value of every value in the JSON texts of a column, objects and arrays included.

    path is $ for the whole, with .key and [index] for what lies in it; shape has [*] for every index. type is object, array,
    string, integer, number, boolean or null; malformed for a text that is no JSON or repeats a key in an object, missing for a null
    text (both at $). value is the text of a string or another plain value. A level of the nesting is one stored table, so the
    number of passes is the depth of the data; each pass reads only objects and arrays of the one before. keep must not hold
    path, shape, type or value; other columns are ignored, whatever their names. An empty table gives none.
    """
    source = F.col(f"`{column}`").cast("string")
    whole = df.select(*(F.col(f"`{c}`") for c in keep), source.isNull().alias("_missing"), F.try_parse_json(source).alias("_v"))
    lost = whole.where("_v is null").select(*(F.col(f"`{c}`") for c in keep), F.lit("$").alias("path"), F.lit("$").alias("shape"), F.when(F.col("_missing"), "missing").otherwise("malformed").alias("type"), F.lit(None).cast("string").alias("value"))
    level = whole.where("_v is not null").drop("_missing").withColumns({"path": F.lit("$"), "shape": F.lit("$")})
    levels = [lost]
    while True:
        level = stored(level.withColumn("type", _type(F.schema_of_variant("_v"))), "json")
        plain = ~F.col("type").isin("object", "array", "null")
        value = F.when(plain, F.try_variant_get(F.when(plain, F.col("_v")), "$", "string"))
        levels.append(level.select(*(F.col(f"`{c}`") for c in keep), "path", "shape", "type", value.alias("value")))
        nested = level.where(F.col("type").isin("object", "array"))
        if nested.isEmpty():
            return reduce(DataFrame.unionByName, levels)
        inside = nested.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("_v").outer()))
        step = lambda index: F.when(F.col("key").isNotNull(), F.concat(F.lit("."), F.col("key"))).otherwise(F.concat(F.lit("["), index, F.lit("]")))
        level = inside.select(
            *(nested[c] for c in keep),
            F.concat("path", step(F.col("pos").cast("string"))).alias("path"),
            F.concat("shape", step(F.lit("*"))).alias("shape"),
            F.col("value").alias("_v"),
        )


def json_paths(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """by, shape, type, n, n_blank (strings that are empty or white space only): how often each shape holds each type."""
    rows = json_values(df, column, by)
    blank = (F.col("type") == "string") & (T.normalize("value") == "")
    return rows.groupBy(*by, "shape", "type").agg(F.count("*").alias("n"), F.sum(F.coalesce(blank, F.lit(False)).cast("long")).alias("n_blank"))


def blank_paths(df: DataFrame, column: str, key: str) -> DataFrame:
    """key, paths: the paths of blank strings, in order of the text of the path, for rows that have any."""
    rows = json_values(df, column, [key]).where("type = 'string'").where(T.normalize("value") == "")
    return rows.groupBy(key).agg(F.array_sort(F.collect_list("path")).alias("paths"))
