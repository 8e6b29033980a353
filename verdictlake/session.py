"""Session helpers: a local session with sensible settings, and shipping this package to the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

PACKAGE = os.path.dirname(os.path.abspath(__file__))


def local_session(cores: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster use the session that it gives you."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each Spark context, so that Python functions find it there."""
    context = spark.sparkContext
    if getattr(context, "_verdictlake_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(), "verdictlake.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(PACKAGE):
            for name in sorted(names):
                if name.endswith(".py"):
                    file = os.path.join(folder, name)
                    archive.write(file, os.path.join("verdictlake", os.path.relpath(file, PACKAGE)))
    context.addPyFile(path)
    context._verdictlake_shipped = True


def map_batches(df: DataFrame, function, schema: str) -> DataFrame:
    """df.mapInArrow(function, schema) with this package on the executors."""
    ship_package(df.sparkSession)
    return df.mapInArrow(function, schema)


def new_folder(spark: SparkSession, label: str) -> str:
    """An unused path in the folder of spark.checkpoint.dir; in local mode a folder is chosen where none is set, a cluster has to name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints", "verdictlake")
    return f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the folder of spark.checkpoint.dir: computed once, kept when executors are lost. The owner of the folder removes what is in it."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
