"""What the corpus operators share: tables, the shared folder, written intermediate tables."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a longest run of characters other than ASCII white space; bytes.split() cuts at the same six.
WORD = r"[^\x20\x09-\x0D]+"

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which the driver and all executors see.

    It is set here only in local mode, where driver and executors are one process.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints", "verdictlake")
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}" if folder.startswith("/") and spark.sparkContext.master.startswith("local") else folder
    return folder.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """An unused path in the shared folder; it is removed when the driver's process ends."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _remove_all() -> None:
    for spark, path in _written:
        try:
            remove(spark, path)
        except Exception:  # the session has ended before: only a folder of the driver's own disk can still be reached
            if path.startswith("file://"):
                shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, survives lost executors, is computed once."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """Actions within send at most so many rows to Python at a time: for rows that are large themselves."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(most, int(before)) if int(before) > 0 else most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def text_bytes(column: str = "text"):
    """The UTF-8 bytes of a text, empty for null: Python gets them without decoding, whatever they hold."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def by_bytes(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``most`` bytes of a column, a row at least; an empty batch gives none."""
    sizes, start, held = pc.binary_length(batch.column(column)).to_pylist(), 0, 0
    for k, n in enumerate(sizes):
        if k > start and held + (n or 0) > most:
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += n or 0
    if start < len(sizes):
        yield batch.slice(start)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names for working columns that df does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def put(uri: str, data: bytes) -> None:
    """Writes a file of any file system that pyarrow knows, whole or not at all: a task that runs twice leaves one file."""
    system, path = pa.fs.FileSystem.from_uri(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    own = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(own) as out:
        out.write(data)
    system.move(own, path)


def get(uri: str) -> bytes:
    system, path = pa.fs.FileSystem.from_uri(uri)
    with system.open_input_stream(path) as stream:
        return stream.read()
