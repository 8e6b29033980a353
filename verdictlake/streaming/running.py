"""Structured Streaming extensions: windowed event metrics with late data, running accuracy, resumable scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def file_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _timed(events: DataFrame, late: str) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """event_type counts and mean values in tumbling windows; rows later than the watermark are dropped. For streams and tables."""
    return _timed(events, late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of users: start, end and events."""
    return _timed(events, late).groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def running_accuracy(predictions: DataFrame, by: str = "dataset") -> DataFrame:
    return predictions.groupBy(by).agg(F.count("*").alias("n"), F.avg((F.col("gold") == F.col("predicted")).cast("double")).alias("accuracy"))


def score_stream(samples: DataFrame, score, out: str, checkpoint: str):
    """Scores a stream of samples exactly once: what the checkpoint has seen isn't scored again after a restart.

    score maps a DataFrame to a DataFrame; each batch is appended to out.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        # The folder of a batch is replaced if the batch runs again.
        score(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return samples.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pending(samples: DataFrame, scored: DataFrame, key: str = "id") -> DataFrame:
    """Samples without a valid score: the batch form of resuming."""
    return samples.join(scored.select(key).distinct(), key, "left_anti")


def retry_rounds(samples: DataFrame, scorers: list, folder: str, key: str = "id") -> DataFrame:
    """Scores with each scorer in turn what those before left invalid; scorers return key and valid beside their columns.

    Each round is written to folder, so a scorer runs once for what it is given, however costly or
    random it is.
    """
    spark, done, left = samples.sparkSession, None, samples
    for attempt, scorer in enumerate(scorers):
        scored = scorer(left).withColumn("attempt", F.lit(attempt))
        path = f"{folder.rstrip('/')}/round-{attempt}"
        scored.write.mode("overwrite").parquet(path)
        ok = spark.read.schema(scored.schema).parquet(path).where("valid")
        done = ok if done is None else done.unionByName(ok)
        left = pending(left, ok, key)
    return done
