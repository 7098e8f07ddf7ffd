"""Structured Streaming forms: an append-only ledger with the latest attempt per key, and sessions by gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mosaiq.sources.tables import ATTEMPTS


def read_attempts(spark: SparkSession, folder: str) -> DataFrame:
    """New ledger files of a folder as a stream."""
    return spark.readStream.schema(ATTEMPTS).csv(folder, header=True)


def latest_per_key(attempts: DataFrame, keys: tuple[str, ...] = ("variant_id", "replicate"), seq: str = "attempt_seq") -> DataFrame:
    """The latest attempt of each key so far; state is one row a key. Write it in update or complete mode."""
    rest = [c for c in attempts.columns if c not in keys]
    return attempts.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("x"), F.count(F.lit(1)).alias("attempts")).select(*keys, "x.*", "attempts")


def sessions(images: DataFrame, time: str, gap: str = "300 seconds", late: str = "1 hour", *keys: str) -> DataFrame:
    """Sessions of a stream by gaps, complete once the watermark has passed them: start, end, images."""
    own = images.withWatermark(time, late)
    if not keys:  # streams have no session windows over all rows
        own = own.withColumn("_all", F.lit(0))
    out = own.groupBy(*(keys or ("_all",)), F.session_window(time, gap)).agg(F.count(F.lit(1)).alias("images"))
    return out.select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "images")


def to_memory(df: DataFrame, name: str, mode: str, checkpoint: str) -> StreamingQuery:
    return df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def to_parquet(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return df.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
