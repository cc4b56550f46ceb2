"""A folder that exports are dropped into, as a stream: each file once, its records deduplicated by key.

This adds to what a batch import does; fuzzy matching stays a batch operation over the table that the stream fills.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import fields
from ..functions.text import column, normalize_title
from ..schema import RECORD


def incoming(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Records (JSON lines in the record schema) as they arrive, with the time they were written."""
    names = [f for f in RECORD]
    from pyspark.sql.types import StructField, StructType, TimestampType

    schema = StructType([*names, StructField("arrived", TimestampType())])
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)


def first_seen(records: DataFrame, late: str = "1 day") -> DataFrame:
    """Each key's first record; keys are forgotten once the watermark has passed them, so the state is bounded."""
    keyed = records.withColumn("norm_title", column(normalize_title, F.coalesce("title", F.lit("")))).withColumn("key", fields.record_key(F.col("norm_title"))).drop("norm_title")
    return keyed.withWatermark("arrived", late).dropDuplicatesWithinWatermark(["key"])


def arrivals(records: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Records by source and window of arrival."""
    return records.withWatermark("arrived", late).groupBy(F.window("arrived", window), "source").agg(F.count("*").alias("n"))


def append_to(records: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Runs what has arrived and stops; the checkpoint makes it exactly once."""
    return records.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
