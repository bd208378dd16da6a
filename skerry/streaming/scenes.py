"""Scenes as a stream: an extension of the batch operators, which work unchanged on unbounded input.

Assessment keeps no state. Structures come from a static table; the match is an aggregation a detection, so a stream takes
the form without it unless structures are few enough to be literals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.operators import assess
from skerry.schemas import Config, Zone


def read(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", **options) -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).options(**options).load(path)


def assessed(detections: DataFrame, zones: list[Zone], config: Config) -> DataFrame:
    """Records of a stream of detections (scene_id, ord, id, day, ...)."""
    return assess.assess(detections, zones, config)


def counts(records: DataFrame, when: str = "ts", every: str = "1 day", late: str = "2 days") -> DataFrame:
    """Classes by event-time window; rows later than the watermark are left out."""
    rows = records.withColumn(when, F.col(when).cast("timestamp")).withWatermark(when, late)
    return rows.groupBy(F.window(when, every), "classification").agg(F.count("*").alias("n"))


def write(records: DataFrame, path: str, checkpoint: str, mode: str = "append", fmt: str = "parquet"):
    """Start a query that takes what is there and ends; the checkpoint makes a restart go on where it stopped."""
    return records.writeStream.format(fmt).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
