"""Scoring of series that arrive as files, a micro-batch at a time.

A file holds whole ids. Each batch runs the batch plan and appends its predictions; nothing is kept
between batches, so a batch that is repeated after a failure gives the same rows (batch_id marks
them for idempotent readers).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from driftline.operators.features import forget, series_features
from driftline.operators.learning import Stack, infer
from driftline.sources.series import SERIES_SCHEMA


def score_stream(spark: SparkSession, source: str, target: str, checkpoint: str, predict: Callable[[DataFrame], DataFrame], files_per_batch: int = 16) -> StreamingQuery:
    """predict maps raw series (id, time, value, period) to (id, prediction)."""
    arriving = spark.readStream.schema(SERIES_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def each(batch: DataFrame, batch_id: int) -> None:
        predict(batch).withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(target)

    return arriving.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def infer_series(stack: Stack, series: DataFrame, use: Callable[[DataFrame], None], mode: str = "full") -> None:
    """Raw series (id, time, value, period) to predictions: preprocessing, features, base learners, the learner on top.

    use gets (id, prediction) while the tables on the way are there, and has to write or collect it.
    """
    key = uuid.uuid4().hex
    features = series_features(series, key)
    try:
        use(infer(stack, features, mode))
    finally:
        forget(series.sparkSession, key)


def score_series(spark: SparkSession, stack: Stack, source: str, target: str, checkpoint: str, mode: str = "full", files_per_batch: int = 16) -> StreamingQuery:
    """score_stream with a trained stack, from raw series to predictions."""
    arriving = spark.readStream.schema(SERIES_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def each(batch: DataFrame, batch_id: int) -> None:
        infer_series(stack, batch, lambda found: found.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(target), mode)

    return arriving.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
