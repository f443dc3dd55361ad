"""Incremental ingestion: a landing folder of page lines, each micro-batch of whole reports run
through the batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def ingest(spark: SparkSession, landing: str, schema: str, out: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Appends transform(batch) to the table at `out`; a report is atomic, so no watermark is
    needed. A batch goes to a folder of its number, so a repeated batch replaces itself."""

    def batch(df: DataFrame, number: int) -> None:
        transform(df).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(schema).json(landing)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
