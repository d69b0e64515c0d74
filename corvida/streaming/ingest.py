"""Streaming ingest, an extension: new text files of a folder become chunks of a store, micro-batch by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvida.functions import text as T
from corvida.operators.ingest import ingest_rows
from corvida.operators.store import ChunkStore


def ingest_stream(spark: SparkSession, folder: str, store: ChunkStore, embed: Callable[[list[str]], list], checkpoint: str) -> StreamingQuery:
    """Runs once over what is new. A batch replaces its files' rows in one step, so a repeated batch changes nothing."""
    files = spark.readStream.format("text").option("wholetext", True).load(folder)
    parsed = files.select(T.basename(F.col("_metadata.file_path")).alias("filename"), F.lit(0).alias("part_index"), F.col("value").alias("text"))

    def write(batch: DataFrame, _: int) -> None:
        names = [r[0] for r in batch.select("filename").distinct().collect()]  # the new files of one micro-batch
        if names:
            store.put(names, ingest_rows(batch, embed))

    return parsed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
