"""Indexing recordings as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.engine import Engine
from ..sources.recordings import FILES


def stream_files(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_per_batch).load(folder)


def ingest(engine: Engine, folder: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Index new files batch by batch.  A repeated batch adds nothing: its names are known by then."""

    def add(batch: DataFrame, _: int) -> None:
        engine.index(batch).unpersist()

    writer = stream_files(engine.library.spark, folder).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
