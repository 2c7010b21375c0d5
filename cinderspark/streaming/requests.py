"""Scoring of requests as they come."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def read_requests(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1000) -> DataFrame:
    """Stream of request files (JSON lines) that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def score_stream(
    requests: DataFrame, score: Callable[[DataFrame], DataFrame], output: str, checkpoint: str, once: bool = True
) -> StreamingQuery:
    """Score every micro-batch and add it to the output table.

    A batch overwrites its own folder, so one that is run again after a failure does not double its rows.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{output}/batch={batch_id}")

    writer = requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
