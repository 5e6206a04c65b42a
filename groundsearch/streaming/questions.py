"""Streams of questions: each micro-batch is one batch search against stored tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def answer_stream(
    spark: SparkSession, source: str, schema: str, answer: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, available_now: bool = False, files_per_batch: int = 100,
    file_format: str = "parquet",
) -> StreamingQuery:
    """Read question files as they come, answer each micro-batch, and write its rows to sink.

    A batch's rows go to a folder of its own, which a repeated batch replaces: each question is answered once.
    No state is kept between batches, so there is nothing to expire.
    """
    questions = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(file_format).load(source)

    def one(batch: DataFrame, number: int) -> None:
        answer(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    writer = questions.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")).start()
