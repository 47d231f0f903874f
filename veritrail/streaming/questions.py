"""Streams of questions over a static index; every question is independent, so no state or watermark is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.answering import answer


def answer_stream(questions: DataFrame, chunks: DataFrame, vectors: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Answer each micro-batch of a stream of (qid, message, vec) and add it to the Parquet table at ``path``.

    A batch is written under its own number, so one that is run again replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        answer(batch, chunks, vectors).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return questions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
