"""Chunked intake of a growing corpus folder.

Reading a corpus chunk by chunk and appending the results is a file stream with
an available-now trigger: each micro-batch takes some files, the checkpoint
remembers them, and a restarted job neither repeats nor skips a file.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.corpus import CORPUS_SCHEMA

Step = Callable[[DataFrame], DataFrame]


def intake_corpus(spark: SparkSession, source: str, target: str, checkpoint: str, step: Step,
                  files_per_chunk: int = 100) -> None:
    """Append ``step(chunk)`` to the parquet folder ``target`` for all new corpus files.

    ``step`` must be a plan over the rows of the chunk. Each chunk is written to
    its own subfolder, so a repeated batch replaces itself.
    """
    stream = (spark.readStream.schema(CORPUS_SCHEMA).option("sep", "\t").option("header", True)
              .option("mode", "DROPMALFORMED").option("quote", '"').option("escape", '"')
              .option("maxFilesPerTrigger", files_per_chunk).csv(source))

    def append(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{target}/chunk={number}")

    query = (stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
