"""Scoring rows as they arrive, with a saved or fitted pipeline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def score_stream(rows: DataFrame, pipeline: PipelineModel, sink: str, checkpoint: str, keep: Sequence[str]) -> StreamingQuery:
    """Start a query that scores what the stream ``rows`` holds now, appends the columns ``keep`` to ``sink``, and ends.

    ``checkpoint`` notes which rows were taken and ``sink`` which files belong to finished batches. Started again with
    both, the query goes on after the last finished batch: no row is lost and none is written twice, whenever it ended.
    Stages must work row by row, which all of this library's do but the neighbours beyond their broadcast limit.
    """
    if not rows.isStreaming:
        raise ValueError("rows must be a stream; a plain frame is scored by the pipeline itself")
    scored = pipeline.transform(rows).select(*keep)
    return scored.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(sink)


def score_new_files(
    spark: SparkSession,
    source: str,
    schema: T.StructType | str,
    pipeline: PipelineModel,
    sink: str,
    checkpoint: str,
    keep: Sequence[str],
    fmt: str = "parquet",
    files_at_once: int = 1000,
) -> DataFrame:
    """Score the files of a folder that no call before has scored, and give all scores so far.

    Files are taken ``files_at_once`` in a batch, so that a large backlog is worked off in steps that each are kept.
    """
    rows = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_at_once).load(source)
    score_stream(rows, pipeline, sink, checkpoint, keep).awaitTermination()
    return spark.read.parquet(sink)
