"""The scoring plan on a file stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskweave.session import work_folder


def score_stream(spark: SparkSession, source: str, schema, transform: Callable[[DataFrame], DataFrame],
                 glob: str = "*.parquet", out: str | None = None, files_per_batch: int = 1000) -> DataFrame:
    """Score all files now in ``source`` as a stream and return the written table.

    The plan is stateless: each micro-batch is the batch plan on some files.
    Progress and output live in the shared folder, so a restarted driver goes on
    where the last committed batch ended and writes every row once.
    """
    folder = out or work_folder(spark, "score-stream")
    stream = (
        spark.readStream.schema(schema).option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", files_per_batch).parquet(source)
    )
    scored = transform(stream)
    query = (
        scored.writeStream.format("parquet").outputMode("append")
        .option("path", f"{folder}/data").option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(scored.schema).parquet(f"{folder}/data")
