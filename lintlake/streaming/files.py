"""Incremental analysis: new rows of a files table run through the batch plan of the rules. An extension; detection itself is a batch job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lintlake.plans.analysis import analyze
from lintlake.sources.files import FILE_SCHEMA


def watch(spark: SparkSession, folder: str, sink: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Analyse parquet files of FILE_SCHEMA as they arrive in ``folder`` and write the issues of each batch below ``sink``.

    A batch that is run again after a failure overwrites its own folder, so every issue is written exactly once.
    """
    stream = spark.readStream.schema(FILE_SCHEMA).parquet(folder)

    def batch(files: DataFrame, number: int) -> None:
        files = files.persist()
        analyze(files).write.mode("overwrite").parquet(f"{sink}/batch={number}")
        files.unpersist()

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (writer.trigger(availableNow=True) if once else writer).start()
