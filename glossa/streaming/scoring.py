"""Scoring texts as they arrive (H7 on a stream).

The reference has no streaming; the only streaming surface is its
single-text prediction, which is stateless.  A file stream of texts is
scored micro-batch by micro-batch with exactly the batch pipeline
(``foreachBatch``), each batch written to its own folder with overwrite, so a
replayed batch (after a failure) replaces its own output: idempotent sink.
``Trigger.AvailableNow`` drains what is there and stops; a long-running
deployment uses a processing-time trigger with the same code.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossa.session import ensure_checkpoint_dir


def text_stream(spark: SparkSession, folder: str, schema: T.StructType, file_glob: str | None = None,
                max_files_per_trigger: int = 100) -> DataFrame:
    """Parquet file stream over a folder (explicit schema; streaming sources never infer).

    ``folder`` may be a table's folder of part files or hold tables as single
    files; ``file_glob`` restricts the stream to matching file names (new
    files that match are picked up by later triggers).
    """
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
    if file_glob:
        reader = reader.option("pathGlobFilter", file_glob)
    return reader.parquet(folder)


def table_stream(spark: SparkSession, folder: str, name: str, schema: T.StructType, **options) -> DataFrame:
    """Stream over the table ``<folder>/<name>.parquet``, be it one file or a folder of part files."""
    path = f"{folder.rstrip('/')}/{name}.parquet"
    files = spark.read.schema(schema).parquet(path).inputFiles()
    if len(files) == 1 and files[0].endswith(f"/{name}.parquet"):  # a stream reads folders: pick the file out of its own
        return text_stream(spark, folder.rstrip("/"), schema, file_glob=f"{name}.parquet", **options)
    return text_stream(spark, path, schema, **options)


def score_stream(stream: DataFrame, score_batch: Callable[[DataFrame], DataFrame], out_path: str | None = None,
                 checkpoint: str | None = None, available_now: bool = True):
    """Run ``score_batch`` on every micro-batch; returns (query, out_path).

    Output and progress live under the shared checkpoint folder unless given.
    """
    spark = stream.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    run = uuid.uuid4().hex
    out_path = out_path or f"{base}/stream-out-{run}"
    checkpoint = checkpoint or f"{base}/stream-ckpt-{run}"

    def each(batch: DataFrame, batch_id: int) -> None:
        scored = score_batch(batch).withColumn("batch_id", F.lit(batch_id))
        scored.write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start(), out_path


def read_scored(spark: SparkSession, out_path: str) -> DataFrame:
    """All micro-batch outputs of a scoring stream."""
    return spark.read.parquet(out_path)
