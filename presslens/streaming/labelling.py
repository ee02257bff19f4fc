"""Incremental labelling with Structured Streaming.

New article files arriving in a folder are labelled exactly once: the file
source tracks which files were read, ``foreachBatch`` runs the batched model
job (``label_batches``) on each micro-batch and appends the answers, and the
query's checkpoint (in the shared checkpoint folder) makes a restart continue
where it stopped.  ``availableNow`` processes everything present and stops,
which is the batch-resume behaviour of the study's sharded labelling run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from presslens.operators.labelling import label_batches, parse_answers


def stream_labels(spark: SparkSession, source_dir: str, schema: StructType, model: Callable, sink_path: str,
                  checkpoint_location: str, key: str = "orig_index", prompt_col: str = "prompt",
                  max_files_per_trigger: int = 2, batch_size: int = 32, available_now: bool = True):
    """Label every (key, prompt) row of the Parquet files in ``source_dir`` and write
    (key, answer, parsed fields) under ``sink_path`` (one ``epoch=<n>`` folder per micro-batch,
    exactly once).  Returns the finished streaming query."""

    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        # foreachBatch may run an epoch again after a failure: each epoch overwrites its own
        # folder, so a re-run replaces its first attempt instead of adding duplicates
        answers = label_batches(batch, model, key, prompt_col, "answer", batch_size)
        parse_answers(answers).write.mode("overwrite").parquet(f"{sink_path.rstrip('/')}/epoch={epoch_id}")

    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
              .parquet(source_dir))
    writer = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint_location)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    q = writer.start()
    if available_now:
        q.awaitTermination()
    return q
