"""A stream of transcript rows scored as they arrive.

The batch transform runs inside ``foreachBatch``; with the checkpoint a killed job loses nothing but the batch in flight,
and a batch that is run again rewrites its own folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from glossaflow.plans.scoring import error_rates

ROWS = "utterance_id string, tts_system_id string, preprocessing_method string, scenario string, language string, reference string, hypothesis string"


def score_stream(spark: SparkSession, source: str, target: str, checkpoint: str, files_per_batch: int = 1000) -> StreamingQuery:
    """Scores JSON Lines files that land in ``source``; each micro-batch writes ``target/batch=<id>``."""
    rows = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", files_per_batch).json(source)

    def score(batch: DataFrame, batch_id: int) -> None:
        error_rates(batch).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return rows.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
