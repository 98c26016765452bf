"""Incremental ingest: each micro-batch of collected items appends the records that are new.

The stored table is the state. A batch that is replayed after a failure finds its ids stored and writes
nothing, so restarts are safe; progress is kept in the query's own checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fieldnote.operators.worklists import pending_records
from fieldnote.sources.ingest import append_new
from fieldnote.sources.mapping import map_records

RAW = "payload string, collect_query string, collected_at string, arrival bigint"


def ingest_stream(
    items: DataFrame, source: str, path: str, checkpoint: str, salt: str, run_id: str, available_now: bool = True
) -> StreamingQuery:
    """Map and append a stream of payloads (columns of ``RAW``) to the records table at ``path``."""

    def write(batch: DataFrame, _: int) -> None:
        append_new(map_records(batch, source, salt, run_id), path, source)

    writer = items.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def top_up(records: DataFrame, stories: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Records a later pass has not seen: the work a top-up adds, and nothing that was done before."""
    return pending_records(records, stories, exclusions).withColumn("queued", F.lit(True))
