"""Incremental ingest with Structured Streaming: new files only, each content once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.sidecars import SCHEMA


def record_stream(spark: SparkSession, root: str) -> DataFrame:
    """Records as they appear below a folder."""
    return spark.readStream.schema(SCHEMA).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(root)


def new_content(records: DataFrame) -> DataFrame:
    """The first record of each content hash, over all runs of one checkpoint."""
    return records.filter("hash_content IS NOT NULL").dropDuplicates(["hash_content"])


def ingest(spark: SparkSession, root: str, out: str, checkpoint: str) -> StreamingQuery:
    """One run over what is new; the checkpoint remembers files and hashes."""
    stream = new_content(record_stream(spark, root))
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_batches(stream: DataFrame, merge, checkpoint: str) -> StreamingQuery:
    """``merge(batch, batch_id)`` for each micro-batch, for sinks that replace rows by key."""
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
