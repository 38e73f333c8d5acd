"""Streams of files into an index: every micro-batch is one upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessella.plans.index import Index


def upsert_batch(index: Index, files: DataFrame) -> None:
    """Add or replace the files of a batch; of a path that comes twice the latest counts. Other files stay."""
    latest = files.groupBy("rel_path").agg(F.max_by(F.struct("content", "hash", "mtime"), F.struct("mtime", "hash")).alias("f")).select("rel_path", "f.*")
    if index.store.meta():
        manifest = index.store.table("manifest")
        rest = manifest.join(latest.select("rel_path"), "rel_path", "left_anti").select("rel_path", F.lit(None).cast("string").alias("content"), "hash", "mtime")
        index.update(latest.unionByName(rest))
    else:
        index.build(latest)


def ingest(stream: DataFrame, index: Index, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Run ``upsert_batch`` for each micro-batch of a stream of files (rel_path, content, hash, mtime)."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: upsert_batch(index, df))
    return (writer.trigger(availableNow=True) if once else writer).start()
