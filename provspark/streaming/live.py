"""An extension: keep the index current from a stream of source files."""

from __future__ import annotations

from pyspark.sql.streaming import StreamingQuery

from ..engine import Engine


def follow(engine: Engine, folder: str, seconds: int = 30) -> StreamingQuery:
    """Sync whenever Markdown files arrive in the folder; identity is (path, hash), so nothing is late."""
    files = engine.spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.md").load(folder)
    return files.select("path").writeStream.foreachBatch(lambda batch, epoch: engine.sync() if not batch.isEmpty() else None).trigger(processingTime=f"{seconds} seconds").start()
