"""Chunking of files as they arrive.

A file is never split over micro-batches, so the operator keeps no state and a stream gives the
rows of a batch over the same files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from .. import api
from ..options import FAMILIES

BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def chunk_stream(spark: SparkSession, path: str, max_files: int = 1000, **options) -> DataFrame:
    """Chunks of files under ``path`` and of those that come later; at most ``max_files`` a batch."""
    known = "*.{" + ",".join(e for f in api.AVAILABLE for e in FAMILIES[f]) + "}"
    files = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("pathGlobFilter", known).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files).load(path)
    return api.chunk(files, key="path", content="content", name="path", **options)


def write_stream(chunks: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append chunks as Parquet; with ``once``, stop when all files at hand are done."""
    writer = chunks.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start(out)
