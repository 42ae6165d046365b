"""Append N-Triples files to a snapshot as they arrive (Structured Streaming, exactly once through the file sink)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import ntriples


def ingest(spark: SparkSession, folder: str, snapshot: str, checkpoint: str, scope: int = 0, once: bool = True) -> StreamingQuery:
    """Starts the stream; with ``once`` it ends after the files that are there now.

    Each file has blank nodes of its own. Scope 0 is no load's, so they differ from those of all loads, too.
    """
    lines = spark.readStream.text(folder).select("value", F.col("_metadata.file_path").alias("path"))
    triples = ntriples.parse(lines, ntriples.file_scope(scope, F.col("path"))).select("s", "p", "o", F.col("p.lex").alias("pkey"))
    writer = triples.writeStream.format("parquet").partitionBy("pkey").option("path", snapshot).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
