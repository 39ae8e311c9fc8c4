"""Batches of new files and events, with Structured Streaming.

Each batch of files is parsed like a folder read at once and appended; a batch that is run again after
a failure replaces its own part, so that rows are there once. Windowed counts take late events up to
the watermark. Defined cases: events without a time or kind are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpuswerk.sources import verticals


def file_stream(spark: SparkSession, path: str, files_a_batch: int = 50) -> DataFrame:
    """(path, text) of new files."""
    reader = spark.readStream.option("maxFilesPerTrigger", files_a_batch).option("recursiveFileLookup", "true").option("wholetext", "true").format("text")
    return reader.load(path).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def ingest(files: DataFrame, to: str, checkpoint: str, parse: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Appends the token rows of all files there are, batch by batch, as folders batch=<n> of one table."""
    parse = parse or (lambda f: verticals.tokens(verticals.documents(f)))

    def write(batch: DataFrame, n: int) -> None:
        parse(batch).write.mode("overwrite").parquet(f"{to}/batch={n}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, kind: str, width: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """(start, kind, n) of tumbling or sliding windows; for streams and tables alike."""
    own = events.filter(F.col(time).isNotNull() & F.col(kind).isNotNull()).withWatermark(time, late)
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return own.groupBy(window.alias("w"), F.col(kind).alias("kind")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "kind", "n")


def session_counts(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(key, start, end, n) of sessions that end after a gap."""
    own = events.filter(F.col(time).isNotNull() & F.col(key).isNotNull()).withWatermark(time, late)
    out = own.groupBy(F.session_window(time, gap).alias("w"), F.col(key).alias("key")).agg(F.count("*").alias("n"))
    return out.select("key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
