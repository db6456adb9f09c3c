"""Incremental ingest and counting with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from palaver.operators.joins import upsert
from palaver.sources import captions


def caption_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Cue rows of files as they come into a folder; the query's checkpoint remembers which were read."""
    files = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_per_batch).load(folder)
    return captions.cues(files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")))


def upsert_sink(read: Callable[[], DataFrame | None], write: Callable[[DataFrame], None], keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: a batch's rows replace the stored rows of its keys."""

    def f(batch: DataFrame, _: int) -> None:
        old = read()
        write(batch if old is None else upsert(old, batch, keys))

    return f


def watch(listings: DataFrame, checkpoint: str, refresh: Callable[[DataFrame], object]) -> StreamingQuery:
    """Call ``refresh`` with each newest listing (ep, stamp, made) of a stream of them (at, ep, stamp, made).

    A listing has all inputs that exist at a time, so that what isn't in it any more is known to be gone, and what changed under its old name is known
    by its stamp. Of several listings that come at once the newest counts; one with no inputs at all has a row whose ep is null. A batch that runs again
    after a failure finds nothing to do if its commit was made.
    """

    def f(batch: DataFrame, _: int) -> None:
        newest = batch.agg(F.max("at")).first()[0]
        if newest is not None:
            refresh(batch.where((F.col("at") == newest) & F.col("ep").isNotNull()).select("ep", "stamp", "made"))

    return listings.writeStream.option("checkpointLocation", checkpoint).foreachBatch(f).trigger(availableNow=True).start()


def minute_counts(requests: DataFrame, limit: int = 30, late: str = "5 minutes") -> DataFrame:
    """(ip, minute, n, allowed) of a stream of (ip, ts); minutes older than the watermark are forgotten."""
    c = requests.withWatermark("ts", late).groupBy("ip", F.window("ts", "1 minute").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return c.select("ip", F.col("w.start").alias("minute"), "n", (F.col("n") <= limit).alias("allowed"))
