"""Streams: an addition of this package, made of the same transformations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import dct
from ..sources.pictures import planes


def encode_pictures(spark: SparkSession, path: str, out: str, checkpoint: str, target: int = 100) -> StreamingQuery:
    """Frequency hashes of pictures as they arrive below ``path``, appended to Parquet; ends when all are done."""
    schema = spark.read.format("image").load(path).schema
    pictures = spark.readStream.format("image").schema(schema).option("recursiveFileLookup", "true").load(path)
    hashes = dct.encode(planes(pictures, target)).select("origin", "w", "h", "hash")
    return hashes.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_runs(events: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count and mean of a stream of events (ts, event_type, value) by window and type; later ones are dropped."""
    w = F.window("ts", every)
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(w.alias("window"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")).select(F.col("window.start").alias("start"), "event_type", "n", "mean")


def distinct_pictures(arriving: DataFrame, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """A stream of pictures (ts, w, h, r, g, b, ...) with ``content``, a digest of size and bytes, each content once.

    State holds a content until the watermark, ``late`` behind the newest ``ts``, has passed it by another
    ``late``; a picture that comes again within that time gives no row, also after a restart from the
    checkpoint.  Rows behind the watermark are dropped.  Pictures without size or bytes are none.
    """
    content = F.sha2(F.to_json(F.struct("w", "h", "r", "g", "b")), 256)
    whole = arriving.dropna(subset=["w", "h", "r", "g", "b"]).withColumn("content", content)
    return whole.withWatermark(ts, late).dropDuplicatesWithinWatermark(["content"])
