"""Structured Streaming forms of the time-shaped behaviour (extensions)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, ts: str, late: str) -> DataFrame:
    """A stream with its watermark (on an instant, as watermarks need); a table as it is."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late) if events.isStreaming else events


def windowed_counts(events: DataFrame, ts: str = "ts", kind: str = "event_type", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by tumbling window and kind; works on a stream (append or update mode) and on a table."""
    source = _timed(events, ts, late)
    counted = source.groupBy(F.window(ts, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), kind, "n")


def sessions(events: DataFrame, key: str = "user_id", ts: str = "ts", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of a key's events with no pause of ``gap`` or more."""
    source = _timed(events, ts, late)
    counted = source.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("last_ts"))
    return counted.select(key, F.col("w.start").alias("session_start"), "last_ts", "n")


def first_in_ttl(requests: DataFrame, key: str, ts: str = "ts", ttl: str = "5 minutes") -> DataFrame:
    """The first request of a key within the time to live, for streams: a cache in front of a costly step."""
    return _timed(requests, ts, ttl).dropDuplicatesWithinWatermark([key])


def append_log(stream: DataFrame, path: str, checkpoint: str):
    """Append-only log sink; exactly once through the checkpoint."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def computed_requests(requests: DataFrame, keys: list[str], ts: str, seconds: int) -> DataFrame:
    """Requests that a cache of this time to live would have to compute: each restarts the clock of its key.

    Which ones they are depends on the one before, so rows go through in order of
    time, with one remembered instant; no task holds the rows of a key in memory.
    Keys are compared by a digest that Spark makes, so nulls equal each other and
    numbers of any size stay whole; requests without a time are dropped. ``streaming.stateful.cache_misses`` is
    the form for streams.
    """
    digest = F.sha2(F.to_json(F.struct(*[F.col(k).cast("string").alias(f"k{i}") for i, k in enumerate(keys)]), {"ignoreNullFields": "false"}), 256)
    lean = requests.where(F.col(ts).isNotNull()).select(*keys, ts, digest.alias("__key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("__us"))
    dealt = lean.repartition("__key").sortWithinPartitions("__key", "__us")

    def run(batches):
        import pyarrow as pa

        held, until = None, 0
        for rows in batches:
            stay = []
            for key, at in zip(rows["__key"].to_pylist(), rows["__us"].to_pylist(), strict=True):
                fresh = key != held or at >= until
                if fresh:
                    held, until = key, at + seconds * 1_000_000
                stay.append(fresh)
            yield rows.filter(pa.array(stay, pa.bool_()))

    return dealt.mapInArrow(run, dealt.schema).drop("__key", "__us")
