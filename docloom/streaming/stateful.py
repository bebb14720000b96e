"""Streams with state of their own: a cache with a time to live, and a queue of open questions.

Both are one processor per key on the session's state store (RocksDB; ``prepare`` chooses it), so state survives a
restart from the checkpoint and rows of any number of batches give what one batch over all of them gives.

Rows of a key are taken in order of time inside a micro-batch, and micro-batches in the order in which they come. State that no later row
can need is dropped by event-time timers: a cache entry when it has run out, a finished queue when it has been
idle for a while.

Cases: a null in a key is a key of its own; rows without a time are dropped, as no order is known for them; rows that come later than the
watermark allows are taken like others while their key's state stands; of rows of one time, the one with the
smaller tie-breaker comes first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepare(spark: SparkSession) -> None:
    """Choose the state store that stateful processors need; streams that are running keep theirs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _inner(columns: Sequence[str]) -> list[str]:
    """Names of the caller's columns inside a processor, which must be plain and clash with nothing."""
    return [f"c{i}" for i in range(len(columns))]


def _keyed(rows: DataFrame, keys: Sequence[str], late: str):
    """The stream grouped by one text of all keys: nulls and large numbers keep apart, whatever their types."""
    text = F.to_json(F.struct(*[F.col(k).cast("string").alias(k) for k in keys]), {"ignoreNullFields": "false"})
    return rows.withWatermark("at", late).withColumn("key", text).withColumn("us", F.unix_micros("at")).groupBy("key")


def _cache(ttl_us: int, names: list[str]):
    class Cache(StatefulProcessor):
        """Remembers until when the last computed answer of a key holds."""

        def init(self, handle) -> None:
            self.handle = handle
            self.until = handle.getValueState("until", "us long")

        def handleInputRows(self, key, rows, timerValues):
            held = self.until.get()
            before = until = held[0] if held is not None else None
            fresh = []
            for row in sorted(rows, key=lambda r: r["us"]):
                if until is None or row["us"] >= until:
                    until = row["us"] + ttl_us
                    fresh.append(Row(*names)(*(row[n] for n in names)))
            if until != before:
                self.until.update((until,))
                for timer in self.handle.listTimers():
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(-(-until // 1000))
            return iter(fresh)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            self.until.clear()
            return iter([])

        def close(self) -> None:
            pass

    return Cache()


def cache_misses(requests: DataFrame, keys: Sequence[str], ts: str, seconds: int, late: str = "10 minutes") -> DataFrame:
    """Stream of the requests that a cache with this time to live has to compute: each restarts the clock of its key."""
    names = _inner([*keys, ts])
    rows = requests.select(*(F.col(c).alias(n) for c, n in zip([*keys, ts], names, strict=True)), F.col(ts).cast("timestamp").alias("at")).where("at is not null")
    schema = T.StructType([rows.schema[n] for n in names])
    return _keyed(rows, names[:-1], late).transformWithState(_cache(seconds * 1_000_000, names), schema, "append", "eventTime").toDF(*keys, ts)


#: What a queue tells after each turn.
QUEUE = ("waiting", "n_handled", "complete", "next_question")


def _queue(names: list[str], idle_ms: int):
    class Queue(StatefulProcessor):
        """The open questions of a key, the oldest first, and how many were answered or skipped."""

        def init(self, handle) -> None:
            self.handle = handle
            self.open = handle.getListState("open", "id long")
            self.handled = handle.getValueState("handled", "n long")

        def handleInputRows(self, key, rows, timerValues):
            batch = sorted(rows, key=lambda r: (r["us"], r["turn"]))
            waiting = [r[0] for r in self.open.get()]
            held = self.handled.get()
            n = held[0] if held is not None else 0
            out = []
            for row in batch:
                if row["asks"]:
                    waiting.append(row["turn"])
                elif waiting:
                    waiting.pop(0)
                    n += 1
                out.append(Row(*names, *QUEUE)(*(row[c] for c in names), len(waiting), n, not waiting, waiting[0] if waiting else None))
            if waiting:
                self.open.put([(i,) for i in waiting])
            else:
                self.open.clear()
            self.handled.update((n,))
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            if not waiting:
                self.handle.registerTimer(batch[-1]["us"] // 1000 + idle_ms)
            return iter(out)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            self.open.clear()
            self.handled.clear()
            return iter([])

        def close(self) -> None:
            pass

    return Queue()


def question_queue(turns: DataFrame, keys: Sequence[str], ts: str, turn: str, asks, late: str = "10 minutes", idle_seconds: int = 86_400) -> DataFrame:
    """Stream of every turn with the queue after it: waiting, n_handled, complete, next_question (the turn that asked it).

    ``asks`` is the condition under which a turn adds a question; any other answers or skips the oldest, or is void. A queue without open questions
    is forgotten, with its count, when the watermark is ``idle_seconds`` past its last turn.
    """
    names = _inner([*keys, turn])
    own = [F.col(c).alias(n) for c, n in zip([*keys, turn], names, strict=True)]
    rows = turns.select(*own, F.coalesce(asks, F.lit(False)).alias("asks"), F.col(turn).cast("long").alias("turn"), F.col(ts).cast("timestamp").alias("at")).where("at is not null and turn is not null")
    more = [T.StructField(c, T.BooleanType() if c == "complete" else T.LongType()) for c in QUEUE]
    schema = T.StructType([*(rows.schema[n] for n in names), *more])
    told = _keyed(rows, names[:-1], late).transformWithState(_queue(names, idle_seconds * 1000), schema, "append", "eventTime")
    return told.toDF(*keys, turn, *QUEUE)
