"""Stateful streams over several micro-batches and restarts give what the batch queries give."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from docloom.plans import catalog
from docloom.streaming import events, stateful


def in_pieces(spark, table, order, n, path, build, out, checkpoint):
    """Write a table in n files, one after the other in time; read one a micro-batch, with a restart in the middle."""
    rows = table.orderBy(order).collect()
    step = -(-len(rows) // n)
    for i in range(n):
        if rows[i * step : (i + 1) * step]:
            spark.createDataFrame(rows[i * step : (i + 1) * step], table.schema).coalesce(1).write.mode("append").parquet(path)
        if i in (n // 2, n - 1):  # two runs from one checkpoint
            stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(path)
            query = build(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
            query.awaitTermination()
            assert query.exception() is None
    return spark.read.parquet(out)


@pytest.fixture(scope="module")
def prepared(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    stateful.prepare(spark)
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_cache_over_a_stream(prepared, sf_dir, tmp_path):
    requests = prepared.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_type", "ts").where("user_id % 7 = 0")
    build = lambda s: stateful.cache_misses(s, ["user_id", "event_type"], "ts", 6 * 3600)
    got = in_pieces(prepared, requests, "ts", 3, str(tmp_path / "in"), build, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    key = lambda df: sorted((r.user_id, r.event_type, r.ts) for r in df.collect())
    want = catalog.QUERIES["ttl_first"](prepared, sf_dir).where("user_id % 7 = 0")
    assert key(got) == key(want) and len(key(want)) > 5


def test_queue_over_a_stream(prepared, sf_dir, tmp_path):
    turns = prepared.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role").where("conv_id % 3 = 0")
    turns = turns.withColumn("at", (F.lit(1_700_000_000) + F.col("turn") * 60).cast("timestamp"))
    build = lambda s: stateful.question_queue(s, ["conv_id"], "at", "turn", F.col("role") == "user")
    got = in_pieces(prepared, turns, "turn", 3, str(tmp_path / "in"), build, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    key = lambda df: sorted((r.conv_id, r.turn, r.waiting, r.n_handled, r.complete, r.next_question is None, r.next_question or 0) for r in df.collect())
    want = catalog.QUERIES["gapfill_replay"](prepared, sf_dir).where("conv_id % 3 = 0")
    assert key(got) == key(want) and len(key(want)) > 20


def test_cache_with_null_and_large_keys(prepared, tmp_path):
    big = 9007199254740993
    rows = [(None, 0), (None, 3600), (None, 7199), (None, 7200), (big, 10), (big - 1, 20), (big, 30), (5, 0), (None, None)]
    df = prepared.createDataFrame(rows, "k long, s long").select("k", (F.col("s") + 1_700_000_000).cast("timestamp").alias("ts"))
    want = [(None, 0), (None, 7200), (5, 0), (big - 1, 20), (big, 10)]
    key = lambda d: sorted(((r.k, int(r.ts.timestamp()) - 1_700_000_000) for r in d.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert key(events.computed_requests(df, ["k"], "ts", 7200)) == want
    got = in_pieces(prepared, df.where("ts is not null"), "ts", 2, str(tmp_path / "in"), lambda s: stateful.cache_misses(s, ["k"], "ts", 7200), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    assert key(got) == want
