"""Sharding by weighted rendezvous hashing of stable record keys.

Every shard draws a pseudo-random score from (key, shard); the record goes to
the shard of the best score, -weight / ln(u). A key's scores for the shards
that stay never change, so one more shard takes rows only into itself, and a
heavier shard takes a share in proportion to its weight.

Only DataFrame functions are used: the scores are code-generated per row, and
the only shuffle carries keys and sizes, never texts.

Cases: a null key hashes like any other value; null and empty texts have the
size of the fixed overhead and CRC 0; repeated rows go to the same shard with
slots of their own; a text of any length counts whole; an empty table gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts of a shard that are numbered on their own, then offset; bounds the offset table.
PARTS = 512


def _score(key: Column, shard: int, weight: float) -> Column:
    """Score of one shard: larger is better; u is uniform on (0, 1) with 53 bits."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double")
    return F.lit(float(weight)) / -F.log((bits + 0.5) / F.lit(2.0**53))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Shard number of a key; ties go to the lower number. A weight of 0 gets nothing."""
    if not any(w > 0 for w in weights) or any(w < 0 or math.isinf(w) for w in weights):
        raise ValueError("weights must be finite, at least 0 and not all 0")
    options = [F.struct(_score(key, i, w).alias("s"), F.lit(-i).alias("i")) for i, w in enumerate(weights) if w > 0]
    best = options[0] if len(options) == 1 else F.greatest(*options)
    return (-best["i"]).cast("int")


def gapless_slots(df: DataFrame, shard: str, key: str, order: Sequence[str], parts: int = PARTS, name: str = "slot") -> DataFrame:
    """Number the rows of each shard from 0 without gaps and without one task per shard.

    Rows of a shard are dealt over ``parts`` by their ordering columns and
    numbered there; the parts' sizes (at most shards x parts rows, so safe to
    broadcast) give each part's offset.
    """
    part = "__part"
    dealt = df.withColumn(part, F.pmod(F.xxhash64(*[F.col(c) for c in dict.fromkeys([key, *order])]), F.lit(parts)).cast("int"))
    counts = dealt.groupBy(shard, part).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(shard).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(shard, part, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy(shard, part).orderBy(*[F.col(c).asc_nulls_first() for c in dict.fromkeys([key, *order])])
    numbered = dealt.withColumn("__row", F.row_number().over(within))
    joined = numbered.join(F.broadcast(offsets), [shard, part])
    return joined.withColumn(name, (F.col("__before") + F.col("__row") - 1).cast("long")).drop(part, "__n", "__before", "__row")


def shard_documents(df: DataFrame, weights: Sequence[float], key: str = "doc_id", text: str = "text", overhead: int = 16, grown_weight: float = 1.0) -> DataFrame:
    """One row per record: key, size, text_crc32, law, shard, slot, grown_shard."""
    lean = df.select(
        F.col(key),
        (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(F.col(key), list(weights)).alias("shard"),
        rendezvous(F.col(key), [*weights, grown_weight]).alias("grown_shard"),
    )
    slotted = gapless_slots(lean, "shard", key, ["text_crc32", "size"])
    return slotted.select(key, "size", "text_crc32", "law", "shard", "slot", "grown_shard")
