"""Post-processing of ranked candidates: drop-off filters, dedupe, pinning, caps, merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dropoff_dedupe(df: DataFrame, group: Sequence[str], score: str, exact: str, key: Sequence[Column], tie: str, k: int, floor: float = 0.015, share: float = 0.5) -> DataFrame:
    """Keep rows over an absolute floor and a share of the group's best (exact ones always), then the best of each key, then k."""
    best = F.max(score).over(Window.partitionBy(*group))
    kept = df.withColumn("__best", best).where(F.col(exact) | ((F.col(score) >= floor) & (F.col(score) >= F.col("__best") * share)))
    first = Window.partitionBy(*group, *key).orderBy(F.desc(score), tie)
    kept = kept.withColumn("__n", F.row_number().over(first)).where("__n = 1")
    rank = Window.partitionBy(*group).orderBy(F.desc(score), tie)
    return kept.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).drop("__best", "__n")


def dropoff_min_results(df: DataFrame, group: Sequence[str], score: str, exact: str, key: Sequence[str], tie: str, least: int = 5, drop: float = 4.0, floor: float | None = None) -> DataFrame:
    """Dedupe by key in score order; once ``least`` are kept, prune rows more than ``drop`` below the best, or below ``floor``, unless exact.

    The key is a title (trimmed, in lower case) with what tells namesakes apart,
    such as the year; rows without a title are never duplicates. Scanned in
    falling score, a row that is not exact and fails makes all later ones fail,
    so the count kept before it is its rank among firsts of a key. A pruned row
    does not use up its key: the first exact row of a key none of whose rows
    stayed is kept as well.
    """
    order = [F.desc(score), F.asc(tie)]
    title = F.lower(F.trim(F.coalesce(F.col(key[0]), F.lit(""))))
    same = F.to_json(F.struct(title.alias("title"), *[F.col(k) for k in key[1:]]))
    keyed = df.withColumn("__key", F.when(title == "", F.concat(F.lit("\0"), F.col(tie).cast("string"))).otherwise(same))
    one = Window.partitionBy(*group, "__key").orderBy(*order)
    keyed = keyed.withColumn("__of_key", F.row_number().over(one)).withColumn("__best", F.max(score).over(Window.partitionBy(*group)))
    firsts = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    keyed = keyed.withColumn("__rank", F.sum((F.col("__of_key") == 1).cast("int")).over(firsts))
    near = F.col(score) >= F.col("__best") - drop
    near = near if floor is None else near & (F.col(score) >= floor)
    stays = (F.col("__of_key") == 1) & ((F.col("__rank") <= least) | near | F.col(exact))
    keyed = keyed.withColumn("__stays", stays).withColumn("__held", F.max("__stays").over(Window.partitionBy(*group, "__key")))
    rescue = Window.partitionBy(*group, "__key", exact).orderBy(*order)
    keyed = keyed.withColumn("__exact_n", F.row_number().over(rescue))
    kept = keyed.where(F.col("__stays") | (~F.col("__held") & F.col(exact) & (F.col("__exact_n") == 1)))
    return kept.drop("__key", "__of_key", "__best", "__rank", "__stays", "__held", "__exact_n")


def score_chain(df: DataFrame, group: Sequence[str], scores: Sequence[str], name: str = "score") -> DataFrame:
    """Fallback chain of scorers, decided for each group: the first column with a score in the group; its gaps count 0."""
    counted = df
    for i, s in enumerate(scores):
        counted = counted.withColumn(f"__n_{i}", F.count(s).over(Window.partitionBy(*group)))
    chosen = F.coalesce(*[F.when(F.col(f"__n_{i}") > 0, F.coalesce(F.col(s), F.lit(0.0))) for i, s in enumerate(scores)], F.lit(0.0))
    return counted.withColumn(name, chosen).drop(*[f"__n_{i}" for i in range(len(scores))])


def exact_first(df: DataFrame, group: Sequence[str], score: str, exact: str, tie: str, name: str = "rank") -> DataFrame:
    """Exact rows on top, each part in falling score."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(exact), F.desc(score), tie)))


def pinned_cap(df: DataFrame, group: Sequence[str], pinned: str, order: Sequence[Column], cap: int = 8) -> DataFrame:
    """All pinned rows, and others in order while the total stays within the cap."""
    n = F.sum(F.col(pinned).cast("int")).over(Window.partitionBy(*group))
    at = F.row_number().over(Window.partitionBy(*group, pinned).orderBy(*order))
    return df.withColumn("__n", n).withColumn("__at", at).where(F.col(pinned) | (F.col("__at") <= F.lit(cap) - F.col("__n"))).drop("__n", "__at")


def merge_ranked(lists: Sequence[DataFrame], key: str, score: str) -> DataFrame:
    """Union of result lists with the best row of each key; of equal scores the one of the earliest list."""
    union = lists[0].withColumn("__list", F.lit(0))
    for i, other in enumerate(lists[1:], 1):
        union = union.unionByName(other.withColumn("__list", F.lit(i)))
    best = Window.partitionBy(key).orderBy(F.desc(score), "__list")
    return union.withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n", "__list")
