"""Writing new rows into old: upserts, inserts, purges, backfills. A merge is one equi-join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows, and old ones that no new row replaces."""
    return new.unionByName(old.join(new.select(*keys), list(keys), "left_anti"))


def insert_ignore(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old rows, and new ones whose key is free."""
    return old.unionByName(new.join(old.select(*keys), list(keys), "left_anti"))


def conditional_upsert(old: DataFrame, new: DataFrame, key: str, text: str, title: str, growth: float = 1.2, too_long: int = 20_000, long_title: int = 180) -> DataFrame:
    """Merged rows with their action: inserted, updated or untouched.

    An old row takes the new text and title only if the new text is over
    ``growth`` times as long, or the old text or title is overlong.
    """
    o = old.select(F.col(key), F.col(text).alias("__ot"), F.col(title).alias("__oi"), F.lit(True).alias("__o"))
    n = new.select(F.col(key), F.col(text).alias("__nt"), F.col(title).alias("__ni"), F.lit(True).alias("__n"))
    both = o.join(n, key, "full")
    takes = (F.char_length("__nt") > growth * F.char_length(F.coalesce("__ot", F.lit("")))) | (F.char_length("__ot") > too_long) | (F.char_length("__oi") > long_title)
    action = F.when(F.col("__o").isNull(), "inserted").when(F.col("__n").isNotNull() & F.coalesce(takes, F.lit(False)), "updated").otherwise("untouched")
    both = both.withColumn("action", action)
    fresh = F.col("action") != "untouched"
    return both.select(key, F.when(fresh, F.col("__nt")).otherwise(F.col("__ot")).alias(text), F.when(fresh, F.col("__ni")).otherwise(F.col("__oi")).alias(title), "action", fresh.alias("embedding_cleared"))


def is_junk(number: Column, text: Column, most: int = 999) -> Column:
    """A number-like key over the limit, or an empty text."""
    return F.coalesce(F.rlike(number, F.lit(r"^\d+$")) & (number.try_cast("bigint") > most), F.lit(False)) | (F.coalesce(F.trim(text), F.lit("")) == "")


def fill_forward(df: DataFrame, is_header: Column, value: Column, order: Sequence[str], part: Sequence[str], name: str) -> DataFrame:
    """Each row gets the value of the last header row at or before it."""
    from pyspark.sql import Window

    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(F.when(is_header, value), ignorenulls=True).over(w))


def backlink(df: DataFrame, claims: DataFrame, session: str, target: str) -> DataFrame:
    """Rows without a target take the one that claims their session."""
    found = claims.select(F.col(session), F.col(target).alias("__new"))
    return df.join(found, session, "left").withColumn(target, F.coalesce(target, "__new")).drop("__new")


def embed_missing(df: DataFrame, text: str, vector: str, encode, batch: int = 100) -> DataFrame:
    """Fill null vectors by ``encode`` (list of texts -> list of vectors), called in batches inside workers."""
    schema = df.schema

    def run(batches):
        import pandas as pd

        for rows in batches:
            rows = rows.copy()
            empty = [i for i, v in enumerate(rows[vector]) if v is None]
            values = rows[vector].tolist()
            for at in range(0, len(empty), batch):
                some = empty[at : at + batch]
                for i, v in zip(some, encode([rows[text].iloc[i] or "" for i in some]), strict=True):
                    values[i] = v
            rows[vector] = pd.Series(values, index=rows.index, dtype=object)
            yield rows

    return df.mapInPandas(run, schema)
