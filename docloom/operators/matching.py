"""Texts that hold given strings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators import dictionaries

#: Bytes of the shortest string that is looked for.
SHORTEST = 6


def containing(docs: DataFrame, hay: str, needles: DataFrame, needle: str, needle_id: str, doc_id: str = "doc_id", most: int = dictionaries.PHRASES) -> DataFrame:
    """(needle_id, doc_id) of every text that holds a string of at least six bytes, in its case.

    One automaton looks for all strings; where they are more than ``most``, they meet the texts part by part, and nothing of them passes
    through the driver.
    """
    given = needles.where(F.octet_length(needle) >= SHORTEST).select(F.col(needle_id).cast("long").alias("id"), F.col(needle).alias("phrase"))
    lean = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(hay).alias("hay"))
    found = dictionaries.found_in(lean, "doc", "hay", given, edges=None, most=most, any_case=False)
    return found.select(F.col("entry").alias(needle_id), F.col("doc").alias(doc_id))
