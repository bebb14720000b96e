"""Search with a configuration per query: ``simple`` takes words as they stand, ``english`` drops stop words and matches by stems.

Short queries and those with an abbreviation are searched as they stand, since stop words and stems would
harm them. Both configurations read the same index rows (``operators.inverted``): an english query asks for every term of the vocabulary
that shares a stem with one of its words, and these count as one.

Cases: a null query has no words and finds nothing; a query of stop words alone finds nothing in english; an empty vocabulary, table of abbreviations or
table of queries gives what is left of the rules.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.stemming import stem_table
from docloom.functions.text import STOP_WORDS, TERM_GAP, terms
from docloom.operators.retrieval import term_hits

#: Words up to which a query counts as short (fixed value).
SHORT = 3
#: Bytes of the texts whose hits one task scores.
PART_BYTES = 2 << 20


def with_configuration(queries: DataFrame, abbreviations: DataFrame, short: int = SHORT) -> DataFrame:
    """Adds ``config`` to (query_id, q): simple for at most ``short`` words or any word of ``abbreviations`` (word), whatever its case."""
    words = F.split(F.trim(F.upper(F.coalesce("q", F.lit("")))), r"\s+")
    each = queries.select("query_id", F.explode(words).alias("word"))
    held = each.join(abbreviations.select(F.upper("word").alias("word")).distinct(), "word", "left_semi").select("query_id").distinct().withColumn("__short", F.lit(True))
    simple = (F.size(words) <= short) | F.coalesce("__short", F.lit(False))
    return queries.join(held, "query_id", "left").withColumn("config", F.when(simple, "simple").otherwise("english")).drop("__short")


def vocabulary(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term) of all texts; a stored index gives the same from its own terms."""
    return docs.select(F.explode(F.array_distinct(F.split(F.lower(text), TERM_GAP))).alias("term")).where("term <> ''").distinct()


def wanted_forms(queries: DataFrame, known: DataFrame, stop: Sequence[str] = STOP_WORDS) -> DataFrame:
    """(query_id, term, form) of (query_id, q, config): terms of the vocabulary ``known`` to look up, and the form of the query that each stands for."""
    each = queries.select("query_id", "config", F.explode(F.array_distinct(terms(F.col("q")))).alias("term"))
    simple = each.where("config = 'simple'").select("query_id", "term", F.col("term").alias("form"))
    content = each.where((F.col("config") == "english") & ~F.col("term").isin(list(stop)))
    asked = content.join(stem_table(content), "term").select("query_id", "stem").distinct()
    stems = stem_table(known.where(~F.col("term").isin(list(stop))))
    english = stems.join(F.broadcast(asked), "stem").select("query_id", "term", F.col("stem").alias("form"))  # the stems of the queries at hand
    return simple.unionByName(english)


def form_counts(queries: DataFrame, stop: Sequence[str] = STOP_WORDS) -> DataFrame:
    """(query_id, n_wanted): forms that a query asks for, known or not."""
    each = queries.select("query_id", "config", F.explode(F.array_distinct(terms(F.col("q")))).alias("term")).where((F.col("config") == "simple") | ~F.col("term").isin(list(stop)))
    form = each.join(stem_table(each), "term").select("query_id", F.when(F.col("config") == "simple", F.col("term")).otherwise(F.col("stem")).alias("form"))
    return form.groupBy("query_id").agg(F.count_distinct("form").alias("n_wanted"))


def hits(docs: DataFrame, forms: DataFrame, text: str = "text", id_name: str = "doc_id") -> DataFrame:
    """Rows for ``matches`` from a scan of texts, those of an id in one part.

    A word stands for very many pairs of query and text, so parts grow with the texts, and what a task scores is neither shuffled nor
    more in larger tables.
    """
    n_bytes = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return term_hits(docs, forms, text, id_name, parts=max(1, -(-n_bytes // PART_BYTES)))


def matches(rows: DataFrame, forms: DataFrame) -> DataFrame:
    """(query_id, id, n_hit, score) of index rows (id, term, tf): forms found, and the sum of 1 + ln(tf) over them."""
    met = rows.join(F.broadcast(forms), "term")  # the terms of the queries at hand
    each = met.groupBy("query_id", "id", "form").agg(F.sum("tf").alias("tf"))
    return each.groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("n_hit"), F.sum(1 + F.log("tf")).alias("score"))
