"""Positional inverted index: phrases, covers and weighted fields without reading a text, kept up to date by segments.

A row of the index is (id, field, term, tf, n_terms, places): the places of a term in one field of one document, in rising
order; ``n_terms`` is the length of the field. Rows come from a scan of texts for a few wanted terms (``places``), or from
a stored index (``current``), and every search below takes either.

A stored index is a folder of segments. A batch of changes writes one segment with the rows of its documents and the list of
their ids; an id on that list hides its rows in all earlier segments, so inserts, updates and deletes are the same.
Searches merge the segments as they read; ``compact`` writes what is current as a new first segment. A segment counts
once its line in the log is written, and a batch that is replayed writes its own segment again.

Cases: null texts have no terms; a null id is an id like any other in a scan and cannot be hidden in a stored index; of rows of one id in
one batch of changes the last by ``order`` counts, without it they must be one; phrases and queries without terms find
nothing; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions.text import TERM_GAP
from docloom.operators.retrieval import dealt

#: Segment numbers between two batches of a stream, so that a compaction fits in between.
STEP = 1000


def _split(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), TERM_GAP), lambda x: x != "")


def places(docs: DataFrame, fields: Mapping[str, str], id_name: str = "doc_id", wanted: DataFrame | None = None) -> DataFrame:
    """(id, field, term, tf, n_terms, places) of the columns ``fields`` (name in the index: column).

    With ``wanted`` (term), those of the queries at hand, only these are kept, before anything is shuffled.
    """
    listed = None if wanted is None else sorted(r[0] for r in wanted.select("term").distinct().collect())
    texts = dealt(docs.select(F.col(id_name).alias("id"), *fields.values()))
    split = texts.select("id", F.explode(F.array(*[F.struct(F.lit(name).alias("field"), _split(F.col(c)).alias("words")) for name, c in fields.items()])).alias("x"))
    numbered = F.transform("x.words", lambda w, i: F.struct(w.alias("term"), i.alias("place")))
    held = numbered if listed is None else F.filter(numbered, lambda e: e["term"].isin(listed))
    # the outer form, as Spark guards the other with filters that split the text again
    rows = split.select("id", "x.field", F.size("x.words").alias("n_terms"), F.explode_outer(held).alias("e")).where("e.term is not null")
    grouped = rows.groupBy("id", "field", "n_terms", F.col("e.term").alias("term")).agg(F.sort_array(F.collect_list("e.place")).alias("places"))
    return grouped.select("id", "field", "term", F.size("places").cast("long").alias("tf"), F.col("n_terms").cast("long").alias("n_terms"), "places")


def phrase_terms(queries: DataFrame) -> DataFrame:
    """(query_id, at, term, n) of the words of (query_id, q), in order, none left out."""
    words = queries.select("query_id", _split(F.col("q")).alias("words"))
    return words.select("query_id", F.size("words").alias("n"), F.posexplode("words").alias("at", "term"))


def phrase_counts(rows: DataFrame, phrases: DataFrame) -> DataFrame:
    """(query_id, id, field, n_phrases): how often the words of a query stand in a row.

    The places of the rarest word in a field are the first candidates; each other word keeps those it confirms.
    """
    met = rows.join(F.broadcast(phrases), "term")  # the words of the queries at hand
    word = F.struct(F.size("places").alias("size"), "at", "places")
    grouped = met.groupBy("query_id", "id", "field", "n").agg(F.array_sort(F.collect_list(word)).alias("words")).where("size(words) = n")
    starts = lambda e: F.transform(e["places"], lambda p: p - e["at"])
    found = F.aggregate(F.slice("words", F.lit(2), F.size("words")), starts(F.col("words")[0]), lambda held, e: F.array_intersect(held, starts(e)))
    return grouped.select("query_id", "id", "field", F.size(found).cast("long").alias("n_phrases")).where("n_phrases > 0")


def _covers(batches):
    """Worker: score of each (query, document) from the places of all of its terms."""
    import numpy as np
    import pyarrow as pa

    for rows in batches:
        scores = []
        for terms in rows["terms"].to_pylist():
            at = np.concatenate([np.asarray(p, np.int64) for p in terms])
            order = np.argsort(at, kind="stable")
            which, at = np.repeat(np.arange(len(terms)), [len(p) for p in terms])[order], at[order]
            last = np.stack([np.maximum.accumulate(np.where(which == t, at, -1)) for t in range(len(terms))])
            low = last.min(axis=0)  # where the shortest span that ends here and holds all terms begins
            begins, ends = np.unique(low, return_index=True)
            spans = at[ends[begins >= 0]] - begins[begins >= 0] + 1
            scores.append(float((1.0 / spans).sum()))
        yield pa.RecordBatch.from_arrays([rows["query_id"], rows["id"], pa.array(scores, pa.float64())], ["query_id", "id", "score"])


def cover_density(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(query_id, id, score): sum of 1 / length over the least spans of a field that hold all of a query's terms."""
    sizes = wanted.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    met = rows.join(F.broadcast(wanted.join(sizes, "query_id")), "term")  # the terms of the queries at hand
    grouped = met.groupBy("query_id", "id", "field", "n").agg(F.collect_list("places").alias("terms")).where("size(terms) = n")
    kinds = {c: grouped.schema[c].dataType.simpleString() for c in ("query_id", "id")}
    scored = grouped.select("query_id", "id", "terms").mapInArrow(_covers, f"query_id {kinds['query_id']}, id {kinds['id']}, score double")
    return scored.groupBy("query_id", "id").agg(F.sum("score").alias("score"))


def weighted_scores(rows: DataFrame, wanted: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """(query_id, id, n_hit, score): sum of weight of the field * (1 + ln tf) over a query's terms; ``n_hit`` terms stand somewhere."""
    weight = F.coalesce(*[F.when(F.col("field") == name, F.lit(float(w))) for name, w in weights.items()], F.lit(0.0))
    met = rows.join(F.broadcast(wanted), "term")  # the terms of the queries at hand
    return met.groupBy("query_id", "id").agg(F.count_distinct("term").alias("n_hit"), F.sum(weight * (1 + F.log("tf"))).alias("score"))


# stored and kept up to date --------------------------------------------------------------------------------------------------


def _part(term: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(parts)).cast("int")


def _write(rows: DataFrame, ids: DataFrame, path: str, segment: int, base: bool, parts: int) -> None:
    spark = rows.sparkSession
    salt = F.pmod(F.xxhash64("id"), F.lit(8))  # a very common term's folder is written by several tasks
    dealt_out = rows.withColumn("part", _part(F.col("term"), parts)).repartition("part", salt).sortWithinPartitions("part", "term")
    lists = dealt_out.write.mode("overwrite").partitionBy("part")
    lists = lists.option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary#places.list.element", "false")  # rising places are stored as steps
    lists.parquet(f"{path}/rows/segment={segment}")
    ids.write.mode("overwrite").parquet(f"{path}/ids/segment={segment}")
    spark.createDataFrame([(base, parts)], "base boolean, parts int").coalesce(1).write.mode("overwrite").parquet(f"{path}/log/segment={segment}")


def _log(spark: SparkSession, path: str) -> tuple[list[int], int]:
    """(segments that count, the first of them the latest base; parts): one line a batch since the last compaction."""
    lines = sorted((r["segment"], r["base"], r["parts"]) for r in spark.read.parquet(f"{path}/log").collect())
    base = max((n for n, is_base, _ in lines if is_base), default=lines[0][0])
    return [n for n, _, _ in lines if n >= base], lines[-1][2]


def apply_changes(changes: DataFrame, path: str, fields: Mapping[str, str], segment: int, id_name: str = "doc_id", deleted: str | None = None, order: str | None = None, parts: int = 64) -> None:
    """Write one segment: the documents of ``changes`` as they are now; those with a true ``deleted`` are gone."""
    rows = changes.where(F.col(id_name).isNotNull())
    if order is not None:
        latest = Window.partitionBy(id_name).orderBy(F.desc(order))
        rows = rows.withColumn("__n", F.row_number().over(latest)).where("__n = 1").drop("__n")
    held = rows if deleted is None else rows.where(~F.coalesce(F.col(deleted), F.lit(False)))
    _write(places(held, fields, id_name), rows.select(F.col(id_name).alias("id")), path, segment, False, parts)


def current(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """Rows of a stored index as of its last segment; with ``wanted`` (term), only the folders of these terms are read."""
    segments, parts = _log(spark, path)
    rows = spark.read.option("basePath", f"{path}/rows").parquet(*[f"{path}/rows/segment={n}" for n in segments])
    if wanted is not None:
        listed = [(r["term"], r["part"]) for r in wanted.select("term", _part(F.col("term"), parts).alias("part")).distinct().collect()]
        rows = rows.where(F.col("part").isin(sorted({p for _, p in listed})) & F.col("term").isin(sorted(t for t, _ in listed)))
    if len(segments) > 1:
        later = spark.read.option("basePath", f"{path}/ids").parquet(*[f"{path}/ids/segment={n}" for n in segments[1:]])
        hidden = later.groupBy(F.col("id").alias("changed")).agg(F.max("segment").alias("since"))
        rows = rows.join(hidden.hint("merge"), (F.col("id") == F.col("changed")) & (F.col("segment") < F.col("since")), "left_anti")
    return rows.select("id", "field", "term", "tf", "n_terms", "places")


def compact(spark: SparkSession, path: str) -> int:
    """Write what is current as one segment, which hides the earlier ones from then on; its number."""
    segments, parts = _log(spark, path)
    now = segments[-1] + 1
    ids = spark.createDataFrame([], spark.read.parquet(f"{path}/ids/segment={segments[-1]}").schema)  # nothing stands before a base
    _write(current(spark, path), ids, path, now, True, parts)
    return now


def follow(changes: DataFrame, path: str, fields: Mapping[str, str], checkpoint: str, **options):
    """Keep an index up to date from a stream of changed documents, one segment a micro-batch; a batch that runs twice writes the same segment."""

    def each(batch: DataFrame, number: int) -> None:
        apply_changes(batch, path, fields, (number + 1) * STEP, **options)

    return changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
