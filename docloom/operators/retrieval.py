"""Retrieval: vector and lexical legs, fusion, expansion. Queries are rows, never loops."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import STOP_WORDS, TERM_GAP, terms

#: Query vectors that one pass compares; more are handled in further passes.
QUERIES_A_PASS = 4096


def _partial_top(queries: list[tuple], k: int, metric: str):
    """Worker: the k nearest rows of each batch for each query."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        names = [q[0] for q in queries]
        q = np.array([v for _, v in queries], np.float64).reshape(len(queries), -1)
        held: list[tuple] = [(np.zeros(0), np.zeros(0, np.int64))] * len(queries)
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            lists = batch.column("vector")
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
            fit = np.flatnonzero(lengths == q.shape[1])
            if len(fit) == 0 or q.shape[1] == 0:
                continue
            x = np.asarray(lists.take(pa.array(fit)).flatten(), np.float64).reshape(len(fit), -1)
            ids = ids[fit]
            if metric == "cosine":
                norms = np.linalg.norm(x, axis=1)
                fit = norms > 0
                x, ids = x[fit] / norms[fit, None], ids[fit]
                distance = 1 - x @ (q / np.linalg.norm(q, axis=1, keepdims=True)).T
            else:
                distance = np.sqrt(np.maximum(((x[:, None, :] - q[None]) ** 2).sum(axis=2) if len(x) * len(q) < 1 << 20 else (x**2).sum(1)[:, None] - 2 * x @ q.T + (q**2).sum(1)[None], 0))
            for j in range(len(queries)):
                d, i = np.r_[held[j][0], distance[:, j]], np.r_[held[j][1], ids]
                order = np.lexsort((i, np.round(d, 9)))[:k]
                held[j] = d[order], i[order]
        rows = [(names[j], int(i), float(d)) for j in range(len(queries)) for d, i in zip(*held[j], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["query_id", "id", "distance"])

    return run


def knn(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """(query_id, id, distance, rank) of the k nearest vectors of each query, exact.

    vectors (id, vector), queries (query_id, vector). Each task keeps k rows per
    query, so the shuffle carries tasks x queries x k rows whatever the corpus.
    Null vectors and ones of another length are never found.
    """
    given = queries.where(F.col("vector").isNotNull()).select("query_id", "vector").collect()
    lean = vectors.where(F.col("vector").isNotNull()).select(F.col("id").cast("long").alias("id"), "vector")
    passes = [given[i : i + QUERIES_A_PASS] for i in range(0, len(given), QUERIES_A_PASS)] or [[]]
    found = None
    for some in passes:
        part = lean.mapInArrow(_partial_top([(r[0], list(r[1])) for r in some], k, metric), "query_id long, id long, distance double")
        found = part if found is None else found.unionByName(part)
    rank = Window.partitionBy("query_id").orderBy(F.round("distance", 9), "id")
    return found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "id", (F.round("distance", 6) + 0.0).alias("distance"), "rank")


def cells(vectors: DataFrame, n_cells: int, seed: int = 7) -> tuple[DataFrame, list]:
    """Inverted-file index: (id, vector, cell) and the cells' centres, fitted on a bounded sample of 256 x n_cells rows."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    ready = vectors.where(F.col("vector").isNotNull()).withColumn("features", array_to_vector(F.col("vector").cast("array<double>")))
    sample = ready.orderBy(F.xxhash64("id")).limit(256 * n_cells)
    model = KMeans(k=n_cells, seed=seed, featuresCol="features", predictionCol="cell", maxIter=10).fit(sample)
    return model.transform(ready).select("id", "vector", "cell"), [list(map(float, c)) for c in model.clusterCenters()]


def store_cells(index: DataFrame, centres: list, path: str) -> None:
    """Keep an inverted-file index: the vectors in one folder per cell, and the centres; built once, then searched by its cells."""
    index.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(8))).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    index.sparkSession.createDataFrame(list(enumerate(centres)), "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")


def stored_cells(spark, path: str) -> tuple[DataFrame, list]:
    """(index, centres) of a stored index; a search prunes the folders of other cells."""
    centres = [r["centre"] for r in spark.read.parquet(f"{path}/centres").orderBy("cell").collect()]
    return spark.read.parquet(f"{path}/vectors"), centres


def postings(docs: DataFrame, text: str = "text", id_name: str = "doc_id", stop: Sequence[str] = STOP_WORDS, field: str | None = None, weight: float = 1.0) -> DataFrame:
    """(id, term, tf, field, weight); the counts combine before the shuffle."""
    split = dealt(docs.select(F.col(id_name).alias("id"), F.col(text).alias("text"))).select("id", F.split(F.lower("text"), TERM_GAP).alias("words"))
    rows = split.select("id", F.explode_outer("words").alias("term")).where(~F.col("term").isin("", *stop))
    counted = rows.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
    return counted.withColumn("field", F.lit(field or text)).withColumn("weight", F.lit(float(weight)))


def query_terms(queries: DataFrame, stop: Sequence[str] = STOP_WORDS) -> DataFrame:
    """(query_id, term) of a table (query_id, q), without stop words."""
    return queries.select("query_id", F.explode(F.array_distinct(F.filter(terms(F.col("q")), lambda x: ~x.isin(list(stop))))).alias("term"))


def dealt(df: DataFrame) -> DataFrame:
    """Rows over all cores where a scan gives fewer tasks than there are cores (one small file); larger scans stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def tokenised(docs: DataFrame, text: str = "text", id_name: str = "doc_id") -> DataFrame:
    """(id, words, n_terms): each text is split once; the empty pieces at its ends do not count."""
    lean = dealt(docs.select(F.col(id_name).alias("id"), F.col(text).alias("text")))
    split = lean.select("id", F.split(F.lower("text"), TERM_GAP).alias("words"))
    return split.select("id", "words", (F.size("words") - F.size(F.filter("words", lambda x: x == ""))).alias("n_terms"))


def term_hits(docs: DataFrame, wanted: DataFrame, text: str = "text", id_name: str = "doc_id", parts: int | None = None) -> DataFrame:
    """(id, term, tf, n_terms) for wanted terms only; with ``parts``, the rows of an id stand in one of so many parts.

    The distinct wanted terms (those of the queries at hand) filter each
    document's words before they are exploded, so the index of the whole
    corpus is never shuffled, and nothing above the explode needs the text.
    """
    listed = sorted(r[0] for r in wanted.select("term").distinct().collect())
    held = tokenised(docs, text, id_name).select("id", "n_terms", F.filter("words", lambda x: x.isin(listed)).alias("held"))
    # the outer form, as Spark guards the other with filters that split the text again
    found = held.select("id", "n_terms", F.explode_outer("held").alias("term")).where("term is not null")
    if parts is not None:
        found = found.repartition(parts, "id")
    return found.groupBy("id", "n_terms", "term").agg(F.count(F.lit(1)).alias("tf"))


def store_postings(docs: DataFrame, path: str, text: str = "text", id_name: str = "doc_id", parts: int = 256) -> None:
    """Write the lexical index of a corpus: postings in ``parts`` folders by the hash of their term, and the corpus statistics.

    For corpora that are searched more than once: a search then reads the folders
    of its own terms, and never a text.
    """
    words = tokenised(docs, text, id_name).select("id", "n_terms", F.explode_outer("words").alias("term")).where("term <> ''")
    counted = words.groupBy("id", "n_terms", "term").agg(F.count(F.lit(1)).alias("tf"))
    part = F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int").alias("part")
    salt = F.pmod(F.xxhash64("id"), F.lit(8))  # a very common term's folder is written by several tasks
    counted.select("*", part).repartition("part", salt).sortWithinPartitions("part", "term").write.mode("overwrite").partitionBy("part").parquet(f"{path}/postings")
    corpus_stats(docs, text).withColumn("parts", F.lit(parts)).write.mode("overwrite").parquet(f"{path}/stats")


def stored_hits(path: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(term_hits, one row of statistics) from a stored index; reads only the folders of the wanted terms."""
    spark = wanted.sparkSession
    stats = spark.read.parquet(f"{path}/stats")
    parts = stats.first()["parts"]
    part = F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int")
    listed = [(r["term"], r["part"]) for r in wanted.select("term", part.alias("part")).distinct().collect()]
    rows = spark.read.parquet(f"{path}/postings").where(F.col("part").isin(sorted({p for _, p in listed})) & F.col("term").isin(sorted(t for t, _ in listed)))
    return rows.select("id", "n_terms", "term", "tf"), stats.select("n", "avgdl")


def match_counts(hits: DataFrame, wanted: DataFrame) -> DataFrame:
    """(query_id, id, n_hit, n_wanted, score): documents that have any wanted term; score is the sum of 1 + ln(tf)."""
    sizes = wanted.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_wanted"))
    joined = hits.join(F.broadcast(wanted), "term")  # the terms of the queries at hand
    found = joined.groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("n_hit"), F.sum(1 + F.log("tf")).alias("score"))
    return found.join(F.broadcast(sizes), "query_id")


def corpus_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row: number of texts and their mean number of terms, null texts counting 0."""
    rows = tokenised(docs.select(F.lit(0).alias("id"), text), text, "id")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("words").isNull(), 0).otherwise(F.col("n_terms"))).alias("avgdl"))


def bm25(stats: DataFrame, hits: DataFrame, wanted: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, id, score) by Okapi BM25, with document frequencies and lengths of the whole corpus (corpus_stats)."""
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rows = hits.join(F.broadcast(df), "term").join(F.broadcast(wanted), "term").crossJoin(F.broadcast(stats))  # the terms of the queries at hand, one row of statistics
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n_terms") / F.col("avgdl")))
    return rows.groupBy("query_id", "id").agg(F.sum(part).alias("score"))


def with_fallback(matched: DataFrame, few: int, k: int) -> DataFrame:
    """First k matches of each query, those with all terms first; the others only where fewer than ``few`` (at most k) have all.

    Those with all terms lead the ranking, so they can be counted among the k
    rows that are kept: no task sees all matches of a query.
    """
    if few > k:
        raise ValueError("few must be at most k")
    rows = matched.select("query_id", "id", (F.col("n_hit") == F.col("n_wanted")).alias("whole"), F.round("score", 6).alias("score"))
    top = ranked(rows, [F.desc("whole"), F.desc("score"), F.asc("id")], k)
    n_all = F.sum(F.col("whole").cast("int")).over(Window.partitionBy("query_id"))
    return top.withColumn("n_all", n_all).where(F.col("whole") | (F.col("n_all") < few)).drop("n_all")


def ranked(df: DataFrame, by: Sequence[Column], k: int, group: Sequence[str] = ("query_id",), name: str = "rank") -> DataFrame:
    """First k rows of each group, numbered from 1."""
    w = Window.partitionBy(*group).orderBy(*by)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def rrf(legs: Sequence[tuple[DataFrame, float]], k: int = 60) -> DataFrame:
    """(query_id, id, score): weighted reciprocal ranks summed over ranked lists (query_id, id, rank)."""
    parts = [leg.select("query_id", "id", (F.lit(float(w)) / (k + F.col("rank"))).alias("part")) for leg, w in legs]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.groupBy("query_id", "id").agg(F.sum("part").alias("score"))


def chunks(docs: DataFrame, size: int = 1750, text: str = "text", id_name: str = "doc_id") -> DataFrame:
    """Tiles of fixed size that cover each text: (doc_id, chunk_index, chunk_text)."""
    n = F.ceil(F.char_length(text) / F.lit(size)).cast("int")
    at = F.explode(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))))
    rows = docs.where(F.col(text).isNotNull()).select(F.col(id_name).alias("doc_id"), F.col(text).alias("__t"), at.alias("chunk_index"))
    return rows.select("doc_id", "chunk_index", F.substring(F.col("__t"), F.col("chunk_index") * size + 1, F.lit(size)).alias("chunk_text"))


def headline(text: Column, wanted: Column | Sequence[str], fragments: int = 2, most_words: int = 30) -> Column:
    """Up to two fragments of at most thirty words around the first hits, hits in <b> tags; ``wanted`` may be an array column."""
    words = F.split(F.trim(text), r"\s+")
    among = (lambda w: F.array_contains(wanted, w)) if isinstance(wanted, Column) else (lambda w: w.isin(list(wanted)))
    hit = lambda w: among(F.regexp_replace(F.lower(w), TERM_GAP, ""))
    places = F.filter(F.transform(words, lambda w, i: F.when(hit(w), i)), lambda i: i.isNotNull())
    first = F.greatest(F.try_element_at(places, F.lit(1)) - 5, F.lit(0))
    later = F.filter(places, lambda i: i >= first + most_words)
    second = F.try_element_at(later, F.lit(1)) - 5
    marked = F.transform(words, lambda w: F.when(hit(w), F.concat(F.lit("<b>"), w, F.lit("</b>"))).otherwise(w))
    piece = lambda start: F.array_join(F.slice(marked, start + 1, F.lit(most_words)), " ")
    one = F.when(first.isNotNull(), piece(first)).otherwise(F.array_join(F.slice(words, 1, most_words), " "))
    return F.when(second.isNotNull(), F.concat_ws(" ... ", one, piece(second))).otherwise(one) if fragments > 1 else one
