"""The engine's services as one object over the caller's own tables.

Column names are parameters, so any document table can be searched, browsed and
split; every method returns a DataFrame and runs nothing until it is read
(searches read the queries at hand, never the corpus, on the driver).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import classify_query, clean_page_text
from docloom.operators import dictionaries, paragraphs, rerank
from docloom.operators import retrieval as r

#: (vector, lexical) fusion weights by kind of query (fixed values).
WEIGHTS = {"citation": (0.5, 4.0), "party_name": (0.5, 3.0), "concept": (0.5, 3.0), "section_ref": (1.0, 2.0)}


@dataclass
class Corpus:
    """documents (id, text, title and facet columns) and, if there are any, vectors (id, vector)."""

    documents: DataFrame
    vectors: DataFrame | None = None
    id: str = "doc_id"
    text: str = "text"
    title: str | None = None
    index: str | None = None

    def store_index(self, path: str, parts: int = 256) -> Corpus:
        """Write the lexical index once; searches of the object returned read the folders of their terms instead of the texts."""
        r.store_postings(self.documents, path, self.text, self.id, parts)
        return replace(self, index=path)

    def filtered(self, filters: dict[str, Sequence] | None = None, unknown_stays: Sequence[str] = ()) -> DataFrame:
        """One filter struct for every branch: a list per column; columns in ``unknown_stays`` also keep null and ''."""
        rows = self.documents
        for column, values in (filters or {}).items():
            hit = F.col(column).isin(list(values))
            rows = rows.where(hit | F.nullif(F.col(column), F.lit("")).isNull() if column in unknown_stays else hit)
        return rows

    def search(self, queries: DataFrame, filters: dict[str, Sequence] | None = None, page: int = 1, limit: int = 10, depth: int = 50, few: int = 10) -> DataFrame:
        """Hybrid search of (query_id, q[, vector]): legs, adaptive fusion, title boost, one page with totals and texts."""
        if page < 1 or not 1 <= limit <= 50:
            raise ValueError("page starts at 1, limit is 1 to 50")
        docs = self.filtered(filters)
        wanted = r.query_terms(queries)
        hits = r.stored_hits(self.index, wanted)[0] if self.index else r.term_hits(docs, wanted, self.text, self.id)
        if self.index and filters:
            hits = hits.join(docs.select(F.col(self.id).alias("id")), "id", "left_semi")
        legs = [r.with_fallback(r.match_counts(hits, wanted), few, depth).select("query_id", "id", "rank", F.lit(1).alias("leg"))]
        if self.vectors is not None and "vector" in queries.columns:
            near = self.vectors.join(docs.select(F.col(self.id).alias("id")), "id", "left_semi") if filters else self.vectors
            legs.append(r.knn(near, queries, depth).select("query_id", "id", "rank", F.lit(0).alias("leg")))
        kinds = queries.select("query_id", classify_query(F.col("q")).alias("kind"), "q")
        vector, lexical_weight = (F.coalesce(*[F.when(F.col("kind") == k, w[i]) for k, w in WEIGHTS.items()]) for i in (0, 1))
        kinds = kinds.withColumn("w0", vector).withColumn("w1", lexical_weight)
        ranks = legs[0]
        for leg in legs[1:]:
            ranks = ranks.unionByName(leg)
        parts = ranks.join(F.broadcast(kinds), "query_id").select("query_id", "id", (F.when(F.col("leg") == 0, F.col("w0")).otherwise(F.col("w1")) / (60 + F.col("rank"))).alias("part"))  # one row a query
        if self.title:
            named = dictionaries.found_in(docs, self.id, self.title, queries.select(F.col("query_id").alias("id"), F.col("q").alias("phrase")), edges=None)
            parts = parts.unionByName(named.select(F.col("entry").alias("query_id"), F.col(self.id).alias("id"), F.lit(5.0).alias("part")))
        fused = parts.groupBy("query_id", "id").agg(F.round(F.sum("part"), 9).alias("score"))
        totals = fused.groupBy("query_id").agg(F.count(F.lit(1)).alias("total"))
        first = r.ranked(fused, [F.desc("score"), F.asc("id")], page * limit)  # each task keeps a page's end, so no task sees all matches of a query
        rows = first.where(F.col("rank") > (page - 1) * limit).join(F.broadcast(totals), "query_id")
        rows = rows.withColumn("relevance", F.round(F.col("score") * 10, 2)).withColumn("total_pages", F.ceil(F.col("total") / limit))
        return docs.join(F.broadcast(rows), F.col(self.id) == F.col("id")).drop("id") if self.id != "id" else docs.join(F.broadcast(rows), "id")  # one page a query

    def browse(self, order: Sequence[Column], filters: dict[str, Sequence] | None = None, page: int = 1, limit: int = 10) -> DataFrame:
        """A page of the filtered documents; the sort keeps no more rows than the page's end."""
        return self.filtered(filters).orderBy(*order, self.id).limit(page * limit).offset((page - 1) * limit)

    def facets(self, columns: Sequence[str], filters: dict[str, Sequence] | None = None) -> DataFrame:
        """(facet, value, n) of several columns in one scan."""
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])).alias("f")
        rows = self.filtered(filters).select(pairs).select("f.*").where(F.nullif("value", F.lit("")).isNotNull())
        return rows.groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))

    def get(self, key) -> DataFrame:
        return self.documents.where(F.col(self.id) == key).limit(1)

    def paragraphs(self, filters: dict[str, Sequence] | None = None) -> DataFrame:
        """Numbered paragraphs of scanned documents, after page furniture is removed."""
        flat = self.filtered(filters).select(self.id, clean_page_text(F.col(self.text)).alias("flat"))
        return paragraphs.segment(flat, "flat", self.id)

    def suggest(self, queries: DataFrame, group: str | None = None, keep: int = 8, exact: DataFrame | None = None, score: Column | None = None, year: str | None = None) -> DataFrame:
        """Citations for groups of queries: consensus over a group's queries, exact matches first, one row of a title and year, drop-off with at least five left.

        ``group`` is a column of the queries; without it they are one group. ``exact`` (id, and the group if there are
        any) names rows that stay. ``score`` may be a column of an outside model over the found rows; else fused ranks count.
        """
        groups = queries.select("query_id", (F.col(group) if group else F.lit(0)).alias("__group"))
        asked = queries.drop(group) if group and group != "query_id" else queries
        found = self.search(asked, limit=30).join(F.broadcast(groups), "query_id").withColumnRenamed("score", "__part")  # a row a query
        title, when = (F.col(c).cast("string") if c else F.lit("") for c in (self.title, year))
        best = found.groupBy("__group", F.col(self.id).alias("id")).agg(F.sum("__part").alias("score"), F.first(title).alias("title"), F.first(when).alias("year"))
        if score is not None:
            best = best.drop("score").join(self.documents, best["id"] == self.documents[self.id]).select("__group", best["id"], "title", "year", score.alias("score"))
        named = best.select("__group", "id").where("1 = 0") if exact is None else exact.select((F.col(group) if group else F.lit(0)).alias("__group"), "id").distinct()
        rows = best.join(named.withColumn("__exact", F.lit(True)), ["__group", "id"], "full")
        rows = rows.select("__group", "id", (F.coalesce("score", F.lit(0.0)) + F.when(F.col("__exact"), 0.5).otherwise(0.0)).alias("score"), F.coalesce("__exact", F.lit(False)).alias("exact"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("year", F.lit("")).alias("year"))
        kept = rerank.dropoff_min_results(rows, ["__group"], "score", "exact", ["title", "year"], "id")
        best_first = rerank.exact_first(kept, ["__group"], "score", "exact", "id").where(F.col("rank") <= keep)
        return best_first.select(*([F.col("__group").alias(group)] if group else []), "id", "score", "exact", "rank")
