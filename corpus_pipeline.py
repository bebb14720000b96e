"""Corpus pipeline: toxicity filter, exact dedup, near dedup, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes
each one as Parquet in the shared folder and reads it again for the next. A
stage sees every row that the one before kept, and works on those alone:

- toxicity: rows scored at or above the threshold go. Labels are learned from
  the training fold only, and only for rows that are among the stage's input.
- exact_dedup: of equal texts (A-Z lower-cased) the row of the largest id stays.
- near_dedup: of texts linked by word 5-gram Jaccard of 0.8 or more, the row of
  the least id of each component stays.
- mixing: rows stay with the calibrated probability of their source, language
  and form; the choice hangs on the id alone. Rare values (together 1% of the
  tokens of a margin) do not thin the others: see docloom.llm.mixing.
- tokens: ids of every text that is left, as little-endian 32-bit integers.

Null texts count as empty, null ids stay, rows that repeat are copies of one
another, and extra columns are carried to the last stage. Empty input passes
through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm import bpe, exact_dedup, mixing, ngram_join, queries, shared, toxicity
from docloom.sources.tables import table


def _all(docs: DataFrame):
    return [shared.column(c) for c in docs.columns]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores below the threshold. A null text scores as an empty one; without labels all rows stay."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), ~queries.held_out())
    score = shared.fresh(docs, "score")
    scored = toxicity.score(docs, model, docs.columns, out=score)
    return scored.where(F.col(score) < queries.TOXIC_FROM).select(*_all(docs))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null and empty are equal) the row of the largest id; of rows that repeat id and text, the one that is first by all its columns' hash."""
    digest, name, one, order = (shared.fresh(docs, c) for c in ("digest", "name", "one", "order"))
    as_text = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    kept = exact_dedup.exact_groups(docs).where("kept").select(F.col("text_sha256").alias(digest), as_text(F.col("doc_id")).alias(name))
    lowered = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    marked = docs.withColumns({digest: F.sha2(lowered.cast("binary"), 256), name: as_text(F.col("doc_id")), order: F.xxhash64(F.to_json(F.struct(*_all(docs))))})
    stay = marked.join(kept.hint("merge"), [digest, name])
    first = Window.partitionBy(digest, name).orderBy(order)  # dealt as for the join
    return stay.withColumn(one, F.row_number().over(first)).where(F.col(one) == 1).select(*_all(docs))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of word 5-gram Jaccard 0.8: the least id (a null id after all others). Texts without words stay."""
    rows = ngram_join.jaccard_components(docs, n=5, top=80, bottom=100)
    key, digest = shared.fresh(docs, "key"), shared.fresh(docs, "digest")
    stay = rows.where("first").select(F.col("doc_id").alias(key), F.col("text_hash").alias(digest)).distinct()
    match = (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(digest)) & F.col("doc_id").eqNullSafe(F.col(key))
    return docs.join(stay.hint("merge"), match, "left_semi").select(*_all(docs))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows kept with their cell's probability; a topic column counts as the topic, and is carried as it is."""
    own = {c: f"own {i}" for i, c in enumerate(docs.columns) if c in mixing.ADDED}
    renamed = docs.withColumnsRenamed(own)
    if "topic" in own:
        renamed = renamed.withColumn("topic", F.col(own["topic"]))
    rows = mixing.with_probabilities(renamed, queries.MIX, rare=mixing.RARE)
    return rows.where("selected").select(*(shared.column(own.get(c, c)).alias(c) for c in docs.columns))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every row; null and empty texts have no tokens."""
    return bpe.encode(docs, queries._vocabulary(), keep=["doc_id"])


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("tokens", tokens_stage),
]

#: Scores, components and merges cannot be told in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared.scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        with shared.scope(spark):  # what a stage keeps for itself goes when its rows are written
            docs = shared.written(stage(spark, docs, sf_dir), f"{folder}/{at}-{name}")
    return docs
