"""The service object and the model functions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from docloom.api import Corpus
from docloom.functions import models
from docloom.plans import catalog, search


@pytest.fixture(scope="module")
def corpus(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return Corpus(docs, vectors)


def test_search_pages(spark, corpus, sf_dir):
    asked = search.asked(spark).join(search.query_vectors(spark, sf_dir), "query_id").drop("vec_id")
    one = corpus.search(asked, page=1, limit=5).select("query_id", "doc_id", "rank").collect()
    two = corpus.search(asked, page=2, limit=5).select("query_id", "doc_id", "rank").collect()
    assert {r["rank"] for r in one} <= set(range(1, 6)) and {r["rank"] for r in two} <= set(range(6, 11))
    assert not {(r["query_id"], r["doc_id"]) for r in one} & {(r["query_id"], r["doc_id"]) for r in two}
    with pytest.raises(ValueError):
        corpus.search(asked, limit=51)


def test_a_stored_index_finds_the_same(spark, corpus, sf_dir, tmp_path):
    asked = search.asked(spark).join(search.query_vectors(spark, sf_dir), "query_id").drop("vec_id")
    stored = corpus.store_index(str(tmp_path / "index"), parts=8)
    key = lambda df: sorted((r["query_id"], r["rank"], r["doc_id"]) for r in df.collect())
    for filters in (None, {"lang": ["de", "fr"]}):
        assert key(stored.search(asked, filters)) == key(corpus.search(asked, filters))


def test_filters_hold_in_every_branch(spark, corpus, sf_dir):
    asked = search.asked(spark).join(search.query_vectors(spark, sf_dir), "query_id").drop("vec_id")
    assert {r["lang"] for r in corpus.search(asked, {"lang": ["de"]}).collect()} == {"de"}
    assert {r["facet"] for r in corpus.facets(["lang", "source"], {"lang": ["de"]}).collect()} == {"lang", "source"}


def test_browse_get_and_suggest(spark, corpus):
    first = corpus.browse([F.desc("n_chars")], limit=3).collect()
    second = corpus.browse([F.desc("n_chars")], page=2, limit=3).collect()
    assert first[-1]["n_chars"] >= second[0]["n_chars"] and len(second) == 3
    assert corpus.get(first[0]["doc_id"]).count() == 1
    exact = spark.createDataFrame([(7,)], "id long")
    rows = corpus.suggest(search.asked(spark), exact=exact).orderBy("rank").collect()
    assert rows[0]["id"] == 7 and rows[0]["exact"] and len(rows) <= 8
    assert corpus.paragraphs().columns[0] == "doc_id"


def test_suggestions_by_group(spark):
    """Groups stay apart, a title and year stand once, titles that hold a query lead."""
    rows = [(1, "alpha law", "alpha beta gamma", 2001), (2, "Alpha Law ", "alpha alpha beta", 2001), (3, "alpha law", "alpha", 2002), (4, "", "beta"), (5, None, "gamma beta"), (6, "beta", "delta beta"), (7, "other", "delta"), (8, "gamma", "nothing")]
    docs = spark.createDataFrame([(*r, *([None] * (4 - len(r)))) for r in rows], "doc_id long, name string, text string, y int")
    held = Corpus(docs, title="name")
    asked = spark.createDataFrame([(1, "alpha", "a"), (2, "alpha beta", "a"), (3, "delta", "b"), (4, "nothing here", None)], "query_id long, q string, g string")
    exact = spark.createDataFrame([(8, "b"), (8, "b")], "id long, g string")
    got = {}
    for r in held.suggest(asked, group="g", exact=exact, year="y").orderBy("g", "rank").collect():
        got.setdefault(r.g, []).append((r.id, r.exact))
    assert got.keys() == {"a", "b", None} and got["b"][0] == (8, True) and {i for i, _ in got["b"]} == {6, 7, 8} and [i for i, _ in got[None]] == [8]
    ids = [i for i, _ in got["a"]]
    assert len({1, 2} & set(ids)) == 1 and 3 in ids and len(ids) == len(set(ids))
    one = [r.id for r in held.suggest(asked.drop("g"), year="y").collect()]
    assert len(one) == len(set(one)) and {3, 6, 7} <= set(one)
    found = held.search(asked.drop("g"), limit=2)
    totals = {r["query_id"]: r["total"] for r in found.collect()}
    assert totals == {1: 3, 2: 6, 3: 2, 4: 1}


def test_models_and_table_functions(spark):
    df = spark.createDataFrame([("ab",), (None,)], "t string")
    encode = models.embedder(lambda texts: [[len(t)] for t in texts])
    assert [r.v for r in df.select(encode("t").alias("v")).collect()] == [[2.0], None]
    models.register_scorer(spark, "pair_score", lambda pairs: [len(a) + len(b) for a, b in pairs])
    assert spark.sql("SELECT pair_score('abc', 'd') AS s").first().s == 4.0
    models.register_table_functions(spark)
    rows = spark.sql("SELECT p.para_number FROM segment_paragraphs('A. 1. The a. 2. The b. 3. The c.') p").collect()
    assert [r.para_number for r in rows] == [1, 2, 3]
    assert spark.sql("SELECT * FROM plan_chunks('धारा तीन सौ दो के अंतर्गत\n\nplain\n\nयह आदेश धारा तीन सौ', 8)").count() == 2
    assert spark.sql("SELECT * FROM parse_sections('<p>a section that is long enough</p>')").count() == 1


def test_flagship_is_registered():
    assert "hybrid_search" in catalog.QUERIES
