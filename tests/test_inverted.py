"""Positional index: places, phrases and covers against plain lists; a stored index that follows changes equals a rebuild."""

from __future__ import annotations

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from docloom.operators import inverted

VOCABULARY = "a b c d e ä of the".split()
FIELDS = {"title": "title", "body": "body"}


def words(t):
    return [w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w]


def documents(rng, ids):
    say = lambda n: rng.choice((" ", "  ", ", ")).join(rng.choice(VOCABULARY) for _ in range(rng.randrange(n)))
    return [(i, rng.choice((None, say(4))), rng.choice((say(25), say(25).upper(), None if i % 17 == 0 else say(9)))) for i in ids]


def plain(docs):
    """{(id, field, term): (tf, n_terms, places)}"""
    out = {}
    for i, title, body in docs:
        for field, text in (("title", title), ("body", body)):
            held = words(text)
            for at, w in enumerate(held):
                out.setdefault((i, field, w), []).append(at)
            for w in set(held):
                out[i, field, w] = (held.count(w), len(held), [at for at, x in enumerate(held) if x == w])
    return out


def got(rows):
    held = [((r.id, r.field, r.term), (r.tf, r.n_terms, list(r.places))) for r in rows.collect()]
    assert len(held) == len(dict(held))
    return dict(held)


@pytest.fixture(scope="module")
def docs():
    return documents(random.Random(1), range(120))


@pytest.fixture(scope="module")
def df(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, title string, body string").withColumn("term", F.lit("x")).withColumn("id", F.lit("y")).repartition(3)


def test_places(spark, df, docs):
    assert got(inverted.places(df, FIELDS)) == plain(docs)
    wanted = spark.createDataFrame([("of",), ("ä",), ("zz",)], "term string")
    assert got(inverted.places(df, FIELDS, wanted=wanted)) == {k: v for k, v in plain(docs).items() if k[2] in ("of", "ä")}
    assert inverted.places(df.where("1 = 0"), FIELDS).collect() == []


def test_phrases(spark, df, docs):
    asked = [(1, "of the"), (2, "a B, a"), (3, "ä"), (4, " -- "), (5, None), (6, "the of a b c d e"), (7, "e e")]
    phrases = inverted.phrase_terms(spark.createDataFrame(asked, "query_id int, q string"))
    found = {(r.query_id, r.id, r.field): r.n_phrases for r in inverted.phrase_counts(inverted.places(df, FIELDS), phrases).collect()}
    want = {}
    for q, text in asked:
        p = words(text)
        for i, title, body in docs:
            for field, t in (("title", title), ("body", body)):
                held = words(t)
                n = sum(held[k : k + len(p)] == p for k in range(len(held) - len(p) + 1)) if p else 0
                if n:
                    want[q, i, field] = n
    assert found == want and {q for q, *_ in want} >= {1, 2, 3, 7}


def test_covers_and_weights(spark, df, docs):
    wanted = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "a"), (3, "c"), (3, "the")], "query_id long, term string")
    rows = inverted.places(df, FIELDS)
    covers = {(r.query_id, r.id): r.score for r in inverted.cover_density(rows, wanted).collect()}
    scores = {(r.query_id, r.id): (r.n_hit, r.score) for r in inverted.weighted_scores(rows, wanted, {"title": 2.0, "body": 0.5}).collect()}
    want, want_scores = {}, {}
    for q, terms in ((1, "a b"), (2, "c"), (3, "a c the")):
        terms = terms.split()
        for i, *texts in docs:
            total, hit = 0.0, set()
            for w, t in zip((2.0, 0.5), texts, strict=True):
                held = words(t)
                spans = [(x, y) for x in range(len(held)) for y in range(x, len(held)) if set(terms) <= set(held[x : y + 1])]
                least = [s for s in spans if not any(o != s and o[0] >= s[0] and o[1] <= s[1] for o in spans)]
                if least:
                    want[q, i] = want.get((q, i), 0) + sum(1 / (y - x + 1) for x, y in least)
                for term in set(terms) & set(held):
                    hit.add(term)
                    total += w * (1 + math.log(held.count(term)))
            if hit:
                want_scores[q, i] = (len(hit), total)
    assert covers == pytest.approx(want)
    assert scores.keys() == want_scores.keys() and all(scores[k] == (n, pytest.approx(s)) for k, (n, s) in want_scores.items())


def test_segments_equal_a_rebuild(spark, tmp_path):
    """Inserts, updates and deletes in several batches, one of them twice, before and after a compaction."""
    rng = random.Random(4)
    path, held = str(tmp_path / "index"), {}
    schema = "doc_id long, title string, body string, gone boolean, at int"
    wanted = spark.createDataFrame([("a",), ("the",)], "term string")
    for n in range(1, 5):
        batch = [(*d, rng.random() < 0.2 and n > 1, 1) for d in documents(rng, rng.sample(range(80), 40))]
        batch += [(*d[:3], not d[3], 0) for d in batch[:10]]  # earlier states of the same batch
        for _ in range(2 if n == 2 else 1):
            inverted.apply_changes(spark.createDataFrame(batch, schema), path, FIELDS, n * 10, deleted="gone", order="at", parts=5)
        for i, title, body, gone, at in batch:
            if at == 1:
                held[i] = (i, title, body)
                if gone:
                    del held[i]
        assert got(inverted.current(spark, path)) == plain(held.values())
        if n == 3:
            assert inverted.compact(spark, path) == 31
            assert got(inverted.current(spark, path)) == plain(held.values())
    some = inverted.current(spark, path, wanted)
    assert got(some) == {k: v for k, v in plain(held.values()).items() if k[2] in ("a", "the")}
    assert "PartitionFilters: [" in some._jdf.queryExecution().toString() and inverted._log(spark, path)[0] == [31, 40]


def test_index_follows_a_stream(spark, tmp_path):
    """Two runs of a stream from one checkpoint; the second finds new files only."""
    rng = random.Random(9)
    source, path, checkpoint = (str(tmp_path / x) for x in ("changes", "index", "checkpoint"))
    schema, held = "doc_id long, title string, body string", {}
    for ids in (range(40), range(20, 60)):
        docs = documents(rng, ids)
        held |= {d[0]: d for d in docs}
        spark.createDataFrame(docs, schema).coalesce(1).write.mode("append").parquet(source)
        inverted.follow(spark.readStream.schema(schema).parquet(source), path, FIELDS, checkpoint, parts=3).awaitTermination()
    assert inverted._log(spark, path)[0] == [inverted.STEP, 2 * inverted.STEP]
    assert got(inverted.current(spark, path)) == plain(held.values())
