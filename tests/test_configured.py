"""Stems against the published examples, and searches in two configurations against plain lists."""

from __future__ import annotations

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from docloom.functions.stemming import stem, stem_table
from docloom.functions.text import STOP_WORDS
from docloom.operators import configured, inverted
from docloom.plans import search

#: Examples of the article, word and stem (fixed values).
EXAMPLES = """caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan
falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit conformabli conform radicalli radic
differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit
sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop
adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog effective
effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll generalizations gener oscillators oscil""".split()


def test_stems_of_the_article(spark):
    assert [stem(w) for w in EXAMPLES[::2]] == EXAMPLES[1::2]
    assert [stem(w) for w in ("as", "é", "abc1", "Cats", "", None, "yyy", "eed", "ing", "sss")] == ["as", "é", "abc1", "Cats", "", None, "yyi", "eed", "ing", "sss"]
    rows = stem_table(spark.createDataFrame([("cats",), ("cats",), (None,), ("running",)], "term string")).collect()
    assert sorted(((r.term, r.stem) for r in rows), key=str) == [("cats", "cat"), ("running", "run"), (None, None)]


def test_stems_are_stable_and_short():
    rng = random.Random(2)
    for _ in range(3000):
        word = "".join(rng.choice("abdeilnorstvyz") for _ in range(rng.randrange(12))) + rng.choice(("", "s", "ed", "ing", "ational", "iveness", "ies", "ly", "eed", "ion", "ement"))
        assert len(stem(word)) <= len(word) + 1 and (not word or stem(word)[:1] == word[:1])


WORDS = "connect connected connecting connection the of court courts ipc section sections relational relate".split()


def plain(docs, queries, short):
    out = {}
    for q, text in queries:
        words = re.findall(r"[^\W_]+", (text or "").lower())
        english = len((text or "").split()) > 3 and not {w.upper() for w in (text or "").split()} & short
        form = (lambda w: None if w in STOP_WORDS else stem(w)) if english else (lambda w: w)
        asked = {form(w) for w in words} - {None}
        for i, body in docs:
            tf = {}
            for w in re.findall(r"[^\W_]+", (body or "").lower()):
                if form(w) in asked:
                    tf[form(w)] = tf.get(form(w), 0) + 1
            if tf:
                out[q, i] = (len(tf), len(asked), round(sum(1 + math.log(n) for n in tf.values()), 9))
    return out


def test_both_configurations(spark):
    rng = random.Random(7)
    docs = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(15)))) for i in range(60)] + [(60, None), (61, "")]
    queries = [(1, "connecting the courts of relation"), (2, "connected courts"), (3, "IPC section connected to the court"), (4, None), (5, "the of the of"), (6, "unknown words only here"), (7, "The Connected, COURT of connects")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    asked = configured.with_configuration(spark.createDataFrame(queries, "query_id int, q string"), spark.createDataFrame([("ipc",), ("GST",)], "word string"))
    assert {r.query_id: r.config for r in asked.collect()} == {1: "english", 2: "simple", 3: "simple", 4: "simple", 5: "english", 6: "english", 7: "english"}
    forms = configured.wanted_forms(asked, configured.vocabulary(df))
    sizes = {r.query_id: r.n_wanted for r in configured.form_counts(asked).collect()}
    for rows in (inverted.places(df, {"text": "text"}), inverted.places(df, {"text": "text"}, wanted=forms)):
        got = {(r.query_id, r.id): (r.n_hit, sizes[r.query_id], round(r.score, 9)) for r in configured.matches(rows, forms).collect()}
        assert got == plain(docs, queries, {"IPC", "GST"}) and {q for q, _ in got} == {1, 2, 3, 7}
    assert configured.wanted_forms(asked.where("1 = 0"), configured.vocabulary(df)).collect() == []


def test_configured_search_over_the_tables(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    asked = search._benchmark_queries(spark, sf_dir).collect()
    assert {r.config for r in asked} == {"simple", "english"}
    some = [(r.query_id, r.q) for r in asked][:6]
    short = {w.upper() for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").where("item_id % 10 = 0").collect() for w in r.text.split(" ") if len(w) == 2}
    want = {}
    for (q, i), (_, _, score) in plain(docs, some, short).items():
        want.setdefault(q, []).append((-round(score, 6), i))
    found = {}
    for r in search.configured_search(spark, sf_dir).where(F.col("query_id").isin([q for q, _ in some])).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.id, r.score))
    assert found.keys() == want.keys()
    for q, rows in found.items():
        assert [(-s, i) for _, i, s in sorted(rows)] == [pytest.approx(x) for x in sorted(want[q])[:10]]


def test_a_text_is_scored_in_one_part(spark, monkeypatch):
    """Parts grow with the texts, and pairs of query and text are counted where the text's hits are: one shuffle, by id."""
    monkeypatch.setattr(configured, "PART_BYTES", 500)
    docs = [(i, " ".join(WORDS[(i * 7 + j * j) % len(WORDS)] for j in range(i % 20))) for i in range(200)] + [(200, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    asked = configured.with_configuration(spark.createDataFrame([(1, "connecting the courts of relation"), (2, "court")], "query_id int, q string"), spark.createDataFrame([], "word string"))
    forms = spark.createDataFrame(configured.wanted_forms(asked, configured.vocabulary(df)).collect(), "query_id int, term string, form string")
    rows = configured.hits(df, forms)
    assert rows.rdd.getNumPartitions() == -(-sum(len(t or "") for _, t in docs) // 500)
    found = configured.matches(rows, forms)
    assert {(r.query_id, r.id): round(r.score, 9) for r in found.collect()} == {k: x[2] for k, x in plain(docs, [(1, "connecting the courts of relation"), (2, "court")], set()).items()}
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning(query_id") == 0
