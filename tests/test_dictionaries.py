"""Dictionaries from tables against plain searches: phrases, covers, expansions, references and rules."""

from __future__ import annotations

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.operators import dictionaries
from docloom.plans import search

PHRASES = [(1, "Penal Code"), (2, "code"), (3, "penal"), (4, "penal code of india"), (5, "é"), (6, ""), (7, None), (8, "CODE"), (9, "u.p."), (10, "a a"), (11, "o")]
TEXTS = [(1, "The Penal Code of India and the penal code, or codes."), (2, None), (3, ""), (4, "a a a a, É é café"), (5, "in U.P. codex xcode CODE"), (6, "İ penal o" + " o" * 50), (7, "penal code of indiana")]


def plain(text, phrase, edges="words"):
    low, p = text.lower() if len(text.lower()) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text), phrase.lower()
    touch = {"words": str.isalnum, "letters": lambda c: "a" <= c <= "z", None: lambda c: False}[edges]
    spots = [i for i in range(len(low)) if low.startswith(p, i)]
    return [i for i in spots if not (i and touch(low[i - 1])) and not (i + len(p) < len(low) and touch(low[i + len(p)]))]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, body string").withColumn("id", F.lit(1)).withColumn("start", F.lit(1))


@pytest.fixture(scope="module")
def phrases(spark):
    return spark.createDataFrame(PHRASES, "id long, phrase string")


@pytest.mark.parametrize("most", [200_000, 3])
@pytest.mark.parametrize("edges", ["words", "letters", None])
def test_found_in(texts, phrases, most, edges):
    got = {(r.doc_id, r.entry): (r.n, r["first"]) for r in dictionaries.found_in(texts, "doc_id", "body", phrases, edges, most).collect()}
    want = {(k, i): (len(spots), spots[0]) for k, t in TEXTS if t for i, p in PHRASES if p and (spots := plain(t, p, edges))}
    assert got == want and len(want) > 10
    assert dictionaries.found_in(texts, "doc_id", "body", phrases.where("1 = 0")).collect() == []
    assert dictionaries.found_in(texts.where("1 = 0"), "doc_id", "body", phrases).collect() == []


@pytest.mark.parametrize("most", [200_000, 3])
def test_mentions_are_leftmost_and_longest(texts, phrases, most):
    got = sorted((r.doc_id, r.start, r.stop, r.entry) for r in dictionaries.mentions(texts, "doc_id", "body", phrases, most).collect())
    want = []
    for k, t in TEXTS:
        spots = sorted((i, -(i + len(p)), e) for e, p in PHRASES if p and t for i in plain(t, p))
        reach = 0
        for start, stop, e in spots:
            if start >= reach:
                want.append((k, start, -stop, e))
                reach = -stop
    assert got == sorted(want)


def test_a_large_dictionary(spark, sf_dir):
    """A hundred thousand phrases, in several passes, against sets of word pairs."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null").limit(40).collect()]
    rng = random.Random(1)
    pairs = sorted({" ".join(w[i : i + 2]) for _, t in docs for w in [t.split()] for i in range(0, len(w) - 1, 7) if all(x.isalpha() for x in w[i : i + 2])})
    entries = list(enumerate(pairs + [f"no such{rng.randrange(10**9)} {i}" for i in range(100_000)]))
    dictionary = spark.createDataFrame(entries, "id long, phrase string").repartition(4)
    got = {(r.doc_id, r.entry): r.n for r in dictionaries.found_in(spark.createDataFrame(docs, "doc_id long, t string"), "doc_id", "t", dictionary, most=40_000).collect()}
    number = {}
    for i, p in entries[: len(pairs)]:
        number.setdefault(p.lower(), []).append(i)
    want = {}
    for k, t in docs:
        words = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W_]+", t)]
        for (_, stop, a), (start, _, b) in zip(words, words[1:], strict=False):
            if t[stop:start] == " ":
                for i in number.get(f"{a} {b}", ()):
                    want[k, i] = want.get((k, i), 0) + 1
    assert got == want and len(want) > 1000


def test_expansions(spark):
    forms = spark.createDataFrame([(1, "IPC", "Indian Penal Code"), (2, "BNS", "Nyaya"), (3, "BNSS", "Suraksha"), (4, "x", None)], "place int, short string, full string")
    asked = [(1, "ipc 302"), (2, "the Indian penal code (IPC)"), (3, "section of BNSS"), (4, None), (5, ""), (6, "IPC or bns"), (7, "bnss Suraksha")]
    got = {r.query_id: r.expanded for r in dictionaries.expanded(spark.createDataFrame(asked, "query_id int, q string"), forms.where("full is not null")).collect()}
    assert got == {1: "ipc 302 Indian Penal Code", 2: asked[1][1], 3: "section of BNSS Nyaya Suraksha", 4: None, 5: "", 6: "IPC or bns Indian Penal Code Nyaya", 7: "bnss Suraksha Nyaya"}


def test_references(spark):
    aliases = [("ipc", "IPC"), ("indian penal code", "IPC"), ("penal code", "PC"), ("crpc", "CrPC"), ("code of criminal procedure", "CrPC"), ("act", "ACT"), ("abc", "X"), ("abd", "Y")]
    texts = [
        (1, "Under Section 302 of the Indian Penal Code and section 41A, CrPC."), (2, "Sections 13(2) of ipcx; Section 5 IPC; Article 21, articles 19-A"), (3, None), (4, "Section 438 of the Code of Criminal Procedure, 1973 ipc"),
        (5, "section 7 act of the penal code"), (6, "section 9"), (7, "section 1 abd abc"), (8, "Section 4 of the Act-IPC"),
    ]
    rows = dictionaries.references(spark.createDataFrame(texts, "id int, t string"), "id", "t", spark.createDataFrame(aliases, "alias string, code string"))
    got = sorted(tuple(r) for r in rows.collect())
    assert got == [(1, "302", "IPC"), (2, "19-A", "COI"), (2, "21", "COI"), (2, "5", "IPC"), (4, "438", "CrPC"), (5, "7", "PC"), (7, "1", "X"), (8, "4", "ACT")]


def test_rules(spark):
    rules = [("a", 1, "every", "red"), ("a", 1, "every", "ring"), ("b", 2, "some", "blue"), ("b", 2, "some", "green"), ("b", 2, "subject", "ring"), ("c", 0, "every", None), ("d", 3, "some", "RING"), ("e", 3, "every", "big ring")]
    texts = [(1, "a red, ring"), (2, "blue ring"), (3, "ring"), (4, "green"), (5, None), (6, "rings"), (7, "red blue green ring"), (8, "Big Ring")]
    rows = dictionaries.first_rules(spark.createDataFrame(texts, "id int, t string"), "id", "t", spark.createDataFrame(rules, "rule string, priority int, part string, keyword string"))
    assert {r.id: r.rule for r in rows.collect()} == {1: "a", 2: "b", 3: "d", 4: None, 5: None, 6: None, 7: "a", 8: "d"}


def test_mentions_over_the_tables(spark, sf_dir):
    rows = search.dictionary_mentions(spark, sf_dir)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = rows.collect()
    by_doc: dict[int, list] = {}
    for r in found:
        by_doc.setdefault(r.doc_id, []).append((r.start, r.stop))
        assert re.fullmatch(r"\S+ \S+( \S+)?", texts[r.doc_id][r.start : r.stop])
    assert len(found) > 100
    for spans in by_doc.values():
        spans.sort()
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_a_worker_puts_out_what_it_found_in_bounded_batches(monkeypatch):
    """Texts with very many hits: each batch has at most one text's places more than the bound, and none is lost."""
    monkeypatch.setattr(dictionaries, "HELD", 1000)
    texts = ["a b " * 100] * 200 + [None, ""]
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["key", "text"])
    found = list(dictionaries._search([(1, "a"), (2, "b")], "words", False)(iter([rows])))
    assert max(b.num_rows for b in found) <= 1000 + 200 and sum(b.num_rows for b in found) == 200 * 200
    assert {(r["key"], r["entry"], r["start"], r["stop"]) for b in found for r in b.to_pylist()} == {(i, 1 + at % 2, 2 * at, 2 * at + 1) for i in range(200) for at in range(200)}
