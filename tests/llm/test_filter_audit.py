"""Operator 11 against brute force, on odd rows and over whole tables."""

from __future__ import annotations

import random
import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import filter_audit, queries, words
from tests import oracle

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def failed(text: str) -> str:
    found = WORD.findall(text)
    checks = {"A": len(found) < 200, "B": 100 * len(set(found)) < 50 * len(found), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search("[#$%&*|]", text))}
    return "".join(k for k, v in checks.items() if v)


def slow_audit(rows, quality, toxic):
    """Every filter in every order over every row, by hand."""
    docs = [(i, t or "", p or "") for i, t, p in rows]
    least: dict[str, int] = {}
    for i, t, _ in docs:
        if i is not None:
            least[t] = min(i, least.get(t, i))
    fails = [set(failed(t)) | ({"E"} if i is not None and i > least[t] else set()) for i, t, _ in docs]
    out, removed_at = {}, {}
    for part in {p for *_, p in docs}:
        for order in permutations("ABCDE"):
            left = {n for n, d in enumerate(docs) if d[2] == part}
            everyone = set(left)
            for step, letter in enumerate(order, 1):
                gone = {n for n in left if letter in fails[n]}
                left -= gone
                removed_at[part, letter] = removed_at.get((part, letter), 0) + len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(letter in fails[n] for n in everyone) - len(gone), sum(fails[n] == {letter} for n in everyone),
                    sum(docs[n][0] in quality for n in gone), sum(docs[n][0] in toxic for n in gone),
                ]
    return {(p, o, s): (*v, removed_at[p, o[s - 1]]) for (p, o, s), v in out.items()}


def got(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def odd_rows():
    rng = random.Random(5)
    rows = [(1, None, "en"), (2, "", None), (3, "", ""), (None, "", "en"), (None, "lone A#", None), (4, "same words here", "en"), (5, "same words here", "de"), (5, "same words here", "de"), (4, "same words here", "en")]
    rows += [(10, "w " * 250, "en"), (11, "x" * 70_000, "fr"), (12, " \t\n\v\f\r ", "fr"), (13, "é中\U0001f600  \x1c é", "fr"), (14, "ABC def", "de"), (15, "100 % * |", "de")]
    rows += [(20 + i, " ".join(f"word{rng.randrange(400)}" for _ in range(rng.choice((150, 260)))) + rng.choice(("", " #", " ABCDEFGHIJKLMNOPQRSTUVWXYZ" * 4)), rng.choice(("en", "de"))) for i in range(60)]
    rows += [(200 + i, rows[-1 - i % 5][1], "en") for i in range(20)]
    return rows


def test_audit_odd_rows(spark):
    rows = odd_rows()
    labels = [(4, 1, 0), (4, 0, 1), (5, 1, 1), (11, 1, None), (None, 1, 1), (30, 1, 1), (41, 0, 1), (999, 1, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    for name in ("mask", "n", "key", "id", "part", "good", "out0", "c0", "n_points_", "least"):
        df = df.withColumn(name, F.lit(7))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("n", F.lit(1))
    rows_of = lambda d: filter_audit.audit(filter_audit.measure(d, ["doc_id", "lang"], block_bytes=1000), filter_audit.text_filters(), marks, part="lang")
    want = slow_audit(rows, {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None})
    assert got(rows_of(df)) == want
    assert rows_of(df.where("1 = 0")).collect() == []
    assert got(filter_audit.audit(filter_audit.measure(df, ["doc_id", "lang"]), filter_audit.text_filters(), marks.where("1 = 0"), part="lang")) == slow_audit(rows, set(), set())


def test_audit_over_a_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    df = queries.op11_filter_audit(spark, sf_dir)
    assert got(df) == slow_audit(rows, {r.doc_id for r in labels if r.quality == 1}, {r.doc_id for r in labels if r.toxic == 1})
    oracle.same(df, oracle.connect(sf_dir), queries.ORACLES["op11_filter_audit"])


@pytest.mark.parametrize("seed", range(20))
def test_spans_and_distinct_words(seed):
    """The transducer and the hash table against a pattern and a set, with words that share hash slots."""
    rng = random.Random(seed)
    texts = ["".join(rng.choice(("a", "b", "A", " ", "\t", "é", "#", "中", "\x1f", "\x0e")) for _ in range(rng.randrange(60))) for _ in range(40)] + ["q" * 500 + " " + "q" * 499 + "r " + "q" * 500]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    opened, ends, counts = filter_audit.transduce(data, offsets)
    begins, stops, owner = words.spans(data, offsets)
    assert opened.tolist() == begins.tolist() and ends.tolist() == stops.tolist()
    assert [bytes(data[i:j]).decode() for i, j in zip(opened, ends, strict=True)] == [w for t in texts for w in WORD.findall(t)]
    assert counts[filter_audit.IS_POINT].tolist() == [len(t) for t in texts]
    first = filter_audit.first_spans(words.padded8(data), opened, ends - opened, owner)
    assert np.bincount(owner[first], minlength=len(texts)).tolist() == [len(set(WORD.findall(t))) for t in texts]


def test_equal_hashes_are_told_apart(monkeypatch):
    """With one hash for all, only the comparison of bytes tells words apart."""
    monkeypatch.setattr(words, "hashes", lambda eight, begins, sizes: np.zeros(len(begins), np.uint64))
    raw = b"aa ab aa ba aaaaaaaab aaaaaaaac aaaaaaaab ab"
    data, offsets = np.frombuffer(raw, np.uint8), np.array([0, len(raw)])
    opened, ends, _ = filter_audit.transduce(data, offsets)
    first = filter_audit.first_spans(words.padded8(data), opened, ends - opened, np.zeros(len(opened), np.int64))
    assert first.sum() == len(set(raw.split()))
