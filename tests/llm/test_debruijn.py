"""Operator 13 against brute force, on odd rows, colliding hashes, hot passages and whole tables."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from docloom.llm import debruijn, queries
from tests import oracle

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_repeats(rows, k):
    """Every window of every document, by hand; a null id is smaller than any other."""
    docs = [(float("-inf") if i is None else i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, ws in docs:
        for j in range(len(ws) - k + 1):
            w = tuple(ws[j : j + k])
            first[w] = min(first.get(w, i), i)
    out = []
    for (i, ws), (raw, _) in zip(docs, rows, strict=True):
        gone = set()
        for j in range(len(ws) - k + 1):
            if first[tuple(ws[j : j + k])] < i:
                gone |= set(range(j, j + k))
        out.append((raw, len(ws), len(gone), " ".join(w for j, w in enumerate(ws) if j not in gone).encode()))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in df.collect()), key=repr)


def odd_rows():
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice("aa bb cc dd é ff gg hh".split()) + str(rng.randrange(12)) for _ in range(n))
    base, passage, line = say(300), say(40), say(9)
    rows = [(1, None), (2, ""), (3, " \t\n "), (None, base), (None, base), (4, base), (4, base), (5, base.replace(" ", "\n\t ")), (6, "no " * 400), (7, "no " * 30), (8, "x" * 50_000 + " " + passage)]
    rows += [(9, passage + " " + say(5000) + " " + passage), (10, say(12)), (11, " ".join(base.split()[:13])), (12, " ".join(base.split()[:12])), (13, base + " " + base)]
    rows += [(20 + i, say(rng.randrange(30)) + " " + rng.choice((passage, line, base[40:900], passage + " " + line)) + " " + say(rng.randrange(30))) for i in range(60)]
    rows += [(100 + i, f"{say(3)} {line} {line} {line} {say(8)}") for i in range(60)]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(odd_rows(), "doc_id long, text string").repartition(4)
    for name in ("block", "number", "head", "row", "word", "id", "n", "bucket", "kind", "at"):
        df = df.withColumn(name, F.lit("x"))
    return df


@pytest.mark.parametrize(("length", "more"), [
    (13, {}), (13, {"block_bytes": 2000, "bucket_bytes": 3000}), (13, {"bits": 9, "block_bytes": 3000}), (13, {"hot_blocks": 0, "block_bytes": 1500}), (6, {"block_bytes": 4000}), (20, {"bits": 5}),
])
def test_odd_rows(odd, length, more):
    """Also with hashes so short that nearly all windows collide, and with every gram taken for hot."""
    assert got(debruijn.remove_repeats(odd, length, **more)) == slow_repeats(odd_rows(), length)


def test_empty_table(odd):
    assert debruijn.remove_repeats(odd.where("1 = 0")).collect() == []


def test_long_paths_are_put_together(spark, monkeypatch):
    """A copy of a document is one path, cut at the cells of its source; pieces and cells do not change the result."""
    monkeypatch.setattr(debruijn, "CELL", 64)
    long = " ".join(f"w{i}" for i in range(1000))
    rows = [(i, long) for i in range(3)]
    assert got(debruijn.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == slow_repeats(rows, 13)
    piece = "head long, row long, word long, before long, tail long, after long, n long, id long"
    pieces = spark.createDataFrame([(1, 7, 0, 0, 2, 3, 2, 5), (3, 7, 2, 2, 4, 9, 2, 5), (5, 7, 4, 4, 6, 0, 3, 5), (8, 7, 64, 6, 8, 0, 1, 5), (1, 9, 0, 0, 1, 0, 1, 6)], piece)
    assert sorted((r.row, r.word, r.head, r.n) for r in debruijn.paths(pieces).collect()) == [(7, 0, 1, 4), (7, 4, 5, 3), (7, 64, 8, 1), (9, 0, 1, 1)]


def test_over_a_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    df = queries.op13_debruijn_dedup(spark, sf_dir)
    assert sorted(tuple(r) for r in df.collect()) == sorted((i, n, gone, hashlib.sha256(kept).hexdigest()) for i, n, gone, kept in slow_repeats(rows, 13))
    oracle.same(df, oracle.connect(sf_dir), queries.ORACLES["op13_debruijn_dedup"])
