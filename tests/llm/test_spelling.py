"""Operator 12 against brute force, on odd rows and over whole tables."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docloom.llm import queries, shared, spelling
from tests import oracle

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow_counts(rows, damaged_one_in=None):
    out = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if damaged_one_in and h % damaged_one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return out


def one_apart(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def slow_variants(counts, letters=5, least=3):
    words = {w: n for w, n in counts.items() if len(w) >= letters and n >= least}
    masks = {}
    for w in words:
        for i in range(len(w)):
            masks.setdefault((w[:i], w[i + 1 :], 1), set()).add(w)
            masks.setdefault((w[:i], w[i + 1 :], 0), set())
    near = {w: set() for w in words}
    for w in words:
        for i in range(len(w)):
            near[w] |= masks[w[:i], w[i + 1 :], 1] - {w}
            shorter = w[:i] + w[i + 1 :]
            if shorter in words:
                near[w].add(shorter)
                near[shorter].add(w)
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return out


def got(df):
    rows = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_odd_rows(spark):
    long = "x" * 30 + "y" * 40
    texts = [None, "", "  ", "ÀÉÎ Ñandú ñandú NANDU nandu", "a" * 3000, "été-été'été 9word9word", long, long[:-1], long[1:], "z" + long[1:], long + "q", "w" * 12, "w" * 13, "w" * 11, "w" * 5 + "v" + "w" * 7, "é" * 70 + "a", "é" * 35 + "è" + "é" * 34 + "a", "×÷×÷× ÷×÷×÷"]
    rows = [(i, t) for i, t in enumerate(texts) for _ in range(3)] + [(None, "nullid nullid nullit nullid")] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for name in ("word", "n", "id", "run", "sum", "side", "node", "length"):
        df = df.withColumn(name, F.lit("x"))
    for damage in (None, 2):
        counts = spelling.count_words(df, damaged_one_in=damage)
        want = slow_counts(rows, damage)
        assert {r.word: r.n for r in counts.collect()} == want
        assert got(spelling.variants(counts, levels=12)) == slow_variants(want)
    assert spelling.variants(spelling.count_words(df.where("1 = 0"))).collect() == []
    assert got(spelling.variants(counts.where("length(word) > 48"))) == slow_variants({w: n for w, n in want.items() if len(w) > 48})
    assert "é" * 70 + "a" in {w for w, *_ in slow_variants(slow_counts(rows))}


@pytest.mark.parametrize("levels", [6, 48])
def test_dense_words_and_chains(spark, levels):
    """Few letters and few lengths, so that nearly all words are near others; ties of counts; chains of forms."""
    rng = random.Random(levels)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(1, 9))): 2 ** rng.randrange(9) for _ in range(500)}
    for i in range(8):  # each twice as frequent as the one before
        words["chain" + "b" * i + "c" * (7 - i)] = 3 << i
    counts = spark.createDataFrame(list(words.items()), "word string, n long")
    assert got(spelling.variants(counts, levels=levels)) == slow_variants(words)
    folder = shared.scratch(spark, "near")
    pairs = {(r.word, r.other, r.n, r.other_n) for r in spelling.near_words(counts, folder, levels).collect()}
    assert pairs == {(a, b, words[a], words[b]) for a in words for b in words if a != b and one_apart(a, b)}


def test_over_a_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    df = queries.op12_spelling_variants(spark, sf_dir)
    assert got(df) == slow_variants(slow_counts(rows, 97))
    oracle.same(df, oracle.connect(sf_dir), queries.ORACLES["op12_spelling_variants"])
