"""The pipeline against a brute-force version of each stage, and on odd input."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import mixing, queries, toxicity
from tests.llm.test_operators import slow_components


def slow_mix(rows):
    """(doc_id, text, lang, source) rows that the calibrated probabilities keep."""
    form = ["note" if len(t) < 1000 else "piece" if len(t) < 5000 else "work" for _, t, _, _ in rows]
    tokens = [max(len(t.split()), 1) for _, t, _, _ in rows]
    cells: dict[tuple, float] = {}
    for (_, _, lang, source), f, n in zip(rows, form, tokens, strict=True):
        cells[source, lang, f] = cells.get((source, lang, f), 0) + n
    weight = dict(cells)
    total = sum(cells.values())
    for _ in range(10):
        for m, name in enumerate(("source", "lang", "topic")):
            natural: dict[str, float] = {}
            for c, n in cells.items():
                natural[c[m]] = natural.get(c[m], 0) + n
            raw = {v: (n / total) ** queries.MIX[name] for v, n in natural.items()}
            now: dict[str, float] = {}
            for c, w in weight.items():
                now[c[m]] = now.get(c[m], 0) + w
            weight = {c: w * raw[c[m]] / sum(raw.values()) / now[c[m]] for c, w in weight.items()}
    rate = {c: weight[c] / cells[c] for c in cells}
    most = max(rate.values())
    unit = lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:12], 16) / 2**48
    return [r for r, f in zip(rows, form, strict=True) if unit(r[0]) < round(min(rate[r[3], r[2], f] / most, 1.0), 9)]


def test_run_equals_brute_force(spark, sf_dir):
    import tiktoken

    docs = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    model = toxicity.learn(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"), ~queries.held_out())
    scores = toxicity.score_block(model, *toxicity.codes([t.encode() for _, t, _, _ in docs]))
    docs = [d for d, s in zip(docs, scores, strict=True) if s < queries.TOXIC_FROM]
    best: dict[bytes, int] = {}
    for i, t, _, _ in docs:
        best[t.encode().lower()] = max(best.get(t.encode().lower(), i), i)
    docs = [d for d in docs if best[d[1].encode().lower()] == d[0]]
    linked = {i: c for i, _, c in slow_components([d[:2] for d in docs], 5, 80, 100)}
    docs = [d for d in docs if linked[d[0]] == d[0]]
    docs = slow_mix(docs)
    vocabulary = queries._vocabulary()
    reference = tiktoken.Encoding("own", pat_str=vocabulary.pattern, mergeable_ranks=vocabulary.ranks, special_tokens={})
    want = {i: reference.encode_ordinary(t) for i, t, _, _ in docs}
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == want and len(want) > 20


def test_stages_keep_columns_and_odd_rows(spark, sf_dir):
    rows = [(1, "Same text here", "en", "s"), (2, "same TEXT here", "en", "s"), (2, "same TEXT here", "en", "s"), (3, None, None, None), (None, None, "de", "t"), (None, "alone and null", "de", "t"), (4, "", "en", None), (5, "x " * 30_000, "en", "s")]
    rows += [(10, " ".join(f"w{i}" for i in range(60)), "en", "s"), (11, " ".join(f"w{i}" for i in range(59)) + " end", "en", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({c: F.lit(1) for c in ("score", "tokens", "first", "digest", "n_chars", "rate", "selected", "probability", "key", "__id", "__hash", "__text", "body", "one", "a.dot")})
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, sf_dir)
        assert df.columns[:4] == ["doc_id", "text", "lang", "source"] and "probability" in df.columns and "score" in df.columns, name
        seen.append(sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=repr))
    assert len(seen[0]) == 10
    assert sorted((i for i, _ in seen[1]), key=repr) == sorted([2, 4, 5, 10, 11, None], key=repr)  # the empty texts are one group
    assert [i for i, _ in seen[2] if i in (10, 11)] == [10]
    tokens = corpus_pipeline.STAGES[-1][1](spark, df, sf_dir)
    assert tokens.columns == ["doc_id", "n_tokens", "ids"] and tokens.count() == df.count()


def test_empty_input(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").where("1 = 0")
    for _, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, sf_dir)
        assert df.count() == 0


@pytest.mark.parametrize("alphas", [queries.MIX, {"source": 0.0, "lang": 1.0, "topic": 1.0}])
def test_mixing_sql_names_all_margins(alphas):
    assert all(f"share_{m}" in mixing.oracle_sql(alphas) for m in mixing.MARGINS)


def test_mixing_keeps_the_corpus_beside_a_rare_source(spark, sf_dir):
    rows = [(i, "word " * 150, "en" if i % 3 else "de", f"s{i % 20}") for i in range(1200)]
    schema = "doc_id long, text string, lang string, source string"
    stay = lambda rs: {r.doc_id for r in corpus_pipeline.mixing_stage(spark, spark.createDataFrame(rs, schema), sf_dir).collect()}
    without, beside = stay(rows), stay([*rows, (-1, "", "en", None)])
    assert -1 in beside and len(beside - {-1}) >= 0.98 * len(without) > 1000
    by_size = [{r.doc_id: r.probability for r in mixing.with_probabilities(spark.createDataFrame([*rows, (-1, "", "en", None)], schema), queries.MIX, rare=mixing.RARE, most_cells=most).collect()} for most in (1000, 1)]
    assert by_size[0] == pytest.approx(by_size[1])
