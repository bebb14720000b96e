"""Models as functions of Spark: encoders and scorers that the caller supplies, and table functions for SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def embedder(encode: Callable[[Sequence[str]], Sequence[Sequence[float]]], batch: int = 100) -> Callable[[Column], Column]:
    """Column function text -> vector; ``encode`` gets lists of at most ``batch`` texts; null texts stay null."""

    @F.pandas_udf("array<double>")
    def run(texts):
        import pandas as pd

        out: list = [None] * len(texts)
        held = [i for i, t in enumerate(texts) if t is not None]
        for at in range(0, len(held), batch):
            some = held[at : at + batch]
            for i, v in zip(some, encode([texts.iloc[i] for i in some]), strict=True):
                out[i] = [float(x) for x in v]
        return pd.Series(out, index=texts.index)

    return run


def scorer(score: Callable[[Sequence[tuple[str, str]]], Sequence[float]], batch: int = 100) -> Callable[[Column, Column], Column]:
    """Column function (query, passage) -> score of a pair model."""

    @F.pandas_udf("double")
    def run(queries, passages):
        import pandas as pd

        pairs = list(zip(queries.fillna(""), passages.fillna(""), strict=True))
        out: list[float] = []
        for at in range(0, len(pairs), batch):
            out += [float(x) for x in score(pairs[at : at + batch])]
        return pd.Series(out, index=queries.index)

    return run


def register_embedder(spark: SparkSession, name: str, encode, batch: int = 100) -> None:
    spark.udf.register(name, embedder(encode, batch))


def register_scorer(spark: SparkSession, name: str, score, batch: int = 100) -> None:
    spark.udf.register(name, scorer(score, batch))


def register_table_functions(spark: SparkSession) -> None:
    """SQL table functions: segment_paragraphs(text), parse_sections(html), plan_chunks(text, most).

    They take one text a call; for whole tables use the operators, which work on batches.
    """
    import re

    from docloom.functions.text import NOTICE, PAGE_MARK, PARAGRAPH_GAP
    from docloom.operators import paragraphs, triage

    @F.udtf(returnType=paragraphs.SPANS, useArrow=False)
    class Segments:
        def eval(self, text):
            yield from paragraphs.segment_text(text or "")[2]

    @F.udtf(returnType="number int, body string", useArrow=False)
    class Sections:
        def eval(self, page):
            for i, part in enumerate(re.split(r"<(?:p|h1|li)>", page or "")[1:], 1):
                body = " ".join(re.sub(r"<[^>]*>", " ", part).split())
                if len(body) >= 20:
                    yield i, body

    @F.udtf(returnType="chunk int, first_token int, last_token int, chars int", useArrow=False)
    class Chunks:
        def eval(self, text, most: int):
            pieces = [x for part in re.split(PAGE_MARK, text or "") for x in ([part] if re.fullmatch(PAGE_MARK, part) else re.split(PARAGRAPH_GAP, part)) if x]
            hindi = [sum(c.isalpha() and "ऀ" <= c <= "ॿ" for c in x) for x in pieces]
            wanted = [n >= max(10, 0.3 * sum(map(str.isalpha, x))) and not re.match(NOTICE, x) for n, x in zip(hindi, pieces, strict=True)]
            kinds = [1 if w else 2 if not x.strip() else 0 for w, x in zip(wanted, pieces, strict=True)]
            for chunk, part in enumerate(triage.cut_runs(kinds, list(map(len, pieces)), most)):
                yield chunk, *part

    spark.udtf.register("segment_paragraphs", Segments)
    spark.udtf.register("parse_sections", Sections)
    spark.udtf.register("plan_chunks", Chunks)
