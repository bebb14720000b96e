"""Mixing sources to target weights by iterative proportional fitting.

The token counts of all documents are summed into cells of source x language x
topic (partial sums first, so a source holding a third of the rows costs no
more than any other). The cell table is raked: its weights are scaled to the
target share of every source, then language, then topic, in turn, for a fixed
number of sweeps. The raked over the actual tokens of a cell is the rate at
which its documents should count; divided by the largest rate it is the
probability with which a document is kept, decided by a hash of its id, so
the expected tokens have the target marginals.

A rate is a product of one factor for each value, and a rare value (one row
without a source) has so large a factor that the plain form thins all other
cells for it. With ``rare`` above 0, the smallest values of a margin, together
holding at most that share of its tokens, do not set the scale: the budget is
the largest one that the cells of the other values allow, cells of rare values
that would need more than all of their documents are kept whole, and the rest is
raked again to what is left of each share, until no cell is above 1.

A target is a map from value to share (missing values get no weight) or an
exponent a: share in proportion to (corpus share) ** a, so 1 keeps and 0
levels the corpus. Cells up to ``most_cells`` are raked on the driver; a larger
table is raked by DataFrame aggregations of the same arithmetic.

Cases: null source, language or topic is a value of its own, written '';
texts without tokens count as one token, so they have a rate too; rows of the
same id are kept or dropped together; a text of any length counts whole; an empty
table gives no rows; existing columns of the names added here are replaced, and
a column named topic is read as the topic.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm import shared

MARGINS = ("source", "lang", "topic")
ADDED = ("topic", "tokens", "rate", "probability", "selected")
#: Share of the tokens of a margin that its rare values may hold together.
RARE = 0.01


def words(text: Column) -> Column:
    """Number of words of a text, 1 at least."""
    return F.greatest(F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^ \t\n\r\f\x0B]+")), F.lit(1)).cast("long")


def form_of(text: Column) -> Column:
    """Stand-in topic where the table has none: the form of a text by its length."""
    n = F.char_length(F.coalesce(text, F.lit("")))
    return F.when(n < 1000, "note").when(n < 5000, "piece").otherwise("work")


def unit(key: Column) -> Column:
    """Uniform number in [0, 1) from a key."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(2.0**48)


def goal(tokens: dict[str, float], target: dict[str, float] | float) -> dict[str, float]:
    """Share of each value."""
    total = sum(tokens.values())
    raw = {v: (t / total) ** target for v, t in tokens.items()} if isinstance(target, (int, float)) else {v: float(target.get(v, 0.0)) for v in tokens}
    whole = sum(raw.values())
    if whole <= 0:
        raise ValueError("the targets give no weight to any value present")
    return {v: r / whole for v, r in raw.items()}


def rake(cells: np.ndarray, codes: list[np.ndarray], shares: list[np.ndarray], sweeps: int) -> np.ndarray:
    """Weights of the cells after the sweeps."""
    weight = cells.astype(np.float64)
    for _ in range(sweeps):
        for code, share in zip(codes, shares, strict=True):
            now = np.bincount(code, weight, len(share))
            weight = weight * np.divide(share, now, out=np.zeros_like(share), where=now > 0)[code]
    return weight


def rare_below(held: dict[int, float], rare: float) -> int:
    """Bits from which a value counts as large: those with fewer hold at most this share; held is the tokens of all values by the bits of their number."""
    seen, whole = 0.0, sum(held.values())
    for bits in sorted(held):
        seen += held[bits]
        if seen > rare * whole:
            return bits
    return 0


def bound(cells: np.ndarray, codes: list[np.ndarray], shares: list[np.ndarray], sweeps: int, rare: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Rate of each cell, whether it is kept whole, and the rate that stands for probability 1."""
    rate, whole, small = rake(cells, codes, shares, sweeps) / cells, np.zeros(len(cells), bool), np.zeros(len(cells), bool)
    for code, share in zip(codes, shares, strict=True):
        sums = np.bincount(code, cells, len(share))
        bits = np.frexp(sums)[1]
        small |= (bits < rare_below({int(b): float(sums[bits == b].sum()) for b in np.unique(bits)}, rare))[code]
    while True:
        most = float(rate[~small].max(initial=0.0)) or float(rate.max(initial=0.0)) or 1.0
        over = small & ~whole & (rate > most)
        if not over.any():
            return rate, whole, most
        budget = (rate * cells)[~whole].sum() / most + cells[whole].sum()
        whole |= over
        left = []
        for code, share in zip(codes, shares, strict=True):
            free = np.bincount(code[~whole], minlength=len(share)) > 0
            rest = np.where(free, np.maximum(share * budget - np.bincount(code, cells * whole, len(share)), 0.0), 0.0)
            left.append(rest / rest.sum())
        rate[~whole] = rake(cells[~whole], [c[~whole] for c in codes], left, sweeps) / cells[~whole]


def _rake_frames(cells: DataFrame, shares: dict[str, DataFrame], sweeps: int, folder: str) -> DataFrame:
    """The same over a cell table of any size; each sweep is written to the shared folder."""
    now = cells.withColumn("weight", F.col("tokens").cast("double"))
    for sweep in range(sweeps):
        for margin in MARGINS:
            sums = now.groupBy(margin).agg(F.sum("weight").alias("held")).join(shares[margin], margin)
            scale = sums.select(margin, F.when(F.col("held") > 0, F.col("share") / F.col("held")).otherwise(0.0).alias("scale"))
            now = now.join(scale, margin).withColumn("weight", F.col("weight") * F.col("scale")).drop("scale")
        now = shared.written(now, f"{folder}/sweep-{sweep}")
    return now


def _bound_frames(cells: DataFrame, shares: dict[str, DataFrame], sweeps: int, rare: float, folder: str) -> tuple[DataFrame, float]:
    """bound() over a cell table of any size."""
    now = _rake_frames(cells, shares, sweeps, folder).withColumns({"whole": F.lit(False), "small": F.lit(False), "rate": F.col("weight") / F.col("tokens")})
    for m in MARGINS if rare else ():
        sums = cells.groupBy(m).agg(F.sum("tokens").alias("t")).withColumn("bits", F.length(F.bin("t")))
        floor = rare_below({r["bits"]: float(r["t"]) for r in sums.groupBy("bits").agg(F.sum("t").alias("t")).collect()}, rare)
        now = now.join(sums.select(m, "bits"), m).withColumn("small", F.col("small") | (F.col("bits") < floor)).drop("bits")
    at = 0
    while True:
        now = shared.written(now, f"{folder}/bound-{at}")
        large, most = now.agg(F.max(F.when(~F.col("small"), F.col("rate"))), F.max("rate")).first()
        most = large or most or 1.0
        over = F.col("small") & ~F.col("whole") & (F.col("rate") > most)
        if not rare or now.where(over).isEmpty():
            return now, float(most)
        free, held = now.agg(F.sum(F.when(~F.col("whole"), F.col("rate") * F.col("tokens"))), F.sum(F.when(F.col("whole"), F.col("tokens")))).first()
        budget = (free or 0.0) / most + (held or 0)
        now = now.withColumn("whole", F.col("whole") | over)
        left = {}
        for m in MARGINS:
            sums = now.groupBy(m).agg(F.sum(F.when(F.col("whole"), F.col("tokens")).otherwise(0)).alias("held"), F.max(~F.col("whole")).alias("free")).where("free").join(shares[m], m)
            rest = sums.select(m, F.greatest(F.col("share") * F.lit(budget) - F.col("held"), F.lit(0.0)).alias("rest"))
            total = rest.agg(F.sum("rest")).first()[0]
            left[m] = rest.select(m, (F.col("rest") / F.lit(total)).alias("share"))
        again = _rake_frames(now.where(~F.col("whole")).drop("weight"), left, sweeps, f"{folder}/again-{at}").withColumn("rate", F.col("weight") / F.col("tokens"))
        now, at = now.where("whole").unionByName(again), at + 1


def with_probabilities(df: DataFrame, targets: dict[str, dict[str, float] | float], sweeps: int = 10, key: str = "doc_id", text: str = "text", most_cells: int = 100_000, rare: float = 0.0) -> DataFrame:
    """All rows with topic, tokens, rate, probability and selected."""
    spark = df.sparkSession
    topic = F.coalesce(F.col("topic").cast("string"), F.lit("")) if "topic" in df.columns else form_of(F.col(text))
    base = df.drop(*[c for c in ADDED if c != "topic"]).withColumn("topic", topic).withColumn("tokens", words(F.col(text)))
    named = [F.coalesce(F.col(m).cast("string"), F.lit("")).alias(m) for m in MARGINS]
    folder = shared.scratch(spark, "mix")
    cells = shared.written(base.select(*named, "tokens").groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")), f"{folder}/cells")
    if cells.count() <= most_cells:
        held = cells.orderBy(*MARGINS).toPandas()
        codes, shares = [], []
        for m in MARGINS:
            values, code = np.unique(held[m].to_numpy(str), return_inverse=True)
            tokens = np.bincount(code, held["tokens"], len(values))
            wanted = goal(dict(zip(values.tolist(), tokens.tolist(), strict=True)), targets[m]) if len(values) else {}
            codes.append(code)
            shares.append(np.array([wanted[v] for v in values.tolist()]))
        held["rate"], held["whole"], most = bound(held["tokens"].to_numpy(), codes, shares, sweeps, rare) if len(held) else ([], [], 1.0)
        rates = spark.createDataFrame(held[[*MARGINS, "rate", "whole"]], "source string, lang string, topic string, rate double, whole boolean")
        rates = F.broadcast(rates)  # at most most_cells rows
    else:
        shares_of = {}
        for m in MARGINS:
            sums = cells.groupBy(m).agg(F.sum("tokens").cast("double").alias("t"))
            target = targets[m]
            if isinstance(target, (int, float)):
                total = sums.agg(F.sum("t")).first()[0]
                raw = sums.select(m, F.pow(F.col("t") / F.lit(total), F.lit(float(target))).alias("raw"))
            else:
                given = spark.createDataFrame([(k, float(v)) for k, v in target.items()], f"{m} string, raw double")
                raw = sums.select(m).join(given, m, "left").select(m, F.coalesce("raw", F.lit(0.0)).alias("raw"))
            whole = raw.agg(F.sum("raw")).first()[0]
            shares_of[m] = raw.select(m, (F.col("raw") / F.lit(whole)).alias("share"))
        found, most = _bound_frames(cells, shares_of, sweeps, rare, folder)
        rates = found.select(*MARGINS, "rate", "whole")
    match = [F.coalesce(F.col(f"d.{m}").cast("string"), F.lit("")) == F.col(f"r.{m}") for m in MARGINS]
    joined = base.alias("d").join(rates.alias("r"), match).select("d.*", "r.rate", F.when(F.col("r.whole"), 1.0).otherwise(F.least(F.col("r.rate") / F.lit(most), F.lit(1.0))).alias("probability"))
    return joined.withColumn("selected", unit(F.col(key)) < F.round("probability", 9))


def oracle_sql(alphas: dict[str, float], sweeps: int = 10) -> str:
    """DuckDB SQL of with_probabilities(documents) for exponent targets."""
    steps = [
        """WITH base AS MATERIALIZED (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
             CASE WHEN length(coalesce(text, '')) < 1000 THEN 'note' WHEN length(coalesce(text, '')) < 5000 THEN 'piece' ELSE 'work' END AS topic,
             greatest(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r\\f\\x0B]+')), 1)::BIGINT AS tokens FROM documents)""",
        "cells AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM base GROUP BY ALL)",
    ]
    for m, a in alphas.items():
        steps.append(f"raw_{m} AS MATERIALIZED (SELECT {m}, pow(sum(tokens) / (SELECT sum(tokens) FROM cells), {a}) AS raw FROM cells GROUP BY {m})")
        steps.append(f"share_{m} AS MATERIALIZED (SELECT {m}, raw / (SELECT sum(raw) FROM raw_{m}) AS share FROM raw_{m})")
    last = "(SELECT source, lang, topic, tokens, tokens AS weight FROM cells)"
    for sweep in range(sweeps):
        for m in alphas:
            name = f"w{sweep}_{m}"
            steps.append(f"{name} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, c.tokens, c.weight * s.share / sum(c.weight) OVER (PARTITION BY c.{m}) AS weight FROM {last} c JOIN share_{m} s USING ({m}))")
            last = name
    steps.append(f"rates AS MATERIALIZED (SELECT source, lang, topic, weight / tokens AS rate FROM {last})")
    return ",\n".join(steps) + """
        SELECT doc_id, source, lang, topic, tokens, round(least(rate / (SELECT max(rate) FROM rates), 1.0), 6) AS probability,
               ('0x' || substr(md5(doc_id::VARCHAR), 1, 12))::BIGINT::DOUBLE / pow(2, 48) < round(least(rate / (SELECT max(rate) FROM rates), 1.0), 9) AS selected
        FROM base JOIN rates USING (source, lang, topic)"""
