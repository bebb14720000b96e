"""Toxicity: a character n-gram linear classifier with naive Bayes scaled features.

Features are the hashed n-grams (4, 6 and 8 characters, lower-cased) present in
a text. From labelled texts come the log-count ratios r of each feature
(smoothed share among toxic texts over share among the others); a logistic
regression is then fitted on features scaled by r, and a text's score is
sigmoid(b + sum of w_j r_j over present features).

The classifier is fitted from a bounded sample: at most ``per_class`` labelled
texts of each class of at most ``longest`` bytes, the first by a hash of their
id. Workers count the features; the driver solves for at most ``features``
weights. Class weights undo the sampling. All texts of the
table are scored, whole, in blocks of bounded size; nothing is shuffled.

Cases: null and empty texts score the intercept; rows without a label or with a
null label are not learned from; an id with labels of both kinds counts as
toxic, and of several texts of one id the least is learned from; if a class has
no labelled text, every score is the smoothed share of the other; repeated rows
score alike; texts of any length are scored whole; empty tables give no rows;
other columns are carried, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import shared, text


@dataclass
class Model:
    bits: int
    orders: tuple[int, ...]
    weights: np.ndarray  # of 2**bits buckets, mostly zero
    intercept: float


def codes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of lower-cased texts, one after the other, offsets of n + 1)."""
    low = [(t or b"").decode("utf-8", "replace").lower() for t in texts]
    offsets = np.cumsum([0, *map(len, low)]).astype(np.int64)
    return np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), "<u4"), offsets


def ngrams(data: np.ndarray, offsets: np.ndarray, orders: tuple[int, ...], bits: int):
    """Per order: (text number, bucket) of every character n-gram inside a text."""
    owner = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    for n in orders:
        if len(data) < n:
            continue
        value = np.full(len(data) - n + 1, n, np.uint64)
        for j in range(n):
            value *= np.uint64(0x100000001B3)
            value += data[j : len(data) - n + 1 + j]
        inside = np.flatnonzero(owner[: len(owner) - n + 1] == owner[n - 1 :])
        yield owner[inside], (text.mix64(value[inside]) >> np.uint64(64 - bits)).astype(np.int32)


def _present(own: np.ndarray, bucket: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, bucket) pairs."""
    pairs = np.unique(own.astype(np.int64) << bits | bucket)
    return pairs >> bits, pairs & ((1 << bits) - 1)


def fit(present: list[np.ndarray], ratio: np.ndarray, toxic: np.ndarray, prior: float, rounds: int = 200, ridge: float = 10.0) -> tuple[np.ndarray, float]:
    """(weight of each feature, intercept) from the features present in each text, as numbers into ``ratio``.

    ``prior``: share of toxic texts among all labelled ones, before sampling.
    """
    y = np.asarray(toxic, np.float64)
    base = float(np.log(prior / (1 - prior)))
    row = np.repeat(np.arange(len(y), dtype=np.int32), [len(x) for x in present])
    col = np.concatenate(present).astype(np.int32)
    scaled = ratio.astype(np.float32)[col]
    positive = y.sum()
    share = np.where(y > 0, prior / positive, (1 - prior) / (len(y) - positive))  # weights that sum to 1
    w, b = np.zeros(len(ratio)), base
    first, second, first_b, second_b = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        margin = b + np.bincount(row, scaled * w[col], len(y))
        error = share * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y)
        slope = np.bincount(col, scaled * error[row], len(w)) + ridge / len(y) * w
        slope_b = float(error.sum())
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        first_b, second_b = 0.9 * first_b + 0.1 * slope_b, 0.99 * second_b + 0.01 * slope_b**2
        rate = 0.02 / (1 + t / 100)
        w -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
        b -= rate * (first_b / (1 - 0.9**t)) / (np.sqrt(second_b / (1 - 0.99**t)) + 1e-8)
    return w * ratio, float(b)


def _buckets(bodies: list[bytes], orders: tuple[int, ...], bits: int, some: int = 25):
    """(first text, text, bucket) of some texts at a time: every n-gram of a text once, so memory stays bounded."""
    for at in range(0, len(bodies), some):
        for own, bucket in ngrams(*codes(bodies[at : at + some]), orders, bits):
            own, bucket = _present(own, bucket, bits)
            yield own + at, bucket


def _count(orders: tuple[int, ...], bits: int):
    """Worker: in how many texts of each class a feature is present."""

    def run(batches):
        import pyarrow as pa

        ones, all_ = np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int32)
        for batch in batches:
            y = batch["y"].to_numpy()
            for own, bucket in _buckets(batch["body"].to_pylist(), orders, bits):
                np.add.at(all_, bucket, 1)
                np.add.at(ones, bucket, y[own].astype(np.int32))
        held = np.flatnonzero(all_)
        for at in range(0, len(held), 50_000):
            part = held[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(ones[part].astype(np.int64)), pa.array(all_[part].astype(np.int64))], ["bucket", "ones", "all"])

    return run


def _mark(chosen: np.ndarray, orders: tuple[int, ...], bits: int):
    """Worker: the chosen features that each text has."""

    def run(batches):
        import pyarrow as pa

        number = np.full(1 << bits, -1, np.int32)
        number[chosen] = np.arange(len(chosen))
        for batch in batches:
            bodies = batch["body"].to_pylist()
            held: list[list[np.ndarray]] = [[] for _ in bodies]
            for own, bucket in _buckets(bodies, orders, bits):
                found = number[bucket]
                own, found = own[found >= 0], found[found >= 0]
                for t, part in zip(np.unique(own).tolist(), np.split(found, np.flatnonzero(np.diff(own)) + 1), strict=False):
                    held[t].append(part)
            marks = [np.concatenate(h).astype("<i4").tobytes() if h else b"" for h in held]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["y"], pa.array(marks, pa.binary())], ["doc_id", "y", "marks"])

    return run


def score_block(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.full(len(offsets) - 1, model.intercept)
    for own, bucket in ngrams(data, offsets, model.orders, model.bits):
        held = np.flatnonzero(model.weights[bucket])
        own, bucket = _present(own[held], bucket[held], model.bits)
        total += np.bincount(own, model.weights[bucket], len(total))
    return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def _score(model, columns: list[str], text_name: str, block_bytes: int):
    def run(batches):
        import pyarrow as pa

        for table in text.blocks(batches, block_bytes, text_name):
            found = score_block(model.value, *codes(table[text_name].cast(pa.large_binary()).to_pylist()))
            yield from table.select(columns).append_column("out0", pa.array(found, pa.float64())).to_batches()

    return run


def score(df: DataFrame, model: Model, keep: list[str], text_name: str = "text", out: str = "score", block_bytes: int = 1 << 19) -> DataFrame:
    """Columns ``keep`` and the score of every row; a column of the score's name is replaced."""
    shared.bound_batches(df.sparkSession)
    keep = [c for c in keep if c != out]
    known = df.sparkSession.sparkContext.broadcast(model)
    return shared.map_texts(df, keep, text_name, lambda columns, body: _score(known, columns, body, block_bytes), **{out: "double"})


def learn(
    docs: DataFrame, labels: DataFrame, usable, per_class: int = 5000, longest: int = 20_000, bits: int = 20, orders: tuple[int, ...] = (4, 6, 8), features: int = 1 << 12, smooth: float = 1.0
) -> Model:
    """Fit from the labelled rows for which the column ``usable`` (of doc_id) holds.

    Texts stay on the workers: they count the features there, and the driver gets
    the chosen features and, for each sampled text, which of them it has.
    """
    spark = docs.sparkSession
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & usable).groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("y"))
    counts = {r["y"]: r["count"] for r in marked.groupBy("y").count().collect()}
    total = sum(counts.values())
    prior = min(max((counts.get(1, 0) + 0.5) / (total + 1), 1e-4), 1 - 1e-4)
    nothing = Model(bits, orders, np.zeros(1 << bits, np.float32), float(np.log(prior / (1 - prior))))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = marked.where("y = 1").orderBy(*order).limit(per_class).unionByName(marked.where("y = 0").orderBy(*order).limit(per_class))
    texts = docs.where(F.octet_length("text") <= longest).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("body"))
    once = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("y").alias("y"), F.min("body").alias("body"))  # at most 2 x per_class ids are broadcast
    shared.bound_batches(spark)
    sample = shared.written(once, f"{shared.scratch(spark, 'toxic')}/sample")
    seen = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    positive, negative = seen.get(1, 0), seen.get(0, 0)
    if not positive or not negative:
        return nothing
    counted = sample.select("y", "body").mapInArrow(shared.tidy(_count(orders, bits)), "bucket int, ones long, all long").groupBy("bucket").agg(F.sum("ones").alias("p"), F.sum("all").alias("n")).where("n >= 3")
    ratio = F.log((F.col("p") + smooth) / (positive + 2 * smooth)) - F.log((F.col("n") - F.col("p") + smooth) / (negative + 2 * smooth))
    telling = counted.select("bucket", ratio.alias("ratio"), (F.abs(ratio) * F.sqrt("n")).alias("telling")).where("telling > 0")
    best = sorted((r["bucket"], r["ratio"]) for r in telling.orderBy(F.desc("telling"), "bucket").limit(features).collect())
    if not best:
        return nothing
    buckets, ratios = np.array([b for b, _ in best]), np.array([r for _, r in best])
    got = sample.mapInArrow(shared.tidy(_mark(buckets, orders, bits)), "doc_id long, y int, marks binary").orderBy("doc_id").select("y", "marks").collect()
    present = [np.frombuffer(r["marks"], "<i4") for r in got]
    weight, intercept = fit(present, ratios, np.array([r["y"] for r in got]), prior)
    weights = np.zeros(1 << bits, np.float32)
    weights[buckets] = weight
    return Model(bits, orders, weights, intercept)
