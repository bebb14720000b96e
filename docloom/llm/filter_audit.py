"""Audit of how text filters act together, over every order in which they can run.

1. ``measure`` runs a byte transducer once over each whole text. Bytes are mapped
   to classes by a table; a second table gives, for (state, class), the next state
   and what the step puts out: a word opens, a word closes, a capital, a code
   point, a symbol. The next state depends on the class alone, so the states of a
   block are one lookup and its outputs another, for all bytes at a time. The word
   spans go into a hash table with open addressing; a span that meets another in
   its slot is compared with it byte by byte, so distinct words are exact.
2. ``audit`` turns the measures into one bit mask a row (which filters fail), adds
   the filter "identical to the text of a smaller id" from counts by text key,
   and sums the rows by part and mask. At most 2 ** filters sums a part then give
   every order and step, so the orders cost nothing a row.

Texts do not leave their task: a row leaves as its measures and the SHA-256 of its
text. Copies of one text meet as partial sums, never as rows.

Cases: null and empty texts have no words and are identical to each other; a null
part is the empty string; a null id is neither smaller nor larger than another, so
such a row never fails as a copy and makes no other fail; rows that repeat an id
with its text count as often as they stand, and none of them is a copy of the
other; rows of ``labels`` that repeat an id count once, with the larger mark;
texts of any length are read whole; an empty table gives no rows; only the named
columns are read, whatever the others are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence
from itertools import permutations
from math import factorial

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm import shared, text, words

#: Classes of bytes, states of the transducer and bits of its output.
SEPARATOR, CAPITAL, SYMBOL, PLAIN, CONTINUED = range(5)
OUTSIDE, INSIDE = range(2)
OPENS, CLOSES, IS_CAPITAL, IS_POINT, IS_SYMBOL = (1 << i for i in range(5))
#: Signs that count as symbols: a fixed value.
SYMBOLS = "#$%&*|"


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class of each byte, next state by class, output by state and class)."""
    classes = np.full(256, PLAIN, np.uint8)
    classes[list(words.SEPARATORS)] = SEPARATOR
    classes[ord("A") : ord("Z") + 1] = CAPITAL
    classes[[ord(c) for c in SYMBOLS]] = SYMBOL
    classes[0x80:0xC0] = CONTINUED
    after = np.array([OUTSIDE, INSIDE, INSIDE, INSIDE, INSIDE], np.uint8)
    out = np.zeros((2, 5), np.uint8)
    out[OUTSIDE, after == INSIDE] |= OPENS
    out[INSIDE, after == OUTSIDE] |= CLOSES
    out[:, [SEPARATOR, CAPITAL, SYMBOL, PLAIN]] |= IS_POINT
    out[:, CAPITAL] |= IS_CAPITAL
    out[:, SYMBOL] |= IS_SYMBOL
    return classes, after, out


def transduce(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """(first byte of every word, its end, {output bit: count of each text}) of texts that lie one after the other."""
    classes, after, out = _tables()
    cls = classes[data]
    before = np.empty(len(data), np.uint8)
    before[1:] = after[cls[:-1]]
    before[offsets[:-1][np.diff(offsets) > 0]] = OUTSIDE  # every text starts afresh
    put = out[before, cls]
    opened = np.flatnonzero(put & OPENS)
    ends = np.flatnonzero(put & CLOSES)
    last = offsets[1:][np.diff(offsets) > 0]
    ends = np.sort(np.concatenate([ends, last[after[cls[last - 1]] == INSIDE]]))  # a text's end closes its last word
    within = lambda marked: np.diff(np.searchsorted(np.flatnonzero(marked), offsets))
    counts = {bit: within(put & bit) for bit in (IS_CAPITAL, IS_SYMBOL)}
    counts[IS_POINT] = np.diff(offsets) - within((put & IS_POINT) == 0)  # few bytes continue a code point
    counts[OPENS] = np.diff(np.searchsorted(opened, offsets))
    return opened, ends, counts


def first_spans(eight: np.ndarray, begins: np.ndarray, sizes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Marks one span of each distinct (owner, bytes), by a hash table with linear probing and byte comparison."""
    n = len(begins)
    marked = np.zeros(n, bool)
    if n == 0:
        return marked
    keys = text.mix64(words.hashes(eight, begins, sizes) ^ owner.astype(np.uint64) * np.uint64(0x165667B19E3779F9))
    bits = max(4, (2 * n - 1).bit_length())
    slots = np.full(1 << bits, -1, np.int64)
    place = (keys >> np.uint64(64 - bits)).astype(np.int64)
    waiting = np.arange(n)
    while len(waiting):
        where = place[waiting]
        free = slots[where] < 0
        slots[where[free]] = waiting[free]  # of several, one stays; the others meet it now
        holder = slots[where]
        own = holder == waiting
        marked[waiting[own]] = True
        waiting, holder = waiting[~own], holder[~own]
        same = (keys[holder] == keys[waiting]) & (owner[holder] == owner[waiting]) & (sizes[holder] == sizes[waiting])
        some = np.flatnonzero(same)
        same[some] = words.equal_bytes(eight, begins[holder[some]], begins[waiting[some]], sizes[waiting[some]])
        waiting = waiting[~same]
        place[waiting] = place[waiting] + 1 & len(slots) - 1
    return marked


def _measures(block_bytes: int):
    def worker(keep: list[str], text_name: str):
        def run(batches):
            import pyarrow as pa

            for table in text.blocks(batches, block_bytes, text_name):
                data, offsets = text.utf8_bytes(table[text_name])
                opened, ends, counts = transduce(data, offsets)
                owner = np.searchsorted(offsets, opened, side="right") - 1
                first = first_spans(words.padded8(data), opened, ends - opened, owner)
                distinct = np.bincount(owner[first], minlength=len(table))
                raw = data.tobytes()
                keys = [hashlib.sha256(raw[i:j]).digest() for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
                measured = [counts[OPENS], distinct, counts[IS_CAPITAL], counts[IS_POINT], counts[IS_SYMBOL]]
                columns = [*(table[c].combine_chunks() for c in keep), *(pa.array(np.asarray(m, np.int64)) for m in measured), pa.array(keys, pa.binary())]
                yield pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns], [*keep, *(f"out{i}" for i in range(6))])

        return run

    return worker


#: What ``measure`` adds to a row.
MEASURES = {"n_words": "long", "n_distinct": "long", "n_capitals": "long", "n_points": "long", "n_symbols": "long", "text_key": "binary"}


def measure(df: DataFrame, keep: Sequence[str] = ("doc_id",), text_name: str = "text", block_bytes: int = 256 << 10) -> DataFrame:
    """Columns ``keep`` and words, distinct words, capitals, code points, symbols and the SHA-256 of each whole text.

    ``block_bytes`` of text share a hash table, which then stays in a core's cache; a longer text has a table of its own.
    """
    shared.bound_batches(df.sparkSession)
    return shared.map_texts(df, list(keep), text_name, _measures(block_bytes), **MEASURES)


def text_filters(least_words: int = 200, least_distinct: int = 50, most_capitals: int = 3) -> dict[str, Column]:
    """Conditions under which a measured text fails: words, percentage of distinct words, percentage of capitals, any symbol."""
    return {
        "A": F.col("n_words") < least_words,
        "B": 100 * F.col("n_distinct") < least_distinct * F.col("n_words"),
        "C": 100 * F.col("n_capitals") > most_capitals * F.col("n_points"),
        "D": F.col("n_symbols") > 0,
    }


def by_mask(rows: DataFrame, failures: Mapping[str, Column], labels: DataFrame, key: str = "text_key", id_name: str = "doc_id", part: str = "part") -> DataFrame:
    """(part, mask, n, good, toxic): rows by the set of filters that they fail.

    Bit i of a mask is the i-th of ``failures``; the bit after the last is the filter for copies.
    """
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(failures.values())), F.lit(0))
    lean = rows.select(F.col(id_name).alias("id"), F.col(key).alias("key"), F.coalesce(F.col(part), F.lit("")).alias("part"), mask.alias("mask"))
    counted = lean.groupBy("id", "key", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    marks = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    marked = counted.join(marks.hint("merge"), "id", "left").withColumn("good", F.coalesce(F.col("quality") == 1, F.lit(False))).withColumn("bad", F.coalesce(F.col("toxic") == 1, F.lit(False)))
    texts = marked.groupBy("key", "part", "mask", "good", "bad").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"), F.min("id").alias("least"), F.min_by("n", "id").alias("at_least")
    )  # an id stands once in such a group
    first = F.min("least").over(Window.partitionBy("key"))  # rows of a key: parts and labels, never documents
    originals = F.col("unnamed") + F.when(F.col("least") == first, F.col("at_least")).otherwise(0)
    copy = F.lit(1 << len(failures))
    told = texts.withColumn("originals", originals).select("part", "good", "bad", F.explode(F.array(F.struct("mask", F.col("originals").alias("n")), F.struct((F.col("mask") + copy).alias("mask"), (F.col("n") - F.col("originals")).alias("n")))).alias("x"))
    one = lambda c: F.sum(F.when(c, F.col("x.n")).otherwise(0))
    return told.groupBy("part", F.col("x.mask").alias("mask")).agg(F.sum("x.n").alias("n"), one(F.col("good")).alias("good"), one(F.col("bad")).alias("toxic"))


def audit(rows: DataFrame, failures: Mapping[str, Column], labels: DataFrame, copies: str = "E", **names: str) -> DataFrame:
    """One row per part, order of the filters and step; counts of rows as in the module's docstring.

    ``shapley`` is the filter's removed rows summed over all orders: a row that fails f filters is removed by each of
    them in one order of f.
    """
    letters = [*failures, copies]
    orders = []
    for order in permutations(letters):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << letters.index(letter)
            orders.append(f"struct('{''.join(order)}' as filter_order, {step} as step, {bit} as bit, {before} as before)")
            before |= bit
    sums = by_mask(rows, failures, labels, **names).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("sums"))
    steps = sums.withColumn("s", F.explode(F.expr(f"array({', '.join(orders)})")))

    def total(condition: str, value: str) -> Column:
        return F.expr(f"aggregate(filter(sums, x -> {condition}), 0L, (a, x) -> a + {value})")

    fails, spared = "x.mask & s.bit <> 0", "x.mask & s.before = 0"
    return steps.select(
        "part", "s.filter_order", "s.step",
        total("x.mask & (s.bit | s.before) = 0", "x.n").alias("kept"),
        total(f"{fails} and {spared}", "x.n").alias("removed"),
        total(f"{fails} and not {spared}", "x.n").alias("redundant"),
        total("x.mask = s.bit", "x.n").alias("unique_fails"),
        total(f"{fails} and {spared}", "x.good").alias("good_lost"),
        total(f"{fails} and {spared}", "x.toxic").alias("toxic_lost"),
        total(fails, f"x.n * cast({factorial(len(letters))} div bit_count(x.mask) as long)").alias("shapley"),
    )
