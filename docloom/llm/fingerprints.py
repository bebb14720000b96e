"""Document fingerprints by Order MinHash, sensitive to edit distance.

Every k-mer (8 bytes) of a text is numbered by its occurrence, so repeats are
different elements. Each of ``slots`` hash functions picks the ``ell`` elements
of smallest hash, keeps them in text order and hashes the tuple of their k-mers
to 32 bits. Two texts agree in a slot only if they share the picked k-mers in
the same order, so likeness (the share of equal slots) falls with both missing
content and moved content.

All texts of a block are hashed together in flat arrays: a cut-off in
proportion to 1 / n leaves about a dozen candidates a text and slot; texts with
too few of them are redone in full, so the pick is exact.

Cases: null texts are empty; texts shorter than k are one padded element;
all empty texts share one fingerprint; equal texts and repeated rows have equal
fingerprints wherever they stand; a very long text is done by itself, a class of
its k-mers at a time; an empty table gives no rows; other columns are carried
(an existing fingerprint column is replaced).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm import shared, text

K = 8


#: k-mers of a text from which it is done by itself, in classes of its k-mers.
LONG = 1 << 23


def order_minhash(data: np.ndarray, offsets: np.ndarray, slots: int = 32, ell: int = 2, likely: float = 12.0, long: int = LONG) -> np.ndarray:
    """uint32 matrix (texts x slots)."""
    n_texts = len(offsets) - 1
    out = np.empty((n_texts, slots), np.uint32)
    factors = text.mix64(np.arange(1, slots + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)
    large = np.flatnonzero(np.diff(offsets) >= long + K)
    start = 0
    for t in [*large.tolist(), n_texts]:
        if start < t:
            low = offsets[start]
            out[start:t] = _short_texts(data[low : offsets[t]], offsets[start : t + 1] - low, factors, ell, likely)
        if t < n_texts:
            out[t] = _long_text(data[offsets[t] : offsets[t + 1]], factors, ell, long)
        start = t + 1
    return out


def _numbered(grams: np.ndarray, owner: np.ndarray | None) -> np.ndarray:
    """Elements: k-mers mixed with the number of their occurrence in their text; grams stand in text order."""
    where = None
    if len(grams) <= 1 << 28:  # a hash's leading bits and the place in one number sort fastest
        low = np.uint64((1 << 28) - 1)
        packed = np.sort((grams & ~low) | np.arange(len(grams), dtype=np.uint64))
        where = (packed & low).astype(np.int64)
        packed >>= np.uint64(28)
        full = grams[where]
        if ((packed[1:] == packed[:-1]) & (full[1:] != full[:-1])).any():
            where = None  # two k-mers share those bits
    if where is None:
        where = np.argsort(grams, kind="stable")
        full = grams[where]
    fresh = np.ones(len(full), bool)
    fresh[1:] = full[1:] != full[:-1]
    if owner is not None:
        fresh[1:] |= owner[where[1:]] != owner[where[:-1]]
    starts = np.flatnonzero(fresh)
    times = np.arange(len(full)) - np.repeat(starts, np.diff(np.r_[starts, len(full)]))
    again = np.flatnonzero(times)
    elements = grams.copy()
    elements[where[again]] = text.mix64(full[again] + times[again].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return elements


def _short_texts(data: np.ndarray, offsets: np.ndarray, factors: np.ndarray, ell: int, likely: float) -> np.ndarray:
    n_texts, slots = len(offsets) - 1, len(factors)
    lengths = np.diff(offsets)
    short = np.flatnonzero(lengths < K)
    pieces = []
    owner = np.repeat(np.arange(n_texts, dtype=np.int64), lengths)
    grams = text.grams8(data)
    if len(grams):
        at = np.flatnonzero(owner[: len(grams)] == owner[K - 1 :])
        grams, owner = grams[at], owner[at]
    else:
        owner = owner[:0]
    for t in short:
        raw = data[offsets[t] : offsets[t + 1]].tobytes()
        pieces.append(int.from_bytes(raw.ljust(K, b"\0"), "little") + (len(raw) + 1 << 56))
    if len(short):
        order = np.argsort(np.concatenate([owner, short]), kind="stable")
        grams = np.concatenate([grams, np.array(pieces, np.uint64)])[order]
        owner = np.concatenate([owner, short])[order]
    grams = text.mix64(grams)
    elements = _numbered(grams, owner)
    counts = np.bincount(owner, minlength=n_texts)
    begins = np.cumsum(counts) - counts
    share = np.minimum(likely / counts, 1.0)
    cut = np.where(share >= 1, np.uint64(2**64 - 1), (share * 2.0**63).astype(np.uint64) << np.uint64(1))
    cuts = np.repeat(cut, counts)
    wanted = np.minimum(counts, ell)
    out = np.empty((n_texts, slots), np.uint32)
    value = np.empty_like(elements)
    for s in range(slots):
        np.multiply(elements, factors[s], out=value)
        few = np.flatnonzero(value <= cuts)
        own, some = owner[few], value[few]
        got = np.bincount(own, minlength=n_texts)
        for t in np.flatnonzero(got < wanted):  # rare: all elements of these texts
            extra = np.arange(begins[t], begins[t] + counts[t])
            keep = own != t
            few, own, some = np.r_[few[keep], extra], np.r_[own[keep], owner[extra]], np.r_[some[keep], value[extra]]
        order = np.lexsort((few, some, own))
        own, few = own[order], few[order]
        rank = np.arange(len(own)) - np.searchsorted(own, own)
        chosen = rank < ell
        own, few = own[chosen], few[chosen]
        order = np.lexsort((few, own))
        own, few = own[order], few[order]
        rank = np.arange(len(own)) - np.searchsorted(own, own)
        mark = np.zeros(n_texts, np.uint64)
        for j in range(ell):
            now = rank == j
            mark[own[now]] = mark[own[now]] * np.uint64(0x100000001B3) + grams[few[now]] + np.uint64(j)
            mark = text.mix64(mark)
        out[:, s] = mark >> np.uint64(32)
    return out


def _long_text(data: np.ndarray, factors: np.ndarray, ell: int, most: int) -> np.ndarray:
    """Marks of one text of any length: its k-mers are numbered class by class (by their hash), so few are held at a time."""
    n = len(data) - K + 1
    classes = -(-n // most) * 2
    best: list[list[tuple[int, int, int]]] = [[] for _ in factors]  # (value, place, k-mer)
    for c in range(classes):
        held, places = [], []
        for low in range(0, n, most):
            grams = text.mix64(text.grams8(data[low : min(low + most, n) + K - 1]))
            at = np.flatnonzero(grams % np.uint64(classes) == np.uint64(c))
            held.append(grams[at])
            places.append(at + low)
        grams, where = np.concatenate(held), np.concatenate(places)
        elements = _numbered(grams, None)
        for s, factor in enumerate(factors):
            value = elements * factor
            few = np.argpartition(value, ell - 1)[:ell] if len(value) > ell else np.arange(len(value))
            if len(few):
                few = np.flatnonzero(value <= value[few].max())
            best[s] = sorted([*best[s], *zip(value[few].tolist(), where[few].tolist(), grams[few].tolist(), strict=True)])[:ell]
    out = np.empty(len(factors), np.uint32)
    for s, found in enumerate(best):
        mark = np.zeros(1, np.uint64)
        for j, (_, _, gram) in enumerate(sorted(found, key=lambda x: x[1])):
            mark = text.mix64(mark * np.uint64(0x100000001B3) + np.uint64(gram) + np.uint64(j))
        out[s] = mark[0] >> np.uint64(32)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal slots, row by row."""
    return (a == b).mean(axis=1)


def _fingerprint(text_name: str, out: str, slots: int, ell: int, block_bytes: int):
    def run(batches):
        import pyarrow as pa

        for table in text.blocks(batches, block_bytes, text_name):
            found = order_minhash(*text.utf8_bytes(table[text_name]), slots, ell).astype("<u4")
            yield from table.append_column(out, pa.array([row.tobytes() for row in found], pa.binary())).to_batches()

    return run


def fingerprint(df: DataFrame, text_name: str = "text", out: str = "fingerprint", slots: int = 32, ell: int = 2, block_bytes: int = 1 << 18) -> DataFrame:
    """Adds a binary column of slots x 4 bytes."""
    shared.bound_batches(df.sparkSession)
    df = df.drop(out)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{out}` binary"])
    return df.mapInArrow(shared.tidy(_fingerprint(text_name, out, slots, ell, block_bytes)), schema)


def _likeness(pairs: list[tuple[str, str, str]], drop: list[str]):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            table = pa.Table.from_batches([batch])
            for a, b, out in pairs:
                left, right = (np.frombuffer(b"".join(table[c].to_pylist()), "<u4").reshape(table.num_rows, -1) for c in (a, b))
                table = table.append_column(out, pa.array(likeness(left, right) if table.num_rows else [], pa.float64()))
            yield from table.drop_columns(drop).to_batches() if drop else table.to_batches()

    return run


def with_likeness(df: DataFrame, pairs: list[tuple[str, str, str]]) -> DataFrame:
    """Adds the likeness of pairs of fingerprint columns: (first, second, name)."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *(f"`{p[2]}` double" for p in pairs)])
    return df.mapInArrow(shared.tidy(_likeness(pairs, [])), schema)


LEAST = -(1 << 63)
Splits = tuple[np.ndarray, np.ndarray]


def _range_of(splits: Splits, ids: np.ndarray, ties: np.ndarray) -> np.ndarray:
    """Number of the range of each (id, tie): how many splits are not above it."""
    keys, at = splits
    low, high = np.searchsorted(keys, ids, side="left"), np.searchsorted(keys, ids, side="right")
    for k in np.unique(ids[high > low]):
        rows = np.flatnonzero(ids == k)
        i, j = low[rows[0]], high[rows[0]]
        high[rows] = i + np.searchsorted(at[i:j], ties[rows], side="right")
    return high


def _split_points(found: list[int]) -> Splits:
    """Range borders from quantiles of the ids; an id that fills several ranges is cut evenly by its tie (a hash)."""
    keys, times = np.unique(np.array(found, np.int64), return_counts=True)
    at = [LEAST + (j << 64) // n for n in times.tolist() for j in range(n)]
    return np.repeat(keys, times), np.array(at, np.int64)


def _first_rows(splits: Splits):
    def run(batches):
        import pyarrow as pa

        first: dict[int, tuple[int, int]] = {}
        for batch in batches:
            ids, ties = (batch[c].to_numpy(zero_copy_only=False) for c in ("k", "t"))
            ranges = _range_of(splits, ids, ties)
            order = np.lexsort((ties, ids, ranges))
            ranges, ids, ties = ranges[order], ids[order], ties[order]
            for i in np.flatnonzero(np.r_[True, ranges[1:] != ranges[:-1]]).tolist() if len(ranges) else []:
                row = (int(ids[i]), int(ties[i]))
                first[int(ranges[i])] = min(first.get(int(ranges[i]), row), row)
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in ((b, *row) for b, row in first.items())], pa.int64()) for i in range(3)], ["b", "k", "t"])

    return run


def _deal(splits: Splits, ghosts: dict[tuple[int, int], int]):
    """Worker: add the range's number; the first rows of a range also go, as ghosts, to the range before."""

    def run(batches):
        import pyarrow as pa

        keys = np.array(sorted({k for k, _ in ghosts}), np.int64)
        for batch in batches:
            table = pa.Table.from_batches([batch])
            ids, ties = table["k"].to_numpy(), table["t"].to_numpy()
            ranges = _range_of(splits, ids, ties)
            yield from table.append_column("b", pa.array(ranges, pa.int64())).append_column("ghost", pa.array(np.zeros(len(ids), bool))).to_batches()
            firsts = [i for i in np.flatnonzero(np.isin(ids, keys)).tolist() if (int(ids[i]), int(ties[i])) in ghosts]
            if firsts:
                target = [ghosts[int(ids[i]), int(ties[i])] for i in firsts]
                yield from table.take(firsts).append_column("b", pa.array(target, pa.int64())).append_column("ghost", pa.array(np.ones(len(firsts), bool))).to_batches()

    return run


def with_next(df: DataFrame, id_name: str, tie: str, columns: list[str], prepare=None, rows_per_range: int = 4096, most_ranges: int = 200_000) -> DataFrame:
    """Adds next_<column> from the next row in id order (after the last row: the first).

    Ids are cut into ranges, one window partition each; the first row of every
    range also goes to the range before, so no task sees the whole order. The
    driver holds one row's id and tie for each range; over ``most_ranges`` x
    ``rows_per_range`` rows the ranges grow instead, and their sorts spill. A null
    id comes first; rows of equal id are ordered by ``tie`` (a hash), and an id of
    very many rows is cut into ranges by it. ``prepare`` may add costly columns;
    it runs once on the rows that are dealt. Names that start with two
    underscores are taken.
    """
    names = df.columns
    inner = {n: f"__{i}" for i, n in enumerate(names)}
    keyed = df.withColumnsRenamed(inner).withColumns({"k": F.coalesce(F.col(inner[id_name]).cast("long"), F.lit(LEAST)), "t": F.col(inner[tie]).cast("long")})
    n = keyed.count()
    ranges = max(1, min(most_ranges, -(-n // rows_per_range)))
    shares = [i / ranges for i in range(1, ranges)]
    found = keyed.agg(F.percentile_approx("k", shares, 10 * ranges)).first()[0] if shares and n else []
    splits = _split_points(found or [])
    firsts = sorted((r["b"], r["k"], r["t"]) for r in keyed.select("k", "t").mapInArrow(shared.tidy(_first_rows(splits)), "b long, k long, t long").groupBy("b").agg(F.min(F.struct("k", "t")).alias("x")).select("b", "x.k", "x.t").collect())
    ghosts = {(k, t): firsts[i - 1][0] for i, (_, k, t) in enumerate(firsts)}
    if prepare:
        more = prepare(keyed.drop("k", "t").withColumnsRenamed({v: k for k, v in inner.items()}))
        added = [c for c in more.columns if c not in inner]
        inner |= {c: f"__{len(inner) + i}" for i, c in enumerate(added)}
        keyed = more.withColumnsRenamed(inner).withColumns({"k": F.coalesce(F.col(inner[id_name]).cast("long"), F.lit(LEAST)), "t": F.col(inner[tie]).cast("long")})
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema), "b long", "ghost boolean"])
    dealt = keyed.mapInArrow(shared.tidy(_deal(splits, ghosts)), schema)
    order = Window.partitionBy("b").orderBy("ghost", "k", "t")
    for c in columns:
        dealt = dealt.withColumn(f"next {c}", F.lead(inner[c]).over(order))
    return dealt.where(~F.col("ghost")).select(*(F.col(v).alias(k) for k, v in inner.items()), *(F.col(f"next {c}").alias(f"next_{c}") for c in columns))
