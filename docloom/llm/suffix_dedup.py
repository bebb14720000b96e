"""Suffix-array dedup: repeated byte strings across documents, found exactly.

A byte goes if a string of ``length`` bytes that covers it also starts in a
document of smaller id. The collection's suffixes are sorted by a column-wise
construction: every round inserts one symbol of every string, which updates
the order of the strings (their Burrows-Wheeler column) and the lengths of the
matches between neighbours (the common-prefix array). To bound the rounds by
the length asked for, instead of the longest document, the strings are not
whole documents but contexts:

1. Anchors. Each window of ``length`` bytes picks the leftmost of its least
   24-byte grams by hash (winnowing). The pick depends on the window's content
   only, so equal windows pick equal grams at equal offsets, and a window can
   only repeat if its gram does. Blocks send their distinct gram hashes to
   range buckets, which tell each block its grams that occur in two documents.
2. Contexts. Consecutive windows with one anchor make a context, of at most
   length + 26 bytes. A block sends its distinct contexts, with their least
   document id, to the bucket of the gram. Copies inside a block thus cost one
   context, whatever their number.
3. Construction. A bucket lays its contexts out, aligned at their anchors, as
   a file of columns in the shared folder, and reads one column a round. After
   the round for column c, neighbours that match over at least ``length``
   symbols are windows that end at c and are equal; the least id of each such
   run is the first document of that window.
4. Removal. Each block marks the windows whose first document is smaller than
   the document they stand in.

Texts are never shuffled: blocks are files in the shared folder. Buckets are
ranges of gram hashes whose number follows the input, so each stays small.

Cases: null and empty texts give no bytes; a null id is smaller than any other;
rows of equal id are one document for the comparison; texts shorter than
``length`` are kept; a very long text is taken window by window (its task holds
about 15 bytes for each of its bytes); bytes need not be UTF-8; an empty table
gives no rows; clashing column names do not matter, since only the id and text
columns are read.
"""

from __future__ import annotations

from contextlib import ExitStack

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import blocks, shared, text

GRAM = 24
#: Bits of a gram's hash that are sent; the lowest says that a block has the gram in two documents.
BITS = 48
_POSITION = 28  # bits of a position inside a piece


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, piece: int = 1 << 19):
    """(first window, last window, anchor position, gram hash, document number) of all runs of windows."""
    out = []
    n = len(offsets) - 1
    start = 0
    while start < n:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + piece, side="right")) - 1)
        stop = min(stop, n)
        low, high = int(offsets[start]), int(offsets[stop])
        if high - low >= length and high - low <= 2 * piece:
            out.append(_piece(data[low:high], offsets[start : stop + 1] - low, length, low, start))
        elif high - low >= length:  # one long text: its windows, some at a time
            for at in range(low, high - length + 1, piece):
                end = min(high, at + piece + length - 1)
                out.append(_piece(data[at:end], np.array([0, end - at]), length, at, start))
        start = stop
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _piece(data, offsets, length, low, first):
    eight = text.grams8(data)
    grams = eight[:-16] * np.uint64(0x9E3779B97F4A7C15)
    grams += eight[8:-8] * np.uint64(0xC2B2AE3D27D4EB4F)
    grams += eight[16:] * np.uint64(0x165667B19E3779F9)
    grams = text.mix64(grams)
    where = np.uint64((1 << _POSITION) - 1)
    least = (grams & ~where) | np.arange(len(grams), dtype=np.uint64)
    width, have = length - GRAM + 1, 1
    while 2 * have <= width:  # minimum over `have` grams, doubled
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
    anchor = (least & where).astype(np.int64)
    owner = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    at = np.flatnonzero(owner[: len(owner) - length + 1] == owner[length - 1 :])
    if len(at) == 0:
        return at, at, at, np.zeros(0, np.uint64), at
    picked, doc = anchor[at], owner[at]
    fresh = np.flatnonzero((picked[1:] != picked[:-1]) | (doc[1:] != doc[:-1])) + 1
    begins, ends = np.r_[0, fresh], np.r_[fresh - 1, len(at) - 1]
    # picked hashes are the small ones: mixed anew, they fill the buckets' ranges evenly
    values = text.mix64(grams[picked[begins]] + np.uint64(0xA0761D6478BD642F)) >> np.uint64(64 - BITS) & ~np.uint64(1)
    return at[begins] + low, at[ends] + low, picked[begins] + low, values, doc[begins].astype(np.int64) + first


def _bucket_cuts(n_buckets: int) -> np.ndarray:
    """Least hash of each bucket but the first."""
    return np.array([(i << BITS) // n_buckets for i in range(1, n_buckets)], np.uint64)


def _pack(values: np.ndarray) -> bytes:
    """Ascending values as byte planes of their steps, compressed."""
    import pyarrow as pa

    planes = np.diff(values, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpack(body: bytes) -> np.ndarray:
    import pyarrow as pa

    n = int.from_bytes(body[:8], "little")
    planes = np.frombuffer(pa.decompress(body[8:], 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def _send_grams(length: int, n_buckets: int):
    """Worker: distinct gram hashes of a block; the lowest bit says that two documents of the block have it."""

    def run(batches):
        import pyarrow as pa

        cuts = _bucket_cuts(n_buckets)
        for batch in batches:
            for uri in batch["block"].to_pylist():
                ids, data, offsets = blocks.read(uri)
                _, _, _, grams, doc = anchors(data, offsets, length)
                own = ids[doc]
                order = np.argsort(grams, kind="stable")
                grams, own = grams[order], own[order]
                begins = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]]) if len(grams) else np.zeros(0, np.int64)
                several = np.minimum.reduceat(own, begins) != np.maximum.reduceat(own, begins) if len(begins) else np.zeros(0, bool)
                values = grams[begins] | several.astype(np.uint64)
                parts = np.split(values, np.searchsorted(values, cuts))
                rows = [(b, uri, _pack(p)) for b, p in enumerate(parts) if len(p)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.string(), pa.binary()))], ["bucket", "block", "body"])

    return run


def _shared_grams(batches):
    """Worker, for one bucket: tell each block its grams that occur in two documents."""
    import pyarrow as pa

    rows = [r for batch in batches for r in batch.to_pylist()]
    if not rows:
        return
    parts = [_unpack(r["body"]) for r in rows]
    grams = np.concatenate(parts)
    several = (grams & np.uint64(1)).astype(bool)
    grams = grams & ~np.uint64(1)
    source = np.repeat(np.arange(len(rows)), [len(p) for p in parts])
    order = np.argsort(grams, kind="stable")
    grams, several, source = grams[order], several[order], source[order]
    equal = grams[1:] == grams[:-1]
    keep = several
    keep[1:] |= equal
    keep[:-1] |= equal
    grams, source = grams[keep], source[keep]
    order = np.argsort(source, kind="stable")  # grams stay in order inside a block
    grams, source = grams[order], source[order]
    cuts = np.searchsorted(source, np.arange(len(rows) + 1))
    for i, r in enumerate(rows):
        if cuts[i] < cuts[i + 1]:
            body = _pack(grams[cuts[i] : cuts[i + 1]])
            yield pa.RecordBatch.from_arrays([pa.array([r["bucket"]], pa.int32()), pa.array([r["block"]]), pa.array([body], pa.binary())], ["bucket", "block", "body"])


class _Contexts:
    """Distinct contexts of a block around grams that are shared, in the order of their grams."""

    #: Contexts whose bytes are gathered at a time.
    SLICE = 50_000

    def __init__(self, uri: str, rows: list[dict], length: int):
        self.ids, self.data, self.offsets = blocks.read(uri)
        wanted = np.concatenate([_unpack(r["body"]) for r in rows])
        begin, last, anchor, grams, doc = anchors(self.data, self.offsets, length)
        at = np.searchsorted(wanted, grams)
        at[at == len(wanted)] = 0
        held = wanted[at] == grams if len(wanted) else np.zeros(len(grams), bool)
        begin, last, anchor, grams, doc = (x[held] for x in (begin, last, anchor, grams, doc))
        self.begin, self.windows, self.doc = begin, last - begin + 1, doc
        left, size = anchor - begin, last - begin + length
        digest = self._digests(begin, size)
        digest = text.mix64(digest + left.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + size.astype(np.uint64) * np.uint64(0x165667B19E3779F9))
        order = np.lexsort((digest, grams))
        same = np.zeros(len(order), bool)
        if len(order):
            a, b = order[1:], order[:-1]
            same[1:] = (grams[a] == grams[b]) & (digest[a] == digest[b]) & (left[a] == left[b]) & (size[a] == size[b])
            pairs = np.flatnonzero(same[1:])
            for at in range(0, len(pairs), self.SLICE):
                some = pairs[at : at + self.SLICE]
                unequal = self._gather(begin[a[some]], size[a[some]]) != self._gather(begin[b[some]], size[b[some]])
                which = np.repeat(np.arange(len(some)), size[a[some]])[unequal]
                same[some[np.unique(which)] + 1] = False  # equal digests of different bytes: two contexts, joined where they match later
        self.context = np.empty(len(order), np.int64)
        self.context[order] = np.cumsum(~same) - 1
        firsts = order[~same]
        self.left, self.size, self.grams, self.at = left[firsts], size[firsts], grams[firsts], begin[firsts]
        self.least = np.minimum.reduceat(self.ids[doc[order]], np.flatnonzero(~same)) if len(order) else self.ids[:0]

    def _digests(self, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Polynomial hash of each context's bytes, from running sums over stretches of the block."""
        base, back = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
        symbols = text.mix64(np.arange(1, 257, dtype=np.uint64))
        out = np.empty(len(begin), np.uint64)
        for k in range(0, len(begin), self.SLICE):
            some = slice(k, k + self.SLICE)  # contexts stand in the order of the text
            low, high = int(begin[k]), int((begin[some] + size[some]).max())
            powers, undo = np.full(high - low + 1, base, np.uint64), np.full(high - low + 1, back, np.uint64)
            powers[0] = undo[0] = 1
            np.multiply.accumulate(powers, out=powers)
            np.multiply.accumulate(undo, out=undo)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(powers[:-1] * symbols[self.data[low:high]], dtype=np.uint64)])
            at = begin[some] - low
            out[some] = (sums[at + size[some]] - sums[at]) * undo[at]
        return out

    def _gather(self, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        return self.data[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]

    def bytes_of(self, i: int, j: int) -> bytes:
        """Bytes of the distinct contexts i to j - 1, one after the other."""
        return b"".join(self._gather(self.at[k : min(k + self.SLICE, j)], self.size[k : min(k + self.SLICE, j)]).tobytes() for k in range(i, j, self.SLICE))


def _send_contexts(length: int, n_buckets: int):
    def run(batches):
        import pyarrow as pa

        cuts = _bucket_cuts(n_buckets)
        for uri, rows in blocks.by_block(batches):
            held = _Contexts(uri, rows, length)
            edges = np.r_[0, np.searchsorted(held.grams, cuts), len(held.grams)]
            for b in range(n_buckets):
                i, j = edges[b], edges[b + 1]
                if i == j:
                    continue
                raw = held.least[i:j].tobytes() + held.left[i:j].astype(np.uint8).tobytes() + (held.size[i:j] - length).astype(np.uint8).tobytes() + held.bytes_of(i, j)
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([uri]), pa.array([int(j - i)]), pa.array([len(raw)]), pa.array([pa.compress(raw, codec="zstd", asbytes=True)], pa.binary())], ["bucket", "block", "n", "raw", "body"])

    return run


def column_rounds(columns, n: int, length: int):
    """Column-wise construction over aligned strings.

    ``columns`` yields one symbol of every string a round, 256 where a string
    has none. After each round: (order of the strings, match length with the
    neighbour before, capped at 255). The order sorts the strings by what was
    inserted so far, last symbol first; matches end at this round's column.
    """
    order = np.arange(n, dtype=np.int32 if n < 1 << 31 else np.int64)
    match = np.zeros(n, np.uint8)
    for symbols in columns:
        now = symbols[order]
        new = np.argsort(now, kind="stable")  # a radix pass: strings keep their order under each symbol
        sorted_now = now[new]
        gap = np.zeros(n, np.int64)
        gap[1:] = new[1:] - new[:-1]
        joined = np.zeros(n, bool)
        joined[1:] = (sorted_now[1:] == sorted_now[:-1]) & (sorted_now[1:] != 256)
        # least match between a string and the one now before it: over a range of the old order
        which = np.flatnonzero(joined)
        high, span = new[which], gap[which]
        value = np.empty(len(which), np.uint8)
        level, table = 0, match
        todo = np.floor(np.log2(span)).astype(np.int64) if len(which) else span
        for level in range(int(todo.max()) + 1 if len(which) else 0):
            some = np.flatnonzero(todo == level)
            width = 1 << level
            ends, starts = high[some] - width + 1, high[some] - span[some] + 1
            value[some] = np.minimum(table[starts], table[ends])
            if len(table) > width:
                table = np.minimum(table[:-width], table[width:])
        match = np.zeros(n, np.uint8)
        match[which] = np.minimum(value, 254) + 1
        order = order[new]
        yield order, match


#: Strings whose columns are laid out at a time.
STRINGS = 50_000


def _construct(folder: str, length: int):
    """Worker, for one bucket: first document of every window of its contexts."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        rows = [r for batch in batches for r in batch.to_pylist()]
        if not rows:
            return
        wide = length - GRAM  # most symbols before an anchor
        n = sum(r["n"] for r in rows)
        least, left, size = np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n, np.int64)
        n_columns = wide + length
        context = TaskContext.get()
        fs, folder_path = shared.open_fs(folder)
        files: list[tuple[str, int]] = []  # (columns of some strings, how many)
        waiting: list[np.ndarray] = []  # bytes of the strings not yet laid out
        at = done = 0

        def lay_out():
            """Columns of the strings done to at - 1, as one file."""
            nonlocal done
            n_flat, flat = size[done:at], np.concatenate(waiting)
            string = np.repeat(np.arange(at - done), n_flat)
            place = np.arange(len(flat)) - np.repeat(np.cumsum(n_flat) - n_flat, n_flat)
            table = np.full((n_columns, at - done), 256, np.uint16)
            table[wide - left[done + string] + place, string] = flat
            path = f"{folder_path}/columns-{context.partitionId()}-{context.taskAttemptId()}-{len(files)}"
            with fs.open_output_stream(path) as out:
                out.write(table.tobytes())
            files.append((path, at - done))
            waiting.clear()
            done = at

        for r in rows:
            raw = pa.decompress(r["body"], r["raw"], codec="zstd", asbytes=True)
            m = r["n"]
            least[at : at + m] = np.frombuffer(raw, np.int64, m)
            left[at : at + m] = np.frombuffer(raw, np.uint8, m, 8 * m)
            size[at : at + m] = np.frombuffer(raw, np.uint8, m, 9 * m).astype(np.int64) + length
            waiting.append(np.frombuffer(raw, np.uint8, offset=10 * m))
            at += m
            if at - done >= STRINGS:
                lay_out()
        if at > done:
            lay_out()

        def columns():
            """One symbol of every string, read from all files at their next column."""
            with ExitStack() as stack:
                opened = [(stack.enter_context(fs.open_input_stream(path)), m) for path, m in files]
                for _ in range(n_columns):
                    yield np.concatenate([np.frombuffer(file.read(2 * m), np.uint16) for file, m in opened])

        windows = size - length + 1
        ends = np.cumsum(windows)
        base = ends - windows
        first = np.repeat(least, windows)  # of each window
        for c, (order, match) in enumerate(column_rounds(columns(), n, length)):
            if c < length - 1:
                continue
            # the window that ends at column c is number c - (length - 1) - (wide - left) of its context
            number = c - (length - 1) - wide + left[order]
            valid = (number >= 0) & (number < windows[order])
            begins = np.flatnonzero(match < length)
            smallest = np.minimum.reduceat(np.where(valid, least[order], np.iinfo(np.int64).max), begins)
            run_of = np.cumsum(match < length) - 1
            some = np.flatnonzero(valid)
            first[base[order[some]] + number[some]] = smallest[run_of[some]]
        for path, _ in files:
            fs.delete_file(path)
        at = 0
        for r in rows:
            i, j = (base[at] if r["n"] else 0), ends[at + r["n"] - 1]
            raw = first[i:j].tobytes()
            at += r["n"]
            yield pa.RecordBatch.from_arrays([pa.array([r["bucket"]], pa.int32()), pa.array([r["block"]]), pa.array([len(raw)]), pa.array([pa.compress(raw, codec="zstd", asbytes=True)], pa.binary())], ["bucket", "block", "raw", "firsts"])

    return run


REMOVED = "id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _remove(length: int):
    schema = text.arrow_schema(REMOVED)

    def run(batches):
        import pyarrow as pa

        for uri, rows in blocks.by_block(batches):
            found = [r for r in rows if r["body"] is not None]
            if found:
                held = _Contexts(uri, found, length)
                first = np.concatenate([np.frombuffer(pa.decompress(r["firsts"], r["raw"], codec="zstd", asbytes=True), np.int64) for r in found])
                ids, data, offsets = held.ids, held.data, held.offsets
                base = np.cumsum(held.size - length + 1) - (held.size - length + 1)
                change = np.zeros(len(data) + 1, np.int8)
                for k in range(0, len(held.begin), held.SLICE):
                    some = slice(k, k + held.SLICE)
                    n = held.windows[some]
                    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                    repeated = first[np.repeat(base[held.context[some]], n) + step] < np.repeat(ids[held.doc[some]], n)
                    at = (np.repeat(held.begin[some], n) + step)[repeated]
                    change[at] += 1  # each window begins at a place of its own
                    change[at + length] -= 1
                gone = np.cumsum(change[:-1], dtype=np.int32) > 0
            else:
                ids, data, offsets = blocks.read(uri)
                gone = np.zeros(len(data), bool)
            n_gone = np.r_[0, np.cumsum(gone)]
            opens = gone.copy()
            opens[1:] &= ~gone[:-1]
            begins = offsets[:-1][np.diff(offsets) > 0]
            opens[begins] = gone[begins]  # a span ends with its document
            n_opens = np.r_[0, np.cumsum(opens)]
            left = data[~gone]
            removed, spans = np.diff(n_gone[offsets]), np.diff(n_opens[offsets])
            kept = offsets - n_gone[offsets]
            for i in range(0, len(ids), 2000):
                j = min(i + 2000, len(ids))
                bodies = [left[kept[k] : kept[k + 1]].tobytes() for k in range(i, j)]
                some = ids[i:j]
                yield pa.RecordBatch.from_arrays([pa.array(some, mask=some == blocks.NO_ID), pa.array(np.diff(offsets[i : j + 1])), pa.array(removed[i:j]), pa.array(spans[i:j]), pa.array(bodies, pa.binary())], schema=schema)

    return run


def remove_repeats(df: DataFrame, length: int = 50, id_name: str = "doc_id", text_name: str = "text", block_bytes: int = 4 << 20, bucket_bytes: int = 16 << 20) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept (bytes)."""
    if not GRAM < length <= GRAM + 128:
        raise ValueError("length must be 25 to 152 bytes")
    spark = df.sparkSession
    folder = shared.scratch(spark, "suffix")
    manifest = blocks.write(df, folder, id_name, text_name, block_bytes)
    total = manifest.agg(F.sum("n_bytes")).first()[0] or 0
    n_buckets = shared.parts_for(total, bucket_bytes, int(spark.conf.get("spark.sql.shuffle.partitions")))
    grams = blocks.spread(manifest).mapInArrow(shared.tidy(_send_grams(length, n_buckets)), "bucket int, block string, body binary")
    common = shared.written(grams.repartitionById(n_buckets, "bucket").mapInArrow(shared.tidy(_shared_grams), "bucket int, block string, body binary"), f"{folder}/grams")
    tasks = blocks.tasks_for(manifest)
    contexts = blocks.gathered(common, "bucket", tasks).mapInArrow(shared.tidy(_send_contexts(length, n_buckets)), "bucket int, block string, n long, raw long, body binary")
    firsts = contexts.repartitionById(n_buckets, "bucket").mapInArrow(shared.tidy(_construct(folder, length)), "bucket int, block string, raw long, firsts binary")
    firsts = shared.written(firsts, f"{folder}/firsts")
    told = manifest.select("block").join(common.join(firsts, ["block", "bucket"]), "block", "left")
    done = blocks.gathered(told, "bucket", tasks).mapInArrow(shared.tidy(_remove(length)), REMOVED)
    return done.withColumnRenamed("id", id_name)
