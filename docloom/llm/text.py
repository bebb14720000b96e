"""Batch-at-a-time text arrays: many texts in one flat byte buffer."""

from __future__ import annotations

import numpy as np


def utf8_bytes(column):
    """(flat uint8 buffer, int64 offsets of n + 1) of an Arrow string column; null is empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    n = len(column)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    base = int(offsets[0]) if n else 0
    return data[base : int(offsets[-1])], offsets - base


def blocks(batches, most_bytes: int, text: str = "text"):
    """Regroup Arrow batches into tables of about most_bytes of text; a text is never split.

    A text longer than the bound makes a block of its own.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    held, size = [], 0
    for batch in batches:
        table = pa.Table.from_batches([batch])
        lengths = pc.fill_null(pc.binary_length(table[text].cast(pa.large_binary())), 0).to_numpy()
        start = 0
        ends = np.cumsum(lengths)
        done = 0
        while start < len(lengths):
            room = most_bytes - size
            stop = int(np.searchsorted(ends, done + max(room, 0), side="right"))
            if stop <= start:
                if held:
                    yield pa.concat_tables(held)
                    held, size = [], 0
                    continue
                stop = start + 1
            held.append(table.slice(start, stop - start))
            size += int(ends[stop - 1]) - done
            done = int(ends[stop - 1])
            start = stop
            if size >= most_bytes:
                yield pa.concat_tables(held)
                held, size = [], 0
    if held:
        yield pa.concat_tables(held)


def mix64(x):
    """Finaliser that spreads 64-bit values (splitmix constants); in place on uint64 arrays."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def grams8(data):
    """uint64 array whose item i holds bytes i .. i + 7 (len - 7 items)."""
    n = len(data) - 7
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    raw = np.ascontiguousarray(data)
    for shift in range(8):
        count = (len(raw) - shift) // 8
        part = raw[shift : shift + 8 * count].view("<u8")
        target = out[shift::8]
        target[:] = part[: len(target)]
    return out


def arrow_schema(ddl: str):
    """Arrow schema of a Spark DDL string, for workers that build batches."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))
