"""Blocks of texts as files in the shared folder, named by a committed manifest.

A worker writes each block once, under a name with its task attempt; the
manifest rows go through Spark's commit protocol, so they only name files of
attempts that succeeded. Later stages read the manifest and open the files, so
whole texts are never shuffled, and a lost executor costs no more than its own
tasks.

Cases: a null text is empty; a null id is written as the least 64-bit number; a
text longer than the block size is a block of its own; repeated rows are written
as often as they stand; an empty table has no blocks; only the id and text
columns are read, whatever the others are called.
"""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm import shared, text

MANIFEST = "block string, n_docs long, n_bytes long, part long, at long"
#: Stands for a null id, smaller than any other.
NO_ID = -(1 << 63)


def pack(ids: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> bytes:
    import pyarrow as pa

    raw = struct.pack("<q", len(ids)) + ids.astype("<i8").tobytes() + offsets.astype("<i8").tobytes() + data.tobytes()
    return struct.pack("<q", len(raw)) + pa.compress(raw, codec="zstd", asbytes=True)


def read(uri: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, flat bytes, offsets) of a block file."""
    import pyarrow as pa

    fs, path = shared.open_fs(uri)
    with fs.open_input_file(path) as file:
        packed = file.read()
    (size,) = struct.unpack("<q", packed[:8])
    raw = pa.decompress(packed[8:], size, codec="zstd", asbytes=True)
    (n,) = struct.unpack("<q", raw[:8])
    ids = np.frombuffer(raw, "<i8", n, 8)
    offsets = np.frombuffer(raw, "<i8", n + 1, 8 + 8 * n)
    return ids, np.frombuffer(raw, np.uint8, int(offsets[-1]), 16 + 16 * n), offsets


def _write(folder: str, block_bytes: int):
    schema = text.arrow_schema(MANIFEST)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        context = TaskContext.get()
        for at, table in enumerate(text.blocks(batches, block_bytes)):
            data, offsets = text.utf8_bytes(table["text"])
            ids = table["id"].fill_null(NO_ID).to_numpy()
            uri = f"{folder}/block-{context.partitionId()}-{at}-{context.taskAttemptId()}"
            fs, path = shared.open_fs(uri)
            with fs.open_output_stream(path) as out:
                out.write(pack(ids, data, offsets))
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((uri, len(ids), len(data), context.partitionId(), at), schema.types, strict=True)], schema=schema)

    return run


def write(df: DataFrame, folder: str, id_name: str = "doc_id", text_name: str = "text", block_bytes: int = 8 << 20) -> DataFrame:
    """Manifest of the blocks of a table's (id, text); the files go to <folder>/blocks."""
    shared.bound_batches(df.sparkSession)
    shared.make(df.sparkSession, f"{folder}/blocks")
    lean = df.select(F.col(id_name).cast("long").alias("id"), F.col(text_name).alias("text"))
    return shared.written(lean.mapInArrow(shared.tidy(_write(f"{folder}/blocks", block_bytes)), MANIFEST), f"{folder}/manifest")


def numbered(manifest: DataFrame) -> DataFrame:
    """Blocks numbered from 0 without gaps: the tasks that wrote them are counted up (one row a task), never the blocks."""
    sizes = manifest.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return manifest.join(sizes.select("part", F.coalesce(before, F.lit(0)).alias("before")), "part").select("block", "n_docs", "n_bytes", (F.col("before") + F.col("at")).alias("number"))


def tasks_for(manifest: DataFrame) -> int:
    """Number of tasks that the blocks are dealt over: a few blocks to a task, and all cores busy."""
    n = manifest.count()
    least = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(n, max(least, n // 4)))


def spread(manifest: DataFrame) -> DataFrame:
    """The manifest dealt evenly, at most a few blocks to a task."""
    return manifest.repartition(tasks_for(manifest), "block")


def gathered(rows: DataFrame, order: str, tasks: int) -> DataFrame:
    """All rows of a block in one task, one block after the other, in the given order.

    The number of tasks is given, as the rows are small and the blocks they stand for are not.
    """
    return rows.repartition(tasks, "block").sortWithinPartitions("block", order)


def by_block(batches):
    """Worker: (block, its rows as a list of dicts) from gathered rows."""
    held, block = [], None
    for batch in batches:
        for row in batch.to_pylist():
            if row["block"] != block and held:
                yield block, held
                held = []
            block = row["block"]
            held.append(row)
    if held:
        yield block, held
