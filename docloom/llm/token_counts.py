"""Token counts by a separator scan of flat, unindexed token files.

A token file is nothing but ids of fixed width, each document followed by an
end-of-document id. The files are cut into blocks of equal size without regard
to documents. A task reads its block and finds the separators with one
vectorised comparison; it returns the lengths of the documents that end there,
the first one being only the part inside the block, and the tokens left over
after the last separator. A prefix scan over the small block rows gives each
block the number of documents that ended before it and the tokens carried into
it, so a document may span any number of blocks.

Cases: an empty document is two separators in a row and has 0 tokens; tokens
after a file's last separator count as one more document; an empty file has
none; a file whose size is no multiple of the width raises an error. In written
files a null text is an empty document; ids may be null or repeat; a text of any
length is one document over as many blocks as it takes; an empty table gives no
files and no rows; other columns of the table are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm import bpe, shared, text

SCANNED = "file string, block long, tokens long, n_ends long, tail long, lengths array<long>"
WRITTEN = "file string, n_bytes long, ordinal long, key long"


def _scan(block_bytes: int, separator: int, width: int):
    schema = text.arrow_schema(SCANNED)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for name, block, size in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "n_bytes")), strict=True):
                if size % width:
                    raise ValueError(f"{name}: {size} bytes are no whole number of ids")
                fs, path = shared.open_fs(name)
                with fs.open_input_file(path) as file:
                    ids = np.frombuffer(file.read_at(min(block_bytes, size - block * block_bytes), block * block_bytes), f"<u{width}")
                ends = np.flatnonzero(ids == separator)
                lengths = np.diff(ends, prepend=-1) - 1
                rows.append((name, block, len(ids), len(ends), len(ids) - 1 - int(ends[-1]) if len(ends) else len(ids), lengths.tolist()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types, strict=True)], schema=schema)

    return run


def separator_counts(files: DataFrame, separator: int, width: int = 2, block_bytes: int = 4 << 20) -> DataFrame:
    """(file, ordinal, n_tokens) of every document; ``files`` has one row (file, n_bytes) per file."""
    spark = files.sparkSession
    if block_bytes % width:
        raise ValueError("a block must hold whole ids")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = F.when(F.col("n_bytes") > 0, F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_bytes") - 1) / block_bytes)))
    blocks = files.select("file", "n_bytes", F.explode(cut).alias("block")).repartition(n, "file", "block")
    scanned = blocks.mapInArrow(shared.tidy(_scan(block_bytes, separator, width)), SCANNED)
    order = Window.partitionBy("file").orderBy("block")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    run = scanned.withColumn("ended", F.coalesce(F.sum("n_ends").over(earlier), F.lit(0)))
    run = run.withColumn("segment", F.coalesce(F.sum(F.when(F.col("n_ends") > 0, 1).otherwise(0)).over(earlier), F.lit(0)))
    carried = Window.partitionBy("file", "segment").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # a segment is a run of blocks from just after one with a separator up to the next with one
    run = run.withColumn("inside", F.coalesce(F.sum("tokens").over(carried), F.lit(0)))
    run = run.withColumn("begins", F.row_number().over(Window.partitionBy("file", "segment").orderBy("block")) == 1)
    run = run.withColumn("last_tail", F.lag("tail").over(order))
    run = run.withColumn("start", F.last(F.when(F.col("begins"), F.coalesce("last_tail", F.lit(0))), True).over(Window.partitionBy("file", "segment").orderBy("block")))
    run = run.withColumn("carry", F.col("inside") + F.col("start"))
    whole = F.transform("lengths", lambda x, i: F.when(i == 0, x + F.col("carry")).otherwise(x))
    ended = run.select("file", "ended", F.posexplode(whole).alias("at", "n_tokens")).select("file", (F.col("ended") + F.col("at")).alias("ordinal"), "n_tokens")
    last = run.withColumn("n", F.row_number().over(Window.partitionBy("file").orderBy(F.col("block").desc()))).where("n = 1")
    open_ = last.select("file", (F.col("ended") + F.col("n_ends")).alias("ordinal"), F.when(F.col("n_ends") > 0, F.col("tail")).otherwise(F.col("carry") + F.col("tokens")).alias("n_tokens"))
    return ended.unionByName(open_.where("n_tokens > 0"))


def _write(folder: str, separator: int, width: int, key: str):
    schema = text.arrow_schema(WRITTEN)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        context = TaskContext.get()
        name = f"{folder}/tokens-{context.partitionId()}-{context.taskAttemptId()}.bin"
        fs, path = shared.open_fs(name)
        keys: list[int] = []
        size = 0
        end = np.array([separator], f"<u{width}").tobytes()
        with fs.open_output_stream(path) as out:
            for batch in batches:
                for key_value, ids in zip(batch[key].to_pylist(), batch["ids"].to_pylist(), strict=True):
                    body = np.frombuffer(ids, "<u4").astype(f"<u{width}").tobytes() + end
                    out.write(body)
                    size += len(body)
                    keys.append(key_value)
        for at in range(0, len(keys), 10_000):
            some = keys[at : at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(some)), pa.array([size] * len(some)), pa.array(range(at, at + len(some))), pa.array(some, pa.int64())], schema=schema)

    return run


def write_token_files(df: DataFrame, vocabulary: bpe.Vocabulary, separator: int, width: int = 2, key: str = "doc_id", folder: str | None = None) -> DataFrame:
    """Encode texts into flat files; one row (file, n_bytes, ordinal, key) per document.

    The rows are committed by Spark's writer and name only the files of tasks
    that succeeded; a lost executor leaves at most an unused file.
    """
    if separator >= 1 << 8 * width or len(vocabulary.tokens) > 1 << 8 * width:
        raise ValueError("ids do not fit the width")
    folder = folder or shared.scratch(df.sparkSession, "tokens")
    ids = bpe.encode(df.select(F.col(key).cast("long").alias(key), "text"), vocabulary, keep=[key])
    return shared.written(ids.mapInArrow(shared.tidy(_write(folder, separator, width, key)), WRITTEN), f"{folder}/manifest")
