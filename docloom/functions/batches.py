"""Arrow batches of bounded size, and workers that give their memory back."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession

#: Bytes of one Arrow batch of whole texts, or of the part of it that a worker takes at once; a longer text is one of its own.
BATCH_BYTES = 2 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound the bytes of Arrow batches that workers get, unless the session has a smaller bound.

    The setting stays: plans read it when they run, which is after this call. It changes no result.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name, None) or 1 << 31) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def cuts(texts, most: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Worker: (start, stop) of the parts of an Arrow column of texts that have so many bytes at most."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64))
    start = 0
    while start < len(ends):
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield start, stop
        start = stop


def tidy(run):
    """A worker function that gives what it held back to the system at its end, as workers live on."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes
            import gc

            import pyarrow as pa

            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
            if trim:
                trim(0)

    return tidied
