"""Comparison form of names over all of Unicode: compatibility decomposition, marks dropped, a-z and digits only."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from docloom.functions import batches

_REST = re.compile("[^a-z0-9]+")


def fold_text(text: str | None) -> str | None:
    """NFKD form of a text without what is not ASCII then, in small letters, letters and digits only; null stays null."""
    if text is None:
        return None
    plain = text if text.isascii() else unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode()
    return _REST.sub("", plain.lower())


def _folded(texts):
    """Worker: the forms of an Arrow column of texts, some at a time."""
    import pyarrow as pa

    done = [pa.array([fold_text(t) for t in texts.slice(start, stop - start).to_pylist()], pa.string()) for start, stop in batches.cuts(texts)]
    return pa.concat_arrays(done) if done else pa.array([], pa.string())


def fold(c: Column) -> Column:
    """Column form of ``fold_text``, in bounded Arrow batches; ``functions.text.fold`` does Latin-1 letters without a worker."""
    batches.bound_batches(SparkSession.active())

    @F.arrow_udf("string")
    def run(texts):
        return _folded(texts)

    return run(c)
