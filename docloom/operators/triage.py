"""Document triage: budgets, tiers, labels, dedupe, chunk plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import CASE_MARKS, NOTICE, is_template, letters, mark_count, script_letters, squeeze, tokens
from docloom.operators.retrieval import dealt


def dedupe_content(df: DataFrame, text: str, order: Sequence[str]) -> DataFrame:
    """First row of each text after white space is collapsed; rows without a text all stay."""
    key = F.coalesce(F.sha1(squeeze(F.col(text)).cast("binary")), F.concat_ws("|", F.lit("none"), *[F.col(c).cast("string") for c in order]))
    first = Window.partitionBy("__h").orderBy(*order)
    return df.withColumn("__h", key).withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__h", "__n")


def tier(template: Column, marks: Column, label: Column, primary: Sequence[str], supporting: Sequence[str]) -> Column:
    """primary, supporting or excluded: blank forms out, then hints in the label, then the number of marks in the text.

    ``template`` and ``marks`` are columns of a projection below (``facts``), so a text is searched once whatever the branches.
    """
    low = F.lower(label)
    any_of = lambda hints: F.exists(F.array(*[F.lit(h) for h in hints]), lambda h: F.contains(low, h))
    return F.when(template, "excluded").when(any_of(supporting), "supporting").when(any_of(primary), "primary").when(marks >= 2, "primary").otherwise("excluded")


def facts(df: DataFrame, text: str) -> DataFrame:
    """Adds ``marks`` and ``template`` of a text, which is dropped; what comes after cannot search it again."""
    told = F.transform(F.array(F.col(text)), lambda t: F.struct(mark_count(t, CASE_MARKS).alias("marks"), is_template(t).alias("template")))[0]
    return dealt(df).withColumn("__facts", told).drop(text).withColumns({"marks": F.col("__facts.marks"), "template": F.col("__facts.template")}).drop("__facts")


def promote(df: DataFrame, group: Sequence[str], tier_name: str, marks: str, order: str) -> DataFrame:
    """Where a group has no primary document, its supporting one with the most marks (one at least; the first of equals) becomes primary.

    Groups are told by sums, so no task holds the documents of a large one.
    """
    best = F.max(F.when(F.col(tier_name) == "supporting", F.struct(F.col(marks), -F.col(order))))
    facts = df.groupBy(*group).agg(F.max((F.col(tier_name) == "primary").cast("int")).alias("__primary"), best.alias("__best"))
    rows = df.join(facts, list(group), "left")
    chosen = (F.col("__primary") == 0) & (F.col(tier_name) == "supporting") & (F.col(marks) >= 1) & (-F.col(order) == F.col("__best.col2"))
    return rows.withColumn(tier_name, F.when(chosen, "primary").otherwise(F.col(tier_name))).drop("__primary", "__best")


def hint_priority(label: Column, hints: Sequence[str]) -> Column:
    """Place of the first hint in the label, or the number of hints."""
    out = F.lit(len(hints))
    for i in range(len(hints) - 1, -1, -1):
        out = F.when(F.contains(F.lower(label), F.lit(hints[i])), i).otherwise(out)
    return out


def unique_labels(df: DataFrame, group: Sequence[str], kind: str, name: str, order: Sequence[str], out: str = "label") -> DataFrame:
    """The kind; with the name where the kind repeats in its group; else the name; else a running number."""
    k, n = F.trim(F.coalesce(F.col(kind), F.lit(""))), F.trim(F.coalesce(F.col(name), F.lit("")))
    many = F.count(F.lit(1)).over(Window.partitionBy(*group, k))
    at = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    label = F.when((k != "") & (many > 1) & (n != ""), F.concat(k, F.lit(" ("), n, F.lit(")"))).when(k != "", k).when(n != "", n).otherwise(F.concat(F.lit("Document "), at.cast("string")))
    return df.withColumn(out, label)


def allocate(df: DataFrame, group: Sequence[str], order: Sequence[str], wanted: str, total: int, least: int, out: str = "chars_used") -> DataFrame:
    """Characters given to each row of a group in order: its wish while the budget lasts, what is left once if
    that is at least ``least``, and nothing after the first short-fall."""
    upto = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("__upto", F.sum(wanted).over(upto))
    before = F.col("__upto") - F.col(wanted)
    given = F.when(F.col("__upto") <= total, F.col(wanted)).when((before < total) & (F.lit(total) - before >= least), F.lit(total) - before).otherwise(0)
    return df.withColumn(out, given).drop("__upto")


def allocate_attempts(df: DataFrame, group: Sequence[str], order: Sequence[str], wanted: str, total: int, out: str = "attempted") -> DataFrame:
    """Whether a part is attempted: parts in order while their sum stays within the total, and the first one always; none after the first that does not fit."""
    upto = F.sum(wanted).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    first = F.row_number().over(Window.partitionBy(*group).orderBy(*order)) == 1
    return df.withColumn(out, (upto <= total) | first)


def cut_runs(kinds: Sequence[int], sizes: Sequence[int], most: int) -> list[tuple[int, int, int]]:
    """(first, last, size) of chunks of wanted pieces (kind 1), at most ``most`` in size unless one piece is larger.

    Pieces of kind 2 (blank) may lie inside a chunk, any other ends it. All cuts of a run come from its running
    sizes: each chunk ends where the size before it plus ``most`` is passed.
    """
    import numpy as np

    kinds, sizes = np.asarray(kinds, np.int64), np.asarray(sizes, np.int64)
    at = np.flatnonzero(kinds == 1)
    run = np.cumsum((kinds != 1) & (kinds != 2))[at]
    upto = np.cumsum(sizes[at])
    out = []
    for low, high in zip(np.searchsorted(run, np.unique(run)), np.searchsorted(run, np.unique(run), side="right"), strict=True):
        begin = int(low)
        while begin < high:
            before = int(upto[begin] - sizes[at[begin]])
            end = max(begin + 1, min(int(np.searchsorted(upto, before + most, side="right")), int(high)))
            out.append((int(at[begin]), int(at[end - 1]), int(upto[end - 1]) - before))
            begin = end
    return out


def piece_kind(piece: Column, least_letters: int = 10, least_share: float = 0.3, script: str = "hi") -> Column:
    """1 for a piece to translate (enough letters of the script, no notice in brackets), 2 for a blank one, else 0 (page marks among them)."""
    foreign = (script_letters(piece, script) >= least_letters) & (script_letters(piece, script) >= letters(piece) * least_share)
    return F.when(F.rlike(piece, F.lit(r"^\s*$")), 2).when(~F.rlike(piece, F.lit(NOTICE)) & foreign, 1).otherwise(0)


def _plan(most: int):
    def run(batches):
        import pyarrow as pa

        for rows in batches:
            parts = [cut_runs(k or (), n or (), most) for k, n in zip(rows["kinds"].to_pylist(), rows["sizes"].to_pylist(), strict=True)]
            of = pa.array([i for i, p in enumerate(parts) for _ in p], pa.int64())
            flat = [(chunk, *c) for p in parts for chunk, c in enumerate(p)]
            made = [pa.array([c[i] for c in flat], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([rows["key"].take(of), *made], ["key", "chunk", "first_token", "last_token", "chars"])

    return run


def plan_chunks(df: DataFrame, key: str, text: str, most: int = 6000, least_letters: int = 10, least_share: float = 0.3, script: str = "hi") -> DataFrame:
    """Runs of paragraphs to translate, at most ``most`` characters each, no paragraph cut: (key, chunk, first_token, last_token, chars).

    Tokens are those of ``functions.text.tokens``: page marks, notices in brackets and other paragraphs end a chunk, gaps between its
    paragraphs lie inside. Only kinds and lengths of the tokens go to the workers.
    """
    held = df.select(F.col(key).alias("key"), tokens(F.col(text)).alias("pieces"))
    lean = held.select("key", F.transform("pieces", lambda x: piece_kind(x, least_letters, least_share, script)).alias("kinds"), F.transform("pieces", lambda x: F.char_length(x)).alias("sizes"))
    kind = df.schema[key].dataType.simpleString()
    return lean.mapInArrow(_plan(most), f"key {kind}, chunk int, first_token int, last_token int, chars long").withColumnRenamed("key", key)
