"""Numbered sections of marked-up pages, found by the depth of their tags.

Sections may lie inside each other and need not be closed, so no pattern finds their ends. A worker goes over the tags of one
name once: an opening tag goes on a stack, a closing tag ends the section on top. Headings, titles, lengths and repeats are
DataFrame expressions over the bodies that come back.

Cases: null and empty pages have no sections; a closing tag without an opening one is ignored; a section that is never closed ends
with the last tag of its name; opening tags that carry no number count for the depth only; keys may repeat or be
null, a page is then a page of its own for the walk, but sections of one key compete by their number; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: An opening tag of a numbered section (fixed value); the group is its number.
NUMBERED = r'<section class="akn-section" id="section_([0-9A-Za-z\-.]+)">'
#: Bounds of a section's text and of its number (fixed values).
SHORTEST, LONGEST, LONGEST_TITLE, LARGEST_NUMBER = 20, 20_000, 180, 999


def bodies(page: str, tag: str, numbered) -> list[tuple[str, int, int]]:
    """(number, start, end) of the bodies of all numbered elements of a tag, in the order of their opening tags."""
    import re

    out: list[list] = []
    stack: list[int | None] = []  # the place in ``out`` of each open element, None for one without a number
    last = 0
    for m in re.finditer(rf"<{tag}\b|</{tag}>", page):
        last = m.end()
        if m[0].startswith("</"):
            if stack and (held := stack.pop()) is not None:
                out[held][2] = m.start()
            continue
        named = numbered.match(page, m.start())
        stack.append(len(out) if named else None)
        if named:
            out.append([named[1], named.end(), None])
    return [(number, start, max(start, last) if end is None else end) for number, start, end in out]


def _walk(tag: str, numbered: str):
    def run(batches):
        import re

        import pyarrow as pa

        pattern = re.compile(numbered)
        for rows in batches:
            at, found = [], []
            for i, page in enumerate(rows["page"].to_pylist()):
                for order, (number, start, end) in enumerate(bodies(page or "", tag, pattern)):
                    at.append(i)
                    found.append((order, number, page[start:end]))
            columns = [pa.array([f[j] for f in found], t) for j, t in enumerate((pa.int32(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([rows["key"].take(pa.array(at, pa.int64())), *columns], ["key", "place", "number", "body"])

    return run


def title_of(heading: Column) -> Column:
    """The first clause of a heading, without its number and the dashes and stops at its end."""
    bare = F.regexp_replace(heading, r"^\s*[0-9A-Za-z\-.]+\s*\.?\s*", "")
    clause = F.trim(F.split(F.regexp_replace(bare, r"[ .—\-–]+$", ""), r"\s[-–—]\s|\.\s*[-–—]|\s*\(1\)\s").getItem(0))
    return F.regexp_replace(F.substring(clause, 1, LONGEST_TITLE), r"[ .—\-–]+$", "")


def numbered_sections(pages: DataFrame, key: str, html: str, strip, tag: str = "section", numbered: str = NUMBERED) -> DataFrame:
    """(key, number, title, text) of the numbered sections of every page; ``strip`` is the column function that takes tags away.

    Short sections and numbers over the limit drop out; of one number the longest text stays, the first of equally long ones.
    """
    kind = pages.schema[key].dataType.simpleString()
    found = pages.select(F.col(key).alias("key"), F.col(html).alias("page")).mapInArrow(_walk(tag, numbered), f"key {kind}, place int, number string, body string")
    heading = F.regexp_extract("body", r"(?s)<h3>(.*?)</h3>", 1)
    rest = F.regexp_replace("body", r"(?s)^.*?<h3>.*?</h3>", "")
    has = F.rlike("body", F.lit(r"(?s)<h3>.*?</h3>"))
    read = found.select("key", "place", F.trim(F.regexp_replace("number", r"^\.+|\.+$", "")).alias("number"), F.when(has, title_of(strip(heading))).otherwise("").alias("title"), strip(F.when(has, rest).otherwise(F.col("body"))).alias("text"))
    kept = read.where(~(F.rlike("number", F.lit(r"^\d+$")) & (F.expr("try_cast(number as decimal(38,0))") > LARGEST_NUMBER)) & (F.char_length("text") >= SHORTEST))
    kept = kept.withColumn("text", F.substring("text", 1, LONGEST))
    best = Window.partitionBy("key", "number").orderBy(F.desc(F.char_length("text")), "place")
    return kept.withColumn("n", F.row_number().over(best)).where("n = 1").select(F.col("key").alias(key), "number", "title", "text")
