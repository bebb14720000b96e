"""Sections by tag depth, against a walk with a counter, and rules on nested and broken pages."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from docloom.operators import sections
from docloom.plans.ingestion import strip_tags

OPEN = '<section class="akn-section" id="section_{}">'


def by_counter(page):
    """From each opening tag on, count tags until the depth is 0."""
    out = []
    for m in re.finditer(sections.NUMBERED, page):
        depth, end = 1, m.end()
        for t in re.finditer(r"<section\b|</section>", page[m.end() :]):
            depth += 1 if t[0] != "</section>" else -1
            end = m.end() + (t.start() if depth == 0 else t.end())
            if depth == 0:
                break
        out.append((m[1], m.end(), end))
    return out


def test_bodies_of_random_pages():
    rng = random.Random(1)
    for _ in range(400):
        page = "".join(rng.choice((OPEN.format(rng.randrange(9)), "<section>", "</section>", "text ", "<sections>", '<section id="x">')) for _ in range(rng.randrange(25)))
        assert sections.bodies(page, "section", re.compile(sections.NUMBERED)) == by_counter(page)


def test_rules(spark):
    long = "words of the section go on and on"
    page = (
        f"</section>{OPEN.format('138')}<h3>138. Dishonour of <b>cheque</b> for funds — (1) Where any</h3><p>{long}</p>{OPEN.format('139.')}<h3>139 . Presumption. — In favour</h3>{long} inner<section class=x>{long}</section></section> tail</section>"
        f"{OPEN.format('138')}<h3>Other</h3>{long * 4}</section>{OPEN.format('7')}too short</section>{OPEN.format('1999')}{long}</section>{OPEN.format('2A')}{long} &amp; more</section>{OPEN.format('9')}<h3>9. Open</h3>{long}<section>x</section> lost"
    )
    df = spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "<p>no section</p>"), (None, f"{OPEN.format('1')}{long}</section>")], "k int, h string").withColumn("number", F.lit(1)).withColumn("page", F.lit(2))
    got = {(r.k, r.number): (r.title, r.text) for r in sections.numbered_sections(df, "k", "h", strip_tags).collect()}
    assert got == {
        (1, "138"): ("Dishonour of cheque for funds", f"{long} 139 . Presumption. — In favour {long} inner {long} tail"), (1, "139"): ("Presumption", f"{long} inner {long}"),
        (1, "2A"): ("", f"{long} & more"), (1, "9"): ("Open", f"{long} x"), (None, "1"): ("", long),
    }
    assert sections.numbered_sections(df.where("1 = 0"), "k", "h", strip_tags).collect() == []


def test_longest_repeat_and_length(spark):
    page = "".join(f"{OPEN.format('5')}<h3>5. T{i}</h3>{'x ' * n}</section>" for i, n in enumerate((20, 30_000, 40, 30_000)))
    (row,) = sections.numbered_sections(spark.createDataFrame([(1, page)], "k int, h string"), "k", "h", strip_tags).collect()
    assert row.title == "T1" and len(row.text) == sections.LONGEST
