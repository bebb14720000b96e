"""Texts read with dictionaries that are tables: keywords, aliases, abbreviations, rules.

One automaton (Aho-Corasick) holds all phrases of a dictionary, so a text is read once whatever the
number of phrases; a phrase counts as a whole word where no letter or digit touches it. Rules and references
are then joins over the phrases found, never expressions that grow with the dictionary.

A dictionary of up to ``PHRASES`` phrases goes to all workers. A larger one is dealt into parts by a hash of the phrase and meets the
texts, in blocks, part by part: nothing of it passes through the driver, and a task holds one part and one block.

Cases: case does not count unless asked for (``any_case``); null and empty texts and phrases find nothing; phrases that repeat under several ids are all found; of phrases that
overlap, ``mentions`` takes the one that begins first, and of those the longest, of equal phrases the least id;
empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions import batches as batches_

#: Phrases that one task looks for, and bytes of the texts of a block where the phrases are more.
PHRASES, BLOCK_BYTES = 200_000, 16 << 20
#: Places that a worker holds before it puts them out; one text's may be more.
HELD = 100_000


def _low(text: str) -> str:
    """Small letters, one for one."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _search(phrases: list[tuple], edges: str | None, covers: bool, any_case: bool = True):
    """Worker: (key, entry, start, stop) of phrases in texts; with ``covers`` only those that the leftmost-longest rule leaves."""

    def run(batches):
        from array import array

        import ahocorasick
        import pyarrow as pa

        form = _low if any_case else str
        touches = {None: lambda c: False, "words": str.isalnum, "letters": lambda c: "a" <= c <= "z"}[edges]
        by_phrase: dict[str, list[int]] = {}
        for entry, phrase in phrases:
            by_phrase.setdefault(form(phrase), []).append(entry)
        machine = ahocorasick.Automaton()
        for phrase, entries in by_phrase.items():
            machine.add_word(phrase, (len(phrase), sorted(entries)))
        if len(machine):
            machine.make_automaton()
        for rows in batches:
            keys = rows["key"].combine_chunks() if isinstance(rows, pa.Table) else rows["key"]

            def put_out(at, found, keys=keys):
                taken = keys.take(pa.array(at, pa.int64()))
                return pa.RecordBatch.from_arrays([taken.combine_chunks() if isinstance(taken, pa.ChunkedArray) else taken, *(pa.array(f, pa.int64()) for f in found)], ["key", "entry", "start", "stop"])

            at, found = array("q"), [array("q") for _ in range(3)]
            for first, after in batches_.cuts(rows["text"]) if len(machine) else ():
                for i, text in enumerate(rows["text"].slice(first, after - first).to_pylist(), first):
                    low = form(text or "")
                    spans = []
                    for end, (size, entries) in machine.iter(low) if low else ():
                        start, stop = end + 1 - size, end + 1
                        if start and touches(low[start - 1]) or stop < len(low) and touches(low[stop]):
                            continue
                        spans.append((start, -stop, entries))
                    reach = 0
                    for start, stop, entries in sorted(spans) if covers else spans:
                        if not covers or start >= reach:
                            reach = -stop
                            for entry in entries[:1] if covers else entries:
                                at.append(i)
                                for column, number in zip(found, (entry, start, -stop), strict=True):
                                    column.append(number)
                    if len(at) >= HELD:
                        yield put_out(at, found)
                        at, found = array("q"), [array("q") for _ in range(3)]
            yield put_out(at, found)

    return run


def _meet(edges: str | None, any_case: bool):
    """Worker: one block of texts and one part of a dictionary."""

    def run(texts, phrases):
        import pyarrow as pa

        entries = list(zip(phrases["id"].to_pylist(), phrases["phrase"].to_pylist(), strict=True))
        return pa.Table.from_batches(list(_search(entries, edges, False, any_case)(iter([texts]))))

    return run


def _hits(texts: DataFrame, key: str, text: str, dictionary: DataFrame, edges: str | None, covers: bool, most: int, any_case: bool = True) -> tuple[DataFrame, bool]:
    """((key, entry, start, stop), whether ``covers`` was heeded)."""
    lean = texts.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = T.StructType([lean.schema["key"], *(T.StructField(c, T.LongType()) for c in ("entry", "start", "stop"))])
    given = dictionary.where(F.char_length("phrase") > 0).select(F.col("id").cast("long").alias("id"), "phrase")
    some = [tuple(r) for r in given.limit(most + 1).collect()]
    batches_.bound_batches(texts.sparkSession)
    if len(some) <= most:
        return lean.mapInArrow(batches_.tidy(_search(some, edges, covers, any_case)), schema), covers
    parts = -(-given.count() // most)
    blocks = max(1, -(-int(lean.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = lean.where("text is not null").withColumn("block", F.pmod(F.xxhash64("key", "text"), F.lit(blocks)).cast("int")).withColumn("part", every(parts))
    right = given.withColumn("part", F.pmod(F.xxhash64(F.lower("phrase")), F.lit(parts)).cast("int")).withColumn("block", every(blocks))
    return left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(_meet(edges, any_case), schema), False


def found_in(texts: DataFrame, key: str, text: str, dictionary: DataFrame, edges: str | None = "words", most: int = PHRASES, any_case: bool = True) -> DataFrame:
    """(key, entry, n, first): how often each phrase of the dictionary (id, phrase) stands in a text, and where first; overlapping ones all count.

    ``edges``: no letter or digit may touch it ("words"), no letter of a-z ("letters"), or anything may (None).
    """
    hits, _ = _hits(texts, key, text, dictionary, edges, False, most, any_case)
    return hits.groupBy(F.col("key").alias(key), "entry").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("first"))


def mentions(texts: DataFrame, key: str, text: str, dictionary: DataFrame, most: int = PHRASES) -> DataFrame:
    """(key, start, stop, entry): whole-word phrases that do not overlap, the leftmost first and of those the longest. Keys must be unique."""
    hits, covered = _hits(texts, key, text, dictionary, "words", True, most)
    if not covered:  # each part knows some of the phrases only
        kind = hits.schema

        def cover(rows):
            import pyarrow as pa

            table = rows.sort_by([("start", "ascending"), ("stop", "descending"), ("entry", "ascending")])
            reach, keep = 0, []
            for start, stop in zip(table["start"].to_pylist(), table["stop"].to_pylist(), strict=True):
                keep.append(start >= reach)
                reach = stop if keep[-1] else reach
            return table.filter(pa.array(keep, pa.bool_()))

        hits = hits.groupBy("key").applyInArrow(cover, kind)
    return hits.select(F.col("key").alias(key), "start", "stop", "entry")


def expanded(queries: DataFrame, abbreviations: DataFrame) -> DataFrame:
    """(query_id, expanded) of (query_id, q): the full forms of (place, short, full) follow whose short form stands in the query, anywhere, and whose full form does not, in the order of ``place``."""
    rows = abbreviations.select(F.col("place").cast("long").alias("place"), "short", "full")
    phrases = rows.select((F.col("place") * 2).alias("id"), F.col("short").alias("phrase")).unionByName(rows.select((F.col("place") * 2 + 1).alias("id"), F.col("full").alias("phrase")))
    hits = found_in(queries, "query_id", "q", phrases, edges=None)
    found = hits.groupBy("query_id", F.floor(F.col("entry") / 2).alias("place")).agg(F.max(F.col("entry") % 2).alias("has_full")).where("has_full = 0")
    added = found.join(rows, "place").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "full"))).alias("added"))
    joined = F.array_join(F.transform("added", lambda x: F.concat(F.lit(" "), x["full"])), "")
    return queries.join(added, "query_id", "left").select("query_id", F.concat("q", F.coalesce(joined, F.lit(""))).alias("expanded"))


#: A section with what follows it, and an article (fixed values).
SECTION_REFERENCE = r"[Ss]ections?\s+(\d+[A-Za-z]{0,2})(?:\s*\([0-9A-Za-z]+\))?[\s,]*(?:of\s+(?:the\s+)?)?([A-Za-z][A-Za-z ,\.\-()]{0,70})?"
ARTICLE_REFERENCE, CONSTITUTION = r"[Aa]rticles?\s+(\d+[A-Za-z]?(?:-[A-Za-z])?)", "COI"


def references(texts: DataFrame, key: str, text: str, aliases: DataFrame) -> DataFrame:
    """(key, section, code) of the provisions that a text names: sections by the longest alias of (alias, code) in the words that follow, articles by their number.

    Of equally long aliases the first in code-point order counts. An alias is a whole word where no letter of a-z touches it.
    """
    parts = texts.select(F.col(key).alias("key"), F.col(text).alias("text"))
    numbers = F.regexp_extract_all("text", F.lit(SECTION_REFERENCE), 1)
    tails = F.regexp_extract_all("text", F.lit(SECTION_REFERENCE), 2)
    lists = parts.select("key", numbers.alias("section"), F.transform(tails, lambda t: F.lower(t)).alias("tail"))
    each = lists.select("key", F.explode(F.arrays_zip("section", "tail")).alias("x")).select("key", "x.section", "x.tail").where("tail <> ''").distinct()
    numbered = aliases.select(F.lower("alias").alias("alias"), "code").dropDuplicates(["alias"]).withColumn("entry", F.xxhash64("alias"))
    hits = found_in(each.select("tail").distinct(), "tail", "tail", numbered.select(F.col("entry").alias("id"), F.col("alias").alias("phrase")), edges="letters").join(numbered, "entry")
    best = hits.groupBy("tail").agg(F.min_by("code", F.struct(-F.char_length("alias"), F.col("alias"))).alias("code"))
    sections = each.join(best, "tail").select(F.col("key").alias(key), "section", "code")
    articles = parts.select(F.col("key").alias(key), F.explode(F.regexp_extract_all("text", F.lit(ARTICLE_REFERENCE), 1)).alias("section")).withColumn("code", F.lit(CONSTITUTION))
    return sections.unionByName(articles).distinct()


def first_rules(texts: DataFrame, key: str, text: str, rules: DataFrame) -> DataFrame:
    """(key, rule): the first rule by priority whose keywords fit a text, null where none does.

    ``rules`` is (rule, priority, part, keyword): of part ``every`` all keywords must stand in the text, of any other part at least one;
    keywords are whole words. Rules without keywords never fit. Of equal priorities the smaller rule counts.
    """
    words = rules.where(F.char_length("keyword") > 0).select("rule", "priority", "part", F.lower("keyword").alias("keyword")).distinct()
    numbered = words.select("keyword").distinct().withColumn("entry", F.xxhash64("keyword"))
    hits = found_in(texts, key, text, numbered.select(F.col("entry").alias("id"), F.col("keyword").alias("phrase"))).join(numbered, "entry").select(key, "keyword")
    needed = words.groupBy("rule", "priority").agg(F.count_if(F.col("part") == "every").alias("n_every"), F.count_distinct(F.when(F.col("part") != "every", F.col("part"))).alias("n_parts"))
    met = hits.join(words, "keyword").groupBy(key, "rule").agg(F.count_if(F.col("part") == "every").alias("every_met"), F.count_distinct(F.when(F.col("part") != "every", F.col("part"))).alias("parts_met"))
    fits = met.join(needed, "rule").where((F.col("every_met") == F.col("n_every")) & (F.col("parts_met") == F.col("n_parts")))
    best = fits.groupBy(key).agg(F.min(F.struct("priority", "rule")).alias("best"))
    return texts.select(key).join(best, key, "left").select(key, F.col("best.rule").alias("rule"))
