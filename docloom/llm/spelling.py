"""Spelling variants: words one edit apart, found by walking a trie level by level.

1. ``count_words`` counts the runs of letters of all texts.
2. The vocabulary is spelled into a trie, forwards and backwards. The trie is a table of edges, one row a node: its
   symbols, and for each the symbols that may follow. A node is named by its prefix, so names cannot collide.
3. The frontier holds states (word, position, node, edits). A level joins the states with the nodes of its depth: a
   word's own prefix may spend its one edit there (another symbol, or one symbol of the word left out), an edited state
   must follow the word's next symbol. A state goes on only if the node it reaches can go on too. States that have read
   their word and stand on a word are neighbours. Each level is written to the shared folder, so a lost executor costs a
   level at most.

An edit in the second half of a word is spent in the forward trie, one in the first half in the backward trie. So states
branch only deep in a trie, where nodes have few symbols, and no two letters that begin a word draw all words
together. Insertions are the deletions of the other word, and of two words that differ in a symbol the smaller one looks
for the other.

A word of more than ``levels`` code points would need as many rounds, so those meet by their halves instead: two such
words one edit apart share a prefix or suffix of half their length, and are compared there.

Cases: null and empty texts have no words; a null id counts as the empty string; repeated rows count as often as they
stand; a run of any length counts whole; ties among forms go to the word that is smallest in code-point order; an empty
table gives no rows; only the id and text columns are read, whatever the others are called.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm import shared

#: Letters of a word: a fixed value.
RUN = r"[A-Za-zÀ-ÿ]+"


def _lower(word: Column) -> Column:
    """A-Z in small letters; words without other letters take the short way."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, string.ascii_uppercase, string.ascii_lowercase))


def count_words(df: DataFrame, id_name: str = "doc_id", text_name: str = "text", damaged_one_in: int | None = None) -> DataFrame:
    """(word, n) of all runs of letters, A-Z lower-cased.

    ``damaged_one_in``: a run whose checksum with its id this number divides loses one code point, which plants variants.
    """
    runs = df.select(F.coalesce(F.col(id_name).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(text_name), F.lit(RUN), F.lit(0))).alias("run"))
    rows = runs.select("id", _lower(F.col("run")).alias("word"))
    if damaged_one_in:
        sum_ = F.crc32(F.concat("id", F.lit(":"), "word").cast("binary"))
        rows = rows.withColumn("sum", sum_)
        at = (F.col("sum") % F.char_length("word")).cast("int")
        rows = rows.withColumn("word", F.when(F.col("sum") % damaged_one_in == 0, F.concat(F.substring("word", F.lit(1), at), F.expr(f"substring(word, cast(sum % char_length(word) as int) + 2)"))).otherwise(F.col("word")))
    return rows.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def spelled_both_ways(words: DataFrame) -> DataFrame:
    """(side, word, n, length): the words, and the words spelled backwards."""
    lean = words.select("word", "n", F.char_length("word").alias("length"))
    return lean.select(F.explode(F.array(F.struct(F.lit(">").alias("side"), "word"), F.struct(F.lit("<").alias("side"), F.reverse("word").alias("word")))).alias("x"), "n", "length").select("x.side", "x.word", "n", "length")


def _spends_from(side: Column, length: Column) -> Column:
    """First position where a word may spend its edit on a side: together the sides cover every position."""
    return F.when(side == ">", F.floor(length / 2)).otherwise(F.ceil(length / 2)).cast("int")


def trie(spelled: DataFrame, least_depth: int) -> DataFrame:
    """Edges of the trie: (side, depth, node, next); next lists symbols with those that may follow, '' being a word's end."""
    at = spelled.select("side", "word", F.explode(F.sequence(F.lit(least_depth), F.col("length"))).alias("depth"))
    part = lambda begin, n: F.substring("word", begin, n)
    edges = at.select("side", "depth", part(F.lit(1), F.col("depth")).alias("node"), part(F.col("depth") + 1, F.lit(1)).alias("symbol"), part(F.col("depth") + 2, F.lit(1)).alias("after")).distinct()
    followed = edges.groupBy("side", "depth", "node", "symbol").agg(F.collect_list("after").alias("after"))
    return followed.groupBy("side", "depth", "node").agg(F.collect_list(F.struct("symbol", "after")).alias("next"))  # as many as letters


#: Where a state may go from its node; d is the node's depth, p the position in the word.
_FOLLOW = "transform(filter(next, x -> x.symbol <> '' and x.symbol = substring(word, {p} + 1, 1) and array_contains(x.after, substring(word, {p} + 2, 1))), x -> struct({p} + 1 as position, concat(node, x.symbol) as node))"
_REPLACE = "transform(filter(next, x -> x.symbol > substring(word, position + 1, 1) and array_contains(x.after, substring(word, position + 2, 1))), x -> struct(position + 1 as position, concat(node, x.symbol) as node))"
_LEAVE_OUT = f"""
    case when position + 1 = length then transform(filter(next, x -> x.symbol = ''), x -> struct(position + 1 as position, node as node))
         when substring(word, position + 1, 1) = substring(word, position + 2, 1) then array()
         else {_FOLLOW.format(p="(position + 1)")} end"""


def _level(states: DataFrame, nodes: DataFrame) -> DataFrame:
    """States one level down."""
    met = states.join(nodes.hint("merge"), ["side", "node"])
    moves = F.expr(f"case when edits = 0 then concat({_REPLACE}, {_LEAVE_OUT}) else {_FOLLOW.format(p='position')} end")
    return met.select("side", "word", "n", "length", F.explode(moves).alias("x")).select("side", "word", "n", "length", "x.position", "x.node", F.lit(1).alias("edits"))


def _walk(words: DataFrame, folder: str) -> DataFrame | None:
    """Pairs (word, n, other) of words one edit apart, each found at least once."""
    bounds = words.agg(F.min(F.char_length("word")), F.max(F.char_length("word"))).first()
    if bounds[0] is None:
        return None
    first, last = int(bounds[0]) // 2, int(bounds[1])
    spark = words.sparkSession
    spelled = shared.written(spelled_both_ways(words), f"{folder}/spelled")
    trie(spelled, first).write.partitionBy("depth").option("compression", "zstd").parquet(f"{folder}/trie")
    nodes = spark.read.schema("side string, node string, next array<struct<symbol: string, after: array<string>>>, depth int").parquet(f"{folder}/trie")
    own = spelled.withColumn("position", F.lit(0)).where(F.col("length") > 0)
    frontier, found = None, []
    for depth in range(first, last + 1):
        spends = (F.lit(depth) >= _spends_from(F.col("side"), F.col("length"))) & (F.lit(depth) < F.col("length"))
        states = own.where(spends).select("side", "word", "n", "length", F.lit(depth).alias("position"), F.substring("word", F.lit(1), F.lit(depth)).alias("node"), F.lit(0).alias("edits"))
        if frontier is not None:
            states = states.unionByName(frontier.where("position < length"))
        frontier = shared.written(_level(states, nodes.where(F.col("depth") == depth).drop("depth")), f"{folder}/level-{depth}")
        found.append(f"{folder}/level-{depth}")
    forwards = lambda c: F.when(F.col("side") == "<", F.reverse(c)).otherwise(F.col(c)).alias(c)
    return spark.read.parquet(*found).where("position = length").select(forwards("word"), "n", forwards("node")).withColumnRenamed("node", "other")


def _by_halves(words: DataFrame) -> DataFrame:
    """Pairs (word, n, other) of long words one edit apart; the other has as many code points, or one less."""
    half, rest = "int((size - 1) / 2)", "(size - int((size - 1) / 2))"
    at = words.select("word", "n", F.char_length("word").alias("length")).select("*", F.explode(F.array("length", F.col("length") + 1)).alias("size"))
    keyed = at.select("word", "n", "length", "size", F.explode(F.expr(f"array(struct('>' as side, sha2(substring(word, 1, {half}), 256) as part), struct('<' as side, sha2(right(word, {rest}), 256) as part))")).alias("k"))
    longer = keyed.where("size = length").select("word", "n", "size", "k.side", "k.part")
    other = keyed.select(F.col("word").alias("other"), "size", "k.side", "k.part")
    return longer.join(other.hint("merge"), ["size", "side", "part"]).where((F.col("word") != F.col("other")) & (F.levenshtein("word", "other", 1) == 1)).select("word", "n", "other")


def near_words(words: DataFrame, folder: str, levels: int = 48) -> DataFrame:
    """(word, n, other, other_n), both ways: words that differ by one inserted, deleted or replaced code point."""
    short = _walk(words.where(F.char_length("word") <= levels), folder)
    pairs = _by_halves(words.where(F.char_length("word") >= levels))
    if short is not None:
        pairs = pairs.unionByName(short)
    pairs = pairs.distinct().join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")).hint("merge"), "other")
    found = shared.written(pairs.select("word", "n", "other", "other_n"), f"{folder}/pairs")
    turned = found.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    return found.unionByName(turned).distinct()


def _roots(forms: DataFrame, folder: str) -> DataFrame:
    """(word, root) of every word that has a form. Each round doubles the steps taken; counts at least double a step, so rounds are few."""
    now = shared.written(forms.select("word", F.col("form").alias("root")), f"{folder}/roots-0")
    turn = 0
    while True:
        turn += 1
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = now.join(onward.hint("merge"), "root", "left")
        now = shared.written(moved.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), f"{folder}/roots-{turn}")
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def variants(counts: DataFrame, least_letters: int = 5, least_n: int = 3, times: int = 2, levels: int = 48) -> DataFrame:
    """One row per word of (word, n) with at least ``least_letters`` code points and ``least_n`` occurrences.

    word, n, n_near (words one edit apart), form (of those the most frequent, if ``times`` as frequent), form_n, root
    (the last of the forms that follow each other).
    """
    if least_letters < 2:
        raise ValueError("words of one code point have no half")
    folder = shared.scratch(counts.sparkSession, "spelling")
    words = shared.written(counts.where((F.char_length("word") >= least_letters) & (F.col("n") >= least_n)), f"{folder}/words")
    best = near_words(words, folder, levels).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), "other")).alias("best"), F.first("n").alias("n"))
    has_form = -F.col("best.n") >= times * F.col("n")
    near = shared.written(best.select("word", "n_near", F.when(has_form, F.col("best.other")).alias("form"), F.when(has_form, -F.col("best.n")).alias("form_n")), f"{folder}/near")
    roots = _roots(near.where("form is not null"), folder)
    rows = words.join(near.hint("merge"), "word", "left").join(roots.hint("merge"), "word", "left")
    return rows.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("form_n").cast("long").alias("form_n"))
