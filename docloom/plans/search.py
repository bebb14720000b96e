"""Search queries: vector and lexical legs, fusion, expansion, citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions.text import STOP_WORDS, TERM_GAP, classify_query, terms
from docloom.operators import configured, dictionaries, inverted, trigrams
from docloom.operators import retrieval as r
from docloom.operators import vectors as v
from docloom.plans.registry import query
from docloom.sources.tables import table

#: Demo searches: (query_id, text, id of the vector that stands for its embedding).
SEARCHES = ((1, "idiot clown trash", 3), (2, "license copyright notice", 11), (3, "que los por una", 42), (4, "section 12 die und", 77), (5, "stupid v. pathetic", 101))
_ASKED = ", ".join(f"({i}, '{q}', {v})" for i, q, v in SEARCHES)
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
ASKED_SQL = f"asked AS (SELECT query_id::BIGINT AS query_id, q, vec_id::BIGINT AS vec_id FROM (VALUES {_ASKED}) t(query_id, q, vec_id))"
WANTED_SQL = rf"wanted AS (SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest(string_split_regex(lower(q), '[^\p{{L}}\p{{N}}]+')) AS term FROM asked) WHERE term <> '' AND term NOT IN ({_STOP}))"
TERMS_SQL = r"terms AS MATERIALIZED (SELECT doc_id AS id, unnest(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS term FROM documents)"
HITS_SQL = "hits AS (SELECT id, term, count(*) AS tf FROM terms WHERE term IN (SELECT term FROM wanted) GROUP BY id, term)"
MATCH_SQL = """sizes AS (SELECT query_id, count(*) AS n_wanted FROM wanted GROUP BY query_id),
matched AS (SELECT w.query_id, h.id, count(*) AS n_hit, sum(1 + ln(h.tf)) AS score FROM hits h JOIN wanted w USING (term) GROUP BY ALL)"""
LEXICAL_SQL = f"WITH {ASKED_SQL}, {WANTED_SQL}, {TERMS_SQL}, {HITS_SQL}, {MATCH_SQL}"
_COS = "1 - list_dot_product(e.embedding::DOUBLE[], q.v) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.v, q.v)))"
_L2 = "sqrt(list_sum(list_transform(list_zip(e.embedding::DOUBLE[], q.v), lambda x: (x[1] - x[2]) * (x[1] - x[2]))))"


def asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SEARCHES), "query_id long, q string, vec_id long")


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return vectors.join(F.broadcast(asked(spark)), "vec_id").select("query_id", "vector")


def corpus_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _knn_sql(distance: str, k: int, where: str = "TRUE") -> str:
    return f"""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0),
    d AS (SELECT q.query_id, e.vec_id AS id, {distance} AS distance FROM embeddings e, q WHERE {where})
    SELECT query_id, id, round(distance, 6) + 0.0 AS distance, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), id)::INTEGER AS rank FROM d
    QUALIFY rank <= {k}"""


def every_fiftieth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query set of the vector searches: every row whose id is divisible by 50."""
    return corpus_vectors(spark, sf_dir).where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector")


@query("knn_cosine", _knn_sql(_COS, 50))
def knn_cosine(spark, sf_dir):
    return v.nearest(corpus_vectors(spark, sf_dir), every_fiftieth(spark, sf_dir), 50)


@query("knn_cosine_multi", _knn_sql(_COS, 30))
def knn_cosine_multi(spark, sf_dir):
    return v.nearest(corpus_vectors(spark, sf_dir), every_fiftieth(spark, sf_dir), 30)


@query("knn_filtered", _knn_sql(_COS, 10, "e.label IN (0, 2)"))
def knn_filtered(spark, sf_dir):
    return v.nearest(corpus_vectors(spark, sf_dir).where(F.col("label").isin(0, 2)), every_fiftieth(spark, sf_dir), 10)


@query("knn_l2", _knn_sql(_L2, 10))
def knn_l2(spark, sf_dir):
    return v.nearest(corpus_vectors(spark, sf_dir), every_fiftieth(spark, sf_dir), 10, metric="l2")


@query("knn_ivf")
def knn_ivf(spark, sf_dir):
    """An inverted file whose cells grow as the root of the table; the share of cells probed holds the recall above 0.9 on vectors without clusters."""
    vectors = corpus_vectors(spark, sf_dir).select("id", "vector")
    index, centres = r.cells(vectors, v.cells_for(vectors.count()))
    return v.probe(index, centres, every_fiftieth(spark, sf_dir), 10, probes=max(1, round(len(centres) * 0.7)))


@query("knn_hnsw")
def knn_hnsw(spark, sf_dir):
    """The ten nearest from graphs of neighbours; the recall is measured in the tests."""
    return v.graph_nearest(v.graph_index(corpus_vectors(spark, sf_dir)), every_fiftieth(spark, sf_dir), 10)


@query("knn_hnsw_filtered")
def knn_hnsw_filtered(spark, sf_dir):
    """The same under a filter on the index's own column: the walk widens until enough rows pass."""
    index = v.graph_index(corpus_vectors(spark, sf_dir), keep=["label"])
    return v.graph_nearest(index, every_fiftieth(spark, sf_dir), 10, passes=F.col("label").isin(0, 2))


@query("fts_postings", f"WITH {TERMS_SQL} SELECT id, term, count(*) AS tf FROM terms WHERE term NOT IN ({_STOP}) GROUP BY id, term")
def fts_postings(spark, sf_dir):
    return r.postings(table(spark, sf_dir, "documents")).select("id", "term", "tf")


@query(
    "weighted_postings",
    rf"""WITH t AS (SELECT p_partkey AS id, 'p_name' AS field, 1.0::DOUBLE AS weight, unnest(string_split_regex(lower(p_name), '[^\p{{L}}\p{{N}}]+')) AS term FROM part
    UNION ALL SELECT p_partkey, 'p_type', 0.4::DOUBLE, unnest(string_split_regex(lower(p_type), '[^\p{{L}}\p{{N}}]+')) FROM part)
    SELECT id, term, count(*) AS tf, field, weight FROM t WHERE term <> '' AND term NOT IN ({_STOP}) GROUP BY ALL""",
)
def weighted_postings(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    title = r.postings(part, "p_name", "p_partkey", weight=1.0)
    return title.unionByName(r.postings(part, "p_type", "p_partkey", weight=0.4))


def _lexical(spark, sf_dir):
    wanted = r.query_terms(asked(spark))
    docs = table(spark, sf_dir, "documents")
    hits = r.term_hits(docs, wanted)
    return docs, wanted, hits, r.match_counts(hits, wanted)


@query("fts_match_all", LEXICAL_SQL + "SELECT query_id, id FROM matched JOIN sizes USING (query_id) WHERE n_hit = n_wanted")
def fts_match_all(spark, sf_dir):
    return _lexical(spark, sf_dir)[3].where("n_hit = n_wanted").select("query_id", "id")


@query("fts_match_any", LEXICAL_SQL + "SELECT query_id, id, n_hit FROM matched")
def fts_match_any(spark, sf_dir):
    return _lexical(spark, sf_dir)[3].select("query_id", "id", "n_hit")


_RANKED = "SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id)::INTEGER AS rank FROM {} QUALIFY rank <= 20"


def _top(df: DataFrame, k: int = 20) -> DataFrame:
    rows = df.select("query_id", "id", F.round("score", 6).alias("score"))
    return r.ranked(rows, [F.desc("score"), F.asc("id")], k)


@query("fts_and_or_rank", LEXICAL_SQL + ", m AS (SELECT * FROM matched JOIN sizes USING (query_id) WHERE n_hit = n_wanted) " + _RANKED.format("m"))
def fts_and_or_rank(spark, sf_dir):
    return _top(_lexical(spark, sf_dir)[3].where("n_hit = n_wanted"))


@query("lexical_rank", LEXICAL_SQL + " " + _RANKED.format("matched"))
def lexical_rank(spark, sf_dir):
    return _top(_lexical(spark, sf_dir)[3])


_BM25 = """, lens AS (SELECT id, count(*) AS n_terms FROM terms GROUP BY id),
stats AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM terms)::DOUBLE / (SELECT count(*) FROM documents) AS avgdl),
dfs AS (SELECT term, count(*) AS df FROM hits GROUP BY term),
scored AS (SELECT w.query_id, h.id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n_terms / avgdl))) AS score
  FROM hits h JOIN wanted w USING (term) JOIN dfs USING (term) JOIN lens USING (id), stats GROUP BY ALL) """


@query("bm25_rank", LEXICAL_SQL + _BM25 + _RANKED.format("scored"))
def bm25_rank(spark, sf_dir):
    docs, wanted, hits, _ = _lexical(spark, sf_dir)
    return _top(r.bm25(r.corpus_stats(docs), hits, wanted))


_COVERS_SQL = """, e AS (SELECT w.query_id, p.id, p.term, p.i FROM places p JOIN wanted w USING (term)),
full_ AS (SELECT query_id, id FROM e JOIN sizes USING (query_id) GROUP BY query_id, id, n_wanted HAVING count(DISTINCT term) = n_wanted),
l AS (SELECT e.query_id, e.id, e.i, w.term, max(o.i) AS last FROM e JOIN full_ USING (query_id, id) JOIN wanted w ON w.query_id = e.query_id JOIN e o ON o.query_id = e.query_id AND o.id = e.id AND o.term = w.term AND o.i <= e.i GROUP BY ALL),
s AS (SELECT query_id, id, i, min(last) AS low FROM l JOIN sizes USING (query_id) GROUP BY query_id, id, i, n_wanted HAVING count(*) = n_wanted),
c AS (SELECT query_id, id, low, min(i) AS i FROM s GROUP BY ALL),
covers AS (SELECT query_id, id, sum(1.0::DOUBLE / (i - low + 1)) AS score FROM c GROUP BY ALL) """
_PLACES_SQL = rf""", words AS MATERIALIZED (SELECT doc_id AS id, list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM documents),
places AS (SELECT * FROM (SELECT id, unnest(w) AS term, unnest(range(len(w))) AS i FROM words) WHERE term IN (SELECT term FROM wanted))"""


@query("cover_density_rank", LEXICAL_SQL + _PLACES_SQL + _COVERS_SQL + _RANKED.format("covers"))
def cover_density_rank(spark, sf_dir):
    wanted = r.query_terms(asked(spark))
    return _top(inverted.cover_density(inverted.places(table(spark, sf_dir, "documents"), {"text": "text"}, wanted=wanted), wanted))


#: Added to the lexical score of a text that holds the whole query as a phrase.
PHRASE_BONUS = 2.0
_PHRASE_SQL = rf"""WITH p AS (SELECT query_id, ' ' || trim(regexp_replace(lower(q), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) || ' ' AS phrase FROM (SELECT query_id, q FROM asked UNION ALL VALUES (6::BIGINT, 'of the'), (7::BIGINT, 'that the'))),
t AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) || ' ' AS body FROM documents)"""


@query("phrase_match", f"{_PHRASE_SQL.replace('WITH p', f'WITH {ASKED_SQL}, p')} SELECT query_id, doc_id, {PHRASE_BONUS}::DOUBLE AS bonus FROM t JOIN p ON contains(body, phrase)")
def phrase_match(spark, sf_dir):
    """Texts that hold a query's terms next to each other, in order: they gain a fixed bonus."""
    phrases = inverted.phrase_terms(asked(spark).select("query_id", "q").unionByName(spark.createDataFrame([(6, "of the"), (7, "that the")], "query_id long, q string")))
    rows = inverted.places(table(spark, sf_dir, "documents"), {"text": "text"}, wanted=phrases)
    return inverted.phrase_counts(rows, phrases).select("query_id", F.col("id").alias("doc_id"), F.lit(PHRASE_BONUS).alias("bonus"))


@query(
    "lexical_phrase_rank",
    LEXICAL_SQL
    + _PHRASE_SQL.replace("WITH p", ", p").replace(" UNION ALL VALUES (6::BIGINT, 'of the'), (7::BIGINT, 'that the')", "")
    + f""", b AS (SELECT query_id, doc_id AS id, {PHRASE_BONUS}::DOUBLE AS bonus FROM t JOIN p ON contains(body, phrase)),
    both_ AS (SELECT query_id, id, score + coalesce(bonus, 0) AS score FROM matched LEFT JOIN b USING (query_id, id)) """
    + _RANKED.format("both_"),
)
def lexical_phrase_rank(spark, sf_dir):
    """The lexical score with the phrase bonus added, from one scan of the texts; the rows may as well come from a stored index."""
    phrases, wanted = inverted.phrase_terms(asked(spark)), r.query_terms(asked(spark))
    rows = inverted.places(table(spark, sf_dir, "documents"), {"text": "text"}, wanted=phrases)
    bonus = inverted.phrase_counts(rows, phrases).select("query_id", "id", F.lit(PHRASE_BONUS).alias("bonus"))
    scored = inverted.weighted_scores(rows, wanted, {"text": 1.0}).join(bonus, ["query_id", "id"], "left")
    return _top(scored.withColumn("score", F.col("score") + F.coalesce("bonus", F.lit(0.0))))


#: Weights of the fields of a part in a search: its name counts more than its kind.
FIELD_WEIGHTS = {"p_name": 1.0, "p_type": 0.4}


@query(
    "weighted_rank",
    rf"""WITH asked AS (SELECT n_nationkey::BIGINT AS query_id, q FROM nation JOIN (SELECT p_partkey % 25 AS k, min(p_name || ' ' || p_type) AS q FROM part GROUP BY 1) ON k = n_nationkey),
    {WANTED_SQL},
    t AS (SELECT p_partkey AS id, 1.0::DOUBLE AS weight, unnest(string_split_regex(lower(p_name), '[^\p{{L}}\p{{N}}]+')) AS term FROM part UNION ALL SELECT p_partkey, 0.4::DOUBLE, unnest(string_split_regex(lower(p_type), '[^\p{{L}}\p{{N}}]+')) FROM part),
    c AS (SELECT id, weight, term, count(*) AS tf FROM t WHERE term <> '' GROUP BY ALL),
    s AS (SELECT query_id, id, sum(weight * (1 + ln(tf))) AS score FROM c JOIN wanted USING (term) GROUP BY ALL) """
    + _RANKED.format("s"),
)
def weighted_rank(spark, sf_dir):
    """Parts for a part of each of 25 kinds as the query, by their name and type, the name counting more."""
    part = table(spark, sf_dir, "part")
    asked_for = part.groupBy((F.col("p_partkey") % 25).alias("query_id")).agg(F.min(F.concat_ws(" ", "p_name", "p_type")).alias("q"))
    wanted = r.query_terms(asked_for)
    rows = inverted.places(part, {c: c for c in FIELD_WEIGHTS}, "p_partkey", wanted)
    return _top(inverted.weighted_scores(rows, wanted, FIELD_WEIGHTS))


@query("headline")
def headline(spark, sf_dir):
    """Fragments of the first five texts of each query around that query's own terms."""
    docs, wanted, _, matched = _lexical(spark, sf_dir)
    asked_for = wanted.groupBy("query_id").agg(F.array_sort(F.collect_list("term")).alias("wanted"))
    top = _top(matched, 5).join(F.broadcast(asked_for), "query_id")
    return docs.join(F.broadcast(top), docs.doc_id == top.id).select("query_id", "doc_id", "rank", r.headline(F.col("text"), F.col("wanted")).alias("headline"))  # five rows a query


ABBREVIATIONS = (("lic", "license"), ("cop", "copyright"), ("sec", "section"))


@query(
    "expand_query",
    """WITH s AS (SELECT doc_id, array_to_string(string_split(text, ' ')[1:6], ' ') || CASE doc_id % 4 WHEN 0 THEN ' LIC' WHEN 1 THEN ' cop section' WHEN 2 THEN ' sec lic license' ELSE '' END AS q FROM documents)
    SELECT doc_id, q || CASE WHEN contains(lower(q), 'lic') AND NOT contains(lower(q), 'license') THEN ' license' ELSE '' END
      || CASE WHEN contains(lower(q), 'cop') AND NOT contains(lower(q), 'copyright') THEN ' copyright' ELSE '' END
      || CASE WHEN contains(lower(q), 'sec') AND NOT contains(lower(q), 'section') THEN ' section' ELSE '' END AS expanded FROM s""",
)
def expand_query(spark, sf_dir):
    """Full forms follow the short ones in the first words of every text; ``expand_from_table`` takes the forms from a table."""
    end = F.element_at(F.array(*[F.lit(x) for x in (" LIC", " cop section", " sec lic license", "")]), (F.col("doc_id") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.array_join(F.slice(F.split("text", " "), F.lit(1), F.lit(6)), " "), end).alias("q"))
    out = F.col("q")
    for short, full in ABBREVIATIONS:
        missing = F.contains(F.lower("q"), F.lit(short)) & ~F.contains(F.lower("q"), F.lit(full))
        out = F.concat(out, F.when(missing, f" {full}").otherwise(""))
    return rows.select("doc_id", out.alias("expanded"))


@query(
    "fts_fallback",
    LEXICAL_SQL
    + """, a AS (SELECT m.*, n_hit = n_wanted AS whole FROM matched m JOIN sizes USING (query_id)),
    n AS (SELECT query_id, count_if(whole) AS n_all FROM a GROUP BY query_id)
    SELECT query_id, id, whole, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY whole DESC, round(score, 6) DESC, id)::INTEGER AS rank
    FROM a JOIN n USING (query_id) WHERE whole OR n_all < 10 QUALIFY rank <= 50""",
)
def fts_fallback(spark, sf_dir):
    """Rows with all terms; where a query has fewer than ten, rows with any term follow."""
    return r.with_fallback(_lexical(spark, sf_dir)[3], few=10, k=50)


@query(
    "party_fallback",
    """WITH q AS (SELECT 1 AS query_id, 'State v. Customer#000000012 and Supplier#000000007' AS q),
    toks AS (SELECT DISTINCT lower(unnest(regexp_extract_all(q, '[A-Z][A-Za-z#0-9]{3,}'))) AS tok FROM q),
    use AS (SELECT tok FROM toks WHERE tok NOT IN ('state', 'union'))
    SELECT o_orderkey, c_name, (SELECT count(*) FROM use WHERE contains(lower(c_name), tok)) AS n_hit FROM orders JOIN customer ON o_custkey = c_custkey
    WHERE EXISTS (SELECT 1 FROM use WHERE contains(lower(c_name), tok)) ORDER BY n_hit DESC, o_orderkey LIMIT 20""",
)
def party_fallback(spark, sf_dir):
    """Proper nouns of a case name (length 4 or more, no stop word, first six) found in a party column."""
    asked_for = spark.createDataFrame([("State v. Customer#000000012 and Supplier#000000007",)], "q string")
    names = F.regexp_extract_all("q", F.lit(r"([A-Z][A-Za-z#0-9]{3,})"), 1)
    tokens = F.slice(F.filter(F.array_distinct(F.transform(names, lambda x: F.lower(x))), lambda x: ~x.isin("state", "union")), 1, 6)
    found = table(spark, sf_dir, "customer").crossJoin(F.broadcast(asked_for.select(tokens.alias("tokens"))))  # one row
    found = found.withColumn("n_hit", F.size(F.filter("tokens", lambda t: F.contains(F.lower("c_name"), t))).cast("long")).where("n_hit > 0")
    rows = table(spark, sf_dir, "orders").join(found, F.col("o_custkey") == F.col("c_custkey"))
    return rows.select("o_orderkey", "c_name", "n_hit").orderBy(F.desc("n_hit"), "o_orderkey").limit(20)


@query(
    "trigram_match",
    """WITH q AS (SELECT p_partkey AS query_id, lower(substring(p_name, 3, 1 + (p_partkey // 50 % 9)::INT)) AS pattern FROM part WHERE p_partkey % 50 = 0)
    SELECT query_id, p_partkey AS id FROM part JOIN q ON contains(lower(p_name), pattern) WHERE pattern <> ''""",
)
def trigram_match(spark, sf_dir):
    """Parts whose name holds a piece of every fiftieth part's name, of one to nine signs, found by the piece's rarest trigrams."""
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    size = F.lit(1) + F.floor(F.col("id") / 50).cast("int") % 9
    patterns = names.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.substring("name", F.lit(3), size).alias("pattern"))
    return trigrams.pairs(names, patterns)


def _benchmark_queries(spark, sf_dir):
    """(query_id, q): the first two to six words of every benchmark item, each with a configuration; the words of two letters in every tenth item are its abbreviations."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.split("text", " ").alias("words"))
    asked_for = items.select("query_id", F.array_join(F.slice("words", F.lit(1), (2 + F.col("query_id") % 5).cast("int")), " ").alias("q"))
    short = items.where("query_id % 10 = 0").select(F.explode("words").alias("word")).where("char_length(word) = 2")
    return configured.with_configuration(asked_for, short)


@query(
    "query_configuration",
    r"""WITH w AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark),
    q AS (SELECT item_id AS query_id, array_to_string(w[1:(2 + item_id % 5)::INT], ' ') AS q FROM w),
    a AS (SELECT DISTINCT upper(x) AS word FROM (SELECT unnest(w) AS x FROM w WHERE item_id % 10 = 0) WHERE length(x) = 2)
    SELECT query_id, q, CASE WHEN len(string_split_regex(trim(upper(q)), '\s+')) <= 3 OR EXISTS (SELECT 1 FROM a WHERE list_contains(string_split_regex(trim(upper(q)), '\s+'), a.word)) THEN 'simple' ELSE 'english' END AS config FROM q""",
)
def query_configuration(spark, sf_dir):
    return _benchmark_queries(spark, sf_dir).select("query_id", "q", "config")


@query("configured_search")
def configured_search(spark, sf_dir):
    """First ten texts of every benchmark query, in its own configuration: as it stands, or by stems without stop words."""
    docs, asked_for = table(spark, sf_dir, "documents"), _benchmark_queries(spark, sf_dir)
    forms = configured.wanted_forms(asked_for, configured.vocabulary(docs))
    rows = configured.hits(docs, forms)
    return _top(configured.matches(rows, forms), 10).join(F.broadcast(asked_for.select("query_id", "config")), "query_id")  # a row a query


_VECTOR_LEG = f"""qv AS (SELECT query_id, embedding::DOUBLE[] AS v FROM asked JOIN embeddings USING (vec_id)),
vd AS (SELECT q.query_id, e.vec_id AS id, {_COS} AS distance FROM embeddings e, qv q),
vleg AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), id) AS rank FROM vd QUALIFY rank <= 50)"""
_LEXICAL_LEG = "lleg AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank FROM matched QUALIFY rank <= 50)"
_LEGS_SQL = f"{LEXICAL_SQL}, {_VECTOR_LEG}, {_LEXICAL_LEG}"


def _legs(spark, sf_dir):
    """The two ranked lists; the artificial join vec_id = doc_id stands for a document's embedding."""
    docs, wanted, hits, matched = _lexical(spark, sf_dir)
    return r.knn(corpus_vectors(spark, sf_dir), query_vectors(spark, sf_dir), 50), _top(matched, 50)


def _fused(vector_weight: str = "1", lexical_weight: str = "2") -> str:
    return f"fused AS (SELECT query_id, id, sum(part) AS score FROM (SELECT query_id, id, {vector_weight}::DOUBLE / (60 + rank) AS part FROM vleg UNION ALL SELECT query_id, id, {lexical_weight}::DOUBLE / (60 + rank) FROM lleg) GROUP BY ALL)"


_FUSED_TOP = "SELECT query_id, id, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id)::INTEGER AS rank FROM fused QUALIFY rank <= 10"


@query("rrf_fusion", f"{_LEGS_SQL}, {_fused()} {_FUSED_TOP}")
def rrf_fusion(spark, sf_dir):
    vector, lexical = _legs(spark, sf_dir)
    fused = r.rrf([(vector, 1.0), (lexical, 2.0)]).withColumn("score", F.round("score", 9))
    return r.ranked(fused, [F.desc("score"), F.asc("id")], 10)


#: (vector, lexical) weights by kind of query (fixed values).
LEG_WEIGHTS = {"citation": (0.5, 4.0), "party_name": (0.5, 3.0), "concept": (0.5, 3.0), "section_ref": (1.0, 2.0)}
_KIND_SQL = r"""CASE WHEN regexp_matches(q, '(?i)\d{4}\s+SCC\s+\d+|\d{4}\s+AIR\s+SC') THEN 'citation' WHEN regexp_matches(q, '(?i)section\s+\d+[A-Z]?\s+(of\s+)?[\p{L}\p{N}_]+') THEN 'section_ref'
 WHEN contains(q, ' v. ') OR contains(lower(q), ' vs ') OR contains(lower(q), ' versus ') THEN 'party_name' ELSE 'concept' END"""


#: What stands before and after the first words of a text to make searches of every kind.
_ASKED_AS = (("", ""), ("2019 SCC 1 ", ""), ("plain ", ""), ("", " 1950 air sc 27"), ("Section 9 ", ""), ("on section 302A of ", ""), ("A v B ", ""), ("x versus ", ""), ("", " VS y"), ("", " v. State"), ("Article 21 ", ""))
_SEARCH_SQL = (
    f"SELECT doc_id, CASE doc_id % {len(_ASKED_AS)} " + " ".join(f"WHEN {i} THEN '{a}'" for i, (a, _) in enumerate(_ASKED_AS)) + " END || array_to_string(string_split(text, ' ')[1:4], ' ') || "
    + f"CASE doc_id % {len(_ASKED_AS)} " + " ".join(f"WHEN {i} THEN '{b}'" for i, (_, b) in enumerate(_ASKED_AS)) + " END AS q FROM documents"
)


def searches(spark, sf_dir):
    """(doc_id, q): a search for every text, made of its first words."""
    kind = (F.col("doc_id") % len(_ASKED_AS) + 1).cast("int")
    around = [F.element_at(F.array(*[F.lit(x[i]) for x in _ASKED_AS]), kind) for i in (0, 1)]
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(around[0], F.array_join(F.slice(F.split("text", " "), F.lit(1), F.lit(4)), " "), around[1]).alias("q"))


@query("classify_query", f"SELECT doc_id, q, {_KIND_SQL} AS kind FROM ({_SEARCH_SQL})")
def classify(spark, sf_dir):
    return searches(spark, sf_dir).select("doc_id", "q", classify_query(F.col("q")).alias("kind"))


@query(
    "rrf_adaptive",
    f"""{_LEGS_SQL}, kinds AS (SELECT query_id, {_KIND_SQL} AS kind FROM asked),
    weights(kind, vw, lw) AS (VALUES ('citation', 0.5, 4.0), ('party_name', 0.5, 3.0), ('concept', 0.5, 3.0), ('section_ref', 1.0, 2.0)),
    w AS (SELECT * FROM kinds JOIN weights USING (kind)),
    fused AS (SELECT query_id, id, sum(part) AS score FROM (SELECT query_id, id, vw::DOUBLE / (60 + rank) AS part FROM vleg JOIN w USING (query_id) UNION ALL SELECT query_id, id, lw::DOUBLE / (60 + rank) FROM lleg JOIN w USING (query_id)) GROUP BY ALL) {_FUSED_TOP}""",
)
def rrf_adaptive(spark, sf_dir):
    vector, lexical = _legs(spark, sf_dir)
    weights = spark.createDataFrame([(k, *w) for k, w in LEG_WEIGHTS.items()], "kind string, vw double, lw double")
    of = F.broadcast(asked(spark).select("query_id", classify_query(F.col("q")).alias("kind")).join(weights, "kind"))  # one row a query
    parts = vector.join(of, "query_id").select("query_id", "id", (F.col("vw") / (60 + F.col("rank"))).alias("part"))
    parts = parts.unionByName(lexical.join(of, "query_id").select("query_id", "id", (F.col("lw") / (60 + F.col("rank"))).alias("part")))
    fused = parts.groupBy("query_id", "id").agg(F.round(F.sum("part"), 9).alias("score"))
    return r.ranked(fused, [F.desc("score"), F.asc("id")], 10)


@query(
    "title_boost",
    f"""{_LEGS_SQL}, titles AS (SELECT query_id, doc_id AS id FROM asked, documents WHERE contains(lower(text[:200]), split_part(lower(q), ' ', 1))),
    fused AS (SELECT query_id, id, sum(part) AS score FROM (SELECT query_id, id, 1::DOUBLE / (60 + rank) AS part FROM vleg UNION ALL SELECT query_id, id, 2::DOUBLE / (60 + rank) FROM lleg UNION ALL SELECT query_id, id, 5.0::DOUBLE FROM titles) GROUP BY ALL) {_FUSED_TOP}""",
)
def title_boost(spark, sf_dir):
    """A third list of constant score: the query's first word in the opening of the text, which stands for a title."""
    vector, lexical = _legs(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lower(F.substring("text", 1, 200)).alias("title"))
    first = F.broadcast(asked(spark).select("query_id", F.split_part(F.lower("q"), F.lit(" "), F.lit(1)).alias("w")))
    titles = docs.join(first, F.contains("title", F.col("w"))).select("query_id", "id", F.lit(5.0).alias("part"))
    parts = r.rrf([(vector, 1.0), (lexical, 2.0)]).withColumnRenamed("score", "part").unionByName(titles)
    return r.ranked(parts.groupBy("query_id", "id").agg(F.round(F.sum("part"), 9).alias("score")), [F.desc("score"), F.asc("id")], 10)


_CHUNK_SQL = "chunks AS (SELECT doc_id, i AS chunk_index, substr(text, i * 1750 + 1, 1750) AS chunk_text FROM (SELECT doc_id, text, unnest(range(0, greatest(ceil(length(text) / 1750.0)::BIGINT, 1))) AS i FROM documents))"


@query(
    "rrf_multi_query",
    rf"""WITH {ASKED_SQL}, {WANTED_SQL}, {_CHUNK_SQL},
    ct AS (SELECT doc_id, chunk_index, unnest(string_split_regex(lower(chunk_text), '[^\p{{L}}\p{{N}}]+')) AS term FROM chunks),
    ch AS (SELECT doc_id, chunk_index, term, count(*) AS tf FROM ct WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
    cs AS (SELECT query_id, doc_id, chunk_index, sum(1 + ln(tf)) AS score FROM ch JOIN wanted USING (term) GROUP BY ALL),
    cr AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id, chunk_index) AS rank FROM cs QUALIFY rank <= 200),
    best AS (SELECT query_id, doc_id, min(rank) AS rank FROM cr GROUP BY ALL),
    s AS (SELECT doc_id AS id, round(sum(1.0 / (60 + rank)), 9) AS score FROM best GROUP BY doc_id)
    SELECT id, score FROM s ORDER BY score DESC, id LIMIT 30""",
)
def rrf_multi_query(spark, sf_dir):
    """Consensus over queries: each document's best chunk rank per query, summed."""
    wanted = r.query_terms(asked(spark))
    parts = r.chunks(table(spark, sf_dir, "documents")).select(F.struct("doc_id", "chunk_index").alias("chunk"), "chunk_text")
    hits = r.term_hits(parts, wanted, "chunk_text", "chunk").drop("n_terms")
    scored = r.match_counts(hits, wanted).withColumn("score", F.round("score", 6))
    top = r.ranked(scored, [F.desc("score"), F.col("id.doc_id"), F.col("id.chunk_index")], 200)
    best = top.groupBy("query_id", F.col("id.doc_id").alias("id")).agg(F.min("rank").alias("rank"))
    fused = best.groupBy("id").agg(F.round(F.sum(1.0 / (60 + F.col("rank"))), 9).alias("score"))
    return fused.orderBy(F.desc("score"), "id").limit(30)


@query("rrf_max_fusion", f"{_LEGS_SQL}, {_fused()}, b AS (SELECT id, round(max(score), 9) AS score FROM fused GROUP BY id) SELECT id, score FROM b WHERE score > 0.01 ORDER BY score DESC, id LIMIT 3")
def rrf_max_fusion(spark, sf_dir):
    vector, lexical = _legs(spark, sf_dir)
    best = r.rrf([(vector, 1.0), (lexical, 2.0)]).groupBy("id").agg(F.round(F.max("score"), 9).alias("score"))
    return best.where("score > 0.01").orderBy(F.desc("score"), "id").limit(3)


@query(
    "paged_results",
    f"""{_LEGS_SQL}, {_fused()}, n AS (SELECT query_id, count(*) AS total FROM fused GROUP BY query_id),
    o AS (SELECT query_id, id, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS pos FROM fused)
    SELECT query_id, id, pos::INTEGER AS pos, round(score * 10, 2) AS relevance, total, ceil(total / 10.0)::BIGINT AS total_pages FROM o JOIN n USING (query_id) WHERE pos > 10 AND pos <= 20""",
)
def paged_results(spark, sf_dir, page: int = 2, size: int = 10):
    vector, lexical = _legs(spark, sf_dir)
    fused = r.rrf([(vector, 1.0), (lexical, 2.0)]).withColumn("score", F.round("score", 9))
    total = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    pos = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    rows = fused.withColumn("total", total).withColumn("pos", pos).where((F.col("pos") > (page - 1) * size) & (F.col("pos") <= page * size))
    return rows.select("query_id", "id", "pos", F.round(F.col("score") * 10, 2).alias("relevance"), "total", F.ceil(F.col("total") / size).alias("total_pages"))


@query(
    "hybrid_search",
    f"""{_LEGS_SQL}, {_fused()}, top AS ({_FUSED_TOP})
    SELECT query_id, rank, id AS doc_id, score, d.lang, d.source, d.text[:200] AS snippet FROM top JOIN documents d ON d.doc_id = top.id""",
)
def hybrid_search(spark, sf_dir):
    """Vector and lexical legs, weighted reciprocal rank fusion, top ten of each query, then the texts of those only."""
    vector, lexical = _legs(spark, sf_dir)
    fused = r.rrf([(vector, 1.0), (lexical, 2.0)]).withColumn("score", F.round("score", 9))
    top = r.ranked(fused, [F.desc("score"), F.asc("id")], 10)
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.substring("text", 1, 200).alias("snippet"))
    return docs.join(F.broadcast(top.withColumnRenamed("id", "doc_id")), "doc_id").select("query_id", "rank", "doc_id", "score", "lang", "source", "snippet")  # ten rows a query


#: A provision and what names its act, and an article (fixed values).
SECTION_REF = r"[Ss]ections?\s+(\d+[A-Za-z]{0,2})(?:\s*\([0-9A-Za-z]+\))?[\s,]*(?:of\s+(?:the\s+)?)?([A-Za-z][A-Za-z ,\.\-()]{0,70})?"
ARTICLE_REF = r"[Aa]rticles?\s+(\d+[A-Za-z]?(?:-[A-Za-z])?)"
#: Code of the act whose articles are cited.
ARTICLES_OF = "COI"
#: (alias, code), longest alias first when resolved.
ALIASES = (("license act", "LA"), ("license", "L"), ("copyright act", "CA"), ("data act", "DA"), ("ipc", "IPC"))
_BODIES = (
    "Section 12 of the License Act, then Section 7, data act", "see section 302A copyright act; Article 21", "no reference", "Section 9", "sections 13(2) of the data act and articles 14 or 19",
    "Section 41A IPC. Article 51A-B", "Section 5 of recipcoat", "Section 3 of the license and copyright act",
)


@query(
    "extract_refs",
    rf"""WITH t AS (SELECT doc_id, left(text, 400) || '. ' || CASE doc_id % {len(_BODIES)} {" ".join(f"WHEN {i} THEN '{b}'" for i, b in enumerate(_BODIES))} END || '. ' || text AS body FROM documents),
    m AS (SELECT doc_id, unnest(regexp_extract_all(body, '{SECTION_REF}')) AS ref FROM t),
    p AS (SELECT doc_id, ref, regexp_extract(ref, '{SECTION_REF}', 1) AS section, lower(regexp_extract(ref, '{SECTION_REF}', 2)) AS tail FROM m),
    a(alias, code) AS (VALUES {", ".join(f"('{x}', '{c}')" for x, c in ALIASES)})
    SELECT DISTINCT doc_id, section, first(code ORDER BY length(alias) DESC, alias) AS code FROM p JOIN a ON regexp_matches(tail, '(^|[^a-z])' || alias || '($|[^a-z])') GROUP BY doc_id, section, ref, tail
    UNION SELECT DISTINCT doc_id, unnest(regexp_extract_all(body, '{ARTICLE_REF}', 1)), '{ARTICLES_OF}' FROM t""",
)
def extract_refs(spark, sf_dir):
    """(number, code) of the provisions that a text names: a section with the longest whole-word alias in what follows it, and articles. Aliases are literals here, a table in ``provision_references``."""
    named = F.element_at(F.array(*[F.lit(b) for b in _BODIES]), (F.col("doc_id") % len(_BODIES) + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.substring("text", 1, 400), F.lit(". "), named, F.lit(". "), "text").alias("body"))
    refs = rows.select("doc_id", F.explode(F.regexp_extract_all("body", F.lit(SECTION_REF), 0)).alias("ref"))
    refs = refs.select("doc_id", F.regexp_extract("ref", SECTION_REF, 1).alias("section"), F.lower(F.regexp_extract("ref", SECTION_REF, 2)).alias("tail"))
    code = F.coalesce(*[F.when(F.rlike("tail", F.lit(f"(^|[^a-z]){a}($|[^a-z])")), c) for a, c in sorted(ALIASES, key=lambda x: (-len(x[0]), x[0]))])
    articles = rows.select("doc_id", F.explode(F.regexp_extract_all("body", F.lit(ARTICLE_REF), 1)).alias("section"), F.lit(ARTICLES_OF).alias("code"))
    return refs.select("doc_id", "section", code.alias("code")).where("code is not null").unionByName(articles).distinct()


@query(
    "exact_boost",
    f"""{_LEGS_SQL}, {_fused()}, exact AS (SELECT DISTINCT query_id, doc_id AS id FROM (SELECT query_id, unnest(regexp_extract_all(q, '[0-9]+')) AS n FROM (SELECT query_id, q || ' and section ' || (vec_id % 50) AS q FROM asked)) JOIN documents ON doc_id = TRY_CAST(n AS BIGINT)),
    allp AS (SELECT query_id, id, score, FALSE AS exact FROM fused UNION ALL SELECT query_id, id, 0.5::DOUBLE, TRUE FROM exact),
    s AS (SELECT query_id, id, round(sum(score), 9) AS score, max(exact) AS exact FROM allp GROUP BY ALL)
    SELECT query_id, id, score, exact, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM s QUALIFY rank <= 10""",
)
def exact_boost(spark, sf_dir):
    """Rows that a query names exactly gain 0.5, and enter even if no leg found them."""
    vector, lexical = _legs(spark, sf_dir)
    named = asked(spark).select("query_id", F.concat("q", F.lit(" and section "), F.col("vec_id") % 50).alias("q"))
    numbers = named.select("query_id", F.explode(F.regexp_extract_all("q", F.lit(r"(\d+)"), 1)).alias("n")).select("query_id", F.col("n").try_cast("long").alias("id")).distinct()
    exact = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")).join(F.broadcast(numbers), "id").select("query_id", "id", F.lit(0.5).alias("score"), F.lit(True).alias("exact"))  # the numbers in the queries at hand
    parts = r.rrf([(vector, 1.0), (lexical, 2.0)]).withColumn("exact", F.lit(False)).unionByName(exact)
    fused = parts.groupBy("query_id", "id").agg(F.round(F.sum("score"), 9).alias("score"), F.max("exact").alias("exact"))
    return r.ranked(fused, [F.desc("score"), F.asc("id")], 10)


@query(
    "mandatory_optional_union",
    """WITH m AS (SELECT p_type AS chapter, p_brand = 'Brand#11' AS mandatory, p_partkey, p_size FROM part),
    scored AS (SELECT chapter, sum(p_size)::BIGINT AS score FROM m WHERE NOT mandatory GROUP BY chapter),
    opt AS (SELECT chapter FROM scored ORDER BY score DESC, chapter LIMIT 3)
    SELECT chapter, mandatory, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) AS rules FROM m WHERE mandatory OR chapter IN (SELECT chapter FROM opt) GROUP BY ALL""",
)
def mandatory_optional_union(spark, sf_dir):
    """All mandatory chapters, and the three best optional ones; rules joined in order."""
    rows = table(spark, sf_dir, "part").select(F.col("p_type").alias("chapter"), (F.col("p_brand") == "Brand#11").alias("mandatory"), "p_partkey", "p_size")
    best = rows.where("not mandatory").groupBy("chapter").agg(F.sum("p_size").alias("score")).orderBy(F.desc("score"), "chapter").limit(3).select("chapter", F.lit(True).alias("chosen"))
    kept = rows.join(F.broadcast(best), "chapter", "left").where("mandatory or chosen")  # three rows
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("p_partkey")), lambda x: x.cast("string")), ",")
    return kept.groupBy("chapter", "mandatory").agg(listed.alias("rules"))


@query(
    "token_overlap_flag",
    """SELECT doc_id, len(list_intersect(list_distinct(string_split(text[:800], ' ')), list_distinct(string_split(text[-800:], ' ')))) > 20 AS same FROM documents""",
)
def token_overlap_flag(spark, sf_dir):
    """More than twenty words shared by the opening and the end of a text."""
    docs = table(spark, sf_dir, "documents")
    tail = F.when(F.char_length("text") >= 800, F.substring("text", -800, 800)).otherwise(F.col("text"))
    return docs.select("doc_id", (F.size(F.array_intersect(F.split(F.substring("text", 1, 800), " "), F.split(tail, " "))) > 20).alias("same"))


#: Words that the start of a passage shares with the holding when it is the holding, words of that start, characters of the holding and of the passage (fixed values).
HOLDING_WORDS, PASSAGE_WORDS, HOLDING_CHARS, PASSAGE_CHARS = 20, 50, 250, 900


@query(
    "holding_prefix",
    rf"""WITH h AS (SELECT conv_id, text AS holding FROM conversations WHERE turn = 0),
    c AS (SELECT conv_id, turn, text, holding, list_distinct(list_filter(string_split_regex(lower(holding), '\s+'), lambda x: x <> '')) AS a, list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')[1:{PASSAGE_WORDS}]) AS b FROM conversations LEFT JOIN h USING (conv_id))
    SELECT conv_id, turn, CASE WHEN coalesce(holding, '') <> '' AND len(list_intersect(a, b)) <= {HOLDING_WORDS} THEN 'HOLDING: ' || holding[:{HOLDING_CHARS}] || chr(10) || chr(10) ELSE '' END || text[:{PASSAGE_CHARS}] AS passage FROM c""",
)
def holding_prefix(spark, sf_dir):
    """Passages behind the start of their document's holding (here a conversation's first turn), but for those that begin as the holding does."""
    turns = table(spark, sf_dir, "conversations")
    holdings = turns.where("turn = 0").select("conv_id", F.col("text").alias("holding"))
    words = lambda c: F.filter(F.split(F.lower(c), r"\s+"), lambda x: x != "")
    shared = F.size(F.array_intersect(words("holding"), F.slice(words("text"), F.lit(1), F.lit(PASSAGE_WORDS))))
    prefix = F.when((F.coalesce("holding", F.lit("")) != "") & (shared <= HOLDING_WORDS), F.concat(F.lit("HOLDING: "), F.substring("holding", 1, HOLDING_CHARS), F.lit("\n\n"))).otherwise("")
    passage = F.concat(prefix, F.substring("text", 1, PASSAGE_CHARS))
    return turns.join(holdings, "conv_id", "left").select("conv_id", "turn", passage.alias("passage"))


@query("paragraph_label", "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '[Para ' || turn || '-' || (turn + 1) || ']' WHEN turn % 3 = 1 THEN '[Para ' || turn || ']' END AS label FROM conversations")
def paragraph_label(spark, sf_dir):
    last = F.when(F.col("turn") % 3 == 0, F.col("turn") + 1)
    label = F.when(last.isNotNull(), F.format_string("[Para %d-%d]", "turn", last)).when(F.col("turn") % 3 == 1, F.format_string("[Para %d]", "turn"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", label.alias("label"))


#: A reported case, and a section of an act by its code (fixed values).
CASE_CITATION = r"\(\d{4}\)\s*\d+\s*SCC\s*\d+"
CODES = ("IPC", "CrPC", "CPC")
SECTION_CITATION = rf"Section\s*\d+[A-Z]?\s*(?:of\s*(?:the\s*)?)?(?:{'|'.join(sorted(CODES, key=len, reverse=True))})\b"
_DRAFT_SQL = "SELECT doc_id, text || ' As held in (2001) 4 SCC ' || doc_id || ' and (19' || (10 + doc_id % 90) || ') 2 SCC 7, under Section ' || (doc_id % 70) || CASE WHEN doc_id % 3 = 0 THEN 'A of the CrPC.' ELSE ' IPC.' END || ' (2001) 4 SCC ' || doc_id AS body FROM documents"


@query(
    "verify_citations",
    rf"""WITH d AS ({_DRAFT_SQL}),
    c AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(body, '{CASE_CITATION}')) AS citation FROM d),
    s AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(body, '{SECTION_CITATION}')) AS citation FROM d),
    cases AS (SELECT 'SLP in (2001) 4 SCC ' || o_orderkey || ', civil' AS name FROM orders),
    known AS (SELECT DISTINCT citation FROM c JOIN cases ON contains(lower(name), lower(citation))),
    sections AS (SELECT DISTINCT p_size || CASE WHEN p_partkey % 2 = 0 THEN 'A' ELSE '' END AS number, CASE WHEN p_partkey % 5 = 0 THEN 'CrPC' ELSE 'IPC' END AS code FROM part)
    SELECT doc_id, citation, 'case' AS kind, CASE WHEN citation IN (SELECT citation FROM known) THEN 'verified' ELSE 'not_found' END AS status FROM c
    UNION ALL SELECT doc_id, citation, 'section', CASE WHEN EXISTS (SELECT 1 FROM sections WHERE contains(lower(number), lower(regexp_extract(citation, '(\d+[A-Z]?)', 1))) AND code = regexp_extract(citation, '(IPC|CrPC|CPC)\b', 1)) THEN 'verified' ELSE 'not_found' END FROM s""",
)
def verify_citations(spark, sf_dir):
    """Distinct case and section citations of each draft, and whether the tables of cases and sections have them.

    A citation is known if it stands inside a case's name, or its number inside
    a section's number of that act. Both sides become keys (citations with every
    beginning of their last number, and every part of a short section number),
    so the joins are equi-joins.
    """
    n = F.col("doc_id")
    draft = F.concat(
        F.col("text"), F.lit(" As held in (2001) 4 SCC "), n.cast("string"), F.lit(" and (19"), (n % 90 + 10).cast("string"), F.lit(") 2 SCC 7, under Section "), (n % 70).cast("string"),
        F.when(n % 3 == 0, "A of the CrPC.").otherwise(" IPC."), F.lit(" (2001) 4 SCC "), n.cast("string"),
    )
    drafts = table(spark, sf_dir, "documents").select("doc_id", draft.alias("body"))
    cited = lambda pattern: drafts.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(pattern), 0))).alias("citation"))
    names = table(spark, sf_dir, "orders").select(F.lower(F.concat(F.lit("SLP in (2001) 4 SCC "), F.col("o_orderkey").cast("string"), F.lit(", civil"))).alias("name"))
    last = F.regexp_extract("known", r"(\d+)$", 1)
    keys = names.select(F.explode(F.regexp_extract_all("name", F.lit(CASE_CITATION.replace("SCC", "scc")), 0)).alias("known"))
    keys = keys.select(F.explode(F.transform(F.sequence(F.lit(1), F.char_length(last)), lambda i: F.concat(F.expr("substring(known, 1, char_length(known) - char_length(regexp_extract(known, '([0-9]+)$', 1)))"), F.substring(last, F.lit(1), i)))).alias("key")).distinct()
    cases = cited(CASE_CITATION).join(keys.withColumn("hit", F.lit(True)), F.lower("citation") == F.col("key"), "left").select("doc_id", "citation", F.lit("case").alias("kind"), "hit")
    part = table(spark, sf_dir, "part")
    number = F.lower(F.concat(F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 0, "A").otherwise("")))
    code = F.when(F.col("p_partkey") % 5 == 0, "CrPC").otherwise("IPC")
    whole = part.select(number.alias("number"), code.alias("act")).distinct()
    starts = whole.select("number", "act", F.explode(F.sequence(F.lit(1), F.char_length("number"))).alias("i"))
    pieces = starts.select("act", F.explode(F.transform(F.sequence(F.lit(1), F.char_length("number") - F.col("i") + 1), lambda k: F.substring("number", F.col("i"), k))).alias("key")).distinct()
    sections = cited(SECTION_CITATION).select("doc_id", "citation", F.lower(F.regexp_extract("citation", r"(\d+[A-Z]?)", 1)).alias("key"), F.regexp_extract("citation", r"(IPC|CrPC|CPC)\b", 1).alias("act"))
    sections = sections.join(pieces.withColumn("hit", F.lit(True)), ["key", "act"], "left").select("doc_id", "citation", F.lit("section").alias("kind"), "hit")
    return cases.unionByName(sections).select("doc_id", "citation", "kind", F.when(F.col("hit"), "verified").otherwise("not_found").alias("status"))


# ---- dictionaries that are tables ----------------------------------------------------------------------------------------------

_NAMED_SQL = "SELECT doc_id, text || ' See Section ' || (doc_id % 70) || 'A of the ' || a.n_name || ' Act, 1999 and Article ' || (doc_id % 400) || '. Also sections 12(3), ' || lower(b.n_name) || ' code; section 5 of nothing.' AS body FROM documents JOIN nation a ON a.n_nationkey = doc_id % 25 JOIN nation b ON b.n_nationkey = (doc_id + 7) % 25"


@query(
    "provision_references",
    rf"""WITH d AS ({_NAMED_SQL}),
    a AS (SELECT lower(n_name) || ' act' AS alias, 'A' || n_nationkey AS code FROM nation UNION ALL SELECT lower(n_name) || ' code', 'C' || n_nationkey FROM nation UNION ALL SELECT lower(n_name), 'N' || n_nationkey FROM nation),
    x AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(body, '{dictionaries.SECTION_REFERENCE}', 1)) AS section, lower(unnest(regexp_extract_all(body, '{dictionaries.SECTION_REFERENCE}', 2))) AS tail FROM d),
    m AS (SELECT doc_id, section, tail, code FROM x JOIN a ON regexp_matches(tail, '(^|[^a-z])' || regexp_escape(alias) || '($|[^a-z])') QUALIFY row_number() OVER (PARTITION BY doc_id, section, tail ORDER BY length(alias) DESC, alias) = 1)
    SELECT DISTINCT doc_id, section, code FROM m UNION SELECT doc_id, unnest(regexp_extract_all(body, '{dictionaries.ARTICLE_REFERENCE}', 1)), 'COI' FROM d""",
)
def provision_references(spark, sf_dir):
    """Sections and articles that each draft names, by a table of the acts' aliases."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (F.col("doc_id") % 25).alias("k1"), ((F.col("doc_id") + 7) % 25).alias("k2"))
    one, two = (F.broadcast(nation.select(F.col("n_nationkey").alias(k), F.col("n_name").alias(n))) for k, n in (("k1", "act"), ("k2", "code")))  # 25 rows
    body = F.concat("text", F.lit(" See Section "), F.col("doc_id") % 70, F.lit("A of the "), "act", F.lit(" Act, 1999 and Article "), F.col("doc_id") % 400, F.lit(". Also sections 12(3), "), F.lower("code"), F.lit(" code; section 5 of nothing."))
    drafts = docs.join(one, "k1").join(two, "k2").select("doc_id", body.alias("body"))
    alias = lambda end, mark: F.struct(F.concat(F.lower("n_name"), F.lit(end)).alias("alias"), F.concat(F.lit(mark), F.col("n_nationkey").cast("string")).alias("code"))
    aliases = nation.select(F.explode(F.array(alias(" act", "A"), alias(" code", "C"), alias("", "N"))).alias("x")).select("x.*")
    return dictionaries.references(drafts, "doc_id", "body", aliases)


@query(
    "expand_from_table",
    """WITH b AS (SELECT item_id AS place, string_split(text, ' ')[1] AS short, array_to_string(string_split(text, ' ')[2:3], ' ') AS full_ FROM benchmark),
    q AS (SELECT doc_id AS query_id, array_to_string(string_split(text, ' ')[1:12], ' ') AS q FROM documents),
    a AS (SELECT query_id, string_agg(' ' || full_, '' ORDER BY place) AS added FROM q JOIN b ON contains(lower(q), lower(short)) AND NOT contains(lower(q), lower(full_)) WHERE short <> '' GROUP BY query_id)
    SELECT query_id, q || coalesce(added, '') AS expanded FROM q LEFT JOIN a USING (query_id)""",
)
def expand_from_table(spark, sf_dir):
    """The first words of every text as a query, expanded by a table of short and full forms."""
    words = F.split("text", " ")
    forms = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("place"), words[0].alias("short"), F.array_join(F.slice(words, F.lit(2), F.lit(2)), " ").alias("full"))
    asked_for = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.array_join(F.slice(words, F.lit(1), F.lit(12)), " ").alias("q"))
    return dictionaries.expanded(asked_for, forms)


@query(
    "first_rule_from_table",
    r"""WITH w AS (SELECT item_id, string_split_regex(lower(text), '[^\p{L}\p{N}]+') AS w FROM benchmark),
    r AS (SELECT DISTINCT item_id AS rule, item_id % 7 AS priority, 'every' AS part, unnest(w[1:2]) AS keyword FROM w UNION SELECT item_id, item_id % 7, 'some', unnest(w[3:5]) FROM w UNION SELECT item_id, item_id % 7, 'subject', unnest(w[6:9]) FROM w),
    k AS (SELECT * FROM r WHERE keyword <> ''),
    t AS (SELECT doc_id, list_distinct(string_split_regex(lower(text), '[^\p{L}\p{N}]+')) AS tokens FROM documents),
    h AS (SELECT doc_id, rule, priority, part, count(*) AS met FROM t JOIN k ON list_contains(tokens, keyword) GROUP BY ALL),
    need AS (SELECT rule, part, count(*) AS n FROM k GROUP BY ALL),
    ok AS (SELECT doc_id, rule, priority, count(*) AS parts FROM h JOIN need USING (rule, part) WHERE part <> 'every' OR met = n GROUP BY ALL),
    best AS (SELECT doc_id, rule FROM ok JOIN (SELECT rule, count(*) AS parts FROM need GROUP BY rule) USING (rule, parts) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY priority, rule) = 1)
    SELECT doc_id, rule FROM documents LEFT JOIN best USING (doc_id)""",
)
def first_rule_from_table(spark, sf_dir):
    """The first rule, by priority, whose keywords a text holds; every benchmark item gives a rule of words that must all, or some, occur."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("rule"), (F.col("item_id") % 7).alias("priority"), F.split(F.lower("text"), TERM_GAP).alias("w"))
    part = lambda name, at, n: F.transform(F.slice("w", F.lit(at), F.lit(n)), lambda x: F.struct(F.lit(name).alias("part"), x.alias("keyword")))
    rules = items.select("rule", "priority", F.explode(F.concat(part("every", 1, 2), part("some", 3, 3), part("subject", 6, 4))).alias("x")).select("rule", "priority", "x.*")
    return dictionaries.first_rules(table(spark, sf_dir, "documents"), "doc_id", "text", rules)


@query("dictionary_mentions")
def dictionary_mentions(spark, sf_dir):
    """Places of the word pairs and triples of all benchmark items in every text, the leftmost and longest first."""
    words = table(spark, sf_dir, "benchmark").select(terms(F.col("text")).alias("w"))
    runs = words.select(F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - 1, F.lit(1)))).alias("i"), "w").select(F.explode(F.array(*[F.array_join(F.slice("w", F.col("i"), F.lit(n)), " ") for n in (2, 3)])).alias("phrase"))
    entries = runs.where("phrase like '% %'").distinct().select(F.xxhash64("phrase").alias("id"), "phrase")
    return dictionaries.mentions(table(spark, sf_dir, "documents"), "doc_id", "text", entries)
