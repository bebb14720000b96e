"""Thin queries over whole tables, one for each operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import bpe, debruijn, exact_dedup, filter_audit, fingerprints, html_extraction, mixing, ngram_join, sharding, spelling, suffix_dedup, token_counts, toxicity
from docloom.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@_query(
    "op1_exact_dedup",
    f"""
    WITH n AS (SELECT doc_id, {_LOWER} AS t FROM documents)
    SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
           doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
    FROM n
    """,
)
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@_query("op6_sharding")
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), weights=[1.0] * 40)


def _vocabulary():
    import public_tokenizers

    return bpe.Vocabulary.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


#: Id that ends a document in token files: the first one that the vocabulary leaves free.
END_OF_DOCUMENT = 50256


@_query("op2_token_counts")
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted in flat token files written from the table."""
    written = token_counts.write_token_files(table(spark, sf_dir, "documents"), _vocabulary(), END_OF_DOCUMENT)
    counts = token_counts.separator_counts(written.where("ordinal = 0").select("file", "n_bytes"), END_OF_DOCUMENT)
    return written.join(counts.hint("merge"), ["file", "ordinal"]).select(F.col("key").alias("doc_id"), "n_tokens")


@_query("op3_fingerprints")
def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("tie", F.xxhash64("text"))
    rows = fingerprints.with_next(docs, "doc_id", "tie", ["text", "fingerprint"], lambda d: fingerprints.fingerprint(d))
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - quarter), F.substring("next_text", F.lit(1), quarter))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "fingerprint", "next_fingerprint", edited.alias("edited"))
    rows = fingerprints.fingerprint(rows, "edited", "edited_fingerprint").withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)).drop("edited")
    rows = fingerprints.with_likeness(rows, [("fingerprint", "edited_fingerprint", "near_edited"), ("fingerprint", "next_fingerprint", "near_next")])
    return rows.select("doc_id", "n_chars", "edited_sha256", F.lower(F.hex("fingerprint")).alias("fingerprint"), F.lower(F.hex("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next")


@_query("op4_byte_bpe")
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = _vocabulary()
    encoded = bpe.encode(table(spark, sf_dir, "documents"), vocabulary, keep=["doc_id"])
    decoded = bpe.decode(encoded, vocabulary)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def held_out(doc_id=None):
    """Rows that no label is learned from."""
    return F.crc32((F.col("doc_id") if doc_id is None else doc_id).cast("string").cast("binary")) % 4 == 2


#: Score from which a text counts as toxic.
TOXIC_FROM = 0.3


@_query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), ~held_out())
    rows = toxicity.score(docs, model, ["doc_id"])
    return rows.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


#: Exponents of the corpus shares that sources, languages and topics are raked to.
MIX = {"source": 0.7, "lang": 0.8, "topic": 0.9}


@_query("op7_mixing", mixing.oracle_sql(MIX))
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.with_probabilities(table(spark, sf_dir, "documents"), MIX)
    named = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("source", "lang")]
    return rows.select("doc_id", *named, "topic", "tokens", F.round("probability", 6).alias("probability"), "selected")


@_query("op9_html_extraction")
def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    rows = html_extraction.extract(pages, ["page_id", "url"], model=html_extraction.learn(pages, ["page_id", "url"]))
    return rows.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@_query("op10_suffix_dedup")
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=50)
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@_query("op8_ngram_join")
def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ngram_join.jaccard_components(table(spark, sf_dir, "documents"), n=4, top=85, bottom=100)
    return rows.select("doc_id", "n_shingles", "component_id")


_LETTERS = "(VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16))"


@_query(
    "op11_filter_audit",
    rf"""
    WITH t AS (
      SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
    m AS (
      SELECT part, (CASE WHEN len(words) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END)
             + (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 4 ELSE 0 END)
             + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END)
             + (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END) AS mask,
             coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS bad
      FROM t LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) USING (doc_id)),
    n AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad FROM m GROUP BY 1, 2),
    o AS (
      SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits
      FROM {_LETTERS} a(l, b), {_LETTERS} b(l, b), {_LETTERS} c(l, b), {_LETTERS} d(l, b), {_LETTERS} e(l, b)
      WHERE a.b + b.b + c.b + d.b + e.b = 31 AND len(list_distinct([a.b, b.b, c.b, d.b, e.b])) = 5),
    s AS (
      SELECT filter_order, i::INT AS step, bits[i] AS bit, (list_sum(bits[1:i]) - bits[i])::INT AS before FROM o, range(1, 6) r(i)),
    x AS (SELECT s.*, n.*, n.mask & s.bit <> 0 AS fails, n.mask & s.before = 0 AS spared FROM s, n)
    SELECT part, filter_order, step, coalesce(sum(n) FILTER (NOT fails AND spared), 0)::BIGINT AS kept,
           coalesce(sum(n) FILTER (fails AND spared), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (fails AND NOT spared), 0)::BIGINT AS redundant,
           coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (fails AND spared), 0)::BIGINT AS good_lost,
           coalesce(sum(bad) FILTER (fails AND spared), 0)::BIGINT AS toxic_lost, coalesce(sum(n * 120 // greatest(bit_count(mask), 1)) FILTER (fails), 0)::BIGINT AS shapley
    FROM x GROUP BY part, filter_order, step
    """,
)
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = filter_audit.measure(table(spark, sf_dir, "documents"), ["doc_id", "lang"])
    return filter_audit.audit(measured, filter_audit.text_filters(), table(spark, sf_dir, "labels"), part="lang")


@_query(
    "op12_spelling_variants",
    r"""
    WITH RECURSIVE bits(i, k, c) AS (
      SELECT i, 0, i FROM range(256) r(i)
      UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
    runs AS (
      SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
      FROM documents),
    counted AS (SELECT id, run, count(*) AS n, hex(encode(id || ':' || run)) AS bytes FROM runs GROUP BY id, run),
    summed(id, run, n, bytes, place, c) AS (
      SELECT id, run, n, bytes, 0, 4294967295 FROM counted
      UNION ALL
      SELECT id, run, n, bytes, place + 1, xor(s.c >> 8, b.c) FROM summed s JOIN bits b ON b.k = 8 AND b.i = xor(s.c & 255, ('0x' || bytes[2 * place + 1:2 * place + 2])::BIGINT)
      WHERE place < length(bytes) // 2),
    hashed AS (SELECT run, n, xor(c, 4294967295) AS h, (xor(c, 4294967295) % length(run))::INT AS place FROM summed WHERE place = length(bytes) // 2),
    words AS (
      SELECT CASE WHEN h % 97 = 0 THEN substring(run, 1, place) || substring(run, place + 2) ELSE run END AS word, sum(n)::BIGINT AS n
      FROM hashed GROUP BY 1 HAVING length(word) >= 5 AND sum(n) >= 3),
    places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
    holes AS (SELECT word, n, i, substring(word, 1, i - 1) || chr(1) || substring(word, i + 1) AS hole, substring(word, 1, i - 1) || substring(word, i + 1) AS without FROM places),
    near AS (
      SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM holes a JOIN holes b ON a.hole = b.hole AND a.word <> b.word
      UNION SELECT h.word, h.n, w.word, w.n FROM holes h JOIN words w ON h.without = w.word
      UNION SELECT w.word, w.n, h.word, h.n FROM holes h JOIN words w ON h.without = w.word),
    best AS (SELECT word, any_value(n) AS n, count(*) AS n_near, min(struct_pack(n := -other_n, other := encode(other))) AS b FROM near GROUP BY word),
    forms AS (SELECT word, decode(b.other) AS form, -b.n AS form_n FROM best WHERE -b.n >= 2 * n),
    steps(word, root) AS (SELECT word, form FROM forms UNION ALL SELECT s.word, f.form FROM steps s JOIN forms f ON s.root = f.word),
    roots AS (SELECT s.word, s.root FROM steps s WHERE s.root NOT IN (SELECT word FROM forms))
    SELECT w.word, form, coalesce(root, w.word) AS root, w.n, coalesce(n_near, 0)::BIGINT AS n_near, form_n::BIGINT AS form_n
    FROM words w LEFT JOIN best USING (word) LEFT JOIN forms USING (word) LEFT JOIN roots USING (word)
    """,
)
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.count_words(table(spark, sf_dir, "documents"), damaged_one_in=97))


@_query(
    "op13_debruijn_dedup",
    r"""
    WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    p AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
    s AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i, unnest(list_transform(range(1, len(ws) - 11), lambda i: array_to_string(ws[i:i + 12], ' '))) AS seq FROM w),
    f AS (SELECT doc_id, i, (doc_id > min(doc_id) OVER (PARTITION BY seq))::INT AS repeated FROM s),
    m AS (
      SELECT p.*, coalesce(max(repeated) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW), 0) = 1 AS gone
      FROM p LEFT JOIN f USING (doc_id, i)),
    k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM m GROUP BY doc_id)
    SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM w LEFT JOIN k USING (doc_id)
    """,
)
def op13_debruijn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = debruijn.remove_repeats(table(spark, sf_dir, "documents"), length=13)
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
