"""Ingestion queries: markup to rows, merges, purges, backfills, JSON."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.operators import hierarchy, ingest, sections
from docloom.plans.registry import query
from docloom.sources import office
from docloom.sources.tables import table

_STRIP_SQL = r"trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gs'), '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&nbsp;', ' '), '&amp;', '&'), '[ \t\n\r\f]+', ' ', 'g'))"


def strip_tags(c):
    """Text of a markup column: scripts out, tags out, common references decoded, white space collapsed."""
    t = F.regexp_replace(F.regexp_replace(c, r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " "), r"<[^>]*>", " ")
    for name, value in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(value))
    return F.trim(F.regexp_replace(t, r"[ \t\n\r\f]+", " "))


@query("html_strip", f"SELECT page_id, {_STRIP_SQL} AS body FROM pages")
def html_strip(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", strip_tags(F.col("html")).alias("body"))


@query(
    "html_sections",
    r"""WITH s AS (SELECT page_id, unnest(string_split_regex(html, '<(p|h1|li)>')) AS part, generate_subscripts(string_split_regex(html, '<(p|h1|li)>'), 1) - 1 AS number FROM pages),
    b AS (SELECT page_id, number, trim(regexp_replace(regexp_replace(part, '<[^>]*>', ' ', 'g'), '[ \t\n\r\f]+', ' ', 'g')) AS body FROM s WHERE number >= 1),
    k AS (SELECT page_id, md5(lower(body[:40])) AS key, body, number FROM b WHERE length(body) >= 20 AND number <= 999)
    SELECT page_id, key, body[:20000] AS body FROM k QUALIFY row_number() OVER (PARTITION BY page_id, key ORDER BY length(body) DESC, number) = 1""",
)
def html_sections(spark, sf_dir, shortest: int = 20, most: int = 999, longest: int = 20_000):
    """Sections of a page; short ones and numbers over the limit drop out, the longest of equal keys stays."""
    parts = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.split("html", r"<(?:p|h1|li)>")).alias("number", "part"))
    body = F.trim(F.regexp_replace(F.regexp_replace("part", r"<[^>]*>", " "), r"[ \t\n\r\f]+", " "))
    rows = parts.where((F.col("number") >= 1) & (F.col("number") <= most)).select("page_id", "number", body.alias("body")).where(F.char_length("body") >= shortest)
    rows = rows.withColumn("key", F.md5(F.lower(F.substring("body", 1, 40)).cast("binary")))
    best = Window.partitionBy("page_id", "key").orderBy(F.desc(F.char_length("body")), "number")
    return rows.withColumn("n", F.row_number().over(best)).where("n = 1").select("page_id", "key", F.substring("body", 1, longest).alias("body"))


@query(
    "nested_sections",
    r"""WITH t AS (SELECT conv_id, turn // 2 AS k, turn % 2 AS inner_, trim(regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g')) AS body, string_split(trim(regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g')), ' ') AS w FROM conversations),
    o AS (SELECT a.conv_id, a.k, a.body, a.w, b.body AS inner_body, b.w AS inner_w FROM t a LEFT JOIN t b ON b.conv_id = a.conv_id AND b.k = a.k AND b.inner_ = 1 WHERE a.inner_ = 0),
    s AS (SELECT conv_id, (k + 1)::VARCHAR AS number, regexp_replace(array_to_string(w[1:3], ' '), '[ .—\-–]+$', '') AS title,
        CASE WHEN inner_body IS NULL THEN body ELSE body || ' ' || (k + 1) || '-A. ' || array_to_string(inner_w[1:3], ' ') || ' — (1) ' || inner_body || ' end' END AS text FROM o
      UNION ALL SELECT conv_id, (k + 1) || '-A', regexp_replace(array_to_string(inner_w[1:3], ' '), '[ .—\-–]+$', ''), inner_body || ' end' FROM o WHERE inner_body IS NOT NULL)
    SELECT conv_id, number, title, text[:20000] AS text FROM s WHERE length(text) >= 20""",
)
def nested_sections(spark, sf_dir):
    """Sections of one page a conversation: a section for every second turn, and inside it one for the turn that follows, with paragraphs of the same tag around the text."""
    flat = F.trim(F.regexp_replace("text", r"[ \t\n\r\f]+", " "))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", flat.alias("body"), F.floor(F.col("turn") / 2).cast("int").alias("k"))
    start = lambda c: F.array_join(F.slice(F.split(c, " "), F.lit(1), F.lit(3)), " ")
    number = F.concat((F.col("k") + 1).cast("string"), F.when(F.col("turn") % 2 == 1, "-A").otherwise(""))
    opened = F.concat(F.lit('<section class="akn-section" id="section_'), number, F.lit('"><h3>'), number, F.lit(". "), start(F.col("body")), F.when(F.col("turn") % 2 == 1, " — (1) ").otherwise(""), F.lit('</h3> <section class="akn-subsection"><p>'), "body", F.lit("</p></section>"))
    parts = turns.select("conv_id", "turn", F.concat(opened, F.when(F.col("turn") % 2 == 1, " end</section></section>").otherwise(" ")).alias("part"), "k")
    pairs = parts.groupBy("conv_id", "k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "part"))), lambda x: x["part"]), "").alias("part"), F.max("turn").alias("last"))
    whole = pairs.withColumn("part", F.concat("part", F.when(F.col("last") % 2 == 0, "</section>").otherwise("")))
    pages = whole.groupBy("conv_id").agg(F.concat(F.lit("</section><html>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "part"))), lambda x: x["part"]), "<hr>"), F.lit("</html>")).alias("html"))
    return sections.numbered_sections(pages, "conv_id", "html", strip_tags)


@query(
    "hierarchy_tables",
    """WITH s AS (SELECT r_regionkey AS tree, n_nationkey, n_name, s_suppkey, s_name, s_acctbal, dense_rank() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey)::INTEGER AS c, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey, s_suppkey)::INTEGER AS t
        FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey)
    SELECT DISTINCT tree, 'category' AS kind, c AS id, 0 AS parent, n_name AS name, 'high' AS mark FROM s
    UNION ALL SELECT tree, 'case_type', t, c, s_name, CASE WHEN s_acctbal < 0 THEN 'true' ELSE 'false' END FROM s
    UNION ALL SELECT tree, 'sub_category', 2 * t - 2 + i, t, s_name || CASE i WHEN 1 THEN '-a' ELSE '-b' END, '' FROM s, (VALUES (1), (2)) v(i)
    UNION ALL SELECT tree, 'requirement', 2 * t - 2 + i, t, CASE i WHEN 1 THEN 'Order of ' || s_name ELSE 'Deed, If Any' END, CASE i WHEN 1 THEN 'required' ELSE 'optional' END FROM s, (VALUES (1), (2)) v(i)""",
)
def hierarchy_tables(spark, sf_dir):
    """Four tables with keys from one JSON tree a region: its nations, their suppliers, and two lists of each supplier."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").alias("tree"))
    held = table(spark, sf_dir, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 rows
    case_type = F.struct(
        F.col("s_suppkey").alias("at"), F.col("s_name").alias("name"), F.col("s_suppkey").cast("string").alias("code"), F.when(F.col("s_acctbal") < 0, True).alias("defective"),
        F.array(F.concat("s_name", F.lit("-a")), F.concat("s_name", F.lit("-b"))).alias("subCategories"), F.array(F.concat(F.lit("Order of "), "s_name"), F.lit("Deed, If Any")).alias("fileWith"),
    )
    by_nation = held.groupBy("tree", "n_nationkey", "n_name").agg(F.array_sort(F.collect_list(case_type)).alias("caseTypes"))
    trees = by_nation.groupBy("tree").agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("at"), F.col("n_name").alias("name"), "caseTypes"))).alias("categories"))).alias("json"))
    made = hierarchy.normalised(trees, "tree", "json")
    parts = [
        made["categories"].select("tree", F.lit("category").alias("kind"), F.col("category_id").alias("id"), F.lit(0).alias("parent"), "name", F.col("court_level").alias("mark")),
        made["case_types"].select("tree", F.lit("case_type").alias("kind"), F.col("case_type_id").alias("id"), F.col("category_id").alias("parent"), "name", F.col("defective").cast("string").alias("mark")),
        made["sub_categories"].select("tree", F.lit("sub_category").alias("kind"), F.col("sort_order").alias("id"), F.col("case_type_id").alias("parent"), "name", F.lit("").alias("mark")),
        made["requirements"].select("tree", F.lit("requirement").alias("kind"), F.col("sort_order").alias("id"), F.col("case_type_id").alias("parent"), F.col("document_name").alias("name"), F.col("requirement_type").alias("mark")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(
    "docx_texts",
    r"""SELECT doc_id, CASE doc_id % 7 WHEN 6 THEN 'Unsupported file type for OCR.' WHEN 5 THEN '' ELSE regexp_replace(array_to_string(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9)) <> ''), chr(10)), '^\s+|\s+$', '', 'g') END AS text,
      CASE doc_id % 7 WHEN 6 THEN 'unsupported' WHEN 5 THEN 'broken' ELSE 'read' END AS status FROM documents""",
)
def docx_texts(spark, sf_dir):
    """Every text written as a DOCX file and read again; a seventh of the files is cut off, a seventh has another suffix."""
    name = F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 7 == 6, ".odt").otherwise(".DOCX"))
    files = office.write_docx(table(spark, sf_dir, "documents").select(name.alias("name"), "text"), "name", "text")
    cut = F.col("path").rlike("DOCX$") & (F.regexp_extract("path", r"^(\d+)", 1).cast("long") % 7 == 5)
    files = files.withColumn("content", F.when(cut, F.substring("content", 1, 40)).otherwise(F.col("content")))
    return office.read_texts(files).select(F.regexp_extract("path", r"^(\d+)", 1).cast("long").alias("doc_id"), "text", "status")


@query(
    "majority_vote",
    """WITH v AS (SELECT regexp_extract(url, '://([^/]+)/', 1) AS host, regexp_extract(url, '/(en|de|fr|es)/', 1) AS lang FROM pages), c AS (SELECT host, lang, count(*) AS votes FROM v GROUP BY ALL)
    SELECT host, lang, votes FROM c WHERE lang IN ('en', 'de', 'fr') QUALIFY row_number() OVER (PARTITION BY host ORDER BY votes DESC, lang) = 1""",
)
def majority_vote(spark, sf_dir):
    """The most named value of each host that passes the check."""
    votes = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^/]+)/", 1).alias("host"), F.regexp_extract("url", "/(en|de|fr|es)/", 1).alias("lang")).groupBy("host", "lang").agg(F.count(F.lit(1)).alias("votes"))
    best = Window.partitionBy("host").orderBy(F.desc("votes"), "lang")
    return votes.where(F.col("lang").isin("en", "de", "fr")).withColumn("n", F.row_number().over(best)).where("n = 1").drop("n")


@query(
    "json_tree",
    "SELECT r_name AS category, n_name AS type, s_name AS item, regexp_matches(lower(s_name), '1|7') AS optional FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey",
)
def json_tree(spark, sf_dir):
    """A nested JSON document per region, read by schema and exploded level by level."""
    items = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.collect_list("s_name").alias("items"))
    types = table(spark, sf_dir, "nation").join(items, F.col("n_nationkey") == F.col("s_nationkey")).groupBy("n_regionkey").agg(F.collect_list(F.struct(F.col("n_name").alias("type"), "items")).alias("types"))
    docs = table(spark, sf_dir, "region").join(types, F.col("r_regionkey") == F.col("n_regionkey")).select(F.to_json(F.struct(F.col("r_name").alias("category"), "types")).alias("json"))
    tree = docs.select(F.from_json("json", "category string, types array<struct<type: string, items: array<string>>>").alias("t"))
    rows = tree.select("t.category", F.explode("t.types").alias("k")).select("category", "k.type", F.explode("k.items").alias("item"))
    return rows.withColumn("optional", F.rlike(F.lower("item"), F.lit("1|7")))


@query(
    "fill_forward_group",
    """SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text[:30] END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS heading FROM conversations QUALIFY role <> 'user'""",
)
def fill_forward_group(spark, sf_dir):
    rows = ingest.fill_forward(table(spark, sf_dir, "conversations"), F.col("role") == "user", F.substring("text", 1, 30), ["turn"], ["conv_id"], "heading")
    return rows.where("role <> 'user'").select("conv_id", "turn", "heading")


@query("seed_rows", "SELECT event_id, (props::JSON->>'k')::INTEGER AS k FROM events WHERE event_id % 10 <> 3 AND (props::JSON->>'k') IS NOT NULL")
def seed_rows(spark, sf_dir):
    """Typed rows from JSON text; rows without a required value drop out."""
    given = F.when(F.col("event_id") % 10 != 3, F.col("props")).otherwise("{}")
    return table(spark, sf_dir, "events").select("event_id", F.from_json(given, "k int").alias("j")).select("event_id", "j.k").dropna(subset=["k"])


_NEW = "SELECT p_partkey + 100 AS p_partkey, p_name || ' new' AS p_name, p_size FROM part WHERE p_partkey % 3 = 0"


def _old_new(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    new = part.where("p_partkey % 3 = 0").select((F.col("p_partkey") + 100).alias("p_partkey"), F.concat("p_name", F.lit(" new")).alias("p_name"), "p_size")
    return part.select("p_partkey", "p_name", "p_size"), new


@query("upsert_merge", f"WITH n AS ({_NEW}) SELECT * FROM n UNION ALL SELECT p_partkey, p_name, p_size FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM n)")
def upsert_merge(spark, sf_dir):
    return ingest.upsert(*_old_new(spark, sf_dir), ["p_partkey"])


@query("insert_ignore", f"WITH n AS ({_NEW}) SELECT p_partkey, p_name, p_size FROM part UNION ALL SELECT * FROM n WHERE p_partkey NOT IN (SELECT p_partkey FROM part)")
def insert_ignore(spark, sf_dir):
    return ingest.insert_ignore(*_old_new(spark, sf_dir), ["p_partkey"])


@query("insert_where_absent", "SELECT n_name FROM nation UNION ALL SELECT name FROM (VALUES ('ATLANTIS'), ('NATION_3')) v(name) WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_name = name)")
def insert_where_absent(spark, sf_dir):
    new = spark.createDataFrame([("ATLANTIS",), ("NATION_3",)], "n_name string")
    return ingest.insert_ignore(table(spark, sf_dir, "nation").select("n_name"), new, ["n_name"])


@query(
    "conditional_upsert",
    """WITH o AS (SELECT doc_id, text AS t, source AS title FROM documents WHERE doc_id % 4 <> 0), n AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || text ELSE text END AS t, source || '!' AS title FROM documents WHERE doc_id % 5 <> 0),
    b AS (SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, o.t AS ot, o.title AS oi, n.t AS nt, n.title AS ni, CASE WHEN o.doc_id IS NULL THEN 'inserted' WHEN n.doc_id IS NOT NULL AND (length(n.t) > 1.2 * length(o.t) OR length(o.t) > 20000 OR length(o.title) > 180) THEN 'updated' ELSE 'untouched' END AS action FROM o FULL JOIN n USING (doc_id))
    SELECT action, count(*) AS n, sum(length(CASE WHEN action = 'untouched' THEN ot ELSE nt END))::BIGINT AS chars, count_if(action <> 'untouched')::BIGINT AS cleared FROM b GROUP BY action""",
)
def conditional_upsert(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    old = docs.where("doc_id % 4 <> 0").select("doc_id", "text", "source")
    new = docs.where("doc_id % 5 <> 0").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat("text", "text")).otherwise(F.col("text")).alias("text"), F.concat("source", F.lit("!")).alias("source"))
    rows = ingest.conditional_upsert(old, new, "doc_id", "text", "source")
    return rows.groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("text")).alias("chars"), F.count_if("embedding_cleared").alias("cleared"))


_KEY_SQL = "CASE WHEN doc_id % 6 = 0 THEN (doc_id * 17)::VARCHAR WHEN doc_id % 6 = 1 THEN doc_id || 'A' ELSE (doc_id % 1000)::VARCHAR END"


@query("junk_purge", f"SELECT doc_id, key FROM (SELECT doc_id, {_KEY_SQL} AS key, text FROM documents) WHERE NOT (coalesce(regexp_matches(key, '^\\d+$') AND try_cast(key AS BIGINT) > 999, FALSE) OR trim(coalesce(text, '')) = '')")
def junk_purge(spark, sf_dir):
    key = F.when(F.col("doc_id") % 6 == 0, (F.col("doc_id") * 17).cast("string")).when(F.col("doc_id") % 6 == 1, F.concat(F.col("doc_id").cast("string"), F.lit("A"))).otherwise((F.col("doc_id") % 1000).cast("string"))
    rows = table(spark, sf_dir, "documents").select("doc_id", key.alias("key"), "text")
    return rows.where(~ingest.is_junk(F.col("key"), F.col("text"))).select("doc_id", "key")


@query("embed_text_template", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang || ': ' || source ELSE text[:2500] END AS template FROM documents")
def embed_text_template(spark, sf_dir):
    """What is sent to an encoder: the summary fields if there are any, else the opening of the text."""
    summary = F.when(F.col("doc_id") % 2 == 0, F.concat_ws(": ", "lang", "source"))
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(summary, F.substring("text", 1, 2500)).alias("template"))


@query("embed_missing")
def embed_missing(spark, sf_dir):
    """Null vectors filled by an encoder that the caller supplies; here letter shares stand for a model."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 3 == 0, F.array(*[F.lit(0.0)] * 4)).alias("vector"))
    encode = lambda texts: [[t.count(c) / max(len(t), 1) for c in "etan"] for t in texts]
    return ingest.embed_missing(rows, "text", "vector", encode).select("doc_id", "vector")


@query(
    "backlink_orphans",
    """WITH u AS (SELECT event_id, user_id % 50 AS session, CASE WHEN event_id % 3 = 0 THEN event_id END AS draft_id FROM events), c(session, draft_id) AS (VALUES (1, 9001), (7, 9007), (49, 9049))
    SELECT event_id, u.session, coalesce(u.draft_id, c.draft_id) AS draft_id FROM u LEFT JOIN c ON u.session = c.session""",
)
def backlink_orphans(spark, sf_dir):
    uploads = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 50).alias("session"), F.when(F.col("event_id") % 3 == 0, F.col("event_id")).alias("draft_id"))
    claims = spark.createDataFrame([(1, 9001), (7, 9007), (49, 9049)], "session long, draft_id long")
    return ingest.backlink(uploads, claims, "session", "draft_id").select("event_id", "session", "draft_id")


@query("map_update", "WITH m(k, v) AS (VALUES (1, 'x,y'), (4, 'z'), (99, 'none')) SELECT n_nationkey, coalesce(v, n_name) AS domains FROM nation LEFT JOIN m ON k = n_nationkey")
def map_update(spark, sf_dir):
    new = spark.createDataFrame([(1, "x,y"), (4, "z"), (99, "none")], "n_nationkey int, v string")
    return table(spark, sf_dir, "nation").join(F.broadcast(new), "n_nationkey", "left").select("n_nationkey", F.coalesce("v", "n_name").alias("domains"))


@query("presave_normalise", "SELECT doc_id, nullif(trim(replace(CASE WHEN doc_id % 9 = 0 THEN '  ' WHEN doc_id % 9 = 1 THEN 'a' || chr(1) || 'b' ELSE source END, chr(1), '')), '') AS body FROM documents")
def presave_normalise(spark, sf_dir):
    """Control characters that a database refuses are taken out; empty becomes null."""
    raw = F.when(F.col("doc_id") % 9 == 0, "  ").when(F.col("doc_id") % 9 == 1, "a\u0001b").otherwise(F.col("source"))
    clean = F.translate(raw, "\u0000\u0001", "")
    return table(spark, sf_dir, "documents").select("doc_id", F.nullif(F.trim(clean), F.lit("")).alias("body"))


# ---- JSON ----------------------------------------------------------------------------------------------------------------


@query("json_decode", "SELECT event_id, CASE WHEN event_id % 8 <> 5 THEN (props::JSON->>'k')::INTEGER END AS k, event_id % 8 = 5 AS broken FROM events")
def json_decode(spark, sf_dir):
    """JSON inside a code fence, or broken: null instead of an error."""
    given = F.when(F.col("event_id") % 8 == 5, "{not json").when(F.col("event_id") % 8 == 1, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).otherwise(F.col("props"))
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.trim(given), r"^```(json)?\s*", ""), r"\s*```$", ""))
    rows = table(spark, sf_dir, "events").select("event_id", F.try_parse_json(plain).alias("v"))
    return rows.select("event_id", F.try_variant_get("v", "$.k", "int").alias("k"), F.col("v").isNull().alias("broken"))


@query("form_summary", "SELECT conv_id, turn, 'role=' || role || '; text=' || CASE WHEN length(text) > 100 THEN text[:100] || '...' ELSE text END AS summary FROM conversations")
def form_summary(spark, sf_dir):
    """Fields of an open form (a map) with long values cut to a preview."""
    form = F.create_map(F.lit("role"), "role", F.lit("text"), "text")
    short = F.transform_values(form, lambda k, v: F.when(F.char_length(v) > 100, F.concat(F.substring(v, 1, 100), F.lit("..."))).otherwise(v))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", short.alias("f"))
    return rows.select("conv_id", "turn", F.array_join(F.transform(F.map_keys("f"), lambda k: F.concat(k, F.lit("="), F.try_element_at("f", k))), "; ").alias("summary"))


@query("json_append", "SELECT conv_id, turn, '[{\"turn\":0},{\"turn\":' || turn || '}]' AS log FROM conversations")
def json_append(spark, sf_dir):
    log = F.from_json(F.lit('[{"turn":0}]'), "array<struct<turn: bigint>>")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.to_json(F.array_append(log, F.struct("turn"))).alias("log"))


@query("fingerprint", "SELECT doc_id, md5(coalesce(lang, '') || '|' || coalesce(source, '') || '|' || text) AS cache_key, sha1(text) AS content_key FROM documents")
def fingerprint(spark, sf_dir):
    key = F.concat(F.coalesce("lang", F.lit("")), F.lit("|"), F.coalesce("source", F.lit("")), F.lit("|"), "text")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(key.cast("binary")).alias("cache_key"), F.sha1(F.col("text").cast("binary")).alias("content_key"))
