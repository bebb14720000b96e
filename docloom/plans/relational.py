"""Filters, joins, aggregates, windows, rerank rules and evaluation over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import text as ft
from docloom.operators import rerank
from docloom.plans.registry import query
from docloom.sources.tables import table


# ---- scans and filters -------------------------------------------------------------------------------------------------


@query("taxonomy_scan", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2 ORDER BY n_name")
def taxonomy_scan(spark, sf_dir):
    return table(spark, sf_dir, "nation").where("n_regionkey = 2").select("n_nationkey", "n_name").orderBy("n_name")


@query("point_lookup", "SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id = 77 LIMIT 1")
def point_lookup(spark, sf_dir, doc_id: int = 77):
    return table(spark, sf_dir, "documents").where(F.col("doc_id") == doc_id).select("doc_id", "lang", "source", "n_chars").limit(1)


@query("in_list_filter", "SELECT doc_id, lang FROM documents WHERE lang IN ('de', 'fr') AND source IN ('src1', 'src2', 'src3')")
def in_list_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.col("lang").isin("de", "fr") & F.col("source").isin("src1", "src2", "src3")).select("doc_id", "lang")


@query("array_overlap_filter", "SELECT p_partkey FROM part WHERE list_has_any(string_split(p_name, ' '), ['red', 'small', 'bolt'])")
def array_overlap_filter(spark, sf_dir):
    wanted = F.array(F.lit("red"), F.lit("small"), F.lit("bolt"))
    return table(spark, sf_dir, "part").where(F.arrays_overlap(F.split("p_name", " "), wanted)).select("p_partkey")


@query("any_of_ids", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT unnest([1, 7, 33, 100, 999999999]))")
def any_of_ids(spark, sf_dir):
    wanted = spark.createDataFrame([(i,) for i in (1, 7, 33, 100, 999_999_999)], "o_orderkey long")
    return table(spark, sf_dir, "orders").join(F.broadcast(wanted), "o_orderkey", "left_semi").select("o_orderkey", "o_totalprice")  # five rows


@query("unknown_tolerant_filter", "SELECT doc_id, k FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 11 = 0 THEN NULL ELSE lang END AS k FROM documents) WHERE k IN ('en') OR nullif(k, '') IS NULL")
def unknown_tolerant_filter(spark, sf_dir):
    """An empty or null kind is unknown, and stays."""
    k = F.when(F.col("doc_id") % 7 == 0, "").when(F.col("doc_id") % 11 == 0, None).otherwise(F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", k.alias("k")).where(F.col("k").isin("en") | F.nullif("k", F.lit("")).isNull())


_PARTIES = """SELECT o_orderkey, c_name AS a, s_name AS b FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey"""


@query("party_symmetric_match", f"SELECT * FROM ({_PARTIES}) WHERE (a ILIKE '%01%' AND b ILIKE '%000005%') OR (a ILIKE '%000005%' AND b ILIKE '%01%')")
def party_symmetric_match(spark, sf_dir, one: str = "01", other: str = "000005"):
    """Both names, whichever column holds which; wildcards in the names are escaped."""
    like = lambda c, x: F.ilike(F.col(c), F.lit("%" + x.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"))
    pairs = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("b")).where(like("b", one) | like("b", other))
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("a")).where(like("a", one) | like("a", other))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    rows = pairs.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.where((like("a", one) & like("b", other)) | (like("a", other) & like("b", one))).select("o_orderkey", "a", "b")


@query("search_filters", "SELECT doc_id FROM documents WHERE lang IN ('en', 'es') AND source IN ('src1', 'src4') AND contains(lower(text), 'the')")
def search_filters(spark, sf_dir):
    """One filter struct that every branch of a search applies, with and without a text."""
    wanted = {"lang": ["en", "es"], "source": ["src1", "src4"]}
    rows = table(spark, sf_dir, "documents")
    for column, values in wanted.items():
        rows = rows.where(F.col(column).isin(values))
    return rows.where(F.contains(F.lower("text"), F.lit("the"))).select("doc_id")


@query("keyword_boundary_match", "SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^A-Za-z0-9_])(idiot|license|die und)($|[^A-Za-z0-9_])')")
def keyword_boundary_match(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(ft.boundary_any(F.lower("text"), ["idiot", "license", "die und"])).select("doc_id")


#: (priority, all of, any of, any of for the subject, hint): demo rules.
RULES = ((1, ["red"], ["widget", "ring"], [], "A"), (2, [], ["small", "blue"], ["economy"], "B"), (3, ["large"], [], [], "C"), (4, [], ["standard"], [], "D"), (5, [], [], ["promo"], "skipped"))
_W = "regexp_matches(t, '(^|[^A-Za-z0-9_]){}($|[^A-Za-z0-9_])')"


@query(
    "first_match_rule",
    f"""WITH p AS (SELECT p_partkey, lower(p_name || ' ' || p_type) AS t FROM part)
    SELECT p_partkey, CASE WHEN {_W.format('red')} AND {_W.format('(widget|ring)')} THEN 'A' WHEN {_W.format('(small|blue)')} AND {_W.format('economy')} THEN 'B'
      WHEN {_W.format('large')} THEN 'C' WHEN {_W.format('standard')} THEN 'D' END AS hint FROM p""",
)
def first_match_rule(spark, sf_dir):
    """The first rule by priority whose conditions all hold; rules without keywords are skipped."""
    t = F.lower(F.concat("p_name", F.lit(" "), "p_type"))
    hint = F.lit(None).cast("string")
    for _, every, some, subject, value in sorted(RULES, key=lambda r: r[0], reverse=True):
        if not every and not some:
            continue
        holds = F.lit(True)
        for k in every:
            holds = holds & ft.boundary_any(t, [k])
        for group in (some, subject):
            if group:
                holds = holds & ft.boundary_any(t, group)
        hint = F.when(holds, value).otherwise(hint)
    return table(spark, sf_dir, "part").select("p_partkey", hint.alias("hint"))


#: Ordered parts of a subject and the domain they mean.
DOMAINS = (("ring", "metals"), ("widget", "metals"), ("small", "finish"), ("economy", "price"), ("standard", "civil"))


@query("domain_resolve", "SELECT p_partkey, CASE WHEN contains(lower(p_name || ' ' || p_type), 'ring') OR contains(lower(p_name || ' ' || p_type), 'widget') THEN 'metals' WHEN contains(lower(p_name || ' ' || p_type), 'small') THEN 'finish' WHEN contains(lower(p_name || ' ' || p_type), 'economy') THEN 'price' WHEN contains(lower(p_name || ' ' || p_type), 'standard') THEN 'civil' ELSE '' END AS domain FROM part")
def domain_resolve(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", _domain().alias("domain"))


def _domain():
    out = F.lit("")
    for part, domain in reversed(DOMAINS):
        out = F.when(F.contains(F.lower(F.concat("p_name", F.lit(" "), "p_type")), F.lit(part)), domain).otherwise(out)
    return out


@query(
    "domain_rewrite",
    """WITH d AS (SELECT p_partkey, CASE WHEN contains(lower(p_name || ' ' || p_type), 'ring') OR contains(lower(p_name || ' ' || p_type), 'widget') THEN 'metals' WHEN contains(lower(p_name || ' ' || p_type), 'small') THEN 'finish' WHEN contains(lower(p_name || ' ' || p_type), 'economy') THEN 'price' ELSE '' END AS s,
       CASE WHEN p_size % 2 = 0 THEN ['civil', 'procedure'] ELSE ['criminal'] END AS base, contains(lower(p_name || ' ' || p_type), 'large') AS needs FROM part),
    e AS (SELECT p_partkey, s, CASE WHEN needs THEN list_append(base, 'constitutional') ELSE base END AS dom FROM d)
    SELECT p_partkey, array_to_string(CASE WHEN s <> '' AND list_contains(dom, 'civil') THEN list_concat(list_filter(dom, lambda x: x <> 'civil'), list_filter([s, 'procedure', 'evidence'], lambda x: NOT list_contains(dom, x))) ELSE dom END, ',') AS domains FROM e""",
)
def domain_rewrite(spark, sf_dir):
    """A specific domain replaces 'civil' and brings companions; order is kept and nothing repeats."""
    base = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("civil"), F.lit("procedure"))).otherwise(F.array(F.lit("criminal")))
    base = F.when(F.contains(F.lower(F.concat("p_name", F.lit(" "), "p_type")), F.lit("large")), F.array_append(base, "constitutional")).otherwise(base)
    specific = F.when(_domain() != "civil", _domain()).otherwise("")
    narrowed = F.array_distinct(F.concat(F.array_remove(base, "civil"), F.array(specific, F.lit("procedure"), F.lit("evidence"))))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.when((specific != "") & F.array_contains(base, "civil"), narrowed).otherwise(base), ",").alias("domains"))


@query(
    "case_type_filter",
    """SELECT o_orderkey, array_to_string(list_concat(['A', 'B'], CASE WHEN o_orderpriority ILIKE '%urgent%' THEN ['U'] ELSE [] END, CASE WHEN o_orderpriority ILIKE '%high%' THEN ['H', 'I'] ELSE [] END), ',') AS kinds FROM orders""",
)
def case_type_filter(spark, sf_dir):
    """Base kinds, then those of every keyword found, in order and once."""
    kinds = F.array(F.lit("A"), F.lit("B"))
    none = F.array().cast("array<string>")
    for word, more in (("urgent", ["U", "A"]), ("high", ["H", "I"])):
        kinds = F.concat(kinds, F.when(ft.boundary_any(F.lower("o_orderpriority"), [word]), F.array(*[F.lit(m) for m in more])).otherwise(none))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(F.array_distinct(kinds), ",").alias("kinds"))


@query(
    "null_safe_ownership",
    """WITH d AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id % 5 END AS draft_id, user_id % 10 AS session, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 9 = 0 THEN 'rejected' ELSE 'ok' END AS status, event_type AS body FROM events)
    SELECT event_id FROM d WHERE (draft_id = 2 OR (session = 3 AND draft_id IS NULL)) AND body IS NOT NULL AND coalesce(status, '') <> 'rejected'""",
)
def null_safe_ownership(spark, sf_dir):
    d = table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 5).alias("draft_id"), (F.col("user_id") % 10).alias("session"),
        F.when(F.col("event_id") % 4 == 0, None).when(F.col("event_id") % 9 == 0, "rejected").otherwise("ok").alias("status"), F.col("event_type").alias("body"),
    )
    own = (F.col("draft_id") == 2) | ((F.col("session") == 3) & F.col("draft_id").isNull())
    return d.where(own & F.col("body").isNotNull() & (F.coalesce("status", F.lit("")) != "rejected")).select("event_id")


@query(
    "filter_or_all",
    """WITH d AS (SELECT doc_id, source, lang IN ('xx') OR (source = 'src1' AND lang = 'de') AS listed FROM documents), m AS (SELECT source, max(listed) AS any_listed FROM d GROUP BY source)
    SELECT doc_id, source FROM d JOIN m USING (source) WHERE listed OR NOT any_listed""",
)
def filter_or_all(spark, sf_dir):
    """An include list that would leave a source nothing is ignored for it."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", (F.col("lang").isin("xx") | ((F.col("source") == "src1") & (F.col("lang") == "de"))).alias("listed"))
    held = d.groupBy("source").agg(F.max("listed").alias("any_listed"))  # partial sums first: a hot source costs no more
    return d.join(held, "source").where("listed or not any_listed").select("doc_id", "source")


@query(
    "specific_else_generic",
    """WITH r AS (SELECT p_partkey, p_brand, CASE WHEN p_size < 10 THEN p_size END AS tribunal FROM part), s AS (SELECT p_brand, count_if(tribunal = 7) > 0 AS has FROM r GROUP BY p_brand)
    SELECT p_partkey, p_brand FROM r JOIN s USING (p_brand) WHERE CASE WHEN has THEN tribunal = 7 ELSE tribunal IS NULL END""",
)
def specific_else_generic(spark, sf_dir):
    r = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.when(F.col("p_size") < 10, F.col("p_size")).alias("tribunal"))
    held = r.groupBy("p_brand").agg((F.count_if(F.col("tribunal") == 7) > 0).alias("has"))
    return r.join(held, "p_brand").where(F.when(F.col("has"), F.col("tribunal") == 7).otherwise(F.col("tribunal").isNull())).select("p_partkey", "p_brand")


_CASE_NAMES_SQL = "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN o_clerk || ' v. ' || o_orderstatus WHEN 1 THEN o_clerk || ' VS ' || o_orderstatus WHEN 2 THEN o_clerk || ' v B' WHEN 3 THEN o_orderpriority WHEN 4 THEN 'vs' ELSE 'version ' || o_clerk END AS q FROM (SELECT *, 'Clerk ' || o_custkey AS o_clerk FROM orders)"


@query("case_name_detect", f"SELECT o_orderkey, q, regexp_matches(q, '(?i)(^|[^A-Za-z0-9_])v\\.?s?\\.?($|[^A-Za-z0-9_])') AS is_case FROM ({_CASE_NAMES_SQL})")
def case_name_detect(spark, sf_dir):
    who, k = F.concat(F.lit("Clerk "), F.col("o_custkey").cast("string")), F.col("o_orderkey") % 6
    q = F.when(k == 0, F.concat(who, F.lit(" v. "), "o_orderstatus")).when(k == 1, F.concat(who, F.lit(" VS "), "o_orderstatus")).when(k == 2, F.concat(who, F.lit(" v B"))).when(k == 3, F.col("o_orderpriority")).when(k == 4, "vs").otherwise(F.concat(F.lit("version "), who))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", q.alias("q"))
    return rows.select("o_orderkey", "q", F.rlike("q", F.lit(r"(?i)(^|[^A-Za-z0-9_])v\.?s?\.?($|[^A-Za-z0-9_])")).alias("is_case"))


@query("fts_config", "SELECT item_id, CASE WHEN list_has_any(string_split_regex(upper(trim(text)), '\\s+'), ['OF', 'IPC', 'GST']) OR len(string_split_regex(upper(trim(text)), '\\s+')) <= 3 THEN 'simple' ELSE 'english' END AS config FROM benchmark")
def fts_config(spark, sf_dir):
    words = F.split(F.upper(F.trim("text")), r"\s+")
    known = F.array(F.lit("OF"), F.lit("IPC"), F.lit("GST"))
    return table(spark, sf_dir, "benchmark").select("item_id", F.when(F.arrays_overlap(words, known) | (F.size(words) <= 3), "simple").otherwise("english").alias("config"))


@query("value_filled", "SELECT conv_id, turn, length(trim(text)) >= 40 AS filled, len(list_filter(string_split(text, '.'), lambda x: length(trim(x)) >= 10)) > 0 AS list_filled FROM conversations")
def value_filled(spark, sf_dir):
    long = F.exists(F.split("text", r"\."), lambda x: F.char_length(F.trim(x)) >= 10)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.char_length(F.trim("text")) >= 40).alias("filled"), long.alias("list_filled"))


@query(
    "filled_field_antijoin",
    """WITH rules(field, pattern) AS (VALUES ('click', 'k.*1'), ('purchase', '"k": [0-4]'), ('view', '99')), e AS (SELECT event_id, event_type, props FROM events)
    SELECT event_id FROM e WHERE NOT EXISTS (SELECT 1 FROM rules WHERE field = event_type AND regexp_matches(props, pattern))""",
)
def filled_field_antijoin(spark, sf_dir):
    """Questions about a field that one of its patterns finds answered are left out."""
    rules = spark.createDataFrame([("click", "k.*1"), ("purchase", '"k": [0-4]'), ("view", "99")], "field string, pattern string")
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "props")
    return events.join(F.broadcast(rules), (F.col("field") == F.col("event_type")) & F.rlike("props", F.col("pattern")), "left_anti").select("event_id")  # three rules


@query("placeholder_detect", "SELECT doc_id, length(trim(text)) < 10 OR lower(trim(text)) IN ('n/a', 'none', 'tbd', '-', 'null') AS empty FROM documents")
def placeholder_detect(spark, sf_dir):
    t = F.trim("text")
    return table(spark, sf_dir, "documents").select("doc_id", ((F.char_length(t) < 10) | F.lower(t).isin("n/a", "none", "tbd", "-", "null")).alias("empty"))


@query("proximity_regex", "SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)(the[^.]{0,80}idiot|idiot[^.]{0,80}the)')")
def proximity_regex(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(ft.proximity(F.col("text"), "the", "idiot")).select("doc_id")


@query(
    "title_projection",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 AND c_name IS NOT NULL THEN c_name || ' v. ' || o_orderstatus WHEN o_orderkey % 10 <> 0 THEN o_orderpriority ELSE 'Unknown v. Unknown' END AS title
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0""",
)
def title_projection(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").where("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey"), "left")
    title = F.when((F.col("o_orderkey") % 5 != 0) & F.col("c_name").isNotNull(), F.concat("c_name", F.lit(" v. "), "o_orderstatus")).when(F.col("o_orderkey") % 10 != 0, F.col("o_orderpriority"))
    return rows.select("o_orderkey", F.coalesce(title, F.lit("Unknown v. Unknown")).alias("title"))


@query("snippet_concat", "SELECT doc_id, coalesce(lang, '') || ' ' || coalesce(CASE WHEN doc_id % 2 = 0 THEN source END, '') || ' ' || text[:1500] AS snippet FROM documents")
def snippet_concat(spark, sf_dir):
    source = F.coalesce(F.when(F.col("doc_id") % 2 == 0, F.col("source")), F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("lang", F.lit("")), F.lit(" "), source, F.lit(" "), F.substring("text", 1, 1500)).alias("snippet"))


@query("status_whitelist", "SELECT event_id, CASE WHEN lower(event_type) IN ('click', 'view', 'purchase') THEN lower(event_type) ELSE 'pending' END AS status FROM events")
def status_whitelist(spark, sf_dir):
    low = F.lower("event_type")
    return table(spark, sf_dir, "events").select("event_id", F.when(low.isin("click", "view", "purchase"), low).otherwise("pending").alias("status"))


@query("substring_any_gate", "SELECT doc_id FROM documents WHERE contains(lower(text), 'scum') OR contains(lower(text), 'copyright') OR contains(lower(text), 'mentemente')")
def substring_any_gate(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(ft.contains_any(F.lower("text"), ["scum", "copyright", "mentemente"])).select("doc_id")


# ---- joins ---------------------------------------------------------------------------------------------------------------


@query("chunk_parent_join", "SELECT l_orderkey, l_linenumber, o_orderdate::DATE AS day FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'")
def chunk_parent_join(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "day")


@query("dim_join", "SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def dim_join(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name", "r_name")


@query("pair_lookup", "SELECT p_partkey, p_name FROM part JOIN (SELECT unnest(['Brand#16', 'Brand#3', 'Brand#18']) AS b, unnest([31, 22, 40]) AS s) q ON p_brand = b AND p_size = s")
def pair_lookup(spark, sf_dir):
    """Two parallel arrays, zipped into key pairs."""
    arrays = spark.createDataFrame([(["Brand#16", "Brand#3", "Brand#18"], [31, 22, 40])], "b array<string>, s array<int>")
    pairs = arrays.select(F.inline(F.arrays_zip("b", "s")))
    return table(spark, sf_dir, "part").join(F.broadcast(pairs), (F.col("p_brand") == F.col("b")) & (F.col("p_size") == F.col("s"))).select("p_partkey", "p_name")


@query("late_materialize_topk", "SELECT doc_id, n_chars, text FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20")
def late_materialize_topk(spark, sf_dir):
    """Rank lean rows, then fetch the texts of the twenty that count."""
    docs = table(spark, sf_dir, "documents")
    top = docs.select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(20)
    return docs.select("doc_id", "text").join(F.broadcast(top), "doc_id").select("doc_id", "n_chars", "text")


@query("nest_children", "SELECT n_name, string_agg(s_name, ';' ORDER BY s_suppkey) AS suppliers FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY n_name")
def nest_children(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "supplier"), F.col("n_nationkey") == F.col("s_nationkey"), "left")
    listed = F.array_sort(F.collect_list(F.when(F.col("s_suppkey").isNotNull(), F.struct("s_suppkey", "s_name"))))
    return rows.groupBy("n_name").agg(F.nullif(F.array_join(F.transform(listed, lambda x: x["s_name"]), ";"), F.lit("")).alias("suppliers"))


@query("ranked_fetch", "SELECT rank, doc_id, lang FROM (VALUES (1, 42), (2, 7), (3, 150), (4, 123456789)) r(rank, id) JOIN documents ON doc_id = id ORDER BY rank")
def ranked_fetch(spark, sf_dir):
    ranked = spark.createDataFrame([(1, 42), (2, 7), (3, 150), (4, 123456789)], "rank int, doc_id long")
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(F.broadcast(ranked), "doc_id").select("rank", "doc_id", "lang").orderBy("rank")


#: Characters taken of a neighbour, and of the whole that goes to a prompt (fixed values).
NEIGHBOUR_CHARS, EXPANDED_CHARS = 300, 1200


@query(
    "neighbour_expand",
    f"""WITH t AS (SELECT conv_id, turn, text, lag(text) OVER w AS p, lead(text) OVER w AS n, lag(turn) OVER w AS pt, lead(turn) OVER w AS nt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    e AS (SELECT conv_id, turn, coalesce(CASE WHEN pt = turn - 1 THEN p[:{NEIGHBOUR_CHARS}] || ' ' END, '') AS l, text, coalesce(CASE WHEN nt = turn + 1 THEN ' ' || n[:{NEIGHBOUR_CHARS}] END, '') AS r FROM t)
    SELECT conv_id, turn, l || text || r AS expanded, CASE WHEN l = '' AND r = '' THEN text ELSE (l || text || r)[:{EXPANDED_CHARS}] END AS prompt FROM e""",
)
def neighbour_expand(spark, sf_dir):
    """Each winner, whole, between the starts of its two neighbours; ``prompt`` is that cut to a length where there is a neighbour."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    start = F.substring("text", 1, NEIGHBOUR_CHARS)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.lag(start).over(w).alias("p"), F.lead(start).over(w).alias("n"), F.lag("turn").over(w).alias("pt"), F.lead("turn").over(w).alias("nt"))
    left = F.coalesce(F.when(F.col("pt") == F.col("turn") - 1, F.concat("p", F.lit(" "))), F.lit(""))
    right = F.coalesce(F.when(F.col("nt") == F.col("turn") + 1, F.concat(F.lit(" "), "n")), F.lit(""))
    rows = rows.select("conv_id", "turn", (F.concat(left, right) == "").alias("alone"), F.concat(left, "text", right).alias("expanded"))
    return rows.select("conv_id", "turn", "expanded", F.when(F.col("alone"), F.col("expanded")).otherwise(F.substring("expanded", 1, EXPANDED_CHARS)).alias("prompt"))


@query(
    "range_window_fetch",
    "SELECT a.conv_id, a.turn AS target, string_agg(b.text, '\n' ORDER BY b.turn) AS joined FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 2 AND a.turn + 2 WHERE a.turn = 3 GROUP BY ALL",
)
def range_window_fetch(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(-2, 2)
    near_target = table(spark, sf_dir, "conversations").where("turn between 1 and 5")  # what no target's window holds is not shuffled
    rows = near_target.withColumn("near", F.collect_list(F.struct("turn", "text")).over(w)).where("turn = 3")
    return rows.select("conv_id", F.col("turn").alias("target"), F.array_join(F.transform(F.array_sort("near"), lambda x: x["text"]), "\n").alias("joined"))


@query("anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 150000)")
def anti_join(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").where("o_totalprice > 150000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("scalar_subquery", "SELECT p_partkey FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part)")
def scalar_subquery(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.where(F.col("p_retailprice") > part.select(F.avg("p_retailprice")).scalar()).select("p_partkey")


@query("left_join_count_filter", "SELECT c_mktsegment, count(*) AS n, count(*) FILTER (WHERE o_orderkey IS NULL) AS without FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment")
def left_join_count_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderkey").isNull()).alias("without"))


_LISTS = "SELECT p_partkey AS id, round(p_retailprice, 2) AS score FROM part WHERE p_size < 20 UNION ALL SELECT p_partkey, round(p_retailprice * 1.1, 2) FROM part WHERE p_size > 10"


@query("merge_ranked_lists", f"SELECT id, max(score) AS score FROM ({_LISTS}) GROUP BY id")
def merge_ranked_lists(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    one = part.where("p_size < 20").select(F.col("p_partkey").alias("id"), F.round("p_retailprice", 2).alias("score"))
    two = part.where("p_size > 10").select(F.col("p_partkey").alias("id"), F.round(F.col("p_retailprice") * 1.1, 2).alias("score"))
    return rerank.merge_ranked([one, two], "id", "score")


@query(
    "identity_resolution",
    """WITH e AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '00000000-0000-4000-8000-' || lpad(event_id::VARCHAR, 12, '0') ELSE 'Customer#' || lpad((user_id % 2000)::VARCHAR, 9, '0') END AS given FROM events)
    SELECT event_id, CASE WHEN regexp_matches(given, '^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$') THEN given ELSE c_custkey::VARCHAR END AS identity FROM e LEFT JOIN customer ON c_name = given""",
)
def identity_resolution(spark, sf_dir):
    given = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(F.col("event_id").cast("string"), 12, "0"))).otherwise(F.concat(F.lit("Customer#"), F.lpad((F.col("user_id") % 2000).cast("string"), 9, "0")))
    rows = table(spark, sf_dir, "events").select("event_id", given.alias("given")).join(table(spark, sf_dir, "customer").select("c_name", "c_custkey"), F.col("given") == F.col("c_name"), "left")
    is_id = F.rlike("given", F.lit("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"))
    return rows.select("event_id", F.coalesce(F.when(is_id, F.col("given")), F.col("c_custkey").cast("string")).alias("identity"))


# ---- rerank rules --------------------------------------------------------------------------------------------------------

_CAND = "cand AS (SELECT p_brand AS query_id, p_partkey AS id, round(p_retailprice / 200.0, 4) AS score, p_partkey % 23 = 0 AS exact, CASE WHEN p_partkey % 19 = 0 THEN '' ELSE lower(trim(p_type)) END AS title, p_size AS year FROM part)"


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.when(F.col("p_partkey") % 19 == 0, "").otherwise(F.lower(F.trim("p_type")))
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("query_id"), F.col("p_partkey").alias("id"), F.round(F.col("p_retailprice") / 200.0, 4).alias("score"), (F.col("p_partkey") % 23 == 0).alias("exact"), title.alias("title"), F.col("p_size").alias("year"))


@query(
    "score_dropoff_dedupe",
    f"""WITH {_CAND}, f AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM cand), k AS (SELECT * FROM f WHERE exact OR (score >= 0.015 AND score >= best * 0.5)),
    d AS (SELECT *, row_number() OVER (PARTITION BY query_id, title, year ORDER BY score DESC, id) AS n FROM k QUALIFY n = 1)
    SELECT query_id, id, round(score * 100, 2) AS rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM d QUALIFY rank <= 15""",
)
def score_dropoff_dedupe(spark, sf_dir):
    kept = rerank.dropoff_dedupe(_candidates(spark, sf_dir), ["query_id"], "score", "exact", [F.col("title"), F.col("year")], "id", 15)
    return kept.select("query_id", "id", F.round(F.col("score") * 100, 2).alias("rerank_score"), "rank")


def _min_results_sql(cand: str, drop: float, floor: float = -1e9) -> str:
    return f"""WITH {cand}, c AS (SELECT *, CASE WHEN title = '' THEN chr(1) || id ELSE title || chr(2) || coalesce(year::VARCHAR, '') END AS k FROM cand),
    a AS (SELECT *, row_number() OVER (PARTITION BY query_id, k ORDER BY score DESC, id) AS of_key, max(score) OVER (PARTITION BY query_id) AS best FROM c),
    b AS (SELECT *, count(*) FILTER (WHERE of_key = 1) OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rk FROM a),
    s AS (SELECT *, of_key = 1 AND (rk <= 5 OR (score >= best - {drop} AND score >= {floor}) OR exact) AS stays FROM b),
    h AS (SELECT *, max(stays) OVER (PARTITION BY query_id, k) AS held, row_number() OVER (PARTITION BY query_id, k, exact ORDER BY score DESC, id) AS en FROM s)
    SELECT query_id, id, score, exact FROM h WHERE stays OR (NOT held AND exact AND en = 1)"""


@query("dropoff_min_results", _min_results_sql(_CAND, 2.0))
def dropoff_min_results(spark, sf_dir):
    kept = rerank.dropoff_min_results(_candidates(spark, sf_dir), ["query_id"], "score", "exact", ["title", "year"], "id", drop=2.0)
    return kept.select("query_id", "id", "score", "exact")


@query("exact_first", f"WITH {_CAND} SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, score DESC, id)::INTEGER AS rank FROM cand")
def exact_first(spark, sf_dir):
    return rerank.exact_first(_candidates(spark, sf_dir), ["query_id"], "score", "exact", "id").select("query_id", "id", "rank")


_GIVEN = f"{_CAND.replace('cand AS', 'base AS')}, given AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 13 = 0 THEN 'n/a' ELSE (p_partkey % 11)::VARCHAR END AS raw FROM part WHERE p_partkey % 4 <> 0), cand AS (SELECT b.query_id, b.id, coalesce(try_cast(raw AS DOUBLE), 0.0) AS score, exact, title, year FROM base b LEFT JOIN given USING (id))"


@query("external_score_rerank", _min_results_sql(_GIVEN, 4.0, 3.0))
def external_score_rerank(spark, sf_dir):
    """Scores from outside (0 to 10): an absent or unreadable one is 0; then the same pruning, and below 3 as well."""
    given = table(spark, sf_dir, "part").where("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 13 == 0, "n/a").otherwise((F.col("p_partkey") % 11).cast("string")).alias("raw"))
    rows = _candidates(spark, sf_dir).drop("score").join(given, "id", "left").withColumn("score", F.coalesce(F.col("raw").try_cast("double"), F.lit(0.0)))
    return rerank.dropoff_min_results(rows, ["query_id"], "score", "exact", ["title", "year"], "id", drop=4.0, floor=3.0).select("query_id", "id", "score", "exact")


@query(
    "grouped_topk",
    f"""WITH {_CAND}, o AS (SELECT *, CASE WHEN query_id IN ('Brand#16', 'Brand#3') OR id % 6 = 0 THEN NULL ELSE (id % 17)::DOUBLE END AS first_scorer FROM cand),
    s AS (SELECT query_id, id, CASE WHEN count(first_scorer) OVER (PARTITION BY query_id) > 0 THEN coalesce(first_scorer, 0.0) ELSE score END AS score FROM o)
    SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM s QUALIFY rank <= 8""",
)
def grouped_topk(spark, sf_dir):
    """First eight of every group by the first scorer that answered for the group, else by the second."""
    given = F.when(~(F.col("query_id").isin("Brand#16", "Brand#3") | (F.col("id") % 6 == 0)), (F.col("id") % 17).cast("double"))
    rows = rerank.score_chain(_candidates(spark, sf_dir).withColumnRenamed("score", "second").withColumn("first", given), ["query_id"], ["first", "second"])
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return rows.select("query_id", "id", "score").withColumn("rank", F.row_number().over(w)).where("rank <= 8")


@query(
    "pinned_cap",
    f"""WITH {_CAND}, p AS (SELECT *, sum(exact::INT) OVER (PARTITION BY query_id) AS n, row_number() OVER (PARTITION BY query_id, exact ORDER BY score DESC, id) AS place FROM cand)
    SELECT query_id, id, exact FROM p WHERE exact OR place <= 8 - n""",
)
def pinned_cap(spark, sf_dir):
    return rerank.pinned_cap(_candidates(spark, sf_dir), ["query_id"], "exact", [F.desc("score"), F.asc("id")]).select("query_id", "id", "exact")


# ---- aggregates and evaluation -------------------------------------------------------------------------------------------


@query("filtered_count", "SELECT count(*) AS n, count(lang) AS n_lang FROM documents WHERE n_chars > 1000 AND source <> 'src3'")
def filtered_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("n_chars > 1000 and source <> 'src3'").agg(F.count(F.lit(1)).alias("n"), F.count("lang").alias("n_lang"))


@query("facet_counts", "SELECT 'lang' AS facet, lang AS value, count(*) AS n FROM documents WHERE nullif(lang, '') IS NOT NULL GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents WHERE nullif(source, '') IS NOT NULL GROUP BY source")
def facet_counts(spark, sf_dir):
    """All facets in one scan: each row gives one (facet, value) per facet, counted before the shuffle."""
    facets = F.explode(F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f).alias("value")) for f in ("lang", "source")])).alias("f")
    return table(spark, sf_dir, "documents").select(facets).select("f.facet", "f.value").where(F.nullif("value", F.lit("")).isNotNull()).groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


@query("facet_rollup", "WITH m(value, label) AS (VALUES ('en', 'Germanic'), ('de', 'Germanic'), ('fr', 'Romance'), ('es', 'Romance'), ('xx', 'None')) SELECT label, count(*) AS n FROM documents JOIN m ON lang = value GROUP BY label")
def facet_rollup(spark, sf_dir):
    labels = spark.createDataFrame([("en", "Germanic"), ("de", "Germanic"), ("fr", "Romance"), ("es", "Romance"), ("xx", "None")], "lang string, label string")
    counts = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("c"))
    return counts.join(labels, "lang").groupBy("label").agg(F.sum("c").alias("n")).where("n > 0")


@query("max_id", "SELECT max(o_orderkey) + 1 AS next_id FROM orders")
def max_id(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg((F.max("o_orderkey") + 1).alias("next_id"))


@query("eval_rollup", "SELECT event_type, round(avg(value), 6) AS mean_value, round(100.0 * count_if(value > 50) / nullif(count(*), 0), 4) AS hit_pct FROM events GROUP BY event_type")
def eval_rollup(spark, sf_dir):
    share = F.count_if(F.col("value") > 50) * 100.0 / F.nullif(F.count(F.lit(1)), F.lit(0))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean_value"), F.round(share.cast("double"), 4).alias("hit_pct"))


@query(
    "gold_recall_at_k",
    """WITH top AS (SELECT source AS q, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 8),
    gold AS (SELECT source AS q, lang AS grp, doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1),
    hit AS (SELECT g.q, g.grp, max(t.doc_id IS NOT NULL) AS got FROM gold g LEFT JOIN top t ON t.q = g.q AND t.doc_id = g.doc_id GROUP BY ALL)
    SELECT q, count(*) AS n_groups, count_if(got)::BIGINT AS n_hit, round(count_if(got)::DOUBLE / count(*), 6) AS recall FROM hit GROUP BY q""",
)
def gold_recall_at_k(spark, sf_dir, k: int = 8):
    """A gold group is satisfied by any of its alternatives among the first k."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("q"), "doc_id", "lang", "n_chars")
    top = docs.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("n_chars"), "doc_id"))).where(F.col("rank") <= k).select("q", "doc_id", F.lit(True).alias("found"))
    gold = docs.join(table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"), "doc_id").select("q", F.col("lang").alias("grp"), "doc_id")
    got = gold.join(top, ["q", "doc_id"], "left").groupBy("q", "grp").agg(F.max(F.coalesce("found", F.lit(False))).alias("got"))
    return got.groupBy("q").agg(F.count(F.lit(1)).alias("n_groups"), F.count_if("got").alias("n_hit")).withColumn("recall", F.round(F.col("n_hit") / F.col("n_groups"), 6))


@query(
    "percentile_nearest_rank",
    """WITH s AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents)
    SELECT lang, max(CASE WHEN i = n // 2 THEN n_chars END) AS median, max(CASE WHEN i = floor(n * 0.9)::BIGINT THEN n_chars END) AS p90, max(n_chars) AS most FROM s GROUP BY lang""",
)
def percentile_nearest_rank(spark, sf_dir):
    """Values at positions floor(n/2) and floor(0.9 n) of the sorted list, from counts of equal values, so no window holds a language's rows."""
    counts = table(spark, sf_dir, "documents").groupBy("lang", "n_chars").agg(F.count(F.lit(1)).alias("c"))
    upto = Window.partitionBy("lang").orderBy("n_chars").rowsBetween(Window.unboundedPreceding, 0)
    run = counts.withColumn("upto", F.sum("c").over(upto)).withColumn("n", F.sum("c").over(Window.partitionBy("lang")))
    at = lambda i: F.max(F.when((i < F.col("upto")) & (i >= F.col("upto") - F.col("c")), F.col("n_chars")))
    return run.groupBy("lang").agg(at(F.floor(F.col("n") / 2)).alias("median"), at(F.floor(F.col("n") * 0.9)).alias("p90"), F.max("n_chars").alias("most"))


_INTEGRITY = (("short_texts", "char_length(text) < 20", 10), ("no_lang", "lang is null", 0), ("long_texts", "char_length(text) > 20000", 5))


@query("integrity_report", "SELECT label, n, max_ok, CASE WHEN n <= max_ok THEN 'ok' WHEN n <= max_ok * 3 THEN 'WARN' ELSE 'FAIL' END AS verdict FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS label, count_if({b.replace('char_length', 'length')})::BIGINT AS n, {m}::BIGINT AS max_ok FROM documents" for a, b, m in _INTEGRITY) + ")")
def integrity_report(spark, sf_dir):
    """All checks in one scan, then one row each."""
    one = table(spark, sf_dir, "documents").agg(*[F.count_if(F.expr(b)).alias(a) for a, b, _ in _INTEGRITY])
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("label"), F.col(a).alias("n"), F.lit(m).cast("long").alias("max_ok")) for a, _, m in _INTEGRITY])).alias("r")).select("r.*")
    return rows.withColumn("verdict", F.when(F.col("n") <= F.col("max_ok"), "ok").when(F.col("n") <= F.col("max_ok") * 3, "WARN").otherwise("FAIL"))


@query("event_rollup", "SELECT event_type, count(*) AS n, count_if(value >= 10)::BIGINT AS answered, count_if(value < 10)::BIGINT AS skipped FROM events GROUP BY event_type")
def event_rollup(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") >= 10).alias("answered"), F.count_if(F.col("value") < 10).alias("skipped"))


@query("log_summary", "SELECT conv_id, string_agg(turn::VARCHAR, ',' ORDER BY turn) FILTER (WHERE role = 'user') AS asked, count_if(role <> 'user')::BIGINT AS n_other FROM conversations GROUP BY conv_id")
def log_summary(spark, sf_dir):
    """A log kept as an array of entries, read with array functions."""
    logs = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("log"))
    of_user = F.transform(F.filter("log", lambda x: x["role"] == "user"), lambda x: x["turn"].cast("string"))
    return logs.select("conv_id", F.nullif(F.array_join(of_user, ","), F.lit("")).alias("asked"), F.size(F.filter("log", lambda x: x["role"] != "user")).cast("long").alias("n_other"))


# ---- windows, sorts, sets --------------------------------------------------------------------------------------------------


@query("lag_lead_context", "SELECT conv_id, turn, lag(role) OVER w AS before, lead(role) OVER w AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def lag_lead_context(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lag("role").over(w).alias("before"), F.lead("role").over(w).alias("after"))


@query("running_budget", "SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS upto, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) <= 1000 AS fits FROM conversations")
def running_budget(spark, sf_dir):
    upto = F.sum(F.char_length("text")).over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", upto.alias("upto"), (upto <= 1000).alias("fits"))


@query("browse_sorted", "SELECT o_orderkey, yr, row_number() OVER (ORDER BY yr DESC NULLS LAST, o_orderkey)::INTEGER AS pos FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 50 <> 0 THEN year(o_orderdate)::INTEGER END AS yr FROM orders) QUALIFY pos > 20 AND pos <= 40")
def browse_sorted(spark, sf_dir, page: int = 2, size: int = 20):
    """A page of the browse order: only the rows up to its end are kept by the sort."""
    year = F.when(F.col("o_orderkey") % 50 != 0, F.year("o_orderdate"))
    top = table(spark, sf_dir, "orders").select("o_orderkey", year.alias("yr")).orderBy(F.desc_nulls_last("yr"), "o_orderkey").limit(page * size)
    pos = F.row_number().over(Window.orderBy(F.desc_nulls_last("yr"), "o_orderkey"))  # over one page's rows
    return top.withColumn("pos", pos).where(F.col("pos") > (page - 1) * size)


@query("priority_sort", "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority DESC, o_orderkey LIMIT 100")
def priority_sort(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority").orderBy(F.desc("o_orderpriority"), "o_orderkey").limit(100)


_ROMAN = ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X")


@query(
    "text_roman_order",
    f"""WITH r AS (SELECT p_brand, p_partkey, {list(_ROMAN)}[1 + p_size % 10] AS ch, CASE WHEN p_partkey % 5 > 0 THEN p_partkey % 7 END AS rule FROM part)
    SELECT p_brand, p_partkey, ch, rule, row_number() OVER (PARTITION BY p_brand ORDER BY ch, rule NULLS LAST, p_partkey)::INTEGER AS pos FROM r""",
)
def text_roman_order(spark, sf_dir):
    """Chapters of each code sort as text ('IX' before 'V'); missing rule numbers come last."""
    chapter = F.element_at(F.array(*[F.lit(x) for x in _ROMAN]), (F.col("p_size") % 10 + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_brand", "p_partkey", chapter.alias("ch"), F.when(F.col("p_partkey") % 5 > 0, F.col("p_partkey") % 7).alias("rule"))
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("p_brand").orderBy("ch", F.asc_nulls_last("rule"), "p_partkey")))


@query(
    "role_conflict",
    """WITH a AS (SELECT o_orderkey AS k, string_split(o_orderpriority || '-x-HIGH', '-') AS l, string_split(o_orderstatus || '-x-1', '-') AS r FROM orders)
    SELECT k, array_to_string(list_sort(list_intersect(list_distinct(l), list_distinct(r))), ',') AS both_sides, array_to_string(list_sort(list_filter(list_distinct(l), lambda x: NOT list_contains(r, x))), ',') AS left_only FROM a""",
)
def role_conflict(spark, sf_dir):
    """Names on both sides are told and leave both."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.split(F.concat("o_orderpriority", F.lit("-x-HIGH")), "-").alias("l"), F.split(F.concat("o_orderstatus", F.lit("-x-1")), "-").alias("r"))
    return rows.select("k", F.array_join(F.array_sort(F.array_intersect("l", "r")), ",").alias("both_sides"), F.array_join(F.array_sort(F.array_except("l", "r")), ",").alias("left_only"))


@query("distinct_citations", "SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Z][a-z]{5,}')) AS name FROM conversations")
def distinct_citations(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Z][a-z]{5,})"), 1)).alias("name")).distinct()


@query("union_ids", "SELECT doc_id AS id FROM documents WHERE lang = 'de' UNION SELECT vec_id FROM embeddings WHERE label = 1")
def union_ids(spark, sf_dir):
    one = table(spark, sf_dir, "documents").where("lang = 'de'").select(F.col("doc_id").alias("id"))
    return one.union(table(spark, sf_dir, "embeddings").where("label = 1").select("vec_id")).distinct()


@query("set_difference", "SELECT doc_id FROM documents WHERE lang = 'en' EXCEPT SELECT doc_id FROM labels WHERE toxic = 1")
def set_difference(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id").distinct()
    return docs.join(table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id", "left_anti")


@query(
    "map_overlay",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'edited' ELSE o_orderstatus END AS status, o_orderpriority || '!' AS priority, (o_orderkey % 2 = 0)::INTEGER AS n_touched FROM orders""",
)
def map_overlay(spark, sf_dir):
    """Keys that differ from the defaults were touched; new defaults reach only the others."""
    rows = table(spark, sf_dir, "orders").withColumn("old", F.create_map(F.lit("status"), "o_orderstatus", F.lit("priority"), "o_orderpriority"))
    rows = rows.withColumn("now", F.create_map(F.lit("status"), F.when(F.col("o_orderkey") % 2 == 0, "edited").otherwise(F.col("o_orderstatus")), F.lit("priority"), F.col("o_orderpriority")))
    rows = rows.withColumn("fresh", F.create_map(F.lit("status"), "o_orderstatus", F.lit("priority"), F.concat("o_orderpriority", F.lit("!"))))
    touched = F.map_filter(F.map_zip_with("now", "old", lambda k, a, b: F.when(~a.eqNullSafe(b), a)), lambda k, v: v.isNotNull())
    merged = F.map_zip_with("fresh", touched, lambda k, a, b: F.coalesce(b, a))
    return rows.withColumn("m", merged).select("o_orderkey", F.col("m")["status"].alias("status"), F.col("m")["priority"].alias("priority"), F.size(touched).alias("n_touched"))


@query(
    "rule_overlay",
    """WITH r AS (SELECT p_partkey AS rule_id, p_size % 2 = 0 AS mandated, p_size > 25 AS is_heading FROM part WHERE p_brand IN ('Brand#11', 'Brand#12')), o AS (SELECT p_partkey AS rule_id, p_size < 40 AS wish FROM part WHERE p_partkey % 3 = 0)
    SELECT rule_id, CASE WHEN NOT mandated AND wish IS NOT NULL THEN wish ELSE is_heading END AS is_heading, NOT mandated AND wish IS NOT NULL AS overridden_by_user FROM r LEFT JOIN o USING (rule_id)""",
)
def rule_overlay(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    rules = part.where(F.col("p_brand").isin("Brand#11", "Brand#12")).select(F.col("p_partkey").alias("rule_id"), (F.col("p_size") % 2 == 0).alias("mandated"), (F.col("p_size") > 25).alias("is_heading"))
    wishes = part.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("rule_id"), (F.col("p_size") < 40).alias("wish"))
    takes = ~F.col("mandated") & F.col("wish").isNotNull()
    return rules.join(wishes, "rule_id", "left").select("rule_id", F.when(takes, F.col("wish")).otherwise(F.col("is_heading")).alias("is_heading"), takes.alias("overridden_by_user"))


@query("fill_if_empty", "SELECT conv_id, turn, CASE WHEN length(trim(text)) >= 60 THEN text ELSE 'suggested ' || role END AS value, CASE WHEN length(trim(text)) < 60 THEN text END AS previous FROM conversations")
def fill_if_empty(spark, sf_dir):
    filled = F.char_length(F.trim("text")) >= 60
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(filled, F.col("text")).otherwise(F.concat(F.lit("suggested "), "role")).alias("value"), F.when(~filled, F.col("text")).alias("previous"))


@query("debounce_sessions", "SELECT user_id, ts, event_id FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt IS NULL OR nxt - ts >= INTERVAL 30 MINUTE")
def debounce_sessions(spark, sf_dir):
    """The last event of every burst: none of the same user follows within the gap."""
    after = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", after.alias("nxt"))
    return rows.where(F.col("nxt").isNull() | (F.col("nxt") - F.col("ts") >= F.expr("interval 30 minutes"))).select("user_id", "ts", "event_id")


@query(
    "ttl_first",
    """WITH RECURSIVE k AS (SELECT user_id, event_type, min(ts) AS ts FROM events GROUP BY ALL
    UNION ALL SELECT k.user_id, k.event_type, min(e.ts) AS ts FROM k JOIN events e ON e.user_id = k.user_id AND e.event_type = k.event_type AND e.ts >= k.ts + INTERVAL 6 HOUR GROUP BY k.user_id, k.event_type, k.ts)
    SELECT user_id, event_type, ts FROM k""",
)
def ttl_first(spark, sf_dir):
    """Requests that a cache of six hours has to compute: the first of a key, then the first after each computed one has run out."""
    from docloom.streaming.events import computed_requests

    return computed_requests(table(spark, sf_dir, "events").select("user_id", "event_type", "ts"), ["user_id", "event_type"], "ts", 6 * 3600)


@query("window_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def window_counts(spark, sf_dir):
    from docloom.streaming.events import windowed_counts

    return windowed_counts(table(spark, sf_dir, "events"))


@query(
    "gapfill_replay",
    """WITH s AS (SELECT conv_id, turn, role, role = 'user' AS asks, sum(CASE WHEN role = 'user' THEN 1 ELSE -1 END) OVER w AS level, count_if(role = 'user') OVER w AS n_asked FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    q AS (SELECT *, level - least(0, min(level) OVER (PARTITION BY conv_id ORDER BY turn)) AS waiting FROM s),
    h AS (SELECT q.*, n_asked - waiting AS n_handled FROM q)
    SELECT h.conv_id, h.turn, h.role, h.waiting::BIGINT AS waiting, h.n_handled::BIGINT AS n_handled, h.waiting = 0 AS complete, n.turn AS next_question
    FROM h LEFT JOIN h n ON n.conv_id = h.conv_id AND n.asks AND n.n_asked = h.n_handled + 1 AND h.waiting > 0""",
)
def gapfill_replay(spark, sf_dir):
    """The queue of open questions after every turn: a user's turn adds one, any other answers or skips its head; an answer to an empty queue is void.

    The queue's length is the running sum less its least value so far, so no state has to be carried row by row; its head is the question after those handled.
    """
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    asks = F.col("role") == "user"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.sum(F.when(asks, 1).otherwise(-1)).over(w).alias("level"), F.count_if(asks).over(w).alias("n_asked"))
    rows = rows.withColumn("waiting", (F.col("level") - F.least(F.lit(0), F.min("level").over(w))).cast("long")).withColumn("n_handled", F.col("n_asked") - F.col("waiting"))
    rows = rows.withColumn("head", F.when(F.col("waiting") > 0, F.col("n_handled") + 1))
    questions = rows.where(asks).select("conv_id", F.col("n_asked").alias("head"), F.col("turn").alias("next_question"))
    return rows.join(questions, ["conv_id", "head"], "left").select("conv_id", "turn", "role", "waiting", "n_handled", (F.col("waiting") == 0).alias("complete"), "next_question")
