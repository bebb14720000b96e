"""Text queries: dates, cleaning, paragraphs, triage, fields, languages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.functions import dates, folding
from docloom.functions import text as ft
from docloom.operators import matching, paragraphs, triage
from docloom.operators.retrieval import chunks
from docloom.plans.registry import query
from docloom.plans.search import _CHUNK_SQL
from docloom.sources.tables import table

# ---- dates -----------------------------------------------------------------------------------------------------------------

#: Ways to write the day of an order, as patterns of DuckDB and of Spark, and whether they can be read; the last four cannot.
_WRITTEN = (
    ("%Y-%m-%d", "yyyy-MM-dd"), ("%d-%m-%Y", "dd-MM-yyyy"), ("%d/%m/%Y", "dd/MM/yyyy"), ("%-d.%-m.%Y", "d.M.yyyy"), ("%-dth %B %Y", "d'th' MMMM yyyy"), ("%-d %b %Y", "d MMM yyyy"), ("%-d-%B-%Y", "d-MMMM-yyyy"),
    ("%B %-d, %Y", "MMMM d, yyyy"), ("%b %-d %Y", "MMM d yyyy"), ("  %-d  %B   %Y. ", "'  'd'  'MMMM'   'yyyy'. '"), ("%Y", "yyyy"), ("31/02/%Y", "'31/02/'yyyy"), ("%m/31/1899", "MM'/31/1899'"), ("no date in %Y", "'no date in 'yyyy"),
)
_DATES_SQL = " ".join(f"WHEN {i} THEN strftime(o_orderdate, '{sql}')" for i, (sql, _) in enumerate(_WRITTEN))


@query(
    "normalize_date_cases",
    f"SELECT o_orderkey, CASE o_orderkey % {len(_WRITTEN) + 1} {_DATES_SQL} END AS raw, CASE WHEN o_orderkey % {len(_WRITTEN) + 1} < {len(_WRITTEN) - 4} THEN strftime(o_orderdate, '%Y-%m-%d') END AS iso FROM orders",
)
def normalize_date_cases(spark, sf_dir):
    """Days written in every accepted form, and in forms that give null; one order in fifteen has none."""
    raw = F.coalesce(*[F.when(F.col("o_orderkey") % (len(_WRITTEN) + 1) == i, F.date_format("o_orderdate", form)) for i, (_, form) in enumerate(_WRITTEN)])
    rows = table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw"))
    return rows.select("o_orderkey", "raw", dates.normalize_date(F.col("raw"), F.lit("2025-01-01").cast("date")).alias("iso"))


_RAW_SQL = "CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 1 THEN strftime(o_orderdate, '%d %B %Y') WHEN 2 THEN strftime(o_orderdate, '%b %d, %Y') WHEN 3 THEN strftime(o_orderdate, '%Y') WHEN 4 THEN strftime(o_orderdate, '%d.%m.%Y') ELSE 'around ' || strftime(o_orderdate, '%Y') END"


def _raw_dates(spark, sf_dir):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 6
    raw = F.when(k == 0, F.date_format(d, "dd/MM/yyyy")).when(k == 1, F.date_format(d, "dd MMMM yyyy")).when(k == 2, F.date_format(d, "MMM dd, yyyy")).when(k == 3, F.date_format(d, "yyyy")).when(k == 4, F.date_format(d, "dd.MM.yyyy"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(raw, F.concat(F.lit("around "), F.date_format(d, "yyyy"))).alias("raw"))


@query("normalize_date", "SELECT o_orderkey, CASE WHEN o_orderkey % 6 NOT IN (3, 5) AND o_orderdate < TIMESTAMP '1997-01-01' THEN strftime(o_orderdate, '%Y-%m-%d') END AS iso FROM orders")
def normalize_date(spark, sf_dir):
    """Strict reading as of the end of 1996: years alone, words and later dates give null."""
    return _raw_dates(spark, sf_dir).select("o_orderkey", dates.normalize_date(F.col("raw"), F.lit("1996-12-31").cast("date")).alias("iso"))


@query("format_date_passthrough", f"SELECT o_orderkey, CASE WHEN o_orderkey % 6 NOT IN (3, 5) THEN strftime(o_orderdate, '%d/%m/%Y') ELSE {_RAW_SQL} END AS shown FROM orders")
def format_date_passthrough(spark, sf_dir):
    return _raw_dates(spark, sf_dir).select("o_orderkey", dates.display_date(F.col("raw")).alias("shown"))


@query(
    "clean_events",
    """WITH e AS (SELECT o_custkey, CASE WHEN o_orderkey % 6 NOT IN (3, 5) THEN strftime(o_orderdate, '%Y-%m-%d') END AS day, o_orderpriority AS event FROM orders), d AS (SELECT DISTINCT o_custkey, day, lower(event) AS k, max(event) OVER (PARTITION BY o_custkey, day, lower(event)) AS event FROM e WHERE day IS NOT NULL)
    SELECT o_custkey, day, event FROM d QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY day, k) <= 15""",
)
def clean_events(spark, sf_dir, most: int = 15):
    """Dated events of each list: readable dates only, no repeats, in order, at most fifteen."""
    raw = _raw_dates(spark, sf_dir).join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), "o_orderkey")
    rows = raw.select("o_custkey", dates.normalize_date(F.col("raw"), F.lit("2025-01-01").cast("date")).alias("day"), ft.squeeze(F.concat(F.lit(" "), "o_orderpriority", F.lit("  "))).alias("event")).where("day is not null")
    once = rows.groupBy("o_custkey", "day", F.lower("event").alias("k")).agg(F.max("event").alias("event"))
    at = Window.partitionBy("o_custkey").orderBy("day", "k")
    return once.withColumn("n", F.row_number().over(at)).where(F.col("n") <= most).select("o_custkey", "day", "event")


@query(
    "line_spacing",
    """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN ' Double' WHEN 1 THEN 'single' WHEN 2 THEN (p_size % 3) || ' 1/' || (p_size % 4) WHEN 3 THEN '1.' || p_size WHEN 4 THEN 'one and a half' ELSE p_type END AS raw,
      CASE p_partkey % 6 WHEN 0 THEN 2.0 WHEN 1 THEN 1.0 WHEN 2 THEN CASE WHEN p_size % 4 > 0 THEN p_size % 3 + 1.0::DOUBLE / (p_size % 4) END WHEN 3 THEN ('1.' || p_size)::DOUBLE WHEN 4 THEN 1.5 END::DOUBLE AS spacing FROM part""",
)
def line_spacing(spark, sf_dir):
    """Spacings as words, numbers and mixed fractions; others, and fractions of nothing, are null."""
    k, size = F.col("p_partkey") % 6, F.col("p_size")
    raw = F.when(k == 0, " Double").when(k == 1, "single").when(k == 2, F.concat((size % 3).cast("string"), F.lit(" 1/"), (size % 4).cast("string"))).when(k == 3, F.concat(F.lit("1."), size.cast("string"))).when(k == 4, "one and a half").otherwise(F.col("p_type"))
    rows = table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw"))
    t = F.lower(F.trim("raw"))
    piece = lambda i: F.regexp_extract(t, r"^(\d+)\s+(\d+)/(\d+)$", i).try_cast("double")
    whole = piece(1) + piece(2) / F.nullif(piece(3), F.lit(0.0))
    return rows.select("p_partkey", "raw", F.when(t == "double", 2.0).when(t == "single", 1.0).when(t == "one and a half", 1.5).otherwise(F.coalesce(whole, t.try_cast("double"))).alias("spacing"))


# ---- cleaning and paragraphs -------------------------------------------------------------------------------------------------

_NOISY_SQL = "SELECT conv_id, turn, 'Digital Supreme Court Reports' || chr(10) || '12' || chr(10) || 'B' || chr(10) || 'the won-' || chr(10) || 'drous D Tale and E the rest, F' || chr(10) || 'Gone. ' || text || chr(8) || chr(10) || '[2019] 5 S.C.R. 77' || chr(10) || ' end' AS raw FROM conversations"


def _noisy(spark, sf_dir):
    raw = F.concat(F.lit("Digital Supreme Court Reports\n12\nB\nthe won-\ndrous D Tale and E the rest, F\nGone. "), "text", F.lit("\b\n[2019] 5 S.C.R. 77\n end"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", raw.alias("raw"))


# a letter is taken with the sign before it and the two letters after it, which no other hit can need: so no look-around
_CLEAN_SQL = (
    "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, chr(8) || '+', ' ', 'g'),"
    r" '(?i)\[\d{4}\]\s*\d*\s*S\.?C\.?R\.?\s*\d*', ' ', 'g'), '(?i)Digital\s+Supreme\s+Court\s+Reports', ' ', 'g'), '(?i)SUPREME\s+COURT\s+REPORTS', ' ', 'g'), '(?m)^\s*\d{1,4}\s*$', ' ', 'g'),"
    r" '([\p{L}\p{N}_])-\s*\n\s*([\p{L}\p{N}_])', '\1\2', 'g'), '(?m)^\s*[A-H]\s*$', ' ', 'g'), '(^|[^A-Za-z])[A-H]\s+([A-Z][a-z])', '\1 \2', 'g'), '\s*\n\s*', ' ', 'g'), '\s{2,}', ' ', 'g'))"
)


@query("clean_ocr", f"SELECT conv_id, turn, {_CLEAN_SQL} AS clean FROM ({_NOISY_SQL})")
def clean_ocr(spark, sf_dir):
    """Page furniture removed from every text."""
    return _noisy(spark, sf_dir).select("conv_id", "turn", ft.clean_page_text(F.col("raw")).alias("clean"))


def _numbered(spark, sf_dir):
    """One numbered document per conversation."""
    parts = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat((F.col("turn") + 1).cast("string"), F.lit(". The "), F.regexp_replace("text", r"\d+\.", ""), F.lit(".")).alias("t")))).alias("p"))
    return parts.select("conv_id", ft.clean_page_text(F.array_join(F.transform("p", lambda x: x["t"]), "\n")).alias("flat"))


@query("segment_paragraphs")
def segment_paragraphs(spark, sf_dir):
    return paragraphs.segment(_numbered(spark, sf_dir), "flat", "conv_id")


_FLAT_SQL = rf"""flat AS (SELECT conv_id, {_CLEAN_SQL} AS flat FROM (SELECT conv_id, string_agg((turn + 1) || '. The ' || regexp_replace(text, '\d+\.', '', 'g') || '.', chr(10) ORDER BY turn) AS raw FROM conversations GROUP BY conv_id))"""


@query(
    "marker_scan",
    # candidates are cut at every number; what stands before and after one decides, as RE2 has no look-around
    rf"""WITH {_FLAT_SQL}, p AS (SELECT conv_id, flat, regexp_extract_all(flat, '\d+|[^\d]+') AS parts FROM flat),
    u AS (SELECT conv_id, flat, parts, unnest(range(1, len(parts) + 1)) AS i FROM p),
    o AS (SELECT conv_id, i, parts[i] AS part, parts[i - 1] AS before, parts[i + 1] AS following, sum(length(parts[i])) OVER (PARTITION BY conv_id ORDER BY i) - length(parts[i]) AS pos FROM u)
    SELECT conv_id, pos::BIGINT AS "at", part::INTEGER AS number FROM o WHERE regexp_matches(part, '^\d{{1,3}}$') AND regexp_matches(following, '^\.\s+[A-Z“"(]') AND (i = 1 OR regexp_matches(before, '[.:?!”")]\s+$') OR (i = 2 AND regexp_matches(before, '^\s*$')))""",
)
def marker_scan(spark, sf_dir):
    """Candidate markers of each text: number and offset, by the pattern alone."""
    return paragraphs.markers(_numbered(spark, sf_dir), "flat", "conv_id")


@query(
    "para_spans",
    """WITH l AS (SELECT conv_id, turn, length(text) + 1 AS n FROM conversations), s AS (SELECT conv_id, turn + 1 + turn // 3 AS para_number, (sum(n) OVER (PARTITION BY conv_id ORDER BY turn) - n)::BIGINT AS start, (sum(n) OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS "end" FROM l)
    SELECT conv_id, para_number, start, "end", CASE WHEN lead(para_number) OVER w > para_number + 1 THEN lead(para_number) OVER w - 1 END AS para_number_end FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY para_number)""",
)
def para_spans(spark, sf_dir):
    """Spans of a given spine; a gap in the numbers makes a paragraph a range."""
    return _spans(spark, sf_dir).select("conv_id", "para_number", "start", "end", "para_number_end")


def _spans(spark, sf_dir):
    order = Window.partitionBy("conv_id").orderBy("turn")
    n = F.char_length("text") + 1
    rows = table(spark, sf_dir, "conversations").withColumn("end", F.sum(n).over(order)).withColumn("start", F.col("end") - n)
    rows = rows.withColumn("para_number", F.col("turn") + 1 + F.floor(F.col("turn") / 3))  # numbers skip one after every third
    after = F.lead("para_number").over(Window.partitionBy("conv_id").orderBy("para_number"))
    return rows.withColumn("para_number_end", F.when(after > F.col("para_number") + 1, after - 1))


_SPANS_SQL = """l AS (SELECT conv_id, turn, length(text) + 1 AS n FROM conversations), spans AS (SELECT conv_id, turn + 1 + turn // 3 AS para_number, (sum(n) OVER (PARTITION BY conv_id ORDER BY turn) - n)::BIGINT AS s, (sum(n) OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS e FROM l),
chunk AS (SELECT conv_id, unnest(range(0, max(e), 700))::BIGINT AS cs FROM spans GROUP BY conv_id)"""


def _span_chunks(spark, sf_dir):
    spans = _spans(spark, sf_dir).select("conv_id", "para_number", "start", "end")
    last = spans.groupBy("conv_id").agg(F.max("end").alias("m"))
    return spans, last.select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1, F.lit(700).cast("long"))).alias("c_start")).withColumn("c_end", F.col("c_start") + 700)


@query(
    "span_overlap_join",
    f"""WITH {_SPANS_SQL}, j AS (SELECT spans.conv_id, cs AS c_start, para_number, least(e, cs + 700) - greatest(s, cs) AS overlap, e - s AS len FROM spans JOIN chunk USING (conv_id))
    SELECT conv_id, c_start, para_number FROM j WHERE overlap > 0 AND (overlap >= least(200, greatest(len, 1)) OR overlap >= 700 * 0.25)""",
)
def span_overlap_join(spark, sf_dir):
    return paragraphs.overlaps(*_span_chunks(spark, sf_dir), "conv_id").select("conv_id", "c_start", "para_number")


@query(
    "zone_classify",
    f"""WITH {_SPANS_SQL}, b AS (SELECT conv_id, min(s) + 500 AS bs, max(e) - 500 AS be FROM spans GROUP BY conv_id)
    SELECT conv_id, cs AS c_start, CASE WHEN cs + 700 <= bs THEN 'front_matter' WHEN cs >= be THEN 'after_body' ELSE 'body' END AS zone FROM chunk JOIN b USING (conv_id)""",
)
def zone_classify(spark, sf_dir):
    spans, parts = _span_chunks(spark, sf_dir)
    body = spans.groupBy("conv_id").agg((F.min("start") + 500).alias("bs"), (F.max("end") - 500).alias("be"))
    return parts.join(body, "conv_id").select("conv_id", "c_start", paragraphs.zone(F.col("c_start"), F.col("c_end"), F.col("bs"), F.col("be")).alias("zone"))


@query("locate_exact", f"WITH {_CHUNK_SQL} SELECT doc_id, chunk_index, strpos(text, trim(chunk_text)) - 1 AS start FROM chunks JOIN documents USING (doc_id) WHERE length(trim(chunk_text)) > 0")
def locate_exact(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    parts = chunks(docs).withColumn("t", F.trim("chunk_text")).where("char_length(t) > 0")
    return parts.join(docs, "doc_id").select("doc_id", "chunk_index", (F.instr("text", F.col("t")) - 1).cast("long").alias("start")).withColumn("chunk_index", F.col("chunk_index").cast("long"))


@query(
    "locate_arithmetic",
    """WITH c AS (SELECT conv_id, turn, length(text) AS n, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(length(text)) OVER (PARTITION BY conv_id) AS total FROM conversations)
    SELECT conv_id, turn, floor(before * (1000.0::DOUBLE / total))::BIGINT AS start, floor((before + n) * (1000.0::DOUBLE / total))::BIGINT AS stop FROM c""",
)
def locate_arithmetic(spark, sf_dir):
    """Estimated place in a flat text of 1000 characters: lengths of the chunks before, scaled."""
    order = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    n = F.char_length("text")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", n.alias("n"), F.coalesce(F.sum(n).over(order), F.lit(0)).alias("before"), F.sum(n).over(Window.partitionBy("conv_id")).alias("total"))
    scale = F.lit(1000.0) / F.col("total")
    return rows.select("conv_id", "turn", F.floor(F.col("before") * scale).alias("start"), F.floor((F.col("before") + F.col("n")) * scale).alias("stop"))


@query("locate_tiered")
def locate_tiered(spark, sf_dir):
    """Place of every chunk in its text, exact, by an anchor of letters and digits, or estimated; a third of the chunks lost their commas, a third their end."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")
    parts = chunks(docs).withColumn("kind", (F.col("doc_id") + F.col("chunk_index")) % 3)
    noisy = F.when(F.col("kind") == 0, F.col("chunk_text")).when(F.col("kind") == 1, F.regexp_replace("chunk_text", "[,.] ", "  ")).otherwise(F.concat(F.lit("scan: "), F.reverse("chunk_text")))
    rows = parts.select("doc_id", "chunk_index", noisy.alias("chunk"), (F.col("chunk_index") * 1750).alias("low"), ((F.col("chunk_index") + 1) * 1750).alias("high"))
    return paragraphs.locate(docs, rows, "doc_id", "text", "chunk", "low", "high", ["chunk_index"])


@query(
    "overlap_rank",
    r"""WITH w AS (SELECT conv_id, turn, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM conversations),
    s AS (SELECT conv_id, turn, len(list_intersect(list_distinct(w), ['tion', 'that', 'this', 'with', 'dans', 'pour', 'und', 'eine'])) AS hits, len(w) AS n FROM w),
    k AS (SELECT conv_id, turn, round(hits / (1 + n / 400.0::DOUBLE), 9) AS score FROM s WHERE hits > 0)
    SELECT conv_id, turn, score FROM k QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn) <= 5""",
)
def overlap_rank(spark, sf_dir):
    """Distinct query terms in each part over a length norm; first five of each document."""
    terms = F.array(*[F.lit(x) for x in ("tion", "that", "this", "with", "dans", "pour", "und", "eine")])
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda x: x != "").alias("w"))
    hits = F.size(F.array_intersect("w", terms))
    rows = rows.where(hits > 0).select("conv_id", "turn", F.round(hits / (1 + F.size("w") / F.lit(400.0)), 9).alias("score"))
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("score"), "turn"))).where("n <= 5").drop("n")


# ---- triage ---------------------------------------------------------------------------------------------------------------------

_SQUEEZE = r"trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'))"


@query("dedupe_content", f"SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY sha1({_SQUEEZE}) ORDER BY doc_id) = 1")
def dedupe_content(spark, sf_dir):
    return triage.dedupe_content(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", ["doc_id"]).select("doc_id")


_SCAN_SQL = "CASE doc_id % 20 WHEN 0 THEN '[OCR failed: page 1] ' WHEN 1 THEN '[PDF extraction failed] ' WHEN 2 THEN 'Unsupported file type for OCR: ' ELSE '' END || text"


@query("usable_text", f"SELECT doc_id, coalesce(length(trim(t)) >= 80 AND NOT contains(lower(trim(t)), 'ocr failed') AND NOT contains(lower(trim(t)), 'extraction failed') AND NOT contains(lower(trim(t)), 'unsupported file type for ocr'), FALSE) AS usable FROM (SELECT doc_id, {_SCAN_SQL} AS t FROM documents)")
def usable_text(spark, sf_dir):
    kind = F.col("doc_id") % 20
    mark = F.when(kind == 0, "[OCR failed: page 1] ").when(kind == 1, "[PDF extraction failed] ").when(kind == 2, "Unsupported file type for OCR: ").otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", ft.usable(F.concat(mark, "text"), 80).alias("usable"))


_FORM_SQL = "CASE WHEN doc_id % 10 = 0 THEN '[Name] [Address] ____ <Place of birth> [Date] ' || text WHEN doc_id % 10 = 1 THEN 'In the High Court. FIR No. 12 of 2020. A versus B. ' || text ELSE text END"
_HITS_SQL = r"len(regexp_extract_all(t, '\[[^\]\n]{1,40}\]|_{4,}|<[A-Za-z /]{2,30}>'))"
_TEMPLATE_SQL = f"({_HITS_SQL} >= 3 AND {_HITS_SQL} / greatest(1.0, length(t) / 1000.0) >= 2.0)"
_MARKS_SQL = "(" + " + ".join(f"regexp_matches(t, '{m}')::INTEGER" for m in ft.CASE_MARKS) + ")"


def _forms():
    return F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("[Name] [Address] ____ <Place of birth> [Date] "), "text")).when(F.col("doc_id") % 10 == 1, F.concat(F.lit("In the High Court. FIR No. 12 of 2020. A versus B. "), "text")).otherwise(F.col("text"))


@query("template_detect", f"SELECT doc_id, {_TEMPLATE_SQL} AS template FROM (SELECT doc_id, {_FORM_SQL} AS t FROM documents)")
def template_detect(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", ft.is_template(_forms()).alias("template"))


@query(
    "doc_tier",
    f"""WITH t AS (SELECT doc_id, source, {_MARKS_SQL} AS marks, CASE WHEN {_TEMPLATE_SQL} THEN 'excluded' WHEN contains(lower(label), 'src3') OR contains(lower(label), 'fr ') THEN 'supporting' WHEN contains(lower(label), 'src1') THEN 'primary' WHEN {_MARKS_SQL} >= 2 AND NOT contains(lower(label), 'src2') THEN 'primary' WHEN {_MARKS_SQL} >= 1 THEN 'supporting' ELSE 'excluded' END AS tier
    FROM (SELECT doc_id, source, lang || ' ' || source AS label, {_FORM_SQL} AS t FROM documents)),
    g AS (SELECT *, max(tier = 'primary') OVER (PARTITION BY source) AS has, row_number() OVER (PARTITION BY source, tier ORDER BY marks DESC, doc_id) AS place FROM t)
    SELECT doc_id, marks, CASE WHEN NOT has AND tier = 'supporting' AND marks >= 1 AND place = 1 THEN 'primary' ELSE tier END AS tier FROM g""",
)
def doc_tier(spark, sf_dir):
    """Tier of each document of a matter (here: of a source); without a primary one, the best supporting one is promoted."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", F.concat_ws(" ", "lang", "source").alias("label"), _forms().alias("t"))
    rows = triage.facts(rows, "t")
    given = triage.tier(F.col("template"), F.col("marks"), F.col("label"), ["src1"], ["src3", "fr "])
    some = (given == "primary") & F.contains(F.lower("label"), F.lit("src2")) | (given == "excluded") & ~F.col("template") & (F.col("marks") >= 1)  # here such texts support
    tiers = rows.select("doc_id", "source", "marks", F.when(some, "supporting").otherwise(given).alias("tier"))
    return triage.promote(tiers, ["source"], "tier", "marks", "doc_id").select("doc_id", "marks", "tier")


@query("hint_priority", "SELECT p_partkey, CASE WHEN contains(lower(p_type), 'promo') THEN 0 WHEN contains(lower(p_type), 'economy') THEN 1 WHEN contains(lower(p_type), 'small') THEN 2 ELSE 3 END AS priority FROM part")
def hint_priority(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", triage.hint_priority(F.col("p_type"), ["promo", "economy", "small"]).alias("priority"))


@query(
    "unique_labels",
    """WITH d AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN '' ELSE role END AS kind, CASE WHEN turn % 7 <> 6 THEN 'file' || turn ELSE '' END AS name FROM conversations)
    SELECT conv_id, turn, CASE WHEN kind <> '' AND count(*) OVER (PARTITION BY conv_id, kind) > 1 AND name <> '' THEN kind || ' (' || name || ')' WHEN kind <> '' THEN kind WHEN name <> '' THEN name ELSE 'Document ' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) END AS label FROM d""",
)
def unique_labels(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 5 == 4, "").otherwise(F.col("role")).alias("kind"), F.when(F.col("turn") % 7 != 6, F.concat(F.lit("file"), F.col("turn").cast("string"))).otherwise("").alias("name"))
    return triage.unique_labels(rows, ["conv_id"], "kind", "name", ["turn"]).select("conv_id", "turn", "label")


@query(
    "budget_alloc",
    """WITH d AS (SELECT conv_id, turn, least(length(text), 600) AS w FROM conversations), c AS (SELECT *, sum(w) OVER (PARTITION BY conv_id ORDER BY turn) AS upto FROM d)
    SELECT conv_id, turn, (CASE WHEN upto <= 1500 THEN w WHEN upto - w < 1500 AND 1500 - (upto - w) >= 80 THEN 1500 - (upto - w) ELSE 0 END)::BIGINT AS chars_used FROM c""",
)
def budget_alloc(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.least(F.char_length("text"), F.lit(600)).cast("long").alias("w"))
    return triage.allocate(rows, ["conv_id"], ["turn"], "w", 1500, 80).select("conv_id", "turn", F.col("chars_used").cast("long").alias("chars_used"))


@query("fair_share_budget", "SELECT conv_id, turn, least(length(text), greatest(400, 4800 // count(*) OVER (PARTITION BY conv_id) - 64))::BIGINT AS chars_used FROM conversations")
def fair_share_budget(spark, sf_dir):
    """An equal share of the budget for each document of a group, with a floor."""
    share = F.greatest(F.lit(400), F.floor(F.lit(4800) / F.count(F.lit(1)).over(Window.partitionBy("conv_id"))) - 64)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.least(F.char_length("text").cast("long"), share).cast("long").alias("chars_used"))


@query(
    "attempt_budget",
    """WITH d AS (SELECT conv_id, turn, length(text) AS w, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS upto, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)
    SELECT conv_id, turn, upto <= 900 OR n = 1 AS attempted FROM d""",
)
def attempt_budget(spark, sf_dir):
    """Parts attempted in order within a total, the first one always."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.char_length("text").alias("w"))
    return triage.allocate_attempts(rows, ["conv_id"], ["turn"], "w", 900).select("conv_id", "turn", "attempted")


@query("clip_head_tail", "SELECT doc_id, CASE WHEN length(trim(text)) <= 600 THEN trim(text) ELSE trim(text)[:450] || chr(10) || chr(10) || '[... middle of document omitted ...]' || chr(10) || chr(10) || right(trim(text), 150) END AS clipped FROM documents")
def clip_head_tail(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", ft.clip_head_tail(F.col("text"), 450, 150).alias("clipped"))


_PAGED_SQL = "CASE WHEN doc_id % 3 = 0 THEN text || chr(10) || '--- Page 2 ---' || chr(10) || 'धारा तीन सौ दो के अंतर्गत यह आदेश' || chr(10) || '  ' || chr(10) || chr(10) || '[note]' ELSE replace(text, '. ', '.' || chr(10) || chr(10)) END"
_HINDI = "धारा तीन सौ दो के अंतर्गत यह आदेश"


def _paged():
    return F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(f"\n--- Page 2 ---\n{_HINDI}\n  \n\n[note]"))).otherwise(F.replace("text", F.lit(". "), F.lit(".\n\n")))


@query(
    "lossless_tokens",
    rf"""WITH p AS (SELECT doc_id, {_PAGED_SQL} AS t FROM documents), k AS (SELECT doc_id, t, list_filter(string_split(regexp_replace(regexp_replace(t, '(\n--- Page \d+ ---\n)', '' || chr(57344) || '\1' || chr(57344), 'g'), '(\n[ \t]*\n\s*)', chr(57344) || '\1' || chr(57344), 'g'), chr(57344)), lambda x: x <> '') AS k FROM p)
    SELECT doc_id, len(k) AS n_tokens, len(list_filter(k, lambda x: regexp_matches(x, '^\n--- Page \d+ ---\n$'))) AS n_marks,
      len(list_filter(k, lambda x: NOT regexp_matches(x, '(?s)^\s*\[.*\]\s*$') AND length(regexp_replace(regexp_replace(x, '[^\p{{L}}]', '', 'g'), '[^\x{{0900}}-\x{{097F}}]', '', 'g')) >= greatest(10, 0.3 * length(regexp_replace(x, '[^\p{{L}}]', '', 'g'))))) AS n_to_translate, array_to_string(k, '') = t AS lossless FROM k""",
)
def lossless_tokens(spark, sf_dir):
    """Page marks, paragraphs and gaps of a text: how many, how many are to be translated, and whether they give the text again."""
    rows = table(spark, sf_dir, "documents").select("doc_id", _paged().alias("t")).withColumn("k", ft.tokens(F.col("t")))
    hindi, letters = (lambda x: ft.script_letters(x, "hi")), (lambda x: ft.letters(x))
    wanted = F.filter("k", lambda x: ~F.rlike(x, F.lit(r"(?s)^\s*\[.*\]\s*$")) & (hindi(x) >= F.greatest(F.lit(10.0), letters(x) * 0.3)))
    marks = F.filter("k", lambda x: F.rlike(x, F.lit(r"^\n--- Page \d+ ---\n$")))
    return rows.select("doc_id", F.size("k").cast("long").alias("n_tokens"), F.size(marks).cast("long").alias("n_marks"), F.size(wanted).cast("long").alias("n_to_translate"), (F.array_join("k", "") == F.col("t")).alias("lossless"))


#: Letters that stand for Latin ones, so that the tables hold passages in another script.
_ROMAN, _NAGARI = "abcdefghijklmnopqrstuvwxyz", "अबचदएफगहइजकलमनओपकरसतउववछयज"
_TRANSLATED_SQL = f"CASE WHEN lang = 'en' THEN {_PAGED_SQL} ELSE translate({_PAGED_SQL}, '{_ROMAN}', '{_NAGARI}') END"


@query(
    "plan_chunks",
    rf"""WITH RECURSIVE p AS (SELECT doc_id, {_TRANSLATED_SQL} AS t FROM documents),
    k AS (SELECT doc_id, unnest(k) AS x, unnest(range(len(k))) AS i FROM (SELECT doc_id, list_filter(string_split(regexp_replace(regexp_replace(t, '(\n--- Page \d+ ---\n)', chr(57344) || '\1' || chr(57344), 'g'), '(\n[ \t]*\n\s*)', chr(57344) || '\1' || chr(57344), 'g'), chr(57344)), lambda x: x <> '') AS k FROM p)),
    h AS (SELECT doc_id, i, length(x) AS n, CASE WHEN regexp_matches(x, '^\s*$') THEN 2 WHEN NOT regexp_matches(x, '(?s)^\s*\[.*\]\s*$')
        AND length(regexp_replace(regexp_replace(x, '[^\p{{L}}]', '', 'g'), '[^\x{{0900}}-\x{{097F}}]', '', 'g')) >= greatest(10, 0.3 * length(regexp_replace(x, '[^\p{{L}}]', '', 'g'))) THEN 1 ELSE 0 END AS kind FROM k),
    r AS (SELECT *, sum((kind = 0)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM h),
    o AS (SELECT doc_id, run, i, n, row_number() OVER (PARTITION BY doc_id, run ORDER BY i) AS place FROM r WHERE kind = 1),
    s AS (SELECT doc_id, run, place, i, n, i AS first_token, n AS size FROM o WHERE place = 1
      UNION ALL SELECT o.doc_id, o.run, o.place, o.i, o.n, CASE WHEN s.size + o.n > 2000 THEN o.i ELSE s.first_token END, CASE WHEN s.size + o.n > 2000 THEN o.n ELSE s.size + o.n END
      FROM s JOIN o ON o.doc_id = s.doc_id AND o.run = s.run AND o.place = s.place + 1)
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY first_token) - 1)::INTEGER AS chunk, first_token::INTEGER AS first_token, max(i)::INTEGER AS last_token, max(size)::BIGINT AS chars
    FROM s GROUP BY doc_id, first_token""",
)
def plan_chunks(spark, sf_dir):
    """Passages to translate; the texts that are not English are spelled in Devanagari, and pages have marks and notices."""
    spelled = F.when(F.col("lang") == "en", _paged()).otherwise(F.translate(_paged(), _ROMAN, _NAGARI))
    return triage.plan_chunks(table(spark, sf_dir, "documents").select("doc_id", spelled.alias("t")), "doc_id", "t", 2000)


# ---- fields ---------------------------------------------------------------------------------------------------------------------

_FOLD_SQL = "regexp_replace(translate(lower({}), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^a-z0-9]+', '', 'g')"


@query("norm_match", f"SELECT doc_id, {_FOLD_SQL.format('text')} AS folded FROM documents")
def norm_match(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", ft.fold(F.col("text")).alias("folded"))


#: Signs that decompose, and what they are in the comparison form.
_DECOMPOSED = (("ﬁ", "fi"), ("Ⅻ", "xii"), ("ａ", "a"), ("①", "1"), ("ǆ", "dz"), ("ọ̈", "o"), ("Å", "a"), ("ß", ""), ("中", ""))


@query("norm_match_all", f"SELECT doc_id, CASE doc_id % {len(_DECOMPOSED)} " + " ".join(f"WHEN {i} THEN '{plain}'" for i, (_, plain) in enumerate(_DECOMPOSED)) + " END || " + _FOLD_SQL.format("text") + " AS folded FROM documents")
def norm_match_all(spark, sf_dir):
    """The comparison form over all of Unicode: ligatures, numerals, wide letters and marks, before texts with accents."""
    sign = F.element_at(F.array(*[F.lit(s) for s, _ in _DECOMPOSED]), (F.col("doc_id") % len(_DECOMPOSED) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", folding.fold(F.concat(sign, F.lit(" "), "text")).alias("folded"))


@query(
    "grounded",
    f"""WITH c AS (SELECT item_id, {_FOLD_SQL.format("string_split_regex(text, '[,(]')[1]")} AS core, {_FOLD_SQL.format('text')} AS whole FROM benchmark),
    k AS (SELECT item_id, CASE WHEN length(core) >= 6 THEN core WHEN length(whole) >= 6 THEN whole END AS needle FROM c), d AS (SELECT doc_id, {_FOLD_SQL.format('text')} AS hay FROM documents)
    SELECT item_id, count(*) AS n_docs FROM k JOIN d ON contains(hay, needle) GROUP BY item_id""",
)
def grounded(spark, sf_dir):
    """Names (here benchmark passages) found in texts, both folded: the core before a comma or bracket if long enough."""
    core, whole = ft.fold(F.split("text", "[,(]")[0]), ft.fold(F.col("text"))
    needles = table(spark, sf_dir, "benchmark").select("item_id", F.when(F.char_length(core) >= 6, core).when(F.char_length(whole) >= 6, whole).alias("needle"))
    docs = table(spark, sf_dir, "documents").select("doc_id", ft.fold(F.col("text")).alias("hay"))
    return matching.containing(docs, "hay", needles.where("needle is not null"), "needle", "item_id").groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"))


@query(
    "party_list_clean",
    rf"""WITH p AS (SELECT conv_id, turn, text, trim(regexp_replace(regexp_replace('(' || turn || ') ' || CASE WHEN turn % 5 = 4 THEN 'Nobody of Nowhere' ELSE split_part(text, '.', 1) END, '^\s*[(\[]?\s*\d+\s*[.)\]]\s*', ''), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS name FROM conversations),
    k AS (SELECT *, {_FOLD_SQL.format('name')} AS key FROM p)
    SELECT conv_id, name, contains({_FOLD_SQL.format('text')}, key) AS grounded FROM k WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY conv_id, key ORDER BY turn) = 1""",
)
def party_list_clean(spark, sf_dir):
    """Party names without their numbers, once each, split into those that their text holds and those it does not."""
    raw = F.when(F.col("turn") % 5 == 4, "Nobody of Nowhere").otherwise(F.split_part("text", F.lit("."), F.lit(1)))
    name = ft.squeeze(F.regexp_replace(F.concat(F.lit("("), F.col("turn").cast("string"), F.lit(") "), raw), r"^\s*[(\[]?\s*\d+\s*[.)\]]\s*", ""))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", name.alias("name")).withColumn("key", ft.fold(F.col("name"))).where("key <> ''")
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("conv_id", "key").orderBy("turn"))).where("n = 1")
    return rows.select("conv_id", "name", F.contains(ft.fold(F.col("text")), F.col("key")).alias("grounded"))


@query(
    "matter_grouping",
    """WITH m AS (SELECT o_custkey AS grp, o_orderkey AS matter, o_orderstatus = 'F' AS is_primary FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY is_primary DESC, matter) AS n FROM m)
    SELECT grp, matter, n = 1 AS is_primary, coalesce(string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber) FILTER (WHERE l_linenumber <= 3), '') AS docs FROM r LEFT JOIN lineitem ON l_orderkey = matter GROUP BY ALL""",
)
def matter_grouping(spark, sf_dir):
    """Document numbers of each matter (those out of range dropped), and exactly one primary matter in a group."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("grp"), F.col("o_orderkey").alias("matter"), (F.col("o_orderstatus") == "F").alias("p"))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("p"), "matter")))
    numbers = table(spark, sf_dir, "lineitem").where("l_linenumber <= 3").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("d"))
    joined = rows.join(numbers, F.col("matter") == F.col("l_orderkey"), "left")
    listed = F.array_join(F.transform(F.coalesce("d", F.array().cast("array<int>")), lambda x: x.cast("string")), ",")
    return joined.select("grp", "matter", (F.col("n") == 1).alias("is_primary"), listed.alias("docs"))


@query("confidence_route", "SELECT event_id, least(greatest(coalesce(c, 0.0), 0.0), 1.0)::DOUBLE AS confidence, CASE WHEN coalesce(c, 0.0) >= 0.5 THEN 'fields' ELSE 'low_confidence' END AS bucket FROM (SELECT event_id, try_cast(CASE WHEN event_id % 7 = 0 THEN 'high' ELSE (value / 40.0 - 0.1)::VARCHAR END AS DOUBLE) AS c FROM events)")
def confidence_route(spark, sf_dir):
    """Confidence clamped to [0, 1], unreadable ones 0; under 0.5 a field is routed away."""
    raw = F.when(F.col("event_id") % 7 == 0, "high").otherwise((F.col("value") / 40.0 - 0.1).cast("string"))
    c = F.coalesce(raw.try_cast("double"), F.lit(0.0))
    rows = table(spark, sf_dir, "events").select("event_id", F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)).alias("confidence"))
    return rows.withColumn("bucket", F.when(F.col("confidence") >= 0.5, "fields").otherwise("low_confidence"))


@query("template_fill", "SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN 'That ' || s_name || ' holds ' || round(s_acctbal)::BIGINT || CASE WHEN s_suppkey % 2 = 0 THEN ' at ' || n_name ELSE '' END || '.' END AS clause FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def template_fill(spark, sf_dir):
    """A required value missing: no clause; an optional one missing: its part is left out."""
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    place = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit(" at "), "n_name")).otherwise("")
    clause = F.concat(F.lit("That "), "s_name", F.lit(" holds "), F.round("s_acctbal").cast("long").cast("string"), place, F.lit("."))
    return rows.select("s_suppkey", F.when(F.col("s_acctbal") > 0, clause).alias("clause"))


@query(
    "script_profile",
    rf"""WITH c AS (SELECT doc_id, length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) AS total, length(regexp_replace(regexp_replace(t, '[^\p{{L}}]', '', 'g'), '[^\x{{0900}}-\x{{097F}}]', '', 'g')) AS n FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN repeat('{_HINDI}', (doc_id % 9)::BIGINT) || text ELSE text END AS t FROM documents))
    SELECT doc_id, n AS n_hi, total AS n_letters, round(n / nullif(total, 0)::DOUBLE, 6) AS ratio, CASE WHEN total < 20 THEN 'unknown' WHEN n = 0 THEN 'en' WHEN n / total::DOUBLE >= 0.6 THEN 'hi' WHEN n >= 10 THEN 'mixed' ELSE 'en' END AS label FROM c""",
)
def script_profile(spark, sf_dir):
    """Letters of Devanagari among all letters of a text, and the label by fixed thresholds."""
    t = F.when(F.col("doc_id") % 4 == 0, F.concat(F.repeat(F.lit(_HINDI), (F.col("doc_id") % 9).cast("int")), "text")).otherwise(F.col("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", t.alias("t")).select("doc_id", ft.letters(F.col("t")).cast("long").alias("n_letters"), ft.script_letters(F.col("t"), "hi").cast("long").alias("n_hi"))
    ratio = F.round(F.col("n_hi") / F.nullif(F.col("n_letters"), F.lit(0)), 6)
    return rows.select("doc_id", "n_hi", "n_letters", ratio.alias("ratio"), ft.script_label(F.col("n_letters"), F.col("n_hi"), "hi").alias("label"))


@query("digits_translit", "SELECT c_custkey, c_name || ' धारा ' || c_custkey AS ascii FROM customer")
def digits_translit(spark, sf_dir):
    """Devanagari digits to ASCII ones, beside letters and digits that stay."""
    raw = F.concat("c_name", F.lit(" धारा "), F.translate(F.col("c_custkey").cast("string"), "0123456789", "०१२३४५६७८९"))
    return table(spark, sf_dir, "customer").select("c_custkey", ft.devanagari_digits(raw).alias("ascii"))


_ANSWER_SQL = "CASE doc_id % 5 WHEN 0 THEN 'Here is the English translation of it:' || chr(10) || chr(10) || text WHEN 1 THEN '```' || chr(10) || text || chr(10) || '```' WHEN 2 THEN left(text, 5) WHEN 3 THEN chr(10) || ' ' ELSE text || chr(10) END"
_BARE_SQL = r"regexp_replace(regexp_replace(regexp_replace(a, '(?i)^\s*(here is|here''s|the following is)?\s*(the\s+)?(english\s+)?translation\s*(of[^\n:]*)?\s*:\s*\n+', ''), '^\n+', ''), '\n+$', '')"


@query(
    "ratio_guard",
    f"""WITH x AS (SELECT doc_id, text, {_ANSWER_SQL} AS a FROM documents), b AS (SELECT doc_id, text, {_BARE_SQL} AS b FROM x),
    c AS (SELECT doc_id, text, CASE WHEN starts_with(b, '```') AND starts_with(trim(string_split(b, chr(10))[-1]), '```') THEN array_to_string(string_split(b, chr(10))[2:-2], chr(10)) ELSE b END AS c FROM b)
    SELECT doc_id, CASE WHEN trim(c) = '' OR length(c) < length(trim(text)) * 0.25 THEN text ELSE c END AS kept FROM c""",
)
def ratio_guard(spark, sf_dir):
    """A model's answer without preamble and fence; one shorter than a quarter of its source is not believed, and the source stays."""
    k, t = F.col("doc_id") % 5, F.col("text")
    answer = F.when(k == 0, F.concat(F.lit("Here is the English translation of it:\n\n"), t)).when(k == 1, F.concat(F.lit("```\n"), t, F.lit("\n```"))).when(k == 2, F.left(t, F.lit(5))).when(k == 3, "\n ").otherwise(F.concat(t, F.lit("\n")))
    return table(spark, sf_dir, "documents").select("doc_id", ft.believed(answer, t).alias("kept"))


@query("retention", "SELECT conv_id, turn, round(len(string_split(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')), ' ')) / greatest(len(string_split(text, ' ')), 1)::DOUBLE, 6) AS retention FROM conversations")
def retention(spark, sf_dir):
    """Words of a squeezed text over those of the text as it was."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.round(F.size(F.split(ft.squeeze(F.col("text")), " ")) / F.greatest(F.size(F.split("text", " ")), F.lit(1)), 6).alias("retention"))


@query("fidelity")
def fidelity(spark, sf_dir):
    """Words of a cleaned part that stand in matching runs of the noisy one."""
    rows = _noisy(spark, sf_dir).withColumn("clean", ft.clean_page_text(F.col("raw")))
    return paragraphs.fidelity(rows, "raw", "clean").select("conv_id", "turn", F.round("fidelity", 6).alias("fidelity"))


@query(
    "split_sections",
    r"""WITH d AS (SELECT conv_id, string_agg('<<SECTION:' || role || '>>' || text, '' ORDER BY turn) AS body FROM conversations GROUP BY conv_id), s AS (SELECT conv_id, unnest(string_split(body, '<<SECTION:')[2:]) AS part, generate_subscripts(string_split(body, '<<SECTION:')[2:], 1) AS place FROM d)
    SELECT conv_id, split_part(part, '>>', 1) AS name, substr(part, strpos(part, '>>') + 2) AS body FROM s QUALIFY row_number() OVER (PARTITION BY conv_id, name ORDER BY place) = 1""",
)
def split_sections(spark, sf_dir):
    """Marked sections of a draft; the first of each name stays."""
    ordered = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("<<SECTION:"), "role", F.lit(">>"), "text").alias("t")))).alias("p"))
    parts = ordered.select("conv_id", F.posexplode(F.slice(F.split(F.array_join(F.transform("p", lambda x: x["t"]), ""), "<<SECTION:"), 2, 2147483646)).alias("at", "part"))
    rows = parts.select("conv_id", "at", F.split_part("part", F.lit(">>"), F.lit(1)).alias("name"), F.expr("substring(part, instr(part, '>>') + 2)").alias("body"))
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("conv_id", "name").orderBy("at"))).where("n = 1").select("conv_id", "name", "body")


_LINED_SQL = "CASE WHEN doc_id % 2 = 0 THEN 'List of Acts' || chr(10) || replace(text, ', ', '-' || chr(10)) || chr(10) || '12. an item' || chr(10) || 'A' || chr(10) || 'ISSUE FOR ALL' || chr(10) || 'the end' ELSE replace(text, '. ', '.' || chr(10)) END"


@query(
    "reflow_lines",
    rf"""WITH d AS (SELECT doc_id, string_split(regexp_replace({_LINED_SQL}, '\n\s*[A-H]\s*\n', chr(10), 'g'), chr(10)) AS ls FROM documents), l AS (SELECT doc_id, trim(unnest(ls), chr(32) || chr(9) || chr(13) || chr(11) || chr(12)) AS line, generate_subscripts(ls, 1) AS place FROM d),
    k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS n FROM l WHERE line <> ''),
    g AS (SELECT *, sum((n = 1 OR line IN ('List of Acts', 'List of Keywords', 'Case Arising From', 'Issue for Consideration', 'Headnotes+') OR regexp_matches(line, '^[A-Z][A-Z\s]+$') OR regexp_matches(line, '^[0-9]+\.'))::INT) OVER (PARTITION BY doc_id ORDER BY place) AS para FROM k)
    SELECT doc_id, para::BIGINT AS para, replace(replace(string_agg(line, chr(57344) ORDER BY place), '-' || chr(57344), ''), chr(57344), ' ') AS body FROM g GROUP BY doc_id, para""",
)
def reflow_lines(spark, sf_dir):
    """Lines to paragraphs: a heading or a numbered item begins one; a hyphen at a line's end joins its word."""
    t = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("List of Acts\n"), F.replace("text", F.lit(", "), F.lit("-\n")), F.lit("\n12. an item\nA\nISSUE FOR ALL\nthe end"))).otherwise(F.replace("text", F.lit(". "), F.lit(".\n")))
    return paragraphs.reflow(table(spark, sf_dir, "documents").select("doc_id", t.alias("t")), "doc_id", "t")


@query("key_inference", "SELECT p_partkey, CASE WHEN p_name = 'red ring' THEN 'exact_ring' WHEN contains(lower(p_name), 'ring') THEN 'ring' WHEN contains(lower(p_name), 'widget') THEN 'widget' ELSE 'other' END AS key FROM part")
def key_inference(spark, sf_dir):
    """A known display name has its key; else the first keyword it contains."""
    exact = F.create_map(F.lit("red ring"), F.lit("exact_ring"))
    low = F.lower("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(F.try_element_at(exact, F.col("p_name")), F.when(F.contains(low, F.lit("ring")), "ring").when(F.contains(low, F.lit("widget")), "widget"), F.lit("other")).alias("key"))


#: (display name, seat): bracketed alias, last part that is no court word, slash of two cities.
@query(
    "seat_extract",
    """WITH s AS (SELECT s_suppkey, n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey),
    d AS (SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'High Court of X (' || n || ' Bench)' WHEN 1 THEN 'District Court - ' || n WHEN 2 THEN 'Tribunal - ' || n || ' - Principal Bench' WHEN 3 THEN 'Court - ' || n || '/Nagpur' ELSE 'Supreme Court' END AS display, n
      FROM (SELECT s_suppkey, upper(n_name[1]) || lower(replace(n_name[2:], '_', ' ')) AS n FROM s))
    SELECT s_suppkey, display, CASE WHEN s_suppkey % 5 < 4 AND (s_suppkey % 5 > 0 OR regexp_full_match(n, '[A-Z][A-Za-z ]+')) THEN n END AS seat FROM d""",
)
def seat_extract(spark, sf_dir):
    """The seat in a court's name: before 'Bench' in brackets, else the last part that names no court, up to a stroke."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    n = F.concat(F.upper(F.substring("n_name", 1, 1)), F.lower(F.replace(F.expr("substring(n_name, 2)"), F.lit("_"), F.lit(" "))))
    held = table(spark, sf_dir, "supplier").join(F.broadcast(nation), F.col("n_nationkey") == F.col("s_nationkey")).select("s_suppkey", n.alias("n"))  # 25 rows
    k = F.col("s_suppkey") % 5
    display = (
        F.when(k == 0, F.concat(F.lit("High Court of X ("), "n", F.lit(" Bench)"))).when(k == 1, F.concat(F.lit("District Court - "), "n"))
        .when(k == 2, F.concat(F.lit("Tribunal - "), "n", F.lit(" - Principal Bench"))).when(k == 3, F.concat(F.lit("Court - "), "n", F.lit("/Nagpur"))).otherwise("Supreme Court")
    )
    rows = held.select("s_suppkey", display.alias("display"))
    court = r"(?i)court|tribunal|bench|commission"
    bracket = F.nullif(F.regexp_extract("display", r"\(([A-Z][A-Za-z ]+?) Bench\)", 1), F.lit(""))
    parts = F.filter(F.reverse(F.split("display", " - ")), lambda x: ~F.rlike(x, F.lit(court)))
    last = F.trim(F.split_part(F.try_element_at(parts, F.lit(1)), F.lit("/"), F.lit(1)))
    return rows.select("s_suppkey", "display", F.coalesce(bracket, last).alias("seat"))


@query("section_list", "SELECT o_orderkey, array_to_string(list_filter(['title', CASE WHEN o_totalprice > 100000 THEN 'index' END, 'facts', CASE WHEN o_orderstatus = 'F' THEN 'prayer' END, 'verification'], lambda x: x IS NOT NULL), '>') AS sections FROM orders")
def section_list(spark, sf_dir):
    parts = F.array(F.lit("title"), F.when(F.col("o_totalprice") > 100000, "index"), F.lit("facts"), F.when(F.col("o_orderstatus") == "F", "prayer"), F.lit("verification"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(F.filter(parts, lambda x: x.isNotNull()), ">").alias("sections"))


@query("split_items", "SELECT conv_id, turn, array_to_string(list_filter(list_transform(string_split_regex(replace(text, '.', ';'), '[\\n;]+'), lambda x: trim(x)), lambda x: x <> ''), '|') AS items FROM conversations")
def split_items(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(ft.split_items(F.replace("text", F.lit("."), F.lit(";"))), "|").alias("items"))


@query("translation_note", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'translated from ' || CASE lang WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' ELSE lang END WHEN doc_id % 3 = 1 AND lang <> 'en' THEN 'not translated' ELSE '' END AS note FROM documents")
def translation_note(spark, sf_dir):
    names = F.create_map(F.lit("de"), F.lit("German"), F.lit("fr"), F.lit("French"))
    name = F.coalesce(F.try_element_at(names, F.col("lang")), F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("translated from "), name)).when((F.col("doc_id") % 3 == 1) & (F.col("lang") != "en"), "not translated").otherwise("").alias("note"))


@query(
    "numbered_list",
    """WITH f AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations), u AS (SELECT conv_id, turn, length(text) AS c FROM conversations WHERE role = 'user')
    SELECT f.conv_id, f.turn, 'Annexure ' || n AS label, c IS NOT NULL AS narrated, coalesce(c, 0)::BIGINT AS chars_used FROM f LEFT JOIN u USING (conv_id, turn)""",
)
def numbered_list(spark, sf_dir):
    """Filed rows numbered in order, with what was used of each."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    used = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.char_length("text").cast("long").alias("c"))
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    joined = rows.withColumn("n", n).join(used, ["conv_id", "turn"], "left")
    return joined.select("conv_id", "turn", F.concat(F.lit("Annexure "), F.col("n").cast("string")).alias("label"), F.col("c").isNotNull().alias("narrated"), F.coalesce("c", F.lit(0).cast("long")).alias("chars_used"))


@query("rule_label", "SELECT p_partkey, 'Ch. ' || p_brand || ' R.' || coalesce((CASE WHEN p_size % 5 <> 0 THEN p_size END)::VARCHAR, '—') || coalesce('(' || (CASE WHEN p_size % 2 = 0 THEN p_type END) || ')', '') AS label FROM part")
def rule_label(spark, sf_dir):
    number = F.coalesce(F.when(F.col("p_size") % 5 != 0, F.col("p_size")).cast("string"), F.lit("—"))
    sub = F.coalesce(F.concat(F.lit("("), F.when(F.col("p_size") % 2 == 0, F.col("p_type")), F.lit(")")), F.lit(""))
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("Ch. "), "p_brand", F.lit(" R."), number, sub).alias("label"))


@query("round_math", "SELECT o_custkey, (sum(round(o_totalprice * 100)::BIGINT) * 2 + count(*))::BIGINT // (2 * count(*)) AS mean_cents, ceil(count(*) / 10.0)::BIGINT AS pages, greatest(least(count(*), 20), 5) AS clamped FROM orders GROUP BY o_custkey")
def round_math(spark, sf_dir):
    n = F.count(F.lit(1))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.expr("(sum(cast(round(o_totalprice * 100) as bigint)) * 2 + count(1)) div (2 * count(1))").alias("mean_cents"), F.ceil(n / 10.0).alias("pages"), F.greatest(F.least(n, F.lit(20).cast("long")), F.lit(5).cast("long")).alias("clamped"))
