"""Queries over the star-schema tables, one or more for each operator, with the SQL that must give the same rows.

Each query runs over its whole tables. A limit stands only where it is the feature: pages, feeds, browse lists.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfold import corpus as c
from tarnfold.functions import markup, text
from tarnfold.operators import catalog, collections, ingest, search
from tarnfold.operators import index as idx
from tarnfold.operators.match import hits, matches, ranked
from tarnfold.plans.query_lang import Request, Term, compile_query
from tarnfold.sources import feed
from tarnfold.sources.addresses import Addresses

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


# --- SQL parts: tokens by DuckDB's own accent stripping, phrases by joins on positions, BM25 written out.

SRC = """src AS (SELECT doc_id, split_part(text, chr(10), 1) AS title, source AS item_title, lang AS presenter, text FROM documents),
tok AS (SELECT doc_id, field, regexp_extract_all(lower(strip_accents(coalesce(c, ''))), '[\\p{L}\\p{N}]+') AS ts
        FROM (SELECT doc_id, 0 AS field, title AS c FROM src UNION ALL SELECT doc_id, 1, item_title FROM src UNION ALL SELECT doc_id, 2, presenter FROM src UNION ALL SELECT doc_id, 3, text FROM src)),
occ AS (SELECT doc_id, field, unnest(ts) AS term, generate_subscripts(ts, 1) - 1 AS pos FROM tok),
len AS (SELECT doc_id, sum(len(ts)) AS n FROM tok GROUP BY doc_id)"""
COLUMN = {"title": 0, "item_title": 1, "presenter": 2, "text": 3}
MEETINGS = "mt AS (SELECT o_orderkey AS meeting_id, strftime(o_orderdate, '%Y-%m-%d') AS date, year(o_orderdate) AS year, o_orderpriority AS meeting_type, 'Meeting ' || o_orderkey AS meeting_name, o_orderstatus = 'F' AS cancelled, o_orderkey % 2 = 0 AS docs_indexed FROM orders)"
DOCS = "dc AS (SELECT doc_id, doc_id AS meeting_id, CASE doc_id % 3 WHEN 0 THEN 'agenda_item' WHEN 1 THEN 'attachment' ELSE 'minutes' END AS kind, CASE doc_id % 3 WHEN 0 THEN 'i' WHEN 1 THEN 'f' ELSE 'm' END || doc_id AS ref, split_part(text, chr(10), 1) AS title, source AS item_title, lang AS presenter, text, doc_id AS sort_order FROM documents)"


def _tf(i: int, tokens: list[str], prefix: bool, column: str | None) -> str:
    joins = " ".join(f"JOIN occ a{k} ON a{k}.doc_id = a0.doc_id AND a{k}.field = a0.field AND a{k}.pos = a0.pos + {k}" for k in range(1, len(tokens)))
    tests = [f"a{k}.term = '{t}'" for k, t in enumerate(tokens)]
    if prefix:
        tests[-1] = f"starts_with(a{len(tokens) - 1}.term, '{tokens[-1]}')"
    if column:
        tests.append(f"a0.field = {COLUMN[column]}")
    return f"t{i} AS (SELECT a0.doc_id, sum(CASE a0.field WHEN 0 THEN 8.0::DOUBLE WHEN 1 THEN 5.0::DOUBLE WHEN 2 THEN 0.3::DOUBLE ELSE 1.5::DOUBLE END) AS tf FROM occ a0 {joins} WHERE {' AND '.join(tests)} GROUP BY a0.doc_id)"


def match_ctes(used, negatives=(), joiner="AND") -> str:
    """CTEs up to `hit(doc_id, rank)`. Phrases are (tokens, prefix, column)."""
    every = [*used, *negatives]
    n = len(used)
    ctes = [SRC, *[_tf(i, *p) for i, p in enumerate(every)]]
    idf = lambda i: f"(SELECT CASE WHEN x > 0 THEN x ELSE 1e-6 END FROM (SELECT ln(((SELECT count(*) FROM len) - count(*) + 0.5) / (count(*) + 0.5)) AS x FROM t{i}))"
    part = lambda i: f"{idf(i)} * (coalesce(t{i}.tf, 0) * 2.2::DOUBLE / (coalesce(t{i}.tf, 0) + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len.n / (SELECT avg(n) FROM len))))"
    wanted = f" {joiner} ".join(f"t{i}.tf IS NOT NULL" for i in range(n))
    excluded = "".join(f" AND t{i}.tf IS NULL" for i in range(n, len(every)))
    joins = " ".join(f"LEFT JOIN t{i} ON t{i}.doc_id = len.doc_id" for i in range(len(every)))
    ctes.append(f"hit AS (SELECT len.doc_id, round(-({' + '.join(part(i) for i in range(n))}), 9) AS rank FROM len {joins} WHERE ({wanted}){excluded})")
    return "WITH " + ",\n".join(ctes)


def _ranked_query(name: str, raw: str, used, negatives=(), joiner="AND", relaxed=False):
    @query(name, match_ctes(used, negatives, joiner) + "\nSELECT doc_id, rank FROM hit")
    def run(spark, d):
        return ranked(c.index(spark, d), compile_query(raw, relaxed)).select("doc_id", F.round("rank", 9).alias("rank"))

    return run


P = lambda text, prefix=False, column=None: (text.split(), prefix, column)

# Full text -------------------------------------------------------------------------------------------------

query("fts_tokenize", f"WITH {SRC} SELECT doc_id, field::TINYINT AS field, pos::INT AS pos, term FROM occ")(lambda s, d: idx.occurrences(idx.tokenised(c.documents(s, d))).select("doc_id", "field", "pos", "term"))
query("fts_postings_df", f"WITH {SRC} SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM occ GROUP BY term")(lambda s, d: idx.document_frequencies(c.index(s, d)))
query("fts_doc_len", f"WITH {SRC} SELECT doc_id, n::BIGINT AS n_tokens FROM len")(lambda s, d: idx.lengths(idx.tokenised(c.documents(s, d))))

_ranked_query("fts_term", "erblest", [P("erblest")])
_ranked_query("fts_and", "erblest whou", [P("erblest"), P("whou")])
_ranked_query("fts_and_common", '"que" "de"', [P("que"), P("de")])
_ranked_query("fts_or", "erblest OR whou", [P("erblest"), P("whou")], joiner="OR")
_ranked_query("fts_not", '"the" -"with"', [P("the")], [P("with")])
_ranked_query("fts_or_not", 'erblest or whou -"of the" -presenter:fr', [P("erblest"), P("whou")], [P("of the"), P("fr", False, "presenter")], "OR")
_ranked_query("fts_phrase", '"of the"', [P("of the")])
_ranked_query("fts_phrase_and_word", '"of the" erblest', [P("of the"), P("erblest")])
_ranked_query("fts_prefix", "reti*", [P("reti", True)])
_ranked_query("fts_phrase_prefix", '"of the"*', [P("of the", True)])
_ranked_query("fts_column", "title:the", [P("the", False, "title")])
_ranked_query("fts_column_presenter", "presenter:fr", [P("fr", False, "presenter")])
_ranked_query("fts_column_prefix", "item_title:src1*", [P("src1", True, "item_title")])
_ranked_query("fts_other_field", "src1", [P("src1")])
_ranked_query("fts_accents", "ÉLEOI*", [P("eleoi", True)])
_ranked_query("fts_bm25_common_term_floor", '"the"', [P("the")])
_ranked_query("fts_repeated_term", "erblest erblest whou*", [P("erblest"), P("erblest"), P("whou", True)])
_ranked_query("search_relaxed", "erblest whou", [P("erblest"), P("whou")], joiner="OR", relaxed=True)


@query("fts_zero_token_term", match_ctes([P("the")]) + "\nSELECT doc_id FROM hit WHERE false")
def _zero(s, d):
    return matches(c.index(s, d), compile_query('"the" &')).select("doc_id")


@query("fts_hits", f"WITH {SRC} SELECT a.doc_id, a.field::TINYINT AS field, 0 AS term_no, count(*) AS n FROM occ a JOIN occ b ON a.doc_id = b.doc_id AND a.field = b.field AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the' GROUP BY ALL")
def _hits(s, d):
    return hits(c.index(s, d), [Term("of the", bare=False)]).select("doc_id", "field", "term_no", "n")


@query("search_strict_or_relaxed", f"{match_ctes([P('erblest'), P('whou')], joiner='OR')}, {MEETINGS} SELECT doc_id, rank FROM hit JOIN mt ON mt.meeting_id = hit.doc_id ORDER BY rank, doc_id LIMIT 25")
def _chosen(s, d):
    lib = c.library(s, d)
    plan, _ = search.choose_plan(lib, Request("erblest whou"))
    return search.page(lib, plan).select("doc_id", "rank")


def _page_sql(used, order: str, where: str = "true", limit: str = "LIMIT 25") -> str:
    return f"{match_ctes(used)},\n{MEETINGS},\n{DOCS}\nSELECT hit.doc_id, dc.kind, mt.date, mt.year::INT AS year, hit.rank FROM hit JOIN dc ON dc.doc_id = hit.doc_id JOIN mt ON mt.meeting_id = dc.meeting_id WHERE {where} ORDER BY {order} {limit}"


def _page(s, d, request: Request, offset: int = 0) -> DataFrame:
    return search.page(c.library(s, d), compile_query(request.q), request, offset).select("doc_id", "kind", "date", "year", "rank")


OF_THE = [P("of the")]
query("search_ranked", _page_sql(OF_THE, "rank, doc_id"))(lambda s, d: _page(s, d, Request('"of the"')))
query("search_newest", _page_sql(OF_THE, "date DESC NULLS LAST, rank, hit.doc_id"))(lambda s, d: _page(s, d, Request('"of the"', sort="newest")))
query("search_oldest", _page_sql(OF_THE, "date ASC NULLS FIRST, rank, hit.doc_id"))(lambda s, d: _page(s, d, Request('"of the"', sort="oldest")))
query("search_filtered_year_kind", _page_sql([P("reti", True)], "rank, hit.doc_id", "mt.year = 1997 AND dc.kind = 'minutes'"))(lambda s, d: _page(s, d, Request("reti*", 1997, "minutes")))
query("search_page_2", _page_sql([P("reti", True)], "rank, hit.doc_id", limit="LIMIT 25 OFFSET 25"))(lambda s, d: _page(s, d, Request("reti*"), 25))
query("search_count", f"{match_ctes(OF_THE)}, {MEETINGS} SELECT count(*) AS n FROM hit JOIN mt ON mt.meeting_id = hit.doc_id WHERE mt.year = 1998")(lambda s, d: search.count_matches(c.library(s, d), compile_query('"of the"'), Request(year=1998)))
query("search_full_page")(lambda s, d: search.full_page(c.library(s, d), compile_query("erblest", relaxed=True)))
query("search_full_page_columns", f"{match_ctes([P('reti', True)])}, {MEETINGS}, {DOCS} SELECT hit.doc_id, ref, kind, title, item_title, presenter, date, meeting_name, meeting_type, rank FROM hit JOIN dc ON dc.doc_id = hit.doc_id JOIN mt ON mt.meeting_id = dc.meeting_id ORDER BY rank, hit.doc_id LIMIT 25")(
    lambda s, d: search.full_page(c.library(s, d), compile_query("reti*")).select("doc_id", "ref", "kind", "title", "item_title", "presenter", "date", "meeting_name", "meeting_type", "rank"))

#: What is typed, and the expression that it must become.
TYPED = (
    ("plum jam", '"plum" AND "jam"', False), ("plum jam", '"plum" OR "jam"', True), ('"cold frame" glass', '"cold frame" OR "glass"', True), ("oboe or cello -drum", '("oboe" OR "cello") NOT ("drum")', False),
    ("oboe NOT and cello drum", '"oboe" AND "drum" NOT ("cello")', False), ("harp* title:solo", '"harp"* AND title:"solo"', False), ('Opus:"c d"*', '"Opus:c d"*', False), ("what is the tempo", '"tempo"', False), ("who they", '"who" AND "they"', False),
    ("how?", '"how?"', False), ('-"only this"', None, False), ("", None, False), ('hum "la', '"hum" AND "la"', False), ("p q OR r", '"p" OR "q" OR "r"', False), ("-not oboe", '"oboe" NOT ("not")', False), ('oboe NOT "" cello', '"oboe" AND "cello"', False),
)


@query("query_language", "SELECT * FROM (VALUES " + ", ".join("({}, {}, {})".format("'" + raw.replace("'", "''") + "'", "NULL" if expr is None else f"'{expr}'", str(relaxed).lower()) for raw, expr, relaxed in TYPED) + ") v(raw, expr, relaxed)")
def _language(s, d):
    return s.createDataFrame([(raw, compile_query(raw, relaxed).expr, relaxed) for raw, _, relaxed in TYPED], "raw string, expr string, relaxed boolean")


@query("highlight_html", f"SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), 'the', '<mark>the</mark>') AS html, contains(text, 'the') AS has_match FROM documents")
def _highlight(s, d):
    marked = F.replace("text", F.lit("the"), F.lit(f"{markup.OPEN}the{markup.CLOSE}"))
    return c.table(s, d, "documents").select("doc_id", markup.highlight(marked).alias("html"), markup.has_match(marked).alias("has_match"))


# Catalogue -------------------------------------------------------------------------------------------------

query("browse_meetings", f"WITH {MEETINGS} SELECT meeting_id, date, (SELECT count(*) FROM lineitem WHERE l_orderkey = mt.meeting_id) AS attachments FROM mt WHERE date IS NOT NULL ORDER BY date DESC, meeting_id LIMIT 400")(
    lambda s, d: catalog.browse(c.meetings(s, d), c.attachments(s, d)).select("meeting_id", "date", F.col("attachments").cast("long").alias("attachments")))
query("meeting_documents", """WITH l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey) AS nth FROM lineitem), m AS (SELECT min(o_orderkey) AS k FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 3)),
u AS (SELECT o_orderkey, 'agenda_item' AS kind, 0 AS sort_order FROM orders UNION ALL SELECT o_orderkey, 'agenda_item', 1 FROM orders UNION ALL SELECT l_orderkey, 'attachment', (1 + nth)::INT FROM l UNION ALL SELECT o_orderkey, 'minutes', 10000 FROM orders WHERE o_orderkey % 3 = 0)
SELECT u.o_orderkey::VARCHAR AS meeting_id, kind, year(o_orderdate)::INT AS year, sort_order, (row_number() OVER (ORDER BY sort_order))::INT AS place FROM u JOIN orders USING (o_orderkey) WHERE o_orderkey = (SELECT k FROM m)""")(lambda s, d: _one_meeting(s, d))


def _one_meeting(s, d) -> DataFrame:
    """The first meeting with minutes and more than three attachments: its documents in agenda order, numbered as they come."""
    many = c.table(s, d, "lineitem").groupBy("l_orderkey").count().where("count > 3")
    first = c.table(s, d, "orders").where("o_orderkey % 3 = 0").join(many, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").agg(F.min("o_orderkey")).first()[0]
    rows = catalog.meeting_documents(catalog.meeting_rows(_nested(s, d)).select("meeting_id", "year"), _document_rows(s, d), str(first)).select("meeting_id", "kind", "year", "sort_order")
    return rows.withColumn("place", (F.monotonically_increasing_id() + 1).cast("int"))
query("documents_with_meetings", f"WITH {MEETINGS}, {DOCS} SELECT ref, kind, date, year::INT AS year, meeting_type FROM dc JOIN mt USING (meeting_id)")(lambda s, d: c.documents(s, d).join(c.meetings(s, d), "meeting_id").select("ref", "kind", "date", "year", "meeting_type"))
query("coverage_by_year", f"WITH {MEETINGS} SELECT year::INT AS year, count(DISTINCT meeting_id) AS meetings, sum(CASE WHEN docs_indexed THEN 1 ELSE 0 END)::BIGINT AS with_documents FROM mt WHERE year IS NOT NULL GROUP BY year")(lambda s, d: catalog.coverage_by_year(c.meetings(s, d)))
query("facet_years", f"WITH {MEETINGS} SELECT DISTINCT year::INT AS year FROM mt")(lambda s, d: catalog.facet_years(c.meetings(s, d)))
query("stats_totals", f"WITH {MEETINGS} SELECT count(*) AS meetings, count(*) FILTER (WHERE docs_indexed) AS indexed, count(*) FILTER (WHERE cancelled) AS cancelled, min(date) AS first_date, max(date) AS last_date FROM mt")(lambda s, d: catalog.totals(c.meetings(s, d)))
query("stats_by_kind", f"WITH {DOCS} SELECT kind, count(*) AS n, sum(length(text))::BIGINT AS chars, count(*) FILTER (WHERE length(text) > 0) AS with_text FROM dc GROUP BY kind")(lambda s, d: catalog.stats_by_kind(c.documents(s, d)))
query("stats_by_year", f"WITH {MEETINGS} SELECT year::INT AS year, count(*) AS n, repeat('#', least(60, count(*))::INT) AS bar FROM mt GROUP BY year ORDER BY year DESC LIMIT 20")(lambda s, d: catalog.meetings_per_year(c.meetings(s, d)))


@query("corpus_counters", f"WITH {DOCS} SELECT count(*) AS documents, sum(length(text))::BIGINT AS chars, count(*) FILTER (WHERE length(text) > 0) AS with_text, count(*) FILTER (WHERE (CASE doc_id % 4 WHEN 0 THEN 'ocr' WHEN 1 THEN 'text-layer+ocr' WHEN 2 THEN 'none' END) LIKE '%ocr%') AS read_by_ocr FROM dc")
def _counters(s, d):
    k = F.pmod("doc_id", F.lit(4))
    return catalog.corpus_counters(c.documents(s, d).withColumn("extract_method", F.when(k == 0, "ocr").when(k == 1, "text-layer+ocr").when(k == 2, "none")))


@query("build_meta", f"WITH {DOCS}, {MEETINGS} SELECT * FROM (VALUES ('org_id', '9'), ('site_tagline', ''), ('schema_version', '2')) v(key, value) UNION ALL SELECT 'meeting_count', count(*)::VARCHAR FROM mt UNION ALL SELECT 'meetings_with_documents', count(*)::VARCHAR FROM mt WHERE docs_indexed UNION ALL SELECT 'document_count', count(*)::VARCHAR FROM dc UNION ALL SELECT 'documents_with_text', count(*)::VARCHAR FROM dc WHERE length(text) > 0 UNION ALL SELECT 'documents_ocr', '0'")
def _meta(s, d):
    return catalog.meta({"org_id": 9, "site_tagline": None}, c.documents(s, d).withColumn("extract_method", F.lit("none")), c.meetings(s, d))


FIRST_SEEN = "fs AS (SELECT user_id AS doc, min(ts) AS first_seen FROM events GROUP BY user_id)"


def _feed_documents(s, d) -> DataFrame:
    seen = ingest.first_seen(c.seen_log(s, d), "doc", "ts")
    return c.documents(s, d).join(seen, F.col("doc_id") == F.col("doc"), "left").drop("doc")


@query("feed_top100", f"WITH {DOCS}, {MEETINGS}, {FIRST_SEEN} SELECT ref, kind, date, first_seen FROM dc JOIN fs ON fs.doc = dc.doc_id JOIN mt USING (meeting_id) WHERE kind IN ('attachment', 'minutes') ORDER BY first_seen::DATE DESC, date DESC, sort_order LIMIT 100")
def _feed(s, d):
    return catalog.newest_documents(_feed_documents(s, d), c.meetings(s, d)).select("ref", "kind", "date", "first_seen")


XML = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"


@query("feed_entries", rf"""WITH {DOCS}, {MEETINGS}, {FIRST_SEEN} SELECT ref, concat_ws(chr(10), '  <entry>', '    <title>' || regexp_replace({XML.format('title')}, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g') || '</title>',
 '    <link href="https://example.org/' || ref || '" />', '    <id>urn:documents:9:' || ref || '</id>', '    <updated>' || strftime(first_seen, '%Y-%m-%dT%H:%M:%S.') || lpad((date_part('millisecond', first_seen)::BIGINT % 1000)::VARCHAR, 3, '0') || 'Z</updated>',
 '    <category term="' || kind || '" />', '    <summary>' || meeting_name || ' · ' || date || ' · item ' || presenter || '</summary>', '  </entry>') AS entry FROM dc JOIN fs ON fs.doc = dc.doc_id JOIN mt USING (meeting_id)""")
def _entries(s, d):
    rows = _feed_documents(s, d).where("first_seen is not null").join(c.meetings(s, d), "meeting_id").withColumns({"source_url": F.concat(F.lit("https://example.org/"), "ref"), "item_label": F.col("presenter")})
    return feed.entries(rows, "9", F.lit("2026-01-01").cast("timestamp")).select("ref", "entry")


def _nested(s, d) -> DataFrame:
    """Orders as nested meeting records: two items, the lines of an order as attachments of the second, minutes for every third."""
    att = F.struct(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.unix_date(F.to_date("l_shipdate")).cast("string"), F.col("l_extendedprice").cast("decimal(20,2)").cast("string")).alias("fileId"), F.when(F.col("l_linenumber") > 1, F.col("l_returnflag")).otherwise("").alias("name"), F.lit("v").alias("viewerUrl"), (F.col("l_linenumber") < 4).alias("indexed"))
    lines = c.table(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(att)).alias("atts"))
    item = lambda n, atts: F.struct(F.concat_ws("-", F.col("o_orderkey").cast("string"), F.lit(n)).alias("itemId"), F.lit("1." if n == "1" else "").alias("label"), (F.col("o_orderpriority") if n == "1" else F.lit("")).alias("title"), F.lit("5 minutes").alias("qualifier"), (F.lit("") if n == "1" else F.concat(F.lit("P "), F.col("o_orderkey").cast("string"))).alias("presenter"), F.col("o_orderstatus").alias("description"), atts.alias("attachments"))
    none = F.array().cast("array<struct<fileId:string,name:string,viewerUrl:string,indexed:boolean>>")
    key = F.col("o_orderkey").cast("string")
    return c.table(s, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        key.alias("meetingId"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.lit("7:00 PM").alias("time"), F.col("o_orderpriority").alias("title"), F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("meetingType"),
        F.when(F.col("o_orderkey") % 2 == 0, "committee").alias("body"), (F.col("o_orderstatus") == "F").alias("cancelled"), F.lit("").alias("location"), F.lit("").alias("notes"), F.lit("a").alias("agendaUrl"), F.lit("u").alias("minutesUrl"), F.lit("p").alias("packetUrl"),
        F.array(item("1", none), item("2", F.coalesce("atts", none))).alias("items"),
        F.when(F.col("o_orderkey") % 3 == 0, F.struct(F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("page of "), key)).otherwise("").alias("url"), F.lit(None).cast("string").alias("fileId"), F.concat(F.lit("minutes-"), key).alias("textKey"))).alias("minutes"), (F.col("o_orderkey") % 2 == 1).alias("documentsIndexed"))


FILE = "l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || (l_shipdate::DATE - DATE '1970-01-01') || '-' || l_extendedprice::DECIMAL(20,2)"


@query("documents_union", f"""WITH l AS (SELECT *, {FILE} AS file, row_number() OVER (PARTITION BY l_orderkey ORDER BY {FILE}) AS nth FROM lineitem), o AS (SELECT *, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderkey::VARCHAR AS meeting_id FROM orders)
SELECT 'i' || o_orderkey || '-1' AS ref, meeting_id, 'agenda_item' AS kind, o_orderkey || '-1' AS item_id, o_orderpriority AS title, '1.' AS item_label, o_orderpriority AS item_title, NULL::VARCHAR AS presenter, 'a' AS source_url, NULL::INT AS pages, 0 AS sort_order, '5 minutes' || chr(10) || o_orderstatus AS text, NULL::VARCHAR AS extract_method, day AS seen FROM o
UNION ALL SELECT 'i' || o_orderkey || '-2', meeting_id, 'agenda_item', o_orderkey || '-2', 'Agenda item', NULL, NULL, 'P ' || o_orderkey, 'a', NULL, 1, '5 minutes' || chr(10) || o_orderstatus, NULL, day FROM o
UNION ALL SELECT 'f' || file, meeting_id, 'attachment', o_orderkey || '-2', CASE WHEN l_linenumber > 1 THEN l_returnflag ELSE 'Attachment' END, NULL, NULL, 'P ' || o_orderkey, 'v', 3, (1 + nth)::INT, CASE WHEN l_linenumber < 4 THEN 'text of ' || file ELSE '' END, l_linestatus, CASE WHEN l_linenumber % 2 = 0 THEN strftime(l_shipdate, '%Y-%m-%d') ELSE day END FROM l JOIN o ON o_orderkey = l_orderkey
UNION ALL SELECT 'm' || o_orderkey, meeting_id, 'minutes', NULL, 'Minutes - ' || o_orderpriority, NULL, 'Minutes', NULL, CASE WHEN o_orderkey % 2 = 0 THEN 'page of ' || o_orderkey ELSE 'u' END, NULL, 10000, CASE WHEN o_orderkey % 2 = 0 THEN 'said ' || o_orderkey ELSE '' END, NULL, day FROM o WHERE o_orderkey % 3 = 0""")
def _union(s, d):
    return _document_rows(s, d).select("ref", "meeting_id", "kind", "item_id", "title", "item_label", "item_title", "presenter", "source_url", "pages", "sort_order", "text", "extract_method", F.date_format("first_seen", "yyyy-MM-dd").alias("seen"))


def _document_rows(s, d) -> DataFrame:
    n = _nested(s, d)
    files = c.spread(c.table(s, d, "lineitem")).select(F.concat_ws("-", *[F.col(k).cast("string") for k in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")], F.unix_date(F.to_date("l_shipdate")).cast("string"), F.col("l_extendedprice").cast("decimal(20,2)").cast("string")).alias("key"), "l_linestatus", "l_linenumber", "l_shipdate")
    texts = files.select("key", F.concat(F.lit("text of  "), "key", F.lit(" ")).alias("text")).unionByName(c.table(s, d, "orders").where("o_orderkey % 2 = 0").select(F.concat(F.lit("minutes-"), F.col("o_orderkey").cast("string")).alias("key"), F.concat(F.lit("said  "), F.col("o_orderkey").cast("string")).alias("text")))
    state = files.select(F.col("key").alias("file_id"), F.lit(3).alias("pages"), F.col("l_linestatus").alias("method"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_shipdate").cast("timestamp")).alias("first_seen"))
    scraped = c.table(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("meeting_id"), F.col("o_orderdate").cast("timestamp").alias("scraped_at"))
    return catalog.document_rows(n, texts, state, scraped)


query("meeting_rows", "SELECT o_orderkey::VARCHAR AS meeting_id, year(o_orderdate)::INT AS year, CASE WHEN o_orderkey % 2 = 0 THEN 'committee' ELSE 'board' END AS body, o_orderstatus = 'F' AS cancelled, 2 AS item_count, o_orderkey % 2 = 1 AS docs_indexed FROM orders")(
    lambda s, d: catalog.meeting_rows(_nested(s, d)).select("meeting_id", "year", "body", "cancelled", "item_count", "docs_indexed"))
query("mean_attachments", "SELECT (SELECT count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders))::DOUBLE / (SELECT count(*) FROM orders) AS per_meeting")(lambda s, d: catalog.mean_attachments(_nested(s, d)))


@query("dry_run_cost", """WITH a AS (SELECT count(*) AS meetings, count(*) FILTER (WHERE o_orderstatus = 'F') AS with_minutes, count(*) FILTER (WHERE o_orderkey % 5 = 0) AS already_scraped,
 count(*) FILTER (WHERE o_orderkey % 5 <> 0 AND strftime(o_orderdate, '%Y-%m-%d') >= '1999-01-01') AS new_with_documents FROM orders),
r AS (SELECT *, meetings + with_minutes + floor(new_with_documents * ((SELECT count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders))::DOUBLE / (SELECT count(*) FROM orders)) + 0.5)::BIGINT AS requests FROM a)
SELECT *, requests * 1200 / 1000.0::DOUBLE AS seconds, floor(requests * 1.2::DOUBLE / 3600)::BIGINT AS hours, floor(((requests * 1200 / 1000.0::DOUBLE) % 3600) / 60 + 0.5)::BIGINT AS minutes FROM r""")
def _cost(s, d):
    m = c.meetings(s, d).select(F.col("cancelled").alias("has_minutes"), (F.col("meeting_id") % 5 != 0).alias("is_new"), catalog.in_document_scope(F.col("date"), "1999-01-01").alias("in_scope"))
    return catalog.run_cost(m, catalog.mean_attachments(_nested(s, d)).scalar(), 1200).drop("per_meeting")


query("item_totals", "SELECT (SELECT 2 * count(*) FROM orders)::BIGINT AS items, (SELECT count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders))::BIGINT AS attachments")(lambda s, d: catalog.item_totals(_nested(s, d)))
query("last_months", f"WITH {MEETINGS} SELECT meeting_id, date FROM mt WHERE date >= '1996-02-29'")(lambda s, d: c.meetings(s, d).where(F.col("date") >= catalog.months_ago(F.lit("1998-08-31").cast("date"), 30)).select("meeting_id", "date"))


@query("scopes", f"WITH {MEETINGS} SELECT meeting_id, coalesce(date >= '1999-01-01', false) AS windowed, (date IS NULL OR date >= '1999-01-01') AS document_scope, date < '2000-09-02' AS is_settled FROM mt")
def _scopes(s, d):
    date = F.col("date")
    return c.meetings(s, d).select("meeting_id", catalog.in_window(date, "1999-01-01").alias("windowed"), catalog.in_document_scope(date, "1999-01-01").alias("document_scope"), catalog.settled(date, F.lit("2000-12-31").cast("date")).alias("is_settled"))


query("dedupe_first_wins", "SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1")(
    lambda s, d: catalog.first_of_each(c.table(s, d, "events").select("event_id", "user_id", "event_type"), "user_id", "event_id"))

# Collections -----------------------------------------------------------------------------------------------

#: Collections of at most a thousand documents of a source, so that a row is bounded.
REFS = "rf AS (SELECT source || ':' || (doc_id // 1000) AS source, list(CASE doc_id % 3 WHEN 0 THEN 'i' WHEN 1 THEN 'f' ELSE 'm' END || doc_id ORDER BY doc_id) FILTER (WHERE doc_id % 2 = 0) AS own, list(CASE doc_id % 5 WHEN 0 THEN 'x' ELSE CASE doc_id % 3 WHEN 0 THEN 'i' WHEN 1 THEN 'f' ELSE 'm' END END || doc_id ORDER BY doc_id) FILTER (WHERE doc_id % 3 < 2) AS incoming FROM documents GROUP BY ALL)"


def _refs(s, d) -> DataFrame:
    part = F.concat("source", F.lit(":"), F.floor(F.col("doc_id") / 1000).cast("string"))
    docs = c.table(s, d, "documents").select(part.alias("source"), "doc_id", F.element_at(F.array(*map(F.lit, "ifm")), (F.pmod("doc_id", F.lit(3)) + 1).cast("int")).alias("k"))
    listed = lambda ref, where: F.transform(F.array_sort(F.collect_list(F.when(where, F.struct("doc_id", ref.alias("r"))))), lambda x: x["r"])
    i = F.col("doc_id").cast("string")
    return docs.groupBy("source").agg(listed(F.concat("k", i), F.col("doc_id") % 2 == 0).alias("own"), listed(F.concat(F.when(F.col("doc_id") % 5 == 0, "x").otherwise(F.col("k")), i), F.col("doc_id") % 3 < 2).alias("incoming"))


def _joined(a: Column) -> Column:
    return F.array_join(a, " ")


@query("star_merge", f"WITH {REFS}, v AS (SELECT source, coalesce(own, []) AS own, list_filter(coalesce(incoming, []), lambda r: regexp_matches(r, '^[fim][0-9]+$')) AS inc FROM rf), m AS (SELECT source, own[1:500] AS own, list_concat(own[1:500], list_filter(inc[1:500], lambda r: NOT list_contains(own[1:500], r)))[1:500] AS b FROM v) SELECT source, array_to_string(b, ' ') AS stars, (len(b) - len(own))::INT AS added FROM m")
def _merge(s, d):
    return _refs(s, d).select("source", collections.merge(F.col("own"), F.col("incoming")).alias("m")).select("source", _joined(F.col("m.stars")).alias("stars"), "m.added")


query("star_clear", f"WITH {REFS} SELECT source, '[]' AS saved FROM rf")(lambda s, d: _refs(s, d).select("source", collections.save(collections.cleared(F.col("own"))).alias("saved")))


@query("star_toggle", f"WITH {REFS}, v AS (SELECT source, coalesce(own, [])[1:500] AS own, coalesce(incoming[1], '') AS r FROM rf) SELECT source, array_to_string(CASE WHEN NOT regexp_matches(r, '^[fim][0-9]+$') THEN own WHEN list_contains(own, r) THEN list_filter(own, lambda x: x <> r) WHEN len(own) < 500 THEN list_append(own, r) ELSE own END, ' ') AS stars, (regexp_matches(r, '^[fim][0-9]+$') AND NOT list_contains(own, r) AND len(own) < 500) AS starred FROM v")
def _toggle(s, d):
    t = collections.toggle(F.col("own"), F.try_element_at("incoming", F.lit(1)))
    return _refs(s, d).select("source", t.alias("t")).select("source", _joined(F.col("t.stars")).alias("stars"), "t.starred")


@query("share_encode", f"WITH {REFS} SELECT source, rtrim(translate(to_base64(encode(array_to_string(list_filter(coalesce(incoming, []), lambda r: regexp_matches(r, '^[fim][0-9]+$')), ' '))), '+/', '-_'), '=') AS shared FROM rf")
def _encode(s, d):
    return _refs(s, d).select("source", collections.encode(F.col("incoming")).alias("shared"))


@query("share_decode", f"WITH {REFS} SELECT source, array_to_string(list_filter(coalesce(incoming, []), lambda r: regexp_matches(r, '^[fim][0-9]+$'))[1:500], ' ') AS stars FROM rf")
def _decode(s, d):
    return _refs(s, d).select("source", _joined(collections.decode(collections.encode(F.col("incoming")))).alias("stars"))


@query("star_save_load", f"WITH {REFS} SELECT source, array_to_string(list_filter(coalesce(incoming, []), lambda r: regexp_matches(r, '^[fim][0-9]+$'))[1:500], ' ') AS stars FROM rf")
def _stored(s, d):
    return _refs(s, d).select("source", _joined(collections.load(collections.save(F.col("incoming")))).alias("stars"))


def _starred(s, d) -> DataFrame:
    return s.range(300).select(F.concat(F.element_at(F.array(*map(F.lit, "ifm")), (F.col("id") % 3 + 1).cast("int")), (F.col("id") * 7).cast("string")).alias("ref"))


STARRED = "st AS (SELECT CASE i % 3 WHEN 0 THEN 'i' WHEN 1 THEN 'f' ELSE 'm' END || (i * 7) AS ref FROM range(300) r(i))"
query("starred_lookup", f"WITH {DOCS}, {MEETINGS}, {STARRED} SELECT ref, date, kind FROM dc JOIN mt USING (meeting_id) WHERE ref IN (SELECT ref FROM st)")(lambda s, d: collections.documents_of(_starred(s, d), c.documents(s, d), c.meetings(s, d)).select("ref", "date", "kind"))
query("starred_missing", f"WITH {DOCS}, {STARRED} SELECT count(*) AS missing FROM st WHERE ref NOT IN (SELECT ref FROM dc)")(lambda s, d: collections.missing(_starred(s, d), c.documents(s, d)))
query("starred_export", f"WITH {DOCS}, {MEETINGS}, {STARRED} SELECT '- ' || title || ' (' || strftime(date::DATE, '%b %-d, %Y') || ') https://example.org/' || ref AS line FROM dc JOIN mt USING (meeting_id) WHERE ref IN (SELECT ref FROM st)")(
    lambda s, d: collections.documents_of(_starred(s, d), c.documents(s, d), c.meetings(s, d)).select(markup.list_line(F.col("title"), F.col("date"), F.concat(F.lit("https://example.org/"), "ref")).alias("line")))

# Ingest ----------------------------------------------------------------------------------------------------

query("state_latest", "SELECT user_id AS doc, ts, event_type AS method, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")(lambda s, d: ingest.latest(c.seen_log(s, d), "doc", "ts", "event_id").select("doc", "ts", "method", "event_id"))
query("first_seen", "SELECT user_id AS doc, min(ts) AS first_seen FROM events GROUP BY user_id")(lambda s, d: ingest.first_seen(c.seen_log(s, d), "doc", "ts"))
query("counts_by_method", "SELECT event_type AS method, count(*) AS n FROM events GROUP BY event_type")(lambda s, d: ingest.counts_by_method(c.seen_log(s, d)).select(F.explode("by_method").alias("method", "n")))


@query("change_detect", """WITH p AS (SELECT user_id, left(sha1(event_type), 16) AS hash FROM events WHERE event_id % 3 > 0 AND user_id % 7 > 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
n AS (SELECT user_id, left(sha1(event_type), 16) AS hash FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT n.user_id AS meeting_id, CASE WHEN p.user_id IS NULL THEN 'new' WHEN p.hash = n.hash AND n.user_id % 5 > 0 THEN 'unchanged' ELSE 'changed' END AS status FROM n LEFT JOIN p USING (user_id)""")
def _changes(s, d):
    log = c.seen_log(s, d)
    now = ingest.latest(log, "doc", "ts", "event_id").select(F.col("doc").alias("meeting_id"), text.short_hash(F.col("method")).alias("hash"), F.lit(True).alias("wants_docs"))
    prior = ingest.latest(log.where("event_id % 3 > 0 and doc % 7 > 0"), "doc", "ts", "event_id").select(F.col("doc").alias("meeting_id"), text.short_hash(F.col("method")).alias("hash"), (F.col("doc") % 5 > 0).alias("docs_complete"))
    return ingest.changes(now, prior).select("meeting_id", "status")


@query("carry_forward_merge", """WITH b AS (SELECT user_id, event_id FROM events WHERE user_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
p AS (SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1)
SELECT user_id AS doc, event_id FROM b UNION ALL SELECT user_id, event_id FROM p WHERE user_id NOT IN (SELECT user_id FROM b)""")
def _carry(s, d):
    log = c.seen_log(s, d)
    batch = ingest.latest(log.where("doc % 2 = 0"), "doc", "ts", "event_id").select("doc", "event_id")
    prior = log.groupBy("doc").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
    return ingest.carry_forward(batch, prior, "doc")


@query("keep_good_rows", """WITH n AS (SELECT user_id, max(value) AS value, max(ts) AS seen, CASE WHEN user_id % 4 = 0 THEN 'HTTP 500' END AS failed FROM events WHERE user_id % 3 > 0 GROUP BY user_id),
p AS (SELECT user_id, min(value) AS value, min(ts) AS seen, CASE WHEN user_id % 5 = 0 THEN 'too-large' END AS failed FROM events WHERE user_id % 7 > 0 GROUP BY user_id)
SELECT coalesce(n.user_id, p.user_id) AS doc, CASE WHEN n.user_id IS NULL OR (n.failed IS NOT NULL AND p.user_id IS NOT NULL AND p.failed IS NULL) THEN p.value ELSE n.value END AS value,
 CASE WHEN n.user_id IS NULL OR (n.failed IS NOT NULL AND p.user_id IS NOT NULL AND p.failed IS NULL) THEN p.failed ELSE n.failed END AS failed, least(n.seen, p.seen) AS first_seen FROM n FULL JOIN p ON n.user_id = p.user_id""")
def _good(s, d):
    log = c.seen_log(s, d)
    new = log.where("doc % 3 > 0").groupBy("doc").agg(F.max("value").alias("value"), F.max("ts").alias("first_seen")).withColumn("failed", F.when(F.col("doc") % 4 == 0, "HTTP 500"))
    old = log.where("doc % 7 > 0").groupBy("doc").agg(F.min("value").alias("value"), F.min("ts").alias("first_seen")).withColumn("failed", F.when(F.col("doc") % 5 == 0, "too-large"))
    return ingest.keep_good(new, old, "doc").select("doc", "value", "failed", "first_seen")


@query("state_migration", "SELECT event_id, (event_id % 7 <> 0 AND event_id % 3 = 0 AND event_type = 'click') AS ocr_pending, coalesce(CASE WHEN event_id % 2 = 0 THEN ts END, ts + INTERVAL 1 DAY) AS first_seen FROM events")
def _migrate(s, d):
    e = F.col("event_id")
    rows = c.seen_log(s, d).select("event_id", F.when(e % 7 == 0, "too-large").alias("failed"), (e % 3).alias("chars"), F.when(F.col("method") == "click", "none").otherwise("ocr").alias("method"), F.lit(None).cast("boolean").alias("ocr_pending"), F.when(e % 2 == 0, F.col("ts")).alias("first_seen"), (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("extracted_at"))
    return ingest.migrated(rows, 2).select("event_id", F.coalesce("ocr_pending", F.lit(False)).alias("ocr_pending"), "first_seen")


@query("extract_method_decision", """WITH x AS (SELECT l_linenumber <> 1 AS pdf, l_linenumber = 2 AS enc, (l_quantity::BIGINT % 3) AS pages, l_suppkey % 15 AS empty, l_partkey % 2 = 0 AS enabled, l_orderkey % 2 = 0 AS ready, l_partkey % 3 AS chars FROM lineitem),
y AS (SELECT *, pdf AND NOT enc AS plain, enabled AND empty > 0 AND ready AS read FROM x)
SELECT CASE WHEN NOT pdf THEN 'unsupported' WHEN enc THEN 'encrypted' WHEN read AND chars > 0 THEN CASE WHEN pages > 0 THEN 'text-layer+ocr' ELSE 'ocr' END WHEN pages > 0 THEN 'text-layer' ELSE 'none' END AS method,
 plain AND empty > 0 AND NOT read AS ocr_pending, plain AND read AND empty > 10 AS truncated, count(*) AS n FROM y GROUP BY ALL""")
def _decision(s, d):
    k = F.col
    x = ingest.extraction(k("l_linenumber") != 1, k("l_linenumber") == 2, k("l_quantity").cast("long") % 3, k("l_suppkey") % 15, k("l_partkey") % 2 == 0, k("l_orderkey") % 2 == 0, k("l_partkey") % 3)
    return c.table(s, d, "lineitem").select(x.alias("x")).groupBy("x.method", "x.ocr_pending", "x.truncated").agg(F.count("*").alias("n"))


@query("document_action", """SELECT CASE WHEN l_linenumber % 2 = 0 AND l_partkey % 5 > 0 AND l_suppkey % 3 > 0 AND NOT (l_orderkey % 2 = 0 AND l_partkey % 7 = 0) THEN 'reuse' WHEN l_orderkey % 2 = 0 AND l_partkey % 7 = 0 THEN 'retry' ELSE 'fetch' END AS action,
 (l_linenumber % 2 = 0 AND l_partkey % 5 > 0 AND l_suppkey % 3 > 0 AND NOT (l_orderkey % 2 = 0 AND l_partkey % 7 = 0)) AS minutes_reused, count(*) AS n FROM lineitem GROUP BY ALL""")
def _action(s, d):
    k = F.col
    prior, good, has, pending, ready = k("l_linenumber") % 2 == 0, k("l_partkey") % 5 > 0, k("l_suppkey") % 3 > 0, k("l_partkey") % 7 == 0, k("l_orderkey") % 2 == 0
    rows = c.table(s, d, "lineitem").select(ingest.document_action(F.when(~good, "too-large"), prior, has, pending, ready).alias("action"), ingest.reuse_minutes(prior, good, has, pending, ready).alias("minutes_reused"))
    return rows.groupBy("action", "minutes_reused").agg(F.count("*").alias("n"))


@query("runs_to_lines", r"""WITH r AS (SELECT l_orderkey AS doc, (l_linenumber % 2)::BIGINT AS page, l_quantity AS x, floor(l_discount * 100 * 0.3 * 2 + 0.5) / 2 AS line, 3.0 AS w, l_returnflag || l_linestatus AS str, row_number() OVER () AS i FROM lineitem),
g AS (SELECT *, lag(x + w) OVER (PARTITION BY doc, page, line ORDER BY x, str) AS e FROM r),
l AS (SELECT doc, page, line, string_agg(CASE WHEN x - e > 1.2 THEN ' ' ELSE '' END || str, '' ORDER BY x, str) AS t FROM g GROUP BY ALL)
SELECT doc, page, string_agg(t, chr(10) ORDER BY line DESC, t) AS text FROM l GROUP BY ALL""")
def _runs(s, d):
    runs = c.table(s, d, "lineitem").select(F.col("l_orderkey").alias("doc"), (F.col("l_linenumber") % 2).cast("long").alias("page"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 100 * 0.3).alias("y"), F.lit(3.0).alias("width"), F.concat("l_returnflag", "l_linestatus").alias("str"))
    return ingest.runs_to_lines(runs, "doc")


# Text ------------------------------------------------------------------------------------------------------

#: What makes clean texts messy, the same in both engines: (from, to).
MESS = ((" the ", "\u00a0the\u200b "), (". ", ".\u2026\n\n\n\n"), (" and ", " \u201cand\u201d\t"), (" que ", " \u2018que\u2019\u2014"), ("er ", "er-\n"), (" of ", "\nof "), (" de ", "\n-----\n de "), (" in ", "\n  Page 3 of 9 \nin "), (" la ", "\n=.=.=.\nla\n"))


def _messy() -> Column:
    t = F.col("text")
    for a, b in MESS:
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def _sql_mess() -> str:
    t = "text"
    for a, b in MESS:
        t = f"replace({t}, '{a}', '{b}')"
    return t


#: White space as a class of the other engine's regular expressions.
HB = text.BLANK


def _sql_normalize(t: str) -> str:
    plain = text._PLAIN.replace("'", "''")
    t = f"translate({t}, '{text._TYPED}{text._DROPPED}', '{plain}')"
    t = f"regexp_replace(replace({t}, '\u2026', '...'), '[{HB}]+', ' ', 'g')"
    t = f"regexp_replace(regexp_replace({t}, ' ?\\n ?', chr(10), 'g'), '\\n\\n\\n+', chr(10) || chr(10), 'g')"
    return f"regexp_replace({t}, '^[{HB}\\n]+|[{HB}\\n]+$', '', 'g')"


def _sql_furniture(t: str) -> str:
    s = f"regexp_replace(l, '^[{HB}\\n]+|[{HB}\\n]+$', '', 'g')"
    return f"array_to_string(list_filter(string_split({t}, chr(10)), lambda l: {s} = '' OR NOT (regexp_matches({s}, '(?i)^page[{HB}]+[0-9]+([{HB}]+of[{HB}]+[0-9]+)?$') OR regexp_matches({s}, '^[-_=.*\u2022{HB}]{{4,}}$'))), chr(10))"


def _sql_rejoin(t: str) -> str:
    return f"regexp_replace(regexp_replace({t}, '([a-z,;])-\\n([a-z])', '\\1\\2', 'g'), '([a-z,;])\\n([a-z])', '\\1 \\2', 'g')"


def _text_query(name: str, make, sql: str):
    query(name, f"WITH m AS (SELECT doc_id, {_sql_mess()} AS t FROM documents) SELECT doc_id, {sql} AS out FROM m")(lambda s, d: c.spread(c.table(s, d, "documents")).select("doc_id", make(_messy()).alias("out")))


_text_query("normalize_text", text.normalize, _sql_normalize("t"))
_text_query("dehyphenate", text.rejoin_lines, _sql_rejoin("t"))
_text_query("strip_page_noise", text.drop_page_furniture, _sql_furniture("t"))
_text_query("clean_text", text.clean_extracted, _sql_normalize(_sql_rejoin(_sql_furniture(_sql_normalize("t")))))
_text_query("truncate_text", lambda t: text.truncate(t, 200), "CASE WHEN length(t) > 200 THEN left(t, 200) || chr(10) || '[truncated]' ELSE t END")
_text_query("content_hash", text.short_hash, "left(sha1(t), 16)")
query("xml_escape", rf"SELECT page_id, regexp_replace({XML.format('html')}, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g') AS out FROM pages")(lambda s, d: c.table(s, d, "pages").select("page_id", markup.escape_xml(F.col("html")).alias("out")))
query("html_escape", "SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS out FROM pages")(lambda s, d: c.table(s, d, "pages").select("page_id", markup.escape_html(F.col("html")).alias("out")))


def _sql_block_text() -> str:
    t = "html"
    for tag in ("script", "style", "nav", "header", "footer"):
        t = f"regexp_replace({t}, '(?is)<{tag}\\b[^>]*>.*?</{tag}[ \\t\\r\\n]*>', '', 'g')"
    t = f"regexp_replace(regexp_replace({t}, '(?i)<br[^>]*>', chr(10), 'g'), '(?i)</(p|div|li|tr|h[1-6])[^>]*>', chr(10), 'g')"
    t = f"regexp_replace({t}, '(?s)<!--.*?-->|<[^>]*>', '', 'g')"
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        t = f"replace({t}, '{entity}', '{plain}')"
    return _sql_normalize(t)


query("html_to_text", f"SELECT page_id, {_sql_block_text()} AS out FROM pages")(lambda s, d: c.spread(c.table(s, d, "pages")).select("page_id", text.normalize(text.block_text(text.drop_chrome(F.col("html")))).alias("out")))


@query("parse_title", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 > 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS date, CASE WHEN o_orderkey % 4 > 0 THEN '7:05 PM' END AS time, CASE WHEN o_orderkey % 4 > 0 THEN o_orderpriority ELSE 'Special gathering ' || o_orderpriority END AS name FROM orders")
def _titles(s, d):
    made = F.when(F.col("o_orderkey") % 4 > 0, F.concat(F.date_format("o_orderdate", "MMMM d,  yyyy"), F.lit(" at 7:05  PM – "), "o_orderpriority")).otherwise(F.concat(F.lit("Special gathering "), "o_orderpriority"))
    return c.spread(c.table(s, d, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")).select("o_orderkey", text.title_parts(made).alias("p")).select("o_orderkey", "p.date", "p.time", "p.name")


@query("item_label", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '5.A.1.' WHEN 1 THEN '' ELSE '12.' END AS label, CASE WHEN p_partkey % 3 = 2 THEN p_name || ' (note)' ELSE p_name END AS title, CASE p_partkey % 3 WHEN 0 THEN '30 minutes, Roll Call Vote' ELSE '' END AS qualifier FROM part")
def _labels(s, d):
    k = F.col("p_partkey") % 3
    made = F.when(k == 0, F.concat(F.lit("5.A.1. "), "p_name", F.lit(" (30 minutes, Roll Call Vote)"))).when(k == 1, F.col("p_name")).otherwise(F.concat(F.lit("12. "), "p_name", F.lit(" (note)")))
    return c.table(s, d, "part").select("p_partkey", text.item_heading(made).alias("h")).select("p_partkey", "h.label", "h.title", "h.qualifier")


@query("cancelled_titles", "SELECT o_orderkey, o_orderkey % 3 = 0 AS cancelled, o_orderpriority AS title FROM orders")
def _cancelled(s, d):
    made = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("CANCELED \n"), "o_orderpriority", F.lit("\n cancelled"))).otherwise(F.col("o_orderpriority"))
    return c.table(s, d, "orders").select("o_orderkey", text.cancelled_title(made).alias("t")).select("o_orderkey", "t.cancelled", "t.title")


AT = Addresses("https://portal.example.org", "77")


@query("addresses", "SELECT o_orderkey, 'https://portal.example.org/Public/Agenda/77?meeting=' || o_orderkey AS agenda, 'https://portal.example.org/Documents/DownloadPDF/' || o_orderkey || '?org=77' AS pdf, o_orderkey::VARCHAR AS meeting, 'https://portal.example.org/x/' || o_orderkey AS resolved FROM orders")
def _addresses(s, d):
    k = F.col("o_orderkey")
    made = AT.column("agenda", k)
    return c.table(s, d, "orders").select("o_orderkey", made.alias("agenda"), AT.column("pdf", k).alias("pdf"), text.meeting_id_of(made).alias("meeting"), text.resolve_url(F.concat(F.lit("/x/"), k.cast("string")), f"{AT.base}/Public/y").alias("resolved"))


@query("markup_attributes", "SELECT p_partkey, floor(p_size / 4.0 + 0.5)::INT AS depth, CASE WHEN p_partkey % 2 = 0 THEN p_partkey::VARCHAR ELSE '0' END AS parent, CASE WHEN p_partkey % 2 = 0 THEN 'pdf' ELSE 'unknown' END AS kind FROM part")
def _attributes(s, d):
    even = F.col("p_partkey") % 2 == 0
    style = F.concat(F.lit("color:red; padding-left: "), (F.col("p_size") / 4.0).cast("string"), F.lit("em"))
    css = F.when(even, F.concat(F.lit("row agenda-item-children-of-"), F.col("p_partkey").cast("string")))
    return c.table(s, d, "part").select("p_partkey", text.depth_of(style).alias("depth"), text.parent_of(css).alias("parent"), text.file_kind_of(F.when(even, "/img/filetypes/PDF.png")).alias("kind"))


@query("display_formats", """SELECT o_orderkey, strftime(o_orderdate, '%b %-d, %Y') AS shown_date, CASE WHEN o_orderkey * 977 >= 1000000 THEN format('{:.1f} MB', floor(o_orderkey * 977 / 100000.0 + 0.5) / 10) ELSE floor(o_orderkey * 977 / 1000.0 + 0.5)::BIGINT || ' KB' END AS shown_bytes,
 concat_ws(' · ', 'Meeting', CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END, CASE WHEN o_orderkey % 3 = 0 THEN 'item ' || o_orderstatus END) AS context, 'a#' || o_orderstatus || '%20x' AS link, CASE WHEN o_orderkey % 2 = 0 THEN 'Minutes' ELSE 'Attachment' END AS label,
 concat_ws(' › ', 'Meeting', concat_ws(' ', o_orderstatus, CASE WHEN o_orderkey % 2 = 0 THEN 'Other' END)) AS crumb FROM orders""")
def _formats(s, d):
    k, date = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    even = k % 2 == 0
    return c.table(s, d, "orders").select(
        "o_orderkey", markup.show_date(date).alias("shown_date"), markup.show_bytes(k * 977).alias("shown_bytes"),
        markup.context_line(F.lit("Meeting"), F.when(even, date).otherwise(""), F.when(k % 3 == 0, F.col("o_orderstatus"))).alias("context"), markup.deep_link(F.lit("a"), F.concat("o_orderstatus", F.lit(" x"))).alias("link"),
        markup.kind_label(F.when(even, "minutes").otherwise("attachment")).alias("label"), markup.breadcrumb(F.lit("Meeting"), F.col("o_orderstatus"), F.when(even, "Other").otherwise("Same"), F.lit("Same")).alias("crumb"))


@query("distinct_links", "SELECT o_orderkey, 'a#1 b c#' || o_orderkey AS links FROM orders")
def _links(s, d):
    urls = F.array(F.lit("a#1"), F.lit("b"), F.lit("a#2"), F.lit("b#9"), F.concat(F.lit("c#"), F.col("o_orderkey").cast("string")), F.lit("a"))
    return c.table(s, d, "orders").select("o_orderkey", F.array_join(markup.distinct_links(urls), " ").alias("links"))


@query("tidy_terms", "SELECT doc_id, regexp_replace(text || '?!.', '[^\\p{L}\\p{N}*]+$', '') AS term FROM documents")
def _terms(s, d):
    return c.table(s, d, "documents").select("doc_id", text.tidy_term(F.concat("text", F.lit("?!."))).alias("term"))


@query("page_chars", "SELECT doc_id, length(regexp_replace(text, '[' || chr(9) || chr(11) || chr(12) || chr(13) || ' ' || chr(10) || ']', '', 'g'))::INT AS chars, CASE WHEN doc_id % 50 < 40 THEN '1 3' ELSE '3' END AS empty FROM documents")
def _chars(s, d):
    pages = F.array((F.col("doc_id") % 50).cast("int"), F.lit(40), F.lit(0))
    return c.table(s, d, "documents").select("doc_id", ingest.page_chars(F.col("text")).alias("chars"), F.array_join(F.transform(ingest.empty_pages(pages), lambda p: p.cast("string")), " ").alias("empty"))


@query("pdf_sniff", "SELECT doc_id, doc_id % 3 < 2 AS pdf FROM documents")
def _sniff(s, d):
    k = F.col("doc_id") % 3
    head = F.when(k == 0, F.concat(F.lit("%PDF-1.7 "), "text")).otherwise(F.col("text")).cast("binary")
    return c.table(s, d, "documents").select("doc_id", ingest.looks_pdf(head, F.when(k == 1, "application/pdf; x=y")).alias("pdf"))


@query("texts_joined", "SELECT doc_id, left(concat_ws(chr(10) || chr(10), nullif(title, ''), CASE WHEN doc_id % 2 = 0 THEN 'scanned' END), 50) AS out FROM (SELECT doc_id, split_part(text, chr(10), 1) AS title FROM documents)")
def _texts(s, d):
    return c.documents(s, d).select("doc_id", text.joined_texts(50, F.col("title"), F.when(F.col("doc_id") % 2 == 0, "scanned").otherwise("")).alias("out"))
