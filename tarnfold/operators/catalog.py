"""Everything round search: documents from nested meetings, browse lists, coverage, statistics, feeds, plans of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfold.functions.markup import bar
from tarnfold.functions.text import body_of, nonempty, normalize

FEED_SIZE, BROWSE, MINUTES_ORDER, DEFAULT_ATTACHMENTS = 100, 400, 10_000, 16.0
DOCUMENT = ("ref", "meeting_id", "kind", "item_id", "item_label", "item_title", "title", "presenter", "source_url", "pages", "extract_method", "first_seen", "sort_order", "text")


def meeting_rows(meetings: DataFrame) -> DataFrame:
    """The flat table of meetings from the nested records."""
    return meetings.select(
        F.col("meetingId").alias("meeting_id"), "date", F.substring("date", 1, 4).cast("int").alias("year"), "time", "title", "name", F.col("meetingType").alias("meeting_type"),
        F.coalesce("body", F.lit("board")).alias("body"), F.coalesce("cancelled", F.lit(False)).alias("cancelled"), "location", "notes",
        F.col("agendaUrl").alias("agenda_url"), F.col("minutesUrl").alias("minutes_url"), F.col("packetUrl").alias("packet_url"),
        F.coalesce(F.size("items"), F.lit(0)).alias("item_count"), F.coalesce("documentsIndexed", F.lit(False)).alias("docs_indexed"))


def document_rows(meetings: DataFrame, texts: DataFrame, state: DataFrame, scraped: DataFrame) -> DataFrame:
    """One row for each searchable unit: agenda items, attachments and minutes of the nested records.

    texts (key, text), state (file_id, pages, method, first_seen) and scraped (meeting_id, scraped_at) are
    looked up; what is not there is empty or null. Orders come from positions in the arrays.
    """
    m = meetings.select(F.col("meetingId").alias("meeting_id"), F.col("title").alias("m_title"), F.col("agendaUrl").alias("agenda_url"), F.col("minutesUrl").alias("minutes_url"), "items", "minutes")
    m = m.join(scraped, "meeting_id", "left")
    # An item comes after the items before it and all of their attachments.
    before = F.transform("items", lambda it, i: F.aggregate(F.slice("items", 1, i), F.lit(0), lambda n, p: n + 1 + F.coalesce(F.size(p["attachments"]), F.lit(0))))
    items = m.select("meeting_id", "agenda_url", "scraped_at", F.explode(F.arrays_zip(F.col("items").alias("it"), before.alias("at"))).alias("x")).select("meeting_id", "agenda_url", "scraped_at", "x.it", "x.at")
    shared = {"item_id": F.col("it.itemId"), "item_label": nonempty(F.col("it.label")), "item_title": nonempty(F.col("it.title")), "presenter": nonempty(F.col("it.presenter"))}
    null = lambda t: F.lit(None).cast(t)
    agenda = items.select(
        F.concat(F.lit("i"), "it.itemId").alias("ref"), "meeting_id", F.lit("agenda_item").alias("kind"), *[c.alias(k) for k, c in shared.items()],
        F.coalesce(nonempty(F.col("it.title")), F.lit("Agenda item")).alias("title"), F.col("agenda_url").alias("source_url"), null("int").alias("pages"), null("string").alias("extract_method"),
        F.col("scraped_at").alias("first_seen"), F.col("at").alias("sort_order"), body_of(F.col("it.qualifier"), F.col("it.description")).alias("text"))
    # Attachments and minutes look up their texts and states together; each text is cleaned once, before it is copied anywhere.
    clean = texts.select(F.col("key").alias("t_key"), normalize(F.col("text")).alias("t_text"))
    known = state.select(F.col("file_id").alias("s_key"), "pages", F.col("method").alias("extract_method"), F.col("first_seen").alias("s_seen"))
    atts = items.select("meeting_id", "scraped_at", "at", *[c.alias(k) for k, c in shared.items()], F.posexplode("it.attachments").alias("nth", "a")).select(
        F.concat(F.lit("f"), "a.fileId").alias("ref"), "meeting_id", F.lit("attachment").alias("kind"), *shared, F.coalesce(nonempty(F.col("a.name")), F.lit("Attachment")).alias("title"), F.col("a.viewerUrl").alias("source_url"),
        "scraped_at", (F.col("at") + 1 + F.col("nth")).alias("sort_order"), F.when(F.col("a.indexed"), F.col("a.fileId")).alias("text_key"), F.col("a.fileId").alias("state_key"))
    mins = m.where("minutes is not null").select(
        F.concat(F.lit("m"), "meeting_id").alias("ref"), "meeting_id", F.lit("minutes").alias("kind"), null("string").alias("item_id"), null("string").alias("item_label"), F.lit("Minutes").alias("item_title"), null("string").alias("presenter"),
        F.concat(F.lit("Minutes - "), "m_title").alias("title"), F.coalesce(nonempty(F.col("minutes.url")), F.col("minutes_url")).alias("source_url"),
        "scraped_at", F.lit(MINUTES_ORDER).alias("sort_order"), F.col("minutes.textKey").alias("text_key"), F.col("minutes.fileId").alias("state_key"))
    found = atts.unionByName(mins).join(clean, F.col("text_key") == F.col("t_key"), "left").join(known, F.col("state_key") == F.col("s_key"), "left")
    files = found.withColumns({"first_seen": F.coalesce("s_seen", "scraped_at"), "text": F.coalesce("t_text", F.lit(""))})
    return agenda.select(*DOCUMENT).unionByName(files.select(*DOCUMENT))


def unique_refs(documents: DataFrame) -> DataFrame:
    """documents; raises with the refs that occur twice (bookmarks are kept by ref)."""
    twice = [r.ref for r in documents.groupBy("ref").count().where("count > 1").orderBy("ref").limit(20).collect()]
    if twice:
        raise ValueError(f"refs that occur more than once: {', '.join(map(str, twice))}")
    return documents


def first_of_each(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key in source order."""
    least = F.min_by(F.struct(*df.columns), F.col(order)).alias("row")
    return df.groupBy(key).agg(least).select("row.*")


def browse(meetings: DataFrame, documents: DataFrame, limit: int = BROWSE) -> DataFrame:
    """The newest dated meetings with how many attachments each has, 0 included."""
    newest = meetings.where("date is not null").orderBy(F.desc("date"), "meeting_id").limit(limit)
    counts = documents.where("kind = 'attachment'").join(newest.select("meeting_id"), "meeting_id", "left_semi").groupBy("meeting_id").agg(F.count("*").alias("attachments"))
    return newest.join(counts, "meeting_id", "left").withColumn("attachments", F.coalesce("attachments", F.lit(0))).orderBy(F.desc("date"), "meeting_id")


def meeting_documents(meetings: DataFrame, documents: DataFrame, meeting_id) -> DataFrame:
    """One meeting's documents in agenda order."""
    return documents.where(F.col("meeting_id") == meeting_id).join(meetings.where(F.col("meeting_id") == meeting_id), "meeting_id").orderBy("sort_order", "ref")


def coverage_by_year(meetings: DataFrame) -> DataFrame:
    dated = meetings.where("year is not null")
    return dated.groupBy("year").agg(F.count_distinct("meeting_id").alias("meetings"), F.sum(F.when(F.col("docs_indexed"), 1).otherwise(0)).alias("with_documents")).orderBy(F.desc("year"))


def facet_years(meetings: DataFrame) -> DataFrame:
    return meetings.where("year is not null").select("year").distinct().orderBy(F.desc("year"))


def totals(meetings: DataFrame) -> DataFrame:
    """One row: meetings, indexed, cancelled, and the range of dates."""
    return meetings.agg(F.count("*").alias("meetings"), F.count_if("docs_indexed").alias("indexed"), F.count_if("cancelled").alias("cancelled"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def stats_by_kind(documents: DataFrame) -> DataFrame:
    return documents.groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.count_if(F.length("text") > 0).alias("with_text")).orderBy(F.desc("n"), "kind")


def meetings_per_year(meetings: DataFrame, limit: int = 20) -> DataFrame:
    """The last years, each with a bar of at most 60 marks."""
    return meetings.where("year is not null").groupBy("year").agg(F.count("*").alias("n")).orderBy(F.desc("year")).limit(limit).withColumn("bar", bar(F.col("n")))


def corpus_counters(documents: DataFrame) -> DataFrame:
    """One row: documents, characters, those with text, those read by OCR, by one pass."""
    return documents.agg(F.count("*").alias("documents"), F.sum(F.length("text")).alias("chars"), F.count_if(F.length("text") > 0).alias("with_text"), F.count_if(F.col("extract_method").contains("ocr")).alias("read_by_ocr"))


def meta(values: dict[str, object], documents: DataFrame, meetings: DataFrame) -> DataFrame:
    """(key, value): what is known of a build, with its counters."""
    spark = documents.sparkSession
    c, t = corpus_counters(documents).first(), totals(meetings).first()
    all_values = values | {"meeting_count": t.meetings, "document_count": c.documents, "documents_with_text": c.with_text, "documents_ocr": c.read_by_ocr, "meetings_with_documents": t.indexed, "schema_version": "2"}
    return spark.createDataFrame([(k, "" if v is None else str(v)) for k, v in all_values.items()], "key string, value string")


def newest_documents(documents: DataFrame, meetings: DataFrame, limit: int = FEED_SIZE) -> DataFrame:
    """Attachments and minutes by the day they were first seen, then by meeting date: a batch counts as one day."""
    d = documents.where(F.col("first_seen").isNotNull() & F.col("kind").isin("attachment", "minutes"))
    return d.join(meetings, "meeting_id").orderBy(F.to_date("first_seen").desc(), F.col("date").desc_nulls_last(), "sort_order", "ref").limit(limit)


def in_document_scope(date: Column, since: str | None) -> Column:
    """Undated meetings are in scope; a null bound takes all."""
    return F.lit(True) if since is None else date.isNull() | (date >= since)


def in_window(date: Column, since: str | None) -> Column:
    """Undated meetings are out as soon as there is a bound."""
    return F.lit(True) if since is None else date.isNotNull() & (date >= since)


def settled(date: Column, today: Column, days: int = 120) -> Column:
    return date < F.date_format(F.date_sub(today, days), "yyyy-MM-dd")


def months_ago(today: Column, months: int) -> Column:
    """The bound of a window of the last months, as a date's text; a day that a month lacks is its last."""
    return F.date_format(F.add_months(today, -months), "yyyy-MM-dd")


def item_totals(meetings: DataFrame) -> DataFrame:
    """One row: how many items and attachments nested records have in all."""
    n = F.aggregate("items", F.lit(0).cast("long"), lambda s, it: s + F.coalesce(F.size(it["attachments"]), F.lit(0)))
    return meetings.agg(F.coalesce(F.sum(F.coalesce(F.size("items"), F.lit(0))), F.lit(0)).alias("items"), F.coalesce(F.sum(n), F.lit(0)).alias("attachments"))


def report(documents: DataFrame, meetings: DataFrame) -> str:
    """Statistics of a build as lines of text: totals, kinds, years."""
    t = totals(meetings).first()
    lines = [f"Meetings    {t.meetings:,} ({t.indexed:,} with documents, {t.cancelled:,} cancelled), {t.first_date or '-'} to {t.last_date or '-'}"]
    lines += [f"{r.kind:<12}{r.n:>10,}  {r.with_text:>10,} with text  {r.chars or 0:>14,} characters" for r in stats_by_kind(documents).collect()]
    lines += [f"{r.year}  {r.n:>6,}  {r.bar}" for r in meetings_per_year(meetings).collect()]
    return "\n".join(lines) + "\n"


def mean_attachments(meetings: DataFrame, default: float = DEFAULT_ATTACHMENTS) -> DataFrame:
    """One row: the mean number of attachments of meetings that have items; default if there are none."""
    n = F.aggregate("items", F.lit(0), lambda s, it: s + F.coalesce(F.size(it["attachments"]), F.lit(0)))
    return meetings.where(F.size("items") > 0).agg(F.coalesce(F.avg(n), F.lit(default)).alias("per_meeting"))


def run_cost(meetings: DataFrame, per_meeting: Column, delay_ms: int) -> DataFrame:
    """One row: what a run would request and how long that takes. meetings: has_minutes, is_new, in_scope."""
    a = meetings.agg(F.count("*").alias("meetings"), F.count_if("has_minutes").alias("with_minutes"), F.count_if(~F.col("is_new")).alias("already_scraped"), F.count_if(F.col("is_new") & F.col("in_scope")).alias("new_with_documents"), F.first(per_meeting).alias("per_meeting"))
    a = a.withColumn("requests", (F.col("meetings") + F.col("with_minutes") + F.floor(F.col("new_with_documents") * F.col("per_meeting") + 0.5)).cast("long"))
    a = a.withColumn("seconds", F.col("requests") * delay_ms / 1000.0)
    return a.withColumns({"hours": F.floor(F.col("seconds") / 3600).cast("long"), "minutes": F.floor((F.col("seconds") % 3600) / 60 + 0.5).cast("long")})
