"""A search from the box to the page: plan, match, relax, filter, order, limit, and only then texts and snippets.

All but the texts comes from the index: `search` aggregates the postings of its terms once, keeps that for as long as it
takes to count, to decide whether to relax and to rank, and reads documents and meetings for the rows of the page alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfold.operators.index import Index
from tarnfold.operators.match import condition, document_counts, ranked, weighted, with_rank
from tarnfold.operators.snippet import with_snippets
from tarnfold.plans.query_lang import PAGE, RELAX_BELOW, Plan, Request, can_relax, compile_query, explain

#: A page's columns before snippets: from documents, then from meetings.
DOCUMENT_COLUMNS = ("doc_id", "ref", "kind", "item_id", "item_label", "item_title", "title", "presenter", "source_url", "extract_method")
MEETING_COLUMNS = ("date", "meeting_name", "meeting_title", "meeting_type", "agenda_url", "minutes_url")


@dataclass
class Library:
    """What is searched: documents (doc_id, meeting_id, kind, the four fields ..), meetings (meeting_id, date, year ..), and the index of with_facts(documents, meetings)."""

    documents: DataFrame
    meetings: DataFrame
    index: Index


def with_facts(documents: DataFrame, meetings: DataFrame) -> DataFrame:
    """documents with their meeting's date and year, for the index; a document without a known meeting has a null meeting_id and no results."""
    m = meetings.select(F.col("meeting_id").alias("fact_id"), F.col("date").alias("fact_date"), F.col("year").alias("fact_year"))
    kept = [c for c in documents.columns if c not in ("meeting_id", "date", "year")]
    joined = documents.join(m, F.col("meeting_id") == F.col("fact_id"), "left")
    return joined.select(*kept, F.col("fact_id").alias("meeting_id"), F.col("fact_date").alias("date"), F.col("fact_year").alias("year"))


def filters(year: int | None = None, kind: str | None = None) -> Column:
    wanted = F.lit(True)
    if year is not None:
        wanted &= F.col("year") == year
    if kind is not None:
        wanted &= F.col("kind") == kind
    return wanted


def _placed(found: DataFrame, request: Request) -> DataFrame:
    return found.where(F.col("meeting_id").isNotNull() & filters(request.year, request.kind))


RESULT = ("doc_id", "meeting_id", "kind", "date", "year", "rank")


def order_of(sort: str) -> list[Column]:
    """Columns to order by; ranks are rounded, and equal ones take the document's order, so pages don't overlap."""
    by_rank = [F.col("rank"), F.col("doc_id")]
    return {"newest": [F.col("date").desc_nulls_last(), *by_rank], "oldest": [F.col("date").asc_nulls_first(), *by_rank]}.get(sort, by_rank)


def results(library: Library, plan: Plan, request: Request = Request()) -> DataFrame:
    """All results: (doc_id, meeting_id, kind, date, year, rank), not ordered."""
    rows = ranked(library.index, plan).withColumn("rank", F.round("rank", 9))
    # A filter on what documents are grouped by would go below the aggregation, which then could not serve the document
    # frequencies as well, and the postings would be read twice; ranks are never above 0, so this only keeps it above.
    held = {c: F.when(F.col("rank") <= 0, F.col(c)) for c in ("meeting_id", "kind", "year")}
    return _placed(rows.withColumns(held), request).select(*RESULT)


def count_matches(library: Library, plan: Plan, request: Request = Request()) -> DataFrame:
    """One row: n, with the filters, without a limit."""
    return _placed(weighted(library.index, plan).where(condition(plan)), request).agg(F.count("*").alias("n"))


def _chosen(rows: DataFrame, request: Request) -> tuple[Plan, int, list[int]]:
    """The plan, how many it finds, and the document counts of its terms, from one aggregate of rows (`weighted`)."""
    strict, relaxed = compile_query(request.q), compile_query(request.q, relaxed=True)
    there = F.col("meeting_id").isNotNull() & filters(request.year, request.kind)
    n, n_relaxed, df = rows.agg(F.count_if(condition(strict) & there), F.count_if(condition(relaxed) & there), document_counts(strict)).first()
    counts = list(df)[: len(strict.used)]
    return (relaxed, n_relaxed, counts) if n < RELAX_BELOW and can_relax(request.q) else (strict, n, counts)


def choose_plan(library: Library, request: Request) -> tuple[Plan, int]:
    """The strict plan and how many it finds, or the relaxed one where that is fewer than RELAX_BELOW."""
    plan = compile_query(request.q)
    return _chosen(weighted(library.index, plan), request)[:2] if plan.expr else (plan, 0)


def page(library: Library, plan: Plan, request: Request = Request(), offset: int = 0, limit: int = PAGE) -> DataFrame:
    """(doc_id, meeting_id, kind, date, year, rank) of one page, in order."""
    return results(library, plan, request).orderBy(*order_of(request.sort)).offset(offset).limit(limit)


def _wide(library: Library, top: DataFrame, plan: Plan, request: Request, ids: dict[str, list] | None = None) -> DataFrame:
    """top with its documents' and meetings' columns and snippets. ids: the values of doc_id and meeting_id, for the scans to skip by."""
    d = library.documents.select(*[c for c in DOCUMENT_COLUMNS if c in library.documents.columns], "text")
    m = library.meetings.select("meeting_id", *[c for c in MEETING_COLUMNS if c in library.meetings.columns])
    if ids is not None:
        d, m = d.where(F.col("doc_id").isin(ids["doc_id"])), m.where(F.col("meeting_id").isin(ids["meeting_id"]))
    wide = F.broadcast(top.select("doc_id", "meeting_id", "rank")).join(d, "doc_id").join(m, "meeting_id")
    return with_snippets(wide, list(plan.used)).drop("text").orderBy(*order_of(request.sort))


def full_page(library: Library, plan: Plan, request: Request = Request(), offset: int = 0, limit: int = PAGE) -> DataFrame:
    """A page with its documents' and meetings' columns and snippets, made for the page's rows alone."""
    return _wide(library, page(library, plan, request, offset, limit), plan, request)


def search(library: Library, request: Request, offset: int = 0, plan: Plan | None = None) -> tuple[DataFrame | None, dict]:
    """A page and what is to be told of it: total, whether there is more, the explanation and the plan.

    Further pages pass the first page's plan, so a relaxed search stays that search.
    """
    given = plan
    plan = given or compile_query(request.q)
    if not plan.expr:
        return None, {"total": 0, "more": False, "plan": plan, **explain(plan, 0)}
    rows = weighted(library.index, plan).persist()
    try:
        if given is None:
            plan, n, counts = _chosen(rows, request)
        else:
            n, df = rows.agg(F.count_if(condition(plan) & F.col("meeting_id").isNotNull() & filters(request.year, request.kind)), document_counts(plan)).first()
            counts = list(df)[: len(plan.used)]
        found = _placed(with_rank(rows.where(condition(plan)), library.index, plan, counts).withColumn("rank", F.round("rank", 9)), request).select(*RESULT)
        ordered = found.orderBy(*order_of(request.sort)).offset(offset).limit(PAGE)
        top = ordered.collect()  # a page
    finally:
        rows.unpersist()
    told = {"total": n, "more": offset + PAGE < n, "plan": plan, **explain(plan, n)}
    local = library.documents.sparkSession.createDataFrame(top, ordered.schema)
    return _wide(library, local, plan, request, {k: [r[k] for r in top] for k in ("doc_id", "meeting_id")}), told
