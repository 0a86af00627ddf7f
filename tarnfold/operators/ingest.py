"""Incremental ingest: what changed, what is reused, and merges that never lose what was known.

State is two tables, meetings and documents, keyed by id; a run joins them with what it has seen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATE_VERSION = 4


def migrated(documents: DataFrame, version: int) -> DataFrame:
    """State rows of documents brought from an older version to STATE_VERSION; an unknown version starts anew.

    From 2: scanned documents of which nothing was read are flagged to be read again. From 3: first_seen,
    where missing, is taken from extracted_at once.
    """
    if version not in (2, 3, STATE_VERSION):
        return documents.limit(0)
    if version == 2:
        unread = F.col("failed").isNull() & (F.coalesce("chars", F.lit(0)) == 0) & F.coalesce(F.col("method") == "none", F.lit(False))
        documents = documents.withColumn("ocr_pending", F.when(unread, True).otherwise(F.col("ocr_pending")))
    if version <= 3:
        documents = documents.withColumn("first_seen", F.coalesce("first_seen", "extracted_at"))
    return documents


def latest(log: DataFrame, key: str, at: str, *tie: str) -> DataFrame:
    """The last row of each key by time; partial maxima go before the shuffle, so long logs of one key are no hot spot."""
    return log.groupBy(key).agg(F.max_by(F.struct(*log.columns), F.struct(at, *tie)).alias("row")).select("row.*")


def first_seen(log: DataFrame, key: str, at: str) -> DataFrame:
    return log.groupBy(key).agg(F.min(at).alias("first_seen"))


def counts_by_method(log: DataFrame, method: str = "method") -> DataFrame:
    """One row: a map from extraction method to how many documents."""
    pairs = log.groupBy(method).agg(F.count("*").alias("n"))
    return pairs.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(method), F.col("n"))))).alias("by_method"))


def changes(current: DataFrame, prior: DataFrame, full: bool = False) -> DataFrame:
    """current (meeting_id, hash, wants_docs) with status: new, changed or unchanged.

    Unchanged is what has the prior hash and was complete in the sense now wanted; a full run reuses nothing.
    """
    p = prior.select(F.col("meeting_id").alias("p_id"), F.col("hash").alias("p_hash"), "docs_complete")
    same = F.lit(not full) & (F.col("hash") == F.col("p_hash")) & (F.col("docs_complete") == F.col("wants_docs"))
    status = F.when(F.col("p_id").isNull(), "new").when(F.coalesce(same, F.lit(False)), "unchanged").otherwise("changed")
    return current.join(p, F.col("meeting_id") == F.col("p_id"), "left").withColumn("status", status).drop("p_id", "p_hash", "docs_complete")


def retry_ocr(ocr_ready: Column, pending: Column) -> Column:
    return ocr_ready & F.coalesce(pending, F.lit(False))


def document_action(prior_failed: Column, has_prior: Column, has_text: Column, pending: Column, ocr_ready: Column, full: bool = False) -> Column:
    """reuse, retry or fetch for each document."""
    retry = retry_ocr(ocr_ready, pending)
    known = F.lit(not full) & has_prior & prior_failed.isNull() & F.coalesce(has_text, F.lit(False))
    return F.when(known & ~retry, "reuse").when(retry, "retry").otherwise("fetch")


def reuse_minutes(unchanged: Column, is_settled: Column, has_text: Column, pending: Column, ocr_ready: Column) -> Column:
    """Minutes of an unchanged meeting past the settling time, read before and not to be read again."""
    return F.coalesce(unchanged & is_settled & has_text, F.lit(False)) & ~retry_ocr(ocr_ready, pending)


def keep_good(new: DataFrame, prior: DataFrame, key: str, failed: str = "failed") -> DataFrame:
    """Prior and new rows merged by key: a failure never takes the place of a row that was good, and first_seen stays."""
    cols = [c for c in new.columns if c != key]
    n = new.withColumn("is_new", F.lit(True)).alias("n")
    p = prior.withColumn("is_old", F.lit(True)).alias("p")
    both = n.join(p, key, "full_outer")
    take_new = F.col("is_new").isNotNull() & (F.col(f"n.{failed}").isNull() | F.col("is_old").isNull() | F.col(f"p.{failed}").isNotNull())
    value = lambda c: F.least(f"n.{c}", f"p.{c}") if c == "first_seen" else F.when(take_new, F.col(f"n.{c}")).otherwise(F.col(f"p.{c}"))
    return both.select(key, *[value(c).alias(c) for c in cols])


def carry_forward(batch: DataFrame, prior: DataFrame, key: str) -> DataFrame:
    """The batch, and prior rows of which the batch has nothing."""
    return batch.unionByName(prior.join(batch.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def extraction(is_pdf: Column, encrypted: Column, pages_with_text: Column, empty_pages: Column, ocr_enabled: Column, ocr_ready: Column, ocr_chars: Column, budget: int = 10) -> Column:
    """struct(method, ocr_pending, note, truncated): how a document's text came about.

    ocr_chars: what reading scanned pages gave; a document is labelled by what it has, so reading that gave nothing
    leaves the label of the text layer.
    """
    layer = F.when(pages_with_text > 0, "text-layer").otherwise("none")
    wanted = ocr_enabled & (empty_pages > 0)
    read = wanted & ocr_ready
    got = read & (ocr_chars > 0)
    method = F.when(~is_pdf, "unsupported").when(encrypted, "encrypted").when(got & (pages_with_text > 0), "text-layer+ocr").when(got, "ocr").otherwise(layer)
    plain = is_pdf & ~encrypted
    note = (
        F.when(~is_pdf, "not a PDF").when(encrypted, "password protected")
        .when(read & (empty_pages > budget), f"scanned pages beyond the first {budget} not read")
        .when(wanted & ~ocr_ready, "scanned pages not read: no OCR tools").when(~read & (empty_pages > 0), "scanned pages not read: OCR disabled").otherwise("")
    )
    return F.struct(method.alias("method"), (plain & (empty_pages > 0) & ~read).alias("ocr_pending"), note.alias("note"), (plain & read & (empty_pages > budget)).alias("truncated"))


def empty_pages(chars: Column, least: int = 40) -> Column:
    """Numbers, from 1, of the pages with fewer than `least` characters."""
    return F.filter(F.transform(chars, lambda c, i: F.when(c < least, i + 1)), lambda p: p.isNotNull())


def page_chars(text: Column) -> Column:
    from tarnfold.functions.text import SPACE

    return F.length(F.regexp_replace(text, f"[{SPACE}]", ""))


def looks_pdf(head: Column, content_type: Column) -> Column:
    """By the first bytes or the declared type."""
    magic = F.decode(F.substring(head, 1, 5), "ISO-8859-1") == "%PDF-"
    return F.coalesce(magic, F.lit(False)) | F.coalesce(content_type.contains("application/pdf"), F.lit(False))


def runs_to_lines(runs: DataFrame, *doc: str, gap: float = 1.2) -> DataFrame:
    """(doc.., page, text): positioned runs (page, x, y, width, str) put together as lines, from top to bottom.

    Runs on one baseline (to half a point) form a line from left to right; a gap wider than `gap` is a blank,
    unless one stands there already. The grouping key has the line in it, so pages stay small groups.
    """
    line = (F.floor(F.col("y") * 2 + 0.5) / 2).alias("line")
    words = runs.where("str <> ''").groupBy(*doc, "page", line).agg(F.array_sort(F.collect_list(F.struct("x", "width", "str"))).alias("runs"))
    step = lambda acc, r: F.struct(
        F.concat(acc["text"], F.when((acc["end"].isNotNull()) & (r["x"] - acc["end"] > gap) & ~acc["text"].rlike(r"\s\z") & ~r["str"].rlike(r"^\s"), " ").otherwise(""), r["str"]).alias("text"),
        (r["x"] + F.coalesce(r["width"], F.lit(0.0))).cast("double").alias("end"))
    text = F.aggregate("runs", F.struct(F.lit("").alias("text"), F.lit(None).cast("double").alias("end")), step)["text"]
    lines = words.select(*doc, "page", "line", F.btrim(text).alias("text")).where("text <> ''")
    return lines.groupBy(*doc, "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("line")).alias("down"), "text"))), lambda x: x["text"]), "\n").alias("text"))
