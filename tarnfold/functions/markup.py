"""Escaping, highlighting and the small formats of pages, feeds and links: Column -> Column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnfold.functions.text import nonempty

#: Sentinels round a match: they occur in no text, so text can be escaped before they become tags.
OPEN, CLOSE = "\x01", "\x02"

KIND_LABELS = {"agenda_item": "Agenda item", "attachment": "Attachment", "minutes": "Minutes"}


def _replaced(c: Column, pairs) -> Column:
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, F.coalesce(c, F.lit("")))


_HTML = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"))


def escape_html(c: Column) -> Column:
    return _replaced(c, _HTML)


def escape_xml(c: Column) -> Column:
    """Five entities, then the control characters that XML has no place for go."""
    return F.regexp_replace(_replaced(c, (*_HTML, ("'", "&apos;"))), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def highlight(c: Column) -> Column:
    """A snippet as HTML: escaped first, then the sentinels become mark tags."""
    return _replaced(escape_html(c), ((OPEN, "<mark>"), (CLOSE, "</mark>")))


def has_match(c: Column) -> Column:
    return F.coalesce(c.contains(OPEN), F.lit(False))


def show_date(c: Column) -> Column:
    """"Aug 3, 2026" for an ISO date, "Undated" for none or a wrong one."""
    return F.coalesce(F.date_format(F.try_to_date(c, "yyyy-MM-dd"), "MMM d, yyyy"), F.lit("Undated"))


def show_bytes(c: Column) -> Column:
    """Megabytes with one decimal from 10^6 on, else whole kilobytes; halves up."""
    mb = F.format_string("%.1f MB", F.floor(c / 100_000.0 + 0.5).cast("double") / 10)
    return F.when(c >= 1_000_000, mb).otherwise(F.concat(F.floor(c / 1000.0 + 0.5).cast("long").cast("string"), F.lit(" KB")))


def kind_label(c: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for p in KIND_LABELS.items() for x in p])[c], c)


def context_line(meeting_name: Column, date: Column, item_label: Column) -> Column:
    """"Business Meeting · 2026-08-03 · item 5.A.", empty parts left out."""
    item = F.concat(F.lit("item "), nonempty(item_label))
    return F.concat_ws(" · ", nonempty(meeting_name), nonempty(date), item)


def breadcrumb(meeting_name: Column, item_label: Column, item_title: Column, title: Column) -> Column:
    """Where a document belongs; an item title that repeats the document's own is left out."""
    item = F.concat_ws(" ", nonempty(item_label), F.when(item_title != title, nonempty(item_title)))
    return F.concat_ws(" › ", nonempty(meeting_name), nonempty(item))


def feed_id(org: str, ref: Column) -> Column:
    return F.concat(F.lit(f"urn:documents:{org}:"), ref)


def deep_link(agenda_url: Column, item_id: Column) -> Column:
    """The agenda at an item; without an item the agenda, without an agenda null."""
    return F.when(nonempty(item_id).isNull(), agenda_url).otherwise(F.concat(agenda_url, F.lit("#"), F.replace(F.url_encode(item_id), F.lit("+"), F.lit("%20"))))


def distinct_links(urls: Column) -> Column:
    """Links in order, the first of those that differ only behind the #."""
    page = lambda u: F.substring_index(u, "#", 1)
    pages = F.transform(urls, page)
    return F.filter(urls, lambda u, i: F.array_position(pages, page(u)) == i + 1)


def list_line(title: Column, date: Column, url: Column) -> Column:
    """A line of a plain list: "- title (date) url"."""
    return F.concat(F.lit("- "), F.coalesce(title, F.lit("")), F.lit(" ("), show_date(date), F.lit(") "), F.coalesce(url, F.lit("")))


def bar(n: Column, most: int = 60, mark: str = "#") -> Column:
    return F.repeat(F.lit(mark), F.least(n, F.lit(most)).cast("int"))
