"""The Atom feed of newly indexed documents. Entries are a column; the driver puts at most a feed's worth together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfold.functions.markup import context_line, escape_xml, feed_id


def iso(value: Column, now: Column) -> Column:
    """An ISO instant in UTC; now for null or what is no time."""
    return F.date_format(F.coalesce(F.try_to_timestamp(value.cast("string")), now), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def entries(documents: DataFrame, org: str, now: Column) -> DataFrame:
    """documents with entry, the XML of each."""
    summary = context_line(F.col("meeting_name"), F.col("date"), F.col("item_label"))
    lines = [
        F.lit("  <entry>"),
        F.concat(F.lit("    <title>"), escape_xml(F.col("title")), F.lit("</title>")),
        F.concat(F.lit('    <link href="'), escape_xml(F.col("source_url")), F.lit('" />')),
        F.concat(F.lit("    <id>"), escape_xml(feed_id(org, F.col("ref"))), F.lit("</id>")),
        F.concat(F.lit("    <updated>"), iso(F.col("first_seen"), now), F.lit("</updated>")),
        F.concat(F.lit('    <category term="'), escape_xml(F.col("kind")), F.lit('" />')),
        F.concat(F.lit("    <summary>"), escape_xml(summary), F.lit("</summary>")),
        F.lit("  </entry>"),
    ]
    return documents.withColumn("entry", F.concat_ws("\n", *lines))


def _xml(text: str) -> str:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = text.replace(plain, entity)
    return "".join(c for c in text if c >= " " or c in "\t\n\r")


def atom(documents: DataFrame, org: str, title: str, subtitle: str = "", site_url: str = "", now: Column | None = None) -> str:
    """The feed of documents, which are limited and in order; updated is the newest first_seen among them."""
    now = F.current_timestamp() if now is None else now
    rows = entries(documents, org, now).select("entry", iso(F.col("first_seen"), now).alias("at")).collect()
    base = site_url.rstrip("/")
    updated = max((r["at"] for r in rows), default=None) or documents.sparkSession.range(1).select(iso(F.lit(None), now)).first()[0]
    head = ['<?xml version="1.0" encoding="utf-8"?>', '<feed xmlns="http://www.w3.org/2005/Atom">', f"  <title>{_xml(title)}</title>"]
    head += [f"  <subtitle>{_xml(subtitle)}</subtitle>"] * bool(subtitle)
    head += [f'  <link href="{_xml(base)}/" />', f'  <link rel="self" href="{_xml(base)}/feed.xml" />'] * bool(base)
    head += [f"  <id>{_xml(base or f'urn:documents:{org}')}</id>", f"  <updated>{updated}</updated>"]
    return "\n".join([*head, *[r.entry for r in rows], "</feed>", ""])
