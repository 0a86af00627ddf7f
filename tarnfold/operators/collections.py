"""Collections of starred documents: ordered unique lists of refs, of at most MOST.

They are array columns (one collection a row); what is stored is JSON, what is shared base64url. A ref that
does not have the right form, or JSON that is none, counts as not there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = 500
REF = r"^[fim][0-9]+\z"


def clean(refs: Column) -> Column:
    """Valid refs, each once, in order, the first MOST; null: none."""
    valid = F.filter(F.coalesce(refs, F.array().cast("array<string>")), lambda r: r.rlike(REF))
    return F.slice(F.array_distinct(valid), 1, MOST)


def load(json: Column) -> Column:
    """The collection out of stored JSON."""
    return clean(F.from_json(json, "array<string>", {"mode": "PERMISSIVE"}))


def save(refs: Column) -> Column:
    return F.to_json(clean(refs))


def cleared(refs: Column) -> Column:
    """No refs, whatever there was."""
    return F.slice(clean(refs), 1, 0)


def toggle(refs: Column, ref: Column) -> Column:
    """struct(stars, starred, full): ref taken out if it is in, else put at the end, unless the collection is full."""
    stars = clean(refs)
    inside, valid, room = F.array_contains(stars, ref), F.coalesce(ref.rlike(REF), F.lit(False)), F.size(stars) < MOST
    return F.struct(
        F.when(valid & inside, F.array_remove(stars, ref)).when(valid & room, F.array_append(stars, ref)).otherwise(stars).alias("stars"),
        F.coalesce(valid & ~inside & room, F.lit(False)).alias("starred"),
        F.coalesce(valid & ~inside & ~room, F.lit(False)).alias("full"),
    )


def merge(refs: Column, incoming: Column) -> Column:
    """struct(stars, added): incoming refs behind one's own; added counts those that are kept and new."""
    own = clean(refs)
    both = F.slice(F.array_union(own, clean(incoming)), 1, MOST)
    return F.struct(both.alias("stars"), (F.size(both) - F.size(own)).alias("added"))


def encode(refs: Column) -> Column:
    """For an address: base64url without padding, empty for no refs."""
    text = F.array_join(F.filter(refs, lambda r: r.rlike(REF)), " ")
    packed = F.replace(F.replace(F.base64(text.cast("binary")), F.lit("\r\n"), F.lit("")), F.lit("\n"), F.lit(""))
    return F.rtrim(F.translate(packed, "+/", "-_"), F.lit("="))


def decode(shared: Column) -> Column:
    """The refs of an address; anything malformed gives none."""
    plain = F.translate(F.coalesce(shared, F.lit("")), "-_", "+/")
    padded = F.concat(plain, F.repeat(F.lit("="), F.pmod(-F.length(plain), F.lit(4))))
    ok = padded.rlike(r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?\z")
    text = F.try_to_binary(F.when(ok, padded), F.lit("base64"))
    return clean(F.split(F.decode(text, "utf-8"), " "))


def documents_of(refs: DataFrame, documents: DataFrame, meetings: DataFrame) -> DataFrame:
    """The starred documents that there are, newest meeting first. refs: one column ref; all of them count (a collection's cap is `clean`'s)."""
    picked = documents.join(refs.select("ref").distinct(), "ref", "left_semi")
    return picked.join(meetings, "meeting_id").orderBy(F.col("date").desc_nulls_last(), "sort_order", "ref")


def missing(refs: DataFrame, documents: DataFrame) -> DataFrame:
    """One row: how many starred refs are not in the index."""
    return refs.select("ref").distinct().join(documents, "ref", "left_anti").agg(F.count("*").alias("missing"))
