"""Mixing sources to target weights: rates per source, then floor(rate) copies and one hash-seeded Bernoulli copy.

One aggregate gives each source's words. Targets share the mix by weight, no source above `most`
times its size; what a capped source cannot take is shared again by weight (each round is one
aggregate of two scalars over the small table of sources). A document is then emitted floor(rate)
times, and once more if a hash of its id falls below the fraction. Nothing needs a document's
neighbours, so hot sources cost no more than others: partial sums go before the one small shuffle, and
the rates reach the documents by broadcast up to BROADCAST_SOURCES rows, beyond that by a join in
which both sides carry a salt.

Defined results: a null text has size 0; a null source is a source of its own, after all others. A
source without words has target 0 and rate 0. Repeated rows are documents of their own and, having
the same id, take the same decision; a null id hashes as the empty text. No rows: an empty mix. Extra
columns of any name pass through unchanged.

What a source gives differs from its target by the noise of the Bernoulli copies alone: with f the fraction of
its rate and s_i the sizes of its documents, by a standard deviation of sqrt(f (1 - f) sum(s_i^2)), so of at most
target / (2 sqrt(n)) for n documents of like size and a rate of 1: about 7 % for 50 documents, 0.5 % for 10,000.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfold.llm.common import fresh, n_words, own_columns, text_of, written

WEIGHTS = (3.0, 1.0, 2.0)  # of the sources in order, repeating
SHARE = 1.5  # of all words
MOST = 2.0  # times a source's own words
BROADCAST_SOURCES = 50_000  # rows of some 100 bytes
SALTS = 32


def source_sizes(docs: DataFrame) -> DataFrame:
    """(source, source_size, place): place counts the sources from 0, by code point, null last.

    Places come from counts of the parts of a range partitioning, so that no task sees all sources.
    """
    sizes = written(docs.groupBy("source").agg(F.sum(n_words(text_of())).alias("source_size")), "sources")
    n = sizes.count()
    if n <= BROADCAST_SOURCES:  # the size of one small task
        return sizes.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1)
    parts = written(sizes.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources")
    within = parts.withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1)
    counts = parts.groupBy("part").count()
    before = counts.select("part", (F.sum("count").over(Window.partitionBy(F.lit(0)).orderBy("part")) - F.col("count")).alias("before"))
    return within.join(F.broadcast(before), "part").select("source", "source_size", (F.col("at") + F.col("before")).alias("place"))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target, rate)."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("place"), F.lit(len(weights))) + 1).cast("int"))
    s = written(sizes.select("source", "source_size", weight.alias("w")), "weights")
    cap = F.col("source_size") * most
    total = (s.agg(F.sum("source_size")).first()[0] or 0) * share
    level = None  # words for one unit of weight; each round caps more sources, so it only rises
    while True:
        over = F.lit(False) if level is None else F.col("w") * level >= cap
        capped, left = s.agg(F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("w")))).first()
        if not left:
            break
        new = (total - (capped or 0.0)) / left
        if level is not None and new <= level:
            break
        level = new
    target = cap if level is None else F.least(F.col("w") * level, cap)
    return s.select("source", "source_size", target.alias("target"), F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("rate"))


def uniform(doc_id: str | Column, seed: int = 0) -> Column:
    """A number in [0, 1) from the id alone: 48 bits of its md5."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(c.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") / float(1 << 48)


ADDED = ("mix_source_size", "mix_target", "mix_copies")


def with_rates(docs: DataFrame, seed: int = 0, **how) -> DataFrame:
    """docs with three columns behind its own: mix_source_size, mix_target and mix_copies."""
    source, rate, salt, own_salt, *added = fresh(docs, "mix_source", "mix_rate", "mix_salt", "mix_salt2", *ADDED)
    size, target, copies = added
    t = written(targets(source_sizes(docs), **how), "rates").toDF(source, size, target, rate)
    on = F.col("source").eqNullSafe(F.col(source))
    if t.count() <= BROADCAST_SOURCES:
        joined = docs.join(F.broadcast(t), on, "left")
    else:
        salted = t.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = docs.withColumn(own_salt, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, on & (F.col(salt) == F.col(own_salt)), "left")
    whole = F.floor(rate)
    n = whole + (uniform("doc_id", seed) < F.col(rate) - whole).cast("long")
    return joined.select(*own_columns(docs), size, target, n.alias(copies))


def mix(docs: DataFrame, seed: int = 0, **how) -> DataFrame:
    """The mix itself: each row of docs as often as its source's rate says, with docs' columns."""
    rated = with_rates(docs, seed, **how)
    copies = rated.columns[-1]
    (copy,) = fresh(rated, "mix_copy")
    return rated.where(F.col(copies) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*own_columns(docs))


def op3_source_mixing(docs: DataFrame) -> DataFrame:
    d = docs.select("doc_id", "source", "text")
    size = n_words(text_of())
    return with_rates(d).select("doc_id", size.alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_copies") * size).alias("taken"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS z FROM d GROUP BY source),
p AS (SELECT *, CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w FROM s),
q AS (SELECT *, row_number() OVER (ORDER BY 2.0 * z / w, source) AS i FROM p),
l AS (SELECT *, (1.5::DOUBLE * (SELECT sum(z) FROM s) - coalesce(sum(2.0::DOUBLE * z) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM q),
v AS (SELECT lvl FROM l WHERE lvl * w < 2.0::DOUBLE * z ORDER BY i LIMIT 1),
t AS (SELECT source, z, CASE WHEN (SELECT lvl FROM v) IS NULL THEN 2.0::DOUBLE * z ELSE least(w * (SELECT lvl FROM v), 2.0::DOUBLE * z) END AS target FROM q),
r AS (SELECT *, CASE WHEN z > 0 THEN target / z ELSE 0.0::DOUBLE END AS rate FROM t),
u AS (SELECT d.doc_id, d.size, r.z AS source_size, r.target, r.rate, ('0x' || substr(md5('0:' || coalesce(d.doc_id::VARCHAR, '')), 1, 12))::BIGINT::DOUBLE / 281474976710656.0::DOUBLE AS h
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, (floor(rate)::BIGINT + (h < rate - floor(rate))::BIGINT) * size AS taken FROM u
"""
