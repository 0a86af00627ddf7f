"""Line dedup: lines found in many documents stay only in the last of them.

Normalised lines become 128-bit hashes, once for each document; their documents are counted with
partial sums, so a line of a third of all rows is no hot spot; what is over the threshold forms the
drop list with, for each hash, the one document that keeps it. The drop list meets the lines twice: its
most common hashes by broadcast (those of more than HOT_SHARE of what is counted, so at most as many as
the inverse of that), so that no task gets the rows of a hot line, and the others by a shuffle on the hash. Each document then gets back only the positions to drop, by which
its lines are put together again from the runs in between. Texts themselves are shuffled once.

Key of a line: the line without the blanks [\\x20\\x09-\\x0D] at its ends, A-Z in lower case.

Defined results: a null or empty text is one empty line. Documents are told apart by doc_id (repeated
rows of one id count once and are treated alike; a null id counts as a document before all others). An
empty table gives an empty result. Extra columns of any name pass through unchanged: names that are added
give way to them (an underscore more).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfold.llm.common import BLANKS, ascii_lower, fresh, own_columns, text_of, written

MIN_CHARS = 20
MIN_DOCS = 3
#: Hashes of more than this share of all counted (hash, document) pairs are met by broadcast; at least HOT_LEAST documents.
HOT_SHARE, HOT_LEAST = 0.0001, 1000


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """(ld_id, ld_text, at, h1, h2) for each line that is long enough."""
    lines = F.transform(F.split(text_of(), "\n", -1), lambda line, at: F.struct(at.alias("at"), line_key(line).alias("k")))
    long = F.filter(lines, lambda x: F.char_length(x["k"]) >= min_chars)
    hashed = F.transform(long, lambda x: F.struct(x["at"].alias("at"), F.xxhash64(x["k"]).alias("h1"), F.xxhash64(F.lit("line"), x["k"]).alias("h2")))
    return docs.select(F.col("doc_id").alias("ld_id"), F.xxhash64(text_of()).alias("ld_text"), F.explode(hashed).alias("x")).select("ld_id", "ld_text", "x.*")


def dropped_positions(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(ld_id, ld_text, ld_drop): the ascending positions of the lines that each text loses; only texts that lose some."""
    lines = written(_hashes(docs, min_chars), "lines")
    per_doc = lines.select("ld_id", "h1", "h2").distinct()
    listed = per_doc.groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.max("ld_id").alias("stays")).where(F.col("docs") >= min_docs)
    listed = written(listed, "listed")
    hot = F.col("docs") > max(HOT_LEAST, HOT_SHARE * (listed.agg(F.sum("docs")).first()[0] or 0))
    common = F.broadcast(listed.where(hot).select("h1", "h2", "stays"))  # at most 1 / HOT_SHARE rows
    rest = lines.join(F.broadcast(common.select("h1", "h2")), ["h1", "h2"], "left_anti").join(listed.where(~hot).select("h1", "h2", "stays"), ["h1", "h2"])
    met = lines.join(common, ["h1", "h2"]).unionByName(rest)
    gone = met.where(~F.col("ld_id").eqNullSafe(F.col("stays")))
    return gone.groupBy("ld_id", "ld_text").agg(F.array_sort(F.collect_set("at")).alias("ld_drop"))


def without(lines: Column, drop: Column) -> Column:
    """lines without the positions in drop (ascending): the runs between them, in linear time."""
    edges = F.concat(F.array(F.lit(-1)), drop, F.array(F.size(lines)))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(drop)), lambda i: F.slice(lines, edges[i] + 2, edges[i + 1] - edges[i] - 1)))


def drop_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with three columns behind its own: ld_lines and ld_dropped (counts) and ld_kept, the text that stays."""
    key, split, gone_id, gone_text, drop, *added = fresh(docs, "ld_text", "ld_split", "ld_id2", "ld_text2", "ld_drop", "ld_lines", "ld_dropped", "ld_kept")
    gone = dropped_positions(docs, min_chars, min_docs).withColumnsRenamed({"ld_id": gone_id, "ld_text": gone_text, "ld_drop": drop})
    d = docs.withColumn(key, F.xxhash64(text_of()))
    met = d.join(gone, F.col("doc_id").eqNullSafe(F.col(gone_id)) & (F.col(key) == F.col(gone_text)), "left")
    # The join's projection stays apart from the next, so that the split isn't made again at each use.
    lines = met.withColumn(split, F.split(text_of(), "\n", -1))
    kept = F.when(F.col(drop).isNull(), text_of()).otherwise(F.array_join(without(F.col(split), F.col(drop)), "\n"))
    dropped = F.when(F.col(drop).isNull(), F.lit(0)).otherwise(F.size(drop)).cast("long")
    return lines.select(*own_columns(docs), *[c.alias(name) for c, name in zip((F.size(split).cast("long"), dropped, kept), added)])


def without_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs, columns as they are: text without the lines that go, and n_chars, if there is one, of the new text; no row goes."""
    out = drop_lines(docs, min_chars, min_docs)
    dropped, kept = out.columns[-2:]
    changes = {"text": F.col(kept)} | ({"n_chars": F.length(kept).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.select(*[F.when(F.col(dropped) > 0, changes[name]).otherwise(c).alias(name) if name in changes else c for name, c in zip(docs.columns, own_columns(docs))])


def op8_line_dedup(docs: DataFrame) -> DataFrame:
    return drop_lines(docs.select("doc_id", "text")).select("doc_id", F.col("ld_lines").alias("n_lines"), F.col("ld_dropped").alias("n_dropped"), F.sha2(F.col("ld_kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
l AS (SELECT r, doc_id, i, string_split(t, chr(10))[i] AS line FROM (SELECT *, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS i FROM d)),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM l),
c AS (SELECT k, max(doc_id) AS stays FROM k WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.*, c.k IS NOT NULL AND k.doc_id IS DISTINCT FROM c.stays AS gone FROM k LEFT JOIN c ON k.k = c.k)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY r
"""
