"""The positional inverted index: one row for each occurrence of a token, with what a search asks of its document.

postings(term, doc_id, field, pos, n_tokens, meeting_id, kind, date, year) is range-partitioned and sorted by (term,
doc_id), so a term's rows lie together in few row groups (a scan for a term skips the rest by min/max), and a term that is
in every document spreads over many partitions instead of making one large group. A document's length, meeting, kind and
date stand beside its postings, where runs of equal values pack to almost nothing, so that matching, ranking, filtering
and ordering need no other table. doc_len(doc_id, n_tokens) and the two corpus figures describe the corpus. Texts are not
stored again: snippets join them after the limit.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfold.functions.tokens import tokens
from tarnfold.plans.query_lang import FIELDS

#: What is known of a document beside its texts; null where documents come without it.
FACTS = {"meeting_id": "string", "kind": "string", "date": "string", "year": "int"}
#: What each posting carries.
CARRIED = ("n_tokens", *FACTS)


@dataclass
class Index:
    postings: DataFrame
    doc_len: DataFrame
    n_docs: int
    avg_len: float

    def write(self, path: str) -> None:
        """Sorted by term with small row groups of distinct term ranges; the whole path is replaced."""
        spread = self.postings.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id", "field", "pos")
        spread.write.mode("overwrite").option("parquet.block.size", 16 << 20).parquet(f"{path}/postings")
        self.doc_len.write.mode("overwrite").parquet(f"{path}/doc_len")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Index:
        return cls.of(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/doc_len"))

    @classmethod
    def of(cls, postings: DataFrame, doc_len: DataFrame) -> Index:
        n, avg = doc_len.agg(F.count("*"), F.avg("n_tokens")).first()
        return cls(postings, doc_len, n, avg or 0.0)

    def cached(self) -> Index:
        return Index(self.postings.persist(), self.doc_len.persist(), self.n_docs, self.avg_len)


def tokenised(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id, fields: the token arrays of the four fields, and what is carried)."""
    facts = [(F.col(name) if name in docs.columns else F.lit(None).cast(kind)).alias(name) for name, kind in FACTS.items()]
    made = docs.select(F.col(key).alias("doc_id"), F.array(*[tokens(F.col(f)) for f in FIELDS]).alias("fields"), *facts)
    return made.select("doc_id", "fields", F.aggregate("fields", F.lit(0).cast("long"), lambda n, ts: n + F.size(ts)).alias("n_tokens"), *FACTS)


def occurrences(docs: DataFrame) -> DataFrame:
    """(term, doc_id, field, pos and what is carried) of tokenised documents; field is its number in FIELDS."""
    each = docs.select("doc_id", *CARRIED, F.posexplode("fields").alias("field", "ts"))
    return each.select("doc_id", *CARRIED, F.col("field").cast("tinyint").alias("field"), F.posexplode("ts").alias("pos", "term")).select("term", "doc_id", "field", "pos", *CARRIED)


def lengths(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens) of tokenised documents."""
    return docs.select("doc_id", "n_tokens")


def build(docs: DataFrame, key: str = "doc_id", path: str | None = None) -> Index:
    """The index of docs, which has key and the four fields, and may have FACTS (see search.with_facts).

    With a path the index is written there: texts are tokenised once, into a table from which the postings
    are ranged and sorted. Without one nothing runs but the two corpus figures.
    """
    made = tokenised(docs, key)
    if path is None:
        return Index.of(occurrences(made), lengths(made))
    made.write.mode("overwrite").parquet(f"{path}/tokens")
    made = docs.sparkSession.read.schema(made.schema).parquet(f"{path}/tokens")
    Index(occurrences(made), lengths(made), 0, 0.0).write(path)
    return Index.read(docs.sparkSession, path)


def document_frequencies(index: Index) -> DataFrame:
    """(term, df, cf): in how many documents a term is, and how often in all."""
    per_doc = index.postings.groupBy("term", "doc_id").agg(F.count("*").alias("n"))
    return per_doc.groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("cf"))
