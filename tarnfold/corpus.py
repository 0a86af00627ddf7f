"""The star-schema tables as a searchable corpus: documents, meetings, attachments, a log of what was seen when."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfold.operators.index import Index, build
from tarnfold.operators.search import Library, with_facts
from tarnfold.plans.query_lang import FIELDS
from tarnfold.scratch import own_dir
from tarnfold.shipping import ship

KINDS = ("agenda_item", "attachment", "minutes")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files make fewer tasks than there are cores, which only small inputs do."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with the four fields: the first line as title, source and lang as item title and presenter."""
    d = spread(table(spark, sf_dir, "documents"))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.pmod("doc_id", F.lit(3)) + 1).cast("int"))
    return d.select(
        "doc_id", F.col("doc_id").alias("meeting_id"), kind.alias("kind"), F.concat(F.element_at(F.array(*map(F.lit, "ifm")), (F.pmod("doc_id", F.lit(3)) + 1).cast("int")), F.col("doc_id").cast("string")).alias("ref"),
        F.substring_index("text", "\n", 1).alias("title"), F.col("source").alias("item_title"), F.col("lang").alias("presenter"), "text", F.col("doc_id").alias("sort_order"))


def meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("meeting_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("meeting_type"),
        F.concat(F.lit("Meeting "), F.col("o_orderkey").cast("string")).alias("meeting_name"), (F.col("o_orderstatus") == "F").alias("cancelled"), (F.col("o_orderkey") % 2 == 0).alias("docs_indexed"))


def attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as a meeting's attachments."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("meeting_id"), F.lit("attachment").alias("kind"))


def seen_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log of documents: key, when, how."""
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("doc"), "ts", F.col("event_type").alias("method"), "value")


_built: dict[tuple[str, str], Index] = {}


def write_index(spark: SparkSession, sf_dir: str, path: str) -> Index:
    """Builds the corpus's index at path; it is the session's index of sf_dir from now on."""
    facts = with_facts(documents(spark, sf_dir).select("doc_id", "meeting_id", "kind", *FIELDS), meetings(spark, sf_dir))
    made = _built[spark.sparkContext.applicationId, sf_dir] = build(facts, path=path)
    return made


def index(spark: SparkSession, sf_dir: str) -> Index:
    """The corpus's index, written once a session to the shared folder."""
    return _built.get((spark.sparkContext.applicationId, sf_dir)) or write_index(spark, sf_dir, own_dir(spark, "index"))


def library(spark: SparkSession, sf_dir: str) -> Library:
    return Library(documents(spark, sf_dir), meetings(spark, sf_dir), index(spark, sf_dir))
