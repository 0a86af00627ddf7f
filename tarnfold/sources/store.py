"""Tables, text blobs, binaries and state on disk: readers that take what was never there for empty, writers that replace at once."""

from __future__ import annotations

import shutil

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnfold.operators.catalog import unique_refs
from tarnfold.operators.ingest import STATE_VERSION, migrated
from tarnfold.shipping import ship

ATTACHMENT = "struct<fileId:string,name:string,kind:string,viewerUrl:string,pdfUrl:string,indexed:boolean>"
ITEM = f"struct<itemId:string,parentId:string,depth:int,label:string,title:string,qualifier:string,presenter:string,description:string,attachments:array<{ATTACHMENT}>,order:int>"
MEETINGS = f"meetingId string, title string, name string, date string, time string, meetingType string, cancelled boolean, notes string, location string, body string, agendaUrl string, minutesUrl string, packetUrl string, items array<{ITEM}>, minutes struct<kind:string,title:string,url:string,fileId:string,textKey:string>, documentsIndexed boolean"
STATE_DOCUMENTS = "file_id string, hash string, bytes long, chars long, pages int, method string, note string, ocr_pending boolean, failed string, first_seen timestamp, extracted_at timestamp"
STATE_MEETINGS = "meeting_id string, hash string, minutes_file_id string, item_count int, docs_complete boolean, scraped_at timestamp"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON documents (an object or an array of them a file); a missing path or what is no JSON gives no rows."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    wanted = T.ArrayType(T._parse_datatype_string(schema))
    parsed = F.from_json("value", wanted, {"mode": "PERMISSIVE"})
    files = spark.read.text(path, wholetext=True)
    one_a_line = F.split(F.rtrim("value"), r"\n(?=\{)")  # files of write_json
    documents = F.when(F.ltrim("value").startswith("["), F.array("value")).otherwise(one_a_line)
    return files.select(F.explode(documents).alias("value")).select(F.explode(parsed).alias("row")).select("row.*")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(key, text) of a folder of <key>.txt files; a missing folder gives no rows."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "key string, text string")
    name = F.col("_metadata.file_name")
    return spark.read.option("pathGlobFilter", "*.txt").text(path, wholetext=True).select(F.regexp_replace(name, r"\.txt\z", "").alias("key"), F.col("value").alias("text"))


def texts_for(wanted: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """wanted with text: null where there is none for key."""
    return wanted.join(texts.withColumnRenamed("key", key), key, "left")


def with_text(wanted: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """The rows of wanted for which a text exists."""
    return wanted.join(texts.select(F.col("key").alias(key)), key, "left_semi")


def read_binaries(spark: SparkSession, path: str, most_bytes: int | None = None) -> DataFrame:
    """(path, bytes, content, failed): files over most_bytes stay, marked too-large and without content.

    Small and large files are read by two scans, so a large file's bytes are never loaded.
    """
    files = spark.read.format("binaryFile").load(path)
    if most_bytes is None:
        return files.select("path", F.col("length").alias("bytes"), "content", F.lit(None).cast("string").alias("failed"))
    small = files.where(F.col("length") <= most_bytes).select("path", F.col("length").alias("bytes"), "content", F.lit(None).cast("string").alias("failed"))
    large = files.where(F.col("length") > most_bytes).select("path", F.col("length").alias("bytes"), F.lit(None).cast("binary").alias("content"), F.lit("too-large").alias("failed"))
    return small.unionByName(large)


class Versions:
    """Tables that change together, in folders of their own under path: v-1, v-2 .. A version counts from the moment its
    marker is there, which is the last thing written, so a run that stops at any point leaves the version before it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _numbers(self) -> list[int]:
        if not self.fs.exists(self._at("")):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self._at(""))]
        return sorted(int(n[2:]) for n in names if n.startswith("v-") and n[2:].isdigit())

    def whole(self) -> list[int]:
        """Versions that were written whole, ascending."""
        return [n for n in self._numbers() if self.fs.exists(self._at(f"v-{n}/{MARKER}"))]

    def folder(self) -> str | None:
        """The newest version's folder; None before the first."""
        found = self.whole()
        return f"{self.path}/v-{found[-1]}" if found else None

    def write(self, tables: dict[str, DataFrame], check=lambda read: None, keep: int = 2) -> None:
        """A new version of all tables, which may be made of the ones that stand there. check sees them as written, by name, and may raise."""
        number = max(self._numbers(), default=0) + 1
        at = f"{self.path}/v-{number}"
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{at}/{name}")
        check(lambda name: self.spark.read.parquet(f"{at}/{name}"))
        self.fs.create(self._at(f"v-{number}/{MARKER}"), False).close()
        for old in self.whole()[:-keep]:
            self.fs.delete(self._at(f"v-{old}"), True)


MARKER = "_WHOLE"


def replace_table(df: DataFrame, path: str) -> None:
    """df in the place of what was at path, which may be what df reads."""
    Versions(df.sparkSession, path).write({"table": df})


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """What was last put at path by replace_table or save_documents; None before the first."""
    at = Versions(spark, path).folder()
    return spark.read.parquet(f"{at}/table") if at else None


def save_documents(documents: DataFrame, path: str) -> None:
    """Rows of documents as a table; a ref that occurs twice ends the run and leaves the table that was there."""
    Versions(documents.sparkSession, path).write({"table": documents}, check=lambda read: unique_refs(read("table")))


def save_state(path: str, org: str, meetings: DataFrame, documents: DataFrame) -> None:
    """Both tables and the row that names version and organisation, together."""
    spark = meetings.sparkSession
    about = spark.createDataFrame([(STATE_VERSION, str(org))], "version int, org string")
    Versions(spark, path).write({"meetings": meetings, "documents": documents, "about": about})


def load_state(spark: SparkSession, path: str, org: str) -> tuple[DataFrame, DataFrame]:
    """(meetings, documents) of an organisation, brought to this version; empty for another one or where nothing was saved.

    What was saved and cannot be read is an error, not an empty state.
    """
    empty = spark.createDataFrame([], STATE_MEETINGS), spark.createDataFrame([], STATE_DOCUMENTS)
    at = Versions(spark, path).folder()
    about = spark.read.parquet(f"{at}/about").first() if at else None
    if not about or about.org != str(org) or about.version not in (2, 3, STATE_VERSION):
        return empty
    return spark.read.parquet(f"{at}/meetings"), migrated(spark.read.parquet(f"{at}/documents"), about.version)


def write_json(df: DataFrame, path: str) -> None:
    """Rows as JSON documents, one a line; read_json gives them back."""
    df.write.mode("overwrite").json(path)


def write_binaries(df: DataFrame, path: str) -> None:
    """(key, content), the bytes of files, as one table by key."""
    df.select("key", "content").write.mode("overwrite").parquet(path)


def write_texts(df: DataFrame, path: str) -> None:
    """(key, text) as one table by key."""
    df.select("key", "text").write.mode("overwrite").parquet(path)


def ocr_available(which=shutil.which) -> bool:
    """Both tools that reading scanned pages takes are on this machine's path."""
    return all(which(tool) for tool in ("pdftoppm", "tesseract"))


def extracted(files: DataFrame, extractor, schema: str) -> DataFrame:
    """files through a pluggable extractor (an iterator of pandas frames in, one out) for formats read outside the engine."""
    return files.mapInPandas(extractor, schema)


def read_page_by_page(pages: DataFrame, read) -> DataFrame:
    """(doc, page, text, failed) of pages (doc, page, content): read(content) -> text; a page that fails is a row of its own
    with what went wrong, and the other pages of its document go on."""
    def run(batches):
        for b in batches:
            rows = []
            for doc, page, content in b.itertuples(index=False, name=None):
                try:
                    rows.append((doc, page, read(content), None))
                except Exception as e:  # noqa: BLE001  whatever a reader of foreign files may raise
                    rows.append((doc, page, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["doc", "page", "text", "failed"])

    ship(pages.sparkSession)
    return pages.select("doc", "page", "content").mapInPandas(run, "doc string, page int, text string, failed string")
