"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfold.scratch import own_dir
from tarnfold.shipping import ship

#: The six white-space characters that end a word, and words as the contracts state them.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; over all cores where its files make fewer tasks than there are cores, which only small ones do."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def in_arrow(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow on workers that have this package."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def text_of(col: str | Column = "text") -> Column:
    """A text, the empty one for null."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def ascii_lower(col: Column) -> Column:
    """A-Z in lower case; every other character stays."""
    return F.translate(col, UPPER, LOWER)


def n_words(col: Column) -> Column:
    return F.regexp_count(col, F.lit(WORD)).cast("long")


def fold(col: str | Column, k: int) -> Column:
    """crc32 of an id as text, modulo k. A null id counts as the empty text."""
    c = F.col(col) if isinstance(col, str) else col
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(k))


def drawn(share: float | Column, *cols: str | Column) -> Column:
    """True for about `share` of the rows, by a hash of cols: a sample without a sort or a top list for the driver."""
    return F.pmod(F.xxhash64(*cols, F.lit("drawn")), F.lit(1 << 30)) / float(1 << 30) < share


def fresh(df: DataFrame, *names: str) -> list[str]:
    """names that are not columns of df: each with as many underscores behind it as that takes."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def own_columns(df: DataFrame) -> list[Column]:
    """df's columns by name, whatever characters are in it."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row instead of at each use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends there, and losing executors loses nothing."""
    path = own_dir(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
