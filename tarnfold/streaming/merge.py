"""The incremental merge as a stream of micro-batches: each batch replaces its keys' rows and carries the others forward.

The table is dealt into buckets by key. A batch reads and writes again only the buckets that it has keys of, and a small file
for each version says where each bucket's rows lie; that file is written last, in one step. Versions are numbered by
what stands in the table, apart from the stream's own batch numbers, so a batch that runs again after a failure, or a stream
that begins anew without its checkpoint, works on the newest version and gives the same table. trigger(availableNow) with
maxFilesPerTrigger works through a backlog in steps; a budget of seconds ends it between or within steps without
harm, as a step that was not finished left no version.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tarnfold.operators.ingest import carry_forward, latest

BUCKETS = 64


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, table: str) -> list[int]:
    """Versions that were written whole, ascending."""
    fs, p = _path(spark, f"{table}/versions")
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n[2:-5]) for n in names if n.startswith("v-") and n.endswith(".json"))


def _manifest(spark: SparkSession, table: str, version: int) -> dict:
    """{buckets: their number, places: {bucket: the version that wrote it}, schema}."""
    return json.loads(spark.read.text(f"{table}/versions/v-{version}.json", wholetext=True).first().value)


def _write_manifest(spark: SparkSession, table: str, version: int, manifest: dict) -> None:
    fs, at = _path(spark, f"{table}/versions/v-{version}.json")
    _, staged = _path(spark, f"{table}/versions/.v-{version}.staged")
    out = fs.create(staged, True)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    if not fs.rename(staged, at):
        raise OSError(f"version {version} of {table} is there already: two streams must not write one table")


def _rows(spark: SparkSession, table: str, manifest: dict, buckets: list[int]) -> DataFrame | None:
    paths = [f"{table}/data/v-{manifest['places'][str(b)]}/bucket_={b}" for b in buckets if str(b) in manifest["places"]]
    return spark.read.schema(manifest["schema"]).parquet(*paths) if paths else None


def current(spark: SparkSession, table: str) -> DataFrame | None:
    """The newest version of the table, or None."""
    found = versions(spark, table)
    if not found:
        return None
    manifest = _manifest(spark, table, found[-1])
    return _rows(spark, table, manifest, list(map(int, manifest["places"])))


def merge_into(table: str, key: str, at: str, keep: int = 2, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the batch's last row of each key, and of the buckets that it touches all other rows of the version before it."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        found = versions(spark, table)
        before = _manifest(spark, table, found[-1]) if found else {"buckets": buckets, "places": {}, "schema": None}
        bucket = F.pmod(F.xxhash64(key), F.lit(before["buckets"])).cast("int")
        rows = latest(batch, key, at)
        touched = [r[0] for r in rows.select(bucket.alias("b")).distinct().collect()]  # at most as many as there are buckets
        if not touched:
            return
        version = max(found, default=-1) + 1
        prior = _rows(spark, table, before, touched)
        merged = carry_forward(rows, prior, key) if prior is not None else rows
        merged.withColumn("bucket_", bucket).repartition("bucket_").write.mode("overwrite").partitionBy("bucket_").parquet(f"{table}/data/v-{version}")
        places = before["places"] | {str(b): version for b in touched}
        _write_manifest(spark, table, version, {"buckets": before["buckets"], "places": places, "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in merged.schema)})
        _clean(spark, table, keep)

    return merge


def _clean(spark: SparkSession, table: str, keep: int) -> None:
    """Removes all but the last `keep` versions, and data that none of those refers to."""
    found = versions(spark, table)
    for old in found[:-keep]:
        fs, p = _path(spark, f"{table}/versions/v-{old}.json")
        fs.delete(p, False)
    used = {v for n in found[-keep:] for v in _manifest(spark, table, n)["places"].values()}
    fs, p = _path(spark, f"{table}/data")
    for s in fs.listStatus(p):
        name = s.getPath().getName()
        if name.startswith("v-") and int(name[2:]) not in used:
            fs.delete(s.getPath(), True)


def start(stream: DataFrame, table: str, checkpoint: str, key: str, at: str) -> StreamingQuery:
    """Works off what is there and stops."""
    return stream.writeStream.foreachBatch(merge_into(table, key, at)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_within(query: StreamingQuery, seconds: float, clock: Callable[[], float] = time.monotonic) -> bool:
    """Waits for query, at most `seconds`, and then stops it; True if it was done. What is left is taken up by the next start."""
    until = clock() + seconds
    while query.isActive and (left := until - clock()) > 0:
        query.awaitTermination(max(1, int(min(left, 5))))
    done = not query.isActive
    if not done:
        query.stop()
    return done
