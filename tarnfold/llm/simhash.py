"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints are taken of whole texts on the workers. Equal fingerprints become one class before
anything is compared. The 64 bits are grouped into partitions, correlated bits together, and thresholds
t_i >= -1 with sum(t_i + 1) = radius + 1 are allocated by dynamic programming on estimated candidate
counts: two fingerprints within the radius differ by at most t_i bits in some partition i. A fingerprint
stands in the bucket of its own bits in each partition with t_i >= 0, and where t_i >= 1 also probes
the buckets up to t_i bits away. A bucket of more than LARGEST_BUCKET members is split by parts of the bits
left, again by the pigeonhole principle. A bucket's members are verified exactly, and a bucket returns a spanning
forest of its links, never its pairs; a search from each member over those not yet reached ends as soon
as all are, so buckets of close copies cost little more than their size. Components follow from the forest.

The sample behind the estimates (about SAMPLE fingerprints) decides only how much is probed where; any plan
finds every link.

Defined results: a null or wordless text has fingerprint 0 and is linked as any other. Repeated rows
each return their row. The component of rows of which no doc_id is known is null. An empty table gives
an empty result. Extra columns of any name are kept unchanged by `keep_one` and ignored elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import accumulate, combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfold.llm.common import drawn, fresh, in_arrow, own_columns, text_of, written
from tarnfold.llm.components import components

WORDS = 4
SEED = 42
RADIUS = 4
SAMPLE = 4096
#: Fingerprints of more than this share of all rows are joined by broadcast: at most as many as the inverse.
HOT_SHARE = 0.001
FANOUT = 16
#: Buckets of more fingerprints are split by further bits.
LARGEST_BUCKET = 1 << 14
SPLITS = 2
_CHUNK = 1 << 16


def fingerprint(text: str, k: int = WORDS, seed: int = SEED) -> int:
    """The SimHash of a text's k-word shingles under XXH64."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = list(accumulate(len(w) + 1 for w in words))
    n = max(1, len(words) - k + 1)
    starts, stops = [0, *ends[: n - 1]], ends[min(k, len(words)) - 1 :]
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _CHUNK):
        h = np.fromiter((digest(joined[a : b - 1], seed) for a, b in zip(starts[at : at + _CHUNK], stops[at : at + _CHUNK])), dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int = WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, text_hash, fp) for each row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), k, seed) for t in b.column(2)), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))], ["doc_id", "text_hash", "fp"])

    t = text_of()
    return in_arrow(docs.select(F.col("doc_id").cast("long"), F.xxhash64(t).alias("text_hash"), t.alias("text")), run, "doc_id long, text_hash long, fp long")


def _order_bits(sample: np.ndarray) -> list[int]:
    """The bits in a chain in which each stands by the one it is most correlated with."""
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    bits -= bits.mean(axis=0)
    scale = np.sqrt((bits**2).sum(axis=0))
    scale[scale == 0] = 1
    near = np.abs((bits / scale).T @ (bits / scale))
    order, left = [0], set(range(1, 64))
    while left:
        best = max(left, key=lambda j: (near[order[-1], j], -j))
        order.append(best)
        left.remove(best)
    return order


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Dynamic programming: shares a_i with sum total that minimise sum of costs[i][a_i]."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for used, (c, shares) in best.items():
            for a in range(total - used + 1):
                x = (c + row[a], [*shares, a])
                if used + a not in new or x[0] < new[used + a][0]:
                    new[used + a] = x
        best = new
    return best[total]


def plan(sample: np.ndarray, n: int, radius: int = RADIUS) -> list[tuple[int, int, list[int]]]:
    """(mask, threshold, bits) of each partition that takes part, cheapest by estimate for n fingerprints.

    The cost of a share a (threshold a - 1) is that of its candidates, from the pairs of the sample that
    agree within the threshold, and of the buckets to which each fingerprint goes.
    """
    order = _order_bits(sample) if len(sample) > 1 else list(range(64))
    some = sample[:1024]
    x = (some[:, None] ^ some[None, :])[np.triu_indices(len(some), 1)]
    pairs = n * (n - 1) / 2
    best: tuple[float, list] = (float("inf"), [])
    for m in range(2, radius + 2):
        ends = [round(64 * i / m) for i in range(m + 1)]
        parts = [order[a:b] for a, b in zip(ends, ends[1:])]
        masks = [sum(1 << b for b in p) for p in parts]
        costs = []
        for p, mask in zip(parts, masks):
            d = np.bitwise_count(x & np.uint64(mask))
            row = [0.0]
            for t in range(radius + 1):
                buckets = sum(comb(len(p), i) for i in range(t + 1))
                even = buckets / 2.0 ** len(p)
                share = max(float((d <= t).mean()) if len(x) else 0.0, even)
                row.append(pairs * share + 20.0 * n * (buckets + bool(t)))
            costs.append(row)
        cost, shares = allocate(costs, radius + 1)
        if cost < best[0]:
            best = (cost, [(mask, a - 1, p) for mask, a, p in zip(masks, shares, parts) if a])
    return best[1]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def buckets(fps: DataFrame, parts: list[tuple[int, int, list[int]]]) -> DataFrame:
    """(mask, key, fp): the buckets where each fingerprint stands or which it probes; mask: the bits that the key takes up."""

    def standing(mask: int, threshold: int, bits: list[int]) -> Column:
        own = F.col("fp").bitwiseAND(F.lit(_signed(mask)))
        flips = [_signed(sum(1 << b for b in c)) for t in range(threshold + 1) for c in combinations(bits, t)]
        return F.transform(F.lit(flips), lambda f: F.struct(F.lit(_signed(mask)).cast("long").alias("mask"), own.bitwiseXOR(f).alias("key")))

    return fps.select("fp", F.explode(F.flatten(F.array(*[standing(*p) for p in parts]))).alias("b")).select("b.mask", "b.key", "fp")


def finer(mask: int, order: list[int], radius: int) -> list[int]:
    """radius + 1 parts, as masks, of the bits that mask leaves; none if there are too few.

    Two fingerprints within the radius agree on one of them at least. Every radius + 1st bit of the chain goes to one
    part, so that each has some of every lot of correlated bits.
    """
    left = [b for b in order if not mask >> b & 1]
    return [sum(1 << b for b in left[i :: radius + 1]) for i in range(radius + 1)] if len(left) > radius else []


def of_bounded_size(spread: DataFrame, order: list[int], radius: int, most: int) -> DataFrame:
    """The rows of buckets (mask, key, fp), where a bucket of more than `most` is replaced by those into which the bits left split it.

    A split bucket's members go to radius + 1 finer ones, each by its own bits of one part; two linked ones meet in one of
    them. At most SPLITS times over: what is large even then differs in few bits, is linked for the most part, and the
    search for a forest takes such groups in one go.
    """
    done, todo = [], spread
    for _ in range(SPLITS):
        sizes = written(todo.groupBy("mask", "key").count().where(F.col("count") > most).select("mask", "key"), "buckets")
        parts = {r.mask: finer(r.mask % (1 << 64), order, radius) for r in sizes.select("mask").distinct().collect()}  # as many as there are kinds of bucket
        parts = {mask: p for mask, p in parts.items() if p}
        if not parts:
            break
        split = sizes.where(F.col("mask").isin(list(parts)))
        done.append(todo.join(split, ["mask", "key"], "left_anti"))
        table = todo.sparkSession.createDataFrame([(mask, [_signed(x) for x in p]) for mask, p in parts.items()], "mask long, finer array<long>")
        large = todo.join(split, ["mask", "key"], "left_semi").join(F.broadcast(table), "mask").select("mask", "key", "fp", F.explode("finer").alias("bits"))
        # Two buckets of one hash would only share a comparison.
        todo = written(large.select(F.col("mask").bitwiseOR(F.col("bits")).alias("mask"), F.xxhash64("mask", "key", "bits", F.col("fp").bitwiseAND(F.col("bits"))).alias("key"), "fp").distinct(), "buckets")
    return reduce(DataFrame.unionByName, done, todo)


def spanning_forest(fps: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Edges that join fps (distinct, unsigned) as the links within the radius do. Trees have bounded fan-out."""
    edges: list[tuple[int, int]] = []
    left = fps
    while len(left) > 1:
        members, left = [left[0]], left[1:]
        at = 0
        while at < len(members) and len(left):
            near = np.bitwise_count(left ^ members[at]) <= radius
            if near.any():
                members.extend(left[near])
                left = left[~near]
            at += 1
        edges += [(int(members[(j - 1) // FANOUT]), int(members[j])) for j in range(1, len(members))]
    return edges


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): edges whose components are those of all links within the radius among distinct fps."""
    n = fps.count()
    sample = np.array([r[0] for r in fps.where(drawn(SAMPLE / max(n, 1), "fp")).collect()], dtype=np.int64).view(np.uint64)
    parts = plan(sample, n, radius)
    spread = of_bounded_size(buckets(fps, parts), _order_bits(sample) if len(sample) > 1 else list(range(64)), radius, LARGEST_BUCKET)
    spread = spread.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 3), dtype=np.int64)

        def joined(rows: np.ndarray) -> pa.RecordBatch:
            new = np.ones(len(rows), dtype=bool)
            new[1:] = (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])
            starts = np.flatnonzero(new)
            stops = np.append(starts[1:], len(rows))
            unsigned = np.ascontiguousarray(rows[:, 2]).view(np.uint64)
            out: list[tuple[int, int]] = []
            two = starts[stops - starts == 2]
            two = two[np.bitwise_count(unsigned[two] ^ unsigned[two + 1]) <= radius]
            for a, b in zip(starts[stops - starts > 2], stops[stops - starts > 2]):
                out += spanning_forest(unsigned[a:b], radius)
            e = np.array(out, dtype=np.uint64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([e[:, i], unsigned[two + i]]).view(np.int64)) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
            rows = np.concatenate([held, rows])
            whole = len(rows)  # the last bucket may go on in the next batch
            if whole:
                same = (rows[:, 0] == rows[-1, 0]) & (rows[:, 1] == rows[-1, 1])
                whole = int(np.argmax(same))
            held = rows[whole:]
            if whole:
                yield joined(rows[:whole])
        if len(held):
            yield joined(held)

    return in_arrow(spread, run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, text_hash, fp, component_id, keeps): component_id is the smallest doc_id of the component;
    keeps marks the rows equal in doc_id and text to the one that stays of it."""
    rows = written(fingerprints(docs), "fingerprints")
    return classes(rows, radius)


def classes(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_hash"))
    fps = written(rows.groupBy("fp").agg(first.alias("first"), F.count("*").alias("n")), "classes")
    roots = components(links(fps.select("fp"), radius))
    rooted = written(fps.join(roots.withColumnRenamed("v", "fp"), "fp", "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root")), "classes")
    best = rooted.groupBy("root").agg(F.min("first").alias("best"))
    named = written(rooted.join(best, "root").select("fp", "n", "best"), "classes")
    total = named.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") > max(1000, HOT_SHARE * total)
    out = lambda left, right: left.join(right, "fp").select(
        "doc_id", "text_hash", "fp", F.col("best.doc_id").alias("component_id"), (F.col("best.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("best.text_hash") == F.col("text_hash"))).alias("keeps"))
    common = F.broadcast(named.where(hot).select("fp", "best"))  # at most 1 / HOT_SHARE rows
    rest = rows.join(common.select("fp"), "fp", "left_anti")
    return out(rows, common).unionByName(out(rest, named.where(~hot).select("fp", "best")))


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """docs with one row of each component, that of the smallest doc_id; columns as they are."""
    own_hash, rank, keep_id, keep_hash = fresh(docs, "near_hash", "near_rank", "keep_id", "keep_hash")
    keep = near_duplicates(docs, radius).where("keeps").select(F.col("doc_id").alias(keep_id), F.col("text_hash").alias(keep_hash)).distinct()
    hashed = docs.withColumn(own_hash, F.xxhash64(text_of()))
    found = hashed.join(keep, F.col("doc_id").cast("long").eqNullSafe(F.col(keep_id)) & (F.col(own_hash) == F.col(keep_hash)), "left_semi")
    one = Window.partitionBy("doc_id", own_hash).orderBy(F.xxhash64(*own_columns(docs)))
    return found.withColumn(rank, F.row_number().over(one)).where(F.col(rank) == 1).select(*own_columns(docs))


def op10_simhash(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
