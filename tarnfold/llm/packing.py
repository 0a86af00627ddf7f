"""Best-fit decreasing packing of token sequences, exact over the whole table.

Workers tokenise whole texts into pieces (doc_id, piece, start, length, ids_crc32), written to the
shared folder. Best-fit decreasing depends on lengths alone and there are at most `size` of them, so
the driver packs the histogram of lengths: a segment tree over remaining capacities finds the
tightest open capacity in logarithmic time, and bins of equal capacity move together as runs. The
outcome is a table of runs (length, ranks from-to -> sequences, offset) whose size is bounded by the
number of lengths, whatever the number of documents. Each piece then needs only its rank within its
length: groups of equal length are split into parts of at most about N/65536 rows, ranked part by part.
The result is that of packing one document at a time, with no task or driver seeing all of them.

Token ids are those of the `tokenizers` library for the given file. Texts of code points below U+0250
take the same vocabulary through tiktoken (several times as fast, the same ids; tests compare them);
all other texts go through `tokenizers` itself.

Defined results: a null text is empty: its one piece is the end token. Repeated rows are packed each;
a null doc_id stays null. A document longer than `size` is cut into pieces of `size`, the first of
which takes what is left over. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tarnfold.llm.common import in_arrow, text_of, written

SIZE = 2048
END_ID = 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, nth int"
_WIDE = re.compile("[^\x00-ɏ]")
_LOADED: dict = {}


def encoder(path: str, ranks_path: str | None):
    """text -> ids, kept for the life of the worker."""
    if path not in _LOADED:
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        exact = Tokenizer.from_file(path)
        exact.encode_special_tokens = True
        by_library = lambda text: exact.encode(text, add_special_tokens=False).ids
        fast = by_library
        if ranks_path:
            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        _LOADED[path] = lambda text: by_library(text) if _WIDE.search(text) else fast(text)
    return _LOADED[path]


def cuts(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of n ids."""
    first = n % size or min(n, size)
    return [(0, first)] + [(at, size) for at in range(first, n, size)]


def tokenised(docs: DataFrame, path: str, ranks_path: str | None = None, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """The pieces of each document, with their ids if asked for; nth counts a task's pieces (modulo 2^31)."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "nth"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, nth = encoder(path, ranks_path), 0
        for batch in batches:
            out: list[tuple] = []
            kept: list = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array(encode(text.as_py()) + [END_ID], dtype="<u4")
                for k, (start, n) in enumerate(cuts(len(ids), size)):
                    part = ids[start : start + n]
                    out.append((doc_id, k, start, n, zlib.crc32(part.tobytes()), nth))
                    nth = (nth + 1) & 0x7FFFFFFF
                    if with_ids:
                        kept.append(part.astype(np.int32))
            columns = [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, types)]
            if with_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names + ["ids"] * with_ids)

    return in_arrow(docs.select(F.col("doc_id").cast("long"), text_of().alias("text")), run, PIECES + ", ids array<int>" * with_ids)


class Capacities:
    """A segment tree over capacities 0..size: which have open bins, and the smallest of them from a bound on."""

    def __init__(self, size: int):
        self.n = 1 << size.bit_length()
        self.any = bytearray(2 * self.n)

    def mark(self, capacity: int, is_open: bool) -> None:
        i = capacity + self.n
        self.any[i] = is_open
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] | self.any[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        i = least + self.n
        if self.any[i]:
            return least
        while i > 1:
            if not i & 1 and self.any[i + 1]:
                i += 1
                while i < self.n:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.n
            i //= 2
        return None


def pack_histogram(counts: dict[int, int], size: int = SIZE) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best-fit decreasing over {length: how many}.

    Returns the runs (length, from_rank, first_sequence, per_sequence, offset), from_rank ascending in
    each length, and the number of sequences. Items of one length that best fit puts one after another
    into the same bin are placed at once: after one, that bin is the tightest still, as long as it fits.
    """
    tree, open_bins = Capacities(size), {}
    runs, sequences = [], 0

    def put(capacity: int, first: int, many: int) -> None:
        if many and capacity:
            open_bins.setdefault(capacity, deque()).append((first, many))
            tree.mark(capacity, True)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                per = size // length
                first, many = sequences, -(-left // per)
                sequences += many
                capacity = size
            else:
                per = capacity // length
                first, many = open_bins[capacity].popleft()
                if not open_bins[capacity]:
                    tree.mark(capacity, False)
            full = min(many, left // per)
            if full:
                runs.append((length, rank, first, per, size - capacity))
                put(capacity - per * length, first, full)
                rank, left = rank + full * per, left - full * per
            if full < many and left and left < per:  # the last bin of this length takes fewer
                runs.append((length, rank, first + full, left, size - capacity))
                put(capacity - left * length, first + full, 1)
                full, rank, left = full + 1, rank + left, 0
            put(capacity, first + full, many - full)
    return runs, sequences


def pack(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """pieces with sequence_id and offset. pieces must be stable when read again, as a table is.

    Parts are dealt by ids, contents and nth, so neither rows without a doc_id nor copies of one document fill a part.
    """
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `size` rows
    spark = pieces.sparkSession
    if not counts:
        return pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    runs, _ = pack_histogram(counts, size)
    most = max(256, sum(counts.values()) // 65536)
    parts = spark.createDataFrame([(n, -(-c // most)) for n, c in counts.items()], "length long, parts int")
    placed = pieces.join(F.broadcast(parts), "length").withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32", "nth"), F.col("parts")).cast("int")).drop("parts")
    by_part = placed.groupBy("length", "part").count().collect()  # at most 65536 and a row for each length
    base, total = {}, {}
    for n, part, c in sorted(map(tuple, by_part)):
        base[n, part] = total.get(n, 0)
        total[n] = base[n, part] + c
    keys = sorted(base)
    shift = 48
    part_keys = np.array([(n << 32) + p for n, p in keys], dtype=np.int64)
    part_base = np.array([base[k] for k in keys], dtype=np.int64)
    runs.sort()
    run_keys = np.array([(r[0] << shift) + r[1] for r in runs], dtype=np.int64)
    run_from, run_first, run_per, run_offset = (np.array([r[i] for r in runs], dtype=np.int64) for i in (1, 2, 3, 4))
    tables = spark.sparkContext.broadcast((part_keys, part_base, run_keys, run_from, run_first, run_per, run_offset))
    ranked = placed.withColumn("rank", F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32", "nth")).cast("long") - 1)
    names = pieces.columns
    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part_keys, part_base, run_keys, run_from, run_first, run_per, run_offset = tables.value
        for b in batches:
            length, part, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "part", "rank"))
            rank = rank + part_base[np.searchsorted(part_keys, (length << 32) + part)]
            at = np.searchsorted(run_keys, (length << shift) + rank, side="right") - 1
            nth = rank - run_from[at]
            columns = [b.column(b.schema.get_field_index(c)) for c in names]
            columns += [pa.array(run_first[at] + nth // run_per[at]), pa.array(run_offset[at] + nth % run_per[at] * length)]
            yield pa.RecordBatch.from_arrays(columns, [*names, "sequence_id", "offset"])

    return in_arrow(ranked.select(*names, "part", "rank"), run, schema)


def assemble(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the sequences themselves, from packed pieces with ids."""
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return rows.select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"))


def best_fit(docs: DataFrame, path: str | None = None, ranks_path: str | None = None, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """Tokenise and pack. Without a path: the public byte-level vocabulary and its ranks."""
    if path is None:
        import public_tokenizers

        path, ranks_path = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    return pack(written(tokenised(docs, str(path), ranks_path and str(ranks_path), size, with_ids), "pieces"), size)


def op4_best_fit_packing(docs: DataFrame) -> DataFrame:
    return best_fit(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
