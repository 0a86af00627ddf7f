"""An interpolated modified Kneser-Ney bigram model over the whole training corpus.

Counting: each task adds up its word pairs and sends them, packed, to cells by the leading bits of the pair's hash, so
that a frequent word's pairs are dealt over all cells. Their number follows from the bytes of all texts (CELL_BYTES
each), not from how the input is partitioned. A few neighbouring cells form a shard, which one task works off cell by
cell, so it never holds more than a cell: it appends the cell's pairs, as sorted hashes with counts, to
the shard's file. What the cells tell of their words (tokens, different words before it, how many different words
follow it once, twice, more often) is added up across all cells that a task sees and sent on in the same way to word
cells, whose shards are the same kind of file. More cells than FANOUT are reached in two steps, so what a task sends is at most FANOUT
packs a flush in each. Discounts come from sums over the shards. Scoring: workers memory-map the files and look a block of tokens up in
sorted order; probabilities are put together from counts there, so nothing is joined and nothing else is shuffled.

The order is two: a shuffle of all three-word counts would take several times the input (see README).

Files are written under a name of their own and renamed, so a task that runs twice leaves one copy. Each shard returns a
row of the manifest, with the bytes of its file; a worker that does not find a file of the manifest, or
finds another size, stops with an error, so a folder that the workers do not share is never taken for an empty model. The
folder is in spark.checkpoint.dir, which must be mounted on the workers (file: or a plain path) for
memory-mapping; otherwise pass `folder`.

Tokens: words of the text with A-Z lowered, then one end. Probabilities sum to one over the training
tokens' V values and one unknown.

Defined results: a null text is empty (its one token is the end). Without training texts each token has
probability 1. Repeated rows are texts of their own. An empty table gives an empty result. A null id
counts as the empty text in the fold. Extra columns are ignored.
"""

from __future__ import annotations

import os
import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfold.llm.common import fold, in_arrow, own_dir, text_of

BEGIN, END = np.uint64(1), np.uint64(2)
#: Bytes of text for each cell of pairs, and bits that tell the cells of one file; words take a quarter of the cells.
CELL_BYTES, SHARD_BITS = 8 << 20, 2
FANOUT_BITS, MOST_TASKS = 12, 1 << 16
_PAIRS = 1 << 20  # pairs counted at once
_HELD = 3 << 20  # different pairs or words that a task holds before it sends them
_TOKENS = 1 << 18  # tokens scored at once
_WORDS = 1 << 18  # words whose hashes a worker keeps
_OPEN = 4096  # files that a worker keeps mapped


class Hashes(dict):
    """word -> 64-bit hash, remembered."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= _WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 7)
        return h


def tokens(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def pair_hash(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    h = (u * np.uint64(0x9E3779B97F4A7C15)) ^ (w + np.uint64(0x7F4A7C15F39CC060))
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def packed(*columns: np.ndarray) -> bytes:
    """Columns of one length; the first ascends. Bytes of equal weight stand together, which packs well."""
    import zstandard

    first = np.diff(columns[0], prepend=columns[0].dtype.type(0))
    raw = [np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in (first, *columns[1:])]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(raw))


def unpacked(data: bytes, n: int, *types) -> list[np.ndarray]:
    import zstandard

    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    for t in types:
        size = np.dtype(t).itemsize
        flat = np.frombuffer(raw, dtype=np.uint8, count=n * size, offset=at).reshape(size, n).T
        out.append(np.ascontiguousarray(flat).view(t).ravel())
        at += n * size
    out[0] = np.cumsum(out[0], dtype=out[0].dtype)
    return out


def added_up(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Sorted different keys, the place of one row of each, and the sums of the values."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    starts = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, dtype=np.int64)
    return k[starts], order[starts], [np.add.reduceat(v[order], starts) if len(k) else v for v in values]


def cell_of(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), dtype=np.int64)


def word_key(w: np.ndarray) -> np.ndarray:
    return w * np.uint64(0x9E3779B97F4A7C15)


class Kind:
    """What is counted: columns that name it, columns that are summed, and the hash that deals it to cells."""

    def __init__(self, name: str, ids: int, sums: int, key):
        self.name, self.ids, self.sums, self.key = name, ids, sums, key

    @property
    def types(self) -> list:
        return [np.uint64] * (self.ids + self.sums)


PAIRS = Kind("pairs", 2, 1, pair_hash)
WORDS = Kind("words", 1, 5, word_key)  # tokens, before, then followed once, twice, more often
PACKS = "cell long, n int, data binary"
TOLD = -1  # the cell of rows that are no packs


class Held:
    """Sums by key, held until there are enough, then sent as one pack for each cell."""

    def __init__(self, kind: Kind, bits: int):
        self.kind, self.bits, self.held, self.n = kind, bits, [], 0
        self.most = _HELD // (kind.ids + kind.sums - 2)

    def add(self, ids: list[np.ndarray], sums: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        self.held.append((self.kind.key(*ids), *ids, *sums))
        self.n += len(ids[0])
        if self.n >= self.most and len(self.held) > 1:
            self._merge()
            if self.n >= self.most // 2:
                yield from self.sent()

    def _merge(self) -> None:
        # One column after the other, so that what is held is not there twice.
        columns = [list(x) for x in zip(*self.held)]
        self.held = []
        order = np.argsort(keys := np.concatenate(columns.pop(0)), kind="stable")
        keys = keys[order]
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, dtype=np.int64)
        first, out = order[starts], [keys[starts]]
        del keys
        for i in range(len(columns)):
            c, columns[i] = np.concatenate(columns[i]), []
            out.append(c[first] if i < self.kind.ids else np.add.reduceat(c[order], starts) if len(starts) else c)
        self.held, self.n = [tuple(out)], len(starts)

    def sent(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        self._merge()
        keys, *columns = self.held[0]
        cells = cell_of(keys, self.bits)
        starts = np.flatnonzero(np.append(True, cells[1:] != cells[:-1])) if len(cells) else []
        rows = []
        for a, b in zip(starts, np.append(starts[1:], len(cells))):
            order = np.lexsort([c[a:b] for c in reversed(columns[: self.kind.ids])])
            rows.append((int(cells[a]), int(b - a), packed(*[c[a:b][order] for c in columns])))
        self.held, self.n = [], 0
        if rows:
            yield _rows(rows)


def _cells(batches: Iterator[pa.RecordBatch], kind: Kind, told: list[bytes]) -> Iterator[tuple[int, list[np.ndarray], list[np.ndarray]]]:
    """(cell, ids, sums) of each cell of packs in order of cell, added up and in order of key. Rows of cell TOLD go to told."""
    now, parts = None, []

    def added() -> tuple[int, list[np.ndarray], list[np.ndarray]]:
        columns = [np.concatenate(x) for x in zip(*parts)]
        _, at, sums = added_up(kind.key(*columns[: kind.ids]), *columns[kind.ids :])
        return now, [c[at] for c in columns[: kind.ids]], sums

    for b in batches:
        for cell, n, data in zip(*(b.column(i).to_pylist() for i in range(3))):
            if cell == TOLD:
                told.append(data)
                continue
            if cell != now and parts:
                yield added()
                parts = []
            now = cell
            parts.append(unpacked(data, n, *kind.types))
    if parts:
        yield added()


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 3, (pa.int64(), pa.int32(), pa.binary()))], ["cell", "n", "data"])


def dealt(packs: DataFrame, kind: Kind, bits: int) -> DataFrame:
    """packs, made for at most FANOUT_BITS, by shard and in order of cell for `bits`; beyond those by a second step."""
    if bits > FANOUT_BITS:
        def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = Held(kind, bits)
            for b in batches:
                for cell, n, data in zip(*(b.column(i).to_pylist() for i in range(3))):
                    if cell == TOLD:
                        yield _rows([(cell, n, data)])
                        continue
                    columns = unpacked(data, n, *kind.types)
                    yield from held.add(columns[: kind.ids], columns[kind.ids :])
            yield from held.sent()

        # Neighbouring cells of the first step share a task, so a flush reaches few cells of the second.
        packs = in_arrow(packs.repartition("cell").sortWithinPartitions("cell"), again, PACKS)
    # Shards are of even size; each goes to the task of its number.
    shards = min(1 << max(0, bits - SHARD_BITS), MOST_TASKS)
    return packs.repartitionById(shards, F.pmod(F.greatest(F.shiftright("cell", SHARD_BITS), F.lit(0)), F.lit(shards)).cast("int")).sortWithinPartitions("cell")


class ShardFile:
    """A shard's file, written cell by cell: hashes ascend from cell to cell. Each column has a file of its own until all are put together."""

    def __init__(self, folder: str, kind: Kind, shard: int):
        os.makedirs(folder, exist_ok=True)
        self.path, self.n = f"{folder}/{kind.name}-{shard}", 0
        self.parts = [f"{folder}/.{kind.name}-{shard}-{uuid.uuid4().hex}-{i}" for i in range(2 if kind is PAIRS else 6)]
        self.files = [open(p, "wb") for p in self.parts]
        self.large: list[tuple[np.ndarray, np.ndarray]] = []

    def pairs(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Counts take a byte; those of 255 and more, which are few, stand with their hashes behind the header."""
        self.n += len(keys)
        self.large.append((keys[counts >= 255], counts[counts >= 255]))
        keys.tofile(self.files[0])
        np.minimum(counts, 255).astype(np.uint8).tofile(self.files[1])

    def words(self, words: np.ndarray, sums: list[np.ndarray]) -> None:
        self.n += len(words)
        for f, c in zip(self.files, (words, *sums)):
            c.astype(np.uint64).tofile(f)

    def close(self) -> tuple[int, int]:
        """(rows, bytes) of the file, which is there as a whole or not at all."""
        for f in self.files:
            f.close()
        large = [np.concatenate(c) for c in zip(*self.large)] if self.large else [np.zeros(0, dtype=np.uint64)] * 2
        with open(f"{self.parts[0]}.whole", "wb") as whole:
            np.array([self.n, len(large[0])], dtype="<u8").tofile(whole)
            for c in large:
                c.astype(np.uint64).tofile(whole)
            for p in self.parts:
                with open(p, "rb") as part:
                    while block := part.read(1 << 24):
                        whole.write(block)
                os.remove(p)
            size = whole.tell()
        os.replace(f"{self.parts[0]}.whole", self.path)
        return self.n, size


def _mapped(path: str, kind: Kind) -> list[np.ndarray]:
    """A shard's columns, memory-mapped: for pairs hashes, counts, then hashes and counts of the large ones."""
    n, m = (int(x) for x in np.fromfile(path, dtype="<u8", count=2))
    at, out = 16, []
    for t, rows in [(np.uint64, m)] * 2 + ([(np.uint64, n), (np.uint8, n)] if kind is PAIRS else [(np.uint64, n)] * 6):
        out.append(np.memmap(path, dtype=t, mode="r", offset=at, shape=(rows,)) if rows else np.zeros(0, dtype=t))
        at += rows * np.dtype(t).itemsize
    return [*out[2:], *out[:2]] if kind is PAIRS else out[2:]


class Counted:
    """What scoring needs besides the files: their manifest {(kind, shard): bytes} and sums."""

    def __init__(self, folder: str, bits: dict[str, int], manifest: dict[tuple[str, int], int], sums: dict[str, int]):
        self.folder, self.bits, self.manifest = folder, bits, manifest
        self.n, self.v, self.pairs, self.texts = sums["n"], sums["v"], sums["pairs"], sums["texts"]
        self.discounts = discounts([sums[f"p{i}"] for i in (1, 2, 3, 4)])
        self.low_discounts = discounts([sums[f"b{i}"] for i in (1, 2, 3, 4)])
        more = sums["v"] - sums["b1"] - sums["b2"]
        self.low_rest = float(np.dot(self.low_discounts[1:], [sums["b1"], sums["b2"], more])) / self.pairs if self.pairs else 1.0


def discounts(n: list[int]) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2 and more, from the counts of counts 1 to 4."""
    d = [0.0, 0.5, 0.75, 0.9]  # where counts of counts are missing
    if n[0] and n[1]:
        y = n[0] / (n[0] + 2.0 * n[1])
        for k in (1, 2, 3):
            if n[k - 1]:
                d[k] = min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k - 0.05)
    return np.array(d)


def word_sums(u: np.ndarray, w: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(words, their five sums) of different pairs. Words after and words before are added up apart; only the much shorter sums meet."""
    after, _, (n_after, before) = added_up(w, c, np.ones(len(c), dtype=np.uint64))
    ahead, _, follow = added_up(u, *[m.astype(np.uint64) for m in (c == 1, c == 2, c > 2)])
    pad = lambda x, n, first: np.concatenate([x, np.zeros(n, dtype=x.dtype)] if first else [np.zeros(n, dtype=x.dtype), x])
    words, _, sums = added_up(np.concatenate([after, ahead]), *[pad(x, len(ahead), True) for x in (n_after, before)], *[pad(x, len(after), False) for x in follow])
    return words, sums


def bits_for(n_bytes: int, cell_bytes: int) -> int:
    """Leading bits of the hash that make a cell of about cell_bytes of n_bytes of text."""
    return max(0, -(-n_bytes // cell_bytes) - 1).bit_length()


def count(docs: DataFrame, folder: str | None = None) -> Counted:
    """Counts the pairs of docs' whole texts into files under folder."""
    spark = docs.sparkSession
    folder = folder or own_dir(spark, "ngrams")
    if "://" in folder.removeprefix("file://") or (":" in folder.split("/")[0] and not folder.startswith("file:")):
        raise ValueError(f"{folder} can't be memory-mapped; pass a folder that is mounted on the workers")
    folder = "/" + folder.removeprefix("file:").lstrip("/")
    texts = docs.select(text_of().alias("text"))
    n_bytes = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = {"pairs": bits_for(n_bytes, CELL_BYTES), "words": bits_for(n_bytes, 4 * CELL_BYTES)}
    first_bits = {k: min(b, FANOUT_BITS) for k, b in bits.items()}

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held = Hashes(), Held(PAIRS, first_bits["pairs"])

        def take(seq: list[int]) -> Iterator[pa.RecordBatch]:
            a = np.array(seq, dtype=np.uint64)
            u, w = a[:-1], a[1:]
            u, w = u[w != BEGIN], w[w != BEGIN]
            u = np.where(u == END, BEGIN, u)
            _, at, (c,) = added_up(pair_hash(u, w), np.ones(len(u), dtype=np.uint64))
            yield from held.add([u[at], w[at]], [c])

        seq: list[int] = [1]
        for b in batches:
            for t in b.column(0):
                seq += [hashes[w] for w in tokens(t.as_py())]
                seq.append(2)  # the next text's first word follows an end, taken as its beginning
                if len(seq) >= _PAIRS:
                    yield from take(seq)
                    seq = [1]
        if len(seq) > 1:
            yield from take(seq)
        yield from held.sent()

    def shards(batches: Iterator[pa.RecordBatch], kind: Kind, told: list[bytes], each) -> Iterator[tuple[int, int, int]]:
        """each(file, ids, sums) for each cell; (shard, rows, bytes) once a shard is done."""
        file, now = None, -1
        for cell, ids, sums in _cells(batches, kind, told):
            if cell >> SHARD_BITS != now:
                if file:
                    yield now, *file.close()
                now = cell >> SHARD_BITS
                file = ShardFile(folder, kind, now)
            each(file, ids, sums)
        if file:
            yield now, *file.close()

    def add_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Packs of words and, as rows of cell TOLD, a line of the manifest for each shard with its counts of counts."""
        held, out, of_counts = Held(WORDS, first_bits["words"]), [], np.zeros(4, dtype=np.int64)

        def each(file: ShardFile, ids: list[np.ndarray], sums: list[np.ndarray]) -> None:
            file.pairs(pair_hash(*ids), sums[0])
            of_counts[:] += np.bincount(np.minimum(sums[0], 5).astype(np.int64), minlength=6)[1:5]
            words, word_rows = word_sums(*ids, sums[0])
            out.extend(held.add([words], word_rows))

        for shard in shards(batches, PAIRS, [], each):
            yield _rows([(TOLD, 0, np.array([*shard, *of_counts], dtype="<i8").tobytes())])
            of_counts[:] = 0
            yield from out
            out.clear()
        yield from held.sent()

    def add_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(7, dtype=np.int64)  # tokens, words, texts, words that have 1 to 4 different ones before them

        def each(file: ShardFile, ids: list[np.ndarray], columns: list[np.ndarray]) -> None:
            words, tok, before = ids[0], columns[0], columns[1]
            file.words(word_key(words), columns)
            sums[:3] += [int(tok.sum()), int((tok > 0).sum()), int(tok[words == END].sum())]
            sums[3:] += np.bincount(np.minimum(before, 5).astype(np.int64), minlength=6)[1:5]

        told: list[bytes] = []
        rows = []
        for shard in shards(batches, WORDS, told, each):
            rows.append((WORDS.name, *shard, sums.tolist()))
            sums[:] = 0
        for data in told:
            shard, n, size, *counts = np.frombuffer(data, dtype="<i8").tolist()
            rows.append((PAIRS.name, shard, n, size, counts))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())))], ["kind", "shard", "n", "bytes", "sums"])

    packs = in_arrow(texts, pairs, PACKS)
    made = in_arrow(dealt(packs, PAIRS, bits["pairs"]), add_pairs, PACKS)
    told = in_arrow(dealt(made, WORDS, bits["words"]), add_words, "kind string, shard long, n long, bytes long, sums array<long>").collect()  # a row for each file
    manifest = {(r.kind, r.shard): r.bytes for r in told}
    total = {kind.name: np.sum([[r.n, *r.sums] for r in told if r.kind == kind.name] or [[0] * 8], axis=0, dtype=np.int64).tolist() for kind in (PAIRS, WORDS)}
    sums = dict(zip(("pairs", "p1", "p2", "p3", "p4"), total["pairs"])) | dict(zip(("n", "v", "texts", "b1", "b2", "b3", "b4"), total["words"][1:]))
    return Counted(folder, bits, manifest, sums)


class Model:
    """A worker's view of the counts: memory-mapped files."""

    def __init__(self, counted: Counted):
        self.c = counted
        self.files: OrderedDict[tuple[str, int], list[np.ndarray]] = OrderedDict()

    def _file(self, kind: Kind, shard: int) -> list[np.ndarray] | None:
        """The columns of a shard's file; None where no words or pairs are in the shard."""
        at = kind.name, shard
        if at not in self.c.manifest:
            return None
        if at not in self.files:
            path = f"{self.c.folder}/{kind.name}-{shard}"
            size = os.path.getsize(path) if os.path.exists(path) else None
            if size != self.c.manifest[at]:
                raise FileNotFoundError(f"{path} has {size} bytes where {self.c.manifest[at]} were written: is spark.checkpoint.dir (or the folder passed) mounted on all workers?")
            self.files[at] = _mapped(path, kind)
            if len(self.files) > _OPEN:
                self.files.popitem(last=False)
        return self.files[at]

    def look_up(self, kind: Kind, by: np.ndarray) -> list[np.ndarray]:
        """The sums beside each key, 0 where it is missing."""
        bits = max(0, self.c.bits[kind.name] - SHARD_BITS)
        order = np.argsort(by, kind="stable")
        out = [np.zeros(len(by), dtype=np.float64) for _ in range(kind.sums)]
        shard = cell_of(by[order], bits)
        starts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else []
        for a, b in zip(starts, np.append(starts[1:], len(shard))):
            file = self._file(kind, int(shard[a]))
            if file is None:
                continue
            mine = order[a:b]
            at = np.searchsorted(file[0], by[mine])
            ok = at < len(file[0])
            ok[ok] = file[0][at[ok]] == by[mine][ok]
            for o, f in zip(out, file[1 : 1 + kind.sums]):
                o[mine[ok]] = f[at[ok]]
            if kind is PAIRS and (out[0][mine] == 255).any():
                large = mine[out[0][mine] == 255]
                out[0][large] = file[3][np.searchsorted(file[2], by[large])]
        return out

    def score(self, texts: list[list[bytes]]) -> list[tuple[int, int, float, float]]:
        """(n_tokens, n_known, base_score, score) of each text, given as words."""
        c = self.c
        index: dict[bytes, int] = {}
        hashes = Hashes()
        seq: list[int] = []
        for ws in texts:
            seq += [index.setdefault(w, len(index) + 2) for w in ws]
            seq.append(1)
        h = np.fromiter((1, 2, *(hashes[w] for w in index)), dtype=np.uint64, count=len(index) + 2)
        tok, before, once, twice, more = self.look_up(WORDS, word_key(h))
        d, low = c.discounts, c.low_discounts
        as_context = tok.copy()
        as_context[0], as_context[1] = c.texts, 0
        rest = np.where(as_context > 0, (d[1] * once + d[2] * twice + d[3] * more) / np.maximum(as_context, 1), 1.0)
        p1 = np.maximum(before - low[np.minimum(before, 3).astype(int)], 0) / max(c.pairs, 1) + c.low_rest / (c.v + 1)
        w = np.array(seq, dtype=np.int64)
        lengths = np.array([len(x) + 1 for x in texts])
        starts = np.cumsum(lengths) - lengths
        u = np.append(0, w[:-1])
        u[starts] = 0
        both = (as_context[u] > 0) & (tok[w] > 0)
        n2 = np.zeros(len(w))
        keys = pair_hash(h[u[both]], h[w[both]])
        (n2[both],) = self.look_up(PAIRS, keys)
        p2 = np.maximum(n2 - d[np.minimum(n2, 3).astype(int)], 0) / np.maximum(as_context[u], 1) + rest[u] * p1[w]
        base = np.log10((tok + 1) / (c.n + c.v + 1))
        sums = [np.add.reduceat(x, starts) for x in ((tok[w] > 0).astype(np.int64), base[w], np.log10(p2))]
        return list(zip(lengths.tolist(), *(x.tolist() for x in sums)))


def score(docs: DataFrame, counted: Counted) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity) for each row of docs."""
    names = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(counted)
        for b in batches:
            rows, block, held = [], [], 0
            for t in b.column(1):
                block.append(tokens(t.as_py()))
                held += len(block[-1]) + 1
                if held >= _TOKENS:
                    rows += model.score(block)
                    block, held = [], 0
            if block:
                rows += model.score(block)
            n, known, base, own = zip(*rows) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array([counted.n] * len(n), pa.int64()), pa.array(base, pa.float64()), pa.array(own, pa.float64())], names)

    out = in_arrow(docs.select(F.col("doc_id").cast("long"), text_of().alias("text")), run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def op7_lm_scoring(docs: DataFrame) -> DataFrame:
    held_out = fold("doc_id", 7) == 2
    return score(docs, count(docs.where(~held_out))).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
