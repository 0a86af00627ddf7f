"""Language identification by nearest centroids of TF-IDF n-gram vectors.

A text's vector counts its character n-grams (1 to 3 characters of the lowered text, anything but
letters taken as one gap) in hashed dimensions, damped, weighted by inverse document frequency and
normalised. Document frequencies are counted over every training document, with one partial array for
each task. Each language gets several centroids: spherical k-means over a bounded sample of its different training
documents (about SAMPLE a language, by hash; fewer where there are many languages, SAMPLE_ALL in all), on the workers. The
model holds the CENTROIDS_ALL centroids that the driver and each worker have room for: with more than a quarter as many languages each
gets fewer, and beyond CENTROIDS_ALL values of lang the rarest ones are not learnt (so a column of dirt is no error). A text takes the language of the centroid of highest
cosine; it is rejected where that cosine is below `least`, a low quantile of the training sample's own.

Defined results: `und` and score 0 for a null text, a text without letters, and where there is nothing to
learn from. Training rows have a non-null lang and text; a null id counts as the empty text in the fold.
Repeated rows get equal results; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfold.llm.common import drawn, fold, in_arrow, text_of

DIMS = 1 << 12
SAMPLE = 400
CENTROIDS = 4
REJECT_QUANTILE = 0.002
SAMPLE_ALL, CENTROIDS_ALL = 40_000, 8_000
_CHARS = 1 << 18  # characters counted at once

_letters: np.ndarray | None = None


def _classes() -> np.ndarray:
    """For each code point its lowered letter, or 0 for what is no letter."""
    global _letters
    if _letters is None:
        points = np.zeros(0x110000, dtype=np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                points[i] = ord(low) if len(low) == 1 else i
        _letters = points
    return _letters


def counts(texts: list[str]) -> np.ndarray:
    """[n, DIMS] n-gram counts of whole texts; float32."""
    out = np.zeros((len(texts), DIMS), dtype=np.float32)
    at = 0
    while at < len(texts):
        block, n = [], 0
        while at + len(block) < len(texts) and (not block or n + len(texts[at + len(block)]) < _CHARS):
            block.append(texts[at + len(block)])
            n += len(block[-1])
        if len(block) == 1 and n > _CHARS:  # one very long text, in parts that overlap by the longest n-gram
            t = block[0]
            for a in range(0, n, _CHARS):
                out[at] += _count([t[max(0, a - 2) : a + _CHARS]], skip=min(a, 2), gap="\n\n" * (a + _CHARS >= n))[0]
        else:
            out[at : at + len(block)] = _count(block)
        at += len(block)
    return out


def _count(block: list[str], skip: int = 0, gap: str = "\n\n") -> np.ndarray:
    """Counts for texts laid end to end, a gap after each; skip: n-grams that end in the first characters don't count."""
    joined = gap.join([*block, ""])
    c = _classes()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    lengths = np.array([len(t) for t in block], dtype=np.int64)
    row = np.repeat(np.arange(len(block)), lengths + len(gap))
    if not len(c):
        return np.zeros((len(block), DIMS))
    prev, before = np.empty_like(c), np.empty_like(c)
    prev[0], prev[1:] = 0, c[:-1]
    before[0], before[1:] = 0, prev[:-1]
    letter = c > 0
    hit = letter | (prev > 0)  # n-grams with a letter in the last two places: single gaps count once, gaps alone never
    if skip:
        letter[:skip] = hit[:skip] = False
    row *= DIMS
    one = c * np.uint32(0x9E3779B1)
    two = (one ^ (prev * np.uint32(0x85EBCA77))) * np.uint32(0xC2B2AE3D)
    three = (two ^ (before * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
    shift = np.uint32(33 - DIMS.bit_length())
    keys = np.concatenate([row[letter] + ((one * np.uint32(0x27D4EB2F)) >> shift)[letter], row[hit] + (two >> shift)[hit], row[hit] + (three >> shift)[hit]])
    return np.bincount(keys, minlength=len(block) * DIMS).reshape(len(block), DIMS)


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts(texts))
    x *= idf
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def _by_chars(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts that together have few enough rows for one dense block."""
    for a in range(0, len(texts), 128):
        yield a, min(a + 128, len(texts))


def document_frequencies(train: DataFrame) -> tuple[np.ndarray, int]:
    """In how many training texts each dimension occurs, and how many texts there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIMS, dtype=np.int64), 0
        for b in batches:
            texts = b.column(0).to_pylist()
            for a, z in _by_chars(texts):
                df += (counts(texts[a:z]) > 0).sum(axis=0)
            n += len(texts)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, DIMS), pa.int32()), pa.array(np.append(n, df))], ["dim", "n"])

    rows = in_arrow(train.select("lid_text"), run, "dim int, n long").groupBy("dim").agg(F.sum("n")).collect()  # DIMS + 1 rows
    found = dict(map(tuple, rows))
    return np.array([found.get(i, 0) for i in range(DIMS)], dtype=float), found.get(-1, 0)


def k_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of unit length, from starts that are spread out; deterministic."""
    k = min(k, len(x))
    chosen = [x.mean(axis=0)]
    while len(chosen) < k:
        chosen.append(x[np.argmin((x @ np.stack(chosen).T).max(axis=1))])
    c = np.stack(chosen)
    for _ in range(rounds):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        near = (x @ c.T).argmax(axis=1)
        c = np.stack([x[near == i].mean(axis=0) if (near == i).any() else c[i] for i in range(k)])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


class Model:
    def __init__(self, idf, centroids, languages, least):
        self.idf, self.centroids, self.languages, self.least = idf, centroids, languages, least


def learn(docs: DataFrame) -> Model | None:
    """The model from folds 0, 1 and 3 of 4 with a lang; None if there are none."""
    t = docs.select(F.col("doc_id").alias("lid_id"), F.col("lang").alias("lid_lang"), F.col("text").alias("lid_text"))
    train = t.where((fold("lid_id", 4) != 2) & F.col("lid_lang").isNotNull() & F.col("lid_text").rlike(r"\p{L}"))
    df, n = document_frequencies(train)
    if not n:
        return None
    idf = (np.log((1 + n) / (1 + df)) + 0.05).astype(np.float32)
    langs = train.groupBy("lid_lang").count().orderBy(F.desc("count"), "lid_lang").limit(CENTROIDS_ALL).collect()
    each = min(SAMPLE, max(2 * CENTROIDS, SAMPLE_ALL // len(langs)))
    most = max(1, min(CENTROIDS, CENTROIDS_ALL // len(langs)))
    shares = docs.sparkSession.createDataFrame([(lang, each / many) for lang, many in langs], "l2 string, share double")
    picked = train.join(F.broadcast(shares), F.col("lid_lang") == F.col("l2")).where(drawn(F.col("share"), "lid_id", "lid_text"))
    # Copies of one row are drawn together and count once, so a language's sample stays small.
    sample = picked.groupBy("lid_lang", F.xxhash64("lid_id", "lid_text").alias("h")).agg(F.min("lid_text").alias("lid_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for a, z in _by_chars(texts):
                x = vectors(texts[a:z], idf).astype(np.float16)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, z - a), pa.array([r.tobytes() for r in x], pa.binary())], ["lang", "x"])

    def clustered(table: pa.Table) -> pa.Table:
        """The centroids of one language's sample, and how near its texts are to them."""
        x = np.stack([np.frombuffer(v, dtype=np.float16) for v in sorted(table["x"].to_pylist())]).astype(np.float32)
        c = k_means(x, most)
        return pa.table({"lang": [table["lang"][0].as_py()], "c": pa.array([[r.tobytes() for r in c]], pa.list_(pa.binary())), "own": pa.array([(x @ c.T).max(axis=1).tolist()], pa.list_(pa.float64()))})

    vectors_of = in_arrow(sample.select("lid_lang", "lid_text"), run, "lang string, x binary")
    rows = sorted(vectors_of.groupBy("lang").applyInArrow(clustered, "lang string, c array<binary>, own array<double>").collect())  # a row for each language learnt
    centroids = np.stack([np.frombuffer(c, dtype=np.float32) for r in rows for c in r.c])
    return Model(idf, centroids, [r.lang for r in rows for _ in r.c], float(np.quantile(np.concatenate([r.own for r in rows]), REJECT_QUANTILE)))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for each row: score is the best cosine, rejected if that is too far off."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIMS numbers for each of at most CENTROIDS_ALL centroids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts, has = b.column(1).to_pylist(), np.array(b.column(2).to_pylist(), dtype=bool)
            lang, score = np.full(len(texts), "und", dtype=object), np.zeros(len(texts))
            rejected = np.ones(len(texts), dtype=bool)
            for a, z in _by_chars(texts) if m else ():
                cos = vectors(texts[a:z], m.idf) @ m.centroids.T
                best = cos.argmax(axis=1)
                top = np.clip(cos[np.arange(z - a), best], 0, 1)
                lang[a:z] = np.where(has[a:z], np.array(m.languages, dtype=object)[best], "und")
                score[a:z] = np.where(has[a:z], top, 0.0)
                rejected[a:z] = ~has[a:z] | (top < m.least)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], ["doc_id", "lang_pred", "score", "rejected"])

    t = text_of()
    return in_arrow(docs.select(F.col("doc_id").cast("long"), t.alias("text"), t.rlike(r"\p{L}").alias("has")), run, "doc_id long, lang_pred string, score double, rejected boolean")


def op6_language_id(docs: DataFrame) -> DataFrame:
    return predict(docs, learn(docs)).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")
