"""Toxic spans by a linear-chain conditional random field.

The chain has two states, clean and toxic. A token's features are its word and those of its
beginnings that tell toxic words; weights add up to its emission, transitions make spans hang together. The model is learnt on
the driver from a bounded sample of labelled documents: about SAMPLE of them, drawn by hash, with at most about
SAMPLE_WORDS words in each class. Where they have more, the longest give way: passages of PASSAGE words are drawn by hash out
of the whole of each long text, so that texts of any length are learnt from. Labelled tokens are those of toxic documents whose word or beginning is found in toxic documents and
hardly in clean ones. Workers tag every token of every whole text: forward and backward messages of all
texts of a batch run as one chain, cut at the starts of texts, in blocks side by side, so a long text
costs no more per token than short ones. A document's score puts the marginals of its different words together:
with L = -sum log(1 - p), each word at its highest p, a logistic function of L and of the text's length, fitted to the
sample's documents, so that one doubtful word flags no text and several of them do. Offending tokens come back as spans of code points.

Defined results: a null text is empty; a text without words scores 0. Without toxic labels to learn from
every score is 0. Labels of null or of unknown documents are ignored; a document labelled twice counts as
toxic if any label says so. Repeated rows get equal results. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfold.llm.common import WORD, drawn, fold, in_arrow, let, n_words, text_of, written

SAMPLE = 4000
SAMPLE_WORDS = 300_000
PASSAGE = 100
#: In nats: chance gives one in about 10^7 features this.
SURE = 16.0
SEVERAL = 5
BEGINNINGS = (3, 4, 5, 6)
ROUNDS = 30
LEAST_WEIGHT = 0.05
THRESHOLD = 0.7
#: Marginals below count as none; the most that a document without any sign is given, in log-odds.
FAINT, NO_SIGN = 0.02, -3.0
#: The most that L counts for, little more than one word with p = 0.997.
CERTAIN = 6.0
EDGE = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~"
_EDGE = EDGE.encode()
_TOKENS = 1 << 18  # tokens in one pass of forward and backward
_KNOWN = 1 << 18  # words whose emissions a worker keeps


def features(word: bytes) -> list[str]:
    """A word's features: the word and its beginnings, lowered, without punctuation at its ends."""
    w = word.decode("utf-8", "replace").lower().strip(EDGE)
    return ["w" + w] + [f"{n}{w[:n]}" for n in BEGINNINGS if len(w) > n]


def _block_scan(step: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The normalised row vectors (1, 1) @ M[0] @ ... @ M[i] for 2 x 2 matrices M >= 0, given as four arrays.

    The chain is cut into about sqrt(n) blocks. Products within blocks advance side by side, their ends
    are chained, and each block is run again from its right start.
    """
    n = len(step[0])
    size = max(1, int(np.sqrt(n)))
    k = -(-n // size)

    def laid_out(x: np.ndarray, pad: float) -> np.ndarray:
        y = np.full(k * size, pad)
        y[:n] = x
        return np.ascontiguousarray(y.reshape(k, size).T)

    a, b, c, d = (laid_out(x, pad) for x, pad in zip(step, (1.0, 0.0, 0.0, 1.0)))
    p, q, r, s = np.ones(k), np.zeros(k), np.zeros(k), np.ones(k)
    for i in range(size):
        p, q, r, s = p * a[i] + q * c[i], p * b[i] + q * d[i], r * a[i] + s * c[i], r * b[i] + s * d[i]
        z = 1.0 / (p + q + r + s + 1e-300)
        p, q, r, s = p * z, q * z, r * z, s * z
    x, y = np.empty(k), np.empty(k)
    u, v = 0.5, 0.5
    for j, (pj, qj, rj, sj) in enumerate(zip(p.tolist(), q.tolist(), r.tolist(), s.tolist())):
        x[j], y[j] = u, v
        u, v = u * pj + v * rj, u * qj + v * sj
        z = u + v + 1e-300
        u, v = u / z, v / z
    out0, out1 = np.empty((size, k)), np.empty((size, k))
    for i in range(size):
        x, y = x * a[i] + y * c[i], x * b[i] + y * d[i]
        z = 1.0 / (x + y + 1e-300)
        x, y = x * z, y * z
        out0[i], out1[i] = x, y
    return out0.T.ravel()[:n], out1.T.ravel()[:n]


def marginals(emission: np.ndarray, first: np.ndarray, start: np.ndarray, move: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """P(token is toxic) and, if asked for, the sums of expected moves 2 x 2, for texts laid end to end.

    emission: log-odds of each token. first: True at the first token of each text. start, move: the
    chain's potentials (2, and 2 x 2).
    """
    e = np.exp(np.clip(emission, -30, 30))
    one = np.ones(len(e))
    # The same from any state at a text's first token: what stands before is forgotten.
    a, b = np.where(first, start[0], move[0, 0] * one), np.where(first, start[1], move[0, 1]) * e
    c, d = np.where(first, start[0], move[1, 0] * one), np.where(first, start[1], move[1, 1]) * e
    f0, f1 = _block_scan((a, b, c, d))
    # Backwards: from token i to i + 1, move and emission of i + 1; nothing beyond a text's last token.
    last = np.append(first[1:], True)
    back = [np.where(last, 1.0, np.append(x[1:], 1.0))[::-1] for x in (a, c, b, d)]
    g0, g1 = (x[::-1] for x in _block_scan(tuple(back)))
    p0, p1 = f0 * g0, f1 * g1
    p = p1 / (p0 + p1 + 1e-300)
    if not pairs:
        return p, None
    h0, h1 = np.append(0.5, f0[:-1]), np.append(0.5, f1[:-1])
    cells = [h0 * a * g0, h0 * b * g1, h1 * c * g0, h1 * d * g1]
    z = np.where(first, np.inf, sum(cells) + 1e-300)
    return p, np.array([(x / z).sum() for x in cells]).reshape(2, 2)


class Model:
    """Weights of features, potentials of the chain, and (constant, of L, of log length) of a document's score."""

    def __init__(self, weights: dict[str, float], start: np.ndarray, move: np.ndarray, document: tuple[float, float, float] = (NO_SIGN, 1.0, 0.0)):
        self.weights, self.start, self.move, self.document = weights, start, move, document


def markers(words: list[bytes], seq: np.ndarray, first: np.ndarray, toxic: np.ndarray) -> set[str]:
    """Features that tell toxic documents: twenty times as frequent there as in clean ones, and not by chance.

    words: the different words; seq: each token's word; first: True at the first token of each text;
    toxic: of each token's text. A word counts by its different places (between its two neighbours), so
    that copies of a document count about once; a beginning counts by its different words, so that one
    word does not make its beginnings suspect. Beginnings of SEVERAL different words are also held against
    clean documents by their places, ten times as frequent. Chance: a likelihood ratio of the feature's two rates
    against one common rate, over SURE; and three counts at least.
    """
    none = np.int64(len(words))
    before = np.where(first, none, np.append(none, seq[:-1]))
    after = np.where(np.append(first[1:], True), none, np.append(seq[1:], none))
    place = (before.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (seq.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (after.astype(np.uint64) * np.uint64(0xFF51AFD7ED558CCD))
    tokens: tuple[Counter, Counter] = (Counter(), Counter())
    types: tuple[Counter, Counter] = (Counter(), Counter())
    for y in (0, 1):
        own = seq[toxic == y]
        _, at = np.unique(place[toxic == y], return_index=True)
        counts = np.bincount(own[at], minlength=len(words))
        for i in np.flatnonzero(counts):
            tokens[y][features(words[i])[0]] += int(counts[i])
        for name in tokens[y]:
            types[y].update(features(name[1:].encode())[1:])
    several = {f for f, n in types[1].items() if n >= SEVERAL}
    begun: tuple[Counter, Counter] = (Counter(), Counter())
    for y in (0, 1):
        for name, n in tokens[y].items():
            for f in features(name[1:].encode())[1:]:
                if f in several:
                    begun[y][f] += n
    found = set()
    places = (tokens[0].total(), tokens[1].total())
    for counts, total, times in ((tokens, places, 20), (types, (types[0].total(), types[1].total()), 20), (begun, places, 10)):
        n0, n1 = max(1, total[0]), max(1, total[1])
        for f, c1 in counts[1].items():
            c0 = counts[0][f]
            if c1 >= 3 and c1 / n1 > times * c0 / n0:
                both = (c0 + c1) / (n0 + n1)
                if c1 * np.log(c1 / n1 / both) + (c0 * np.log(c0 / n0 / both) if c0 else 0.0) > SURE:
                    found.add(f)
    return found


def signs(text: str, p: np.ndarray) -> dict[bytes, float]:
    """The highest marginal of each different word with a marginal over FAINT."""
    best: dict[bytes, float] = {}
    at = np.flatnonzero(p > FAINT)
    if len(at):
        words = text.encode("utf-8", "replace").lower().split()
        for i in at.tolist():
            w = words[i].strip(_EDGE)
            best[w] = max(best.get(w, 0.0), float(p[i]))
    return best


def together(best: dict[bytes, float]) -> float:
    """L, at most that of one word that is certain: more words than that say no more."""
    return min(CERTAIN, float(-np.log1p(-np.minimum(list(best.values()), 0.9999)).sum())) if best else 0.0


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.01) -> np.ndarray:
    """(constant, weights) of a logistic regression, by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w)), x.T @ (y - p) - penalty * w)
    return w


def with_document_score(model: Model, texts: list[str], toxic: list[int], of: list[int], lengths: list[int]) -> Model:
    """model, its document score fitted: of tells which document each text is a part of, lengths each document's words."""
    best: list[dict[bytes, float]] = [{} for _ in lengths]
    y = np.zeros(len(lengths))
    for text, label, doc, p in zip(texts, toxic, of, Tagger(model).tag(texts)):
        y[doc] = label
        for w, x in signs(text, p).items():
            best[doc][w] = max(best[doc].get(w, 0.0), x)
    a, b, c = logistic(np.column_stack([list(map(together, best)), np.log1p(lengths)]), y)
    # Neither the share of toxic labels nor a text's length may flag what shows no sign.
    return Model(model.weights, model.start, model.move, (min(a, NO_SIGN), max(b, 0.0), min(c, 0.0)))


def fit(texts: list[str], toxic: list[int], rounds: int = ROUNDS) -> Model | None:
    """Maximum likelihood with an L2 penalty, by RProp; None without toxic texts or tokens."""
    ids: dict[bytes, int] = {}
    each = [np.array([ids.setdefault(w, len(ids)) for w in t.encode("utf-8", "replace").lower().split()], dtype=np.int64) for t in texts]
    lengths = np.array([len(x) for x in each], dtype=np.int64)
    if not lengths.sum():
        return None
    seq = np.concatenate(each)
    del each
    first = np.zeros(len(seq), dtype=bool)
    first[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
    tags = np.repeat(np.array(toxic, dtype=np.int64), lengths)
    marked = markers(list(ids), seq, first, tags)
    if not marked:
        return None
    lists = [[f for f in features(w) if f[0] == "w" or f in marked] for w in ids]
    names: dict[str, int] = {}
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    col = np.array([names.setdefault(f, len(names)) for x in lists for f in x])
    is_marker = np.array([any(f in marked for f in x) for x in lists])
    tags = (tags == 1) & is_marker[seq]
    if not tags.any():
        return None
    prev = np.where(first, 0, np.append(0, tags[:-1]).astype(int))
    now = tags.astype(int)
    gold_pairs = np.zeros((2, 2))
    np.add.at(gold_pairs, (prev[~first], now[~first]), 1)
    gold_start = np.bincount(now[first], minlength=2)
    gold_words = np.bincount(seq, weights=now, minlength=len(lists))
    x = np.zeros(len(names) + 6)
    x[-6:] = np.log([0.9, 0.1, 0.9, 0.1, 0.5, 0.5])
    size, was = np.full(len(x), 0.1), np.zeros(len(x))
    for _ in range(rounds):
        w, start, move = x[:-6], np.exp(x[-6:-4]), np.exp(x[-4:]).reshape(2, 2)
        word = np.bincount(row, weights=w[col], minlength=len(lists))
        p, moves = marginals(word[seq], first, start, move, pairs=True)
        diff = gold_words - np.bincount(seq, weights=p, minlength=len(lists))
        g = np.empty_like(x)
        g[:-6] = np.bincount(col, weights=diff[row], minlength=len(names)) - 0.05 * w
        g[-6:-4] = gold_start - np.array([(1 - p[first]).sum(), p[first].sum()])
        g[-4:] = (gold_pairs - moves).ravel() - 0.1 * x[-4:]
        size = np.clip(np.where(g * was > 0, size * 1.2, np.where(g * was < 0, size * 0.5, size)), 1e-4, 1.0)
        x, was = x + np.sign(g) * size * (np.abs(g) > 1e-9), g
    return Model({f: float(w) for f, w in zip(names, x) if abs(w) >= LEAST_WEIGHT}, np.exp(x[-6:-4]), np.exp(x[-4:]).reshape(2, 2))


class Tagger:
    """A worker's tagger, which remembers the emissions of words."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}
        self.weight = lambda f, get=model.weights.get: get(f, 0.0)

    def emission(self, word: bytes) -> float:
        e = self.known.get(word)
        if e is None:
            if len(self.known) >= _KNOWN:
                self.known.clear()
            e = self.known[word] = sum(map(self.weight, features(word)))
        return e

    def score(self, text: str, p: np.ndarray) -> float:
        """The document's score from its tokens' marginals; 0 without tokens."""
        a, b, c = self.model.document
        return 1 / (1 + math.exp(-min(max(a + b * together(signs(text, p)) + c * math.log1p(len(p)), -30.0), 30.0))) if len(p) else 0.0

    def tag(self, texts: list[str]) -> list[np.ndarray]:
        """P(toxic) of each token of each text."""
        out: list[np.ndarray] = []
        block: list[list[float]] = []
        held = 0
        for t in texts:
            block.append([self.emission(w) for w in t.encode("utf-8", "replace").lower().split()])
            held += len(block[-1])
            if held >= _TOKENS:
                out += self._run(block)
                block, held = [], 0
        return out + self._run(block)

    def _run(self, block: list[list[float]]) -> list[np.ndarray]:
        lengths = np.array([len(b) for b in block], dtype=np.int64)
        ends = np.cumsum(lengths)
        if not len(block) or not ends[-1]:
            return [np.zeros(0) for _ in block]
        first = np.zeros(ends[-1], dtype=bool)
        first[(ends - lengths)[lengths > 0]] = True
        e = np.fromiter((x for b in block for x in b), dtype=float, count=int(ends[-1]))
        p, _ = marginals(e, first, self.model.start, self.model.move)
        return np.split(p, ends[:-1])


_WORD = re.compile(r"[^\x20\x09-\x0d]+")


def spans_of(text: str, p: np.ndarray, at_least: float = 0.5) -> list[tuple[int, int]]:
    """(start, end) in code points of each run of tokens with P(toxic) >= at_least."""
    spans: list[tuple[int, int]] = []
    if not (p >= at_least).any():
        return spans
    was = False
    for m, x in zip(_WORD.finditer(text), p):
        if x >= at_least and was:
            spans[-1] = (spans[-1][0], m.end())
        elif x >= at_least:
            spans.append(m.span())
        was = x >= at_least
    return spans


def most_words(lengths: list[int], budget: int) -> float:
    """The words that each text may give at most for all to give `budget` together; infinity if they have no more."""
    left, lengths = budget, sorted(lengths)
    for i, n in enumerate(lengths):
        level = left / (len(lengths) - i)
        if n > level:
            return level
        left -= n
    return float("inf")


def passages(text: Column, share: Column) -> Column:
    """The passages of PASSAGE words that a hash of place and contents draws, `share` of them, in order."""
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), 1)
    cut = lambda ws: F.transform(F.sequence(F.lit(0), F.floor((F.size(ws) - 1) / PASSAGE).cast("int")), lambda i: F.array_join(F.slice(ws, i * PASSAGE + 1, PASSAGE), " "))
    return let(words, lambda ws: F.filter(cut(ws), lambda p, i: drawn(share, p, i)))


def learn(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The model, from labelled rows of folds 0 and 2 of 3: at most about SAMPLE, by hash, half of them toxic.

    The ids are drawn from the labels alone, so that texts are not shuffled; different texts count once, and of one id's
    texts too only about a bounded number is drawn. What reaches the driver is bounded by SAMPLE and SAMPLE_WORDS.
    """
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", 3) != 1)).groupBy(F.col("doc_id").cast("long").alias("tox_id")).agg(F.max(F.col("toxic") > 0).cast("int").alias("tox_label"))
    by_label = lambda share: F.when(F.col("tox_label") == 1, share(1)).otherwise(share(0))
    many = dict(map(tuple, marks.groupBy("tox_label").count().collect()))
    picked = marks.where(drawn(by_label(lambda y: min(1.0, SAMPLE / many.get(y, 1))), "tox_id"))  # about 2 * SAMPLE rows
    d = docs.select(F.col("doc_id").cast("long").alias("tox_id"), text_of().alias("tox_text"))
    words = n_words(F.col("tox_text"))
    labelled = d.join(F.broadcast(picked), "tox_id").select(F.xxhash64("tox_text").alias("h"), "tox_text", "tox_label", words.alias("n")).where("n > 0")
    labelled = written(labelled, "labelled")
    # A text counts once, as toxic if any of its rows is; half of SAMPLE in each class, by hash.
    texts = written(labelled.groupBy("h").agg(F.max("tox_label").alias("tox_label"), F.max("n").alias("n")), "labelled")
    found = dict(map(tuple, texts.groupBy("tox_label").count().collect()))
    used = texts.where(drawn(by_label(lambda y: min(1.0, SAMPLE / 2 / found.get(y, 1))), "h", F.lit("text")))
    lengths: dict[int, list[int]] = {0: [], 1: []}
    for y, n in used.select("tox_label", "n").collect():  # about SAMPLE rows
        lengths[y].append(n)
    most = by_label(lambda y: most_words(lengths[y], SAMPLE_WORDS))
    chosen = labelled.select("h", "tox_text").join(F.broadcast(used), "h").groupBy("h", "tox_label", "n").agg(F.min("tox_text").alias("tox_text"))
    whole = chosen.where(F.col("n") <= most).select("h", "n", "tox_label", F.array("tox_text").alias("parts"))
    cut = chosen.where(F.col("n") > most).select("h", "n", "tox_label", passages(F.col("tox_text"), most / F.col("n")).alias("parts"))
    rows = whole.unionByName(cut).select("h", "n", "tox_label", F.posexplode("parts").alias("at", "part")).collect()  # about 2 * SAMPLE_WORDS words
    rows.sort(key=lambda r: (r.h, r.at))
    parts, marked = [r.part for r in rows], [r.tox_label for r in rows]
    model = fit(parts, marked)
    if model is None:
        return None
    docs_at = {h: i for i, h in enumerate(dict.fromkeys(r.h for r in rows))}
    lengths_of = {r.h: r.n for r in rows}
    return with_document_score(model, parts, marked, [docs_at[r.h] for r in rows], [lengths_of[h] for h in docs_at])


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text_hash, score, predicted, spans) for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the words of the sample
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value) if shared.value else None
        for b in batches:
            texts = b.column(2).to_pylist()
            ps = tagger.tag(texts) if tagger else [np.zeros(0)] * len(texts)
            best = np.array([tagger.score(t, p) if tagger else 0.0 for t, p in zip(texts, ps)], dtype=float)
            spans = [[{"start": s, "end": e} for s, e in spans_of(t, p)] for t, p in zip(texts, ps)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(best), pa.array((best >= threshold).astype(np.int32)), pa.array(spans, spans_type)], ["doc_id", "text_hash", "score", "predicted", "spans"])

    t = text_of()
    return in_arrow(docs.select(F.col("doc_id").cast("long"), F.xxhash64(t).alias("text_hash"), t.alias("text")), run, "doc_id long, text_hash long, score double, predicted int, spans array<struct<start:long,end:long>>")


def drop_toxic(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score at the threshold or above, columns as they are.

    Rows pass whole through the tagger, so nothing is joined back.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value) if shared.value else None
        for b in batches:
            if tagger and b.num_rows:
                texts = [t or "" for t in b.column(at).to_pylist()]
                b = b.filter(pa.array([tagger.score(t, p) < threshold for t, p in zip(texts, tagger.tag(texts))]))
            yield b

    return in_arrow(docs, run, docs.schema)


def op9_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    s = score(docs, learn(docs, labels))
    return s.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted", "spans")
