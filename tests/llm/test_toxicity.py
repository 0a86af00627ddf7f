import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnfold.llm import toxicity

START, MOVE = np.array([0.7, 0.3]), np.array([[0.8, 0.3], [0.4, 0.9]])


def brute(e):
    z, m, pair = 0.0, np.zeros(len(e)), np.zeros((2, 2))
    for y in itertools.product([0, 1], repeat=len(e)):
        w = START[y[0]] * np.exp(e[0] * y[0])
        for i in range(1, len(e)):
            w *= MOVE[y[i - 1], y[i]] * np.exp(e[i] * y[i])
        z += w
        m += w * np.array(y)
        for a, b in zip(y, y[1:]):
            pair[a, b] += w
    return m / z, pair / z


def test_marginals_equal_brute_force():
    rng = np.random.default_rng(3)
    lengths = [1, 5, 2, 8, 1, 9]
    e = rng.normal(size=sum(lengths)) * 3
    ends = np.cumsum(lengths)
    first = np.zeros(len(e), dtype=bool)
    first[ends - lengths] = True
    p, moves = toxicity.marginals(e, first, START, MOVE, pairs=True)
    want = [brute(x) for x in np.split(e, ends[:-1])]
    assert np.allclose(p, np.concatenate([w[0] for w in want]))
    assert np.allclose(moves, sum(w[1] for w in want))


def corpus(n, seed):
    rnd = random.Random(seed)
    plain = [f"w{i}" for i in range(300)]
    out = []
    for i in range(n):
        words = [rnd.choice(plain) for _ in range(rnd.randint(5, 60))]
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                words.insert(rnd.randint(0, len(words)), rnd.choice(["idiot", "Moron!", f"vlek{rnd.randint(0, 10**6)}"]))
        out.append((i, " ".join(words), int(bad)))
    return out


@pytest.fixture(scope="module")
def learnt(spark):
    rows = corpus(1200, 1)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    return docs, labels, {r[0]: r[2] for r in rows}


def test_held_out_accuracy(learnt):
    docs, labels, truth = learnt
    got = toxicity.op9_toxicity(docs, labels).collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 300 and sum(r.predicted != truth[r.doc_id] for r in held) <= 0.02 * len(held)


def test_labels_of_held_out_rows_are_not_read(learnt):
    docs, labels, _ = learnt
    lied = labels.withColumn("toxic", F.when(toxicity.fold("doc_id", 3) == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = {r.doc_id: r.score for r in toxicity.op9_toxicity(docs, labels).collect()}
    b = {r.doc_id: r.score for r in toxicity.op9_toxicity(docs, lied).collect()}
    assert a == b


def test_spans_are_offending_tokens(learnt):
    docs, labels, truth = learnt
    for r in toxicity.op9_toxicity(docs, labels).join(docs, "doc_id").limit(200).collect():
        for s in r.spans:
            assert any(b in r.text[s.start : s.end].lower() for b in ("idiot", "moron", "vlek"))


def test_scores_do_not_depend_on_batches(learnt):
    docs, labels, _ = learnt
    texts = [r.text for r in docs.limit(50).collect()] + ["", "idiot", "a " * 5000 + "moron"]
    model = toxicity.learn(docs, labels)
    tagger = toxicity.Tagger(model)
    together = tagger.tag(texts)
    for t, p in zip(texts, together):
        assert np.allclose(p, tagger.tag([t])[0], atol=1e-9)


def test_odd_rows(spark, odd_docs, odd_rows, no_docs, learnt):
    labels = spark.createDataFrame([(0, 1), (None, 1), (5, None), (99, 1)], "doc_id long, toxic int")
    got = toxicity.op9_toxicity(odd_docs, labels).collect()
    assert len(got) == len(odd_rows) and all(r.score == 0 and r.predicted == 0 for r in got)
    model = toxicity.learn(learnt[0], learnt[1])
    scored = toxicity.score(odd_docs, model).collect()
    assert len(scored) == len(odd_rows) and all(0 <= r.score <= 1 for r in scored)
    assert toxicity.score(no_docs, model).collect() == []
    assert toxicity.learn(no_docs, labels) is None
    assert toxicity.drop_toxic(odd_docs, model).count() == sum(r.predicted == 0 for r in scored)


def test_long_texts_are_learnt_from(spark):
    """600 documents of 900 words, a third of them toxic; and one clean text that is longer than all others together."""
    rnd = random.Random(4)
    rows = []
    for i in range(600):
        words = [f"w{rnd.randrange(300)}" for _ in range(900)]
        for _ in range(3 * (i % 3 == 0)):
            words.insert(rnd.randrange(900), rnd.choice(["idiot", "Moron!"]))
        rows.append((i, " ".join(words), int(i % 3 == 0)))
    rows.append((600, " ".join(f"w{rnd.randrange(300)}" for _ in range(600_000)), 0))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.op9_toxicity(docs, labels).collect()}
    assert sum(got[i] != y for i, _, y in rows) <= 3


def test_shares_of_words():
    assert toxicity.most_words([5, 5, 5], 15) == float("inf") and toxicity.most_words([], 9) == float("inf")
    assert toxicity.most_words([1, 100, 100], 21) == 10 and toxicity.most_words([100], 30) == 30


def test_passages_are_drawn_from_the_whole_text(spark):
    text = " ".join(f"w{i}" for i in range(50_050))
    got = spark.createDataFrame([(text, "a  b\n")], "t string, s string").select(toxicity.passages(F.col("t"), F.lit(0.2)).alias("p"), toxicity.passages(F.col("t"), F.lit(1.0)).alias("all"), toxicity.passages(F.col("s"), F.lit(1.0)).alias("s")).first()
    assert " ".join(got.all) == text and got.s == ["a b"]
    starts = [int(p.split()[0][1:]) for p in got.p]
    assert set(got.p) <= set(got.all) and 60 < len(got.p) < 140 and min(starts) < 5_000 and max(starts) > 45_000


def test_gradient_by_finite_differences():
    """The steps of `fit` follow the penalised likelihood: its gradient is expected counts less gold ones."""
    rng = np.random.default_rng(5)
    lengths = [4, 1, 6]
    ends = np.cumsum(lengths)
    first = np.zeros(ends[-1], dtype=bool)
    first[ends - lengths] = True
    gold = rng.integers(0, 2, ends[-1])
    e = rng.normal(size=ends[-1])

    def log_likelihood(e, start, move):
        total = 0.0
        for x, y in zip(np.split(e, ends[:-1]), np.split(gold, ends[:-1])):
            weight = lambda s: np.log(start[s[0]]) + sum(x * s) + sum(np.log(move[a, b]) for a, b in zip(s, s[1:]))  # noqa: E731, B023
            total += weight(y) - np.log(sum(np.exp(weight(np.array(s))) for s in itertools.product([0, 1], repeat=len(x))))
        return total

    p, moves = toxicity.marginals(e, first, START, MOVE, pairs=True)
    h = 1e-6
    for i in range(len(e)):
        step = np.eye(len(e))[i] * h
        assert (log_likelihood(e + step, START, MOVE) - log_likelihood(e - step, START, MOVE)) / (2 * h) == pytest.approx(gold[i] - p[i], abs=1e-5)
    pairs = np.zeros((2, 2))
    for y in np.split(gold, ends[:-1]):
        for a, b in zip(y, y[1:]):
            pairs[a, b] += 1
    for a, b in itertools.product([0, 1], repeat=2):
        up, down = MOVE.copy(), MOVE.copy()
        up[a, b] *= np.exp(h)
        down[a, b] *= np.exp(-h)
        assert (log_likelihood(e, START, up) - log_likelihood(e, START, down)) / (2 * h) == pytest.approx((pairs - moves)[a, b], abs=1e-5)


def test_scores_equal_brute_force(spark, learnt):
    """Emissions from the weights, marginals by enumeration, and the document's logistic, all written out."""
    docs, labels, _ = learnt
    model = toxicity.learn(docs, labels)
    texts = ["w1 idiot w2", "w3", "Moron! w4 vlek123456 w5 w6 moron", "", "w7 w8 w9 vlekzzz w1"]
    got = [r.score for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), model).orderBy("doc_id").collect()]
    a, b, c = model.document
    for text, score in zip(texts, got):
        words = text.encode().lower().split()
        e = np.array([sum(model.weights.get(f, 0.0) for f in toxicity.features(w)) for w in words])
        z, m = 0.0, np.zeros(len(words))
        for y in itertools.product([0, 1], repeat=len(words)) if words else ():
            weight = model.start[y[0]] * np.exp(sum(x * s for x, s in zip(e, y))) * np.prod([model.move[s, t] for s, t in zip(y, y[1:])])
            z, m = z + weight, m + weight * np.array(y)
        best = {}
        for w, p in zip(words, m / z if words else ()):
            if p > 0.02:
                best[w.strip(b"!")] = max(best.get(w.strip(b"!"), 0.0), p)
        seen = min(6.0, -sum(np.log(1 - min(p, 0.9999)) for p in best.values()))
        assert score == pytest.approx(1 / (1 + np.exp(-(a + b * seen + c * np.log(1 + len(words))))) if words else 0.0, abs=1e-6)
