import random

import numpy as np
import pytest

from conftest import fold
from tarnfold.llm import langid


def corpus(n, seed=1):
    rnd = random.Random(seed)
    parts = {"en": ["the", "th", "ing", "er", "wh", "ou"], "fr": ["le", "eau", "é", "qu", "ou", "aux"], "de": ["der", "sch", "ung", "ä", "keit", "ei"]}
    out = []
    for i in range(n):
        lang = rnd.choice(list(parts))
        words = ["".join(rnd.choice(parts[lang]) for _ in range(rnd.randint(1, 3))) for _ in range(rnd.randint(8, 60))]
        out.append((i, " ".join(words), lang))
    return out


def test_held_out_accuracy(spark):
    docs = spark.createDataFrame(corpus(900), "doc_id long, text string, lang string")
    got = langid.op6_language_id(docs).join(docs, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 150 and sum(r.lang_pred != r.lang for r in held) <= 0.02 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_lang_of_held_out_rows_is_not_read(spark):
    docs = spark.createDataFrame(corpus(300), "doc_id long, text string, lang string")
    lied = docs.withColumn("lang", langid.F.when(langid.fold("doc_id", 4) == 2, "xx").otherwise(docs.lang))
    a, b = ({r.doc_id: (r.lang_pred, r.score) for r in langid.op6_language_id(d).collect()} for d in (docs, lied))
    assert a == b and "xx" not in {v[0] for v in a.values()}


def test_odd_rows(odd_docs, odd_rows, no_docs):
    got = langid.op6_language_id(odd_docs).collect()
    assert len(got) == len(odd_rows)
    import regex

    und = sorted((r[0] for r in odd_rows if not regex.search(r"\p{L}", r[1] or "")), key=str)
    assert sorted((r.doc_id for r in got if r.lang_pred == "und"), key=str) == und
    assert all(r.score == 0 and r.rejected for r in got if r.lang_pred == "und")
    assert langid.op6_language_id(no_docs).collect() == []


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in langid.op6_language_id(docs).collect()} == {("und", 0.0)}


def test_far_off_texts_are_rejected(spark):
    docs = spark.createDataFrame(corpus(600), "doc_id long, text string, lang string")
    model = langid.learn(docs)
    odd = spark.createDataFrame([(1, "ж" * 40 + " щщщ ыыы эээ"), (2, corpus(3)[0][1])], "doc_id long, text string")
    got = {r.doc_id: r.rejected for r in langid.predict(odd, model).collect()}
    assert got == {1: True, 2: False}


@pytest.mark.parametrize("chars", [17, 1000])
def test_counts_do_not_depend_on_blocks(monkeypatch, chars):
    texts = [r[1] for r in corpus(20)] + ["", "a", "x" * 50, "1 2 3", "é" * 33]
    want = np.concatenate([langid.counts([t]) for t in texts])
    monkeypatch.setattr(langid, "_CHARS", chars)
    assert np.array_equal(langid.counts(texts), want)


def test_a_column_of_dirt_is_no_error(spark, monkeypatch):
    rows = corpus(300) + [(1000 + i, f"odd text number {i}", f"x{i}") for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.op6_language_id(docs).collect()
    assert len(got) == 1000 and {r.lang_pred for r in got if r.doc_id < 300} >= {"en", "fr", "de"}
    monkeypatch.setattr(langid, "CENTROIDS_ALL", 3)  # only the most frequent ones are learnt
    got = langid.op6_language_id(docs).collect()
    assert {r.lang_pred for r in got} == {"en", "fr", "de"}


def test_copies_of_one_row_count_once_in_the_sample(spark):
    rows = corpus(60) + [(7, "the same row again and again", "en")] * 3000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(langid.op6_language_id(docs).collect()) == 3060


def brute_vector(text, idf):
    """TF-IDF by the rule: n-grams of 1 to 3 characters of the lowered text, each non-letter a gap; a dictionary of dimensions."""
    import math

    m32 = 0xFFFFFFFF
    code = lambda c: (ord(c.lower()) if len(c.lower()) == 1 else ord(c)) if c.isalpha() else 0
    cs = [0, 0, *map(code, text), 0, 0]
    shift = 33 - langid.DIMS.bit_length()
    counts = {}
    for i in range(2, len(cs)):
        c, prev, before = cs[i], cs[i - 1], cs[i - 2]
        one = c * 0x9E3779B1 & m32
        two = (one ^ prev * 0x85EBCA77 & m32) * 0xC2B2AE3D & m32
        three = (two ^ before * 0x27D4EB2F & m32) * 0x165667B1 & m32
        dims = [(one * 0x27D4EB2F & m32) >> shift] * (c > 0) + [two >> shift, three >> shift] * (c > 0 or prev > 0)
        for d in dims:
            counts[d] = counts.get(d, 0) + 1
    x = {d: math.log1p(n) * float(idf[d]) for d, n in counts.items()}
    norm = math.sqrt(sum(v * v for v in x.values())) or 1.0
    return {d: v / norm for d, v in x.items()}


def test_query_equals_brute_force(spark, odd_docs):
    """Document frequencies, vectors, the nearest centroid and its cosine from dictionaries; and languages by n-grams that aren't hashed."""
    import math

    rows = corpus(250)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(docs)
    train = [r for r in rows if fold(r[0], 4) != 2]
    df = {}
    for _, t, _ in train:
        for d in brute_vector(t, np.ones(langid.DIMS)):
            df[d] = df.get(d, 0) + 1
    want = [math.log((1 + len(train)) / (1 + df.get(d, 0))) + 0.05 for d in range(langid.DIMS)]
    assert np.allclose(model.idf, want, atol=1e-5)
    got = {r.doc_id: r for r in langid.op6_language_id(docs).collect()}
    plain = {}  # language -> n-gram -> in how many of its training texts
    for _, t, lang in train:
        for g in {t[i : i + n] for n in (1, 2, 3) for i in range(len(t))}:
            plain.setdefault(lang, {}).setdefault(g, 0)
            plain[lang][g] += 1
    agree = 0
    for i, t, _ in rows:
        v = brute_vector(t, model.idf)
        cos = [sum(x * float(c[d]) for d, x in v.items()) for c in model.centroids]
        best = max(range(len(cos)), key=lambda k: cos[k])
        assert got[i].lang_pred == model.languages[best] and got[i].score == pytest.approx(min(max(cos[best], 0), 1), abs=1e-4)
        grams = [t[k : k + n] for n in (1, 2, 3) for k in range(len(t))]
        agree += max(plain, key=lambda lang: sum(math.log((plain[lang].get(g, 0) + 0.5) / (len(train) + 1)) for g in grams)) == got[i].lang_pred
    assert agree >= 0.98 * len(rows)
