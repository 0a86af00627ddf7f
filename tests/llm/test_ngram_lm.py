import math
from collections import Counter

import numpy as np
import pytest

from tarnfold.llm import ngram_lm
from conftest import fold


class Brute:
    """Interpolated modified Kneser-Ney of order two, from dictionaries."""

    def __init__(self, texts):
        self.c, self.pairs = Counter(), Counter()
        for t in texts:
            seq = ["<s>", *ngram_lm.tokens(t), "</s>"]
            self.c.update(seq[1:])
            self.pairs.update(zip(seq, seq[1:]))
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.before = Counter(w for _, w in self.pairs)
        self.follow = {}
        for (u, _), k in self.pairs.items():
            self.follow.setdefault(u, []).append(k)
        self.d = self.discounts(self.pairs.values())
        self.low = self.discounts(self.before.values())

    @staticmethod
    def discounts(counts):
        return ngram_lm.discounts([sum(1 for k in counts if k == i) for i in (1, 2, 3, 4)])

    def p(self, u, w):
        types = len(self.pairs)
        if not types:
            return 1.0
        rest = sum(self.low[min(b, 3)] for b in self.before.values()) / types
        p1 = max(self.before[w] - self.low[min(self.before[w], 3)], 0) / types + rest / (self.v + 1)
        if u not in self.follow:
            return p1
        total = sum(self.follow[u])
        c = self.pairs[u, w]
        return max(c - self.d[min(c, 3)], 0) / total + sum(self.d[min(k, 3)] for k in self.follow[u]) / total * p1

    def row(self, t):
        seq = ["<s>", *ngram_lm.tokens(t), "</s>"]
        base = sum(math.log10((self.c[w] + 1) / (self.n + self.v + 1)) for w in seq[1:])
        return len(seq) - 1, sum(self.c[w] > 0 for w in seq[1:]), base, sum(math.log10(self.p(u, w)) for u, w in zip(seq, seq[1:]))


def check(got, rows):
    model = Brute([t or "" for i, t in rows if fold(i, 7) != 2])
    key = lambda r: str(r[0]) + str(r[1])
    want = sorted([(i, *model.row(t or "")) for i, t in rows], key=key)
    have = sorted([(r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score) for r in got], key=key)
    assert [w[:3] for w in want] == [h[:3] for h in have]
    assert np.allclose([w[3:] for w in want], [h[3:] for h in have], rtol=1e-9)
    assert {r.train_tokens for r in got} == {model.n}
    return model


def test_query_equals_brute_force(odd_docs, odd_rows):
    got = ngram_lm.op7_lm_scoring(odd_docs).collect()
    check(got, [r[:2] for r in odd_rows])
    assert {r.doc_id for r in got if r.held_out} == {r[0] for r in odd_rows if fold(r[0], 7) == 2}


def test_many_shards_and_flushes(spark, monkeypatch):
    import random

    rnd = random.Random(3)
    rows = [(i, " ".join(f"w{int(rnd.paretovariate(0.7))}" for _ in range(rnd.randint(0, 80)))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    monkeypatch.setattr(ngram_lm, "CELL_BYTES", 512)
    model = check(ngram_lm.op7_lm_scoring(docs).collect(), rows)
    vocabulary = [*model.c, "<unknown>"]
    for u in ("<s>", b"w1", b"w3", "never seen"):
        assert sum(model.p(u, w) for w in vocabulary) == pytest.approx(1.0)


@pytest.mark.parametrize("fanout", [2, 4, 12])
def test_cells_in_one_step_and_in_two(spark, odd_docs, odd_rows, monkeypatch, fanout):
    monkeypatch.setattr(ngram_lm, "CELL_BYTES", 1 << 11)
    monkeypatch.setattr(ngram_lm, "FANOUT_BITS", fanout)
    counted = ngram_lm.count(odd_docs)
    assert counted.bits["pairs"] > 4 and len([k for k in counted.manifest if k[0] == "pairs"]) > 4
    check(ngram_lm.op7_lm_scoring(odd_docs).collect(), [r[:2] for r in odd_rows])


def test_frequent_pairs_are_counted_exactly(spark, tmp_path):
    rows = [(i, "a b " * n) for i, n in enumerate((1, 200, 254, 255, 256, 300, 70_000))] + [(10 + i, "c d " * 254) for i in range(2)] + [(20, "e f " * 255)]
    check(ngram_lm.op7_lm_scoring(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)


def test_a_missing_or_short_file_is_an_error(spark, odd_docs, tmp_path):
    counted = ngram_lm.count(odd_docs, f"file://{tmp_path}/model")
    whole = ngram_lm.score(odd_docs, counted).collect()
    assert whole and sorted(f"{k}-{s}" for k, s in counted.manifest) == sorted(p.name for p in (tmp_path / "model").iterdir())
    for kind, shard in list(counted.manifest):
        path = tmp_path / "model" / f"{kind}-{shard}"
        data = path.read_bytes()
        path.write_bytes(data[:-1])
        with pytest.raises(Exception, match="mounted on all workers"):
            ngram_lm.score(odd_docs, counted).collect()
        path.unlink()
        with pytest.raises(Exception, match="mounted on all workers"):
            ngram_lm.score(odd_docs, counted).collect()
        path.write_bytes(data)
    assert ngram_lm.score(odd_docs, counted).collect() == whole


def test_empty_table_and_nothing_to_learn_from(spark, no_docs):
    assert ngram_lm.op7_lm_scoring(no_docs).collect() == []
    i = next(i for i in range(50) if fold(i, 7) == 2)
    got = ngram_lm.op7_lm_scoring(spark.createDataFrame([(i, "a b")], "doc_id long, text string")).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got] == [(3, 0, 0, 0.0, 0.0)]


def test_columns_survive_packing():
    rng = np.random.default_rng(2)
    a = np.sort(rng.integers(0, 2**63, 999).astype(np.uint64))
    b, c = rng.integers(0, 2**63, 999).astype(np.uint64), rng.integers(0, 9, 999).astype(np.uint32)
    got = ngram_lm.unpacked(ngram_lm.packed(a, b, c), 999, np.uint64, np.uint64, np.uint32)
    assert all(np.array_equal(x, y) for x, y in zip(got, (a, b, c)))


def test_a_folder_that_cannot_be_mapped_is_refused(odd_docs):
    with pytest.raises(ValueError, match="memory-mapped"):
        ngram_lm.count(odd_docs, "hdfs://somewhere/else")
