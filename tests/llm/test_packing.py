import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tarnfold.llm import packing


def one_by_one(lengths, size):
    """Best-fit decreasing as a loop: the bins' free places."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [(free, i) for i, free in enumerate(bins) if free >= n]
        if fit:
            bins[min(fit)[1]] -= n
        else:
            bins.append(size - n)
    return sorted(bins)


def test_histogram_packing_equals_one_by_one():
    rnd = random.Random(2)
    for _ in range(300):
        size = rnd.choice([5, 16, 50])
        lengths = [rnd.randint(1, size) for _ in range(rnd.randint(0, 60))]
        counts = {n: lengths.count(n) for n in set(lengths)}
        runs, sequences = packing.pack_histogram(counts, size)
        places = {}
        for n, c in counts.items():
            own = sorted(r for r in runs if r[0] == n)
            for rank in range(c):
                r = [r for r in own if r[1] <= rank][-1]
                nth = rank - r[1]
                places.setdefault(r[2] + nth // r[3], []).append((r[4] + nth % r[3] * n, n))
        free = []
        for items in places.values():
            at = 0
            for offset, n in sorted(items):
                assert offset == at
                at += n
            free.append(size - at)
        assert sorted(free) == one_by_one(lengths, size) and len(places) == sequences


def test_tightest_finds_the_smallest_open_capacity():
    tree, open_ = packing.Capacities(100), set()
    rnd = random.Random(4)
    for _ in range(2000):
        c = rnd.randint(1, 100)
        tree.mark(c, c not in open_)
        open_ ^= {c}
        least = rnd.randint(1, 100)
        assert tree.tightest(least) == min((x for x in open_ if x >= least), default=None)


def test_query_packs_whole_texts(odd_docs, odd_rows):
    tok = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    tok.encode_special_tokens = True
    want = []
    for r in odd_rows:
        ids = tok.encode(r[1] or "", add_special_tokens=False).ids + [0]
        for k, (a, n) in enumerate(packing.cuts(len(ids), 2048)):
            want.append((r[0], k, a, n, zlib.crc32(np.array(ids[a : a + n], dtype="<u4").tobytes())))
    got = packing.op4_best_fit_packing(odd_docs).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    at = {}
    for r in got:
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in at.values():
        end = 0
        for offset, n in sorted(items):
            assert offset == end
            end += n
        assert end <= 2048
    assert len(at) == len(one_by_one([w[3] for w in want], 2048))


def test_fast_ids_are_the_librarys(spark):
    path, ranks = str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    exact = Tokenizer.from_file(path)
    exact.encode_special_tokens = True
    encode = packing.encoder(path, ranks)
    rnd = random.Random(6)
    alphabet = "".join(map(chr, range(1, 0x250))) + " \n\t'sd" * 40
    texts = ["".join(rnd.choices(alphabet, k=80)) for _ in range(2000)] + ["<|endoftext|> x", "日本 🎉", "     a", "  lead", "trail  ", "\r\n\r\n", "don't 'LL"]
    for t in texts:
        assert encode(t) == exact.encode(t, add_special_tokens=False).ids, t


def test_assembled_sequences_hold_every_id(spark):
    docs = spark.createDataFrame([(i, "some words here " * (i % 40)) for i in range(300)], "doc_id long, text string")
    packed = packing.best_fit(docs, size=128, with_ids=True)
    rows = packed.collect()
    whole = {r.sequence_id: r.ids for r in packing.assemble(packed).collect()}
    for r in rows:
        assert whole[r.sequence_id][r.offset : r.offset + r.length] == r.ids
    assert sum(map(len, whole.values())) == sum(r.length for r in rows)


def test_empty_table(no_docs):
    out = packing.op4_best_fit_packing(no_docs)
    assert out.collect() == [] and out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


@pytest.mark.parametrize("n, want", [(1, [(0, 1)]), (2048, [(0, 2048)]), (2049, [(0, 1), (1, 2048)]), (5000, [(0, 904), (904, 2048), (2952, 2048)])])
def test_cuts(n, want):
    assert packing.cuts(n, 2048) == want


def test_both_ways_of_encoding_agree_on_odd_strings():
    """Control characters, strings that name special tokens, long runs of one character, every code point of the fast way."""
    ranks = str(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    special = [t.content for t in tok.get_added_tokens_decoder().values()] or ["<|endoftext|>"]
    texts = ["".join(map(chr, range(0x250))), "".join(chr(i) + "a " for i in range(0x250)), "\x00\x01\x1f\x7f\x80\x9f\xa0\xad", "\r\n\r\r\n \t\v\f  \n", "a" * 20_000, " " * 20_000, "\n" * 5_000, "!" * 9_999, "7" * 9_999, "é" * 5_000, "aB" * 9_999,
             "it's we'll I'D they'VE 'S'", "x\u200by 日本 \U0001f600 \u0301", *special, *[f"a{t}b {t} {t}{t}" for t in special], "</s>[INST]<s><|im_start|>"]
    encode = packing.encoder(path, ranks)
    for t in texts:
        assert encode(t) == tok.encode(t, add_special_tokens=False).ids, t[:50]
