import random

import numpy as np
import xxhash

from tarnfold.llm import components, simhash


def brute_fp(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, radius=4):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fs = sorted(fps)
    for i, a in enumerate(fs):
        for b in fs[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def clustered(rnd, centres, each, flips):
    out = set()
    for _ in range(centres):
        c = rnd.getrandbits(64)
        for _ in range(each):
            x = c
            for b in rnd.sample(range(64), rnd.randint(0, flips)):
                x ^= 1 << b
            out.add(x)
    return out


def test_fingerprints_equal_brute_force(odd_rows):
    for r in odd_rows:
        assert simhash.fingerprint(r[1] or "") == brute_fp(r[1])


def test_query_equals_brute_force(odd_docs, odd_rows):
    got = simhash.op10_simhash(odd_docs).collect()
    fp = [brute_fp(r[1]) for r in odd_rows]
    root = brute_components(set(fp))
    least = {}
    for r, f in zip(odd_rows, fp):
        if r[0] is not None:
            least[root[f]] = min(least.get(root[f], r[0]), r[0])
    want = sorted(((r[0], f"{f:016x}", least.get(root[f])) for r, f in zip(odd_rows, fp)), key=str)
    assert sorted(map(tuple, got), key=str) == want


def linked(spark, fps):
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    roots = {r.v % (1 << 64): r.root % (1 << 64) for r in components.components(simhash.links(df)).collect()}
    return {f: roots.get(f, f) for f in fps}


def groups(roots):
    by = {}
    for f, r in roots.items():
        by.setdefault(r, set()).add(f)
    return sorted(map(sorted, by.values()))


def test_links_lose_none(spark):
    rnd = random.Random(7)
    fps = clustered(rnd, 40, 25, 4) | {rnd.getrandbits(64) for _ in range(300)} | {0, (1 << 64) - 1} | {rnd.getrandbits(10) for _ in range(200)}
    assert groups(linked(spark, fps)) == groups(brute_components(fps))


def test_any_plan_finds_every_link(spark, monkeypatch):
    rnd = random.Random(8)
    fps = clustered(rnd, 15, 12, 5) | {rnd.getrandbits(64) for _ in range(100)}
    want = groups(brute_components(fps))
    order = list(range(64))
    rnd.shuffle(order)
    for widths in ([(20, 1), (20, 1), (24, 0)], [(30, 2), (34, 1)], [(16, 1), (16, 0), (16, 0), (16, 0)], [(13, 0), (13, 0), (13, 0), (13, 0), (12, 0)]):
        parts, at = [], 0
        for w, t in widths:
            bits = order[at : at + w]
            parts.append((sum(1 << b for b in bits), t, bits))
            at += w
        assert sum(t + 1 for _, t in widths) == 5
        monkeypatch.setattr(simhash, "plan", lambda *a, parts=parts: parts)
        assert groups(linked(spark, fps)) == want


def test_buckets_stand_and_probe_by_their_own_bits(spark):
    rnd = random.Random(11)
    fps = [rnd.getrandbits(64) for _ in range(40)]
    parts = [(0xFF, 1, list(range(8))), (0xFFFF << 48, 0, list(range(48, 64)))]
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    got = {tuple(x % (1 << 64) for x in r) for r in simhash.buckets(df, parts).collect()}
    assert got == {(m, f & m ^ flip, f) for f in fps for m, t, bits in parts for flip in [0, *[1 << b for b in bits if t]]}


def test_large_buckets_are_split_and_lose_no_link(spark, monkeypatch):
    rnd = random.Random(12)
    low = [rnd.getrandbits(20) for _ in range(150)]  # 44 common bits: all in the same buckets of three parts
    fps = clustered(rnd, 12, 12, 4) | set(low) | {x ^ 1 << rnd.randrange(64) for x in low} | {0, (1 << 64) - 1}
    want = groups(brute_components(fps))
    for most in (40,):
        monkeypatch.setattr(simhash, "LARGEST_BUCKET", most)
        assert groups(linked(spark, fps)) == want
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    parts = [(0xFFFFF << 44, 1, list(range(44, 64))), (0xFFFFF << 24, 0, list(range(24, 44))), (0xFFFFFF, 1, list(range(24)))]
    sizes = simhash.of_bounded_size(simhash.buckets(df, parts), list(range(64)), 4, 20).groupBy("mask", "key").count()
    assert simhash.buckets(df, parts).groupBy("mask", "key").count().agg({"count": "max"}).first()[0] > 100
    assert sizes.agg({"count": "max"}).first()[0] < 80


def test_plans_allocate_all_shares():
    rnd = np.random.default_rng(1)
    sample = rnd.integers(0, 2**63, 500, dtype=np.int64).view(np.uint64)
    for n in (10, 10**5, 10**7, 10**9):
        parts = simhash.plan(sample, n)
        assert sum(t + 1 for _, t, _ in parts) == 5
        bits = [b for _, _, p in parts for b in p]
        assert len(bits) == len(set(bits))
    assert len(simhash.plan(sample, 10**9)) < len(simhash.plan(sample, 10**5))


def test_allocation_is_the_cheapest():
    assert simhash.allocate([[0, 5, 50, 99], [0, 1, 2, 40], [0, 9, 90, 99]], 3) == (7, [1, 2, 0])


def test_spanning_forest_of_a_close_group_is_small():
    rnd = random.Random(9)
    fps = np.array(sorted(clustered(rnd, 1, 3000, 2)), dtype=np.uint64)
    edges = simhash.spanning_forest(fps)
    assert len(edges) == len(fps) - 1


def test_components_of_paths_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 90)] + [(2000 + i, 2000 + (i + 1) % 30) for i in range(30)] + [(5, 5), (7, 6)]
    got = {}
    for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect():
        got.setdefault(r.root, set()).add(r.v)
    assert sorted(map(len, got.values())) == [30, 61, 90]
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_keep_one_of_each_group(odd_docs):
    named = {r.doc_id: r.component_id for r in simhash.op10_simhash(odd_docs).where("doc_id is not null").collect()}
    kept = [r.doc_id for r in simhash.keep_one(odd_docs).collect()]
    assert sorted(k for k in kept if k is not None) == sorted(set(named.values()))
    assert simhash.keep_one(odd_docs).columns == odd_docs.columns


def test_empty_table(no_docs):
    assert simhash.op10_simhash(no_docs).collect() == [] and simhash.keep_one(no_docs).collect() == []
