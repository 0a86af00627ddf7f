import re

import pytest

from tarnfold.llm import mixing


def brute_targets(sizes):
    """Sources in order -> targets, by sharing again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        if not full:
            return out | {s: weight[s] * level for s in open_}
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def test_query_equals_brute_force(odd_docs, odd_rows):
    n = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for r in odd_rows:
        sizes[r[3]] = sizes.get(r[3], 0) + n(r[1])
    want = brute_targets(sizes)
    source = {(r[0], n(r[1])): r[3] for r in odd_rows}
    got = mixing.op3_source_mixing(odd_docs).collect()
    assert len(got) == len(odd_rows)
    for r in got:
        s = source[r.doc_id, r["size"]]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        assert r.taken <= 2 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.op3_source_mixing(odd_docs).collect()), key=str)


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 1000, 1], [5, 0, 0, 7], [0, 0], [100, 1, 1, 1, 90, 3], [3]])
def test_targets(spark, sizes):
    rows = [(i, f"s{i}", "w " * z) for i, z in enumerate(sizes)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r.source: r.target for r in mixing.targets(mixing.source_sizes(docs)).collect()}
    assert got == pytest.approx(brute_targets({f"s{i}": z for i, z in enumerate(sizes)}))


def test_taken_comes_near_the_target(spark):
    docs = spark.range(6000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'hot' else concat('s', id % 7) end as source", "repeat('w ', cast(1 + id % 9 as int)) as text")
    by = mixing.op3_source_mixing(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    for r in by:
        assert r["sum(taken)"] == pytest.approx(r["max(target)"], rel=0.1)


def test_mix_repeats_rows_and_keeps_columns(odd_docs):
    taken = {}
    for r in mixing.with_rates(odd_docs).select("doc_id", "mix_copies").collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.mix_copies
    out = mixing.mix(odd_docs)
    assert out.columns == odd_docs.columns
    got = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert got == {k: v for k, v in taken.items() if v}


def test_many_sources_take_the_salted_way(odd_docs, monkeypatch):
    want = sorted(map(tuple, mixing.op3_source_mixing(odd_docs).collect()), key=str)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    got = mixing.op3_source_mixing(odd_docs)
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_empty_and_plan(no_docs, odd_docs):
    assert mixing.op3_source_mixing(no_docs).collect() == []
    plan = mixing.op3_source_mixing(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
