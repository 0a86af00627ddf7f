import numpy as np
import pytest

from tarnfold.llm import ann


def brute(rows, k):
    ok = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok.setdefault(i, np.array(v, dtype=np.float32).astype(float))
    ids = np.array(sorted(ok))
    x = np.stack([ok[i] for i in ids])
    out = {}
    for q in ids[ids % 20 == 0]:
        s = (x * ok[q]).sum(axis=1)
        m = ids != q
        order = np.lexsort((ids[m], -s[m]))[:k]
        out[int(q)] = list(zip(ids[m][order].tolist(), s[m][order].tolist()))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 0.0) for i, v in rows], "vec_id long, embedding array<float>, label int, score double")


def found(df, k=20):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(900, 16)), rng.normal(size=(1, 16)) * 2 + rng.normal(size=(300, 16)) * 0.05])
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    got, want = found(ann.op5_nearest_neighbours(frame(spark, rows))), brute(rows, 20)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    hit = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hit >= 0.9 * 20 * len(want)
    for q, near in got.items():
        for i, s in near:
            assert s == (x[i].astype(np.float32).astype(float) * x[q].astype(np.float32).astype(float)).sum()


def test_a_third_of_equal_vectors(spark):
    rng = np.random.default_rng(5)
    same = [1.0, 0.5, -0.25, 0.0]
    rows = [(i, same if i % 3 == 0 else rng.normal(size=4).astype(np.float32).tolist()) for i in range(600)]
    got, want = found(ann.op5_nearest_neighbours(frame(spark, rows))), brute(rows, 20)
    for q in want:
        if q % 3 == 0:  # their own copies are among the nearest, smallest ids first
            best = want[q][0][1]
            assert [x for x in got[q] if x[1] == best] == [x for x in want[q] if x[1] == best]
    hit = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hit >= 0.9 * 20 * len(want)


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [1.0]), (7, []), (20, [0.5, -0.0]), (None, [1.0, 1.0]), (40, [-1.0, 2.0]), (8, [1.0, 0.0]), (9, [0.5, 0.0])]
    got = found(ann.op5_nearest_neighbours(frame(spark, rows)))
    assert got == {
        0: [(8, 1.0), (9, 0.5), (20, 0.5), (40, -1.0)],
        20: [(0, 0.5), (8, 0.5), (9, 0.25), (40, -0.5)],
        40: [(9, -0.5), (20, -0.5), (0, -1.0), (8, -1.0)],
    }


def test_empty_table_and_no_valid_vector(spark):
    assert ann.op5_nearest_neighbours(frame(spark, [])).collect() == []
    assert ann.op5_nearest_neighbours(frame(spark, [(0, [0.0]), (20, None)])).collect() == []


def test_best_bins_come_in_order_of_branches():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 8))
    tree = ann.Tree(x, leaf=20)
    leaves = next(iter(tree.best_bins(x[:1])))
    order = list(leaves)
    assert sorted(order) == list(range(tree.n_leaves))
    assert order[0] == tree.assign(x[:1])[0]


@pytest.mark.parametrize("group", [4, 100])
def test_groups_of_any_size(spark, monkeypatch, group):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(300)]
    want = found(ann.op5_nearest_neighbours(frame(spark, rows)))
    monkeypatch.setattr(ann, "GROUP", group)
    assert found(ann.op5_nearest_neighbours(frame(spark, rows))) == want


def test_leaves_grow_with_the_table(spark, monkeypatch):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(60, 12)) * 3
    x = (centres[rng.integers(0, 60, 6000)] + rng.normal(size=(6000, 12)) * 0.3).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    monkeypatch.setattr(ann, "SAMPLE", 200)
    monkeypatch.setattr(ann, "LEAF_SAMPLE", 300)
    trees = []
    calibrated = ann._calibrated
    monkeypatch.setattr(ann, "_calibrated", lambda leaved, classes, tree, *a: trees.append((tree, leaved.groupBy("leaf").count().agg({"count": "max"}).first()[0])) or calibrated(leaved, classes, tree, *a))
    got, want = found(ann.op5_nearest_neighbours(frame(spark, rows))), brute(rows, 20)
    (tree, largest), = trees
    assert tree.n_leaves > 100 and largest <= ann.LEAF_SHARE * ann.LEAF
    assert sorted(tree.leaf_of.values()) == list(range(tree.n_leaves)) and sorted(next(iter(tree.best_bins(np.zeros((1, 13)))))) == list(range(tree.n_leaves))
    hit = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hit >= 0.9 * 20 * len(want)
