"""Approximate nearest neighbours by largest inner product: a hierarchical k-means tree, best bin first.

Inner products become distances by one more component, sqrt(M^2 - |x|^2) with M the largest norm. The top of the tree
is fitted on the driver to a bounded sample (about SAMPLE vectors); leaves that turn out too large for LEAF_SHARE
vectors a leaf are split further on the workers, each by a tree fitted to a sample of its own members, so the number of
leaves grows with the table, up to MOST_LEAVES, beyond which leaves do. Every vector is put into its leaf. A query
goes down the tree through a priority queue of branches, nearest centroid first. How many leaves it visits is
calibrated: exact neighbours of about CALIBRATION queries are found by brute force, and visits widen to the fewest
with which TARGET of them are reached (and on, until a query has seen enough vectors). Leaves are
dealt out in groups of even size, a few for each core and of GROUP vectors at least, large leaves over several; each group is a task of its own; a group's
vectors lie in memory while its queries stream past, each compared with the leaves that it visits. The
sample's vectors in those leaves bound the query's last place, so a group returns only what may still take one.

Equal vectors tie, so of each only the K + 1 smallest ids can be among any query's K nearest: the index
keeps those, ranked with a limit before the shuffle, and equal queries are searched once. So a vector
that is a third of all rows is no hot spot, and the result is that of an index of every row.

Scores are sums of products in double precision in a fixed order. Defined results: vectors that are null,
zero, of a length other than the most frequent one, or that hold a null, NaN or infinity take no part, nor
do rows without a vec_id. Repeated rows (same id and vector) count once; an id with several vectors takes part
with each. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnfold.llm.common import drawn, in_arrow, written

K = 20
SAMPLE = 20_000
LEAF = 40
BRANCHES = 8
#: A leaf of more than LEAF_SHARE times its fair size is split; a leaf's sample; the most leaves of a tree.
LEAF_SHARE, LEAF_SAMPLE, MOST_LEAVES = 4, 4_000, 100_000
CALIBRATION = 200
TARGET = 0.95
GROUP, LARGEST_GROUP = 2048, 1 << 17
SALTS = 8
_BLOCK = 256


class Tree:
    """centroids [nodes, d]; children of node i (empty: a leaf); leaf number of each node."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF, branches: int = BRANCHES, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.children: list[list[int]] = [[]]
        centroids = [x.mean(axis=0) if len(x) else np.zeros(x.shape[1])]
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            parts = self._split(x[rows], branches, rng) if len(rows) > leaf else []
            if len(parts) < 2:
                continue
            for c, at in parts:
                self.children[node].append(len(centroids))
                todo.append((len(centroids), rows[at]))
                centroids.append(c)
                self.children.append([])
        self.centroids = np.stack(centroids)
        self._number()

    def graft(self, leaf_nodes: dict[int, Tree]) -> None:
        """Each given leaf node becomes the root of a tree; leaves are numbered again, in the order of the nodes."""
        centroids = [self.centroids]
        for node, sub in leaf_nodes.items():
            base = sum(map(len, centroids)) - 1  # the root of sub is node itself
            self.children[node] = [base + c for c in sub.children[0]]
            self.children += [[base + c for c in cs] for cs in sub.children[1:]]
            centroids.append(sub.centroids[1:])
        self.centroids = np.concatenate(centroids)
        self._number()

    def _number(self) -> None:
        """Leaves from left to right, so that neighbouring numbers are neighbouring places."""
        self.leaf_of, todo = {}, [0]
        while todo:
            node = todo.pop()
            if self.children[node]:
                todo += reversed(self.children[node])
            else:
                self.leaf_of[node] = len(self.leaf_of)
        self.n_leaves = len(self.leaf_of)

    @staticmethod
    def _split(x: np.ndarray, k: int, rng) -> list[tuple[np.ndarray, np.ndarray]]:
        c = x[rng.choice(len(x), size=min(k, len(x)), replace=False)]
        for _ in range(8):
            near = ((c**2).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)
            c = np.stack([x[near == i].mean(axis=0) if (near == i).any() else c[i] for i in range(len(c))])
        near = ((c**2).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)
        return [(c[i], np.flatnonzero(near == i)) for i in range(len(c)) if (near == i).any()]

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row, down the nearest child at each node."""
        out = np.zeros(len(x), dtype=np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not self.children[node]:
                out[rows] = self.leaf_of[node]
                continue
            c = self.centroids[self.children[node]]
            near = ((c**2).sum(axis=1) - 2 * x[rows] @ c.T).argmin(axis=1)
            todo += [(child, rows[near == i]) for i, child in enumerate(self.children[node]) if (near == i).any()]
        return out

    def best_bins(self, q: np.ndarray) -> Iterator[Iterator[int]]:
        """For each query its leaves, best bin first, as long as they are asked for."""
        d = (self.centroids**2).sum(axis=1) - 2 * q @ self.centroids.T

        def visit(row: list[float]) -> Iterator[int]:
            queue = [(row[0], 0)]
            while queue:
                _, node = heapq.heappop(queue)
                if not self.children[node]:
                    yield self.leaf_of[node]
                for child in self.children[node]:
                    heapq.heappush(queue, (row[child], child))

        for row in d:
            yield visit(row.tolist())


def widened(x: np.ndarray, largest: float) -> np.ndarray:
    """Vectors with the component that makes all norms equal."""
    return np.concatenate([x, np.sqrt(np.maximum(largest**2 - (x**2).sum(axis=1), 0))[:, None]], axis=1)


def as_query(q: np.ndarray, largest: float) -> np.ndarray:
    norm = np.sqrt((q**2).sum(axis=1, keepdims=True))
    return np.concatenate([q / norm * largest, np.zeros((len(q), 1))], axis=1)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """A column of d doubles a row."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(np.float64)


NEAR = "array<struct<score:double,vec_id:long>>"


def _near_array(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    ends = np.cumsum([0, *[len(i) for i, _ in found]]).astype(np.int32)
    ids, scores = (np.concatenate([f[j] for f in found]) if found else np.zeros(0) for j in (0, 1))
    rows = pa.StructArray.from_arrays([pa.array(scores, pa.float64()), pa.array(ids.astype(np.int64))], ["score", "vec_id"])
    return pa.ListArray.from_arrays(pa.array(ends), rows)


def nearest(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, spans: list[tuple[int, int, np.ndarray]] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, scores) of the k nearest of each query, ties to smaller ids.

    spans: (from, to, which queries) of x to compare; None: all. A matrix product finds what may be
    among them, with room for its rounding; the scores themselves are summed in a fixed order.
    """
    s = np.full((len(q), len(x)), -np.inf)
    for a, b, rows in spans if spans is not None else [(0, len(x), np.arange(len(q)))]:
        s[rows, a:b] = q[rows] @ x[a:b].T
    room = 1e-12 * np.sqrt((q**2).sum(axis=1)) * (np.sqrt((x**2).sum(axis=1)).max() if len(x) else 0.0)
    least = np.partition(s, len(x) - k, axis=1)[:, len(x) - k] if len(x) > k else np.full(len(q), -np.inf)
    out = []
    for row, score in enumerate(s):
        at = np.flatnonzero((score >= least[row] - room[row]) & (score > -np.inf))
        exact = (x[at] * q[row]).sum(axis=1)
        order = np.lexsort((ids[at], -exact))[:k]
        out.append((ids[at][order], exact[order]))
    return out


def valid(vectors: DataFrame, id_col: str = "vec_id", col: str = "embedding") -> tuple[DataFrame, int]:
    """(vec_id, x) of the rows that take part, x as doubles, and the length of x (0: there are none)."""
    x = F.transform(F.col(col), lambda v: v.cast("double") + F.lit(0.0))  # -0.0 becomes 0.0
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where("vec_id is not null and x is not null")
    rows = rows.where(~bad & F.exists("x", lambda v: v != 0))
    common = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = common[0] if common else 0
    return rows.where(F.size("x") == d), d


def search(vectors: DataFrame, queries: DataFrame, d: int, k: int = K, target: float = TARGET) -> DataFrame:
    """(query_id, near: array of k + 1 structs (score, vec_id), best first) for each query row, its own id included.

    vectors, queries: (vec_id, x) as `valid` gives them.
    """
    spark = vectors.sparkSession
    class_of = F.struct(F.xxhash64("x").alias("a"), F.xxhash64(F.lit("q"), "x").alias("b"))
    in_class = F.dense_rank().over(Window.partitionBy("x").orderBy("vec_id"))
    index = written(vectors.withColumn("r", in_class).where(F.col("r") <= k + 1).select("vec_id", "x").distinct(), "vectors")
    largest = float(np.sqrt(index.agg(F.max(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))).first()[0] or 0.0))
    n_index = index.count()
    size = max(GROUP, min(LARGEST_GROUP, n_index // (8 * spark.sparkContext.defaultParallelism)))
    in_sample = drawn(SAMPLE / max(n_index, 1), "vec_id", "x")
    sample = _matrix(index.where(in_sample).orderBy("vec_id", "x").select("x").toArrow()["x"].combine_chunks(), d)
    tree = Tree(widened(sample, largest))
    leaved = _grown(index, tree, n_index, largest, d)
    shared = spark.sparkContext.broadcast((tree, largest))  # at most MOST_LEAVES leaves and little more nodes
    looked_at = leaved.where(in_sample).select("leaf", "x").toArrow().combine_chunks()
    of_sample = spark.sparkContext.broadcast((_matrix(looked_at["x"].combine_chunks(), d), looked_at["leaf"].to_numpy()))
    in_leaves = dict(map(tuple, leaved.groupBy("leaf").count().collect()))  # a row for each leaf
    asked = written(queries.select(class_of.alias("c"), "vec_id", "x"), "queries")
    classes = written(asked.groupBy("c").agg(F.first("x").alias("x")), "classes")
    visits = _calibrated(leaved, classes, tree, largest, d, k, target)
    # Leaves to groups: small leaves share one, large ones are dealt over several.
    place, group, room = {}, 0, size
    for leaf in range(tree.n_leaves):
        n = in_leaves.get(leaf, 0)
        if n > room and room < size:
            group, room = group + 1, size
        if n > size:
            place[leaf] = (group, -(-n // size))
            group += place[leaf][1]
        else:
            place[leaf] = (group, 1)
            room -= n
    groups = spark.createDataFrame([(leaf, *p) for leaf, p in place.items()], "leaf int, first int, many int")
    dealt = leaved.join(F.broadcast(groups), "leaf").select((F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("many"))).cast("int").alias("group"), F.lit(0).alias("kind"), F.struct(F.col("vec_id").alias("a"), F.lit(0).cast("long").alias("b")).alias("c"), F.array("leaf").alias("leaves"), F.lit(0.0).alias("least"), "x")

    def to_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, largest = shared.value
        sample, sample_leaf = of_sample.value
        for b in batches:
            for at in range(0, b.num_rows, _BLOCK):
                part = b.slice(at, _BLOCK)
                x = _matrix(part.column(1), d)
                near, room = x @ sample.T, 1e-12 * largest * np.sqrt((x**2).sum(axis=1))
                rows: list[tuple[int, int, list[int], float]] = []
                for i, bins in enumerate(tree.best_bins(as_query(x, largest))):
                    seen, n, by = 0, 0, {}
                    for leaf in bins:
                        if seen >= visits and n > k:
                            break
                        if leaf in in_leaves:
                            seen, n = seen + 1, n + in_leaves[leaf]
                            for g in range(place[leaf][0], sum(place[leaf])):
                                by.setdefault(g, []).append(leaf)
                    # The sample's vectors in these leaves will be found there: the k-th of them bounds what groups return.
                    visited = np.zeros(tree.n_leaves, dtype=bool)
                    visited[[leaf for leaves in by.values() for leaf in leaves]] = True
                    seen_here = near[i][visited[sample_leaf]]
                    low = np.partition(seen_here, len(seen_here) - k - 1)[len(seen_here) - k - 1] - room[i] if len(seen_here) > k else -np.inf
                    rows += [(g, i, leaves, float(low)) for g, leaves in by.items()]
                g, i, leaves, least = zip(*rows) if rows else ((),) * 4
                take = pa.array(i, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(g, pa.int32()), pa.array([1] * len(g), pa.int32()), part.column(0).take(take), pa.array(leaves, pa.list_(pa.int32())), pa.array(least, pa.float64()), part.column(1).take(take)], ["group", "kind", "c", "leaves", "least", "x"])

    schema = "group int, kind int, c struct<a:long,b:long>, leaves array<int>, least double, x array<double>"
    # Few rows, each of which takes long: over all cores.
    sent = in_arrow(classes.select("c", "x").repartition(2 * spark.sparkContext.defaultParallelism, "c"), to_groups, schema)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, index = -1, [], None
        for b in batches:
            group, kind = b.column(0).to_numpy(), b.column(1).to_numpy()
            cut = np.flatnonzero(np.append(True, (np.diff(group) != 0) | (np.diff(kind) != 0)))
            for a, z in zip(cut, np.append(cut[1:], b.num_rows)):
                part = b.slice(int(a), int(z - a))
                if group[a] != now:
                    now, held, index = group[a], [], None
                if kind[a] == 0:
                    held.append((part.column(2).field(0).to_numpy(), part.column(3).flatten().to_numpy(), _matrix(part.column(5), d)))
                    continue
                if not held:
                    continue
                if index is None:
                    ids, leaf, x = (np.concatenate(c) for c in zip(*held))
                    order = np.lexsort((ids, leaf))
                    ids, leaf, x = ids[order], leaf[order], x[order]
                    starts = np.flatnonzero(np.append(True, leaf[1:] != leaf[:-1]))
                    index = ids, x, list(zip(leaf[starts].tolist(), starts.tolist(), np.append(starts[1:], len(leaf)).tolist()))
                ids, x, parts = index
                for at in range(0, part.num_rows, _BLOCK):
                    some = part.slice(at, _BLOCK)
                    q, least = _matrix(some.column(5), d), some.column(4).to_numpy()
                    goes = [set(v) for v in some.column(3).to_pylist()]
                    spans = [(s, e, np.array(rows)) for leaf, s, e in parts if (rows := [i for i, g in enumerate(goes) if leaf in g])]
                    found = [(i[s >= low], s[s >= low]) for (i, s), low in zip(nearest(q, x, ids, k + 1, spans), least)]
                    yield pa.RecordBatch.from_arrays([some.column(2), _near_array(found)], ["c", "near"])

    # Groups are of even size; each goes to the task of its number.
    both = dealt.unionByName(sent).repartitionById(max(1, 1 + max((first + many - 1 for first, many in place.values()), default=0)), F.col("group")).sortWithinPartitions("group", "kind")
    some = in_arrow(both, compare, f"c struct<a:long,b:long>, near {NEAR}")
    each = some.select("c", F.explode("near").alias("n")).select("c", "n.score", "n.vec_id")
    best = F.row_number().over(Window.partitionBy("c").orderBy(F.desc("score"), "vec_id"))
    top = each.withColumn("r", best).where(F.col("r") <= k + 1).groupBy("c").agg(F.array_sort(F.collect_list(F.struct("r", "score", "vec_id"))).alias("near"))
    salted = top.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    ids = asked.select("c", F.col("vec_id").alias("query_id"), F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int").alias("salt")).distinct()
    return ids.join(salted, ["c", "salt"]).select("query_id", "near")


def _grown(index: DataFrame, tree: Tree, n_index: int, largest: float, d: int) -> DataFrame:
    """(leaf, vec_id, x) of all vectors; splits tree where leaves are too large, as often as that takes."""
    fair = max(LEAF, n_index // MOST_LEAVES)
    while True:
        shared = index.sparkSession.sparkContext.broadcast((tree, largest))

        def in_leaf(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            tree, largest = shared.value
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array(tree.assign(widened(_matrix(b.column(1), d), largest))), *b.columns], ["leaf", "vec_id", "x"])

        leaved = written(in_arrow(index, in_leaf, "leaf int, vec_id long, x array<double>"), "leaves")
        large = {r.leaf: r["count"] for r in leaved.groupBy("leaf").count().where(F.col("count") > LEAF_SHARE * fair).collect()}  # fewer than leaves
        if not large:
            return leaved
        shares = index.sparkSession.createDataFrame([(leaf, LEAF_SAMPLE / n, n) for leaf, n in large.items()], "leaf int, share double, n long")

        def split(table: pa.Table) -> pa.Table:
            x, n = _matrix(table["x"].combine_chunks(), d), table["n"][0].as_py()
            order = np.argsort(table["vec_id"].to_numpy(), kind="stable")
            sub = Tree(widened(x[order], largest), leaf=max(2, fair * len(x) // n))
            return pa.table({"leaf": pa.array([table["leaf"][0].as_py()], pa.int32()), "tree": pa.array([pickle.dumps((sub.centroids, sub.children))], pa.binary())})

        sample = leaved.join(F.broadcast(shares), "leaf").where(drawn(F.col("share"), "vec_id", "x"))
        node_of = {leaf: node for node, leaf in tree.leaf_of.items()}
        grafts = {}
        for r in sorted(sample.groupBy("leaf").applyInArrow(split, "leaf int, tree binary").collect(), key=lambda r: r.leaf):
            sub = Tree.__new__(Tree)
            sub.centroids, sub.children = pickle.loads(r.tree)
            if len(sub.children) > 1:
                grafts[node_of[r.leaf]] = sub
        if not grafts:  # what is left cannot be told apart
            return leaved
        tree.graft(grafts)


def _calibrated(leaved: DataFrame, classes: DataFrame, tree: Tree, largest: float, d: int, k: int, target: float) -> int:
    """The fewest leaves with which a sample of queries reaches `target` of its exact neighbours."""
    rows = classes.where(drawn(CALIBRATION / max(classes.count(), 1), "c")).orderBy("c").select("x").toArrow()["x"].combine_chunks()
    if not len(rows):
        return tree.n_leaves
    q = _matrix(rows, d)

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, leaf = _matrix(b.column(2), d), b.column(0).to_numpy()
            # Rows stand for ids here: what counts is the leaf.
            out = [(i, s, leaf[r]) for i, (rs, ss) in enumerate(nearest(q, x, np.arange(len(x)), k + 1)) for r, s in zip(rs, ss)]
            i, s, at = zip(*out) if out else ((),) * 3
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(s, pa.float64()), pa.array(at, pa.int32())], ["q", "score", "leaf"])

    near = in_arrow(leaved, brute, "q int, score double, leaf int")
    top = near.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "leaf"))).where(F.col("r") <= k + 1)
    orders = [{leaf: n for n, leaf in enumerate(bins)} for bins in tree.best_bins(as_query(q, largest))]
    needed = sorted(orders[i][leaf] for i, leaf in top.where("r > 1").select("q", "leaf").collect())  # k rows a query; the nearest is itself
    if not needed:
        return tree.n_leaves
    return 1 + needed[min(len(needed) - 1, int(np.ceil(target * len(needed))))]


def op5_nearest_neighbours(embeddings: DataFrame, k: int = K) -> DataFrame:
    """The k nearest other rows of each row whose vec_id is divisible by 20."""
    rows, d = valid(embeddings)
    none = embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not d:
        return none
    queries = rows.where(F.col("vec_id") % 20 == 0)
    near = search(rows, queries, d, k)
    others = F.slice(F.filter("near", lambda n: n["vec_id"] != F.col("query_id")), 1, k)
    return near.select("query_id", F.posexplode(others).alias("at", "n")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "n.vec_id", "n.score")
