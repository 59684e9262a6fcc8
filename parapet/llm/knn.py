"""Approximate nearest neighbours with a hierarchical k-means tree.

The tree is fitted on a bounded sample. Every row is then put into the leaf it falls to. A query walks the tree best bin
first: a priority queue holds the branches not taken, by distance to their centre, and gives the leaves in the order in
which they are worth a visit. How many leaves are visited is calibrated: for a bounded number of rows the true
neighbours are found by brute force over all rows, and visits widen until the wanted share of them is met.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from parapet.llm.common import nested, written
from parapet.llm.vectors import doubles, matrix, picked, usable

#: Rows the tree is fitted on, rows whose true neighbours calibrate the visits, and the recall wanted of them.
SAMPLE = 20_000
CALIBRATION = 200
RECALL = 0.97
BRANCHES = 8
LEAF = 64
ROUNDS = 8
#: Rows of a leaf, and queries of a leaf, that one task compares.
ROWS, QUERIES = 4096, 4096


@dataclass
class Tree:
    """Nodes: centres of the children, and where they lead (a node, or below zero a leaf: -1 - its number)."""

    centres: list[np.ndarray]
    children: list[list[int]]
    leaves: int
    size: int

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row, going down to the nearest centre."""
        at = np.zeros(len(x), np.int64)
        while (at >= 0).any():
            for node in np.unique(at[at >= 0]):
                own = np.flatnonzero(at == node)
                c = self.centres[node]
                near = ((c * c).sum(1) - 2 * (x[own] @ c.T)).argmin(1)
                at[own] = np.asarray(self.children[node])[near]
        return -1 - at

    def order(self, q: np.ndarray, most: int, held: np.ndarray | None = None, rows: int = 0) -> list[int]:
        """The first ``most`` leaves for a query, best bin first, and more until ``rows`` by their counts ``held`` are met."""
        queue: list[tuple[float, int]] = [(0.0, 0)]
        found: list[int] = []
        met = 0
        while queue and (len(found) < most or met < rows):
            _, node = heapq.heappop(queue)
            while node >= 0:
                far = ((self.centres[node] - q) ** 2).sum(1)
                best = int(far.argmin())
                for k, child in enumerate(self.children[node]):
                    if k != best:
                        heapq.heappush(queue, (float(far[k]), child))
                node = self.children[node][best]
            found.append(-1 - node)
            met += 0 if held is None else int(held[-1 - node])
        return found


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(ROUNDS):
        near = ((centres ** 2).sum(1) - 2 * (x @ centres.T)).argmin(1)
        for j in range(k):
            if (near == j).any():
                centres[j] = x[near == j].mean(0)
    return centres, ((centres ** 2).sum(1) - 2 * (x @ centres.T)).argmin(1)


def grow(x: np.ndarray, branches: int = BRANCHES, leaf: int = LEAF, seed: int = 0) -> Tree:
    """A tree whose leaves hold at most ``leaf`` sample rows, unless those are all alike."""
    rng = np.random.default_rng(seed)
    tree = Tree([], [], 0, x.shape[1])

    def build(rows: np.ndarray, depth: int) -> int:
        values = np.unique(rows, axis=0) if len(rows) <= 4 * leaf or depth else rows
        if (len(rows) <= leaf or len(values) <= branches) and tree.centres:
            tree.leaves += 1
            return -tree.leaves
        k = min(branches, len(values))
        centres, near = _kmeans(values, k, rng)
        used = np.unique(near)
        node = len(tree.centres)
        tree.centres.append(centres[used])
        tree.children.append([])
        if len(used) == 1:
            tree.leaves += 1
            tree.children[node] = [-tree.leaves]
            return node
        own = ((centres[used] ** 2).sum(1) - 2 * (rows @ centres[used].T)).argmin(1)
        tree.children[node] = [build(rows[own == j], depth + 1) for j in range(len(used))]
        return node

    build(x, 0)
    return tree


def _nearest(rows: np.ndarray, ids: np.ndarray, q: np.ndarray, own: int | None, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances and ids of the ``k`` nearest rows but the query itself, ties to the smaller id."""
    far = np.sqrt(((rows - q) ** 2).sum(1))
    if own is not None:
        keep = ids != own
        far, ids = far[keep], ids[keep]
    if len(far) > k:
        cut = np.partition(far, k - 1)[k - 1]
        near = far <= cut
        far, ids = far[near], ids[near]
    best = np.lexsort((ids, far))[:k]
    return far[best], ids[best]


def _truth(rows: DataFrame, probes: np.ndarray, names: list[int], tree: Tree, k: int) -> list[tuple[int, int]]:
    """(probe, leaf) of each probe's true neighbours among all rows; at most probes x k x tasks rows come together."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[float, int, int]]] = [[] for _ in names]
        for batch in batches:
            if batch.num_rows:
                x, ids = matrix(batch.column("v")), batch.column("id").to_numpy()
                leaf = dict(zip(ids.tolist(), tree.assign(x).tolist()))
                for i, q in enumerate(probes):
                    far, near = _nearest(x, ids, q, names[i], k)
                    best[i] = sorted(best[i] + [(f, n, leaf[n]) for f, n in zip(far.tolist(), near.tolist())])[:k]
        flat = [(i, *t) for i, own in enumerate(best) for t in own]
        yield pa.RecordBatch.from_arrays([pa.array([t[j] for t in flat], kind) for j, kind in enumerate(
            (pa.int32(), pa.float64(), pa.int64(), pa.int32()))], ["probe", "far", "id", "leaf"])

    found = rows.select("id", "v").mapInArrow(run, "probe int, far double, id long, leaf int")
    order = Window.partitionBy("probe").orderBy("far", "id")
    got = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("probe", "leaf").collect()
    return [(r["probe"], r["leaf"]) for r in got]


def calibrate(rows: DataFrame, tree: Tree, k: int, wanted: float = RECALL, probes: int = CALIBRATION) -> tuple[int, float]:
    """The least number of leaves to visit that reaches the wanted recall, and the recall reached on the probes."""
    got = rows.orderBy(F.xxhash64("id", F.lit("probe")), "id").select("id", "v").limit(probes).collect()
    truth = _truth(rows, np.array([r["v"] for r in got]), [r["id"] for r in got], tree, k)
    places = [{leaf: i for i, leaf in enumerate(tree.order(np.array(r["v"]), tree.leaves))} for r in got]
    if not truth:
        return tree.leaves, 1.0
    ranks = np.sort([places[probe][leaf] for probe, leaf in truth])
    visits = int(ranks[int(np.ceil(wanted * len(ranks))) - 1]) + 1
    return visits, float((ranks < visits).mean())


def search(vectors: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding",
           wanted: float = RECALL) -> DataFrame:
    """The ``k`` nearest rows found for each query: ``query_id, rank, vec_id, score`` (Euclidean distance, double).

    Ties go to the smaller id; a query never finds its own id. Vectors that are null, empty, zero or have null or
    non-finite components take no part, nor do rows without id or of another length than most. Fewer candidates than
    ``k`` give fewer rows; no vectors give none. Rows that share an id are candidates each for itself, and queries each for
    itself: a repeated query row gives its ranks again. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("raw"),
                          F.coalesce(is_query, F.lit(False)).alias("query"))
    rows = rows.filter(F.col("id").isNotNull() & usable(F.col("raw"))).select("id", "query", doubles(F.col("raw")).alias("v"))
    sample = picked(rows, SAMPLE)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not len(sample):
        return empty
    tree = grow(sample)
    rows = rows.filter(F.size("v") == tree.size)
    visits, _ = calibrate(rows, tree, k, wanted)
    filled = np.zeros(tree.leaves, np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("v"))
            leaf = tree.assign(x) if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(name) for name in ("row", "id", "query", "v")], pa.array(leaf, pa.int32())],
                ["row", "id", "query", "v", "leaf"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("v"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("id"), batch.column("v"), nested([np.asarray(tree.order(q, visits, filled, k + own))
                                                                for q, own in zip(x, batch.column("own").to_pylist())],
                                                               pa.int32())], ["row", "id", "v", "leaves"])

    numbered = rows.withColumn("row", F.monotonically_increasing_id())  # tells rows that share an id apart, once written
    index = written(numbered.mapInArrow(place, "row long, id long, query boolean, v array<double>, leaf int"), "leaves")
    for r in index.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect():  # one row per leaf of the tree
        filled[r["leaf"]] = r["n"]
    # a query's own id gives no candidate, however many rows have it
    repeated = index.join(index.filter("query").select("id").distinct(), "id", "left_semi").groupBy("id").agg(
        F.count(F.lit(1)).alias("n")).filter("n > 1")
    asking = index.filter("query").select("row", "id", "v").join(repeated, "id", "left").select(
        "row", "id", "v", F.coalesce("n", F.lit(1)).alias("own"))
    queries = written(asking.mapInArrow(visit, "row long, id long, v array<double>, leaves array<int>")
                      .select("row", "id", "v", F.explode("leaves").alias("leaf")), "visits")
    # one row per leaf of the tree
    held = index.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / ROWS).cast("int").alias("parts"))
    asked = queries.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("asks"))
    plan = F.broadcast(held.join(asked, "leaf"))
    cells = "leaf", "part", "ask"
    own = index.join(plan, "leaf").select(
        "id", "v", "leaf", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"),
        F.explode(F.sequence(F.lit(0), F.col("asks") - 1)).alias("ask"))
    theirs = queries.join(plan, "leaf").select(
        "row", "id", "v", "leaf", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
        F.pmod(F.xxhash64("row"), F.col("asks")).cast("int").alias("ask"))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        numbers, names, far, near = [], [], [], []
        if left.num_rows and right.num_rows:
            x, ids = matrix(left.column("v").combine_chunks()), left.column("id").to_numpy()
            asked = zip(right.column("row").to_pylist(), right.column("id").to_pylist(), matrix(right.column("v").combine_chunks()))
            for number, name, q in asked:
                f, n = _nearest(x, ids, q, name, k)
                numbers.append(np.full(len(f), number))
                names.append(np.full(len(f), name))
                far.append(f)
                near.append(n)
        join = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.zeros(0), kind)
        return pa.Table.from_arrays([join(numbers, pa.int64()), join(names, pa.int64()), join(near, pa.int64()), join(far, pa.float64())],
                                    ["row", "query_id", "vec_id", "score"])

    found = own.groupBy(*cells).cogroup(theirs.groupBy(*cells)).applyInArrow(
        compare, "row long, query_id long, vec_id long, score double")
    order = Window.partitionBy("row").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def brute_force(vectors: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id",
                vector: str = "embedding") -> DataFrame:
    """The true answer to ``search``, for measuring recall: the queries (all on the driver) against every row."""
    rows = vectors.select(F.col(vec_id).alias("id"), F.col(vector).alias("raw"), is_query.alias("query"))
    rows = rows.filter(F.col("id").isNotNull() & usable(F.col("raw"))).select("id", "query", doubles(F.col("raw")).alias("v"))
    sample = picked(rows, SAMPLE)
    rows = rows.filter(F.size("v") == (sample.shape[1] if len(sample) else -1))
    asked = [(i, r["id"], np.array(r["v"])) for i, r in enumerate(rows.filter("query").collect())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, ids = matrix(batch.column("v")), batch.column("id").to_numpy()
                flat = [(i, name, n, f) for i, name, q in asked for f, n in zip(*_nearest(x, ids, q, name, k))]
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array([t[c] for t in flat], pa.int64()) for c in range(3)], pa.array([t[3] for t in flat], pa.float64())],
                    ["row", "query_id", "vec_id", "score"])

    order = Window.partitionBy("row").orderBy("score", "vec_id")
    return rows.mapInArrow(run, "row long, query_id long, vec_id long, score double").withColumn(
        "rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
