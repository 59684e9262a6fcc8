"""Embedding near-duplicates by PCA-ordered tiled comparison.

Vectors are compared within a label only. Scaled to length one and turned by the principal axes of a bounded sample, they
carry most of their products in the leading dimensions. A label's vectors are cut into tiles along the first axis; two
tiles are compared in a task of their own, unless they lie too far apart on that axis. A task adds up products of leading
dimensions first. What the other dimensions can still add is at most the product of the two suffix norms; pairs that
cannot reach the threshold stop there. Survivors are decided on the original vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from parapet.llm.common import written
from parapet.llm.components import components
from parapet.llm.vectors import doubles, matrix, picked, usable

THRESHOLD = 0.93
#: Vectors the axes are taken from. They only decide how early pairs stop, never which pairs link.
SAMPLE = 20_000
TILE = 1024
#: Dimensions after which pairs are given up.
STEPS = (8, 16, 32)
#: Room for rounding in the bounds.
SLACK = 1e-6


def axes(sample: np.ndarray) -> np.ndarray:
    """Principal axes of unit vectors, as columns, largest share first."""
    unit = sample / np.sqrt((sample ** 2).sum(1))[:, None]
    _, turned = np.linalg.eigh(unit.T @ unit)
    return turned[:, ::-1]


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least position each of ``n`` places can reach over the links."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their largest component near 1: squares neither overflow nor vanish, and a
    cosine has the same bits as before where it had any."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None]) if x.size else x


def _pairs(x: np.ndarray, y: np.ndarray, turn: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of pairs with a cosine of at least the threshold."""
    x, y = _scaled(x), _scaled(y)
    u, v = (m / np.sqrt((m ** 2).sum(1))[:, None] for m in (x, y))
    p, q = u @ turn, v @ turn
    size = p.shape[1]
    steps = [s for s in STEPS if s < size]
    first = steps[0] if steps else size
    i, j = np.nonzero(p[:, :first] @ q[:, :first].T + _tail(p, first)[:, None] * _tail(q, first)[None, :] >= threshold - SLACK)
    total = (p[i, :first] * q[j, :first]).sum(1)
    for low, high in zip(steps, steps[1:]):
        total += (p[i, low:high] * q[j, low:high]).sum(1)
        keep = total + _tail(p, high)[i] * _tail(q, high)[j] >= threshold - SLACK
        i, j, total = i[keep], j[keep], total[keep]
    dot = np.zeros(len(i))
    for at in range(0, len(i), 100_000):
        own = slice(at, at + 100_000)
        a, b = x[i[own]], y[j[own]]
        dot[own] = (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))
    return i[dot >= threshold], j[dot >= threshold]


def _tail(p: np.ndarray, at: int) -> np.ndarray:
    return np.sqrt((p[:, at:] ** 2).sum(1))


def _compare(node: np.ndarray, n: np.ndarray, half: np.ndarray, x: np.ndarray, turn: np.ndarray, threshold: float):
    """For one pair of tiles: links of each vector, counted with copies, and a forest of links between vectors."""
    split = int(np.searchsorted(half, 1))
    if split in (0, len(half)):
        if half[0] == 2:  # a tile with itself
            i, j = _pairs(x, x, turn, threshold)
            keep = i < j
            i, j = i[keep], j[keep]
        else:
            i = j = np.zeros(0, np.int64)
    else:
        i, j = _pairs(x[:split], x[split:], turn, threshold)
        j = j + split
    links = np.bincount(i, n[j], len(node)) + np.bincount(j, n[i], len(node))
    root = _roots(len(node), i, j)
    own = np.flatnonzero(links > 0)
    return node[own], links[own].astype(np.int64), node[root[own]]


def _classes(vectors: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """Rows with the class of their vector: a hash of label and vector, null where the vector links with nothing."""
    raw = F.col(vector)
    part = usable(raw) & F.col(label).isNotNull()
    return vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), doubles(raw).alias("v"),
                          F.when(part, F.xxhash64(F.col(label), doubles(raw))).alias("node"))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, vec_id: str = "vec_id",
                    vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    Equal vectors of a label are one class (by a 64-bit hash of label and vector), counted but not expanded. Vectors that
    are null, empty, zero or hold null or non-finite components, and those without a label, link with nothing and are
    kept. Vectors of different length do not link. Rows that share an id are counted each for itself; a null id is never
    the least of its component.
    """
    rows = written(_classes(vectors, vec_id, vector, label), "vectors")
    classes = rows.filter(F.col("node").isNotNull()).groupBy("node").agg(
        F.first("label").alias("label"), F.first("v").alias("v"), F.count(F.lit(1)).alias("n"),
        F.min("vec_id").alias("least"))
    classes = classes.withColumn("size", F.size("v"))
    sample = picked(classes.select(F.col("node").alias("id"), "v"), SAMPLE)
    size = sample.shape[1] if len(sample) else 0
    turn = axes(_scaled(sample)) if len(sample) else np.zeros((0, 0))
    scaled = F.transform("v", lambda x: x / F.array_max(F.transform("v", F.abs)))
    classes = classes.withColumn("scaled", scaled)
    unit = F.sqrt(F.aggregate("scaled", F.lit(0.0), lambda s, x: s + x * x))
    head = turn[:, 0].tolist() if size else [0.0]
    lead = F.aggregate(F.zip_with("scaled", F.array(*map(F.lit, head)), lambda x, y: x * y), F.lit(0.0),
                       lambda s, x: s + F.coalesce(x, F.lit(0.0)))
    # the place on the first axis, with a trace of the hash so that no value can be common
    place = lead / unit + F.pmod("node", F.lit(1 << 20)) * F.lit(1e-12)
    classes = written(classes.withColumn("place", place).drop("scaled"), "classes")
    # per label and length: borders of its tiles on the first axis
    counts = classes.groupBy("label", "size").agg(F.count(F.lit(1)).alias("rows"))
    borders = _borders(classes, counts)
    reach = float(np.sqrt(max(2 - 2 * threshold, 0.0))) + SLACK
    tiled = classes.join(borders, ["label", "size"]).withColumn(
        "own", F.size(F.filter("borders", lambda b: b < F.col("place"))))
    low = lambda t: F.when(t > 0, F.element_at("borders", t.cast("int"))).otherwise(F.lit(-2.0))
    high = lambda t: F.when(t < F.size("borders"), F.element_at("borders", t.cast("int") + 1)).otherwise(F.lit(2.0))
    partners = F.filter(F.sequence(F.lit(0), F.size("borders")), lambda t: (
        low(t) - high(F.col("own")) <= reach) & (low(F.col("own")) - high(t) <= reach))
    dealt = tiled.select("label", "size", "node", "n", "v", "own", F.explode(partners).alias("other")).select(
        "label", "size", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
        F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") > F.col("other")).cast("int")).alias("half"),
        "node", "n", "v")
    cells = ["label", "size", "low", "high"]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("half")
        x = matrix(table.column("v").combine_chunks())
        own = turn if x.shape[1] == size else np.eye(x.shape[1])
        a, links, root = _compare(table.column("node").to_numpy(), table.column("n").to_numpy(),
                                  table.column("half").to_numpy(), x, own, threshold)
        return pa.Table.from_arrays([pa.array(a), pa.array(links), pa.array(root)], ["a", "links", "b"])

    found = written(dealt.groupBy(*cells).applyInArrow(run, "a long, links long, b long"), "tile-links")
    roots = components(found.select("a", "b"))
    links = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    known = classes.select("node", "n", "least").join(links, "node", "left").join(roots, "node", "left")
    known = known.withColumn("root", F.coalesce("root", "node"))
    least = known.groupBy("root").agg(F.min("least").alias("component"))
    named = known.join(least, "root").select(
        "node", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component")
    joined = rows.select("vec_id", "node").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                         component.cast("long").alias("component_id"),
                         F.coalesce(F.col("vec_id") == component, F.col("node").isNull()).alias("kept"))


def _borders(classes: DataFrame, counts: DataFrame) -> DataFrame:
    """Inner borders of tiles, from approximate quantiles of all places: one array per label and length."""
    tiles = counts.withColumn("tiles", F.ceil(F.col("rows") / TILE).cast("int"))
    most = tiles.agg(F.max("tiles")).first()[0] or 1
    shares = [i / most for i in range(1, most)]
    if not shares:
        return tiles.select("label", "size", F.array().cast("array<double>").alias("borders"))
    cuts = classes.groupBy("label", "size").agg(
        F.percentile_approx("place", shares, max(10_000, 20 * most)).alias("cuts")).join(tiles, ["label", "size"])
    every = F.sequence(F.lit(1), F.col("tiles") - 1)
    own = F.when(F.col("tiles") > 1, F.transform(every, lambda i: F.element_at(
        "cuts", F.greatest(F.lit(1), F.least(F.lit(most - 1), F.round(i * most / F.col("tiles")).cast("int")))))).otherwise(
        F.array().cast("array<double>"))
    return cuts.select("label", "size", F.array_sort(F.array_distinct(own)).alias("borders"))
