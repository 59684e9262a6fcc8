import math
import zlib
from collections import Counter, defaultdict
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from parapet.llm import sharding
from parapet.llm.sharding import Shard, Tree


def plain(tree, key):
    """The same descent without Spark."""
    node, nodes = "", tree.nodes()
    while node in nodes:
        node = min((-math.log((int(md5(f"{tree.seed}|{path}|{key}".encode()).hexdigest()[:13], 16) + 0.5) / 16 ** 13) / w, path)
                   for path, w in nodes[node].items())[1]
    return int(node.split("/")[-1])


@pytest.fixture
def ids(spark):
    return spark.range(20_000).withColumnRenamed("id", "doc_id")


def placed(ids, tree):
    return {r["doc_id"]: r["s"] for r in ids.select("doc_id", sharding.shard_of(tree, F.col("doc_id")).alias("s")).collect()}


def test_same_as_without_spark(ids):
    tree = Tree((*sharding.even(6).shards, Shard(9, "region0", "rack7", 2.5, 1)))
    got = placed(ids.limit(500), tree)
    assert got == {k: plain(tree, k) for k in got}


def test_shares_follow_weights(ids):
    tree = Tree(tuple(Shard(i, f"r{i % 2}", f"k{i % 3}", w) for i, w in enumerate([1, 2, 3, 4, 5, 5.0])))
    counts = Counter(placed(ids, tree).values())
    for s in tree.shards:
        assert abs(counts[s.number] - 1000 * s.weight) < 5 * math.sqrt(1000 * s.weight)


def test_one_more_shard_takes_rows_into_itself_only(ids):
    tree = sharding.even(16)
    for grown, share in ((tree.grown(), 1 / 17), (tree.grown("region1", "rack2", 4.0), 4 / 20), (tree.grown("new", "new"), 1 / 17)):
        a, b = placed(ids, tree), placed(ids, grown)
        went = Counter(b[k] for k in a if a[k] != b[k])
        assert list(went) == [16] and abs(went[16] - 20_000 * share) < 5 * math.sqrt(20_000 * share)
        left = Counter(a[k] for k in a if a[k] != b[k])
        assert len(left) == 16  # every shard gives some
    twice = tree.grown().grown()
    assert {s for k, s in placed(ids, twice).items() if placed_once(k, ids, tree) != s} <= {16, 17}


_seen = {}


def placed_once(key, ids, tree):
    if not _seen:
        _seen.update(placed(ids, tree))
    return _seen[key]


def test_a_changed_weight_moves_rows_in_its_own_subtree_only(ids):
    tree = sharding.even(16)
    region, rack = {s.number: s.region for s in tree.shards}, {s.number: s.rack for s in tree.shards}
    for weight in (0.25, 3.0):
        new = tree.reweighted(5, weight)
        a, b = placed(ids, tree), placed(ids, new)
        moves = {(a[k], b[k]) for k in a if a[k] != b[k]}
        assert moves
        for x, y in moves:  # between regions: into the changed region or out of it; inside one region, likewise by rack and shard
            touched = "region0" if region[x] != region[y] else "rack1" if rack[x] != rack[y] else 5
            assert touched in ((region[x], region[y]) if region[x] != region[y] else (rack[x], rack[y]) if rack[x] != rack[y] else (x, y))
            assert (y if weight > 1 else x) in {s.number for s in tree.shards if s.region == "region0"}


def test_wrong_trees_are_refused():
    for shards in ((), (Shard(0, "a", "b"), Shard(0, "c", "d")), (Shard(0, "a", "b", 0.0),), (Shard(0, "a/b", "c"),)):
        with pytest.raises(ValueError):
            Tree(shards)


def test_digest(spark):
    rows = [(1, "ä€😀"), (1, "ä€😀"), (2, None), (None, "x"), (None, None), (3, ""), (4, "y" * 100_000), *[(7, "hot")] * 400,
            *[(i, f"t{i}") for i in range(100, 400)]]
    docs = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "doc_id long, text string, shard int, slot int, `row.range` string")
    tree = sharding.even(16)
    got = sharding.digest(docs, tree).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(
        (d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 16) and r["law"] == "key"
        key = "null" if r["doc_id"] is None else r["doc_id"]
        assert r["shard"] == plain(tree, key) and r["grown_shard"] == plain(tree.grown(), key)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    by_shard = defaultdict(list)
    for r in sorted(got, key=lambda r: (r["shard"], r["slot"])):
        by_shard[r["shard"]].append((r["doc_id"] is not None, r["doc_id"] or 0, r["size"], r["text_crc32"]))
    assert all(v == sorted(v) for v in by_shard.values())
    assert sharding.digest(docs.limit(0), tree).count() == 0


def test_written_shards(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "kept") for i in range(200)] + [(None, None, None)], "doc_id long, text string, shard string")
    tree = sharding.even(5)
    back = spark.read.parquet(sharding.write(docs, tree))
    assert sorted((r["doc_id"] or -1, r["shard"]) for r in back.collect()) == sorted(
        (i or -1, plain(tree, "null" if i is None else i)) for i in [*range(200), None])
    moves = sharding.moved(docs, tree, tree.grown()).collect()
    assert {r["new_shard"] for r in moves} == {5}
    assert sharding.moved(docs, tree, tree).count() == 0
