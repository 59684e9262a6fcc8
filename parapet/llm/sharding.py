"""Rows placed into shards by a hierarchical weighted hash tree.

A tree has three levels: regions, racks, shards. A row descends by weighted hash draws: at every node each child draws
``-ln(u) / weight``, with ``u`` in (0, 1) from a hash of seed, child and key, and the least draw wins. A child is chosen
in proportion to its weight, and the draws of the other children do not depend on it; so after a change of weight rows
only move between subtrees whose weights changed (all shards below the nodes on the changed path), never between others.

Growth keeps rows even stiller. A shard added later belongs to a younger *generation* (``since``). Generations draw apart
at the top of the tree: each region has one entry per generation, weighing what its shards of that generation weigh. A new
shard's entry then takes rows from all shards in proportion and gives them to that shard alone, although it stands in
a rack that already exists.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from parapet.llm.common import folder, written
from parapet.llm.mixing import DIGITS, unit

SEED = 29
RACKS_PER_REGION = 2
SHARDS_PER_RACK = 4


@dataclass(frozen=True)
class Shard:
    """A leaf: its number, where it stands, how much it takes, and the generation it came with."""

    number: int
    region: str
    rack: str
    weight: float = 1.0
    since: int = 0


@dataclass(frozen=True)
class Tree:
    """The shards and the seed of the draws. Shard numbers are unique; weights are positive and finite."""

    shards: tuple[Shard, ...]
    seed: int = SEED

    def __post_init__(self):
        if not self.shards:
            raise ValueError("a tree needs a shard")
        if len({s.number for s in self.shards}) != len(self.shards):
            raise ValueError("two shards share a number")
        if any(not (s.weight > 0 and math.isfinite(s.weight)) for s in self.shards):
            raise ValueError("weights are positive and finite")
        if any("/" in name for s in self.shards for name in (s.region, s.rack)):
            raise ValueError("names hold no slash")

    def nodes(self) -> dict[str, dict[str, float]]:
        """Children and their weights by node; the root is the empty path, a leaf's path ends with its number."""
        found: dict[str, dict[str, float]] = {}
        for s in sorted(self.shards, key=lambda s: s.number):
            path = ""
            for step in (f"{s.since}:{s.region}", s.rack, str(s.number)):
                child = f"{path}/{step}"
                below = found.setdefault(path, {})
                below[child] = below.get(child, 0.0) + s.weight
                path = child
        return found

    def grown(self, region: str | None = None, rack: str | None = None, weight: float = 1.0) -> Tree:
        """The tree with one more shard; rows move only into it.

        Without a place it goes to the rack with the least weight (the first of them).
        """
        if region is None or rack is None:
            held: dict[tuple[str, str], float] = {}
            for s in self.shards:
                held[s.region, s.rack] = held.get((s.region, s.rack), 0.0) + s.weight
            region, rack = min(held, key=lambda place: held[place])
        new = Shard(max(s.number for s in self.shards) + 1, region, rack, weight, max(s.since for s in self.shards) + 1)
        return replace(self, shards=(*self.shards, new))

    def reweighted(self, number: int, weight: float) -> Tree:
        """The tree with another weight for one shard."""
        return replace(self, shards=tuple(replace(s, weight=weight) if s.number == number else s for s in self.shards))


def even(shards: int, racks_per_region: int = RACKS_PER_REGION, per_rack: int = SHARDS_PER_RACK, seed: int = SEED) -> Tree:
    """A tree of equal shards, rack after rack."""
    racks = [i // per_rack for i in range(shards)]
    return Tree(tuple(Shard(i, f"region{r // racks_per_region}", f"rack{r}") for i, r in enumerate(racks)), seed)


def _level(tree: Tree, key: Column, node: Column, table: Column) -> Column:
    """The path of the child that a row descends to."""
    def draw(child: Column) -> Column:
        u = unit(F.lit(tree.seed), child["path"], key)
        return F.struct((-F.log(u) / child["weight"]).alias("draw"), child["path"].alias("path"))

    return F.array_min(F.transform(table[node], draw))["path"]


def shard_of(tree: Tree, key: Column) -> Column:
    """The number of the shard that a key belongs to (int). A null key is a key like any other.

    The tree is a literal of its nodes; a row draws only among the children of the nodes it passes.
    """
    table = F.create_map(*[x for node, children in tree.nodes().items() for x in (
        F.lit(node), F.array(*[F.struct(F.lit(path).alias("path"), F.lit(float(weight)).alias("weight"))
                               for path, weight in children.items()]))])
    region = _level(tree, key, F.lit(""), table)
    leaf = _level(tree, key, _level(tree, key, region, table), table)
    return F.element_at(F.split(leaf, "/"), -1).cast("int")


def digest(docs: DataFrame, tree: Tree, grown: Tree | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row.

    ``size`` is the text's UTF-8 bytes (a null text has none) plus 1. ``slot`` numbers a shard's rows from 0 without gaps,
    by id (null first), size and checksum; rows that agree in all three are interchangeable. ``grown_shard`` is where the
    row lies in ``grown``, by default the tree with one more shard. Rows that share an id share a shard. Other columns
    are not read; an empty table gives no rows. Texts of any length are hashed in the scan and not shuffled.

    Rows are dealt out by ranges of (shard, id, size, checksum, row), so neither a heavy shard nor an id with very many
    rows is one task's work; each range knows its place in the shard from the counts of the ranges before it.
    """
    grown = tree.grown() if grown is None else grown
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    key = F.col(doc_id)
    rows = docs.select(
        key.cast("long").alias("doc_id"), (F.octet_length(content) + 1).cast("long").alias("size"),
        F.crc32(content.cast("binary")).alias("text_crc32"), shard_of(tree, key).alias("shard"),
        shard_of(grown, key).alias("grown_shard"), F.monotonically_increasing_id().alias("row"))
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["shard", "doc_id", "size", "text_crc32", "row"]
    dealt = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    # a row's place in its range: the lower 33 bits of the id
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = written(dealt.drop("row").withColumns({"range": F.spark_partition_id(), "place": place}), "shards")
    runs = placed.groupBy("shard", "range").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    earlier = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select("shard", "range", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("start"))
    # at most one row per range and shard boundary: the ranges plus the shards, whatever the table's size
    return placed.join(F.broadcast(starts), ["shard", "range"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("place") + F.col("start")).alias("slot"),
        "grown_shard")


def write(docs: DataFrame, tree: Tree, path: str | None = None, doc_id: str = "doc_id") -> str:
    """Write whole rows, one folder per shard (column ``shard``; a column of that name is replaced); gives the path.

    Every task writes its rows into the folders of their shards: nothing is shuffled and a heavy shard is many files.
    """
    path = path or folder(docs.sparkSession, "sharded")
    docs.withColumn("shard", shard_of(tree, F.col(doc_id))).write.partitionBy("shard").parquet(path)
    return path


def moved(docs: DataFrame, before: Tree, after: Tree, doc_id: str = "doc_id") -> DataFrame:
    """How many rows go where when one tree takes the other's place: ``shard, new_shard, n_rows``, moving rows only."""
    key = F.col(doc_id)
    return docs.select(shard_of(before, key).alias("shard"), shard_of(after, key).alias("new_shard")).filter(
        "shard != new_shard").groupBy("shard", "new_shard").agg(F.count(F.lit(1)).alias("n_rows"))


def _placed_sql(tree: Tree, name: str) -> str:
    """``d`` and the shard of every distinct id, three draws one after the other."""
    rows = ", ".join(f"('{node}', '{path}', {weight!r}::DOUBLE)"
                     for node, children in tree.nodes().items() for path, weight in children.items())
    levels, last = [], f"(SELECT d, '' AS path FROM ids)"
    for i in range(3):
        u = (f"(('0x' || substr(md5('{tree.seed}|' || n.path || '|' || coalesce(d::VARCHAR, 'null')), 1, {DIGITS}))::BIGINT + 0.5)"
             f" / {16 ** DIGITS}::DOUBLE")
        levels.append(f"{name}_{i} AS (SELECT d, arg_min(n.path, -ln({u}) / n.weight) AS path FROM {last} p "
                      f"JOIN {name}_nodes n ON n.node = p.path GROUP BY d)")
        last = f"{name}_{i}"
    return (f"{name}_nodes(node, path, weight) AS (VALUES {rows}), " + ", ".join(levels)
            + f", {name} AS (SELECT d, split_part(path, '/', 4)::INTEGER AS shard FROM {last})")


def statement(tree: Tree, grown: Tree | None = None, docs: str = "documents") -> str:
    """The rows of ``digest`` from DuckDB; the checksum goes byte by byte over a table made from its polynomial."""
    grown = tree.grown() if grown is None else grown
    return f"""
WITH bits AS (SELECT i, list_reduce(list_prepend(i::BIGINT, [0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[]),
                  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)),
bytes AS (SELECT list(v ORDER BY i) AS t FROM bits),
ids AS (SELECT DISTINCT doc_id AS d FROM {docs}),
{_placed_sql(tree, "now")},
{_placed_sql(grown, "later")},
sums AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
    string_split(regexp_replace(hex(encode(coalesce(text, ''))), '(..)', '\\1 ', 'g'), ' ')[:-2], lambda x: ('0x' || x)::BIGINT)),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) AS text_crc32 FROM {docs}, bytes)
SELECT doc_id, size, text_crc32, 'key' AS law, now.shard, row_number() OVER (
    PARTITION BY now.shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, later.shard AS grown_shard
FROM sums JOIN now ON now.d IS NOT DISTINCT FROM doc_id JOIN later ON later.d IS NOT DISTINCT FROM doc_id
"""
