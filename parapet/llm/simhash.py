"""SimHash near-duplicates, candidates by pigeonring filtering.

The 64 bits of a fingerprint lie on a ring of segments. If two fingerprints differ in at most ``limit`` bits, then from
some segment on every chain of consecutive segments keeps within its share of that budget: k segments differ in at most
``k * limit / segments`` bits. The first few segments of such a chain have no difference at all, so they make an
equi-join key, one for each place on the ring. Fingerprints that share a key are compared chain by chain, and only
those with a chain within budget get the full count of differing bits.

Keys that many fingerprints share are split into blocks, and pairs of blocks compared in tasks of their own. Within a
group, links go out as a forest: enough for components, and never more than one per fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from parapet.llm.common import buffers, nested, released, slices, unused, written
from parapet.llm.components import components

LIMIT = 3
SEGMENTS = 16
WIDTH = 64 // SEGMENTS
SEED = 42
#: A key with more fingerprints is split into blocks of about this size.
BLOCK = 2048
#: Groups up to this size are compared shift by shift, all at once.
SMALL = 12
CHUNK = 8 << 20
#: Rows held by a task while it looks for groups.
HELD = 200_000
#: Shingles hashed at once.
SHINGLES = 500_000


def budgets(limit: int = LIMIT, segments: int = SEGMENTS) -> list[tuple[int, int]]:
    """The chain lengths that bind, each with its budget in bits: the last length before the next bit is allowed."""
    share = [k * limit // segments for k in range(1, segments + 1)]
    return [(k, share[k - 1]) for k in range(1, segments + 1) if k == segments or share[k] > share[k - 1]]


def key_segments(limit: int = LIMIT, segments: int = SEGMENTS) -> int:
    """Segments at the head of a chain that cannot differ."""
    k, budget = budgets(limit, segments)[0]
    return k if budget == 0 else 0


def linked(x: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Whether differences, turned so that their chain starts at the top bit, keep within all budgets and the limit."""
    ok = np.ones(x.shape, bool)
    for k, budget in budgets(limit):
        mask = np.uint64(0xFFFFFFFFFFFFFFFF << (64 - k * WIDTH) & 0xFFFFFFFFFFFFFFFF)
        ok &= np.bitwise_count(x & mask) <= budget
    return ok


def _words(data: bytes) -> list[bytes]:
    return data.lower().split()  # bytes: A-Z alone, and the six ASCII blanks


def _hashes(words: list[bytes], n: int) -> Iterator[np.ndarray]:
    """XXH64 of the word shingles, some at a time."""
    if len(words) < n:
        words, n = [b" ".join(words)] if words else [], 1
    for at in range(0, len(words) - n + 1, SHINGLES):
        own = words[at:at + SHINGLES + n - 1]
        joined = map(b" ".join, zip(*[own[i:] for i in range(n)])) if n > 1 else own
        yield np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in joined), np.uint64)


def fingerprints(data: bytes, n: int, many: int = 1) -> list[int]:
    """Fingerprints over ``n``-word shingles, repeats included: a bit is set if it is set in over half the hashes.

    The first uses XXH64 itself, others a mix of it with their number. Without words all bits are zero.
    """
    counts = np.zeros((many, 64), np.int64)
    total = 0
    for hashes in _hashes(_words(data), n):
        total += len(hashes)
        for k in range(many):
            h = hashes if k == 0 else _mixed(hashes, k)
            counts[k] += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
    bits = (2 * counts > total).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view(np.int64).reshape(-1).tolist()


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The finaliser of splitmix64 on the hash plus a multiple of the golden ratio."""
    h = h + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprinted(docs: DataFrame, n: int, many: int = 1, keep: tuple[str, ...] = ("doc_id",),
                  text: str = "text") -> DataFrame:
    """The columns ``keep`` and ``prints``, ``many`` fingerprints of every whole text. Null texts count as empty."""
    names = list(keep)
    rows = docs.select(*names, F.col(text).cast("string").cast("binary").alias("_bytes"))

    def run(batches):
        for batch in slices(batches, "_bytes", CHUNK):
            offsets, data = buffers(batch.column("_bytes"))
            data = data.tobytes()
            found = [fingerprints(data[a:b], n, many) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(found, pa.list_(pa.int64()))],
                                             names + ["prints"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join([f"`{c}` {kinds[c]}" for c in names] + ["prints array<long>"]))


def _forest(turned: np.ndarray, ids: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a group as a forest. With ``first`` < size, only links between the two halves are looked for."""
    n = len(turned)
    left = np.ones(n, bool)
    ours, theirs = [], []
    todo = np.arange(n)
    while len(todo):
        frontier = [todo[0]]
        left[todo[0]] = False
        while frontier:
            node = frontier.pop()
            rest = todo[left[todo]]
            if first < n:
                rest = rest[(rest >= first) != (node >= first)]
            hit = rest[linked(turned[rest] ^ turned[node])]
            if len(hit):
                left[hit] = False
                frontier += hit.tolist()
                ours.append(np.full(len(hit), ids[node]))
                theirs.append(ids[hit])
        todo = todo[left[todo]]
    none = np.zeros(0, np.int64)
    return (np.concatenate(ours), np.concatenate(theirs)) if ours else (none, none)


def _links(group: np.ndarray, half: np.ndarray, turned: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    """Links within the runs of equal ``group``; rows of a split group are sorted by ``half``."""
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    sizes = np.diff(np.append(starts, len(group)))
    small = np.repeat(sizes <= SMALL, sizes)
    ours, theirs = [], []
    for shift in range(1, min(SMALL, sizes.max())):
        i = np.flatnonzero(small[:-shift] & (group[shift:] == group[:-shift]))
        i = i[linked(turned[i] ^ turned[i + shift])]
        ours.append(ids[i])
        theirs.append(ids[i + shift])
    for start, size in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
        own = slice(start, start + size)
        first = int(np.searchsorted(half[own], 1)) if half[own][-1] == 1 and half[own][0] == 0 else size
        a, b = _forest(turned[own], ids[own], first)
        ours.append(a)
        theirs.append(b)
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ours, theirs))
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])


def pairs(prints: DataFrame) -> DataFrame:
    """Links ``a, b`` (ids) that connect all rows of ``id, ring, print`` whose prints differ in at most ``LIMIT`` bits.

    Prints are compared within a ring only. Small groups give all their links, larger ones a forest with the same
    components; a link may come out several times.
    """
    spark = prints.sparkSession
    head = key_segments() * WIDTH
    starts = prints.select("id", "ring", "print", F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS - 1))).alias("at"))
    turned = starts.select("id", F.expr(f"shiftleft(print, {WIDTH} * at) | IF(at = 0, 0L, shiftrightunsigned(print, 64 - {WIDTH} * at))")
                           .alias("turned"), "ring", "at")
    keyed = turned.select("id", "turned", F.expr(
        f"(ring * {SEGMENTS}L + at) * {1 << head}L + shiftrightunsigned(turned, {64 - head})").alias("key"))
    hot = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK).select(
        "key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "hot-keys")
    spread = keyed.join(hot, "key", "left").withColumn("own", F.when(
        F.col("blocks").isNotNull(), F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).otherwise(F.lit(0)))
    pieces = spread.select("id", "turned", "key", "own", F.explode(F.sequence(
        F.lit(0), F.coalesce(F.col("blocks"), F.lit(1)) - 1)).alias("other"))
    dealt = pieces.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
                          (F.col("own") > F.col("other")).cast("int").alias("half"), "turned", "id")
    ordered = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key", "low", "high") \
        .sortWithinPartitions("key", "low", "high", "half")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = 0

        def columns():
            return [np.concatenate(c) for c in zip(*held)]

        def numbered(c):
            change = (c[0][1:] != c[0][:-1]) | (c[1][1:] != c[1][:-1]) | (c[2][1:] != c[2][:-1])
            return np.concatenate([[0], np.cumsum(change)])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([batch.column(k).to_numpy(zero_copy_only=False) for k in
                         ("key", "low", "high", "half", "turned", "id")])
            rows += batch.num_rows
            if rows >= HELD:
                c = columns()
                group = numbered(c)
                last = int(np.searchsorted(group, group[-1]))  # the last group may go on
                if last:
                    yield _links(group[:last], c[3][:last], c[4][:last].view(np.uint64), c[5][:last])
                held, rows = [[x[last:] for x in c]], len(group) - last
        if rows:
            c = columns()
            yield _links(numbered(c), c[3], c[4].view(np.uint64), c[5])

    return ordered.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, n: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, fingerprint`` (16 hex digits) and ``component_id``, the least id it can reach.

    Documents with equal fingerprints are one class; links between classes are found as described above. Null and empty
    texts have fingerprint zero and link like any other. Null ids are never the least id; a component without any id has
    none. Repeated rows and ids are kept.
    """
    return _grouped(docs, n, doc_id, text).select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def _grouped(docs: DataFrame, n: int, doc_id: str, text: str) -> DataFrame:
    """``doc_id, hash`` (of the text), ``print``, and ``root`` and ``component_id`` of the group, per row."""
    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), raw_hash(f"`{text}`").alias("hash"))
    prints = written(fingerprinted(own, n, keep=("doc_id", "hash")).select(
        "doc_id", "hash", F.col("prints")[0].alias("print")), "prints")
    classes = written(prints.groupBy("print").agg(F.min("doc_id").alias("least")), "classes")
    links = pairs(classes.select(F.col("print").alias("id"), F.lit(0).cast("long").alias("ring"), "print"))
    roots = components(links)
    members = classes.join(roots, F.col("print") == F.col("node"), "left").select(
        "print", "least", F.coalesce("root", "print").alias("root"))
    least = members.groupBy("root").agg(F.min("least").alias("component_id"))
    named = members.join(least, "root").select("print", "root", "component_id")
    return prints.join(named, "print")


def one_of_each(docs: DataFrame, n: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with one of each group of ``near_duplicates`` left: the one with the least id.

    All columns stay. Groups hang together by fingerprints of ``n``-word shingles within ``LIMIT`` bits, found by pigeonring;
    words are not compared beside that. Null and empty texts are copies of each other. Rows without id are kept only if
    their group has no other; of rows with the same id and text, one stays.
    """
    found = written(_grouped(docs, n, doc_id, text).select("root", "doc_id", F.col("hash").alias("node")), "groups")
    best = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("least"), "node")).alias("best"))
    return _left(docs, best, found, doc_id, text)


#: The pipeline's stage: word shingles and similarity that make two texts near duplicates.
SHINGLE, SIMILARITY = 5, 0.8
#: Rounds that leave out texts with too few shared shingles. More rounds propose fewer pairs and lose none.
PRUNE = 3
#: Texts, and shingles, of about one block when a proposed group is compared.
TEXTS, HASHES = 1024, 2 << 20


def shingles(data: bytes, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles (of the whole text, if it is shorter)."""
    found = [h for h in _hashes(_words(data), n)]
    return np.unique(np.concatenate(found)).view(np.int64) if found else np.zeros(0, np.int64)


def needed(size: int | np.ndarray, similarity: float) -> int | np.ndarray:
    """Shingles among its ``prefix`` that a set shares with each similar set among that set's prefix.

    The prefix of a set holds its first ``depth`` shingles in common with any similar set; a similar set can be smaller,
    by the similarity, and its prefix less deep.
    """
    return _depth(_least(size, similarity), similarity)


def _least(size, similarity):
    """The least size of a similar set, and the least number of shingles shared with it."""
    return np.ceil(size * similarity - 1e-6).astype(np.int64)


def _depth(size, similarity):
    return 1 + np.floor(size * (1 - similarity) + 1e-6).astype(np.int64)


def prefix(hashes: np.ndarray, similarity: float) -> np.ndarray:
    """The least hashes of a sorted set, as many as ``needed`` relies on."""
    n = np.int64(len(hashes))
    return hashes[:n - _least(n, similarity) + _depth(n, similarity)] if n else hashes


def proposed(rows: DataFrame, n: int, similarity: float) -> DataFrame:
    """Links ``a, b`` that connect all texts of ``node, text`` whose shingle sets have that Jaccard similarity.

    Two such sets share enough of their least hashes. So shingles that occur once are left out, then texts with too few
    others, and again. What is left of a text is ordered from rare to common: if a pair shares k of m shingles, it shares
    one of the first m - k + 1, and texts with one of these in common are linked.
    """
    spark = rows.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "bytes", CHUNK // 4):
            sets = [shingles(x, n) for x in batch.column("bytes").to_pylist()]
            heads = [prefix(x, similarity) for x in sets]
            lengths = [len(x) for x in heads]
            need = needed(np.array([len(x) for x in sets], np.int64), similarity)
            found = np.concatenate(heads), np.repeat(batch.column("node").to_numpy(), lengths), \
                np.repeat(need.astype(np.int32), lengths)
            for at in range(0, len(found[0]), HELD):
                yield pa.RecordBatch.from_arrays([pa.array(x[at:at + HELD]) for x in found], ["token", "node", "need"])

    tokens = rows.select("node", F.col("text").cast("binary").alias("bytes")).mapInArrow(
        run, "token long, node long, need int")
    # equal texts count too; their rows become one below
    several = written(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("token"), "several")
    released(spark)
    shared = written(tokens.join(several, "token", "left_semi").distinct(), "shared")
    released(spark)
    for _ in range(PRUNE):
        texts = shared.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.first("need").alias("need")).filter("n >= need")
        some = shared.join(texts.select("node"), "node", "left_semi")
        several = some.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("token")
        shared = written(some.join(several, "token", "left_semi"), "shared")
    df = written(shared.groupBy("token").agg(F.count(F.lit(1)).alias("df")), "frequencies")
    order = Window.partitionBy("node").orderBy("df", "token")
    ranked = shared.join(df, "token").withColumn("rank", F.row_number().over(order)).withColumn(
        "m", F.count(F.lit(1)).over(Window.partitionBy("node")))
    heads = written(ranked.filter("rank <= m - need + 1").select("token", "node"), "heads")
    least = heads.groupBy("token").agg(F.min("node").alias("b"))
    return heads.join(least, "token").filter("node != b").select(F.col("node").alias("a"), "b").distinct()


def _alike(sets: list[np.ndarray], half: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """A forest with the components of all pairs of that Jaccard similarity; of a split group, pairs of both halves only.

    Every text is compared with all that could reach the similarity by their size and are not linked to it yet.
    """
    sizes = np.array([len(x) for x in sets])
    order = np.argsort(sizes, kind="stable")
    sizes, half = sizes[order], half[order]
    known, flat = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    across = half.min() != half.max()
    left, here = np.ones(len(sets), bool), np.zeros(len(known), bool)
    ours, theirs = [], []
    for seed in range(len(sets)):
        frontier = [seed] if left[seed] else []
        left[seed] = False
        while frontier:
            node = frontier.pop()
            low = int(np.searchsorted(sizes, int(sizes[node] * similarity)))
            high = int(np.searchsorted(sizes, int(sizes[node] / similarity) + 1, "right"))
            rest = left[low:high] & (half[low:high] != half[node]) if across else left[low:high]
            if not rest.any():
                continue
            own = flat[starts[node]:starts[node + 1]]
            here[own] = True
            both = np.add.reduceat(here[flat[starts[low]:starts[high]]], starts[low:high] - starts[low], dtype=np.int64)
            here[own] = False
            hit = low + np.flatnonzero(rest & (both >= similarity * (sizes[node] + sizes[low:high] - both)))
            left[hit] = False
            frontier += hit.tolist()
            ours.append(np.full(len(hit), order[node]))
            theirs.append(order[hit])
    none = np.zeros(0, np.int64)
    return (np.concatenate(ours), np.concatenate(theirs)) if ours else (none, none)


def _similar(members: DataFrame, similarity: float) -> DataFrame:
    """Links ``a, b`` that connect all texts of ``root, node, shingles`` with that similarity and the same root.

    Large groups go block against block, so that every pair of a group meets in some task.
    """
    spark = members.sparkSession
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("shingles")).alias("hashes")).select(
        "root", F.ceil(F.greatest(F.col("n") / TEXTS, F.col("hashes") / HASHES)).cast("int").alias("blocks"))
    own = members.join(sizes, "root").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pieces = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = pieces.select("root", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
                          (F.col("own") > F.col("other")).cast("int").alias("half"), "node", "shingles")
    ordered = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "root", "low", "high") \
        .sortWithinPartitions("root", "low", "high", "half", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, halves, sets = None, [], [], []

        def done():
            ids = np.array(nodes, np.int64)
            a, b = _alike(sets, np.array(halves), similarity)
            a, b = ids[a], ids[b]
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])

        for batch in batches:
            column = batch.column("shingles")
            ends, flat = column.offsets.to_numpy(), column.values.to_numpy()
            for i, (*new, half, node) in enumerate(zip(*(batch.column(c).to_pylist() for c in (
                    "root", "low", "high", "half", "node")))):
                if new != key and len(nodes) > 1:
                    yield done()
                if new != key:
                    key, nodes, halves, sets = new, [], [], []
                nodes.append(node)
                halves.append(half)
                sets.append(flat[ends[i]:ends[i + 1]].copy())
        if len(nodes) > 1:
            yield done()

    return ordered.mapInArrow(run, "a long, b long")


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = SHINGLE,
                 similarity: float = SIMILARITY) -> DataFrame:
    """The documents with one of each group of near duplicates left, the one with the least id.

    Near duplicates are texts with equal bytes, or with a Jaccard similarity of their ``n``-word shingle sets of at least
    ``similarity``, directly or over others. Candidates come from an exact filter on shared shingles, and every pair within
    a group of candidates is compared on whole shingle sets: no pair is missed, none is linked without that reason.

    All columns stay. Null and empty texts are copies of each other. Rows without id are kept only if their group has no
    other; of rows with the same id and text, one stays. Texts are told apart by a 64-bit hash.
    """
    raw = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), raw.alias("text"), F.xxhash64(raw).alias("node"))
    names = written(rows.select("doc_id", "node"), "names")
    classes = written(names.groupBy("node").agg(F.min("doc_id").alias("least")), "classes")
    candidates = written(components(written(proposed(rows, n, similarity), "candidates")), "members")
    released(docs.sparkSession)
    wanted = written(candidates.join(classes, "node").select("node", "least"), "wanted")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "bytes", CHUNK):
            found = [shingles(x, n) for x in batch.column("bytes").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), nested(found, pa.int64())], ["node", "shingles"])

    texts = rows.join(wanted, "node").filter(F.col("doc_id").eqNullSafe(F.col("least"))).select(
        "node", F.col("text").cast("binary").alias("bytes"))
    shingled = written(texts.mapInArrow(sets, "node long, shingles array<long>").dropDuplicates(["node"]), "shingles")
    released(docs.sparkSession)
    members = candidates.join(shingled.filter(F.size("shingles") > 0), "node").select("root", "node", "shingles")
    roots = components(written(_similar(members, similarity), "links"))
    known = classes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    best = known.groupBy("root").agg(F.min(F.struct(F.col("least").isNull(), "least", "node")).alias("best"))
    return _left(docs, best, names, doc_id, text)


def _left(docs: DataFrame, best: DataFrame, names: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The rows of ``docs`` that ``best`` names by hash and id (``best.node``, ``best.least``), one of those alike."""
    hashed, node, own_id, copies = unused(docs.columns, "_hash", "_node", "_least", "_copies")
    chosen = best.select(F.col("best.node").alias(node), F.col("best.least").alias(own_id))
    counts = names.groupBy("node", "doc_id").agg(F.count(F.lit(1)).alias(copies))
    kept = written(chosen.join(counts, (F.col("node") == F.col(node)) & F.col("doc_id").eqNullSafe(F.col(own_id)))
                   .select(node, own_id, copies), "kept")
    own = docs.withColumn(hashed, raw_hash(text))
    same = (F.col(hashed) == F.col(node)) & F.col(f"`{doc_id}`").eqNullSafe(F.col(own_id))
    single = own.join(kept.filter(F.col(copies) == 1), same, "left_semi")
    # rows that share id and text: usually none, so a small table that Spark can broadcast
    shared = own.join(written(kept.filter(F.col(copies) > 1), "shared"), same, "left_semi").dropDuplicates([doc_id, hashed])
    return single.unionByName(shared).select(*[F.col(f"`{c}`") for c in docs.columns])


def raw_hash(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))
