import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from parapet.llm import components, cosine, htmltext, knn, mixing, simhash, suffixes
from pyspark.sql import functions as F


def roots(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(100, 300 + i) for i in range(50)] + [(7, 7), (500, 501)]
    rng.shuffle(links)
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots({x for p in links for x in p}, links)
    assert got == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("block,small", [(2048, 12), (16, 3)])
def test_pigeonring_loses_no_link(spark, monkeypatch, block, small):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "SMALL", small)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 25, np.int64)
    prints = set(base.tolist())
    for x in np.repeat(base[:6], 40).tolist():
        for bit in rng.choice(64, rng.integers(1, 5), replace=False).tolist():
            x ^= 1 << bit
        prints.add(x - (1 << 64) if x >= 1 << 63 else x)
    prints = sorted(prints)
    table = spark.createDataFrame([(p, 0, p) for p in prints], "id long, ring long, print long")
    got = roots(prints, [(r["a"], r["b"]) for r in simhash.pairs(table).collect()])
    want = roots(prints, [(a, b) for i, a in enumerate(prints) for b in prints[:i] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3])
    assert got == want


def test_simhash_edges(spark):
    rows = [(3, "A b c d"), (2, "a  B\tc D"), (5, ""), (4, None), (None, ""), (9, "one"), (9, "one"), (1, "quite another text, it is")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit(0)).withColumn("print", F.lit("x"))
    got = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    by_id = {d: (f, c) for d, f, c in got}
    assert by_id[2] == by_id[3] and by_id[2][1] == 2
    assert by_id[5] == by_id[4] == by_id[None] == ("0" * 16, 4)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_leave_one(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(3000)]
    base = [" ".join(rng.choice(words) for _ in range(300)) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(20):  # one word of 300 replaced: similarity 0.97
        w = base[i].split()
        w[150] = "changed"
        rows.append((100 + i, " ".join(w)))
    rows += [(200, base[0]), (200, base[0]), (0, base[0]), (300, None), (301, "")]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, node string")
    got = sorted(r["doc_id"] for r in simhash.deduplicated(docs).collect())
    assert got == [*range(30), 300]
    assert simhash.deduplicated(docs).columns == docs.columns
    assert simhash.deduplicated(docs.limit(0)).count() == 0


def jaccard_roots(texts):
    sets = [set(simhash.shingles(t.encode()).tolist()) for t in texts]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    return roots(range(len(texts)), links)


@pytest.mark.parametrize("block", [1024, 20])
def test_every_pair_of_a_large_group_is_compared(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "TEXTS", block)
    rng = random.Random(9)
    template = [f"t{i}" for i in range(200)]
    texts = []
    for k in range(30):  # families of one template, at about 0.7 of each other; within a family pairs lie around 0.8
        base = list(template)
        for at in rng.sample(range(200), 4):
            base[at] = f"f{k}x{at}"
        for _ in range(4):
            own = list(base)
            for at in rng.sample(range(200), 2):
                own[at] = f"w{rng.random()}"
            texts.append(" ".join(own))
    sets = [(1, i, simhash.shingles(t.encode()).tolist()) for i, t in enumerate(texts)]
    links = simhash._similar(spark.createDataFrame(sets, "root long, node long, shingles array<long>"), 0.8).collect()
    want = jaccard_roots(texts)
    assert 1 < len(set(want.values())) < len(texts)
    assert roots(range(len(texts)), [(r["a"], r["b"]) for r in links]) == want
    assert len(links) <= len(texts) * (1 if block > len(texts) else 12)


def test_near_duplicates_close_to_the_threshold(spark):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(2000)]
    texts = []
    for size in [9, 12, 20, 30, 40, 60, 100, 150, 300, 600] * 6:
        base = [rng.choice(words) for _ in range(size)]
        texts.append(" ".join(base))
        for _ in range(3):  # a changed stretch, and words cut at the end: similarities from about 0.6 to 0.95
            own = list(base)
            at = rng.randrange(size)
            own[at:at + max(1, size // rng.choice([20, 40]))] = [f"x{rng.random()}"]
            texts.append(" ".join(own[:size - rng.randrange(size // 10 + 1)]))
    texts = list(dict.fromkeys(texts))
    want = jaccard_roots(texts)
    near = [i for i in want if want[i] != i]
    assert 50 < len(near) < len(texts) - 60
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"] for r in simhash.deduplicated(docs).collect()}
    assert got == set(want.values())


def digests(rows):
    first, out = {}, []
    for d, t in rows:
        for i in range(len(t) - 49):
            if d is not None:
                first[t[i:i + 50]] = min(d, first.get(t[i:i + 50], d))
    for d, t in rows:
        covered = bytearray(len(t))
        for i in range(len(t) - 49):
            if d is not None and first[t[i:i + 50]] < d:
                covered[i:i + 50] = b"\1" * 50
        kept = bytes(b for b, c in zip(t, covered) if not c)
        out.append((d, len(t), sum(covered), len([x for x in bytes(covered).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("crowd", [20_000, 3])
def test_repeated_strings(spark, monkeypatch, crowd):
    monkeypatch.setattr(suffixes, "CROWD", crowd)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdé ") for _ in range(rng.randrange(1, 9)))
    passages = ["".join(word() for _ in range(25)) for _ in range(4)]
    rows = [(i, "".join(rng.choice([word(), word() * 3, rng.choice(passages)]) for _ in range(12))) for i in range(40)]
    rows += [(50, "a" * 400), (51, "a" * 60), (52, "a" * 49), (53, None), (54, ""), (None, passages[0]), (7, passages[1] * 2), (55, rows[3][1]), (55, rows[3][1])]
    docs = spark.createDataFrame([(d, t, "k") for d, t in rows], "doc_id long, text string, key string")
    got = sorted((tuple(r) for r in suffixes.digest(docs).collect()), key=repr)
    assert got == digests([(d, (t or "").encode()) for d, t in rows])
    kept = suffixes.remove(docs)
    assert kept.columns == docs.columns and kept.filter("text is null").count() == 1 and kept.count() == len(rows)
    assert suffixes.digest(docs.limit(0)).count() == 0


def test_shared_keys_across_batches(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(40), rng.choice([1, 1, 1, 2, 3]), rng.randrange(3)) for _ in range(150)]
    rows += [(50, 7, n % 4) for n in range(20)] + [(51, 7, 0)] * 9 + [(51, 8, 0)]  # one document's own, and one met late
    keys = spark.createDataFrame(rows, "key long, doc_id long, part int")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        got = {tuple(r) for r in suffixes._shared(keys, 2).collect()}
        none = suffixes._shared(keys.limit(0), 2).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    docs = {k: {d for key, d, _ in rows if key == k} for k, _, _ in rows}
    assert got == {r for r in rows if len(docs[r[0]]) > 1} and not none


def test_keys_are_sorted_by_themselves(spark):
    """One sorted column goes by its digits; rows of a key may come in any order of documents, and more than once."""
    rows = [(k, d, p) for k in range(-20, 20) for d, p in ((7, 1), (3, 2), (7, 3), (7, 1))[:1 + abs(k) % 4]] + [(50, 7, p % 3) for p in range(40)]
    random.Random(2).shuffle(rows)
    keys = spark.createDataFrame(rows, "key long, doc_id long, part int").repartition(3)
    found = suffixes._shared(keys, 2)
    sorts = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Sort [" in line]
    assert sorts and all("doc_id" not in line and "part" not in line for line in sorts)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = {tuple(r) for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    docs = {k: {d for key, d, _ in rows if key == k} for k, _, _ in rows}
    assert got == {r for r in rows if len(docs[r[0]]) > 1}


def test_column_sort_orders_suffixes():
    rng = random.Random(6)
    strings = sorted((bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 20))) for _ in range(30)), key=len, reverse=True)
    sizes = np.array([len(s) for s in strings])
    ends = np.cumsum(sizes)
    start, before, shared = suffixes.column_sort(np.frombuffer(b"".join(strings), np.uint8), ends, sizes)
    whole = b"".join(strings)
    owner = np.minimum(np.searchsorted(ends, start, "right"), len(ends) - 1)
    found = [whole[a:ends[o]] for a, o in zip(start[30:], owner[30:])]
    assert found == sorted(found)
    common = [next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(found, found[1:])]
    assert shared[31:].tolist() == common
    assert [b - 1 for b in before[30:] if b] == [whole[a - 1] for a, o in zip(start[30:], owner[30:]) if a > ends[o] - sizes[o]]


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(30, 16))
    rows = []
    for i in range(900):
        v = centres[i % 30] + rng.normal(size=16) * rng.choice([0.05, 0.25, 0.6])
        rows.append((i, v.astype(np.float32).tolist(), int(i % 2)))
    rows += [(1000 + i, rows[4][1], 0) for i in range(40)]
    rows += [(2000, None, 0), (2001, [0.0] * 16, 0), (2002, [float("nan")] * 16, 0), (2003, rows[4][1], None), (2004, [None] + [1.0] * 15, 0), (2005, [1.0, 2.0], 0)]
    return rows, spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<float>, label int, n int")


@pytest.mark.parametrize("tile", [1024, 50])
def test_cosine_links(spark, monkeypatch, vectors, tile):
    monkeypatch.setattr(cosine, "TILE", tile)
    rows, table = vectors
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in cosine.near_duplicates(table).collect()}
    some = [(i, np.array(v, float), lab) for i, v, lab in rows if i < 2000]
    unit = np.array([v / np.linalg.norm(v) for _, v, _ in some])
    same = (unit @ unit.T >= 0.93) & (np.array([s[2] for s in some])[:, None] == np.array([s[2] for s in some])[None])
    ids = [s[0] for s in some]
    links = [(ids[a], ids[b]) for a, b in zip(*np.nonzero(np.triu(same, 1)))]
    root = roots(ids, links)
    want = {i: (int(same[k].sum()) - 1, root[i], root[i] == i) for k, i in enumerate(ids)}
    want |= {i: (0, i, True) for i in range(2000, 2006)}
    assert got == want
    assert cosine.near_duplicates(table.limit(0)).count() == 0


def test_nearest_recall(spark, monkeypatch, vectors):
    monkeypatch.setattr(knn, "ROWS", 30)
    monkeypatch.setattr(knn, "QUERIES", 5)
    _, table = vectors
    query = F.col("vec_id") % 20 == 0
    found, true = ({(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in f(table, query).collect()}
                   for f in (knn.search, knn.brute_force))
    mine, theirs = ({(q, v) for (q, _), (v, _) in x.items()} for x in (found, {k: v for k, v in true.items() if k in found}))
    assert len(mine & theirs) >= 0.9 * len(true)
    assert knn.search(table.limit(0), query).count() == 0


def test_outliers_get_all_their_neighbours(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 8))
    rows = [(i, centres[i % 40].tolist()) for i in range(1600)]
    far = [(rng.normal(size=8) * 1000).tolist() for _ in range(4)]
    rows += [(10_000 + i, v) for i, v in enumerate(far)] + [(10_000, far[0])] * 15  # rows that share the query's id
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    query = (F.col("vec_id") >= 10_000) | (F.col("vec_id") % 100 == 0)
    found = knn.search(table, query).groupBy("query_id").agg(F.count_distinct("rank").alias("n")).collect()
    assert {r["query_id"]: r["n"] for r in found} == {i: 10 for i in [*range(0, 1600, 100), *range(10_000, 10_004)]}
    few = spark.createDataFrame(rows[:7], "vec_id long, embedding array<double>")
    assert knn.search(few, F.col("vec_id") == 3).count() == 6


def test_every_query_row_has_its_own_ranks(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(200)]
    rows += [(100, rng.normal(size=6).tolist()), rows[40], rows[40]]  # one id with two vectors, one row three times
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    query = F.col("vec_id").isin(40, 60, 100)
    want = []
    for own, v in ((i, v) for i, v in rows if i in (40, 60, 100)):
        far = sorted((float(np.sqrt(((np.array(v) - np.array(u)) ** 2).sum())), i) for i, u in rows if i != own)
        want += [(own, rank, i, d) for rank, (d, i) in enumerate(far[:10], 1)]
    for search in (knn.search, knn.brute_force):
        got = sorted(tuple(r) for r in search(table, query).collect())
        assert [g[:2] for g in got] == sorted(w[:2] for w in want) and len(got) == 60
    exact = sorted(tuple(r) for r in knn.brute_force(table, query).collect())
    assert [(a, b, c) for a, b, c, _ in exact] == sorted((a, b, c) for a, b, c, _ in want)
    for own in (40, 100):
        ranks = [r for q, r, _, _ in got if q == own]
        assert sorted(ranks) == sorted([*range(1, 11)] * (3 if own == 40 else 2))


def test_huge_and_tiny_vectors_link_like_others(spark):
    base = [3.0, -1.0, 0.5, 2.0]
    rows = [(1, base), (2, [x * 1e200 for x in base]), (3, [x * 1e-200 for x in base]), (4, [x * 1e-310 for x in base]),
            (5, [-x for x in base]), (6, [x * 1.1e200 for x in [3.0, -1.0, 0.5, 2.1]]), (7, [1e308, 0.0, 0.0, 0.0]), (8, [5e-324, 0.0, 0.0, 0.0])]
    table = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in cosine.near_duplicates(table).collect()}
    assert got == {**{i: (4, 1) for i in (1, 2, 3, 4, 6)}, 5: (0, 5), 7: (1, 7), 8: (1, 7)}


def test_clashing_names(spark):
    names = ["_hash", "_node", "_least", "_copies", "spans", "_id", "_bytes", "_null", "_text", "other", "a.b", "Row", "_markup", "draw",
             "mix_source", "mix_steps", "mix_n", "mix_draw", "steps", "salt", "doc", "id"]
    shape = "doc_id long, text string, source string, " + ", ".join(f"`{n}` int" for n in names)
    rows = [(i, t, "s", *range(len(names))) for i, t in enumerate(["one two three four five six seven " * 9, "short", None, "short", "é" * 80])]
    docs = spark.createDataFrame(rows + [(9, rows[0][1], "s", *range(len(names)))], shape)
    one = simhash.deduplicated(docs)
    assert one.columns == docs.columns and sorted(r["doc_id"] for r in one.collect()) == [0, 1, 2, 4]
    cut = suffixes.remove(docs)
    assert cut.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == {0: rows[0][1], 1: "short", 2: None, 3: "short", 4: "é" * 80, 9: ""}
    assert all(tuple(r)[3:] == tuple(range(len(names))) for df in (one, cut) for r in df.collect())
    mixed = mixing.mix(docs, scale=3.0)
    assert mixed.columns == [*docs.columns, "mix_copy", "mix_order"] and mixed.count() > 0
    assert all(tuple(r)[3:-2] == tuple(range(len(names))) for r in mixed.collect())
    pages = docs.withColumnRenamed("text", "html")
    text = htmltext.main_text(pages, htmltext.Weights({}, {}))
    assert text.columns == [c for c in pages.columns if c != "html"] + ["text", "n_chars"] and text.count() == 6


def test_rows_of_one_id_spread_over_partitions(spark):
    docs = spark.range(0, 4000, 1, 8).selectExpr("7 AS doc_id", "'t' || id AS text", "'s' AS source")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["n"] for r in mixing.mix(docs, scale=3.0).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 4 and max(sizes) < 2 * sum(sizes) / 4 or sum(sizes) == 0


def test_one_of_each_fingerprint_group(spark):
    rng = random.Random(12)
    texts = [" ".join(rng.choice("abcdefgh") * 3 + str(rng.randrange(40)) for _ in range(120)) for _ in range(12)]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(100 + i, t, "copy") for i, t in enumerate(texts[:5])]
    rows += [(200, texts[0] + " more", "near"), (300, None, "s"), (301, "", "s"), (None, texts[3], "s"), (None, "all alone here", "s"), (2, texts[2], "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `_node` string")
    groups = {}
    for r in simhash.near_duplicates(docs).collect():
        groups.setdefault(r["component_id"], []).append(r["doc_id"])
    got = simhash.one_of_each(docs)
    assert got.columns == docs.columns
    left = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got.collect())
    assert left == sorted((k is None, k or 0) for k in groups) and len(left) == 14
    assert simhash.one_of_each(docs.limit(0)).count() == 0


def test_column_sort_takes_several_symbols_a_round(monkeypatch):
    rng = random.Random(9)
    shared = [bytes(rng.choice(b"ab\0\xff") for _ in range(70)) for _ in range(3)]
    strings = [bytes(rng.choice(b"ab\0\xff") for _ in range(rng.randrange(40))) + rng.choice(shared) for _ in range(40)]
    strings = sorted(strings + [b"a" * 160, b"a" * 161, b"ab", b"a", b""], key=len, reverse=True)
    sizes = np.array([len(s) for s in strings])
    ends, whole = np.cumsum(sizes), b"".join(strings)
    data, m, rounds, least = np.frombuffer(whole, np.uint8), len(strings), [], suffixes.range_min
    monkeypatch.setattr(suffixes, "range_min", lambda *a: rounds.append(1) or least(*a))
    got = suffixes.column_sort(data, ends, sizes)
    assert 0 < len(rounds) <= 41  # the longest string has 161 symbols
    order = sorted((whole[i:e], k, i) for k, (e, n) in enumerate(zip(ends.tolist(), sizes.tolist())) for i in range(e - n, e))
    assert got[0][m:].tolist() == [i for _, _, i in order] and got[0][:m].tolist() == ends.tolist()
    common = [next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for (a, *_), (b, *_) in zip(order, order[1:])]
    assert got[2][m + 1:].tolist() == [min(n, 50) for n in common]
    for x, y in zip(got, suffixes.column_sort(data, ends, sizes, wide=1)):  # keys of large collections
        assert (x == y).all()
    values = np.array([rng.randrange(200) for _ in range(3000)], np.uint8)
    pairs = sorted((rng.randrange(3000), rng.randrange(3000)) for _ in range(500))
    low, high = np.array([min(p) for p in pairs] + [0, 7]), np.array([max(p) for p in pairs] + [2999, 7])
    assert least(values, low, high).tolist() == [values[a:b + 1].min() for a, b in zip(low, high)]


@pytest.mark.parametrize("block", [1, 64, 32 << 10])
def test_runs_of_texts_hashed_in_blocks(monkeypatch, block):
    monkeypatch.setattr(suffixes, "BLOCK", block)
    rng = random.Random(10)
    texts = [bytes(rng.choice(b"abcd") for _ in range(n)) for n in (0, 300, 49, 50, 51, 0, 500, 7, 99)] + [b"a" * 120] * 2
    offsets = np.cumsum([0] + [len(t) for t in texts])
    want = []
    for r, t in enumerate(texts):
        hashes = suffixes.grams(np.frombuffer(t, np.uint8))
        for i in range(len(t) - 49):
            key = int(hashes[i:i + 31].min().view(np.int64))
            if i and want[-1][3] == key:
                want[-1][2] += 1
            else:
                want.append([r, i, 1, key])
    got = suffixes.runs(offsets, np.frombuffer(b"".join(texts), np.uint8))
    assert [list(x) for x in zip(*(c.tolist() for c in got))] == want


def test_spans_are_cut_for_many_texts_at_once():
    kind = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))
    texts = pa.array([b"skipped", b"0123456789", b"abc", b"", b"xyz", b"0123456789"], pa.binary())
    spans = [[(0, 7)], [(6, 8), (1, 3), (3, 4), (7, 9)], [(0, 3)], None, [(0, 1)], []]
    spans = pa.array([s and [{"low": a, "high": b} for a, b in s] for s in spans], kind)
    offsets, data, n, removed = suffixes._kept(texts.slice(1), spans.slice(1))
    assert [data.tobytes()[a:b] for a, b in zip(offsets, offsets[1:])] == [b"0459", b"", b"", b"yz", b"0123456789"]
    assert n.tolist() == [2, 1, 0, 1, 0] and removed.tolist() == [6, 3, 0, 1, 0]


def test_strings_are_not_shuffled_to_meet_crowded_keys(spark, monkeypatch):
    plans = {}
    whole = suffixes.written

    def kept(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return whole(df, name)

    monkeypatch.setattr(suffixes, "written", kept)
    monkeypatch.setattr(suffixes, "CROWD", 2)
    rows = [(k, bytes([65 + i]) * 60, i, i, 0) for k, n in ((1, 2), (2, 4)) for i in range(n)]
    strings = spark.createDataFrame(rows, "key long, string binary, doc_id long, row long, start long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")
    try:
        got = suffixes._by_window(strings.repartition(2)).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plans["crowded"] and "SortMergeJoin" not in plans["crowded"]
    assert sorted(len(r["string"]) for r in got) == [50] * 44 + [60] * 2
