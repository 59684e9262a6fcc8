"""Exact removal of repeated byte strings with suffix arrays built column by column.

Which bytes of a document lie in a string of ``LENGTH`` bytes that also starts in a document with a smaller id? Strings
that are equal have the same least hash of a shorter gram, so all windows of a text fall into runs that share that hash,
and equal windows always meet under the same hash. Runs whose hash occurs in one document only are dropped. The others
are the documents of collections that tasks sort: one round inserts the next few symbols of every string, from the right,
into the collection's Burrows-Wheeler transform, each at the place given by the symbols that start there and the rank of the
suffix behind them, and updates the common prefixes next to what was inserted. In the end windows that share ``LENGTH``
symbols lie side by side, and each learns the least document that holds it.

Collections are small (``COLLECTION`` bytes), independent and read in one sequential pass per round. They stay in memory:
files beside a task would be machine-local scratch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F, types as T

from parapet.llm.common import buffers, discarded, nested, released, slices, written

LENGTH = 50
#: Bytes of the grams that are hashed; every window has ``LENGTH - GRAM + 1`` of them.
GRAM = 20
#: Windows of a run that go into one string; longer runs are cut, with an overlap of ``LENGTH - 1`` bytes.
LONGEST = 128
#: A hash with more different strings is dealt out by single windows instead.
CROWD = 20_000
COLLECTION = 256 << 10
CHUNK = 4 << 20
#: Text searched for runs at once: its arrays of hashes stay in the processor's cache.
SCAN = 256 << 10
#: Positions hashed at once.
BLOCK = 32 << 10
#: Texts that share an id are dealt out by this many remainders of their hash.
PARTS = 1 << 16
#: Rows of strings held by a task while it looks for those of one hash.
HELD = 20_000


def grams(data: np.ndarray, size: int = GRAM) -> np.ndarray:
    """A hash of the ``size`` bytes from each position on, by doubling."""
    table = np.random.default_rng(1).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
    factor = np.uint64(0x9E3779B97F4A7C15)
    out, width, done = None, 1, 0
    power, step = table[data], int(factor)
    while width <= size:
        if size & width:
            if out is None:
                out, done = power, width
            else:
                n = len(out) - width  # the part found so far follows this one
                joined = power[:n] * _pow(factor, done)
                joined += out[width:]
                out = joined
                done += width
        n = len(power) - width
        if n <= 0 or 2 * width > size:
            break
        joined = power[:n] * np.uint64(step)
        joined += power[width:]
        power = joined
        step = step * step % (1 << 64)
        width *= 2
    if done != size or len(data) < size:
        return np.zeros(0, np.uint64)
    h = out[:len(data) - size + 1]
    h = h ^ (h >> np.uint64(29))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _pow(x: np.uint64, n: int) -> np.uint64:
    return np.uint64(pow(int(x), n, 1 << 64))


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbouring values."""
    size, out = 1, values
    while 2 * size <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[:len(values) - width + 1], out[width - size:width - size + len(values) - width + 1])


def runs(offsets: np.ndarray, data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Runs of windows with the same least gram hash: row, first byte in the text, windows, hash."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64))
    sizes = np.diff(offsets)
    if len(data) < length or not (sizes >= length).any():
        return none
    key = np.empty(len(data) - length + 1, np.uint64)
    for at in range(0, len(key), BLOCK):
        key[at:at + BLOCK] = least(grams(data[at:at + BLOCK + length - 1]), length - GRAM + 1)
    # a run starts with another key, with a text, and behind the last window of a text; the last kind holds no windows
    windows = np.maximum(sizes - length + 1, 0)
    change = np.append(True, key[1:] != key[:-1])
    opens = np.append(offsets[:-1], offsets[:-1] + windows)
    change[opens[opens < len(key)]] = True
    inside = np.repeat(np.tile([True, False], len(sizes)), np.stack([windows, sizes - windows], 1).ravel())
    starts = np.flatnonzero(change)
    n = np.diff(np.append(starts, len(key)))
    whole = inside[starts]
    starts, n = starts[whole], n[whole]
    row = np.searchsorted(offsets[1:], starts, "right")
    return row, starts - offsets[row], n, key[starts].view(np.int64)


def range_min(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of ``values[a] .. values[b]``, for each pair ``a <= b``: that of two stretches of 2^k values that meet."""
    out = np.empty(len(a), values.dtype)
    level = (np.frexp((b - a + 1).astype(np.float64))[1] - 1).astype(np.uint8)
    order = np.argsort(level, kind="stable")
    a, b = a[order], b[order]
    least_of, size, done = values, 1, 0  # least_of[i]: the least of ``size`` values from i on
    for n in np.bincount(level).tolist():
        if n:
            own = slice(done, done + n)
            out[order[own]] = np.minimum(least_of[a[own]], least_of[b[own] - (size - 1)])
            done += n
        if done < len(a):
            least_of = np.minimum(least_of[:-size], least_of[size:])
            size *= 2
    return out


def column_sort(data: np.ndarray, ends: np.ndarray, sizes: np.ndarray, cap: int = LENGTH, wide: int = 1 << 27):
    """Sort all suffixes of a collection by inserting a column of a few symbols per string and round.

    String i is ``data[ends[i] - sizes[i]:ends[i]]``; sizes fall. A round inserts the next ``step`` suffixes of every string,
    each placed by its first ``step`` symbols and the rank of what follows them, which the round before has inserted. Gives,
    in suffix order (the empty suffixes first): where the suffix starts in ``data``, the symbol before it (plus one, 0 at a
    string's start), and how many symbols it shares with its predecessor, up to ``cap``. Collections of ``wide`` suffixes and
    more take keys with room for longer ranks and fewer symbols.
    """
    m = len(sizes)
    total = m + int(sizes.sum())
    step, bits = (4, 27) if total < wide else (2, 40)
    low = (1 << bits) - 1
    # the first symbols of each suffix, 9 bits each (plus one, 0 behind the end), above the place of the rank
    left = np.repeat(ends, sizes) - np.arange(len(data))
    code = np.zeros(len(data), np.int64)
    for k in range(min(step, len(data))):
        code[:len(data) - k] |= np.where(left[:len(data) - k] > k, data[k:] + np.int64(1), 0) << (bits + 9 * (step - 1 - k))
    del left
    key = np.arange(m)  # the empty suffixes rank by string
    shared = np.zeros(m, np.uint8)
    ranks = [key] * step  # of what follows the first symbols of the suffixes that are next
    active = np.searchsorted(-sizes, -np.arange(1, int(sizes[0]) + 1 if m else 1), "right").tolist()
    for j in range(0, len(active), step):
        counts = active[j:j + step]
        new = np.concatenate([code[ends[:a] - j - p] | ranks[p - 1][:a] for p, a in enumerate(counts, 1)])
        order = np.argsort(new)
        new = new[order]
        place = np.searchsorted(key, new)
        at = place + np.arange(len(new))
        old = np.ones(len(key) + len(new), bool)
        old[at] = False
        # how far what was there moves on
        shift = np.repeat(np.arange(len(new) + 1), np.diff(place, prepend=0, append=len(key)))

        key2 = np.empty(len(old), np.int64)
        key2[old] = key
        key2[at] = new
        shared2 = np.zeros(len(old), np.uint8)
        shared2[old] = shared
        old[at[at + 1 < len(old)] + 1] = False  # what was inserted and what follows it
        touched = np.flatnonzero(~old)
        x, y = key2[touched - 1], key2[touched]
        same = np.zeros(len(touched), np.uint8)
        alike = np.ones(len(touched), bool)
        for k in range(step):
            place_of = bits + 9 * (step - 1 - k)
            alike &= (x >> place_of == y >> place_of) & (y >> place_of & 511 > 0)
            same += alike
        x, y = x[alike] & low, y[alike] & low
        same[alike] = np.minimum(range_min(shared, x + 1, y), cap - step) + step
        shared2[touched] = np.minimum(same, cap)
        key2 += shift.take(key2 & low)
        key, shared = key2, shared2
        rank = np.empty(len(order), np.int64)
        rank[order] = at
        ranks = np.split(rank, np.cumsum(counts)[:-1])
    # where suffixes start: the shortest follow from the string and how many symbols they have, and each leads to the suffix
    # that has one column of symbols more
    after = key[m:] & low
    short = np.flatnonzero(after < m) + m
    longer = np.zeros(total, np.int64)
    longer[after] = np.arange(m, total)
    held = sum((key[short] >> (bits + 9 * k) & 511 > 0).astype(np.int64) for k in range(step))
    start = np.empty(total, np.int64)
    start[:m] = ends
    first_ranks = np.zeros((step + 1, m), np.int64)
    first_ranks[held, key[short] & low] = short
    for p in range(1, min(step, len(active)) + 1):
        at = first_ranks[p]
        for j in range(p, len(active) + 1, step):
            a = active[j - 1]
            at = at[:a] if j == p else longer[at[:a]]
            start[at] = ends[:a] - j
    first = np.zeros(len(data) + 1, bool)
    first[ends - sizes] = True
    before = np.zeros(total, np.int16)
    inner = np.append(sizes > 0, ~first[start[m:]])
    before[inner] = data[start[inner] - 1].astype(np.int16) + 1
    return start, before, shared


def least_holders(strings: list[bytes], docs: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each window of each string, the least document among the strings that hold that window."""
    order = np.argsort([-len(s) for s in strings], kind="stable")
    sizes = np.array([len(strings[i]) for i in order], np.int64)
    data = np.frombuffer(b"".join(strings[i] for i in order), np.uint8)
    ends = np.cumsum(sizes)
    start, _, shared = column_sort(data, ends, sizes, length)
    owner = np.searchsorted(ends, start, "right")
    owner = np.minimum(owner, len(strings) - 1)
    whole = start + length <= ends[owner]
    group = np.cumsum(shared < length)[whole]
    place, holder = start[whole], docs[order][owner[whole]]
    found = np.zeros(len(data), np.int64)
    if len(group):
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        found[place] = np.repeat(np.minimum.reduceat(holder, first), np.diff(np.append(first, len(group))))
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(strings)
    for k, i in enumerate(order):
        out[i] = found[ends[k] - sizes[k]:max(ends[k] - length + 1, ends[k] - sizes[k])]
    return out


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id``, a hash of the text to tell rows that share an id apart, a short form of it, and the bytes."""
    raw = F.col(text).cast("string")
    row = F.xxhash64(raw)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), row.alias("row"),
                       F.pmod(row, F.lit(PARTS)).cast("int").alias("part"),
                       F.coalesce(raw, F.lit("")).cast("binary").alias("bytes"))


def _keys(texts: DataFrame) -> DataFrame:
    """``key, doc_id, part`` of every run, once per text and key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "bytes", SCAN):
            row, _, _, key = runs(*buffers(batch.column("bytes")))
            order = np.lexsort((row, key))
            key, row = key[order], row[order]
            once = np.append(True, (key[1:] != key[:-1]) | (row[1:] != row[:-1])) if len(key) else np.zeros(0, bool)
            own = pa.array(row[once])
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[once]), batch.column("doc_id").take(own), batch.column("part").take(own)],
                ["key", "doc_id", "part"])

    return texts.select("doc_id", "part", "bytes").mapInArrow(run, "key long, doc_id long, part int")


def _shared(keys: DataFrame, partitions: int) -> DataFrame:
    """The rows of ``_keys`` whose key occurs in several documents, from one sorted pass.

    A task holds back the rows of a key that may go on only while they all come from one document: ``PARTS`` rows at most.
    """
    names = ["key", "doc_id", "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, t) for t in (np.int64, np.int64, np.int32)]
        met = None  # the key that may go on, if several documents have it
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [np.append(h, batch.column(c).to_numpy()) for h, c in zip(held, names)]
            key, docs, part = columns
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            after = np.append(first[1:], len(key))
            many = np.minimum.reduceat(docs, first) != np.maximum.reduceat(docs, first)
            many[0] |= met is not None and key[0] == met
            kept = np.repeat(many, after - first)
            met = key[-1] if many[-1] else None
            open_ = np.arange(len(key) if many[-1] else first[-1], len(key))
            open_ = open_[np.unique(part[open_], return_index=True)[1]]
            held = [c[open_] for c in columns]
            yield pa.RecordBatch.from_arrays([pa.array(c[kept]) for c in columns], names)

    # by the key alone, which Spark sorts by its digits; several columns would be compared row by row
    dealt = keys.repartition(partitions, "key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, keys.schema)


def _strings(texts: DataFrame) -> DataFrame:
    """The strings of runs whose hash is among ``keys``: ``key, string, doc_id, row, start``."""
    spread = np.int64(0x9E3779B97F4A7C1)  # tells the documents of a slice apart; a clash keeps a run too many

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "bytes", SCAN):
            offsets, data = buffers(batch.column("bytes"))
            row, place, n, key = runs(offsets, data)
            wanted = batch.column("keys")
            owner = np.repeat(np.arange(batch.num_rows), wanted.value_lengths().to_numpy(zero_copy_only=False))
            keep = np.isin(key + row * spread, wanted.flatten().to_numpy(zero_copy_only=False) + owner * spread)
            row, place, n, key = (c[keep] for c in (row, place, n, key))
            cuts = -(-n // LONGEST)  # long runs go out in parts
            part = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            row, place, key, n = (np.repeat(c, cuts) for c in (row, place, key, n))
            first = place + part * LONGEST
            size = np.minimum(LONGEST, n - part * LONGEST) + LENGTH - 1
            from_ = offsets[row] + first
            raw = data.tobytes()
            texts = [raw[a:a + s] for a, s in zip(from_.tolist(), size.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(texts, pa.binary()), pa.array(batch.column("doc_id").to_numpy()[row]),
                 pa.array(batch.column("row").to_numpy()[row]), pa.array(first)],
                ["key", "string", "doc_id", "row", "start"])

    return texts.mapInArrow(run, "key long, string binary, doc_id long, row long, start long")


def _by_window(strings: DataFrame) -> DataFrame:
    """Strings of crowded hashes as single windows, each under its own hash."""
    counts = written(strings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CROWD).select("key"), "counts")
    # read back, the few keys are broadcast; as a plan of unknown size they would have all strings shuffled to meet them
    differing = strings.join(counts, "key").select("key", "string").distinct().groupBy("key").agg(
        F.count(F.lit(1)).alias("n")).filter(F.col("n") > CROWD).select("key")
    crowded = written(differing, "crowded")
    marked = strings.join(crowded.withColumn("crowded", F.lit(True)), "key", "left")
    count = F.when(F.col("crowded"), F.octet_length("string") - LENGTH + 1).otherwise(F.lit(1))
    each = marked.withColumn("at", F.explode(F.sequence(F.lit(1), count)))
    string = F.when(F.col("crowded"), F.expr(f"substring(string, at, {LENGTH})")).otherwise(F.col("string"))
    each = each.withColumn("string", string).withColumn("start", F.col("start") + F.col("at") - 1)
    key = F.when(F.col("crowded"), F.xxhash64("string")).otherwise(F.col("key"))
    return each.select(key.alias("key"), "string", "doc_id", "row", "start")


def _met(strings: pa.Array, key: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Whether a string can share a window with another of its group.

    A shared window holds the gram of the group's hash and half of its other bytes before or after it. Strings that have
    the gram once and no such context in common with any other are alone. A group with any string that has it several
    times (or, by single windows, not at all) is left as it is.
    """
    if not len(group):
        return np.zeros(0, bool)
    offsets, data = buffers(strings)
    side = (LENGTH - GRAM) // 2
    owner = np.repeat(np.arange(len(group)), np.diff(offsets))
    hashes, contexts = grams(data).view(np.int64), grams(data, GRAM + side)
    at = np.flatnonzero(hashes == key[owner[:len(hashes)]])
    at = at[at + GRAM <= offsets[owner[at] + 1]]
    times = np.bincount(owner[at], minlength=len(group))
    odd = np.zeros(int(group[-1]) + 1, bool)
    odd[group[times != 1]] = True
    meets = odd[group]
    at = at[~meets[owner[at]]]
    own = owner[at]
    for from_ in (at - side, at):
        whole = (from_ >= offsets[own]) & (from_ + GRAM + side <= offsets[own + 1])
        rows = own[whole]
        mark = contexts[from_[whole]] + group[rows].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        _, place, many = np.unique(mark, return_inverse=True, return_counts=True)
        meets[rows[many[place] > 1]] = True
    return meets


def _minima(strings: DataFrame, partitions: int) -> DataFrame:
    """For each different string its two hashes and, per window, the least document that holds the window.

    One holder stands for all windows where they agree. A hash with a single string needs no sorting.
    """
    once = strings.groupBy("key", "string").agg(F.min("doc_id").alias("doc_id"))
    dealt = once.repartition(partitions, "key").sortWithinPartitions("key").select("key", "string", "doc_id")

    def sort(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key, docs = table.column("key").to_numpy(), table.column("doc_id").to_numpy()
        strings = table.column("string").combine_chunks()
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        count = np.diff(np.append(first, len(key)))
        rows = np.flatnonzero(np.repeat(count > 1, count))
        group = np.repeat(np.arange(len(count)), count)[rows]
        meets = _met(strings.take(pa.array(rows)), key[rows], group)
        alone = np.concatenate([first[count == 1], rows[~meets]])
        rows, group = rows[meets], group[meets]
        yield pa.RecordBatch.from_arrays(
            [strings.take(pa.array(alone)), pa.ListArray.from_arrays(
                pa.array(np.arange(len(alone) + 1), pa.int32()), pa.array(docs[alone]))], ["string", "holders"])
        if not len(rows):
            return
        sizes = np.diff(buffers(strings.take(pa.array(rows)))[0])
        opens = np.append(True, group[1:] != group[:-1])
        # a collection takes as many rounds as its longest string has symbols: groups of like length go together, and
        # strings that hold their gram several times, which alone pass this length, into collections of their own
        starts = np.flatnonzero(opens)
        longest = np.repeat(np.maximum.reduceat(sizes, starts), np.diff(np.append(starts, len(rows))))
        order = np.argsort(longest, kind="stable")
        rows, sizes, opens, longest = rows[order], sizes[order], opens[order], longest[order]
        at = np.cumsum(sizes) - sizes
        block = np.maximum.accumulate(np.where(opens, at, 0)) // COLLECTION * 2 + (longest > 2 * LENGTH - GRAM)
        for own in np.split(rows, np.flatnonzero(block[1:] != block[:-1]) + 1):
            texts = strings.take(pa.array(own)).to_pylist()
            holders = [h[:1] if (h == h[0]).all() else h for h in least_holders(texts, docs[own])]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), nested(holders, pa.int64())],
                                             ["string", "holders"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= HELD:
                table = pa.Table.from_batches(held)
                key = table.column("key").to_numpy()
                last = int(np.searchsorted(key, key[-1]))  # the last hash may go on
                if last:
                    yield from sort(table.slice(0, last))
                    held = table.slice(last).combine_chunks().to_batches()
                    rows -= last
        if rows:
            yield from sort(pa.Table.from_batches(held))

    found = dealt.mapInArrow(run, "string binary, holders array<long>")
    return found.select(*_names(), "holders")


def _names():
    return F.xxhash64("string").alias("s1"), F.xxhash64(F.lit(7), F.col("string")).alias("s2")


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, row`` and ``spans``: byte ranges (from, to) of repeated windows, for documents that have any."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = _texts(docs, doc_id, text).filter(F.col("doc_id").isNotNull() & (F.octet_length("bytes") >= LENGTH))
    own = written(_shared(_keys(texts), partitions).groupBy("doc_id", "part").agg(
        F.collect_list("key").alias("keys")), "document-keys")
    released(spark)
    cut = written(_strings(texts.join(own.hint("shuffle_hash"), ["doc_id", "part"])), "strings")
    discarded(own)
    released(spark)
    strings = _by_window(cut)
    minima = written(_minima(strings, partitions), "holders")
    released(spark)
    held = strings.select("doc_id", "row", "start", (F.octet_length("string") - (LENGTH - 1)).alias("n"), *_names())
    # windows of a string that an earlier document holds, as ranges of bytes
    hit = held.join(minima.hint("shuffle_hash"), ["s1", "s2"]).select(
        "doc_id", "row", "start", "n", F.transform("holders", lambda d: d < F.col("doc_id")).alias("hit")).filter(
        F.exists("hit", lambda h: h))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags = batch.column("hit")
            sizes = flags.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = flags.flatten().to_numpy(zero_copy_only=False).astype(bool)
            string = np.repeat(np.arange(len(sizes)), sizes)
            place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            edge = np.append(True, string[1:] != string[:-1])[:len(flat)]
            first = np.flatnonzero(flat & (edge | ~np.append(False, flat[:-1])[:len(flat)]))
            last = np.flatnonzero(flat & (np.append(edge[1:], True)[:len(flat)] | ~np.append(flat[1:], False)[:len(flat)]))
            own = string[first]
            start = batch.column("start").to_numpy()[own]
            all_of_it = np.where(sizes == 1, batch.column("n").to_numpy(), 1)[own]  # one flag may stand for every window
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(own)), batch.column("row").take(pa.array(own)),
                 pa.array(start + place[first]), pa.array(start + place[last] + all_of_it + LENGTH - 1)],
                ["doc_id", "row", "low", "high"])

    spans = hit.mapInArrow(run, "doc_id long, row long, low long, high long")
    found = spans.groupBy("doc_id", "row").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    found = written(found, "spans")
    discarded(cut, minima)
    released(spark)
    return found


def _kept(column: pa.Array, spans: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts without the bytes in their spans: offsets and bytes of what is left, and per text the maximal runs removed and
    the bytes in them."""
    offsets, data = buffers(column)
    rows = len(offsets) - 1
    counts = spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(rows), counts)
    flat = spans.flatten()
    base = offsets[owner] + owner  # a place between texts, so that spans of two of them never touch
    low, high = (flat.field(k).to_numpy(zero_copy_only=False) + base for k in (0, 1))
    order = np.argsort(low, kind="stable")
    low, high, owner = low[order], np.maximum.accumulate(high[order]), owner[order]
    opens = np.append(True, low[1:] > high[:-1])[:len(low)]
    first = np.flatnonzero(opens)
    last = np.append(first[1:], len(low))[:len(first)] - 1
    low, high, owner = low[first] - owner[first], high[last] - owner[first], owner[first]
    edges = np.concatenate([[0], np.stack([low, high], 1).ravel(), [len(data)]])
    keep = np.repeat(np.arange(len(edges) - 1) % 2 == 0, np.diff(edges))
    removed = np.zeros(rows, np.int64)
    np.add.at(removed, owner, high - low)
    sizes = np.diff(offsets) - removed
    return np.append(0, np.cumsum(sizes)), data[keep], np.bincount(owner, minlength=rows), removed


def _joined(docs: DataFrame, doc_id: str, text: str, keep: list[str]) -> DataFrame:
    spans = repeats(docs, doc_id, text).withColumnRenamed("doc_id", "_doc").withColumnRenamed("row", "_row")
    raw = F.col(text).cast("string")
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(doc_id).cast("long").alias("_id"),
                       F.coalesce(raw, F.lit("")).cast("binary").alias("_bytes"), F.xxhash64(raw).alias("_hash"))
    return rows.join(spans.hint("shuffle_hash"), (F.col("_id") == F.col("_doc")) & (F.col("_hash") == F.col("_row")), "left").drop(
        "_doc", "_row", "_hash")


def digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``.

    Null and short texts lose nothing. A document without id loses nothing and takes nothing from others; rows that share
    an id take nothing from each other. Repeated rows are judged each for itself.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_bytes", CHUNK):
            offsets, data, n, removed = _kept(batch.column("_bytes"), batch.column("spans"))
            left = memoryview(data)
            sums = [hashlib.sha256(left[a:b]).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.array(np.diff(offsets) + removed), pa.array(removed), pa.array(n), pa.array(sums, pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _joined(docs, doc_id, text, []).select("_id", "_bytes", "spans").mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without their repeated bytes; other columns and all rows stay.

    Where a removal would cut a character in two, the character's other bytes go as well, so that texts stay valid.
    Null texts stay null.
    """
    # the other columns travel as one value, so that no name of theirs can clash
    others = [F.col(f"`{c}`") for c in docs.columns if c != text]
    packed = docs.select(F.struct(*others).alias("other"), F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"),
                         F.col(f"`{text}`").isNull().alias("_null"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_bytes", CHUNK):
            offsets, data, _, _ = _kept(batch.column("_bytes"), batch.column("spans"))
            raw = data.tobytes()
            texts = [raw[a:b].decode("utf-8", "ignore") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("other"), pa.array(texts, pa.string())], ["other", "_text"])

    rows = _joined(packed, "doc_id", "text", ["other", "_null"])
    schema = T.StructType([T.StructField("other", rows.schema["other"].dataType), T.StructField("_text", T.StringType())])
    found = rows.select("other", F.when(~F.col("_null"), F.col("_bytes")).alias("_bytes"), "spans").mapInArrow(_keeping_nulls(run), schema)
    return found.select(*[F.col("_text").alias(c) if c == text else F.col("other")[c].alias(c) for c in docs.columns])


def _keeping_nulls(run):
    """``run`` gives texts for null bytes too; put the nulls back."""
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            null = batch.column("_bytes").is_null()
            at = batch.schema.get_field_index("_bytes")
            filled = batch.set_column(at, "_bytes", batch.column("_bytes").fill_null(b""))
            done = 0
            for out in run(iter([filled])):
                own = null.slice(done, out.num_rows)
                done += out.num_rows
                text = pa.compute.if_else(own, pa.scalar(None, pa.string()), out.column("_text"))
                yield out.set_column(out.schema.get_field_index("_text"), "_text", text)

    return wrapped
