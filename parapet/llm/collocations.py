"""Collocations from sorted streams of n-gram counts, joined by running side by side.

The layout is that of external language-model estimation. Nothing is looked up by hash; counts meet because they are
neighbours in a sorted stream:

* Every task counts the n-grams of order 1 to 3 in a stretch of text, in prefix order: by first word, then second, then
  third, where "no word" sorts first, so that an n-gram stands right before its extensions. A sorted run is cut at given
  boundaries and leaves as one packed block per bucket.
* A bucket is a range of that order. Its blocks are merged, counts added up, and what is too rare is dropped. One scan of
  the merged stream then gives each n-gram the counts of its prefixes and each bigram its greatest extension to the right.
* The frequent n-grams go round once more in suffix order (last word first), and the same scan gives the counts of
  suffixes and the greatest extension to the left.

Buckets end anywhere, also between a word and its bigrams. What such a scan lacks is the last shorter n-gram of the buckets
before it, and one extension at the head of the bucket; these are a row per bucket and are filled in afterwards.

An n-gram is at most as frequent as its parts, so the streams still hold every part of what is left after rare ones are gone.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from parapet.llm.common import buffers, slices, written

LEAST = 10
TOP = 2000
#: A bigram goes where a longer candidate has this share (in per cent) of its count.
COVERED = 50
MILLION = 1_000_000
#: Text a bucket stands for, in bytes: it sets the number of buckets and so the memory a merge takes.
BUCKET = 6 << 20
#: Frequent n-grams in a bucket of the second round.
SECOND = 200_000
#: N-grams drawn per bucket to place the boundaries; texts they are drawn from.
DRAWN, SAMPLE = 24, 8_000
#: Text handed over at once, text split into words at once, and words counted before a run is closed.
CHUNK, BLOCK, WORDS = 4 << 20, 1 << 20, 1_500_000
#: Fixed by the task: letters lowered, what ends a piece, what parts words.
UPPER, ENDS, GAP = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
_TABLE = bytes(10 if c in ENDS else 32 if c in GAP else c + 32 if c in UPPER else c for c in range(256))
_NONE = b""


# --- runs ----------------------------------------------------------------------------------------------------------

class _Vocabulary(dict):
    """Numbers words as they come; an end of a piece is 0, the nothing between two gaps is -1."""

    def __init__(self):
        super().__init__({b"\n": 0, b"": -1})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self) - 1
        return number


class _Run:
    """Words of one language since the last run was closed."""

    def __init__(self):
        self.words, self.parts, self.seen, self.size = _Vocabulary(), [], 0, 0

    def add(self, text: bytes) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray, int]]:
        """Take a text that ends with a piece; gives runs that are full (a text may fill several)."""
        text = text.translate(_TABLE)
        at = 0
        while at < len(text):
            stop = len(text)
            if stop - at > BLOCK:  # cut behind a gap or a piece; a word longer than a block stays whole
                stop = max(text.rfind(b" ", at, at + BLOCK), text.rfind(b"\n", at, at + BLOCK)) + 1
                if stop <= at:
                    found = [i for i in (text.find(b" ", at + BLOCK), text.find(b"\n", at + BLOCK)) if i >= 0]
                    stop = min(found) + 1 if found else len(text)
            words = text[at:stop].replace(b"\n", b" \n ").split(b" ")
            ids = np.fromiter(map(self.words.__getitem__, words), np.int32, len(words))
            self.parts.append(ids[ids >= 0])
            self.size += len(self.parts[-1])
            at = stop
            if self.size >= WORDS:
                yield self.close()

    def close(self) -> tuple[list[bytes], np.ndarray, np.ndarray, int]:
        """Sorted words, n-gram keys in prefix order with their counts, and the bits a word takes in a key.

        The last two words of an open piece stay as context of what follows; they are not counted again.
        """
        ids, seen = np.concatenate(self.parts) if self.parts else np.zeros(0, np.int32), self.seen
        names = [w for w, i in self.words.items() if i > 0]
        order = sorted(range(len(names)), key=names.__getitem__)
        rank = np.zeros(len(names) + 1, np.int64)
        rank[np.asarray(order, np.int64) + 1] = np.arange(1, len(names) + 1)
        open_piece = ids[-2:] if len(ids) else ids
        if len(open_piece) and open_piece[-1] == 0:
            open_piece = open_piece[:0]
        elif len(open_piece) == 2 and open_piece[0] == 0:
            open_piece = open_piece[1:]
        context = [names[i - 1] for i in open_piece]
        result = ([names[i] for i in order], *_counted(rank[ids], seen, len(names)))
        self.__init__()
        self.parts = [np.array([self.words[w] for w in context], np.int32)]
        self.seen = self.size = len(context)
        return result


def _counted(r: np.ndarray, seen: int, words: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Keys and counts of all n-grams that end behind the first ``seen`` words."""
    bits = max(int(words).bit_length(), 1)
    one = r[seen:]
    keys = [one[one > 0] << 2 * bits]
    for n in (2, 3):
        if len(r) >= n:
            own = np.arange(max(seen, n - 1), len(r))
            inside = np.ones(len(own), bool)
            key = np.zeros(len(own), np.int64)
            for k in range(n):
                word = r[own - (n - 1) + k]
                inside &= word > 0
                key |= word << (2 - k) * bits
            keys.append(key[inside])
    return *np.unique(np.concatenate(keys), return_counts=True), bits


def _cuts(words: list[bytes], lang: bytes, keys: np.ndarray, bits: int, boundaries: list[tuple]) -> np.ndarray:
    """Where the boundaries fall in a run: the first key not below each."""
    low, high = bisect_left(boundaries, (lang,)), bisect_left(boundaries, (lang + b"\x00",))
    at = []
    for boundary in boundaries[low:high]:
        key = 0
        for k, word in enumerate(boundary[1:]):
            if word == _NONE:
                break
            place = bisect_left(words, word)
            key += (place + 1) << (2 - k) * bits  # behind all words: where the next shorter n-gram begins
            if place == len(words) or words[place] != word:
                break
        at.append(key)
    inner = np.searchsorted(keys, np.asarray(at, np.int64), "left")
    return np.concatenate([np.zeros(low, np.int64), inner, np.full(len(boundaries) - high, len(keys))])


def _packed(words: list[bytes], keys: np.ndarray, counts: np.ndarray, bits: int) -> bytes:
    """A block: its words in order, then first words (as steps), second and third words, counts."""
    mask = (1 << bits) - 1
    ranks = [keys >> 2 * bits, (keys >> bits) & mask, keys & mask]
    used = np.unique(np.concatenate(ranks))
    used = used[used > 0]
    local = [np.searchsorted(used, r, "left") + (r > 0) for r in ranks]
    local[0] = np.diff(local[0], prepend=0)
    names = b"\n".join([words[i - 1] for i in used.tolist()])
    arrays = [_narrow(a) for a in (*local, counts)]
    head = np.array([len(names), len(keys), *[a.itemsize for a in arrays]], "<u8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(b"".join([head, names, *[a.tobytes() for a in arrays]]))


def _narrow(a: np.ndarray) -> np.ndarray:
    top = int(a.max()) if len(a) else 0
    return a.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8")


def _unpacked(block: bytes) -> tuple[list[bytes], list[np.ndarray]]:
    """Words, and arrays of first, second and third word (0: none, else place in the words plus 1) and counts."""
    data = zstandard.ZstdDecompressor().decompress(block)
    head = np.frombuffer(data, "<u8", 6)
    size, n, at = int(head[0]), int(head[1]), 48 + int(head[0])
    arrays = []
    for width in head[2:].tolist():
        arrays.append(np.frombuffer(data, f"<u{width}", n, at).astype(np.int64))
        at += n * width
    arrays[0] = np.cumsum(arrays[0])
    return data[48:48 + size].split(b"\n"), arrays


def _runs(boundaries: list[tuple]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_runs: dict[bytes, _Run] = {}

        def blocks(lang: bytes, words, keys, counts, bits) -> pa.RecordBatch:
            ends = [0, *_cuts(words, lang, keys, bits, boundaries).tolist(), len(keys)]
            own = [(b, _packed(words, keys[x:y], counts[x:y], bits)) for b, (x, y) in enumerate(zip(ends, ends[1:])) if y > x]
            return pa.RecordBatch.from_arrays([
                pa.array([b for b, _ in own], pa.int32()), pa.array([lang] * len(own), pa.binary()),
                pa.array([p for _, p in own], pa.binary())], ["bucket", "lang", "block"])

        for batch in slices(batches, "text", CHUNK):
            offsets, data = buffers(batch.column("text"))
            data = data.tobytes()
            names = batch.column("lang").to_pylist()
            texts: dict[bytes, list[bytes]] = {}
            for i, lang in enumerate(names):
                texts.setdefault(lang.encode(), []).append(data[offsets[i]:offsets[i + 1]])
            for lang, own in texts.items():
                held = open_runs.setdefault(lang, _Run())
                for full in held.add(b"\n".join([*own, b""])):
                    yield blocks(lang, *full)
            if sum(r.size for r in open_runs.values()) >= WORDS:
                for lang, held in open_runs.items():
                    yield blocks(lang, *held.close())
                open_runs = {}
        for lang, held in open_runs.items():
            yield blocks(lang, *held.close())

    return run


def _boundaries(texts: DataFrame, buckets: int, rows: int, size: int) -> list[tuple]:
    """N-grams that part the prefix order into about equal buckets, from a bounded sample of places in texts.

    They only decide which bucket counts what; the counts are the same whatever they are.
    """
    if buckets < 2:
        return []
    share = min(1.0, SAMPLE / max(rows, 1))
    chance = min(1.0, DRAWN * buckets / (share * max(size, 1)))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(7)
        for batch in batches:
            offsets, data = buffers(batch.column("text"))
            found: list[tuple[bytes, ...]] = []
            for i, lang in enumerate(batch.column("lang").to_pylist()):
                n = int(offsets[i + 1] - offsets[i])
                for at in rng.integers(0, max(n, 1), rng.binomial(n, chance) if n else 0):
                    near = data[offsets[i] + at:min(offsets[i] + at + 200, offsets[i + 1])].tobytes().translate(_TABLE)
                    words = [w for w in near.split(b"\n")[0].split(b" ")[1:] if w][:int(rng.integers(1, 4))]
                    if words:
                        found.append((lang.encode(), *words, _NONE, _NONE)[:4])
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.binary()) for k in range(4)], ["l", "a", "b", "c"])

    drawn = texts.filter(F.rand(7) < F.lit(share)).mapInArrow(draw, "l binary, a binary, b binary, c binary").distinct().collect()
    return _spread(sorted(tuple(bytes(x) for x in row) for row in drawn), buckets)


def _spread(drawn: list[tuple], buckets: int) -> list[tuple]:
    return sorted({drawn[len(drawn) * i // buckets] for i in range(1, buckets)}) if drawn else []


# --- streams -------------------------------------------------------------------------------------------------------

def _scan(k: list[np.ndarray], f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One pass down a sorted stream (words as numbers, 0 for none).

    Gives the count of the one-word and of the two-word n-gram each row extends (0 where it lies before this stretch),
    the greatest count of the three-word n-grams that extend a two-word one, and a mark for three-word rows whose two-word
    n-gram lies before this stretch.
    """
    at, order = np.arange(len(f)), (k[1] > 0).astype(np.int8) + (k[2] > 0)
    one = np.maximum.accumulate(np.where(order == 0, at, -1))
    two = np.maximum.accumulate(np.where(order == 1, at, -1))
    has_one = (one >= 0) & (order > 0) & (k[0][one] == k[0])
    has_two = (two >= 0) & (order == 2) & (k[0][two] == k[0]) & (k[1][two] == k[1])
    most = np.zeros(len(f), np.int64)
    np.maximum.at(most, two[has_two], f[has_two])
    return np.where(has_one, f[one], 0), np.where(has_two, f[two], 0), most, (order == 2) & ~has_two


_STREAM = "bucket int, kind int, lang binary, k1 binary, k2 binary, k3 binary, f bigint, one bigint, two bigint, most bigint"
_GRAM, _HEAD, _TOTAL = 0, 1, 2


def _rows(bucket: int, lang: bytes, words: list[bytes], k: list[np.ndarray], f: np.ndarray) -> pa.Table:
    """The scanned rows of a sorted stretch, and a row for the extensions of a two-word n-gram that lies before it."""
    one, two, most, head = _scan(k, f)
    names = pa.array([None, *words], pa.binary())
    n = len(f)
    columns = [np.full(n, bucket, np.int32), np.full(n, _GRAM, np.int32), pa.array([lang] * n, pa.binary()),
               *[names.take(pa.array(x)) for x in k], f, one, two, most]
    table = pa.table([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names=_names(_STREAM))
    if not head.any():
        return table
    i = int(np.flatnonzero(head)[0])
    return pa.concat_tables([table, _extra(bucket, _HEAD, lang, words[k[0][i] - 1], words[k[1][i] - 1], int(f[head].max()))])


def _extra(bucket: int, kind: int, lang: bytes, k1: bytes | None, k2: bytes | None, f: int) -> pa.Table:
    values = [bucket, kind, lang, k1, k2, None, f, 0, 0, 0]
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4, *[pa.int64()] * 4]
    return pa.table([pa.array([v], t) for v, t in zip(values, kinds)], names=_names(_STREAM))


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def _merged(least: int):
    """Blocks of one bucket to one stream in prefix order."""
    def merge(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        blocks: dict[bytes, list[bytes]] = {}
        for lang, block in zip(table.column("lang").to_pylist(), table.column("block").to_pylist()):
            blocks.setdefault(lang, []).append(block)
        out = [pa.table([pa.array([], t) for t in (pa.int32(), pa.int32(), *[pa.binary()] * 4, *[pa.int64()] * 4)],
                        names=_names(_STREAM))]
        for lang in sorted(blocks):
            opened = [_unpacked(b) for b in blocks[lang]]
            words = sorted({w for names, _ in opened for w in names})
            rank = {w: i for i, w in enumerate(words, 1)}
            columns: list[list[np.ndarray]] = [[], [], [], []]
            for names, arrays in opened:
                to = np.array([0, *map(rank.__getitem__, names)], np.int64)
                for column, array in zip(columns, arrays):
                    column.append(to[array] if column is not columns[3] else array)
            opened = None
            k, f = _added([np.concatenate(c) for c in columns[:3]], np.concatenate(columns[3]))
            out.append(_extra(bucket, _TOTAL, lang, None, None, int(f[k[1] == 0].sum())))
            keep = f >= least
            out.append(_rows(bucket, lang, words, [x[keep] for x in k], f[keep]))
        return pa.concat_tables(out)

    return merge


def _added(k: list[np.ndarray], f: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Equal n-grams added up, in order. Two words make one number, that and the third another: no limit on words."""
    wide = max(int(k[2].max()) if len(f) else 0, 1) + 1
    pairs, pair = np.unique(k[0] << 32 | k[1], return_inverse=True)
    keys, where = np.unique(pair * wide + k[2], return_inverse=True)
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, where, f)
    first = pairs[keys // wide]
    return [first >> 32, first & 0xFFFFFFFF, keys % wide], total


def _completed(stream: DataFrame) -> DataFrame:
    """The n-grams of a written stream with what their buckets could not know.

    ``tails`` and ``heads`` have one row per bucket at most.
    """
    grams, heads = stream.filter(F.col("kind") == _GRAM), stream.filter(F.col("kind") == _HEAD)
    tails = grams.groupBy("bucket").agg(
        F.max(F.when(F.col("k2").isNull(), F.struct("lang", "k1", "f"))).alias("last1"),
        F.max(F.when(F.col("k2").isNotNull() & F.col("k3").isNull(), F.struct("lang", "k1", "k2", "f"))).alias("last2"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    tails = tails.select("bucket", F.last("last1", True).over(before).alias("last1"), F.last("last2", True).over(before).alias("last2"))
    heads = heads.groupBy("lang", "k1", "k2").agg(F.max("f").alias("more"))
    one = (F.col("one") == 0) & F.col("k2").isNotNull() & (F.col("last1.lang") == F.col("lang")) & (F.col("last1.k1") == F.col("k1"))
    two = ((F.col("two") == 0) & F.col("k3").isNotNull() & (F.col("last2.lang") == F.col("lang"))
           & (F.col("last2.k1") == F.col("k1")) & (F.col("last2.k2") == F.col("k2")))
    return grams.join(F.broadcast(tails), "bucket", "left").join(F.broadcast(heads), ["lang", "k1", "k2"], "left").withColumns({
        "one": F.when(one, F.col("last1.f")).otherwise(F.col("one")),
        "two": F.when(two, F.col("last2.f")).otherwise(F.col("two")),
        "most": F.when(F.col("k2").isNotNull() & F.col("k3").isNull(), F.greatest("most", F.coalesce("more", F.lit(0))))
        .otherwise(F.lit(0))}).drop("last1", "last2", "more")


def _turned(rows: DataFrame) -> DataFrame:
    """Words in the other direction: the last one first."""
    words = [F.coalesce(F.col("k3"), F.col("k2"), F.col("k1")),
             F.when(F.col("k3").isNotNull(), F.col("k2")).when(F.col("k2").isNotNull(), F.col("k1")),
             F.when(F.col("k3").isNotNull(), F.col("k1"))]
    return rows.withColumns({f"k{i}": w for i, w in enumerate(words, 1)})


def _suffix_stream(prefix: DataFrame) -> DataFrame:
    """The frequent n-grams in suffix order, with all they have from the prefix order as ``p_one, p_two, p_most``."""
    rows = _turned(prefix).select("lang", "k1", "k2", "k3", "f", F.col("one").alias("p_one"), F.col("two").alias("p_two"),
                                  F.col("most").alias("p_most"))
    buckets = -(-rows.count() // SECOND)
    key = [F.coalesce(F.col(c), F.lit(b"")).alias(c) for c in ("lang", "k1", "k2", "k3")]
    drawn = rows.select(*key).orderBy(F.xxhash64("lang", "k1", "k2", "k3")).limit(DRAWN * buckets).collect() if buckets > 1 else []
    boundaries = _spread(sorted(tuple(bytes(x) for x in row) for row in drawn), buckets)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(*[[x or b"" for x in batch.column(c).to_pylist()] for c in ("lang", "k1", "k2", "k3")])
            yield batch.append_column("bucket", pa.array([bisect_right(boundaries, key) for key in keys], pa.int32()))

    schema = ("lang binary, k1 binary, k2 binary, k3 binary, f bigint, p_one bigint, p_two bigint, p_most bigint, bucket int")

    def scan(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        table = table.sort_by([(c, "ascending") for c in ("lang", "k1")])
        out = []
        for lang, own in groupby(enumerate(table.column("lang").to_pylist()), key=lambda x: x[1]):
            places = [i for i, _ in own]
            part = table.slice(places[0], len(places))
            names = [part.column(c).to_pylist() for c in ("k1", "k2", "k3")]
            words = sorted({w for column in names for w in column if w is not None})
            rank = {w: i for i, w in enumerate(words, 1)} | {None: 0}
            k = [np.array([rank[w] for w in column], np.int64) for column in names]
            order = np.lexsort(k[::-1])
            rows = _rows(bucket, lang, words, [x[order] for x in k], part.column("f").to_numpy()[order])
            rest = rows.num_rows - len(order)  # a head has nothing from the other direction
            for name in ("p_one", "p_two", "p_most"):
                values = np.concatenate([part.column(name).to_numpy()[order], np.zeros(rest, np.int64)])
                rows = rows.append_column(name, pa.array(values))
            out.append(rows)
        return pa.concat_tables(out)

    return rows.mapInArrow(place, schema).groupBy("bucket").applyInArrow(scan, _STREAM + ", p_one bigint, p_two bigint, p_most bigint")


def counts(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """N-grams of order 1 to 3 that occur at least ``least`` times, and the number of words per language.

    First: ``lang, w1, w2, w3, f`` (strings, null beyond the order), counts of prefixes ``first, first_two``, of suffixes
    ``last, last_two`` (0 where shorter), and of the most frequent extension by one word, ``longer``. Second: ``lang, n``.

    Texts are lower-cased (A-Z only), pieces end at ``.,;:!?`` and line ends, words at blanks and tabs; n-grams lie within
    pieces. Null texts are empty, a null language is ``und``. A text longer than a run is counted in several, a single
    word of any length stays whole. Repeated rows count each time; an empty table gives empty tables; other columns are
    not read. The tables behind the results are in the shared folder.
    """
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"),
                        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    whole = texts.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("text")).alias("size")).first()
    size = whole["size"] or 0
    buckets = -(-size // BUCKET)
    boundaries = _boundaries(texts, buckets, whole["rows"], size)
    blocks = texts.mapInArrow(_runs(boundaries), "bucket int, lang binary, block binary")
    first = written(blocks.groupBy("bucket").applyInArrow(_merged(least), _STREAM), "prefixes")
    second = written(_suffix_stream(_completed(first)), "suffixes")
    rows = _completed(second)
    words = [F.coalesce(F.col("k3"), F.col("k2"), F.col("k1")),
             F.when(F.col("k3").isNotNull(), F.col("k2")).when(F.col("k2").isNotNull(), F.col("k1")),
             F.when(F.col("k3").isNotNull(), F.col("k1"))]
    grams = rows.select(F.col("lang").cast("string").alias("lang"), *[w.cast("string").alias(f"w{i}") for i, w in enumerate(words, 1)],
                        "f", F.col("p_one").alias("first"), F.col("p_two").alias("first_two"), F.col("one").alias("last"),
                        F.col("two").alias("last_two"), F.greatest("most", "p_most").alias("longer"))
    totals = first.filter(F.col("kind") == _TOTAL).groupBy(F.col("lang").cast("string").alias("lang")).agg(F.sum("f").alias("n"))
    return grams, totals


def phrases(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, top: int | None = TOP,
            covered: int = COVERED) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's best phrases of two or three words.

    A phrase is scored by its weakest cut into two parts (ties: the first). Pairs that a candidate of three words covers are
    left out. Ranks go by score, count (both falling) and phrase. Scores are exact for counts up to 10^16. ``top`` is the
    length of the report; None gives all. For rows see ``counts``.
    """
    grams, totals = counts(docs, lang, text, least)
    table = grams.filter("w2 IS NOT NULL AND (w3 IS NOT NULL OR 100 * longer < %d * f)" % covered)

    def ratio(left: str, right: str) -> str:
        d = "CAST(%s AS DECIMAL(16,0))"
        return f"({d % 'f'} * {d % 'f'} * CAST({MILLION} AS DECIMAL(7,0))) DIV ({d % left} * {d % right})"

    cut = "named_struct('score', %s, 'k', %d, 'l', %s, 'r', %s)"
    one = cut % (ratio("first", "last"), 1, "first", "last")
    two = (f"array_min(array({cut % (ratio('first', 'last_two'), 1, 'first', 'last_two')}, "
           f"{cut % (ratio('first_two', 'last'), 2, 'first_two', 'last')}))")
    scored = table.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), F.col("f").alias("a"),
                          F.expr(f"CASE WHEN w3 IS NULL THEN {one} ELSE {two} END").alias("cut")).select(
        "lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(best).cast("long"))
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The same rows from DuckDB; ``{docs}`` is the table.
SQL = f"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ\t', 'abcdefghijklmnopqrstuvwxyz '), '[.,;:!?\\n\\x0B\\f\\r]')) AS piece
    FROM {{docs}}),
words AS (SELECT lang, list_filter(string_split(piece, ' '), lambda x: x <> '') AS w FROM pieces),
grams AS (SELECT lang, unnest(flatten([[[x] for x in w], list_transform(range(1, len(w)), lambda i: w[i:i + 1]),
                                       list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2])])) AS g FROM words),
f AS (SELECT lang, g, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE len(g) = 1 GROUP BY lang),
often AS (SELECT * FROM f WHERE len(g) > 1 AND f >= {LEAST}),
covered AS (SELECT s.lang, s.g FROM often s JOIN often t ON t.lang = s.lang AND len(s.g) = 2 AND len(t.g) = 3
            AND (t.g[1:2] = s.g OR t.g[2:3] = s.g) WHERE 100 * t.f >= {COVERED} * s.f GROUP BY ALL),
cuts AS (SELECT lang, g, f AS a, unnest(range(1, len(g))) AS k FROM often ANTI JOIN covered USING (lang, g)),
scores AS (SELECT c.lang, c.g, a, k, l.f AS l, r.f AS r,
                  ({MILLION}::HUGEINT * a * a // (l.f::HUGEINT * r.f::HUGEINT))::BIGINT AS score
           FROM cuts c JOIN f l ON l.lang = c.lang AND l.g = c.g[1:k] JOIN f r ON r.lang = c.lang AND r.g = c.g[k + 1:len(c.g)]),
least AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
named AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score FROM least)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM named JOIN totals USING (lang) QUALIFY rank <= {TOP}
"""
