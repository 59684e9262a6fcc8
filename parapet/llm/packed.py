"""Token ids in binary shards: patched frame-of-reference blocks.

A shard holds the ids of whole documents, one after the other. Ids are cut into blocks of a fixed size. A block keeps its
minimum, the differences to it packed at the width that a percentile of them needs, and lists the outliers: their
positions and the bits above that width. An index of block starts gives random access. Shards are rows of a Parquet table
(uncompressed: the payload is packed already), in ascending order of document id.

Payload, little-endian: magic ``PFR1``, block size u32, ids u64, blocks u32, exceptions u32; then the index, per block
minimum u32, first packed byte u32, first exception u32, width u8; then packed bits, exception positions u16 and
exception high bits u32. Bits of a block are packed value by value, lowest bit first.
"""

from __future__ import annotations

import json
import os
import string
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from parapet.llm.common import buffers, folder, nested, slices
from parapet.llm.tokens import LONGEST, Words

MAGIC = b"PFR1"
HEAD = struct.Struct("<4sIQII")
BLOCK = 256
PERCENTILE = 90.0
#: A shard is closed after the document that brings it to so many ids.
SHARD = 500_000
#: Text handed to the tokenizer at once.
CHUNK = 2 << 20
#: ASCII marks and letters, and the second bytes of Latin-1 letters (the first is C3).
MARK, LETTER, LATIN = (np.isin(np.arange(256), list(x)) for x in (
    string.punctuation.encode(), string.ascii_letters.encode(), bytes({*range(0x80, 0xC0)} - {0x97, 0xB7})))
#: Separates words handed to the tokenizer together; words that contain it go alone.
BREAK = "\x01"
SHARDS = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("seq", T.IntegerType()),
                       T.StructField("first_in_part", T.LongType()), T.StructField("n_ids", T.LongType()),
                       T.StructField("doc_ids", T.ArrayType(T.LongType())),
                       T.StructField("lengths", T.ArrayType(T.LongType())), T.StructField("payload", T.BinaryType())])


def _bits(values: np.ndarray) -> np.ndarray:
    """How many bits each value needs."""
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)


def pack(ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> bytes:
    """The payload of a shard. ``block`` is a multiple of 8 and below 65536."""
    ids = np.ascontiguousarray(ids, np.uint32)
    n_blocks = -(-len(ids) // block)
    padded = np.zeros(n_blocks * block, np.uint32)
    padded[:len(ids)] = ids
    if len(ids) % block:
        padded[len(ids):] = ids[-1]
    rows = padded.reshape(n_blocks, block)
    least = rows.min(1) if n_blocks else np.zeros(0, np.uint32)
    rest = rows - least[:, None]
    needed = _bits(rest)
    width = np.percentile(needed, percentile, axis=1, method="higher").astype(np.uint8) if n_blocks \
        else np.zeros(0, np.uint8)
    sizes = width.astype(np.int64) * (block // 8)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    packed = np.zeros(int(starts[-1]), np.uint8)
    for w in np.unique(width[width > 0]):
        own = np.flatnonzero(width == w)
        raw = np.ascontiguousarray(rest[own].astype("<u4").view(np.uint8).reshape(len(own), block, 4)[:, :, :-(-int(w) // 8)])
        bits = np.unpackbits(raw, axis=2, count=int(w), bitorder="little")
        data = np.packbits(bits.reshape(len(own), -1), axis=1, bitorder="little")
        packed[starts[own][:, None] + np.arange(data.shape[1])] = data
    which, where = np.nonzero(needed > width[:, None])
    high = rest[which, where] >> width[which].astype(np.uint32)
    first = np.searchsorted(which, np.arange(n_blocks))
    return b"".join([HEAD.pack(MAGIC, block, len(ids), n_blocks, len(which)), least.astype("<u4").tobytes(),
                     starts[:-1].astype("<u4").tobytes(), first.astype("<u4").tobytes(), width.tobytes(),
                     packed.tobytes(), where.astype("<u2").tobytes(), high.astype("<u4").tobytes()])


def unpack(payload: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a shard; only the blocks that hold them are read."""
    magic, block, n, n_blocks, n_high = HEAD.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a shard of packed ids")
    stop = n if stop is None else min(stop, n)
    if start >= stop:
        return np.zeros(0, np.uint32)
    at = HEAD.size
    least, starts, first = (np.frombuffer(payload, "<u4", n_blocks, at + 4 * n_blocks * i) for i in range(3))
    width = np.frombuffer(payload, np.uint8, n_blocks, at + 12 * n_blocks)
    data = np.frombuffer(payload, np.uint8, int((width.astype(np.int64) * (block // 8)).sum()), at + 13 * n_blocks)
    where = np.frombuffer(payload, "<u2", n_high, at + 13 * n_blocks + len(data))
    high = np.frombuffer(payload, "<u4", n_high, at + 13 * n_blocks + len(data) + 2 * n_high)
    low, top = start // block, -(-stop // block)
    rows = np.zeros((top - low, block), np.uint32)
    for w in np.unique(width[low:top]):
        if w:
            own = low + np.flatnonzero(width[low:top] == w)
            size = int(w) * (block // 8)
            raw = data[starts[own].astype(np.int64)[:, None] + np.arange(size)]
            bits = np.unpackbits(raw, axis=1, bitorder="little").reshape(len(own), block, int(w))
            rows[own - low] = bits.astype(np.uint32) @ (np.uint32(1) << np.arange(w, dtype=np.uint32))
    last = int(first[top]) if top < n_blocks else n_high
    own = np.arange(int(first[low]), last)
    which = np.searchsorted(first, own, "right") - 1
    rows[which - low, where[own]] |= high[own] << width[which].astype(np.uint32)
    rows += least[low:top, None]
    return rows.reshape(-1)[start - low * block:stop - low * block]


class Encoder:
    """Ids of texts by a tokenizer file; ``words`` says that its words do not depend on each other.

    With ``words``, texts are cut at blanks, tabs, line and page ends and only words not met before go to the library, many at
    once with a separator between. That holds for tokenizers that drop white space before they look for words, such as
    the one named in the query; tests compare it with encoding texts whole. If it also drops case and cuts between
    letters and marks, so do the texts before they are cut into words: fewer words differ.
    """

    def __init__(self, path: str, words: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words = Words(self._many, start={b"": b""}) if words else None
        self.mark = self._whole([BREAK])[0] if words else None
        self.ends = self._last() if words else None
        self.folds, self.apart = self._simple() if words else (False, False)

    def _simple(self) -> tuple[bool, bool]:
        """Whether the case of ASCII letters makes no difference, and whether letters and ASCII marks are always cut apart.

        An apostrophe may go with the letters behind it.
        """
        normal, cut = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        folds = normal is not None and normal.normalize_str(string.ascii_uppercase) == string.ascii_lowercase
        return folds, cut is not None and all(
            [part for part, _ in cut.pre_tokenize_str(text)] == parts for m in string.punctuation for text, parts in (
                (f"ab{m}", ["ab", m]), (f"ab{m}cd{m}{m}ef", ["ab", m, "cd", m + m, "ef"])) if m != "'" or text == "ab'")

    def _plainer(self, texts: pa.Array) -> pa.Array:
        """The texts in lower case and with blanks between letters and marks, as far as that changes no id.

        A text stays as it is if it holds combining marks (bytes CC and CD), as not every letter combines alike in both cases,
        or a "<|", as special tokens are looked for before anything else.
        """
        offsets, data = buffers(texts)
        raw = data.tobytes()
        kept = np.zeros(len(texts), bool)
        if any(x in raw for x in (b"\xcc", b"\xcd", b"<|")):
            odd = (data == 0xCC) | (data == 0xCD)
            odd[:-1] |= (data[:-1] == ord("<")) & (data[1:] == ord("|"))
            kept[np.searchsorted(offsets, np.flatnonzero(odd), "right") - 1] = True
        fixed = np.repeat(kept, np.diff(offsets)) if kept.any() else None
        if self.folds:
            lower = np.frombuffer(raw.lower(), np.uint8)
            data = lower if fixed is None else np.where(fixed, data, lower)
        if self.apart:
            at = np.flatnonzero(MARK[data] if fixed is None else MARK[data] & ~fixed)
            wide = np.pad(data, 2)
            two, one, own, next_, last = (wide[at + i] for i in range(5))
            left = LETTER[one] | (LATIN[one] & (two == 0xC3))
            right = (LETTER[next_] | ((next_ == 0xC3) & LATIN[last])) & (own != ord("'"))
            holes = np.sort(np.concatenate([at[left], at[right] + 1]))
            data, offsets = np.insert(data, holes, ord(" ")), offsets + np.searchsorted(holes, offsets)
        return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets), pa.py_buffer(data))

    def _last(self) -> np.ndarray | None:
        """Which ids end a word, if the vocabulary marks them; words of letters alone then need no separator."""
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        if not suffix:
            return None
        ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(suffix)]] = True
        return ends

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _many(self, given: list[bytes]) -> list[bytes]:
        words = [w.decode() for w in given]
        found: list[bytes] = [b""] * len(words)
        letters = [i for i, w in enumerate(words) if w.isalpha() and w.lower().isalpha()] if self.ends is not None else []
        done = set(letters)
        for at in range(0, len(letters), 1000):
            own = letters[at:at + 1000]
            ids = self._whole([" ".join(words[i] for i in own)])[0]
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(own):  # some word fell into several: not as simple as it looked
                done -= set(own)
                continue
            starts, data = np.concatenate([[0], stops[:-1]]), ids.tobytes()
            for i, x, y in zip(own, (starts * 4).tolist(), (stops * 4).tolist()):
                found[i] = data[x:y]
        rest = [i for i in range(len(words)) if i not in done]
        apart = {i for i in rest if BREAK in words[i] or len(words[i]) > LONGEST or "<|" in words[i]}
        alone, together = sorted(apart), [i for i in rest if i not in apart]
        for i, ids in zip(alone, self._whole([words[i] for i in alone])):
            found[i] = ids.tobytes()
        if len(self.mark) != 1:
            for i, ids in zip(together, self._whole([words[i] for i in together])):
                found[i] = ids.tobytes()
            return found
        for at in range(0, len(together), 200):
            own = together[at:at + 200]
            ids = self._whole([f" {BREAK} ".join(words[i] for i in own)])[0]
            ends = np.concatenate([[-1], np.flatnonzero(ids == self.mark[0]), [len(ids)]])
            for k, i in enumerate(own):
                found[i] = ids[ends[k] + 1:ends[k + 1]].tobytes()
        return found

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        return self.encoded(pa.array(texts, pa.string()))

    def encoded(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text of a column; null texts count as empty."""
        texts = texts.fill_null("")
        return self._whole(texts.to_pylist()) if self.words is None else self.words.arrays(self._plainer(texts))


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, words: bool) -> Encoder:
    """One encoder per worker process, so that its words are remembered over tasks."""
    key = (path, words)
    if key not in _encoders:
        _encoders[key] = Encoder(path, words)
    return _encoders[key]


def write(docs: DataFrame, path: str, tokenizer: Callable[[], str], end_id: int, partitions: int, words: bool = False,
          doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode whole texts, append ``end_id`` to each, and write shards in ascending order of document id.

    Rows are dealt out by range of (id, hash of the text), so rows that share an id may lie in several partitions and
    stay in order; identical rows are interchangeable. Null ids come first, null texts count as empty (the end id alone),
    other columns are not read. ``tokenizer`` gives the tokenizer file's path where the task runs.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer(), words)
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        ids: list[np.ndarray] = []
        names: list[int] = []
        held = 0

        def shard():
            flat = np.concatenate(ids)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([before], pa.int64()),
                 pa.array([len(flat)], pa.int64()), pa.array([names], pa.list_(pa.int64())),
                 pa.array([[len(x) for x in ids]], pa.list_(pa.int64())), pa.array([pack(flat)], pa.binary())],
                ["part", "seq", "first_in_part", "n_ids", "doc_ids", "lengths", "payload"])

        end = np.asarray([end_id], "<u4")
        for batch in slices(batches, "text", CHUNK):
            found = encode.encoded(batch.column("text"))
            for name, own in zip(batch.column("doc_id").to_pylist(), found):
                ids.append(np.concatenate([own, end]))
                names.append(name)
                held += len(own) + 1
                if held >= SHARD:
                    yield shard()
                    seq, before, held, ids, names = seq + 1, before + held, 0, [], []
        if ids:
            yield shard()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    dealt = rows.repartitionByRange(partitions, F.col("doc_id").asc_nulls_first(), "tie")
    ordered = dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie").select("doc_id", "text")
    ordered.mapInArrow(run, SHARDS).write.option("compression", "uncompressed").parquet(path)


def read(shards: DataFrame) -> DataFrame:
    """One row per document from the shards: ``doc_id, start, n_tokens, ids_crc32``, every id unpacked.

    Payloads are not shuffled: what they are joined with has one row per partition written, a number the writer chose.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids = unpack(batch.column("payload")[row].as_py()).astype("<u4")
                sizes = np.asarray(batch.column("lengths")[row].as_py(), np.int64)
                ends = np.cumsum(sizes)
                sums = [zlib.crc32(ids[e - n:e].tobytes()) for e, n in zip(ends, sizes)]
                first = batch.column("part_start")[row].as_py() + batch.column("first_in_part")[row].as_py()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_ids")[row].values, pa.array(first + ends - sizes, pa.int64()),
                     pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"])

    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition written
    starts = totals.select("part", F.coalesce(F.sum("ids").over(order), F.lit(0)).alias("part_start"))
    return shards.join(F.broadcast(starts), "part").select("part_start", "first_in_part", "doc_ids", "lengths", "payload").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokens(shards: DataFrame) -> DataFrame:
    """The documents' ids themselves: ``doc_id, ids``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids = unpack(batch.column("payload")[row].as_py())
                ends = np.cumsum(batch.column("lengths")[row].as_py())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_ids")[row].values, nested(np.split(ids, ends[:-1]), pa.int64())], ["doc_id", "ids"])

    return shards.select("doc_ids", "lengths", "payload").mapInArrow(run, "doc_id long, ids array<long>")


def write_and_read(docs: DataFrame, tokenizer: Callable[[], str], end_id: int, words: bool = False) -> DataFrame:
    """Write the shards to the shared folder and give what is read back from them."""
    spark = docs.sparkSession
    path = folder(spark, "tokens")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    write(docs, path, tokenizer, end_id, partitions, words)
    return read(spark.read.schema(SHARDS).parquet(path))
