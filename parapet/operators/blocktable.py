"""A blocklist that is itself a table: texts meet the entries they may contain by an equi-join on prefixes.

An entry's key is a hash of its first ``LONG`` characters, of all of it if it is shorter. A text has the hash of each of its
stretches of the lengths that prefixes have, so a contained entry's key is among them. A Bloom filter of fixed size lets only
keys leave a text's row that some entry may have. What the join proposes is decided by ``contains`` on the texts themselves, so
hashes never decide. Frequent keys are spread over ``SALTS`` parts.

Where only a verdict is asked for, the ``COMMON`` shortest entries, which most texts that are caught contain, are looked up
in the texts' own tasks. Only texts without any of these send keys to the join with the whole list.
"""

from __future__ import annotations

from functools import lru_cache
from typing import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from parapet.functions import fixed
from parapet.sources.session import cut

LONG = 32
#: Bits of the Bloom filter: an eighth of that many bytes at most ever reaches the driver, however long the list.
BITS = 1 << 23
#: Where a key's bits in the filter are read from.
SHIFTS = (0, 20, 41)
#: Bits of the filter that are put together in one row, as many as ``bitmap_construct_agg`` takes.
ROW_BITS = 1 << 15
COMMON = 4_096
SALTS = 16
_BASE = 0x9E3779B97F4A7C15


@lru_cache(4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    up, down = (np.cumprod(np.append(np.uint64(1), np.full(size, base, np.uint64))) for base in (_BASE, pow(_BASE, -1, 1 << 64)))
    return up, down


def _sums(points: np.ndarray) -> np.ndarray:
    """Running sums of the characters, weighted, from which the hash of any stretch is two lookups."""
    _, down = _powers(1 << max(10, len(points).bit_length()))
    return np.append(np.uint64(0), np.cumsum((points + np.uint64(1)) * down[:len(points)]))


def _hashes(sums: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` characters; runs of different sizes never share a meaning (the size is mixed in)."""
    count = len(sums) - size
    if count <= 0:
        return np.zeros(0, np.uint64)
    up, _ = _powers(1 << max(10, (len(sums) - 1).bit_length()))
    total = (sums[size:] - sums[:count]) * up[:count] + np.uint64(size)
    total = (total ^ (total >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    total = (total ^ (total >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return total ^ (total >> np.uint64(29))


def _passed(keys: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    for shift in SHIFTS:
        keys = keys[allowed[(keys >> np.uint64(shift) & np.uint64(BITS - 1)).astype(np.int64)]]
    return keys


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def entry_key(entry: str) -> int:
    """The key of a lower-cased entry, as a signed long."""
    points = _points(entry[:LONG])
    return int(_hashes(_sums(points), len(points)).view(np.int64)[0])


def text_keys(text: str, sizes: Sequence[int], allowed: np.ndarray) -> np.ndarray:
    """The keys of a lower-cased text for entries of these lengths (``LONG`` stands for all longer ones)."""
    sums = _sums(_points(text))
    found = [_passed(_hashes(sums, size), allowed) for size in sizes]
    return np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64)).view(np.int64)


def holds_any(text: str, common: Mapping[int, Mapping[int, Sequence[str]]], allowed: np.ndarray) -> bool:
    """Whether a lower-cased text contains one of ``common``: entries by their length and key."""
    sums = _sums(_points(text))
    for size, known in common.items():
        for key in _passed(_hashes(sums, size), allowed).view(np.int64).tolist():
            if any(entry in text for entry in known.get(key, ())):
                return True
    return False


def _keyed(entries: DataFrame, pattern: str) -> DataFrame:
    """``entry, size, key`` of every different entry that is neither null nor empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("entry").to_pylist()
            yield pa.RecordBatch.from_arrays([
                batch.column("entry"), pa.array([min(len(e), LONG) for e in own], pa.int32()),
                pa.array([entry_key(e) for e in own], pa.int64())], ["entry", "size", "key"])

    rows = entries.select(F.lower(F.col(pattern).cast("string")).alias("entry")).filter("entry <> ''").distinct()
    return cut(rows.mapInArrow(run, "entry string, size int, key long"))


def _filter(listed: DataFrame) -> bytes:
    """The Bloom filter of the entries' keys, packed."""
    bits = listed.select(F.explode(F.array(*[F.shiftrightunsigned("key", shift).bitwiseAND(F.lit(BITS - 1)) for shift in SHIFTS])).alias("bit"))
    rows = bits.groupBy(F.shiftright("bit", ROW_BITS.bit_length() - 1).alias("row")).agg(
        F.bitmap_construct_agg(F.col("bit").bitwiseAND(F.lit(ROW_BITS - 1))).alias("set")).collect()
    packed = bytearray(BITS // 8)
    for r in rows:
        packed[r["row"] * ROW_BITS // 8:(r["row"] + 1) * ROW_BITS // 8] = r["set"]
    return bytes(packed)


def _proposed(low: DataFrame, keys: Sequence[str], listed: DataFrame, common: Mapping[int, Mapping[int, Sequence[str]]]) -> DataFrame:
    """``keys, __key``: the keys of every text that the filter lets pass; a null key alone for texts that hold a common entry."""
    sizes = sorted(r["size"] for r in listed.select("size").distinct().collect())  # LONG values at most
    packed = _filter(listed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allowed = np.unpackbits(np.frombuffer(packed, np.uint8), bitorder="little").view(bool)
        for batch in batches:
            texts = batch.column("__low").to_pylist()
            caught = np.array([bool(common) and holds_any(t, common, allowed) for t in texts], bool)
            found = [np.zeros(1, np.int64) if c else text_keys(t, sizes, allowed) for t, c in zip(texts, caught)]
            rows = np.repeat(np.arange(len(found)), [len(f) for f in found])
            flat = np.concatenate(found) if found else np.zeros(0, np.int64)
            own = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k).take(own) for k in keys], pa.array(flat, pa.int64(), mask=caught[rows])], [*keys, "__key"])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in low.select(*keys).schema.fields)
    return low.mapInArrow(run, f"{shape}, __key long")


def _lowered(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    return df.select(*keys, F.lower(F.col(text).cast("string")).alias("__low")).filter(F.col("__low").isNotNull())


def _pairs(low: DataFrame, keys: Sequence[str], seen: DataFrame, listed: DataFrame) -> DataFrame:
    """``keys, entry``: the proposed pairs that hold."""
    salted = seen.withColumn("__salt", F.pmod(F.xxhash64(*keys), F.lit(SALTS)))
    spread = listed.select("entry", F.col("key").alias("__key"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>"))
                           .alias("__salt"))
    pairs = salted.join(spread, ["__key", "__salt"]).select(*keys, "entry")
    return low.join(pairs, [*keys]).filter(F.contains("__low", "entry")).select(*keys, "entry")


def hits(df: DataFrame, keys: Sequence[str], text: str, entries: DataFrame, pattern: str) -> DataFrame:
    """``keys, entry``: every text with every entry it contains, in any case. ``keys`` name a row.

    Null texts and null or empty entries hit nothing. Texts are read twice and shuffled by ``keys`` only where the proposed
    pairs are too many to broadcast; entries are never paired with all texts.
    """
    listed, low = _keyed(entries, pattern), _lowered(df, keys, text)
    return _pairs(low, keys, _proposed(low, keys, listed, {}), listed)


def _common(listed: DataFrame) -> dict[int, dict[int, list[str]]]:
    """The ``COMMON`` shortest entries, by length and key; those beyond ``LONG`` characters are left to the join."""
    found: dict[int, dict[int, list[str]]] = {}
    for r in listed.filter(F.length("entry") <= LONG).orderBy("size", "entry").limit(COMMON).collect():
        found.setdefault(r["size"], {}).setdefault(r["key"], []).append(r["entry"])
    return found


def caught(df: DataFrame, keys: Sequence[str], text: str, entries: DataFrame, pattern: str) -> DataFrame:
    """``keys`` of the texts that contain any entry: those of ``hits``, without a row for every entry they contain."""
    listed, low = _keyed(entries, pattern), _lowered(df, keys, text)
    seen = cut(_proposed(low, keys, listed, _common(listed)))
    known = seen.filter(F.col("__key").isNull()).select(*keys)
    return known.unionByName(_pairs(low, keys, seen.filter(F.col("__key").isNotNull()), listed).select(*keys)).distinct()


def screen_by_table(df: DataFrame, keys: Sequence[str], text: str, entries: DataFrame, pattern: str,
                    message: str = fixed.REASON_BLOCKLIST, name: str = "blocked-patterns") -> DataFrame:
    """Adds ``blocked``, ``screen``, ``reason``, as the blocklist screen of a policy does for a short list."""
    found = caught(df, keys, text, entries, pattern).withColumn("__hit", F.lit(True))
    none = F.lit(None).cast("string")
    hit = F.col("__hit").isNotNull()
    return df.join(found, [*keys], "left").withColumns({
        "blocked": hit, "screen": F.when(hit, F.lit(name)).otherwise(none),
        "reason": F.when(hit, F.lit(message)).otherwise(none)}).drop("__hit")
