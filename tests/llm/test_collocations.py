import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from parapet.llm import collocations


def brute(rows, least=10, top=2000, covered=50):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                f.update((lang, *words[i:i + k]) for i in range(len(words) - k + 1))
    often = {g: a for g, a in f.items() if len(g) > 2 and a >= least}
    out = {}
    for g, a in often.items():
        lang, words = g[0], g[1:]
        if any(100 * b >= covered * a for h, b in often.items() if len(h) > len(g) and h[0] == lang
               and any(h[i:i + len(words)] == words for i in range(1, len(h)))):
            continue
        cuts = [(1_000_000 * a * a // (f[(lang, *words[:k])] * f[(lang, *words[k:])]), k) for k in range(1, len(words))]
        s, k = min(cuts)
        out.setdefault(lang, []).append((-s, -a, " ".join(words).encode(), f[(lang, *words[:k])], f[(lang, *words[k:])]))
    return sorted((lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items()
                  for i, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1))


def made(seed, size=300):
    rng = random.Random(seed)
    words = ["a", "B", "the", "of", "é", "zz\x01", "zz", " x", "new", "york", "city", "İ", "a\x00b", "x y"]
    rows = []
    for _ in range(size):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", " ", ". ", "\n", "\x0b", ",", " "])
                       for _ in range(rng.randrange(40)))
        rows.append((rng.choice(["en", "en", "fr", None, "und", ""]), text + " New York City is" * (rng.random() < 0.3)))
    return rows + [("en", None), (None, ""), ("en", "...!?"), ("fr", "w" * 3000 + " " + "w" * 3000)] + [("en", "hot pair of words")] * 50


def found(spark, rows, **options):
    docs = spark.createDataFrame([(l, t, "x", 1) for l, t in rows], "lang string, text string, phrase string, bucket int")
    return sorted(tuple(r) for r in collocations.phrases(docs, **options).collect())


def test_like_brute_force(spark):
    rows = made(1)
    want = brute(rows)
    assert len(want) > 30 and found(spark, rows) == want
    assert found(spark, rows, top=3, least=4) == brute(rows, 4, 3)
    assert found(spark, []) == [] == found(spark, [(None, None)])


@pytest.mark.parametrize("least", [2, 7])
def test_many_buckets_and_runs_change_nothing(spark, monkeypatch, least):
    rows = made(2)
    # workers get these constants with the functions of the module only if they are read on the driver; run here instead
    for name, value in (("BLOCK", 64), ("WORDS", 100)):
        monkeypatch.setattr(collocations, name, value)
    texts: dict[bytes, list[bytes]] = {}
    for lang, text in rows:
        texts.setdefault((lang or "und").encode() if lang is not None else b"und", []).append((text or "").encode())
    grams = sorted({(lang, *re.findall(rb"[^ \t.,;:!?\n\x0b]+", t.lower())[i:i + 3], b"", b"")[:4]
                    for lang, own in texts.items() for t in own[::7] for i in range(0, 30, 4) if t})
    for boundaries in ([], grams[::9], grams):
        run = collocations._runs(boundaries)
        batch = pa.RecordBatch.from_arrays([pa.array([l.decode() for l, own in texts.items() for _ in own]),
                                            pa.array([t.decode() for own in texts.values() for t in own])], ["lang", "text"])
        blocks = pa.Table.from_batches(list(run(iter([batch]))))
        assert max(blocks.column("bucket").to_pylist()) <= len(boundaries)
        merged = [collocations._merged(least)(blocks.filter(pc.equal(blocks.column("bucket"), b)))
                  for b in sorted(set(blocks.column("bucket").to_pylist()))]
        rows_out = [r for t in merged for r in t.to_pylist()]
        grams_out = [(r["lang"], *[x for x in (r["k1"], r["k2"], r["k3"]) if x is not None], r["f"]) for r in rows_out if r["kind"] == 0]
        assert grams_out == sorted(grams_out, key=lambda g: g[:-1])  # one stream in prefix order
        want = Counter()
        for lang, own in texts.items():
            for t in own:
                for piece in re.split(rb"[.,;:!?\n\x0b]", t.lower()):
                    w = [x for x in re.split(rb"[ \t]", piece) if x]
                    for k in (1, 2, 3):
                        want.update((lang, *w[i:i + k]) for i in range(len(w) - k + 1))
        assert {g[:-1]: g[-1] for g in grams_out} == {g: n for g, n in want.items() if n >= least}


def test_streams_split_anywhere(spark, monkeypatch):
    monkeypatch.setattr(collocations, "BUCKET", 200)
    monkeypatch.setattr(collocations, "SECOND", 7)
    for seed in (3, 4):
        rows = made(seed, 250)
        assert found(spark, rows, least=3) == brute(rows, 3)


def test_blocks_give_back_what_went_in():
    words = [f"w{i:05d}".encode() for i in range(70_000)]
    rng = np.random.default_rng(1)
    bits = 17
    k = np.sort(rng.integers(1, 70_001, 5000)) << 2 * bits | rng.integers(0, 70_001, 5000) << bits
    keys = np.unique(k | np.where((k >> bits) & (2 ** bits - 1) > 0, rng.integers(0, 70_001, 5000), 0))
    n = rng.integers(1, 2 ** 40, len(keys))
    names, (a, b, c, counts) = collocations._unpacked(collocations._packed(words, keys, n, bits))
    back = np.array([0, *[words.index(w) + 1 for w in names]]) if len(names) < 50 else np.array([0, *[int(w[1:]) + 1 for w in names]])
    assert (counts == n).all() and (back[a] << 2 * bits | back[b] << bits | back[c] == keys).all()
