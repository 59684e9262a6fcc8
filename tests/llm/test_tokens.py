import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parapet.llm import mixing, packed, pieces
from parapet.llm.queries import _word_bpe, piece_model

TEXTS = ["Hello  wörld", "", None, "a\x01b \x01 <|endoftext|>x ΑΣ İ", " lead and trail ", "x" * 300 + " y" * 50, "tab\there\r\nand \x0b\x1c é",
         "</s><0x0A> 😀 ▁x", "Hello  wörld"]


@pytest.fixture
def docs(spark):
    rows = [(i if i != 4 else None, t, "s" if i % 3 else None, -1, "own") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "s", -1, "own")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_tokens int, ids string")


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 4000])
@pytest.mark.parametrize("block", [8, 256])
def test_blocks_give_back_every_id(n, block):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.pareto(0.5, n) * 20, 2 ** 32 - 1).astype(np.uint32)
    payload = packed.pack(ids, block)
    assert (packed.unpack(payload) == ids).all()
    assert (packed.unpack(payload, n // 3, n // 2) == ids[n // 3:n // 2]).all()


def test_words_encode_like_whole_texts():
    texts = [t or "" for t in TEXTS] + ["don't we'll I'm 12,345 ...!?" * 20]
    one, other = (packed.Encoder(_word_bpe(), w) for w in (True, False))
    texts += ["a\x0bb\x0cc\x1cd\x85e\xa0f\u2028g", "\x0b", "a \x00 b"]
    assert [x.tolist() for x in one(texts)] == [x.tolist() for x in other(texts)]


def test_shards_in_order(spark, docs):
    got = packed.write_and_read(docs, _word_bpe, 2, words=True).orderBy("start").collect()
    whole = packed.Encoder(_word_bpe(), False)
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    want = sorted((-1 if d is None else d, zlib.crc32(np.append(whole([t])[0], 2).astype("<u4").tobytes())) for d, t in rows)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["ids_crc32"]) for r in got) == want
    assert [r["doc_id"] for r in got][1:] == sorted(d for d, _ in rows if d is not None)
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]
    assert packed.write_and_read(docs.limit(0), _word_bpe, 2).count() == 0


def test_pieces_match_the_other_library(spark, docs):
    assert pieces.check(piece_model(), [t or "" for t in TEXTS if t is None or "▁" not in t]) == []
    got = pieces.encode_decode(docs, piece_model(), keep_decoded=True).collect()
    assert all(r["exact"] for r in got) and len(got) == docs.count()
    assert {r["decoded"] for r in got} == {(t or "").replace("▁", " ") for t in TEXTS}
    assert [r["n_tokens"] for r in got] == [len(r["ids"]) for r in got]


def test_own_decoding_is_the_library_s(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    texts = [r["text"] or "" for r in rows] + [t or "" for t in TEXTS] + ["\u200b漢😀字", "  a", " ", "a  b ", "é" * 50]
    codec = pieces.Codec(piece_model())
    ids = codec.encode(texts)
    cut = [x[1:] for x in ids] + [x[:-1] for x in ids] + [np.array([3 + 0xC3, 3 + 0x28, 300], "<u4"), np.array([0, 1, 2, 0], "<u4")]
    assert codec.decode(ids + cut) == codec._decoded(ids + cut)


def test_one_codec_per_worker():
    assert pieces.codec(piece_model(), 2) is pieces.codec(piece_model(), 2)


def test_pieces_match_on_a_whole_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    texts = [r["text"] or "" for r in rows] + ["Ωμέγα и мир 漢字かな交じり文 العربية हिन्दी " * 400, "ﬁn ½ Å e\u0301 \u200b\u00a0x"]
    assert pieces.check(piece_model(), [t for t in texts if "▁" not in t]) == []


def test_unigram_models():
    def number(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def field(k, data):
        return number(k << 3 | 2) + number(len(data)) + data

    def piece(text, score, kind):
        return field(1, field(1, text.encode()) + b"\x15" + np.float32(score).tobytes() + b"\x18" + bytes([kind]))

    model = piece("<unk>", 0, 2) + b"".join(piece(t, s, 1) for t, s in (("▁", -3), ("▁a", -1), ("a", -2), ("b", -2), ("ab", -1.5)))
    model += field(2, b"\x18\x01" + number(24 << 3) + b"\x00") + field(3, b"\x18\x01\x20\x00")
    codec = pieces.Codec(model, 1)
    assert [x.tolist() for x in codec.encode(["ab ab", "aab"])] == [[2, 4, 2, 4], [2, 5]]


def test_mixing_keeps_rates(spark, docs):
    many = spark.range(4000).select("id", F.when(F.col("id") < 3600, "big").otherwise("small").alias("source"), F.lit("t").alias("mix_n"))
    got = {r["source"]: r["n"] for r in mixing.mix(many, "id").groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(got["big"] - 3000) < 250 and abs(got["small"] - 1000) < 150  # shares go with the roots of 3600 and 400
    again = mixing.mix(docs, weights={"s": 1.0}).select("doc_id", "source", "mix_copy").collect()
    assert {r["source"] for r in again} <= {"s"}
    assert mixing.mix(docs.limit(0)).count() == 0
    order = [r["mix_order"] for r in mixing.mix(many, "id").coalesce(1).collect()]
    assert len(set(order)) == len(order)


def test_words_met_once_take_a_fixed_room():
    from parapet.llm.tokens import Words

    words = Words(lambda given: [w.encode() for w in given])
    room = sys.getsizeof(words.met)
    for at in range(0, 60_000, 20_000):
        assert words.ids([[f"w{i}" for i in range(at, at + 20_000)]]) == [
            "".join(f"w{i}" for i in range(at, at + 20_000)).encode()]
    assert sys.getsizeof(words.met) == room and len(words.known) < 1_000
    assert words.ids([["w59999", "", "w59999"]]) == [b"w59999w59999"] and "w59999" in words.known


def test_freed_arrow_memory_leaves_the_worker(monkeypatch):
    from parapet.llm import common

    class Pool:
        released = 0

        def release_unused(self):
            Pool.released += 1

    batches = [pa.RecordBatch.from_pydict({"text": ["ab", None, "c" * 9]})] * 3
    monkeypatch.setattr(common.pa, "default_memory_pool", Pool)
    got = [s.column("text").to_pylist() for s in common.slices(iter(batches), "text", 4)]
    assert got == [["ab", None], ["c" * 9]] * 3 and Pool.released == 3


def test_encoder_keeps_a_fixed_room_for_rare_words():
    one = packed.Encoder(_word_bpe(), True)
    room = sys.getsizeof(one.words.met)
    one([" ".join(f"w{i}x" for i in range(3000))])
    assert sys.getsizeof(one.words.met) == room and len(one.words.known) < 100


def test_case_and_marks_make_no_new_words(monkeypatch):
    one, given = packed.Encoder(_word_bpe(), True), []
    many = one.words.encode
    monkeypatch.setattr(one.words, "encode", lambda words: given.extend(words) or many(words))
    texts = ['Word word, (WORD) word... "wÖrd" wÖrd!?', "word,Word;word $$$word$$$"]
    assert [x.tolist() for x in one(texts)] == [x.tolist() for x in packed.Encoder(_word_bpe(), False)(texts)]
    assert [w for w in given if w.isalpha()] == [b"word"] and sum("w" in w.decode() for w in given) == 2


def test_cut_and_folded_texts_encode_like_whole_ones():
    one, other = (packed.Encoder(_word_bpe(), w) for w in (True, False))
    parts = ["a", "H", "s", "T", "É", "é", "ß", "×", "÷", "Σ", "İ", "\u212a", "\u0331", "\u0300", "\u0344", "\u0338", "\u05b0", "\u1dc0",
             "\u200d", "«", "»", "—", "'", "'s", "'LL", ".", ",", "=", "<", "|", "<|", "|>", "<|endoftext|>", "<|ENDOFTEXT|>",
             "1", "\u0663", " ", "\n", "\xa0", "\x85", "字", "😀", "\x00", "\x01", ""]
    rng = np.random.default_rng(4)
    texts = ["".join(parts[i] for i in rng.integers(0, len(parts), n)) for n in rng.integers(0, 12, 6000)]
    texts += ["".join(p for p in parts[:2] + ["'", "?", "É", " "] for _ in range(n)) for n in range(4)]
    for at in range(0, len(texts), 500):  # texts stand beside each other, so nothing may cross their edges
        assert [x.tolist() for x in one(texts[at:at + 500])] == [x.tolist() for x in other(texts[at:at + 500])]
    assert one([]) == []


def test_words_stay_whole_for_tokenizers_that_need_them(tmp_path):
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    cased, joined = (Tokenizer.from_file(_word_bpe()) for _ in range(2))
    cased.normalizer = normalizers.NFC()
    joined.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    for name, tokenizer, simple in (("cased", cased, (False, True)), ("joined", joined, (True, False))):
        tokenizer.save(str(tmp_path / name))
        one, other = (packed.Encoder(str(tmp_path / name), w) for w in (True, False))
        assert (one.folds, one.apart) == simple
        texts = ["Word word, WORD. (word)", "don't Don't"]
        assert [x.tolist() for x in one(texts)] == [x.tolist() for x in other(texts)]
