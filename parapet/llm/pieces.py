"""SentencePiece models encoded and decoded by the tokenizers library.

The model file is read as a protobuf by its public field numbers: pieces with scores and types, the model kind, the
normaliser. From these a ``tokenizers.Tokenizer`` is rebuilt: precompiled character map, white space collapsing and
dummy prefix as normalisers, the marker U+2581 for blanks, unigram scores or merges in score order, and byte fallback.
``check`` compares its ids with the sentencepiece library.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from parapet.llm.common import nested, slices
from parapet.llm.tokens import Words

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Text handed to the library at once.
CHUNK = 2 << 20
#: Words a worker remembers, of either kind; decoded texts and ids need room beside them.
REMEMBERED = 600_000
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())),
                       T.StructField("n_tokens", T.LongType()), T.StructField("decoded", T.StringType()),
                       T.StructField("exact", T.BooleanType())])


@dataclass
class Model:
    """What a model file says."""

    kind: int = UNIGRAM
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    byte_fallback: bool = False
    charsmap: bytes = b""
    prefix: bool = True
    collapse: bool = True
    escape: bool = True
    suffix: bool = False


def _varint(data: bytes, at: int) -> tuple[int, int]:
    shift = value = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            if kind == 2:
                size, at = _varint(data, at)
            else:
                size = {1: 8, 5: 4}[kind]
            value, at = data[at:at + size], at + size
        yield key >> 3, value


def parse(data: bytes) -> Model:
    """Read a serialized ``ModelProto``: 1 pieces, 2 trainer (3 kind, 24 suffix, 35 bytes), 3 normaliser."""
    model = Model()
    for number, value in _fields(data):
        if number == 1:
            text, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    text = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            model.pieces.append((text, score, kind))
        elif number == 2:
            for n, v in _fields(value):
                if n == 3:
                    model.kind = v
                elif n == 24:
                    model.suffix = bool(v)
                elif n == 35:
                    model.byte_fallback = bool(v)
        elif number == 3:
            for n, v in _fields(value):
                if n == 2:
                    model.charsmap = v
                elif n == 3:
                    model.prefix = bool(v)
                elif n == 4:
                    model.collapse = bool(v)
                elif n == 5:
                    model.escape = bool(v)
    if model.kind not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models can be rebuilt")
    if model.suffix or not model.escape or any(kind == USER for _, _, kind in model.pieces):
        raise ValueError("models with a suffix marker, unescaped blanks or user-defined pieces are not supported")
    return model


def merges(model: Model) -> list[tuple[str, str]]:
    """Pairs of pieces that make a piece, best score first."""
    scores = {text: score for text, score, kind in model.pieces if kind == NORMAL}
    found = []
    for text, score in scores.items():
        for cut in range(1, len(text)):
            left, right = text[:cut], text[cut:]
            if left in scores and right in scores:
                found.append((-score, cut, left, right))
    return [(left, right) for _, _, left, right in sorted(found)]


def cuttable(model: Model) -> bool:
    """Whether no piece continues over a blank, so that texts fall into words before the search for pieces."""
    return not any(re.search(f"[^{MARK}]{MARK}", text) for text, _, kind in model.pieces if kind == NORMAL)


def rebuild(model: Model, prefix: bool | None = None):
    """The ``tokenizers.Tokenizer`` of a model; ``prefix`` overrides the dummy prefix, for later parts of a text."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    unknown = next(i for i, (_, _, kind) in enumerate(model.pieces) if kind == UNKNOWN)
    if model.kind == BPE:
        core = models.BPE({text: i for i, (text, _, _) in enumerate(model.pieces)}, merges(model),
                          unk_token=model.pieces[unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        core = models.Unigram([(text, score) for text, score, _ in model.pieces], unknown, model.byte_fallback)
    tokenizer = Tokenizer(core)
    steps = []
    if model.charsmap:
        steps.append(normalizers.Precompiled(model.charsmap))
    if model.collapse:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.prefix if prefix is None else prefix:
        steps.append(normalizers.Prepend(MARK))
    steps.append(normalizers.Replace(" ", MARK))
    tokenizer.normalizer = normalizers.Sequence(steps)
    if cuttable(model):
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*|^[^{MARK}]+"), "removed", invert=True)
    ends = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    tokenizer.decoder = decoders.Sequence(ends + [decoders.Strip(" ", 1, 0)] * model.prefix)
    return tokenizer


class Codec:
    """Encodes and decodes lists of texts. ``threads`` are the library's own, inside one task."""

    def __init__(self, data: bytes, threads: int = 2):
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        self.model = parse(data)
        self.tokenizer = rebuild(self.model)
        self.plain = rebuild(self.model, prefix=False)
        #: Words of unnormalised text stand for themselves only if normalising means no more than the marker.
        self.wordwise = cuttable(self.model) and not self.model.charsmap and not self.model.collapse
        self.words = Words(self._each, REMEMBERED)
        self.marked = Words(self._joined, REMEMBERED, {})
        self.starts = np.array([text.startswith(MARK) for text, _, _ in self.model.pieces])
        self.raw = self._bytes()

    def _bytes(self) -> list[bytes] | None:
        """What each piece stands for. None if a piece's text is not simply its own (the library then decodes)."""
        if not self.tokenizer.get_vocab_size() == len(self.model.pieces):
            return None
        return [bytes([int(text[3:5], 16)]) if kind == BYTE else text.replace(MARK, " ").encode()
                for text, _, kind in self.model.pieces]

    def _each(self, words: list[str]) -> list[bytes]:
        found = self.plain.encode_batch_fast(words, add_special_tokens=False)
        return [np.asarray(e.ids, "<u4").tobytes() for e in found]

    def _joined(self, words: list[str]) -> list[bytes]:
        """Ids of words with the marker before each, many to a text: a piece that begins with the marker begins a word."""
        found: list[bytes] = []
        for at in range(0, len(words), 1000):
            own = words[at:at + 1000]
            ids = np.asarray(self.tokenizer.encode_batch_fast([" ".join(own)], add_special_tokens=False)[0].ids, "<u4")
            starts = np.flatnonzero(self.starts[ids])
            if len(starts) != len(own):
                found += self._each([MARK + w for w in own])
                continue
            stops, data = np.append(starts[1:], len(ids)), ids.tobytes()
            found += [data[x:y] for x, y in zip((starts * 4).tolist(), (stops * 4).tolist())]
        return found

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts. Empty texts have none."""
        if not self.wordwise:
            return [np.asarray(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        found: list[bytes] = [b""] * len(texts)
        # one blank between words: each word but the marker is a word of the text as it stands
        plain = [i for i, t in enumerate(texts) if t and self.model.prefix and "  " not in t and MARK not in t
                 and t[0] != " " and t[-1] != " "]
        for i, ids in zip(plain, self.marked.ids([texts[i].split(" ") for i in plain])):
            found[i] = ids
        own = set(plain)
        other = [i for i, t in enumerate(texts) if t and i not in own]
        lead = MARK if self.model.prefix else ""
        cut = re.compile(f"{MARK}+[^{MARK}]*|^[^{MARK}]+").findall
        for i, ids in zip(other, self.words.ids([cut(lead + texts[i].replace(" ", MARK)) for i in other])):
            found[i] = ids
        return [np.frombuffer(x, "<u4") for x in found]

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """Texts of ids: pieces joined, byte pieces as bytes. What is not UTF-8 then is left to the library."""
        if self.raw is None:
            return self._decoded(ids)
        back: list[str] = []
        for own in ids:
            text = b"".join(map(self.raw.__getitem__, own.tolist()))
            try:
                back.append(text[1 if self.model.prefix and text[:1] == b" " else 0:].decode())
            except UnicodeDecodeError:
                back += self._decoded([own])
        return back

    def _decoded(self, ids: list[np.ndarray]) -> list[str]:
        return self.tokenizer.decode_batch([x.tolist() for x in ids], skip_special_tokens=False)

    def expected(self, text: str) -> str:
        """What decoding gives back: the normalised text (the text itself for an identity normaliser)."""
        done = self.plain.normalizer.normalize_str(text) if text and (self.model.charsmap or self.model.collapse) else text
        return done.replace(MARK, " ")


_codecs: dict[tuple[bytes, int], Codec] = {}


def codec(data: bytes, threads: int) -> Codec:
    """One codec per worker process: tables are built and words met once, not in every task."""
    if (data, threads) not in _codecs:
        _codecs[data, threads] = Codec(data, threads)
    return _codecs[data, threads]


def check(data: bytes, texts: list[str]) -> list[int]:
    """Positions of texts whose ids differ from the sentencepiece library's."""
    import sentencepiece

    other = sentencepiece.SentencePieceProcessor(model_proto=data)
    ours = Codec(data).encode(texts)
    return [i for i, text in enumerate(texts) if other.encode(text) != ours[i].tolist()]


def encode_decode(docs: DataFrame, model: bytes, doc_id: str = "doc_id", text: str = "text", threads: int = 2,
                  keep_decoded: bool = False) -> DataFrame:
    """Encode every whole text and decode its ids again, partition by partition, without a shuffle.

    One row per input row: ``doc_id, ids, n_tokens, decoded, exact``; ``exact`` says that decoding gave the normalised
    text. ``decoded`` is null unless kept. Null texts count as empty; empty texts have no ids; repeated rows and null
    ids are kept as they are; other columns are not read.
    """
    kinds = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("n_tokens", pa.int64()),
                       ("decoded", pa.string()), ("exact", pa.bool_())])

    def run(batches):
        own = codec(model, threads)
        for batch in slices(batches, "text", CHUNK):
            texts = [x or "" for x in batch.column("text").to_pylist()]
            ids = own.encode(texts)
            back = own.decode(ids)
            exact = [b == own.expected(t) for b, t in zip(back, texts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), nested(ids, pa.int32()), pa.array([len(x) for x in ids], pa.int64()),
                 pa.array(back if keep_decoded else [None] * len(back), pa.string()), pa.array(exact, pa.bool_())],
                schema=kinds)

    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return narrow.mapInArrow(run, SCHEMA)
