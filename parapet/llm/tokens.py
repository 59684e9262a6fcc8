"""Encoding text word by word with a tokenizer whose words do not depend on each other.

Most words of a corpus come back all the time, and many others never do. Where a tokenizer never looks across a
separator, the ids of a text are the ids of its words in order, so each worker remembers words it has met in two calls and
the library sees the others. A word met once takes no lasting room: names and misspellings do not push out common words.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from parapet.llm.common import buffers

#: Words remembered by one Python worker; a full memory is emptied, which costs time and changes nothing.
REMEMBERED = 800_000
#: Places for marks of words met once, a byte each. A later word may take the place of an earlier one, and two words of one
#: mark may be remembered a call early, no more.
MET = 1 << 22
#: Longer words are encoded each time.
LONGEST = 64


class Words:
    """Ids of words as little-endian 32-bit bytes. ``start`` are words known beforehand: the empty one has no ids."""

    def __init__(self, encode: Callable[[list], list[bytes]], most: int = REMEMBERED, start: dict | None = None):
        self.encode, self.most, self.start = encode, most, {"": b""} if start is None else start
        self.known: dict = dict(self.start)
        self.met = bytearray(MET)

    def ids(self, texts: list[list]) -> list[bytes]:
        """For each list of words (text or bytes, one kind only), the ids of all words joined."""
        new = self._learn(set().union(*texts))
        found = [b"".join(map(self.known.__getitem__, words)) for words in texts]
        self._forget(new)
        return found

    def arrays(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text of a column without nulls, cut at white space of one byte. Equal words are looked up once."""
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        offsets, data = buffers(coded.dictionary)
        data, offsets = data.tobytes(), offsets.tolist()
        words = [data[x:y] for x, y in zip(offsets, offsets[1:])]
        new = self._learn(set(words))
        found = list(map(self.known.__getitem__, words))
        self._forget(new)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        which = coded.indices.to_numpy(zero_copy_only=False)
        counts = sizes[which]
        ends = np.concatenate([[0], np.cumsum(counts)])
        at = np.repeat((np.cumsum(sizes) - sizes)[which] - ends[:-1], counts) + np.arange(ends[-1])
        ids = np.frombuffer(b"".join(found), "<u4")[at]
        cuts = ends[lists.offsets.to_numpy()]
        return [ids[x:y] for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist())]

    def _learn(self, words: set) -> list:
        """Take up the words not known."""
        if len(self.known) > self.most:
            self.known = dict(self.start)
        new = list(words.difference(self.known))
        if new:
            self.known.update(zip(new, self.encode(new)))
        return new

    def _forget(self, new: list) -> None:
        """Of the words just taken up, keep those met in an earlier call."""
        known, met = self.known, self.met
        for word in new:
            at, mark = (code := hash(word)) % MET, code // MET % 255 + 1
            if met[at] != mark or len(word) > LONGEST:
                met[at] = mark
                del known[word]
