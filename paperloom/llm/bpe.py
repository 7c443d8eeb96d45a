"""Byte-level BPE ids of whole texts through the tokenizers library.

The vocabulary file is a parameter. Texts are cut where ASCII white space follows
another character; the pre-tokenizer of byte-level BPE always has a boundary there,
so each unit's ids don't depend on its neighbours, and a bounded store of units
gives the library's ids for the whole text. Units are found, hashed and looked up
in array steps for many texts at once. Texts with other white space, next to which
that rule needn't hold, or with the string of a special token go to the library as
they are.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np

from paperloom.llm.words import Lookup, span_hashes

#: White space of Unicode beyond ASCII.
WIDE_SPACE = "\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Units and ids held per worker before the store starts anew; bounds its memory.
CACHE_UNITS, CACHE_IDS = 2_000_000, 16_000_000
#: Bytes of texts whose units are looked up at once.
GROUP_BYTES = 2_000_000

_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def default_vocabulary() -> str:
    """The vocabulary file that the queries name: a public 50k byte-level BPE."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes, unit by unit, from a bounded store."""

    def __init__(self, path: str, cache_units: int = CACHE_UNITS, cache_ids: int = CACHE_IDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        #: Bytes of text that each id stands for: in byte-level vocabularies each character of a token is one.
        self.lengths = np.zeros(max(vocabulary.values()) + 1, np.int64)
        #: Ids whose text holds a line feed, which byte-level vocabularies write as this letter.
        self.breaks = np.zeros(len(self.lengths), bool)
        for token, i in vocabulary.items():
            self.lengths[i] = len(token)
            self.breaks[i] = "\u010a" in token
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = re.compile("|".join([f"[{WIDE_SPACE}]", *added]))
        self.cache_units, self.cache_ids = cache_units, cache_ids
        self._clear()

    def _clear(self) -> None:
        self.index = Lookup(np.empty(0, np.uint64))
        #: All ids of the units, one after the other, and where each unit's start.
        self.ids, self.starts = np.empty(1024, "<u4"), np.zeros(1024, np.int64)

    def encode(self, texts: list[str | None], end: bytes = b"\0\0\0\0") -> list[bytes]:
        """For each text its ids and ``end``; a null or empty text has only ``end``.

        Some texts are taken at a time, so memory stays bounded by ``GROUP_BYTES``
        and the longest text.
        """
        out: list[bytes] = []
        group: list[bytes] = []
        size = 0
        for text in texts:
            if text and self.odd.search(text):
                out += self._encode(group, end)
                out.append(np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes() + end)
                group, size = [], 0
                continue
            group.append(text.encode() if text else b"")
            size += len(group[-1])
            if size >= GROUP_BYTES:
                out += self._encode(group, end)
                group, size = [], 0
        return out + self._encode(group, end)

    def _encode(self, group: list[bytes], end: bytes) -> list[bytes]:
        data = b"".join(group)
        stops = np.cumsum([len(t) for t in group], dtype=np.int64)
        if not data:
            return [end] * len(group)
        blank = _BLANK[np.frombuffer(data, np.uint8)]
        opens = blank.copy()
        opens[1:] &= ~blank[:-1]
        opens[np.append(0, stops[:-1][stops[:-1] < len(data)])] = True
        starts = np.flatnonzero(opens)
        ends = np.append(starts[1:], len(data))
        hashes = span_hashes(data, starts, ends)
        at = self.index(hashes)
        if self._learn(data, starts, ends, hashes, at, blank):
            at = self.index(hashes)
        at = at.astype(np.int64)
        first = self.starts[at]
        sizes = self.starts[at + 1] - first
        upto = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.ids[np.repeat(first - upto[:-1], sizes) + np.arange(upto[-1])]
        edges = (upto[np.searchsorted(starts, np.append(0, stops))] * 4).tolist()
        whole = ids.tobytes()
        return [whole[a:b] + end for a, b in zip(edges, edges[1:], strict=False)]

    def _learn(self, data: bytes, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, at: np.ndarray, blank: np.ndarray) -> bool:
        """Store the units that have no number yet; all of these if the store has to start anew."""
        missing = np.flatnonzero(at < 0)
        if not len(missing):
            return False
        new, first = np.unique(hashes[missing], return_index=True)
        if self.index.size and (self.index.size + len(new) > self.cache_units or self.starts[self.index.size] > self.cache_ids):
            self._clear()
            missing = np.arange(len(hashes))
            new, first = np.unique(hashes, return_index=True)
        own = missing[first]
        # Units that begin with white space and don't end with it may follow each other as in a text.
        alone = ~blank[starts[own]] | blank[ends[own] - 1]
        for part, size in ((own[~alone], 64), (own[alone], 1)):
            for low in range(0, len(part), 8192):
                self._store(data, starts, ends, hashes, part[low : low + 8192], size)
        return True

    def _store(self, data: bytes, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, own: np.ndarray, together: int) -> None:
        """Encode units, so many in a line, and cut the lines' ids by the bytes they stand for."""
        units = [data[a:b] for a, b in zip(starts[own].tolist(), ends[own].tolist(), strict=True)]
        lines = [b"".join(units[k : k + together]).decode() for k in range(0, len(units), together)]
        got = self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(g.ids for g in got), "<u4")
        stops = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum(ends[own] - starts[own]), "left") + 1
        n = self.index.size
        low = int(self.starts[n])
        while len(self.starts) < n + len(own) + 1:
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        while len(self.ids) < low + len(ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[low : low + len(ids)] = ids
        self.starts[n + 1 : n + len(own) + 1] = low + stops
        self.index.add(hashes[own])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
