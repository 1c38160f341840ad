"""Exact ids of a byte-level BPE tokenizer (tokenizers library), with each distinct chunk of text encoded once.

A text is cut before an ASCII white-space byte that follows something that is no white space. The split rule of
byte-level BPE never joins what stands on both sides of such a place, and looks past it nowhere, so the ids of the
chunks, one after the other, are the ids of the text. Special strings hold no white space and stay in a chunk.
"""

from __future__ import annotations

import hashlib
import os
from functools import cache

import numpy as np

from .spans import BITS, POOL, SpanCache
from .text import Flat, Spans

_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[33:127] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
#: Last two bytes of the white space beyond ASCII, in UTF-8.
_WIDE = [(0xC2, 0x85), (0xC2, 0xA0), (0x9A, 0x80), *((0x80, x) for x in range(0x80, 0x8B)), (0x80, 0xA8), (0x80, 0xA9), (0x80, 0xAF), (0x81, 0x9F)]
_WIDE_PAIR = np.zeros(65536, bool)
_WIDE_PAIR[[a << 8 | b for a, b in _WIDE]] = True


def chunks(flat: Flat, letters: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every chunk and the chunks of each text. letters: cut behind runs of ASCII letters too, for rules that end there
    whatever comes next, without special strings."""
    buf = flat.buf
    mark = np.zeros(len(buf) + 1, bool)
    if len(buf):
        before = np.zeros(len(buf), np.uint16)
        before[1:] = buf[:-1]
        pair = before.copy()
        pair[2:] |= buf[:-2].astype(np.uint16) << 8
        mark[:-1] = _WHITE[buf] & (_PLAIN[before] | ((before >= 128) & ~_WIDE_PAIR[pair]))
        if letters:
            mark[1:-1] |= _LETTER[buf[:-1]] & ~_LETTER[buf[1:]] & (buf[1:] < 128)
        mark[flat.start] = True
        mark[flat.end] = False
    starts = np.flatnonzero(mark)
    per_text = np.diff(np.searchsorted(starts, flat.offsets))
    ends = np.append(starts[1:], 0)
    last = np.cumsum(per_text)[per_text > 0] - 1
    ends[last] = flat.end[per_text > 0]
    return starts, ends, per_text


#: Bits and limit of a cache for tasks that read many distinct words and have the memory: about 150 MB a worker once it is full.
WIDE = (21, 1 << 24)


class Bpe:
    def __init__(self, path: str, bits: int = BITS, limit: int = POOL):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.cache = SpanCache(self._encode, bits, limit)

    def _encode(self, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        texts = [raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        found = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        n = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for ids in found for i in ids), np.int32, int(n.sum())), n

    def _looked_up(self, flat: Flat) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        starts, ends, per_text = chunks(flat)
        return *self.cache.look_up(flat.buf, Spans(flat.buf), starts, ends), per_text

    def counts(self, flat: Flat) -> np.ndarray:
        """Tokens of each text."""
        _, size, per_text = self._looked_up(flat)
        total = np.concatenate([[0], np.cumsum(size)])
        ends = np.cumsum(per_text)
        return total[ends] - total[ends - per_text]

    def ids(self, flat: Flat) -> tuple[np.ndarray, np.ndarray]:
        """All ids and the number of each text."""
        at, size, per_text = self._looked_up(flat)
        total = np.concatenate([[0], np.cumsum(size)])
        ends = np.cumsum(per_text)
        return self.cache.gather(at, size), total[ends] - total[ends - per_text]


@cache
def loaded(path: str, bits: int = BITS, limit: int = POOL) -> Bpe:
    """One tokenizer for each Python worker and size of cache."""
    return Bpe(path, bits, limit)


@cache
def version(path: str) -> str:
    """Digest of a tokenizer's file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()
