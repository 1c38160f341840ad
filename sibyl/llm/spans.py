"""Encoding of byte ranges through a bounded cache: equal ranges are encoded once, the rest is gathered.

The cache is direct-mapped on 64-bit hashes, so its size is fixed; an entry that is pushed out is encoded again
when it is met again. It keeps the bytes of its entries and compares them on every hit, so it lives in a Python
worker and is only a matter of speed.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .text import Spans

BITS, POOL = 19, 1 << 22


def _room(pool: np.ndarray, used: int, more: int, least: int) -> np.ndarray:
    return pool if used + more <= len(pool) else np.concatenate([pool[:used], np.zeros(max(least, more), pool.dtype)])


class SpanCache:
    def __init__(self, encode: Callable[[bytes, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], bits: int = BITS, limit: int = POOL):
        """encode(buffer, starts, ends) -> flat int32 ids and the number of ids of each range. 2^bits entries, and limit ids and bytes."""
        self.encode, self.bits, self.limit = encode, bits, limit
        self.clear()

    def clear(self) -> None:
        slots = 1 << self.bits
        self.keys = np.zeros(slots, np.uint64)
        self.at, self.text_at = np.zeros(slots, np.int64), np.zeros(slots, np.int64)
        self.size, self.text_size = np.zeros(slots, np.int32), np.zeros(slots, np.int32)
        self.pool, self.used = np.zeros(self.limit, np.int32), 0
        self.text, self.text_used = np.zeros(self.limit, np.uint8), 0
        self.held: Spans | None = None

    def _hits(self, spans: Spans, h: np.ndarray, slot: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        hit = self.keys[slot] == h
        if self.held is None:
            self.held = Spans(self.text[: self.text_used])
        some = np.flatnonzero(hit)
        at = self.text_at[slot[some]]
        hit[some] = spans.same(starts[some], ends[some], self.held, at, at + self.text_size[slot[some]])
        return hit

    def look_up(self, buf: np.ndarray, spans: Spans, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the pool and number of ids of every range; spans: those of buf."""
        h = spans.hash(starts, ends) | np.uint64(1)  # 0 marks a free slot
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        at, size = self.at[slot], self.size[slot].astype(np.int64)
        missed = np.flatnonzero(~self._hits(spans, h, slot, starts, ends))
        if len(missed):
            back, first = spans.classes(h[missed], starts[missed], ends[missed])
            new = missed[first]
            ids, n = self.encode(buf.tobytes(), starts[new], ends[new])
            length = ends[new] - starts[new]
            total = int(length.sum())
            if max(self.used + len(ids), self.text_used + total) > self.limit and self.used:
                self.clear()
                return self.look_up(buf, spans, starts, ends)
            self.pool, self.text = _room(self.pool, self.used, len(ids), self.limit), _room(self.text, self.text_used, total, self.limit)
            self.pool[self.used : self.used + len(ids)] = ids
            place = self.used + np.cumsum(n) - n
            text_place = self.text_used + np.cumsum(length) - length
            self.text[self.text_used : self.text_used + total] = buf[np.repeat(starts[new] - (text_place - self.text_used), length) + np.arange(total)]
            self.used, self.text_used, self.held = self.used + len(ids), self.text_used + total, None
            # of new ranges that share a slot one is kept; the arrays agree, as numpy writes them in the same order
            own = slot[new]
            self.keys[own], self.at[own], self.size[own], self.text_at[own], self.text_size[own] = h[new], place, n, text_place, length
            at[missed], size[missed] = place[back], n[back]
        return at, size

    def gather(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The ids of the ranges, one after the other."""
        total = int(size.sum())
        return self.pool[np.repeat(at - (np.cumsum(size) - size), size) + np.arange(total)]
