"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

Words (a run of word marks and what follows it) are flat symbol arrays. In each round every word finds the best
rank among its neighbour pairs by a segmented minimum and merges all its leftmost, non-overlapping places of that
rank at once; where a merge would make a neighbour pair of the same or a better rank, which the library would take
next, the round ends for that word. Finished words leave the arrays. A word still not finished after many rounds
(thousands of symbols in one word) goes on alone, in the same rounds, with its places filed by rank.

Defined results: null and empty texts encode to the begin and end ids alone and decode to ''; characters that the
model lacks become byte pieces; very long words are encoded whole; repeated rows stay; an empty table gives no rows; columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .spans import SpanCache
from .text import Flat, Schema, Spans, lists, map_slices, type_of

MARK = "▁"
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
_NONE = np.int64(1) << 40  # rank of a pair that does not merge
_ROUNDS = 150


def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        c = b[i]
        i += 1
        value |= (c & 127) << shift
        if c < 128:
            return value, i
        shift += 7


def _fields(b: bytes):
    """Field numbers and values of a protocol buffer message."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        if key & 7 == 0:
            value, i = _varint(b, i)
        elif key & 7 == 2:
            n, i = _varint(b, i)
            value, i = b[i : i + n], i + n
        else:
            n = 4 if key & 7 == 5 else 8
            value, i = b[i : i + n], i + n
        yield key >> 3, value


class SentencePieceBpe:
    def __init__(self, path: str):
        pieces: list[tuple[str, float, int]] = []
        trainer: dict[int, object] = {}
        normalizer: dict[int, object] = {}
        with open(path, "rb") as f:
            for k, v in _fields(f.read()):
                if k == 1:
                    x = dict(_fields(v))
                    pieces.append((x[1].decode(), struct.unpack("<f", x[2])[0] if 2 in x else 0.0, x.get(3, _NORMAL)))
                elif k == 2:
                    trainer = dict(_fields(v))
                elif k == 3:
                    normalizer = dict(_fields(v))
        kinds = {t for _, _, t in pieces}
        if trainer.get(3) != 2 or normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(3, 1) or not normalizer.get(5, 1) or kinds & {_USER, _UNUSED}:
            raise ValueError("only BPE models with the identity normalizer, a dummy prefix and no user-defined pieces are supported")
        self.begin, self.end = trainer.get(41, 1), trainer.get(42, 2)
        self.unknown = trainer.get(40, 0)
        self.bytes = np.full(256, self.unknown, np.int32)
        for i, (p, _, t) in enumerate(pieces):
            if t == _BYTE:
                self.bytes[int(p[3:5], 16)] = i
        normal = {p: i for i, (p, _, t) in enumerate(pieces) if t == _NORMAL}
        if any(MARK in p.lstrip(MARK) for p in normal):
            raise ValueError("pieces that hold a word mark inside are not supported")
        order = {s: r for r, s in enumerate(sorted({pieces[i][1] for i in normal.values()}, reverse=True))}
        # symbols: ids of the vocabulary, then characters that only longer pieces hold, then all other characters
        symbols = dict(normal)
        for p in list(normal):
            for c in p:
                symbols.setdefault(c, len(pieces) + len(symbols))
        self.limit = max(symbols.values()) + 1
        self.of_char = {ord(c): i for c, i in symbols.items() if len(c) == 1}
        table: dict[int, tuple[int, int]] = {}
        for p, i in normal.items():
            for k in range(1, len(p)):
                a, b = symbols.get(p[:k]), symbols.get(p[k:])
                if a is not None and b is not None:
                    table[a << 32 | b] = (order[pieces[i][1]], i)
        self.pair_keys = np.array(sorted(table), np.int64)
        self.pair_rank = np.array([table[k][0] for k in self.pair_keys.tolist()], np.int64)
        self.pair_made = np.array([table[k][1] for k in self.pair_keys.tolist()], np.int64)
        self._build_slots()
        surface = [b"" if t == _CONTROL else " ⁇ ".encode() if t == _UNKNOWN else bytes([int(p[3:5], 16)]) if t == _BYTE else p.replace(MARK, " ").encode() for p, _, t in pieces]
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_n = np.array([len(x) for x in surface], np.int64)
        self.surface_at = np.cumsum(self.surface_n) - self.surface_n
        chars = np.array(sorted(self.of_char), np.int64)
        self.chars, self.char_ids = chars, np.array([self.of_char[c] for c in chars.tolist()], np.int64)
        self.cache = SpanCache(self._encode_spans)

    def _build_slots(self) -> None:
        """An open hash table of pairs, so that a round looks up its pairs in a few gathers."""
        bits = int(2 * len(self.pair_keys)).bit_length() + 1
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.slots = np.full(1 << bits, -1, np.int64)
        todo, slot = np.arange(len(self.pair_keys)), self._slot(self.pair_keys)
        self.probes = 0
        while len(todo):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = todo[free]
            left = self.slots[slot] != todo
            todo, slot = todo[left], (slot[left] + 1) & self.mask
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Index into the pair table, -1 where there is no such pair."""
        keys = (a << 32) | b
        slot, out = self._slot(keys), np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for _ in range(self.probes):
            found = self.slots[slot]
            hit = (found >= 0) & (self.pair_keys[found] == keys[todo])
            out[todo[hit]] = found[hit]
            on = (found >= 0) & ~hit
            todo, slot = todo[on], (slot[on] + 1) & self.mask
            if not len(todo):
                break
        return out

    def _neighbours(self, sym: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of the pair that begins at each symbol; first marks the first symbol of a word."""
        pair = np.full(len(sym), -1, np.int64)
        inside = np.flatnonzero(~first[1:])
        pair[inside] = self._pairs(sym[inside], sym[inside + 1])
        return np.where(pair >= 0, self.pair_rank[pair], _NONE), self.pair_made[pair]

    def merge(self, sym: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge the symbols of words until no pair remains; every word has a symbol."""
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        which = np.arange(len(counts))
        starts = np.cumsum(counts) - counts
        first = np.zeros(len(sym), bool)
        first[starts] = True
        rank, made = self._neighbours(sym, first)
        for turn in range(_ROUNDS + 1):
            best = np.minimum.reduceat(rank, starts) if len(starts) else rank
            over = best == _NONE
            if turn == _ROUNDS:
                rest = [self._by_rank(sym[s : s + n]) for s, n in zip(starts.tolist(), counts.tolist(), strict=True)]
                if rest:
                    done.append((which, np.array([len(x) for x in rest], np.int64), np.concatenate(rest)))
                break
            if over.any():
                out = np.repeat(over, counts)
                done.append((which[over], counts[over], sym[out]))
                sym, rank, made, first = sym[~out], rank[~out], made[~out], first[~out]
                which, counts, best = which[~over], counts[~over], best[~over]
                starts = np.cumsum(counts) - counts
            if not len(counts):
                break
            word = np.repeat(np.arange(len(counts)), counts)
            hit = rank == best[word]
            places = np.flatnonzero(hit)
            # of places that overlap (aaa) every second one counts, from the left
            run = np.ones(len(places), bool)
            run[1:] = places[1:] != places[:-1] + 1
            head = np.maximum.accumulate(np.where(run, np.arange(len(places)), 0))
            places = places[(np.arange(len(places)) - head) % 2 == 0]
            # what a merge makes with the symbol right of it, before that one is merged too
            beside = places[(places + 2 < len(sym))]
            beside = beside[~first[beside + 2]]
            pair = self._pairs(made[beside], sym[beside + 2])
            early_before = np.zeros(len(counts), bool)
            early_before[word[beside[(pair >= 0) & (self.pair_rank[pair] <= best[word[beside]])]]] = True
            while True:
                new, gone = sym.copy(), np.zeros(len(sym), bool)
                new[places] = made[places]
                gone[places + 1] = True
                keep = ~gone
                new_sym, new_first, new_word = new[keep], first[keep], word[keep]
                # only pairs beside a merge change
                moved = (np.cumsum(keep) - 1)[places]
                new_rank, new_made = rank[keep], made[keep]
                touched = np.unique(np.concatenate([moved, moved[moved > 0] - 1]))
                last = np.ones(len(new_sym), bool)
                last[:-1] = new_first[1:]
                tail = touched[last[touched]]
                new_rank[tail] = _NONE
                touched = touched[~last[touched]]
                pair = self._pairs(new_sym[touched], new_sym[touched + 1])
                new_rank[touched] = np.where(pair >= 0, self.pair_rank[pair], _NONE)
                new_made[touched] = self.pair_made[pair]
                early = early_before.copy()
                early[new_word[touched[new_rank[touched] <= best[new_word[touched]]]]] = True
                of_place = word[places]
                lead = np.ones(len(places), bool)
                lead[1:] = of_place[1:] != of_place[:-1]
                cut = early[of_place] & ~lead
                if not cut.any():
                    break
                places = places[~cut]
            sym, rank, made, first = new_sym, new_rank, new_made, new_first
            counts = np.bincount(new_word, minlength=len(counts))
            starts = np.cumsum(counts) - counts
        if not done:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        order = np.concatenate([w for w, _, _ in done])
        n = np.concatenate([c for _, c, _ in done])
        flat = np.concatenate([s for _, _, s in done])
        back = np.argsort(order)
        at = (np.cumsum(n) - n)[back]
        n = n[back]
        return flat[np.repeat(at - (np.cumsum(n) - n), n) + np.arange(len(flat))], n

    def _by_rank(self, sym: np.ndarray) -> np.ndarray:
        """The same rounds for one long word. Places wait under the rank of their pair, so a round looks at its own merges alone."""
        sym, n = sym.copy(), len(sym)
        left, right = np.arange(-1, n - 1), np.arange(1, n + 1)
        right[-1] = -1
        rank, made, alive = np.full(n, _NONE), np.zeros(n, np.int64), np.ones(n, bool)
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def wait(r: int, places: np.ndarray) -> None:
            if r not in waiting:
                waiting[r] = []
                heapq.heappush(ranks, r)
            waiting[r].append(places)

        def rank_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            k = self._pairs(a, b)
            return np.where(k >= 0, self.pair_rank[k], _NONE)

        def offer(places: np.ndarray) -> None:
            rank[places] = _NONE
            places = places[right[places] >= 0]
            k = self._pairs(sym[places], sym[right[places]])
            places, k = places[k >= 0], k[k >= 0]
            rank[places], made[places] = self.pair_rank[k], self.pair_made[k]
            order = np.argsort(rank[places], kind="stable")
            places = places[order]
            cut = np.flatnonzero(np.diff(rank[places])) + 1
            for part in np.split(places, cut) if len(places) else []:
                wait(int(rank[part[0]]), part)

        offer(np.arange(n))
        while ranks:
            r = heapq.heappop(ranks)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[rank[at] == r]
            if not len(at):
                continue
            # of places that overlap (aaa) every second one counts, from the left
            run = np.ones(len(at), bool)
            run[1:] = right[at[:-1]] != at[1:]
            at = at[(np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))) % 2 == 0]
            # a merge that makes a pair of this rank or a better one is the last of its round
            before, after = left[at], right[right[at]]
            beside = np.where(before >= 0, sym[before], 0)
            chained = np.flatnonzero(right[at[:-1]] == before[1:]) + 1
            beside[chained] = made[at[chained - 1]]
            early = np.minimum(np.where(before >= 0, rank_of(beside, made[at]), _NONE), np.where(after >= 0, rank_of(made[at], np.where(after >= 0, sym[after], 0)), _NONE)) <= r
            if early.any():
                stop = int(np.argmax(early)) + 1
                if stop < len(at):
                    wait(r, at[stop:])
                at = at[:stop]
            gone = right[at]
            after = right[gone]
            sym[at], rank[gone], alive[gone], right[at] = made[at], _NONE, False, after
            left[after[after >= 0]] = at[after >= 0]
            offer(np.unique(np.concatenate([at, left[at][left[at] >= 0]])))
        return sym[alive]

    def _encode_spans(self, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        text = b"\n".join([raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
        points = np.frombuffer(text.decode().encode("utf-32-le"), np.uint32).astype(np.int64)
        lens = ends - starts  # bytes; code points of each word follow from the first bytes
        is_first = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
        total = np.concatenate([[0], np.cumsum(is_first)])
        at = np.cumsum(lens + 1) - (lens + 1)
        counts = total[at + lens] - total[at]
        gaps = (np.cumsum(counts) + np.arange(len(counts)))[:-1]  # the newlines put between words
        points = np.delete(points, gaps)
        points = np.where(points == 32, ord(MARK), points)
        k = np.minimum(np.searchsorted(self.chars, points), len(self.chars) - 1)
        sym = np.where(self.chars[k] == points, self.char_ids[k], self.limit + points)
        out, n = self.merge(sym, counts)
        lost = out >= len(self.surface_n)
        if lost.any():  # byte pieces for characters without a piece
            chars = {v: c for c, v in self.of_char.items() if v >= len(self.surface_n)}
            width = np.ones(len(out), np.int64)
            coded = [chr(chars.get(int(s), int(s) - self.limit)).encode() for s in out[lost]]
            width[lost] = [len(c) for c in coded]
            wide = np.repeat(np.where(lost, -1, out), width)
            wide[wide < 0] = self.bytes[np.frombuffer(b"".join(coded), np.uint8)]
            word = np.repeat(np.arange(len(n)), n)
            n = np.bincount(word, weights=width, minlength=len(n)).astype(np.int64)
            out = wide
        return out.astype(np.int32), n

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, begin and end ids included, and the number of each text."""
        flat = Flat(texts, before=b" ")
        buf = flat.buf
        mark = np.zeros(len(buf) + 1, bool)
        if len(buf):
            before = np.zeros(len(buf), np.uint8)
            before[1:] = buf[:-1]
            # a word begins at a space after anything but a space or what may end a word mark
            mark[:-1] = (buf == 32) & (before != 32) & (before != 0x81)
            mark[flat.end] = False
            mark[flat.start] = flat.end - flat.start > 1
        starts = np.flatnonzero(mark)
        per_text = np.diff(np.searchsorted(starts, flat.offsets))
        ends = np.append(starts[1:], 0)
        ends[np.cumsum(per_text)[per_text > 0] - 1] = flat.end[per_text > 0]
        at, size = self.cache.look_up(buf, Spans(buf), starts, ends)
        ids = self.cache.gather(at, size)
        total = np.concatenate([[0], np.cumsum(size)])
        stop = np.cumsum(per_text)
        n = total[stop] - total[stop - per_text]
        out = np.full(len(ids) + 2 * len(n), self.end, np.int32)
        head = np.cumsum(n + 2) - (n + 2)
        out[np.arange(len(ids)) + np.repeat(head - (np.cumsum(n) - n), n) + 1] = ids
        out[head] = self.begin
        return out, n + 2

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """Texts of lists of ids."""
        size = self.surface_n[ids]
        data = self.surface[np.repeat(self.surface_at[ids] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        total = np.concatenate([[0], np.cumsum(size)])
        stop = np.cumsum(counts)
        a, b = total[stop - counts], total[stop]
        raw = data.tobytes()
        cut = [raw[x:y].decode("utf-8", "replace") for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        return pa.array([t.removeprefix(" ") for t in cut], pa.string())


@cache
def loaded(path: str) -> SentencePieceBpe:
    """One model for each Python worker."""
    return SentencePieceBpe(path)


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, ids array<int>). No shuffle."""

    def per_slice(part, flat):
        ids, n = loaded(model_path).encode(part.column(text_col))
        return {id_col: part.column(id_col), "ids": lists(ids, n, pa.int32())}

    return map_slices(docs, [id_col, text_col], text_col, per_slice, Schema(**{id_col: type_of(docs, id_col), "ids": "array<int>"}))


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Rows (id, text)."""
    schema = Schema(**{id_col: type_of(encoded, id_col), "text": "string"})

    def run(batches):
        for batch in batches:
            column = batch.column(ids_col)
            n = np.diff(column.offsets.to_numpy()).astype(np.int64)
            yield schema.batch({id_col: batch.column(id_col), "text": loaded(model_path).decode(column.flatten().to_numpy(), n)})

    return encoded.select(id_col, ids_col).mapInArrow(run, schema.spark)


def digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_tokens, ids_sha256, decoded_sha256): encoding and decoding in one pass, without the ids leaving the task."""

    def per_slice(part, flat):
        model = loaded(model_path)
        ids, n = model.encode(part.column(text_col))
        raw, stop = ids.astype("<u4").tobytes(), (4 * np.cumsum(n)).tolist()
        return {
            id_col: part.column(id_col), "n_tokens": n,
            "ids_sha256": [hashlib.sha256(raw[b - 4 * k : b]).hexdigest() for b, k in zip(stop, n.tolist(), strict=True)],
            "decoded_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in model.decode(ids, n).to_pylist()],
        }

    return map_slices(docs, [id_col, text_col], text_col, per_slice, Schema(**{id_col: type_of(docs, id_col), "n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}))
