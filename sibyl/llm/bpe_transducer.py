"""Byte-level BPE by rank files: encoding through a lazily determinised finite-state transducer, streaming decoding.

Merging always takes the pair of the least rank, the leftmost one of equals. A list of tokens is then the encoding
of a piece if and only if each two neighbours are the encoding of their joined bytes: the first merge across a
border would come at the same point with or without the rest of the piece. So encodings are the paths of an automaton that
spells tokens through a trie and steps from one token to the next where the two are such neighbours. It is not
deterministic, as it guesses where tokens end, but every prefix has exactly one path that ends with it.

The transducer determinises it while texts are read. A state holds what all live paths share last (the token
before), and for every live path the tokens that it has beyond those and its place in the trie. A step follows one byte, and
emits the tokens that all live paths now agree on: a path lives no longer than the longest token, so output waits
for a bounded number of bytes. A piece that is a token as a whole is that token, whether merges reach it or not; such a
token is one more path. States and arcs stay until `STATES` of them are held and are then built anew, which
bounds memory and changes no result.

States pay if they are met again. Most pieces are words met once, for which every third byte or so made a new state,
so pieces of up to `SIDE_BY_SIDE` bytes go through the same automaton as it is, all of a slice at a time: a column of
their bytes moves all live paths on, and the one token that may end there is noted. What is noted at the end of a piece leads back to
its beginning. Longer pieces go through the determinised states.

Defined results: null and empty texts encode to no ids and decode to nothing; pieces of any length go through the same
arcs; repeated rows stay; an empty table gives no rows; columns other than id and text are not read. Decoded bytes
that are no UTF-8 come out as U+FFFD, one for each maximal part of a character, as Python's decoder has it.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .bpe import chunks
from .spans import SpanCache
from .text import Flat, Schema, Spans, lists, map_slices, type_of

STATES = 150_000
#: Bytes of the longest piece that is read together with others.
SIDE_BY_SIDE = 256
#: Bytes of pieces that are read at a time, so that memory does not grow with a long text.
BLOCK = 1 << 21
_PAIR_BITS = 20
_NEVER = 1 << 60


class _Node:
    """A place in the trie of tokens."""

    __slots__ = ("next", "token")

    def __init__(self):
        self.next: dict[int, _Node] = {}
        self.token = -1


class _State:
    """last: the token before, -1 at the start of a piece. Of every live path: the tokens beyond it, and the place in the trie; the
    last path is the one whose tokens are complete here. whole: place in the trie of the piece so far, None if it cannot be one
    of the tokens that merges do not reach."""

    __slots__ = ("last", "tokens", "nodes", "whole", "arcs", "final")

    def __init__(self, last: int, tokens: tuple, nodes: tuple, whole: _Node | None):
        self.last, self.tokens, self.nodes, self.whole = last, tokens, nodes, whole
        self.arcs: dict[int, tuple[_State, tuple[int, ...]]] = {}
        #: Tokens still to emit if the piece ends here.
        self.final = tokens[-1]
        if whole is not None and whole.token >= 0:
            self.final = (whole.token,)


def _shared(lists: list[tuple[int, ...]]) -> int:
    """Length of the prefix that all have."""
    first = lists[0]
    n = len(first)
    for other in lists:
        k = 0
        for a, b in zip(first[:n], other, strict=False):
            if a != b:
                break
            k += 1
        n = k
        if not n:
            break
    return n


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = {i: b for b, i in ranks.items()}
        self.root = _Node()
        for b, i in ranks.items():
            node = self.root
            for c in b:
                node = node.next.setdefault(c, _Node())
            node.token = i
        if any(c not in self.root.next or self.root.next[c].token < 0 for c in range(256)):
            raise ValueError("every byte has to be a token")
        self.traces: dict[int, tuple[bool, list[tuple[int, bytes, bytes]]]] = {}
        #: Whether a token at or below a place in the trie is not reached by merges, so that only whole pieces are that token.
        self.odd: dict[int, bool] = {}
        self.pairs: dict[int, bool] = {}
        self.forget()
        self._lay_out()

    def forget(self) -> None:
        """Drop all states; they come back when they are met."""
        self.held: dict[tuple, _State] = {}
        if len(self.pairs) > 4 * STATES:
            self.pairs.clear()
        self.start = _State(-1, ((),), (self.root,), self.root if self._odd(self.root) else None)

    def _lay_out(self) -> None:
        """The trie as arrays; places that go on have the least numbers, the root has 0."""
        inner, leaves = [self.root], []
        for node in inner:  # grows while it is read
            for to in node.next.values():
                (inner if to.next else leaves).append(to)
        number = {id(node): i for i, node in enumerate(inner + leaves)}
        steps = [(i << 8 | c, number[id(to)]) for i, node in enumerate(inner) for c, to in node.next.items()]
        self.inner = len(inner)
        self.step = np.full(self.inner << 8, -1, np.int32)
        self.step[[a for a, _ in steps]] = [b for _, b in steps]
        self.token_at = np.array([node.token for node in inner + leaves], np.int32)
        self.length = np.zeros(max(self.bytes) + 1, np.int64)
        self.length[list(self.bytes)] = [len(b) for b in self.bytes.values()]
        self.longest = int(self.length.max())
        #: Neighbours that were judged, direct-mapped: (last + 1, token) and the verdict in the lowest bit.
        self.judged = np.full(1 << _PAIR_BITS, -1, np.int64)

    def _trace(self, token: int) -> tuple[bool, list[tuple[int, bytes, bytes]]]:
        """Whether merges reach a token, and for each merge of its bytes its rank, with the leftmost and the rightmost part before it."""
        found = self.traces.get(token)
        if found is None:
            data = self.bytes[token]
            parts, steps = [data[i : i + 1] for i in range(len(data))], []
            while len(parts) > 1:
                rank, i = min((self.ranks.get(a + b, _NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
                if rank == _NEVER:
                    break
                steps.append((rank, parts[0], parts[-1]))
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            steps.append((_NEVER, parts[0], parts[-1]))
            found = self.traces[token] = len(parts) == 1, steps
        return found

    def reached(self, token: int) -> bool:
        return self._trace(token)[0]

    def follows(self, last: int, token: int) -> bool:
        """Whether token may come after last (-1: may begin a piece)."""
        key = last << 32 | token
        found = self.pairs.get(key)
        if found is None:
            found = self.pairs[key] = self._proved(last, token)
        return found

    def _proved(self, last: int, token: int) -> bool:
        """Whether the merges of both, in the order of their ranks, meet no earlier merge across the border."""
        ok, after = self._trace(token)
        if last < 0 or not ok:
            return ok
        ok, before = self._trace(last)
        i = j = 0
        while ok:
            (a, _, right), (b, left, _) = before[i], after[j]
            across = self.ranks.get(right + left, _NEVER)
            if across < a and across <= b:
                return False
            if a == b == _NEVER:
                return True
            if a <= b:
                i += 1
            else:
                j += 1
        return False

    def _arc(self, state: _State, c: int) -> tuple[_State, tuple[int, ...]]:
        if len(self.held) > STATES:
            for s in self.held.values():
                s.arcs.clear()
            self.forget()
        held, nodes, ends = [], [], []
        for tokens, node in zip(state.tokens, state.nodes, strict=True):
            node = node.next.get(c)
            if node is not None:
                if node.next:
                    held.append(tokens)
                    nodes.append(node)
                if node.token >= 0:
                    ends.append((tokens, node.token))
        # one of them is right, so the last one needs no proof
        tokens, token = ends[-1] if len(ends) == 1 else next((e for e in ends[:-1] if self.follows(e[0][-1] if e[0] else state.last, e[1])), ends[-1])
        ended = (*tokens, token)
        held.append(ended)
        nodes.append(self.root)  # the next token begins here
        whole = None if state.whole is None else state.whole.next.get(c)
        if whole is not None and not self._odd(whole):
            whole = None
        # nothing is emitted while the piece may still be one token that merges do not reach
        n = 0 if whole is not None or not held[0] else _shared(held)
        out, last = (ended[:n], ended[n - 1]) if n else ((), state.last)
        key = (last, tuple([t[n:] for t in held]) if n else tuple(held), tuple(nodes), whole)
        to = self.held.get(key)
        if to is None:
            to = self.held[key] = _State(*key)
        state.arcs[c] = arc = (to, out)
        return arc

    def _odd(self, node: _Node) -> bool:
        found = self.odd.get(id(node))
        if found is None:
            found = self.odd[id(node)] = (node.token >= 0 and not self.reached(node.token)) or any(map(self._odd, node.next.values()))
        return found

    def encode(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        ids: list[int] = []
        state = self.start
        for c in piece:
            arc = state.arcs.get(c) or self._arc(state, c)
            state = arc[0]
            if arc[1]:
                ids += arc[1]
        return ids + list(state.final)

    def _follow(self, last: np.ndarray, token: np.ndarray) -> np.ndarray:
        """`follows` of many pairs."""
        key = (last.astype(np.int64) + 1) << 31 | token
        slot = self._slot(key)
        known = self.judged[slot]
        out = (known & 1).astype(bool)
        missed = np.flatnonzero(known >> 1 != key)
        if len(missed):
            new, back = np.unique(key[missed], return_inverse=True)
            proved = np.array([self._proved((k >> 31) - 1, k & 0x7FFFFFFF) for k in new.tolist()], bool)
            out[missed] = proved[back]
            self.judged[self._slot(new)] = new << 1 | proved
        return out

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _PAIR_BITS)).astype(np.int64)

    def encode_all(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, one after the other, and their number for each piece."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        total = np.cumsum(size)
        cuts = np.searchsorted(total, np.arange(BLOCK, int(size.sum()), BLOCK)) + 1
        bounds = np.unique(np.concatenate([[0], cuts, [len(pieces)]])).tolist()
        done = [self._block(pieces[a:b], size[a:b]) for a, b in pairwise(bounds)]
        ids, counts = zip(*done, strict=True) if done else ([np.zeros(0, np.int32)], [size])
        return np.concatenate(ids), np.concatenate(counts)

    def _block(self, pieces: list[bytes], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = size <= SIDE_BY_SIDE
        if near.all():
            return self._side_by_side(b"".join(pieces), size)
        longer = [np.array(self.encode(pieces[i]), np.int32) for i in np.flatnonzero(~near).tolist()]
        ids, n = self._side_by_side(b"".join([pieces[i] for i in np.flatnonzero(near).tolist()]), size[near])
        counts = np.zeros(len(pieces), np.int64)
        counts[near], counts[~near] = n, list(map(len, longer))
        own = np.repeat(near, counts)
        out = np.zeros(len(own), np.int32)
        out[own], out[~own] = ids, np.concatenate(longer)
        return out, counts

    def _side_by_side(self, raw: bytes, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and numbers of ids without determinised states, for pieces that follow each other in raw; one step for each column of bytes."""
        if not raw:
            return np.zeros(0, np.int32), np.zeros(len(size), np.int64)
        data, first = np.frombuffer(raw, np.uint8), np.cumsum(size) - size
        order = np.argsort(-size, kind="stable")  # pieces that still go on come first in every column
        by, begin = size[order], first[order]
        active = np.searchsorted(-by, -np.arange(by[0] + 1), "left")
        column = np.cumsum(active) - active
        ends = np.zeros(int(active.sum()), np.int32)  # the token that ends at a byte, column by column
        piece, node, last = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)  # of every live path
        before = np.full(active[0], -1, np.int32)
        for k, n in enumerate(active[:-1].tolist()):
            piece, node, last = np.concatenate([piece, np.arange(n)]), np.concatenate([node, np.zeros(n, np.int64)]), np.concatenate([last, before[:n]])
            node = self.step[node << 8 | data[begin[:n] + k][piece]]
            live = np.flatnonzero(node >= 0)
            piece, node, last = piece[live], node[live].astype(np.int64), last[live]
            token = self.token_at[node]
            ended = np.flatnonzero(token >= 0)
            of, after, token = piece[ended], last[ended], token[ended]
            # one of them is right, so one alone needs no proof
            right = np.bincount(of, minlength=n)[of] == 1
            several = np.flatnonzero(~right)
            right[several] = self._follow(after[several], token[several])
            here = ends[column[k] : column[k] + n]
            here[of[right]] = token[right]
            if k < self.longest:
                whole = np.flatnonzero((after < 0) & (by[of] == k + 1))
                here[of[whole]] = token[whole]
            on = np.flatnonzero((node < self.inner) & (piece < active[k + 1]))
            piece, node, last, before = piece[on], node[on], last[on], here
        used = np.zeros(len(ends), bool)
        piece, place = np.arange(active[0]), by[: active[0]] - 1
        while len(piece):
            at = column[place] + piece
            used[at] = True
            place = place - self.length[ends[at]]
            on = place >= 0
            piece, place = piece[on], place[on]
        rank = np.empty(len(size), np.int64)
        rank[order] = np.arange(len(size))
        at = column[np.arange(len(data)) - np.repeat(first, size)] + np.repeat(rank, size)
        shown = used[at]
        total = np.concatenate([[0], np.cumsum(shown)])
        return ends[at[shown]], total[first + size] - total[first]


def _utf8_leads() -> dict[int, tuple[int, int, int]]:
    """For every first byte of a longer character: bytes still to come, and the range of the next one."""
    leads = {b: (1, 0x80, 0xBF) for b in range(0xC2, 0xE0)} | {b: (2, 0x80, 0xBF) for b in range(0xE0, 0xF0)} | {b: (3, 0x80, 0xBF) for b in range(0xF0, 0xF5)}
    return leads | {0xE0: (2, 0xA0, 0xBF), 0xED: (2, 0x80, 0x9F), 0xF0: (3, 0x90, 0xBF), 0xF4: (3, 0x80, 0x8F)}


_LEADS = _utf8_leads()


class Utf8Machine:
    """Bytes in, whole characters out. Between calls it holds the beginning of one character, three bytes at most."""

    def __init__(self):
        self.held = b""

    def feed(self, data: bytes) -> str:
        data = self.held + data
        cut = len(data)
        for i in range(max(0, cut - 3), cut):  # where the last character begins, if it may go on
            if data[i] in _LEADS and self._open(data[i:]):
                cut = i
                break
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    @staticmethod
    def _open(tail: bytes) -> bool:
        """Whether a tail is the beginning of one character and no whole one."""
        left, low, high = _LEADS[tail[0]]
        for c in tail[1:]:
            if not low <= c <= high:
                return False
            left, low, high = left - 1, 0x80, 0xBF
        return left > 0

    def end(self) -> str:
        out, self.held = self.held.decode("utf-8", "replace"), b""
        return out


class RankedBpe:
    """A rank file: base64 of a token's bytes and its rank on each line. pattern: splits texts into pieces; it may not look back, has to
    end a piece behind a run of ASCII letters, and may join white space only with other white space or what follows."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.transducer, self.pattern = Transducer(ranks), regex.compile(pattern)
        self.cache = SpanCache(self._encode, bits=21, limit=1 << 24)
        surface = [self.transducer.bytes.get(i, b"") for i in range(max(ranks.values()) + 1)]
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_n = np.array([len(x) for x in surface], np.int64)
        self.surface_at = np.cumsum(self.surface_n) - self.surface_n
        gc.freeze()  # the trie stays; collections need not go through it

    def _encode(self, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pieces, stop, match = [], [], self.pattern.match
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            chunk = raw[a:b]
            text = chunk.decode()
            m = match(text)
            if m is not None and m.end() == len(text):
                pieces.append(chunk)
            else:
                pieces += [m[0].encode() for m in self.pattern.finditer(text)]
            stop.append(len(pieces))
        ids, n = self.transducer.encode_all(pieces)
        total, stop = np.concatenate([[0], np.cumsum(n)]), np.array(stop)
        return ids, np.diff(total[stop], prepend=0)

    def ids(self, flat: Flat) -> tuple[np.ndarray, np.ndarray]:
        """All ids and the number of each text. No piece reaches over two chunks, so each distinct chunk is encoded once."""
        starts, ends, per_text = chunks(flat, letters=True)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(flat.n, np.int64)
        at, size = self.cache.look_up(flat.buf, Spans(flat.buf), starts, ends)
        total = np.concatenate([[0], np.cumsum(size)])
        stop = np.cumsum(per_text)
        return self.cache.gather(at, size), total[stop] - total[stop - per_text]

    def raw(self, ids: np.ndarray) -> bytes:
        """The bytes of ids; ids that the file lacks have none."""
        size = self.surface_n[ids]
        return self.surface[np.repeat(self.surface_at[ids] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))].tobytes()

    def stream(self, ids: Iterable[np.ndarray]) -> Iterator[str]:
        """Text of a stream of blocks of ids, as far as its characters are whole."""
        machine = Utf8Machine()
        for block in ids:
            yield machine.feed(self.raw(block))
        yield machine.end()

    def decode(self, ids: np.ndarray, block: int = 1 << 16) -> str:
        return "".join(self.stream(ids[i : i + block] for i in range(0, len(ids), block)))


@cache
def loaded(path: str, pattern: str) -> RankedBpe:
    """One tokenizer for each Python worker."""
    return RankedBpe(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, ids array<int>). No shuffle."""

    def per_slice(part, flat):
        ids, n = loaded(path, pattern).ids(flat)
        return {id_col: part.column(id_col), "ids": lists(ids, n, pa.int32())}

    return map_slices(docs, [id_col, text_col], text_col, per_slice, Schema(**{id_col: type_of(docs, id_col), "ids": "array<int>"}))


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Rows (id, text); null ids decode to ''."""
    schema = Schema(**{id_col: type_of(encoded, id_col), "text": "string"})

    def run(batches):
        for batch in batches:
            model = loaded(path, pattern)
            texts = [model.decode(np.array(x.as_py() or [], np.int32)) for x in batch.column(ids_col)]
            yield schema.batch({id_col: batch.column(id_col), "text": texts})

    return encoded.select(id_col, ids_col).mapInArrow(run, schema.spark)


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_tokens, ids_sha256, decoded_sha256): encoding and decoding in one pass, without the ids leaving the task."""

    def per_slice(part, flat):
        model = loaded(path, pattern)
        ids, n = model.ids(flat)
        raw, stop = ids.astype("<u4").tobytes(), np.cumsum(n).tolist()
        return {
            id_col: part.column(id_col), "n_tokens": n,
            "ids_sha256": [hashlib.sha256(raw[4 * (b - k) : 4 * b]).hexdigest() for b, k in zip(stop, n.tolist(), strict=True)],
            "decoded_sha256": [hashlib.sha256(model.decode(ids[b - k : b]).encode()).hexdigest() for b, k in zip(stop, n.tolist(), strict=True)],
        }

    return map_slices(docs, [id_col, text_col], text_col, per_slice, Schema(**{id_col: type_of(docs, id_col), "n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}))
