"""Packing of tokenised documents into sequences, by bin completion over the histogram of lengths.

Every document longer than a sequence is cut into full sequences after a first piece that may be shorter, so what
has to be packed is described by how many pieces there are of each length: at most `capacity` numbers, however
many documents. A branch and bound on that histogram fills sequences around the largest piece left: it lists the
undominated fillings, prunes by the waste that the best plan so far allows, and keeps best-fit plans as
incumbents. Spark counts the lengths, ranks the pieces of each length and gives each its place in the plan.

Defined results: a null text counts as empty and is one piece (the end id alone); rows that repeat are packed each;
an empty table gives no rows; columns other than id and text are not read.
"""

from __future__ import annotations

import collections
import itertools
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe, places
from .spans import BITS, POOL
from .text import Schema, map_slices, type_of

PIECE = {"piece": "int", "start": "long", "length": "long", "ids_crc32": "long"}
#: Pieces that the branch and bound tries in fillings, at most, before it keeps its incumbent (a node counts as NODE of them);
#: fillings that it ranks at a time.
TRIES, NODE, RANKED_TOGETHER = 1_500_000, 500, 100
#: Pieces that one task ranks, about.
RANKED = 8_000

Plan = list[tuple[int, list[tuple[int, int]]]]  # (sequences, [(length, how many)])


def best_fit(counts: np.ndarray, capacity: int) -> Plan:
    """Best-fit decreasing, for all pieces of a length at once."""
    room: dict[int, list[list]] = defaultdict(list)  # space left -> [[sequences, filling]]
    for size in range(len(counts) - 1, 0, -1):
        left = int(counts[size])
        for space in sorted(x for x in room if x >= size):
            while left and room[space]:
                group = room[space][-1]
                each = space // size
                take = min(group[0], left // each)
                if take == 0:
                    each, take = left, 1
                group[0] -= take
                if not group[0]:
                    room[space].pop()
                room[space - each * size].append([take, [*group[1], (size, each)]])
                left -= take * each
            if not left:
                break
        each = capacity // size
        if left // each:
            room[capacity - each * size].append([left // each, [(size, each)]])
        if left % each:
            room[capacity - (left % each) * size].append([1, [(size, left % each)]])
    return [(n, filling) for groups in room.values() for n, filling in groups if n]


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences that any packing needs: by total length, and by pieces too large to share one (Martello and Toth's L2)."""
    size = np.arange(len(counts))
    number, total = np.cumsum(counts[::-1])[::-1], np.cumsum((counts * size)[::-1])[::-1]  # of this size and above
    at = lambda a, k: int(a[k]) if k < len(a) else 0
    best = -(-at(total, 0) // capacity)
    half = capacity // 2
    for k in range(1, half + 1):
        big = at(number, capacity - k + 1)
        middle = at(number, half + 1) - big
        free = middle * capacity - (at(total, half + 1) - at(total, capacity - k + 1))
        small = at(total, k) - at(total, half + 1)
        best = max(best, big + middle + max(0, -(-(small - free) // capacity)))
    return best


def reachable(counts: list[int], space: int, largest: int) -> list[int]:
    """For every k up to largest the sums up to space (bit t: t) that pieces of length k or less can make, each as often as it is there."""
    every, sums, out = (1 << (space + 1)) - 1, 1, [1] * (largest + 1)
    for k in range(1, largest + 1):
        left, part = min(counts[k], space // k), 1
        while left > 0:  # binary parts of a bounded number of pieces
            take = min(part, left)
            sums |= (sums << (take * k)) & every
            left, part = left - take, part * 2
        out[k] = sums
    return out


def waste_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences that any packing needs, from the least waste beside each piece larger than half a sequence (no two share one)."""
    number = [int(x) for x in counts]
    half = capacity // 2
    sums = reachable(number, half, half)
    wasted = 0
    for size in np.flatnonzero(counts[half + 1 :]) + half + 1:
        space = capacity - int(size)
        wasted += number[size] * (space - (sums[space] & ((1 << (space + 1)) - 1)).bit_length() + 1)
    return -(-(int((np.arange(len(counts)) * counts).sum()) + wasted) // capacity)


def fillings(counts: list[int], largest: int, capacity: int, waste: int, budget: list[int], dominated: bool = False) -> Iterator[tuple[int, list[int]]]:
    """All fillings around a piece of the largest length that waste at most `waste`, by increasing waste, each when it is asked for.

    Without `dominated`, those are left out that another one dominates: several of the pieces, or one of them with the space left, could
    be exchanged for one larger piece (or one as large as the several are together), which leaves a packing that is
    no worse. budget[0] falls with every piece tried, by its cost; at 0 the listing ends.
    """
    left, space = list(counts), capacity - largest
    left[largest] -= 1
    top = min(largest, space)
    sums = reachable(left, space, top)

    def parts(target: int, k: int, chosen: list[int], several: int, single: int, free: int, spare: int) -> Iterator[list[int]]:
        """Pieces of length k or less that make target, the longest first. several: sums of two chosen ones or more, single: each chosen
        one alone, free: lengths still there."""
        if target == 0:
            if dominated or not free & ((1 << (spare + 1)) - 1):
                yield list(chosen)
            return
        k = (free & ((2 << min(k, target)) - 1)).bit_length() - 1  # the longest that is there
        while k > 0 and (sums[k] >> target) & 1 and budget[0] > 0:
            if (sums[k] >> (target - k)) & 1:
                budget[0] -= 1
                both = grown = 0
                if not dominated:
                    budget[0] -= spare.bit_length()
                    both = (several | single) << k
                    if spare:
                        grown = both | several | single | 1 << k
                        for turn in range(spare.bit_length()):  # by up to `spare` more
                            grown |= grown << min(1 << turn, spare - (1 << turn) + 1)
                        grown &= ~(single | 1 << k)
                left[k] -= 1
                rest = free if left[k] else free & ~(1 << k)
                if not rest & (both | grown):  # else one piece could stand for others
                    chosen.append(k)
                    yield from parts(target - k, k, chosen, several | both, single | 1 << k, rest, spare)
                    chosen.pop()
                left[k] += 1
            k = (free & ((1 << k) - 1)).bit_length() - 1

    for w in range(min(waste, space) + 1):
        if budget[0] > 0 and (sums[top] >> (space - w)) & 1:
            for chosen in parts(space - w, top, [], 0, 0, sum(1 << k for k in range(1, top + 1) if left[k] > 0), w):
                yield w, chosen


def plan(counts: np.ndarray, capacity: int, tries: int = TRIES) -> tuple[Plan, int]:
    """A packing of counts[length] pieces of each length, and a lower bound of its sequences.

    Depth-first branch and bound from the largest piece down: over undominated fillings, and while a gap is left once more over all
    fillings, those of equal waste ranked by how many pieces there are of their lengths, so that common lengths go first. A filling is
    used at once for all the largest pieces that it can serve, so a plan has no more steps than there are lengths and fillings, whatever
    the counts. Branches end when their waste, or the bound of the rest, leaves no room for a better plan; best-fit plans of the rest
    are incumbents. The first search has a fifth of `tries`; one that has used up its part keeps its incumbent.
    """
    counts = np.asarray(counts, np.int64).copy()
    counts[0] = 0
    total = lambda p: sum(n for n, _ in p)
    best, bound = best_fit(counts, capacity), max(lower_bound(counts, capacity), waste_bound(counts, capacity))
    volume = int((np.arange(len(counts)) * counts).sum())

    def search(dominated: bool, budget: list[int]) -> None:
        nonlocal best
        left, used, wasted = [int(x) for x in counts], 0, 0
        trail: list[tuple[int, int, dict[int, int], int]] = []  # (largest, times, needs, waste of each) of every step
        stack: list[Iterator] = []

        def allowed() -> int:  # a better plan wastes no more than this from here on
            return (total(best) - 1) * capacity - volume - wasted

        def ranked(largest: int) -> Iterator[tuple[int, list[int]]]:
            found = fillings(left, largest, capacity, max(0, min(allowed(), capacity)), budget, dominated)
            if not dominated:
                yield from found
            for _, alike in itertools.groupby(found, key=lambda x: x[0]):
                while chunk := list(itertools.islice(alike, RANKED_TOGETHER)):
                    yield from sorted(chunk, key=lambda x: -sum(left[k] for k in x[1]) / (len(x[1]) + 1))

        def undo() -> None:
            nonlocal used, wasted
            largest, times, needs, waste = trail.pop()
            for k, n in needs.items():
                left[k] += times * n
            used, wasted = used - times, wasted - times * waste

        while budget[0] > 0 and total(best) > bound:
            largest = next((k for k in range(trail[-1][0] if trail else capacity, 0, -1) if left[k]), 0)
            if not largest and used < total(best):
                best = [(t, sorted(needs.items(), reverse=True)) for _, t, needs, _ in trail]
            fits = bool(largest) and allowed() >= 0
            if fits and len(trail) % 64 == 0:
                rest = np.array(left)
                fits = used + lower_bound(rest, capacity) < total(best)
                tail = best_fit(rest, capacity) if fits else []
                if fits and used + total(tail) < total(best):
                    best = [(t, sorted(needs.items(), reverse=True)) for _, t, needs, _ in trail] + tail
            if fits:
                budget[0] -= NODE
                stack.append(ranked(largest))
            elif trail:
                undo()
            while stack:
                found = next(stack[-1], None)
                if found is not None and found[0] <= allowed():
                    break
                stack.pop()
                if trail:
                    undo()
            if not stack:
                return
            waste, chosen = found
            needs = collections.Counter([max((k for k in range(trail[-1][0] if trail else capacity, 0, -1) if left[k])), *chosen])
            times = min(left[k] // n for k, n in needs.items())
            if waste:
                times = min(times, max(1, allowed() // waste))
            for k, n in needs.items():
                left[k] -= times * n
            trail.append((max(needs), times, dict(needs), waste))
            used, wasted = used + times, wasted + times * waste

    for dominated in (False, True):
        search(dominated, [tries * (4 if dominated else 1) // 5])
    return best, bound


class Places:
    """Where the k-th piece of a length goes, from a plan."""

    def __init__(self, packing: Plan, capacity: int):
        slots: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
        first = 0
        for n, filling in packing:
            at = 0
            for size, each in filling:
                slots[size].append((n * each, each, first, at))
                at += size * each
            first += n
        self.begin, self.table, row = np.zeros(capacity + 2, np.int64), [], 0
        for size in range(capacity + 1):
            self.begin[size] = row
            rank = 0
            for number, each, sequence, at in slots.get(size, ()):
                self.table.append((rank, each, sequence, at))
                rank += number
                row += 1
        self.begin[capacity + 1] = row
        self.table = np.array(self.table or np.zeros((0, 4)), np.int64).reshape(-1, 4)
        self.key = self.table[:, 0] + (np.repeat(np.arange(capacity + 1), np.diff(self.begin)) << 44)

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset."""
        row = np.searchsorted(self.key, rank + (length << 44), "right") - 1
        start, each, sequence, at = self.table[row].T
        k = rank - start
        return sequence + k // each, at + (k % each) * length


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text", cache: tuple[int, int] = (BITS, POOL)) -> DataFrame:
    """The pieces of every document, with a checksum of their ids. cache: bits and limit of the words that a worker keeps."""

    def per_slice(part, flat):
        ids, n = bpe.loaded(tokenizer_path, *cache).ids(flat)
        out = np.full(len(ids) + len(n), end_id, np.uint32)
        out[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
        n = n + 1
        made = -(-n // capacity)
        of = np.repeat(np.arange(len(n)), made)
        piece = np.arange(len(of)) - np.repeat(np.cumsum(made) - made, made)
        head = n - (made - 1) * capacity
        start = np.where(piece == 0, 0, head[of] + (piece - 1) * capacity)
        length = np.where(piece == 0, head[of], capacity)
        raw, at = memoryview(out.astype("<u4").tobytes()), 4 * (start + (np.cumsum(n) - n)[of])
        crc = [zlib.crc32(raw[a : a + 4 * k]) for a, k in zip(at.tolist(), length.tolist(), strict=True)]
        return {id_col: part.column(id_col).take(pa.array(of)), "piece": piece, "start": start, "length": length, "ids_crc32": crc}

    return map_slices(docs, [id_col, text_col], text_col, per_slice, Schema(**{id_col: type_of(docs, id_col)}, **PIECE))


def pack(cut: DataFrame, capacity: int, id_col: str = "doc_id") -> DataFrame:
    """Give pieces (length at most capacity) a sequence and an offset. Lengths are counted in partial sums; ranks inside a length
    come from counts by (bucket, length) and a window over one bucket and length, so a common length is no hot key."""
    cut = places.stored(cut, "pieces")
    columns = [id_col, *PIECE]
    placed = Schema(**{id_col: type_of(cut, id_col)}, **PIECE, sequence_id="long", offset="long")
    total = cut.count()
    buckets = max(1, -(-total // RANKED))
    keyed = cut.withColumn("bucket", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    by_bucket = places.stored(keyed.groupBy("length", "bucket").agg(F.count("*").alias("n")), "lengths")
    histogram = np.zeros(capacity + 1, np.int64)
    for row in by_bucket.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        histogram[row["length"]] = row["n"]
    packing, _ = plan(histogram, capacity)
    shared = cut.sparkSession.sparkContext.broadcast(Places(packing, capacity))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_bucket.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy("bucket", "length").orderBy(id_col, "piece", "ids_crc32", "start")
    ranked = keyed.withColumn("rank", F.row_number().over(inside) - 1).join(offsets, ["bucket", "length"])
    ranked = ranked.select(*columns, (F.col("rank") + F.col("before")).cast("long").alias("rank"))

    def run(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = shared.value.find(length, rank)
            yield placed.batch({c: batch.column(c) for c in columns} | {"sequence_id": sequence, "offset": offset})

    return ranked.mapInArrow(run, placed.spark)


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text", cache: tuple[int, int] = (BITS, POOL)) -> DataFrame:
    return pack(pieces(docs, tokenizer_path, end_id, capacity, id_col, text_col, cache), capacity, id_col)
