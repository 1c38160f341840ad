"""Byte-level, vectorised view of a batch of texts, for work inside Arrow tasks.

A batch is cut into slices of a few MB (a longer text is a slice of its own, whole), so that the memory of a
task does not depend on how many rows Spark puts into a batch. All positions are byte positions in one buffer
in which every text is followed by a newline; null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

SLICE_BYTES = 1 << 20
U64 = np.uint64

_TYPES = {
    "long": (T.LongType(), pa.int64()),
    "int": (T.IntegerType(), pa.int32()),
    "double": (T.DoubleType(), pa.float64()),
    "string": (T.StringType(), pa.string()),
    "boolean": (T.BooleanType(), pa.bool_()),
    "binary": (T.BinaryType(), pa.binary()),
    "array<long>": (T.ArrayType(T.LongType()), pa.list_(pa.int64())),
    "array<int>": (T.ArrayType(T.IntegerType()), pa.list_(pa.int32())),
    "array<double>": (T.ArrayType(T.DoubleType()), pa.list_(pa.float64())),
    "array<string>": (T.ArrayType(T.StringType()), pa.list_(pa.string())),
}


class Schema:
    """Column names and types, for Spark and for Arrow."""

    def __init__(self, **kinds: str | T.DataType):
        self.kinds = {c: k if isinstance(k, str) else (k, to_arrow_type(k)) for c, k in kinds.items()}
        self.kinds = {c: _TYPES[k] if isinstance(k, str) else k for c, k in self.kinds.items()}
        self.spark = T.StructType([T.StructField(c, k[0]) for c, k in self.kinds.items()])

    def batch(self, columns: dict) -> pa.RecordBatch:
        arrays = []
        for name, kind in self.kinds.items():
            value, arrow = columns[name], kind[1]
            if isinstance(value, pa.Array | pa.ChunkedArray):
                value = value.combine_chunks() if isinstance(value, pa.ChunkedArray) else value
                arrays.append(value if value.type == arrow else value.cast(arrow))
            else:
                arrays.append(pa.array(value, arrow))
        return pa.RecordBatch.from_arrays(arrays, names=list(self.kinds))


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from flat values and the length of each list."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def map_slices(df: DataFrame, columns: list[str], text: str, fn: Callable, schema: Schema, limit: int = SLICE_BYTES) -> DataFrame:
    """Apply fn(slice, Flat) -> {column: values} to slices of the selected columns; text names the text column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in cuts(batch.column(text), limit):
                part = batch.slice(lo, hi - lo)
                yield schema.batch(fn(part, Flat(part.column(text))))

    return df.select(*columns).mapInArrow(run, schema.spark)


def filter_slices(df: DataFrame, text: str, fn: Callable, limit: int = SLICE_BYTES) -> DataFrame:
    """The rows of df, whole and with all columns, for which fn(slice, Flat) -> mask is true. No shuffle and no join by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in cuts(batch.column(text), limit):
                part = batch.slice(lo, hi - lo)
                yield part.filter(pa.array(fn(part, Flat(part.column(text)))))

    return df.mapInArrow(run, df.schema)


def map_rows(df: DataFrame, text: str, fn: Callable, limit: int = SLICE_BYTES) -> DataFrame:
    """fn(slice, Flat) -> slice of the same columns, over all columns of df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in cuts(batch.column(text), limit):
                part = batch.slice(lo, hi - lo)
                yield fn(part, Flat(part.column(text)))

    return df.mapInArrow(run, df.schema)


def type_of(df: DataFrame, column: str) -> T.DataType:
    return df.schema[column].dataType


def need_whole_ids(df: DataFrame, column: str) -> None:
    if not isinstance(type_of(df, column), T.LongType | T.IntegerType | T.ShortType | T.ByteType):
        raise TypeError(f"{column} has to be a whole number")


def cuts(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes, or of one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo, done = 0, 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield lo, hi
        lo, done = hi, int(ends[hi - 1])


_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Flat:
    """One buffer of texts, each followed by a newline. start and end bound the texts, with what is put before each."""

    def __init__(self, texts: pa.Array, before: bytes = b""):
        kind = pa.large_binary()
        whole = pc.binary_join_element_wise(pa.scalar(before, kind), pc.fill_null(texts, "").cast(kind), pa.scalar(b"\n", kind), pa.scalar(b"", kind))
        offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
        data = whole.buffers()[2]
        self.buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(whole) else np.zeros(0, np.uint8)
        self.offsets = offsets - offsets[0] if len(whole) else np.zeros(1, np.int64)
        self.start, self.end = self.offsets[:-1], self.offsets[1:] - 1
        self.n = len(self.start)

    def lowered(self) -> Flat:
        """The same with A-Z lower-cased."""
        out = object.__new__(Flat)
        out.__dict__ = self.__dict__ | {"buf": _LOWER[self.buf]}
        return out

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of every run of bytes other than space and tab to carriage return, and the words of each text."""
        inside = np.zeros(len(self.buf) + 1, np.int8)
        inside[1:] = ~_SEPARATOR[self.buf]
        turns = np.diff(inside)
        ws, we = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
        return ws, we, np.diff(np.searchsorted(ws, self.offsets))

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of every line (split at newlines alone) and the lines of each text."""
        le = np.flatnonzero(self.buf == 10)
        ls = np.concatenate([[0], le[:-1] + 1]) if len(le) else le
        return ls, le, np.diff(np.searchsorted(ls, self.offsets))

    def tally(self, mask: np.ndarray) -> np.ndarray:
        """Running count of set bytes: tally[b] - tally[a] are those in [a, b)."""
        out = np.zeros(len(self.buf) + 1, np.int64)
        np.cumsum(mask, out=out[1:])
        return out


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser over 64 bits; every input bit reaches every output bit."""
    h = h ^ (h >> U64(33))
    h *= U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


class Spans:
    """Hashes and comparisons of any byte ranges of one buffer, eight bytes at a time.

    A hash is a sum over the lanes of a range of a mixed lane and its place, so no structure of the bytes makes two
    ranges collide. It is still no proof that ranges are equal: `classes` and `same` compare the bytes.
    """

    def __init__(self, buf: np.ndarray):
        self.padded = np.concatenate([buf, np.zeros(8, np.uint8)])
        self.lanes = np.ndarray((len(buf) + 1,), "<u8", self.padded, 0, (1,))

    def _lanes(self, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Range, place in it and used bytes of every lane, and lanes of each range."""
        n = (size + 7) >> 3
        of = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        return of, place, _MASKS[np.minimum(size[of] - 8 * place, 8)], n

    def hash(self, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
        size = end - start
        of, place, used, n = self._lanes(start, size)
        terms = mix((self.lanes[start[of] + 8 * place] & used) ^ (place.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(0x632BE59BD9B4E019 + seed)))
        total = np.zeros(len(terms) + 1, U64)
        np.cumsum(terms, out=total[1:])
        ends = np.cumsum(n)
        return mix(total[ends] - total[ends - n] + size.astype(U64) * U64(0xD6E8FEB86659FD93))

    def same(self, start: np.ndarray, end: np.ndarray, other: Spans, other_start: np.ndarray, other_end: np.ndarray) -> np.ndarray:
        """Whether ranges hold the same bytes as those of another buffer (or of this one)."""
        size = end - start
        out = size == other_end - other_start
        some = np.flatnonzero(out)
        of, place, used, _ = self._lanes(start[some], size[some])
        differ = ((self.lanes[start[some][of] + 8 * place] ^ other.lanes[other_start[some][of] + 8 * place]) & used) != 0
        out[some[of[differ]]] = False
        return out

    def classes(self, h: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers that ranges of the same bytes share, and the first range of each number. h: their hashes."""
        return classes(h, lambda i, j: self.same(start[i], end[i], self, start[j], end[j]))


def classes(keys: np.ndarray, equal: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers that equal rows share, and the first row of each number. Equal rows have equal keys; rows of equal keys are
    equal only if equal(rows, other rows) says so."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, first, of = np.unique(keys, return_index=True, return_inverse=True)
    odd = np.flatnonzero(~equal(np.arange(len(keys)), first[of]))
    while len(odd):  # rows whose key belongs to another row too
        _, lead, back = np.unique(keys[odd], return_index=True, return_inverse=True)
        lead = odd[lead]
        ok = equal(odd, lead[back])
        of[odd[ok]] = len(first) + back[ok]
        first, odd = np.concatenate([first, lead]), odd[~ok]
    return of, first


def windows(h: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` neighbours inside each group, and how many each group has."""
    made = np.maximum(counts - size + 1, 0)
    if len(h) < size:
        return np.zeros(0, U64), made
    out = np.zeros(len(h) - size + 1, U64)
    for k in range(size):
        out *= U64(0x9FB21C651E98DF25)
        out += h[k : len(h) - size + 1 + k]
    ends = np.cumsum(counts)
    good = np.zeros(len(h) + 1, np.int64)  # places at which a window may start
    first = ends - counts
    np.add.at(good, first[made > 0], 1)
    np.add.at(good, (first + made)[made > 0], -1)
    return mix(out[np.cumsum(good[: len(out)]) > 0]), made


def group_of(counts: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(counts)), counts)


def per_group(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of values over consecutive groups; empty groups give 0."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def repeated(of: np.ndarray, first: np.ndarray, first_too: bool) -> np.ndarray:
    """Marks rows whose class (see `classes`) has two rows or more: all of them, or all but the first."""
    if first_too:
        return np.bincount(of, minlength=len(first))[of] > 1
    return first[of] != np.arange(len(of))


def repeated_windows(of: np.ndarray, place: np.ndarray, group: np.ndarray, size: int) -> np.ndarray:
    """Marks windows of `size` words that their group has twice or more. of: class of every word; place: first word of every window."""
    key = group.astype(U64) * U64(0x9E3779B97F4A7C15)
    for k in range(size):
        key = mix(key + of[place + k].astype(U64))
    same = lambda i, j: (group[i] == group[j]) & np.logical_and.reduce([of[place[i] + k] == of[place[j] + k] for k in range(size)])
    return repeated(*classes(key, same), first_too=True)


def window_places(counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First word of every run of `size` words inside its group, and the group."""
    made = np.maximum(counts - size + 1, 0)
    group = group_of(made)
    return (np.cumsum(counts) - counts)[group] + np.arange(len(group)) - (np.cumsum(made) - made)[group], group
