"""Exact top-k inner-product search on a bit-sliced index.

Vectors are quantised to integers and cut into segments of rows. A segment stores, for each attribute, the bits of
its offset values as bitmaps over the rows. The score of a query against all rows of a segment is a sum of such
bitmaps: the query's numbers are written in signed digits, so that few bitmaps take part, each at the level of its
weight; carry-save adders reduce the bitmaps of a level to one and pass carries on. From the most significant slice
of the sum downward, rows that are surely among the k best and rows still tied are kept apart; the rows tied at the
boundary are resolved exactly, by the smaller id.

Segments and blocks of queries are built once, as tables of one row each. Every segment meets every block in a
group of its own, and the best k of each segment are ranked again.

Defined results: vectors that are null or hold null or non-finite components take no part; a shorter vector counts
as ending in zeros; rows of one id are one vector, the smallest of theirs; fewer than k candidates are all returned;
an empty table gives no rows; columns other than id and vector are not read. Any component of 64 bits is exact; a
score is a number of 64 bits, so larger ones come out modulo 2^64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .places import stored
from .text import Schema, need_whole_ids

#: Rows of a segment and queries of a block, at most about; blocks are smaller while there are fewer than CELLS pairs of both.
SEGMENT_ROWS, BLOCK_QUERIES, CELLS = 8192, 2048, 48


def quantised(vectors: DataFrame, scale: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (id, v array<long>) of usable vectors, one of each id: floor(scale * x) of every component."""
    bad = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    usable = vectors.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()).where(~F.coalesce(bad, F.lit(True)))
    rows = usable.select(F.col(id_col).alias("id"), F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale)).alias("v"))
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def _matrix(column: pa.Array, dim: int | None = None) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = np.diff(column.offsets.to_numpy()).astype(np.int64)
    dim = int(n.max(initial=0)) if dim is None else dim
    out = np.zeros((len(n), dim), np.int64)
    flat = column.flatten().to_numpy()
    row, col = np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
    fits = col < dim
    out[row[fits], col[fits]] = flat[fits]
    return out


INDEX = Schema(segment="long", ids="binary", low="binary", bits="binary", planes="binary")
QUERIES = Schema(block="long", ids="binary", values="binary")


def _segment_row(number: int, ids: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    """The index of one segment: rows in the order of ids, offset values of every attribute cut into bitmaps."""
    order = np.argsort(ids, kind="stable")
    ids, values = ids[order], values[order]
    low = values.min(0) if values.shape[1] else np.zeros(0, np.int64)
    lifted = values.view(np.uint64) - low.view(np.uint64)
    bits = np.array([int(x).bit_length() for x in lifted.max(0)] if values.shape[1] else [], np.int64)
    planes = np.zeros((int(bits.sum()), -(-len(ids) // 64) * 8), np.uint8)
    row = 0
    for d in range(values.shape[1]):
        for b in range(int(bits[d])):
            packed = np.packbits(((lifted[:, d] >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), bitorder="little")
            planes[row, : len(packed)] = packed
            row += 1
    return INDEX.batch({"segment": [number], "ids": [ids.astype("<i8").tobytes()], "low": [low.astype("<i8").tobytes()], "bits": [bits.astype("<i8").tobytes()], "planes": [planes.tobytes()]})


class Segment:
    """A segment of the index as read from its row."""

    def __init__(self, row: dict[str, bytes]):
        self.ids, self.low, self.bits = (np.frombuffer(row[c], "<i8") for c in ("ids", "low", "bits"))
        self.words = -(-len(self.ids) // 64)
        self.first = np.cumsum(self.bits) - self.bits
        plain = np.frombuffer(row["planes"], np.uint64).reshape(int(self.bits.sum()), self.words)
        self.planes = np.concatenate([plain, ~plain])  # the second half serves negative digits: -x = (2^bits - 1 - x) - (2^bits - 1)
        live = np.zeros(self.words * 8, np.uint8)
        packed = np.packbits(np.ones(len(self.ids), np.uint8), bitorder="little")
        live[: len(packed)] = packed
        self.live = live.view(np.uint64)

    def slices(self, query: np.ndarray) -> tuple[np.ndarray, int]:
        """Bit slices of the scores of all rows, least significant first, and the constant to add to them."""
        n = len(self.low)
        rest = [0] * n
        rest[: min(n, len(query))] = query[:n].tolist()
        constant = sum(x * y for x, y in zip(rest, self.low.tolist(), strict=True))
        wide = max(map(abs, rest), default=0) >> 62
        rest = np.array(rest, object if wide else np.int64)
        levels: list[list[np.ndarray]] = []
        b = 0
        while rest.any():
            digit = np.where(rest & 1, 2 - (rest & 3), 0).astype(np.int64)  # signed digits: 1, 0 or -1
            rest = (rest - digit) >> 1
            d = np.flatnonzero(digit)
            k, minus = self.bits[d], digit[d] < 0
            constant -= sum(((1 << x) - 1) << b for x in k[minus].tolist())
            bit = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
            plane = np.repeat(self.first[d] + np.where(minus, len(self.planes) // 2, 0), k) + bit
            for level in np.unique(bit):
                while len(levels) <= b + level:
                    levels.append([])
                levels[b + level].append(plane[bit == level])
            b += 1
        out, carried = [], [np.zeros((0, self.words), np.uint64)]
        level = 0
        while level < len(levels) or sum(map(len, carried)):
            stack = np.concatenate([*carried, *([self.planes[np.concatenate(levels[level])]] if level < len(levels) and levels[level] else [])])
            carried = []
            while len(stack) > 2:
                m = len(stack) // 3
                a, b, c = stack[:m], stack[m : 2 * m], stack[2 * m : 3 * m]
                x = a ^ b
                carried.append((a & b) | (x & c))
                stack = np.concatenate([x ^ c, stack[3 * m :]]) if len(stack) > 3 * m else x ^ c
            if len(stack) == 2:
                carried.append((stack[0] & stack[1])[None])
                stack = (stack[0] ^ stack[1])[None]
            out.append(stack[0] if len(stack) else np.zeros(self.words, np.uint64))
            carried = carried or [np.zeros((0, self.words), np.uint64)]
            level += 1
        return (np.stack(out) if out else np.zeros((0, self.words), np.uint64)), constant

    def top(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows other than the query's own, in no order."""
        slices, constant = self.slices(query)
        open_ = self.live.copy()
        lo, hi = np.searchsorted(self.ids, query_id, "left"), np.searchsorted(self.ids, query_id, "right")
        for row in range(lo, hi):
            open_[row >> 6] &= ~(np.uint64(1) << np.uint64(row & 63))
        sure = np.zeros(self.words, np.uint64)
        count = lambda x: int(np.bitwise_count(x).sum())
        if count(open_) > k:
            for s in slices[::-1]:
                with_bit = open_ & s
                tried = sure | with_bit
                n = count(tried)
                if n > k:
                    open_ = with_bit
                elif n < k:
                    sure, open_ = tried, open_ & ~s
                else:
                    sure, open_ = tried, np.zeros_like(open_)
                    break
        rows = np.concatenate([_set_bits(sure), _set_bits(open_)])[:k]  # rows are in the order of ids
        bits = (slices[:, rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1)
        score = np.full(len(rows), constant % (1 << 64), np.uint64)
        for level, x in enumerate(bits[:64]):
            score += x << np.uint64(level)
        return self.ids[rows], score.view(np.int64)


def _set_bits(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


FOUND = Schema(query_id="long", vec_id="long", score="long")


def built_index(rows: DataFrame, segments: int) -> DataFrame:
    """One row of INDEX for each segment; rows: (id, v)."""

    def build(data: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_segment_row(data["s"][0].as_py(), data["id"].to_numpy(), _matrix(data["v"]))])

    return rows.withColumn("s", F.pmod(F.xxhash64("id"), F.lit(segments))).groupBy("s").applyInArrow(build, INDEX.spark)


def query_blocks(rows: DataFrame, blocks: int) -> DataFrame:
    """One row of QUERIES for each block of queries; rows: (id, v)."""

    def build(data: pa.Table) -> pa.Table:
        values = _matrix(data["v"])
        return pa.Table.from_batches([QUERIES.batch({"block": [data["b"][0].as_py()], "ids": [data["id"].to_numpy().astype("<i8").tobytes()], "values": [values.astype("<i8").tobytes()]})])

    return rows.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks))).groupBy("b").applyInArrow(build, QUERIES.spark)


def top_k(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for every id of queries the k rows of vectors of the highest inner product."""
    need_whole_ids(vectors, id_col)
    rows = stored(quantised(vectors, scale, id_col, vector_col), "vectors")
    asked = stored(quantised(queries, scale, id_col, vector_col), "queries")
    segments = max(1, -(-rows.count() // SEGMENT_ROWS))
    number = asked.count()
    blocks = max(1, -(-number // BLOCK_QUERIES), min(-(-number // 64), -(-CELLS // segments)))
    index, asked = stored(built_index(rows, segments), "index"), stored(query_blocks(asked, blocks), "blocks")
    # a cell of the grid (segment, block) is one group: segments go to every block and blocks to every segment, as single rows
    cell = (F.col("segment") * blocks + F.col("block")).alias("cell")
    left = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("ids", "low", "bits", "planes", cell)
    right = asked.withColumn("segment", F.explode(F.sequence(F.lit(0), F.lit(segments - 1)))).select("ids", "values", cell)
    cells = segments * blocks

    def search(segment: pa.Table, block: pa.Table) -> pa.Table:
        if not segment.num_rows or not block.num_rows:
            return pa.Table.from_batches([], pa.schema([(c, pa.int64()) for c in FOUND.kinds]))
        index_ = Segment(segment.to_pylist()[0])
        ids = np.frombuffer(block["ids"][0].as_py(), "<i8")
        values = np.frombuffer(block["values"][0].as_py(), "<i8").reshape(len(ids), -1)
        parts = [(i, *index_.top(int(i), q, k)) for i, q in zip(ids, values, strict=True)]
        return pa.Table.from_batches([FOUND.batch({"query_id": np.repeat(ids, [len(x) for _, x, _ in parts]).astype(np.int64), "vec_id": np.concatenate([x for _, x, _ in parts]), "score": np.concatenate([y for _, _, y in parts])})])

    left, right = left.repartition(cells, "cell"), right.repartition(cells, "cell")
    found = left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(search, FOUND.spark)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
