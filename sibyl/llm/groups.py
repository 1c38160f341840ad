"""Whole groups of sorted rows inside an Arrow task, and connected components of a table of edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .places import stored


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int = 20_000) -> Iterator[pa.Table]:
    """Tables of complete groups from batches sorted by key; a table holds about `rows` rows or one larger group."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        if held and (size >= rows or keys[0] != held[-1].column(key)[-1].as_py()):
            # the rows before the last change of key are complete
            change = np.flatnonzero(keys[1:] != keys[:-1])
            if keys[0] != held[-1].column(key)[-1].as_py():
                if size >= rows:
                    yield pa.Table.from_batches(held)
                    held, size = [], 0
            elif len(change):
                cut = int(change[0]) + 1
                yield pa.Table.from_batches([*held, batch.slice(0, cut)])
                batch, held, size = batch.slice(cut), [], 0
        held.append(batch)
        size += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def bounds(keys: np.ndarray) -> np.ndarray:
    """Where groups of equal neighbours begin, and the end."""
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]) if len(keys) else np.zeros(1, np.int64)


#: Bits of the filter of probably_in: 2 MB, whatever the input.
FILTER_BITS = 1 << 24


def probably_in(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """df without most rows whose integer key is not in wanted, by a bitmap of fixed size; an exact join has to follow.

    Only words of the bitmap that hold a bit come to the driver, at most FILTER_BITS / 64 of them. A fuller bitmap
    lets more rows through and loses none.
    """
    place = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    words = wanted.select(F.shiftright(place, 6).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(`{key}`), {FILTER_BITS}) % 64 as int))").alias("b"))
    found = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bitmap = np.zeros(FILTER_BITS // 64, np.uint64)
    bitmap[found["w"].to_numpy()] = found["b"].to_numpy().view(np.uint64)
    shared = df.sparkSession.sparkContext.broadcast(bitmap)
    columns = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("sibyl_place").to_numpy()
            hit = (shared.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
            yield batch.select(columns).filter(pa.array(hit == 1))

    return df.withColumn("sibyl_place", place).where("sibyl_place is not null").mapInArrow(run, df.schema)


def connected_components(edges: DataFrame) -> DataFrame:
    """Rows (u, root) for every node of edges (u, v) that is not its component's smallest: root is that smallest node.

    Large and small stars in turn: neighbours are tied to the smallest one, until
    nothing changes. Minima are partial before a shuffle and become tables of their own, so that the joins with them
    are plain ones: a node with very many edges is a skewed join key there, which adaptive execution splits.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    e = stored(e, "edges")
    mark = lambda d: tuple(d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
    before = mark(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stored(large, "large")
        down = stored(large.groupBy("u").agg(F.min("v").alias("m")), "down")
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = stored(small.unionByName(down.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = mark(e)
        if now == before:
            break
        before = now
    return e.select("u", F.col("v").alias("root"))
