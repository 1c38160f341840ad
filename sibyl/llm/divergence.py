"""Divergence audit: how far the sources of a language stand apart in the terms that they use, in exact integers.

Each group (a source of a language) and each language give every kept term a chance p, in billionths, from its count and one more. Two
groups differ by the sum over all kept terms of floor((p - q)^2 / q). Most terms are in few groups, so the sum is taken
as if no group had any term, put right for the terms that one group has (from its numbers of terms by count), and put
right once more for the terms that both have.

That last correction depends on the two counts alone, and comes from a frequent-pattern tree: a term is the row of its
counts above zero, in the order of the sources that have most terms, equal rows are one row with a multiplicity, and rows
with equal beginnings share the nodes of a path. A node adds, once for each of its ancestors, its multiplicity times the
correction of the two counts. Tasks hold sorted rows, so a tree is the path to the row that was read last, and is as
high as the number of sources of its language; the rows of a language are dealt by their beginnings, so large ones lie in many tasks.

Defined results: null text, lang and source are empty; a term of any length is a term; every lang and source that occurs is a
group, terms or not; a language without kept terms has pairs of value 0 and no terms; equal values are ranked by the item in
UTF-8 order; repeated rows are documents of their own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import batched, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .places import stored
from .text import Flat, Schema, Spans, map_slices

SCALE = 1_000_000_000
#: Counts below it fit into 64 bits after scaling.
_NARROW = 9_000_000_000
_TERM = np.zeros(256, bool)
_TERM[65:91] = _TERM[97:123] = _TERM[128:] = True


def counts_of(langs: list, sources: list, flat: Flat) -> dict[str, list]:
    """For each group and term of a slice, occurrences and documents."""
    flat = flat.lowered()
    inside = np.zeros(len(flat.buf) + 1, np.int8)
    inside[1:] = _TERM[flat.buf]
    turns = np.diff(inside)
    starts, ends = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
    per_text = np.diff(np.searchsorted(starts, flat.offsets))
    names: dict[tuple, int] = {}
    group = np.array([names.setdefault(x, len(names)) for x in zip(langs, sources, strict=True)], np.int64)
    spans = Spans(flat.buf)
    of, first = spans.classes(spans.hash(starts, ends), starts, ends)
    pairs, times = np.unique(np.repeat(np.arange(flat.n), per_text) * len(first) + of, return_counts=True)  # of text and term
    key = group[pairs // max(len(first), 1)] * len(first) + pairs % max(len(first), 1)
    keys, back = np.unique(key, return_inverse=True)
    raw = flat.buf.tobytes()
    word = [raw[a:b].decode() for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
    named = list(names)
    at = [named[k] for k in (keys // max(len(first), 1)).tolist()]
    return {
        "lang": [x[0] for x in at], "source": [x[1] for x in at], "term": [word[k] for k in (keys % max(len(first), 1)).tolist()],
        "n": np.bincount(back, times, len(keys)).astype(np.int64), "docs": np.bincount(back, minlength=len(keys)),
    }


#: Texts of one count in a task, in bytes: groups of a larger slice share more of their terms.
SLICE = 4 << 20


def kept_terms(docs: DataFrame, least_docs: int, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Rows (lang, term, in_lang, items): terms of at least least_docs documents of a language, their occurrences there and in each of
    its sources that has any. Slices are counted before their one shuffle, by language and term, which serves both sums."""
    named = docs.select(F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.coalesce(F.col(source_col), F.lit("")).alias("source"), F.col(text_col).alias("text"))

    def per_slice(part, flat):
        return counts_of(part.column("lang").to_pylist(), part.column("source").to_pylist(), flat)

    counted = map_slices(named, ["lang", "source", "text"], "text", per_slice, Schema(lang="string", source="string", term="string", n="long", docs="long"), SLICE)
    groups = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = groups.groupBy("lang", "term").agg(F.sum("n").alias("in_lang"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("items"))
    return terms.where(F.col("docs") >= least_docs).drop("docs")


def chance(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)), in decimals if the count is very large; null without terms."""
    below = F.nullif(total + terms, F.lit(0).cast("long"))
    wide = F.call_function("div", (F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)")).cast("decimal(38,0)"), below.cast("decimal(20,0)"))
    return F.lit(1).cast("long") + F.when(count < _NARROW, F.call_function("div", (F.when(count < _NARROW, count) + 1) * F.lit(SCALE).cast("long"), below)).otherwise(wide)


def difference(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); both are at most SCALE + 1."""
    return F.call_function("div", (p - q) * (p - q), q)


#: Multiplicities are summed in digits of so many bits, and corrections in halves, so that 64 bits hold every sum of a block.
_BITS, _BLOCK = 12, 250_000


class _Sums:
    """Exact sums of the corrections of nodes with their ancestors, by (group, other group)."""

    def __init__(self):
        self.total: dict[tuple[int, int], int] = defaultdict(int)
        self._clear()

    def _clear(self) -> None:
        self.above: tuple[list, list, list] = ([], [], [])  # group, chance and chance of no occurrence of ancestors
        self.node: list[tuple[int, int, int, int, int, int]] = []  # ancestors, group, chance, chance of none, digit, its place

    def add(self, path: tuple[list, list, list], node: tuple[int, int, int], times: int) -> None:
        size, place = len(path[0]), 0
        while times:
            digit = times & ((1 << _BITS) - 1)
            if digit:
                for column, values in zip(self.above, path, strict=True):
                    column.extend(values)
                self.node.append((size, *node, digit, place))
            times, place = times >> _BITS, place + 1
        if len(self.above[0]) > _BLOCK:
            self.flush()

    def flush(self) -> None:
        if not self.node:
            return
        a, p, p0 = (np.array(x, np.int64) for x in self.above)
        node = np.array(self.node, np.int64)
        b, q, q0, digit, place = np.repeat(node[:, 1:], node[:, 0], axis=0).T
        f = lambda x, y: (x - y) ** 2 // y
        for g, h, v in ((a, b, f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)), (b, a, f(q, p) - f(q, p0) - f(q0, p) + f(q0, p0))):
            _, first, of = np.unique((g << 35) + (h << 4) + place, return_index=True, return_inverse=True)
            high, low = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
            np.add.at(high, of, (v >> 32) * digit)
            np.add.at(low, of, (v & 0xFFFFFFFF) * digit)
            for x, y, k, m, n in zip(g[first].tolist(), h[first].tolist(), place[first].tolist(), high.tolist(), low.tolist(), strict=True):
                self.total[x, y] += ((m << 32) + n) << (_BITS * k)
        self._clear()


def tree_sums(rows: Iterator[tuple[list[tuple[int, int, int]], int]], limit: int = 500_000) -> Iterator[tuple[int, int, int]]:
    """(group, other, sum of corrections) from sorted rows (items (group, chance, chance of no occurrence), multiplicity). Once there are
    `limit` sums they come out as they are, so a pair may come more than once."""
    held: list[tuple[int, int, int]] = []  # the nodes to the last row
    path: tuple[list, list, list] = ([], [], [])  # the same by column
    times: list[int] = []  # rows that ended in a node or went through a closed one below it
    sums = _Sums()

    def close(depth: int) -> None:
        """Nodes deeper than depth get no more rows: combine each with its ancestors."""
        while len(held) > depth:
            node, n = held.pop(), times.pop()
            for column in path:
                column.pop()
            if held:
                times[-1] += n
                sums.add(path, node, n)

    for items, n in rows:
        same = 0
        while same < min(len(held), len(items)) and held[same] == items[same]:
            same += 1
        close(same)
        if same < len(items):
            held.extend(items[same:])
            times.extend([0] * (len(items) - same))
            for column, values in zip(path, zip(*items[same:], strict=True), strict=True):
                column.extend(values)
        times[-1] += n
        if len(sums.total) > limit:
            yield from ((a, b, v) for (a, b), v in sums.total.items())
            sums.total.clear()
    close(0)
    sums.flush()
    yield from ((a, b, v) for (a, b), v in sums.total.items())


def _tree_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trees of the languages of a task, from rows (lang, items, times) sorted by language and items."""

    def rows():
        for batch in batches:
            items = batch.column("items")
            flat = [x.to_pylist() for x in items.flatten().flatten()]
            of, ends = list(zip(*flat, strict=True)), np.cumsum(np.diff(items.offsets.to_numpy())).tolist()
            for lang, n, lo, hi in zip(batch.column("lang").to_pylist(), batch.column("times").to_pylist(), [0, *ends[:-1]], ends, strict=True):
                yield lang, of[lo:hi], n

    for lang, own in groupby(rows(), key=lambda r: r[0]):
        for found in batched(tree_sums((items, n) for _, items, n in own), 50_000):
            a, b, v = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array([str(x) for x in v], pa.string())], names=["lang", "g", "h", "value"])


def divergence(docs: DataFrame, least_docs: int = 3, top: int = 200, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Rows (lang, source, part, item, value, rank). part `pair`: every other source of the language; `term`: the `top` terms that the
    source has more of than its language. Terms are those in at least least_docs documents of the language.

    The largest thing in one row is the counts of a term in the sources of a language.
    """
    by_term = stored(kept_terms(docs, least_docs, text_col, lang_col, source_col), "divergence-terms")
    kept = by_term.select("lang", "term", "in_lang", F.explode("items").alias("x")).select("lang", "term", "in_lang", "x.source", "x.n")
    groups = docs.select(F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.coalesce(F.col(source_col), F.lit("")).alias("source")).distinct()
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("own"))
    langs = by_term.groupBy("lang").agg(F.sum("in_lang").alias("lang_total"), F.count("*").alias("terms"))
    known = groups.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "own", "lang_total", "terms"])
    order = Window.partitionBy("lang").orderBy(F.desc("own"), "source")
    known = stored(known.withColumn("g", F.row_number().over(order) - 1), "divergence-groups")
    pairs = _pairs(kept, known).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(ranked))
    t = kept.join(known.select("lang", "source", "total", "lang_total", "terms"), ["lang", "source"])
    t = t.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), chance(F.col("n"), F.col("total"), F.col("terms")).alias("p"), chance(F.col("in_lang"), F.col("lang_total"), F.col("terms")).alias("q"))
    t = t.where("p > q").withColumn("value", difference(F.col("p"), F.col("q"))).drop("p", "q")
    terms = t.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    return pairs.unionByName(terms)


def _pairs(kept: DataFrame, known: DataFrame) -> DataFrame:
    """Rows (lang, source, item, value) of every ordered pair of sources of a language."""
    p0 = chance(F.lit(0), F.col("total"), F.col("terms"))
    numbered = kept.join(known.select("lang", "source", "g", "total", "terms"), ["lang", "source"])
    numbered = stored(numbered.select("lang", "g", "term", chance(F.col("n"), F.col("total"), F.col("terms")).alias("p"), p0.alias("p0")), "divergence-rows")
    # equal rows once, dealt by their first three items and sorted, so that equal beginnings are neighbours
    paths = numbered.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("g", "p", "p0"))).alias("items")).where(F.size("items") > 1)
    paths = paths.groupBy("lang", "items").agg(F.count("*").alias("times"))
    dealt = paths.repartition("lang", F.slice("items", 1, 3)).sortWithinPartitions("lang", "items")
    both = dealt.mapInArrow(_tree_task, "lang string, g int, h int, value string")
    # exact sums: single corrections fit, sums of them may not
    both = both.groupBy("lang", "g", "h").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("both"))
    # terms that one group has, by count: each adds to the pair with every other group of the language
    heights = stored(numbered.groupBy("lang", "g", "p", "p0").agg(F.count("*").alias("times")), "divergence-heights")
    other = known.select("lang", F.col("g").alias("h"), chance(F.lit(0), F.col("total"), F.col("terms")).alias("q0"))
    p, q0 = F.col("p"), F.col("q0")
    wide = lambda c: c.cast("decimal(38,0)")
    none = F.col("p0")
    single = heights.join(other, "lang").where("g <> h").groupBy("lang", "g", "h").agg(
        F.sum(wide(difference(p, q0) - difference(none, q0)) * F.col("times")).alias("forth"), F.sum(wide(difference(q0, p) - difference(q0, none)) * F.col("times")).alias("back")
    )
    a = known.select("lang", "source", "g", "terms", p0.alias("p0"))
    b = known.select("lang", F.col("source").alias("item"), F.col("g").alias("h"), p0.alias("q0"))
    pair = a.join(b, "lang").where("g <> h")
    forth, back = single.select("lang", "g", "h", "forth"), single.select("lang", F.col("g").alias("h"), F.col("h").alias("g"), "back")
    base = F.when(F.col("terms") > 0, F.col("terms") * wide(difference(none, q0))).otherwise(0)
    part = lambda c: F.coalesce(wide(F.col(c)), F.lit(0))
    joined = pair.join(forth, ["lang", "g", "h"], "left").join(back, ["lang", "g", "h"], "left").join(both, ["lang", "g", "h"], "left")
    return joined.select("lang", "source", "item", (base + part("forth") + part("back") + part("both")).cast("long").alias("value"))
