"""Spelling variants: words one edit apart, grouped by following each to a much more frequent one.

Near words are found in sorted lists. A query goes through a list from word to word with the rows of its edit matrix,
banded to the diagonal and its two neighbours; rows up to the common prefix with the word before are kept, and once a
row has no cell of at most one edit, the scan jumps over all words that share the prefix up to that row.

Of two words one edit apart, either the first half before the edit or the second half behind it is equal. So each
word is in one list by its letters and in one by its letters backwards, and a query needs those words alone that begin
with its own half. The lists are one table sorted by range partitioning: a range is a task's list and holds some `RANGE`
words however many share a beginning, and queries stream past it. A query goes to the ranges that its beginning
reaches, less those whose own shared prefix already exceeds one edit. A pair counts in the first list if
its first difference is in the second half, else in the second list, so no pair is counted twice and no pair becomes a row.

Defined results: null and empty texts have no words; null ids count as empty text in the digest of a run; rows that
repeat count as often as they stand there; a run of any length is a word; of near words with equal counts the smallest in code-point order is
the form; a word without near words, or none twice as frequent, has itself as root; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .places import stored
from .text import Flat, Schema, Spans, map_slices

RANGE = 20_000
_TOP = "\U0010ffff"
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[0xC3] = True


def _runs(flat: Flat) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every run of A-Z, a-z and U+00C0 to U+00FF (a byte C3 and the one behind it), and the runs of each text."""
    inside = np.zeros(len(flat.buf) + 1, np.int8)
    inside[1:] = _LETTER[flat.buf]
    inside[2:] |= flat.buf[:-1] == 0xC3
    turns = np.diff(inside)
    starts, ends = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
    return starts, ends, np.diff(np.searchsorted(starts, flat.offsets))


def words_of(ids: list, flat: Flat, drop_every: int, least_chars: int) -> tuple[list[str], list[int]]:
    """Words of a slice and how often they occur; ids: the id of each text as text."""
    flat = flat.lowered()
    starts, ends, per_text = _runs(flat)
    if not len(starts):
        return [], []
    spans = Spans(flat.buf)
    of, first = spans.classes(spans.hash(starts, ends), starts, ends)
    raw = flat.buf.tobytes()
    word = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
    seed = [zlib.crc32(f"{i if i is not None else ''}:".encode()) for i in ids]
    pairs, times = np.unique(np.repeat(np.arange(flat.n), per_text) * len(word) + of, return_counts=True)
    text, kind = pairs // len(word), pairs % len(word)
    h = np.fromiter((zlib.crc32(word[k], seed[t]) for t, k in zip(text.tolist(), kind.tolist(), strict=True)), np.int64, len(pairs))
    typo = h % drop_every == 0 if drop_every else np.zeros(len(h), bool)
    whole = np.bincount(kind[~typo], times[~typo], len(word)).astype(np.int64)
    out: dict[str, int] = {}
    for k in np.flatnonzero(whole).tolist():
        w = word[k].decode()
        if len(w) >= least_chars:
            out[w] = int(whole[k])
    for k, x, n in zip(kind[typo].tolist(), h[typo].tolist(), times[typo].tolist(), strict=True):
        w = word[k].decode()
        w = w[: x % len(w)] + w[x % len(w) + 1 :]
        if len(w) >= least_chars:
            out[w] = out.get(w, 0) + n
    return list(out), list(out.values())


def vocabulary(docs: DataFrame, drop_every: int = 0, least_chars: int = 5, least_count: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (word, n): words of whole texts, A-Z lower-cased, with at least so many code points and occurrences. drop_every: a run whose
    crc32 of `<id>:<run>` it divides loses one letter; 0: none does."""

    def per_slice(part, flat):
        words, n = words_of(part.column("sibyl_id").to_pylist(), flat, drop_every, least_chars)
        return {"word": words, "n": n}

    named = docs.select(F.col(id_col).cast("string").alias("sibyl_id"), F.col(text_col).alias("sibyl_text"))
    counted = map_slices(named, ["sibyl_id", "sibyl_text"], "sibyl_text", per_slice, Schema(word="string", n="long"))
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def shared(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i in range(n) if a[i] != b[i])


def _row(above: tuple[int, int, int], c: str, query: str, d: int) -> tuple[int, int, int]:
    """Edits between d letters of a word and d - 1, d and d + 1 letters of the query, 2 for more than one; above: those of
    d - 1; c: the word's letter d."""
    m = len(query)
    left = min(above[0] + (d < 2 or d - 2 >= m or query[d - 2] != c), above[1] + 1) if 1 <= d <= m + 1 else 2
    here = min(above[1] + (query[d - 1] != c), above[2] + 1, left + 1) if d <= m else 2
    right = min(above[2] + (query[d] != c), here + 1) if d < m else 2
    return left if left < 2 else 2, here if here < 2 else 2, right if right < 2 else 2


def scan(words: list[str], lcp: list[int], query: str, begin: int) -> Iterator[int]:
    """Places in the sorted list of the words one edit from query that begin with its first `begin` letters. lcp: common prefix of each
    word with the one before."""
    head = query[:begin]
    i, stop = bisect_left(words, head), bisect_left(words, head + _TOP)
    m = len(query)
    rows = {begin: (1 if begin else 2, 0, 1 if begin < m else 2)}
    kept = begin
    while i < stop:
        w = words[i]
        d, size = kept, len(w)
        row = rows[d]
        while d < size and d <= m + 1:
            d += 1
            row = rows[d] = _row(row, w[d - 1], query, d)
            if row == (2, 2, 2):
                break
        else:
            if d == size and -2 < m - size < 2 and row[m - size + 1] == 1:
                yield i
        # words that share the prefix up to the row that failed, or that a whole word ends in, cannot do better
        if row == (2, 2, 2) or d < size:
            j, far = i + 1, i + 8
            while j < stop and j < far and lcp[j] >= d:
                j += 1
            if j == far and j < stop and lcp[j] >= d:
                j = bisect_left(words, w[:d] + _TOP, j, stop)
            i = j
        else:
            i += 1
        if i < stop:
            kept = max(begin, min(lcp[i], d))
    return


def half(n: int) -> int:
    """Letters before the second half, of the shorter word of a pair."""
    return n // 2


def _side(side: str, w: str, x: str) -> bool:
    """Whether the pair belongs to this list: the first difference is in the second half (f) or in the first one (b)."""
    return (shared(w, x) >= half(min(len(w), len(x)))) == (side == "f")


def begin_of(side: str, n: int) -> int:
    """Letters that a word of n letters shares at least with every near word of a list."""
    return half(n - 1) if side == "f" else n - half(n)


def _reach(lows: list[str], highs: list[str], key: str) -> list[int]:
    """Ranges that may hold near words of a key: those that its beginning reaches, if their own shared prefix is within one edit."""
    side, query = key[0], key[1:]
    begin = begin_of(side, len(query))
    head = key[: begin + 1]
    out, r = [], bisect_left(highs, head)
    while r < len(lows) and lows[r] <= head + _TOP:
        both, row, d = lows[r][1 : 1 + max(begin, shared(lows[r], highs[r]) - 1)], (1 if begin else 2, 0, 1 if begin < len(query) else 2), begin
        if lows[r][1 : 1 + begin] == highs[r][1 : 1 + begin] == query[:begin]:
            while d < len(both) and row != (2, 2, 2):
                d += 1
                row = _row(row, both[d - 1], query, d)
        if row != (2, 2, 2):
            out.append(r)
        r += 1
    return out


def _asked(keys: DataFrame, lows: list[str], highs: list[str], numbers: list[int]) -> DataFrame:
    """A row for each range that a word of the lists has to ask. numbers: those of the ranges, in the order of their words."""

    def run(batches):
        for batch in batches:
            key = batch.column("key").to_pylist()
            to = [_reach(lows, highs, k) for k in key]
            at = np.repeat(np.arange(len(key)), [len(x) for x in to])
            yield pa.RecordBatch.from_arrays([pa.array([numbers[r] for x in to for r in x], pa.int32()), pa.array(np.ones(len(at), np.int32)), batch.column("key").take(pa.array(at)), pa.nulls(len(at), pa.int64())], names=["range", "kind", "key", "n"])

    return keys.select("key").mapInArrow(run, "range int, kind int, key string, n long")


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by range, kind and key: the words of a range (kind 0) form its list, the others go past it."""
    held, words, count, lcp = -1, {}, {}, {}
    for batch in batches:
        out: list[tuple] = []
        for r, kind, key, n in zip(*(batch.column(c).to_pylist() for c in ("range", "kind", "key", "n")), strict=True):
            if r != held:
                held, words, count, lcp = r, {"f": [], "b": []}, {"f": [], "b": []}, {"f": [], "b": []}
            side, w = key[0], key[1:]
            if kind == 0:
                lcp[side].append(shared(words[side][-1], w) if words[side] else 0)
                words[side].append(w)
                count[side].append(n)
                continue
            places = scan(words[side], lcp[side], w, begin_of(side, len(w)))
            own = w if side == "f" else w[::-1]
            near = [(-count[side][i], words[side][i] if side == "f" else words[side][i][::-1]) for i in places]
            near = [x for x in near if _side(side, own, x[1])]
            if near:
                out.append((own, len(near), *min(near)))
        if out:
            a, b, c, d = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d)], names=["word", "n_near", "minus", "near"])


def near_words(words: DataFrame, size: int = RANGE) -> DataFrame:
    """For rows (word, n) with distinct words: rows (word, n_near, near, near_n) of those that have a word one edit away; near is the
    most frequent of them. Words of one letter have halves of no letters, so the lists are of use from two letters on."""
    spark = words.sparkSession
    keys = words.select(F.explode(F.array(F.concat(F.lit("f"), "word"), F.concat(F.lit("b"), F.reverse("word")))).alias("key"), "n")
    count = -(-2 * words.count() // size)
    if not count:
        return spark.createDataFrame([], "word string, n_near long, near string, near_n long")
    lists = stored(keys.repartitionByRange(count, "key").withColumn("range", F.spark_partition_id()), "spelling-lists")
    # one row for each range of `size` words
    ends = sorted(tuple(r) for r in lists.groupBy("range").agg(F.min("key").alias("low"), F.max("key").alias("high")).select("low", "high", "range").collect())
    listed = lists.select("range", F.lit(0).alias("kind"), "key", "n")
    rows = listed.unionByName(_asked(lists, *map(list, zip(*ends, strict=True))))
    found = rows.repartition(count, "range").sortWithinPartitions("range", "kind", "key").mapInArrow(_answers, "word string, n_near long, minus long, near string")
    best = F.min(F.struct("minus", "near"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("x")).select("word", "n_near", F.col("x.near").alias("near"), (-F.col("x.minus")).alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """Rows (word, root) of rows (word, form): from word on, form after form to the last one, by doubling the steps. Forms do not run in a circle, as counts grow."""
    jumps = stored(forms.select("word", F.col("form").alias("to")), "spelling-jumps")
    while True:
        on = jumps.select(F.col("word").alias("to"), F.col("to").alias("next"))
        jumps = stored(jumps.join(on, "to", "left").select("word", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "spelling-jumps")
        moved = jumps.where("moved").limit(1).count()
        jumps = jumps.drop("moved")
        if not moved:
            return jumps.withColumnRenamed("to", "root")


def spelling_variants(words: DataFrame, factor: int = 2, size: int = RANGE) -> DataFrame:
    """Rows (word, n, n_near, form, form_n, root) of rows (word, n) with distinct words. form: the most frequent near word, if it is at
    least `factor` times as frequent."""
    words = stored(words.select("word", "n"), "spelling-words")
    near = near_words(words, size)
    ok = F.col("near_n") >= factor * F.col("n")
    named = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(ok, F.col("near")).alias("form"), F.when(ok, F.col("near_n")).alias("form_n"))
    named = stored(named, "spelling-forms")
    ends = roots(named.where("form is not null"))
    return named.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
