"""Similarity join on the Jaccard similarity of word n-gram sets, by chosen paths.

In each run every set walks down a tree: at a node it moves to the child of one of its tokens, the one that a
hash drawn for the run and depth ranks first, so that two sets of similarity J choose the same child with chance
J. A set stops in a bucket that is small, or at the last depth. Buckets are brute-forced. A pair of similarity t
meets in a run with chance t^depth or more, and runs are repeated until the chance to meet in none is below
1 - recall.

Sets that are equal are one node with its copies. A pair that meets in several runs counts in the first. A bucket
larger than BLOCK sets is brute-forced in pairs of blocks, each of them a group of its own, so no bucket is capped
and none lands in one task. Before texts are fetched, pairs are thinned by set sizes and by a sketch of all ranks
(a pair at the threshold passes with chance 1 - 1e-8); only sets left in a pair have their tokens compared.
No pairs leave a task: each node leaves with its number of links and one edge that ties it to its part of the
bucket, which is enough for the classes.

Defined results: texts of fewer words than n have one token, all their words; texts without words (null, empty)
are copies of each other; rows without an id come back with no class and no links; rows that repeat are copies; an
empty table gives no rows; columns other than id and text are not read. Sets are told apart by digests of 128 bits, their tokens
are hashes of 64 bits (two different n-grams of one hash change a similarity by one token).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .groups import bounds, connected_components, probably_in, whole_groups
from .places import stored
from .text import Flat, Schema, Spans, classes, cuts, group_of, lists, map_slices, mix, need_whole_ids, per_group, repeated, windows

SIZE, THRESHOLD, RECALL = 5, 0.8, 1 - 1e-6
DEPTH = 2
#: Sets of a bucket, or of a block of a large one.
BLOCK = 256
_PAIRS = 1 << 20  # pairs that a task looks at together
_SALT = np.uint64(0x9E3779B97F4A7C15)


def runs_needed(threshold: float = THRESHOLD, recall: float = RECALL, depth: int = DEPTH) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**depth))


def shingles(flat: Flat, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of every text (whole-word hashes) and their number."""
    ws, we, counts = flat.words()
    h = Spans(flat.buf).hash(ws, we)
    grams, made = windows(h, counts, size)
    start = np.cumsum(counts) - counts
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        value = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            more = counts[short] > k
            value[more] = value[more] * np.uint64(0x9FB21C651E98DF25) + h[start[short[more]] + k]
        value = mix(value + counts[short].astype(np.uint64) * _SALT)
        grams = np.insert(grams, (np.cumsum(made) - made)[short], value)
        made = made.copy()
        made[short] = 1
    of = group_of(made)
    new = ~repeated(*classes(mix(grams + of.astype(np.uint64) * _SALT), lambda i, j: (grams[i] == grams[j]) & (of[i] == of[j])), first_too=False)
    return grams[new], per_group(new, made)


def digest_of(grams: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A digest of 128 bits of each set, in two halves, whatever the order of its members."""
    ends, out = np.cumsum(n), []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(grams ^ np.uint64(salt)))])
        out.append(mix(total[ends] - total[ends - n] + n.astype(np.uint64) * _SALT).view(np.int64))
    return out[0], out[1]


def _ranks(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(314159)
    draw = lambda: rng.integers(0, 2**63, count, dtype=np.int64).astype(np.uint64)
    return draw() * np.uint64(2) + np.uint64(1), draw()


def signatures(docs: DataFrame, runs: int, size: int, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, d1, d2, n, mins, sketch): d1 and d2 are the digest of the set, mins has the chosen token of every run and depth, sketch 16 bits of each."""
    factor, shift = _ranks(runs * DEPTH)

    def per_slice(part, flat):
        grams, n = shingles(flat, size)
        some = n > 0
        first = (np.cumsum(n) - n)[some]
        mins = np.zeros((flat.n, runs * DEPTH), np.uint64)
        for k in range(runs * DEPTH):
            if len(first):
                mins[some, k] = np.minimum.reduceat((grams ^ shift[k]) * factor[k], first)
        d1, d2 = digest_of(grams, n)
        sketch = ((mins >> np.uint64(20)) & np.uint64(0xFFFF)).astype("<u2")
        return {
            "id": part.column(id_col), "d1": d1, "d2": d2, "n": n,
            "mins": lists(mins.view(np.int64).ravel(), np.full(flat.n, runs * DEPTH), pa.int64()), "sketch": [x.tobytes() for x in sketch],
        }

    schema = Schema(id="long", d1="long", d2="long", n="long", mins="array<long>", sketch="binary")
    return map_slices(docs, [id_col, text_col], text_col, per_slice, schema)


def _leaves(nodes: DataFrame, runs: int) -> DataFrame:
    """Rows (node, run, key, blocks): the bucket of each node in each run in which it is not alone."""
    steps = F.expr(f"transform(sequence(0, {runs - 1}), r -> slice(mins, r * {DEPTH} + 1, {DEPTH}))")
    frame = nodes.where("n > 0").select("node", F.posexplode(steps).alias("run", "mins")).withColumn("key", F.xxhash64("run", F.col("mins")[0]))
    out = None
    for depth in range(1, DEPTH + 1):
        sizes = stored(frame.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
        last = depth == DEPTH or sizes.where(F.col("size") > BLOCK).isEmpty()
        placed = probably_in(frame, sizes, "key").join(sizes, "key")  # most sets are alone in their bucket
        done = placed if last else placed.where(F.col("size") <= BLOCK)
        done = done.select("node", "run", "key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
        out = done if out is None else out.unionByName(done)
        if last:
            return out
        frame = placed.where(F.col("size") > BLOCK).select("node", "run", "mins", F.xxhash64("key", F.lit(depth), F.col("mins")[depth]).alias("key"))
    return out


def _partners(data: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """For every row of sorted groups the range of rows that it is paired with: those after it, or those of the other block."""
    at = bounds(data["g"].to_numpy())
    side = data["side"].to_numpy()
    rows, size = np.arange(len(side)), np.diff(at)
    end = np.repeat(at[1:], size)
    other = np.repeat(at[1:] - np.add.reduceat(side, at[:-1]), size)  # where the second block begins
    begin = np.where(other < end, np.where(side == 0, other, end), rows + 1)
    return begin, end


def _pairs(begin: np.ndarray, end: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    k = end[lo:hi] - begin[lo:hi]
    left = np.repeat(np.arange(lo, hi), k)
    return left, np.repeat(begin[lo:hi], k) + np.arange(len(left)) - np.repeat(np.cumsum(k) - k, k)


def _first_meeting(keys: np.ndarray, run: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether the pair's first common bucket is the one of this run."""
    same = (keys[left] == keys[right]) & (keys[left] != 0)
    return np.argmax(same, 1) == run[left]


def _fixed(column: pa.ChunkedArray, dtype: str) -> np.ndarray:
    """A column of equally long binary values or lists as a matrix."""
    values = column.combine_chunks()
    if pa.types.is_binary(values.type):
        start, width = np.frombuffer(values.buffers()[1], np.int32)[values.offset], len(values[0].as_py())
        return np.frombuffer(values.buffers()[2], np.uint8)[start : start + width * len(values)].view(dtype).reshape(len(values), -1)
    return values.flatten().to_numpy().reshape(len(values), -1)


NEEDED = Schema(g="long", run="int", side="int", node="long")


def _thin(runs: int, threshold: float):
    """Rows that are left in a pair, by set sizes, first meeting and sketch."""
    total = runs * DEPTH
    least = math.floor(total * threshold - 5.7 * math.sqrt(total * threshold * (1 - threshold)))

    def run(batches):
        for data in whole_groups(batches, "g"):
            keys, sketch = _fixed(data["keys"], "int64"), _fixed(data["sketch"], "<u2")
            n, turn = data["n"].to_numpy(), data["run"].to_numpy()
            begin, end = _partners(data)
            cost = np.concatenate([[0], np.cumsum(end - begin)])
            wanted = np.zeros(len(n), bool)
            lo = 0
            while lo < len(n):
                hi = max(lo + 1, int(np.searchsorted(cost, cost[lo] + _PAIRS, "right")) - 1)
                left, right = _pairs(begin, end, lo, hi)
                ok = np.minimum(n[left], n[right]) >= threshold * np.maximum(n[left], n[right]) - 1e-9
                left, right = left[ok], right[ok]
                ok = _first_meeting(keys, turn, left, right)
                left, right = left[ok], right[ok]
                ok = (sketch[left] == sketch[right]).sum(1) >= least
                wanted[left[ok]] = True
                wanted[right[ok]] = True
                lo = hi
            rows = pa.array(np.flatnonzero(wanted))
            yield NEEDED.batch({c: data[c].take(rows) for c in NEEDED.kinds})

    return run


LINKED = Schema(node="long", links="long", texts="long", label="long")


def _common(tokens: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sizes of all intersections of the sets of one group, from a 0/1 matrix of the tokens that two sets or more have."""
    _, of = np.unique(tokens, return_inverse=True)
    seen = np.bincount(of)
    shared = seen > 1
    column = np.cumsum(shared) - 1
    row = np.repeat(np.arange(len(n)), n)
    keep = shared[of]
    row, col = row[keep], column[of[keep]]
    out = np.zeros((len(n), len(n)), np.float32)
    width = max(1, (1 << 21) // len(n))
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for lo in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(col, [lo, lo + width])
        X = np.zeros((len(n), width), np.float32)
        X[row[a:b], col[a:b] - lo] = 1
        out += X @ X.T
    return np.rint(out).astype(np.int64)


def _compare(threshold: float):
    """Exact similarities of the pairs of each group that meet here first; one row for each node with a link."""

    def run(batches):
        for data in whole_groups(batches, "g", rows=2_000):
            at = bounds(data["g"].to_numpy())
            keys, n, turn = _fixed(data["keys"], "int64"), data["n"].to_numpy(), data["run"].to_numpy()
            copies, node = data["copies"].to_numpy(), data["node"].to_numpy()
            begin, end = _partners(data)
            lists_ = data["tokens"].combine_chunks()
            flat, offsets = lists_.flatten().to_numpy(), lists_.offsets.to_numpy() - lists_.offsets[0].as_py()
            out: list[tuple[np.ndarray, ...]] = []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                left, right = _pairs(begin, end, a, b)
                if not len(left):
                    continue
                common = _common(flat[offsets[a] : offsets[b]], n[a:b])[left - a, right - a]
                ok = common * (1 + threshold) >= threshold * (n[left] + n[right]) - 1e-9
                ok[ok] = _first_meeting(keys, turn, left[ok], right[ok])
                left, right = left[ok] - a, right[ok] - a
                if not len(left):
                    continue
                size = b - a
                links = np.bincount(left, copies[a:b][right], size) + np.bincount(right, copies[a:b][left], size)
                texts = np.bincount(left, minlength=size) + np.bincount(right, minlength=size)
                label = node[a:b].copy()
                while True:  # smallest node of each part
                    before = label.copy()
                    np.minimum.at(label, left, before[right])
                    np.minimum.at(label, right, before[left])
                    if (label == before).all():
                        break
                rows = np.flatnonzero(texts)
                out.append((node[a:b][rows], links[rows].astype(np.int64), texts[rows], label[rows]))
            if out:
                yield LINKED.batch(dict(zip(LINKED.kinds, map(np.concatenate, zip(*out, strict=True)), strict=True)))

    return run


def with_tokens(texts: DataFrame, size: int) -> DataFrame:
    """One row of each node from texts whose n-grams are those of the node (an id may have several texts), with tokens in the place
    of the text. The rows of a node stand together in one partition."""
    kept = [f for f in texts.schema.fields if f.name not in ("text", "rep", "d1", "d2")]
    schema = T.StructType([*kept, T.StructField("tokens", T.ArrayType(T.LongType()))])

    def run(batches):
        last = None
        for batch in batches:
            for lo, hi in cuts(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                grams, n = shingles(Flat(part.column("text")), size)
                columns = [*(part.column(f.name) for f in kept), lists(grams.view(np.int64), n, pa.int64())]
                node, (d1, d2) = part.column("node").to_numpy(), digest_of(grams, n)
                mask = (part.column("d1").to_numpy() == d1) & (part.column("d2").to_numpy() == d2)
                fit = np.flatnonzero(mask)
                if len(fit):
                    mask[fit[1:]] = node[fit[1:]] != node[fit[:-1]]
                    mask[fit[0]] = node[fit[0]] != last
                    last = node[fit[-1]]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names).filter(pa.array(mask))

    return texts.mapInArrow(run, schema)


def similarity_classes(docs: DataFrame, size: int = SIZE, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, class_id, n_links, n_copies): class_id is the smallest id of the documents tied by links; n_links counts
    the other documents of similarity `threshold` or more, copies included; n_copies the documents of the same set."""
    need_whole_ids(docs, id_col)
    runs = runs_needed(threshold, recall)
    named = docs.where(F.col(id_col).isNotNull())
    sig = stored(signatures(named, runs, size, id_col, text_col), "signatures")
    best = F.min_by(F.struct("n", "mins", "sketch"), "id").alias("x")
    nodes = sig.groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), best).select("d1", "d2", "rep", "copies", "x.*")
    # the number of a row of a stored table is a short name without collisions
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    leaves = _leaves(nodes, runs)
    of_run = lambda c, r: F.max(F.when(F.col("run") == r, F.col(c)))
    paths = leaves.groupBy("node").agg(F.array(*(of_run("key", r) for r in range(runs))).alias("path"), F.array(*(of_run("blocks", r) for r in range(runs))).alias("blocks"))
    candidates = nodes.drop("mins").join(paths, "node").withColumn("keys", F.transform("path", lambda k: F.coalesce(k.bitwiseOR(F.lit(1)), F.lit(0))))  # 0: alone in the bucket of that run
    candidates = stored(candidates, "candidates")
    each = F.explode(F.filter(F.sequence(F.lit(0), F.lit(runs - 1)), lambda r: F.get("path", r).isNotNull()))
    rows = candidates.withColumn("run", each).withColumns({"key": F.get("path", F.col("run")), "nb": F.get("blocks", F.col("run"))})
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    rows = rows.withColumns({"g": F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")), "side": (F.col("own") > F.col("other")).cast("int")})
    grouped = rows.select("g", "side", "run", "node", "n", "keys", "sketch").repartition("g").sortWithinPartitions("g", "side", "node")
    needed = stored(grouped.mapInArrow(_thin(runs, threshold), NEEDED.spark), "needed")
    places_ = needed.groupBy("node").agg(F.collect_list(F.struct("g", "side", "run")).alias("places"))  # at most runs * blocks of its bucket
    wanted = stored(candidates.select("node", "d1", "d2", "rep", "n", "copies", "keys").join(places_, "node"), "wanted")
    texts = probably_in(docs.select(F.col(id_col).alias("rep"), F.col(text_col).alias("text")), wanted, "rep").join(wanted, "rep")
    # rows that repeat; other texts of an id stay until their n-grams are compared with the node's. The window keeps rows of a node together.
    again = F.lag("h").over(Window.partitionBy("rep", "node").orderBy("h")).eqNullSafe(F.col("h"))
    texts = texts.withColumn("h", F.xxhash64("text")).withColumn("again", again).where("not again").drop("h", "again")
    compared = with_tokens(texts, size).select(F.inline("places"), "node", "n", "copies", "keys", "tokens")
    compared = compared.repartition("g").sortWithinPartitions("g", "side", "node")
    linked = stored(compared.mapInArrow(_compare(threshold), LINKED.spark), "linked")
    roots = connected_components(linked.select(F.col("node").alias("u"), F.col("label").alias("v")))
    links = linked.groupBy("node").agg(F.sum("links").alias("links"))
    joined = nodes.select("node", "d1", "d2", "rep", "copies").join(links, "node", "left").join(roots.withColumnRenamed("u", "node"), "node", "left")
    joined = joined.withColumn("root", F.when(F.col("links").isNotNull(), F.coalesce("root", "node")))
    classes = joined.where("root is not null").groupBy("root").agg(F.min("rep").alias("class_id"))
    info = joined.join(classes, "root", "left").select(
        "d1", "d2", "copies", F.coalesce("class_id", "rep").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
    )
    out = sig.select("id", "d1", "d2").join(info, ["d1", "d2"]).select(F.col("id").alias(id_col), "class_id", "n_links", F.col("copies").alias("n_copies"))
    nameless = docs.where(F.col(id_col).isNull()).select(F.lit(None).cast("long").alias(id_col), F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"))
    return out.unionByName(nameless)


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one document of each class, that of the smallest id, and once of rows that repeat. Rows without an id stay."""
    classes = similarity_classes(docs, id_col=id_col, text_col=text_col, **options)
    first = classes.where(F.col(id_col) == F.col("class_id")).select(F.col(id_col).alias("id")).distinct()
    kept = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).join(first, "id", "left_semi")
    copy = F.row_number().over(Window.partitionBy("id", "h").orderBy("h")).alias("copy")
    return kept.select("row", copy).where("copy = 1").select("row.*").unionByName(docs.where(F.col(id_col).isNull()))
