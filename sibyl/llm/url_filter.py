"""URL filter: rules by host and path, and a ratio of character language models over the whole URL for the rest.

URLs that an allow or a block rule decides are the examples of two variable-order Markov models over a fixed
alphabet. The models read each URL from its scheme to its fragment; only the rules stop at host and path. Counts of every order come from all such URLs, in Spark; orders are blended by Witten-Bell weights. The
score of a URL is the difference of its log likelihoods for each character, and the cut is calibrated on a quarter
of the examples that the counts leave out. With `order` symbols of 40, a model has at most 40^4 = 2,560,000
entries, whatever the input, so it is broadcast.

Defined results: null URLs and those without `://` have an empty host and path and no rule; null and empty URLs
have the score 0; without examples of both kinds every undecided URL is allowed; repeated rows are judged alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import Flat, Schema, cuts

SYMBOLS = "abcdefghijklmnopqrstuvwxyz0./-_?=&#%:~+"  # any digit is 0; all else is one more symbol
SIZE = 40
ORDER = 4
BINS = 2000  # of the histogram of scores, from -LIMIT to LIMIT
LIMIT = 10.0
_CODE = np.full(256, SIZE - 1, np.int64)
for _i, _c in enumerate(SYMBOLS):
    _CODE[ord(_c)] = _i
_CODE[65:91], _CODE[48:58] = _CODE[97:123], SYMBOLS.index("0")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first `://`: up to / ? # or the end, A-Z lower-cased; then up to ? # or the end. Empty without one."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(url, "://", 1)).otherwise(F.lit(None))
    after = F.coalesce(F.substring(url, F.length(rest) + 4, F.length(url)), F.lit(""))
    host = F.regexp_extract(after, r"^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def judged_by_rules(urls: DataFrame, rules: list[tuple[str, str]], url_col: str = "url") -> DataFrame:
    """urls with host, path, and the longest fitting rule and its verdict (null where none fits). rules: (verdict, 'host/path')."""
    host, path = host_and_path(F.col(url_col))
    out = urls.withColumns({"host": host, "path": path})
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest comes last and so wins
        h, slash, p = text.partition("/")
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(slash + p)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return out.withColumns({"rule": rule, "rule_verdict": verdict})


def _grams(flat: Flat) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code of every symbol with the ORDER - 1 before it (missing ones: the last symbol), how many stand before it, and symbols of each text."""
    inside = np.ones(len(flat.buf), bool)
    inside[flat.end] = False
    counts = flat.end - flat.start
    code = _CODE[flat.buf[inside]]
    depth = np.arange(len(code)) - np.repeat(np.cumsum(counts) - counts, counts)
    gram = code.copy()
    for k in range(1, ORDER):
        before = np.full(len(code), SIZE - 1, np.int64)
        before[k:] = code[:-k] if k < len(code) else before[k:]
        before[depth < k] = SIZE - 1
        gram += before * SIZE**k
    return gram, depth, counts


@dataclass
class UrlModel:
    ratio: np.ndarray  # log likelihood difference of each gram (accepted less rejected)
    cut: float = 0.0

    def score(self, flat: Flat) -> np.ndarray:
        gram, _, counts = _grams(flat)
        total = np.concatenate([[0], np.cumsum(self.ratio[gram].astype(np.float64))])
        ends = np.cumsum(counts)
        return (total[ends] - total[ends - counts]) / np.maximum(counts, 1)


def blended(counts: np.ndarray) -> np.ndarray:
    """Witten-Bell blend of all orders, from counts of the longest grams: log probability of each gram's last symbol."""
    full = counts.reshape([SIZE] * ORDER).astype(np.float64)
    p = np.full([SIZE], 1 / SIZE)
    for order in range(1, ORDER + 1):
        n = full.sum(tuple(range(ORDER - order))) if order < ORDER else full
        total, kinds = n.sum(-1, keepdims=True), (n > 0).sum(-1, keepdims=True)
        with np.errstate(invalid="ignore", divide="ignore"):
            mixed = (n + kinds * p[None] if order > 1 else n + kinds * p) / (total + kinds)
        p = np.where(total > 0, mixed, p[None] if order > 1 else p)
    return np.log(p).ravel()


def _whole(url_col: str) -> Column:
    return F.coalesce(F.col(url_col), F.lit(""))


def fit(judged: DataFrame, url_col: str = "url") -> UrlModel:
    """Models from all URLs that a rule decides: three quarters give the counts, one quarter the cut. URLs of one host and path stay on one side."""
    apart = (F.crc32(F.concat("host", "path").cast("binary")) % 4 == 3).cast("int")
    examples = judged.where("rule_verdict is not null").select(_whole(url_col).alias("text"), (F.col("rule_verdict") == "allow").cast("int").alias("kind"), apart.alias("apart"))
    schema = Schema(kind="int", gram="long", n="long")

    def count(batches):
        for batch in batches:
            for lo, hi in cuts(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                gram, _, counts = _grams(Flat(part.column("text")))
                kind = np.repeat(part.column("kind").to_numpy().astype(np.int64), counts)
                key, n = np.unique(kind * SIZE**ORDER + gram, return_counts=True)
                yield schema.batch({"kind": key // SIZE**ORDER, "gram": key % SIZE**ORDER, "n": n})

    sums = examples.where("apart = 0").select("text", "kind").mapInArrow(count, schema.spark).groupBy("kind", "gram").agg(F.sum("n").alias("n")).toArrow()  # at most 2 * 40^4 rows
    tables = np.zeros((2, SIZE**ORDER), np.int64)
    tables[sums["kind"].to_numpy(), sums["gram"].to_numpy()] = sums["n"].to_numpy()
    if not tables.any(1).all():
        return UrlModel(np.zeros(SIZE**ORDER, np.float32), -1.0)
    model = UrlModel((blended(tables[1]) - blended(tables[0])).astype(np.float32))
    scored = scores(examples.where("apart = 1"), model, ["kind"])
    bins = scored.groupBy("kind", F.floor((F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), "score")) + LIMIT) * (BINS / (2 * LIMIT))).cast("int").alias("bin")).agg(F.count("*").alias("n")).collect()
    seen = np.zeros((2, BINS + 1))
    for row in bins:
        seen[row["kind"], row["bin"]] += row["n"]
    share = seen / np.maximum(seen.sum(1, keepdims=True), 1)
    # allowed from the cut on: the highest mean of both kinds' rates, in the middle of equal places
    gain = np.concatenate([[0], np.cumsum(share[0])]) + np.concatenate([[1], 1 - np.cumsum(share[1])])
    top = np.flatnonzero(gain >= gain.max() - 1e-12)
    model.cut = float((top[0] + top[-1]) / 2 * (2 * LIMIT / BINS) - LIMIT) if seen.any(1).all() else 0.0
    return model


def scores(df: DataFrame, model: UrlModel, keep: list[str]) -> DataFrame:
    """Columns `keep` and the score of the column text."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    from pyspark.sql import types as T

    fields = [f for f in df.schema.fields if f.name in keep]

    def run(batches):
        for batch in batches:
            for lo, hi in cuts(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in fields), pa.array(shared.value.score(Flat(part.column("text"))))], names=[*(f.name for f in fields), "score"])

    return df.select(*(f.name for f in fields), "text").mapInArrow(run, T.StructType([*fields, T.StructField("score", T.DoubleType())]))


def filter_urls(urls: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Rows (id, host, path, rule, verdict, score)."""
    judged = judged_by_rules(urls.select(id_col, url_col), rules, url_col)
    model = fit(judged, url_col)
    scored = scores(judged.withColumn("text", _whole(url_col)), model, [id_col, "host", "path", "rule", "rule_verdict"])
    verdict = F.coalesce("rule_verdict", F.when(F.col("score") >= model.cut, "allow").otherwise("block"))
    return scored.select(id_col, "host", "path", "rule", verdict.alias("verdict"), "score")
