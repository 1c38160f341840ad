"""Bounded samples of labelled documents, and calibration of scores."""

from __future__ import annotations

import collections

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Remainders of crc32(id as text) modulo 4: one is held out, one calibrates, the others train.
FOLDS, HELD_OUT, CALIBRATION = 4, 2, 3


def fold(id_col: str = "doc_id"):
    return (F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS).cast("int")


#: Bytes of the texts of a class and fold in a sample, but for one text that goes beyond.
SAMPLE_BYTES = 8 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, id_col: str = "doc_id", text_col: str = "text", group_col: str | None = None) -> pa.Table:
    """At most per_class labelled documents, and about SAMPLE_BYTES, of each class and fold that is not held out, chosen by a hash of the id.

    The bounds do not depend on the input, so the chosen ids are broadcast and the texts go to the driver. An id with
    both labels is left out; of documents with one id the smallest text is taken.
    Columns: text, y, fold, group (null without group_col), weight (rows of the class and fold for each one chosen).
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).where("y in (0, 1) and id is not null")
    known = known.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("other")).where("y = other").drop("other")
    known = known.withColumn("fold", F.coalesce(fold("id"), F.lit(HELD_OUT))).where(F.col("fold") != HELD_OUT)
    sizes = {(r["y"], r["fold"]): r["n"] for r in known.groupBy("y", "fold").agg(F.count("*").alias("n")).collect()}
    parts = []
    for (y, k), _ in sorted(sizes.items()):
        parts.append(known.where((F.col("y") == y) & (F.col("fold") == k)).orderBy(F.xxhash64("id"), "id").limit(per_class))
    group = F.col(group_col).cast("string") if group_col else F.lit(None).cast("string")
    kind = pa.schema([("text", pa.string()), ("y", pa.int32()), ("fold", pa.int32()), ("group", pa.string()), ("weight", pa.float64())])
    if not parts:
        return kind.empty_table()
    chosen = parts[0]
    for p in parts[1:]:
        chosen = chosen.unionByName(p)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), group.alias("group"))
    found = texts.join(F.broadcast(chosen), "id").groupBy("id", "y", "fold").agg(F.min(F.struct("text", "group")).alias("x")).select("id", "y", "fold", "x.*")
    before = Window.partitionBy("y", "fold").orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, -1)  # at most per_class rows
    found = found.withColumn("before", F.coalesce(F.sum(F.octet_length("text")).over(before), F.lit(0))).where(F.col("before") < SAMPLE_BYTES)
    got = found.select("text", "y", "fold", "group").toArrow()
    held = collections.Counter(zip(got["y"].to_pylist(), got["fold"].to_pylist(), strict=True))
    weight = [max(1.0, sizes[y, k] / held[y, k]) for y, k in zip(got["y"].to_pylist(), got["fold"].to_pylist(), strict=True)]
    return got.append_column("weight", pa.array(weight, pa.float64())).cast(kind)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def platt(z: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope and intercept of a weighted logistic fit of y on z, lightly penalised, by Newton steps."""
    if not len(z) or y.min() == y.max():
        return 1.0, 0.0
    scale = max(float(np.abs(z).mean()), 1e-6)
    X = np.stack([z / scale, np.ones(len(z))], 1)
    beta = np.zeros(2)
    for _ in range(rounds):
        p = sigmoid(X @ beta)
        w = weight * p * (1 - p)
        step = np.linalg.solve((X * w[:, None]).T @ X + np.diag([0.5, 1e-3]), X.T @ (weight * (y - p)) - np.array([0.5, 1e-3]) * beta)
        beta += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0] / scale), float(beta[1])


def best_threshold(p: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The cut of highest F1, in the middle of the gap that it falls into."""
    order = np.argsort(-p, kind="stable")
    q, hit, all_ = p[order], np.cumsum((weight * y)[order]), np.cumsum(weight[order])
    ends = np.append(q[1:] != q[:-1], True)
    f1 = np.where(ends, 2 * hit / (all_ + (weight * y).sum()), -1)
    k = int(np.argmax(f1))
    return float((q[k] + (q[k + 1] if k + 1 < len(q) else 0)) / 2)
