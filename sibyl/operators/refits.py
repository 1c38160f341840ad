"""Least squares with any number of regressors from sums by day.

Rows are read once: each day's X'X, X'y, y'y and counts are one packed array of k(k + 1)/2 + k + 2 numbers, k with the intercept. What is
fitted, a slate's past, an aged past, many half-lives or a bootstrap replicate, is a weighted sum of such arrays, made by windows and
groups over days, which are few beside rows. An Arrow pass solves each sum where it is, so no coefficients go to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .resample import replicates


def width(k: int) -> int:
    return k * (k + 1) // 2 + k + 2


def packed_sums(df: DataFrame, by: Sequence[str], x: Sequence[str | Column], y: str | Column) -> DataFrame:
    """Rows (by, sums): X'X by rows of its upper half, X'y, y'y and the count, the intercept last in X. Rows with a null are left out."""
    cols = [*(F.col(c) if isinstance(c, str) else c for c in x), F.lit(1.0)]
    named = df.select(*by, *(c.cast("double").alias(f"_x{i}") for i, c in enumerate(cols)), (F.col(y) if isinstance(y, str) else y).cast("double").alias("_y")).dropna(subset=[*(f"_x{i}" for i in range(len(cols))), "_y"])
    xs = [F.col(f"_x{i}") for i in range(len(cols))]
    parts = [*(xs[i] * xs[j] for i in range(len(xs)) for j in range(i, len(xs))), *(c * F.col("_y") for c in xs), F.col("_y") * F.col("_y"), F.lit(1.0)]
    s = named.groupBy(*by).agg(*(F.sum(p).alias(f"_s{i}") for i, p in enumerate(parts)))
    return s.select(*by, F.array(*(f"_s{i}" for i in range(len(parts)))).alias("sums"))


def _each(f, size: int, sums: str = "sums") -> Column:
    return F.array(*(f(F.col(sums)[i]) for i in range(size)))


def cumulated(daily: DataFrame, day: str, size: int, by: Sequence[str] = (), half_life: str | None = None) -> DataFrame:
    """Sums of strictly earlier days beside each day. half_life: a column of days after which a day counts half; its sums grow by
    2^(day / half-life) from the first day on, so a key may span some thousand half-lives at most."""
    past = Window.partitionBy(*by).orderBy(day).rangeBetween(Window.unboundedPreceding, -1)
    if half_life is None:
        return daily.withColumn("sums", _each(lambda c: F.sum(c).over(past), size))
    since = F.col(day) - F.min(day).over(Window.partitionBy(*by))
    grown = daily.withColumn("_g", F.pow(F.lit(2.0), since / F.col(half_life))).withColumn("sums", _each(lambda c: c * F.col("_g"), size))
    return grown.withColumn("sums", _each(lambda c: F.sum(c).over(past), size)).withColumn("sums", _each(lambda c: c / F.col("_g"), size)).drop("_g")


def unpacked(sums: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """X'X, X'y, y'y and weights of rows of packed sums."""
    upper = np.triu_indices(k)
    xx = np.zeros((len(sums), k, k))
    xx[:, upper[0], upper[1]] = xx[:, upper[1], upper[0]] = sums[:, : len(upper[0])]
    at = len(upper[0])
    return xx, sums[:, at : at + k], sums[:, at + k], sums[:, at + k + 1]


def solve_all(xx: np.ndarray, xy: np.ndarray, ridge: float = 0.0) -> np.ndarray:
    """Coefficients of every block, nan where X'X is singular; columns are scaled first, so units do not matter."""
    k = xx.shape[1]
    scale = np.sqrt(np.maximum(np.einsum("nii->ni", xx), 1e-300))
    a = xx / scale[:, :, None] / scale[:, None, :] + ridge * np.eye(k)
    ok = np.linalg.eigvalsh(a)[:, 0] > 1e-10 if len(a) else np.zeros(0, bool)
    out = np.full(xy.shape, np.nan)
    if ok.any():
        low = np.linalg.cholesky(a[ok])
        half = np.linalg.solve(low, (xy / scale)[ok][:, :, None])
        out[ok] = np.linalg.solve(low.transpose(0, 2, 1), half)[:, :, 0] / scale[ok]
    return out


def _block(column: pa.Array, size: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, size)


def solved(df: DataFrame, k: int, least: float = 0.0, ridge: float = 0.0) -> DataFrame:
    """df with coef, the coefficients of its sums (the intercept last), null where there are too few rows or no single answer; sums is dropped."""
    keep = [c for c in df.columns if c != "sums"]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("coef", T.ArrayType(T.DoubleType()))])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            xx, xy, _, n = unpacked(_block(batch.column("sums"), width(k)), k)
            coef = solve_all(xx, xy, ridge)
            good = np.isfinite(coef).all(1) & (n >= least)
            lists = pa.array([c.tolist() if g else None for c, g in zip(coef, good, strict=True)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), lists.cast(arrow.field("coef").type)], schema=arrow)

    return df.where(F.col("sums").isNotNull() & F.forall("sums", lambda v: v.isNotNull())).select(*keep, "sums").mapInArrow(run, schema)


def slate_refits(df: DataFrame, x: Sequence[str], y: str, season: str, day: str, least: int = 50) -> DataFrame:
    """Rows (season, day, train_rows, coef): each slate's fit on all earlier seasons and the earlier slates of its own. Windows are over the
    days of one season; seasons before it are one row each."""
    k = len(x) + 1
    size = width(k)
    daily = packed_sums(df, [season, day], x, y)
    own = cumulated(daily, day, size, [season])
    each = daily.groupBy(season).agg(*(F.sum(F.col("sums")[i]).alias(f"_s{i}") for i in range(size)))
    before = Window.orderBy(season).rowsBetween(Window.unboundedPreceding, -1)  # a row a season
    prior = each.select(season, F.array(*(F.coalesce(F.sum(f"_s{i}").over(before), F.lit(0.0)) for i in range(size))).alias("prior"))
    both = own.join(prior, season).select(season, day, F.array(*(F.coalesce(F.col("sums")[i], F.lit(0.0)) + F.col("prior")[i] for i in range(size))).alias("sums"))
    return solved(both.withColumn("train_rows", F.round(F.col("sums")[size - 1]).cast("long")), k, least)


def aged_refits(df: DataFrame, x: Sequence[str], y: str, day: str, half_lives: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Rows (by, half_life, day, weight, coef): each day's fit on earlier days, aged by each half-life. One scan: the days' sums are
    copied for each half-life, not the rows."""
    k = len(x) + 1
    daily = packed_sums(df, [*by, day], x, y).withColumn("half_life", F.explode(F.array(*map(F.lit, map(float, half_lives)))))
    aged = cumulated(daily, day, width(k), [*by, "half_life"], "half_life")
    return solved(aged.withColumn("weight", F.col("sums")[width(k) - 1]), k)


def prediction(x: Sequence[str], coef: str = "coef") -> Column:
    out = F.col(coef)[len(x)]
    for i, c in enumerate(x):
        out = out + F.col(coef)[i] * F.col(c)
    return out


def ablation(df: DataFrame, x: Sequence[str], y: str, fold: str) -> DataFrame:
    """Rows (fold, features, n, rmse, added): every subset of the features fitted on earlier folds and scored on its fold, with what its squared
    error adds to that of all features. Subsets are sub-blocks of the folds' sums, so 2^k arms cost one scan."""
    k = len(x) + 1
    size = width(k)
    own = packed_sums(df, [fold], x, y)
    before = Window.orderBy(fold).rowsBetween(Window.unboundedPreceding, -1)  # a row a fold
    both = own.select(fold, F.col("sums").alias("test"), _each(lambda c: F.sum(c).over(before), size).alias("train")).where(F.col("train")[0].isNotNull())
    schema = T.StructType([df.schema[fold], *(T.StructField(n, t) for n, t in (("features", T.StringType()), ("n", T.LongType()), ("rmse", T.DoubleType()), ("added", T.DoubleType())))])
    arrow = to_arrow_schema(schema)
    subsets = [s for n in range(k) for s in combinations(range(k - 1), n)]

    def run(batches):
        for batch in batches:
            (xx, xy, _, _), (zz, zy, yy, n) = (unpacked(_block(batch.column(c), size), k) for c in ("train", "test"))
            mse = {}
            for s in subsets:
                at = [*s, k - 1]
                b = solve_all(xx[:, at][:, :, at], xy[:, at])
                mse[s] = (yy - 2 * np.einsum("ni,ni->n", b, zy[:, at]) + np.einsum("ni,nij,nj->n", b, zz[:, at][:, :, at], b)) / n
            for s in subsets:
                names = ",".join(x[i] for i in s)
                columns = [batch.column(fold), pa.array([names] * len(n)), pa.array(np.round(n).astype(np.int64)), pa.array(np.sqrt(np.maximum(mse[s], 0))), pa.array(mse[s] - mse[subsets[-1]])]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return both.mapInArrow(run, schema)


def coefficient_bootstrap(df: DataFrame, block: str, x: Sequence[str], y: str, draws: int = 200, seed: int = 13) -> DataFrame:
    """Rows (term, coef, se): mean and error of each coefficient over draws of whole blocks, from the blocks' sums."""
    k = len(x) + 1
    size = width(k)
    sums = packed_sums(df, [block], x, y).select(block, *(F.col("sums")[i].alias(f"_s{i}") for i in range(size)))
    reps = replicates(sums, block, draws, seed).groupBy("rep").agg(*(F.sum(F.col("k") * F.col(f"_s{i}")).alias(f"_s{i}") for i in range(size)))
    fits = solved(reps.select("rep", F.array(*(f"_s{i}" for i in range(size))).alias("sums")), k)
    one = fits.where("coef is not null").select(F.posexplode("coef").alias("i", "b"))
    names = F.array(*(F.lit(n) for n in [*x, "one"]))
    return one.groupBy("i").agg(F.avg("b").alias("coef"), F.stddev_samp("b").alias("se")).select(names[F.col("i")].alias("term"), "coef", "se")
