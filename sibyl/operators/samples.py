"""How soon a mean can be trusted: random splits of rows, and second halves foretold from first halves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import beside, quantiles


def correlation(x: str, y: str) -> Column:
    """Correlation; null where one of the two does not vary, on which corr raises."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when((F.stddev_pop(x) > 1e-9) & (F.stddev_pop(y) > 1e-9), F.try_divide(F.covar_pop(x, y), spread))


def split_reliability(df: DataFrame, key: Sequence[str], row: str, value: str, sizes: Sequence[int], draws: int = 20, seed: int = 7) -> DataFrame:
    """Rows (n, reliability, half_at): the correlation over keys of the means of two disjoint random sets of n rows, averaged over
    draws, and the number of rows at which it would reach one half (Spearman-Brown; null unless it is positive).

    A draw orders the rows of a key by a digest of seed, draw and `row`, a name of the row. Only the first 2 max(sizes) of each key and draw
    are wanted, so tasks drop the others before the shuffle. Keys with fewer rows with a value are left out.
    """
    most = 2 * max(sizes)
    rows = df.where(F.col(value).isNotNull()).select(*key, F.col(row).alias("_row"), F.col(value).cast("double").alias("_v"))
    drawn = rows.withColumn("_draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    digest = F.md5(F.concat_ws(":", F.lit(seed), "_draw", F.col("_row").cast("string")))
    ranked = drawn.withColumn("_r", F.row_number().over(Window.partitionBy(*key, "_draw").orderBy(digest, "_row"))).where(F.col("_r") <= most)
    mean = lambda lo, hi: F.avg(F.when((F.col("_r") > lo) & (F.col("_r") <= hi), F.col("_v")))
    pairs = ranked.groupBy(*key, "_draw").agg(F.count("*").alias("_n"), *(x for n in sizes for x in (mean(0, n).alias(f"_a{n}"), mean(n, 2 * n).alias(f"_b{n}")))).where(F.col("_n") == most)
    of_draw = pairs.groupBy("_draw").agg(*(correlation(f"_a{n}", f"_b{n}").alias(f"_c{n}") for n in sizes))
    means = of_draw.agg(*(F.avg(f"_c{n}").alias(f"_c{n}") for n in sizes))
    out = means.select(F.inline(F.array(*(F.struct(F.lit(n).alias("n"), F.col(f"_c{n}").alias("reliability")) for n in sizes))))
    return out.withColumn("half_at", F.when(F.col("reliability") > 0, F.col("n") * (1 - F.col("reliability")) / F.col("reliability")))


def pooled(prior: Column, prior_weight: Column, seen: Column, weight: Column, level: float, k: float) -> Column:
    """Mean of a level worth k, the prior and what was seen, each by its weight."""
    return (k * level + prior_weight * prior + weight * seen) / (k + prior_weight + weight)


def half_estimates(df: DataFrame, key: Sequence[str], season: str, day: str, value: str, weight: str, level: float, k: float, least: float) -> DataFrame:
    """Rows (key, season, w0, w1, w2, target, frozen, pooled, season_only) of members seen in both halves of a season.

    A season is cut at its median day, whose rows are of the second half. target is the weighted mean of the second half; the estimates are last
    season's mean shrunk to the level, the same with the first half, and the first half alone. w0 is last season's weight (0 without one), w1
    and w2 those of the halves; members with a w2 below `least` are left out.
    """
    d = df.where(F.col(value).isNotNull() & F.col(weight).isNotNull())
    cut = quantiles(d, [season], F.col(day).cast("double"), {"_cut": 0.5})
    late = F.col(day) >= F.floor("_cut")
    part = lambda at, name: (F.sum(F.when(at, F.col(value) * F.col(weight))).alias(f"_s{name}"), F.sum(F.when(at, F.col(weight))).alias(f"_w{name}"))
    sums = beside(d, cut, [season], ["_cut"]).groupBy(*key, season).agg(*part(~late, 1), *part(late, 2))
    last = sums.select(*key, (F.col(season) + 1).alias(season), (F.coalesce("_s1", F.lit(0.0)) + F.coalesce("_s2", F.lit(0.0))).alias("_s0"), (F.coalesce("_w1", F.lit(0.0)) + F.coalesce("_w2", F.lit(0.0))).alias("_w0"))
    rows = beside(sums.where(F.col("_w1") > 0).where(F.col("_w2") >= least).where("_w2 > 0"), last, [*key, season], ["_s0", "_w0"])
    w0, seen = F.coalesce("_w0", F.lit(0.0)), F.col("_s1") / F.col("_w1")
    prior = F.when(F.col("_w0") > 0, F.col("_s0") / F.col("_w0")).otherwise(level)
    none = F.lit(0.0)
    return rows.select(
        *key, season, w0.alias("w0"), F.col("_w1").alias("w1"), F.col("_w2").alias("w2"), (F.col("_s2") / F.col("_w2")).alias("target"),
        pooled(prior, w0, none, none, level, k).alias("frozen"), pooled(prior, w0, seen, F.col("_w1"), level, k).alias("pooled"), seen.alias("season_only"),
    )


def by_experience(estimates: DataFrame, edges: Sequence[float], least_rows: int = 20) -> DataFrame:
    """Rows (experience, estimate, n, mae, corr): how well each estimate foretells the target, errors weighted by the second half, by last
    season's weight: 0 for none, then one more at each edge that it reaches. Groups under least_rows are left out."""
    reached = sum(((F.col("w0") >= e).cast("int") for e in edges), F.lit(1))
    kinds = ("frozen", "pooled", "season_only")
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("estimate"), F.col(n).alias("v")) for n in kinds))).alias("x")
    long = estimates.select(F.when(F.col("w0") > 0, reached).otherwise(0).alias("experience"), "w2", "target", each).select("experience", "w2", "target", "x.*")
    out = long.groupBy("experience", "estimate").agg(F.count("*").alias("n"), (F.sum(F.col("w2") * F.abs(F.col("v") - F.col("target"))) / F.sum("w2")).alias("mae"), correlation("v", "target").alias("corr"))
    return out.where(F.col("n") >= least_rows)
