"""Seeded resampling (R01-R05). Clusters are summed first; replicates are made from those sums, so the cost is clusters
times replicates and not rows times replicates. Draws are hashes of (seed, replicate, cluster): the same on every run
and on every partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of a digest that other engines have too."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(p.cast("string") for p in parts))), 1, 13), 16, 10).cast("double") / float(1 << 52)


def poisson_cuts() -> list[float]:
    """Chances that a Poisson number of mean 1 is at most 0, 1, .. 7."""
    total, term, cuts = 0.0, 0.36787944117144233, []
    for k in range(8):
        total += term
        cuts.append(total)
        term /= k + 1
    return cuts


def poisson_weight(u: Column) -> Column:
    """How often a cluster is drawn: Poisson of mean 1 by inversion (the limit of multinomial counts)."""
    out = F.lit(8)
    for k, c in reversed(list(enumerate(poisson_cuts()))):
        out = F.when(u < c, k).otherwise(out)
    return out.cast("double")


def replicates(sums: DataFrame, cluster: str, draws: int, seed: int) -> DataFrame:
    return sums.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("k", poisson_weight(uniform(F.lit(seed), F.col("rep"), F.col(cluster))))


def paired_bootstrap(df: DataFrame, cluster: str, a: str, b: str, draws: int = 200, seed: int = 11, by: Sequence[str] = ()) -> DataFrame:
    """Mean difference a - b with a percentile interval over draws of clusters."""
    sums = df.groupBy(*by, cluster).agg(F.sum(F.col(a) - F.col(b)).alias("s"), F.count("*").alias("n"))
    reps = replicates(sums, cluster, draws, seed).groupBy(*by, "rep").agg((F.sum(F.col("k") * F.col("s")) / F.nullif(F.sum(F.col("k") * F.col("n")), F.lit(0.0))).alias("m"))
    point = sums.groupBy(*by).agg((F.sum("s") / F.sum("n")).alias("mean"))
    out = reps.groupBy(*by).agg(F.percentile("m", F.lit(0.025)).alias("lo"), F.percentile("m", F.lit(0.975)).alias("hi"), F.stddev_samp("m").alias("se"))
    return point.join(out, list(by)) if by else point.join(F.broadcast(out))


def argmin_bootstrap(losses: DataFrame, cluster: str, grid: str, loss: str, draws: int = 200, seed: int = 12) -> DataFrame:
    """How often each grid point has the least loss over draws of clusters."""
    sums = losses.groupBy(cluster, grid).agg(F.sum(loss).alias("s"))
    reps = replicates(sums, cluster, draws, seed).groupBy("rep", grid).agg(F.sum(F.col("k") * F.col("s")).alias("l"))
    best = reps.groupBy("rep").agg(F.min(F.struct(F.col("l"), F.col(grid).alias("g")))["g"].alias(grid))
    return best.groupBy(grid).agg(F.count("*").alias("times"))


def slope_bootstrap(df: DataFrame, block: str, x: str, y: str, draws: int = 200, seed: int = 13) -> DataFrame:
    """Error of a slope over draws of blocks, from the blocks' sums."""
    a, b = F.col(x), F.col(y)
    sums = df.groupBy(block).agg(F.count("*").alias("n"), F.sum(a).alias("sx"), F.sum(b).alias("sy"), F.sum(a * a).alias("sxx"), F.sum(a * b).alias("sxy"))
    w = lambda c: F.sum(F.col("k") * F.col(c))
    reps = replicates(sums, block, draws, seed).groupBy("rep").agg(((w("n") * w("sxy") - w("sx") * w("sy")) / F.nullif(w("n") * w("sxx") - w("sx") * w("sx"), F.lit(0.0))).alias("slope"))
    return reps.agg(F.avg("slope").alias("slope"), F.stddev_samp("slope").alias("se"))


def sign_flips(df: DataFrame, row: str, cell: str, value: str, draws: int = 200, seed: int = 14) -> DataFrame:
    """Largest |z| over cells against its distribution when every cluster's sign is flipped at random."""
    sums = df.groupBy(row, cell).agg(F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))
    z = lambda s, q: F.abs(F.sum(s)) / F.nullif(F.sqrt(F.sum(q)), F.lit(0.0))
    seen = sums.groupBy(cell).agg(z(F.col("s"), F.col("q")).alias("z")).agg(F.max("z").alias("z_max"))
    flip = F.when(uniform(F.lit(seed), F.col("rep"), F.col(row)) < 0.5, -1.0).otherwise(1.0)
    reps = sums.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("f", flip * F.col("s")).groupBy("rep", cell).agg(z(F.col("f"), F.col("q")).alias("z")).groupBy("rep").agg(F.max("z").alias("m"))
    return reps.join(F.broadcast(seen)).agg(F.first("z_max").alias("z_max"), F.avg((F.col("m") >= F.col("z_max")).cast("double")).alias("p_value"), F.percentile("m", F.lit(0.95)).alias("z_95"))
