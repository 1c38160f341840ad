"""Model fits (M01-M21) from distributed normal equations.

Rows never leave the executors: one grouped sum gives X'WX, X'Wy, y'Wy and the weights of every fold, and only
those k by k blocks (k of tens) go to the driver, where they are solved. Iterated fits run one such sum a step.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.normal import norm_cdf, norm_ppf
from ..functions.prices import brier, log_loss
from .tables import stored


@dataclass
class Gram:
    """Sums of one fold."""

    xx: np.ndarray
    xy: np.ndarray
    yy: float
    n: float
    w: float
    w2: float

    def __add__(self, o: Gram) -> Gram:
        return Gram(self.xx + o.xx, self.xy + o.xy, self.yy + o.yy, self.n + o.n, self.w + o.w, self.w2 + o.w2)

    def __sub__(self, o: Gram) -> Gram:
        return Gram(self.xx - o.xx, self.xy - o.xy, self.yy - o.yy, self.n - o.n, self.w - o.w, self.w2 - o.w2)


def gram_columns(x: Sequence[Column], y: Column, weight: Column | None = None, intercept: bool = True) -> list[Column]:
    w = weight if weight is not None else F.lit(1.0)
    cols = [*x, F.lit(1.0)] if intercept else list(x)
    out = [F.sum(w * cols[i] * cols[j]).alias(f"xx_{i}_{j}") for i in range(len(cols)) for j in range(i, len(cols))]
    out += [F.sum(w * c * y).alias(f"xy_{i}") for i, c in enumerate(cols)]
    return [*out, F.sum(w * y * y).alias("yy"), F.count("*").alias("n"), F.sum(w).alias("w"), F.sum(w * w).alias("w2")]


def _block(row, k: int) -> Gram:
    xx = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            xx[i, j] = xx[j, i] = row[f"xx_{i}_{j}"] or 0.0
    return Gram(xx, np.array([row[f"xy_{i}"] or 0.0 for i in range(k)]), row["yy"] or 0.0, float(row["n"]), row["w"] or 0.0, row["w2"] or 0.0)


def grams(df: DataFrame, x: Sequence[str | Column], y: str | Column, fold: str | None = None, weight: Column | None = None, intercept: bool = True) -> dict:
    """Normal equations of every fold in one pass; folds are a small dimension (seasons, arms)."""
    xs = [F.col(c) if isinstance(c, str) else c for c in x]
    yc = F.col(y) if isinstance(y, str) else y
    rows = df.groupBy(*([fold] if fold else [])).agg(*gram_columns(xs, yc, weight, intercept)).collect()
    k = len(xs) + bool(intercept)
    return {row[fold] if fold else None: _block(row, k) for row in rows}


def solve(g: Gram, ridge: float = 0.0, penalise_last: bool = False) -> np.ndarray:
    """Coefficients, the intercept last."""
    p = np.full(len(g.xy), ridge)
    if not penalise_last and len(p):
        p[-1] = 0.0
    return np.linalg.lstsq(g.xx + np.diag(p), g.xy, rcond=None)[0]


def sse(g: Gram, beta: np.ndarray) -> float:
    return float(max(0.0, g.yy - 2 * beta @ g.xy + beta @ g.xx @ beta))


def ols(df: DataFrame, x: Sequence[str], y: str, weight: Column | None = None) -> tuple[np.ndarray, float]:
    """Coefficients and sigma; with weights the effective number of rows is sum(w)^2 / sum(w^2) (Kish)."""
    g = grams(df, x, y, weight=weight)[None]
    beta = solve(g)
    n = g.w**2 / g.w2 if weight is not None else g.n
    return beta, float(np.sqrt(sse(g, beta) / g.w * n / max(n - len(x) - 1, 1)))


def ridge_centred(df: DataFrame, x: Sequence[str], y: str, season: str, lam: float) -> np.ndarray:
    """Ridge on season-centred features and outcome, without intercept."""
    by = Window.partitionBy(season)
    centred = df.select(*((F.col(c) - F.avg(c).over(by)).alias(c) for c in [*x, y]))
    return solve(grams(centred, x, y, intercept=False)[None], lam, penalise_last=True)


def two_stage(df: DataFrame, first: Sequence[str], second: Sequence[str], y: str, level: str, stage: str) -> tuple[np.ndarray, np.ndarray, dict]:
    """Fit relative to a level, a second stage on its residual, and the residual's deviation (n) by stage."""
    rel = df.withColumn("_y", F.col(y) - F.col(level))
    a, _ = ols(rel, first, "_y")
    res = rel.withColumn("_r", F.col("_y") - linear(first, a))
    b, _ = ols(res, second, "_r")
    sig = res.groupBy(stage).agg(F.stddev_pop(F.col("_r") - linear(second, b)).alias("s")).collect()
    return a, b, {r[stage]: r["s"] for r in sig}


def linear(x: Sequence[str | Column], beta: Sequence[float]) -> Column:
    """Linear predictor with the intercept last (if there is one more coefficient than features)."""
    out = F.lit(float(beta[len(x)]) if len(beta) > len(x) else 0.0)
    for c, b in zip(x, beta, strict=False):
        out = out + (F.col(c) if isinstance(c, str) else c) * float(b)
    return out


@dataclass
class Glm:
    beta: np.ndarray
    cov: np.ndarray

    @property
    def se(self) -> np.ndarray:
        return np.sqrt(np.diag(self.cov))


def glm(df: DataFrame, x: Sequence[str | Column], y: str, link: str = "logit", weight: str | None = None, offset: Column | None = None, l2: float | Sequence[float] = 0.0, cluster: str | None = None, rounds: int = 25) -> Glm:
    """Penalised logit or probit with weights and an offset, by Newton or scoring steps, each one aggregate.

    The penalty is on coefficients, not on the intercept. With `cluster` the covariance is the sandwich over clusters.
    """
    xs = [F.col(c) if isinstance(c, str) else c for c in x]
    k = len(xs) + 1
    pen = np.append(np.broadcast_to(np.asarray(l2, float), (k - 1,)), 0.0)
    w0, off, yc = (F.col(weight) if weight else F.lit(1.0)), (offset if offset is not None else F.lit(0.0)), F.col(y).cast("double")
    keep = df.where(yc.isNotNull())
    beta = np.zeros(k)
    for _ in range(rounds):
        parts = _scores(xs, yc, off, beta, link)
        row = keep.agg(*gram_columns(xs, parts["z"], w0 * parts["w"])).first()
        g = _block(row, k)
        step = np.linalg.lstsq(g.xx + np.diag(pen), g.xy - pen * beta, rcond=None)[0]
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    bread = np.linalg.pinv(g.xx + np.diag(pen))
    if cluster is None:
        return Glm(beta, bread)
    parts = _scores(xs, yc, off, beta, link)
    one = w0 * parts["w"] * parts["z"]
    sums = keep.groupBy(cluster).agg(*(F.sum(one * c).alias(f"s{i}") for i, c in enumerate([*xs, F.lit(1.0)])))
    meat_row = sums.agg(*(F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k))).first()
    meat = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            meat[i, j] = meat[j, i] = meat_row[f"m{i}_{j}"]
    return Glm(beta, bread @ meat @ bread)


def _scores(xs: Sequence[Column], y: Column, offset: Column, beta: np.ndarray, link: str) -> dict[str, Column]:
    """Working weight w and residual z with w * z the score's factor."""
    eta = offset + linear(xs, beta)
    if link == "logit":
        p = 1 / (1 + F.exp(-eta))
        w = F.greatest(p * (1 - p), F.lit(1e-12))
        return {"w": w, "z": (y - p) / w}
    p = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), norm_cdf(eta)))
    d = F.greatest(F.exp(-eta * eta / 2) * 0.3989422804014327, F.lit(1e-12))
    w = d * d / (p * (1 - p))
    return {"w": w, "z": (y - p) / d}


def log_curve(df: DataFrame, pick: str, value: str, minutes: str) -> tuple[float, float]:
    """Minutes-weighted fit of value on the logarithm of the pick: (a, b)."""
    beta, _ = ols(df.withColumn("_lp", F.ln(pick)), ["_lp"], value, F.col(minutes).cast("double"))
    return float(beta[1]), float(beta[0])


def grid_fit(df: DataFrame, grid: Sequence[float], loss, by: Sequence[str] = ()) -> DataFrame:
    """The grid point of least summed loss; loss maps a grid Column to a row's loss. Ties go to the smaller point.

    Rows are summed for every grid point in one pass (columns, not exploded rows).
    """
    sums = df.groupBy(*by).agg(*(F.sum(loss(F.lit(float(v)))).alias(f"g{i}") for i, v in enumerate(grid)))
    best = F.array_min(F.array(*(F.struct(F.col(f"g{i}").alias("loss"), F.lit(float(v)).alias("value")) for i, v in enumerate(grid))))
    return sums.select(*by, best["value"].alias("value"), best["loss"].alias("loss"))


#: A slope beyond this means that the forecasts separate the outcomes.
SEPARATED = 50


def calibration_slope(df: DataFrame, p: str, y: str, least: int = 30) -> tuple[float, float, float, float] | None:
    """Slope and intercept of y on logit(p) with standard errors; none if rows are few, one class is missing or the fit separates."""
    df = df.where(F.col(p).isNotNull() & ~F.isnan(p) & F.col(y).isNotNull())
    n, m = df.agg(F.count("*"), F.avg(F.col(y).cast("double"))).first()
    if n < least or not m or m >= 1:
        return None
    from ..functions.prices import logit

    g = glm(df, [logit(F.col(p))], y)
    if not np.isfinite(g.beta).all() or abs(g.beta[0]) > SEPARATED:
        return None
    return float(g.beta[0]), float(g.se[0]), float(g.beta[1]), float(g.se[1])


def disagreement_weight(df: DataFrame, p: str, q: str, y: str) -> Glm:
    """Y on logit q and logit p - logit q."""
    from ..functions.prices import logit

    return glm(df, [logit(F.col(q)), logit(F.col(p)) - logit(F.col(q))], y)


def ols_robust(df: DataFrame, x: Sequence[str], y: str) -> Glm:
    """Least squares with HC1 errors: a second sum weights X'X by squared residuals."""
    g = grams(df, x, y)[None]
    beta = solve(g)
    r = F.col(y) - linear(x, beta)
    meat = grams(df, x, y, weight=r * r)[None].xx
    inv, k = np.linalg.pinv(g.xx), len(beta)
    return Glm(beta, inv @ meat @ inv * g.n / max(g.n - k, 1))


def slope(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Simple slope with its standard error."""
    xx, yy, xy, n = F.regr_sxx(y, x), F.regr_syy(y, x), F.regr_sxy(y, x), F.regr_count(y, x)
    return df.groupBy(*by).agg(n.alias("n"), F.regr_slope(y, x).alias("slope"), F.when((n > 2) & (xx > 0), F.sqrt(F.greatest(F.lit(0.0), yy - xy * xy / xx) / (n - 2) / xx)).alias("slope_se"))


def margin_mapping(df: DataFrame, z: str, margin: str, method: str, fixed: float = 13.5, by: Sequence[str] = ()) -> DataFrame:
    """margin = a + b z: fixed b, scale only, or affine."""
    b = {"fixed": F.max(F.lit(fixed)), "scale": F.sum(F.col(z) * F.col(margin)) / F.sum(F.col(z) * F.col(z)), "affine": F.regr_slope(margin, z)}[method]
    a = F.regr_intercept(margin, z) if method == "affine" else F.max(F.lit(0.0))
    return df.groupBy(*by).agg(a.alias("a"), b.alias("b"))


def eb_spread(offsets: DataFrame, b: str, se_: str) -> DataFrame:
    """Spread of offsets beyond their errors, not below 0."""
    return offsets.agg(F.sqrt(F.greatest(F.lit(0.0), F.var_samp(b) - F.avg(F.col(se_) * F.col(se_)))).alias("tau"))


def shaped(df: DataFrame, x: str, y: str, arm: str, knots: Sequence[float] = ()) -> np.ndarray:
    """Polynomial or natural spline arms of one feature."""
    from ..functions.scalars import spline_basis

    cols = spline_basis(F.col(x), knots) if arm == "spline" else [F.col(x), F.col(x) * F.abs(x), F.pow(x, 3)] if arm == "poly" else [F.col(x)]
    return solve(grams(df, cols, y)[None])


def hetero_sigma(df: DataFrame, x: Sequence[str], y: str) -> tuple[np.ndarray, np.ndarray]:
    """Mean fit, then squared residuals on the same features."""
    beta, _ = ols(df, x, y)
    r = F.col(y) - linear(x, beta)
    return beta, solve(grams(df.withColumn("_r2", r * r), x, "_r2")[None])


def ladder_mean(quotes: DataFrame, key: Sequence[str], line: str, over: str) -> DataFrame:
    """Mean behind a ladder of lines with no-vig chances to go over: the normal quantiles of three lines or more on a straight
    line, else the Poisson mean that gives the single (lowest) line's chance, by halving."""
    some = quotes.where(F.col(over).between(0.001, 0.999)).withColumn("_z", norm_ppf(1 - F.col(over)))  # once a quote: the sums of the line name it often
    g = some.groupBy(*key).agg(F.count("*").alias("n"), F.regr_intercept(line, F.col("_z")).alias("fit"), F.min(F.struct(F.col(line).alias("l"), F.col(over).alias("p"))).alias("one"))
    terms = F.sequence(F.lit(0), F.floor(F.col("one.l")).cast("int"))

    def over_at(mu: Column) -> Column:
        t = F.aggregate(F.filter(terms, lambda i: i > 0), F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")), lambda a, i: F.struct((a["t"] * mu / i).alias("t"), (a["s"] + a["t"] * mu / i).alias("s")), lambda a: a["s"])
        return 1 - F.exp(-mu) * t

    from ..functions.prices import _bisect

    poisson = _bisect(0.01, 100.0, lambda m: over_at(m) < F.col("one.p"), 50)
    return g.select(*key, "n", F.when(F.col("n") >= 3, F.col("fit")).otherwise(poisson).alias("mean"))


def shrunk_bins(df: DataFrame, bin_: str, actual: str, forecast: str, base: str, pseudo: float = 100.0, low: float = 0.25, high: float = 4.0) -> DataFrame:
    """Squared error of each bin over its forecast variance, shrunk toward 1 by pseudo rows and kept within bounds, and the share of the bin's
    outcomes above 0."""
    e = F.col(actual) - F.col(forecast)
    raw = F.sum(e * e) / F.nullif(F.sum(base), F.lit(0.0))
    n = F.count("*")
    play = F.avg((F.col(actual) > 0).cast("double"))
    return df.groupBy(bin_).agg(n.alias("n"), play.alias("play"), F.greatest(F.lit(low), F.least(F.lit(high), (raw * n + pseudo) / (n + pseudo))).alias("ratio"))


def play_mixture(df: DataFrame, bin_: str, actual: str, forecast: str, base: str, least: int = 100) -> DataFrame:
    """Chance to play (an outcome above 0) and variance ratio of those who did around forecast / chance; bins with fewer than `least` played
    rows are left out. The squares are sums, so the chance need not be known before the pass."""
    played = F.col(actual) > 0
    some = lambda c: F.sum(F.when(played, c))
    a, f = F.col(actual), F.col(forecast)
    s = df.groupBy(bin_).agg(F.count("*").alias("n"), F.count_if(played).alias("played"), some(a * a).alias("aa"), some(a * f).alias("af"), some(f * f).alias("ff"), some(F.col(base)).alias("base"))
    p = F.greatest(F.lit(0.2), F.least(F.lit(1.0), F.col("played") / F.col("n")))
    c = (F.col("aa") - 2 * F.col("af") / p + F.col("ff") / (p * p)) / F.nullif(F.col("base"), F.lit(0.0))
    return s.where(F.col("played") >= least).select(bin_, "n", "played", p.alias("play"), F.greatest(F.lit(0.25), F.least(F.lit(10.0), c)).alias("ratio"))


def pair_dependence(df: DataFrame, game: str, team: str, z: str, starter: Column, star: Column, pseudo: float = 100.0) -> DataFrame:
    """Products of pairs of one game by their roles: two starters of a team, two others of a team, two stars of a team, stars of two
    teams. Averaged in a game, so that its pairs count as one, then over games, shrunk to 0 by pseudo games. The products
    of all pairs of a set are half of its squared sum less its squares, so no pair becomes a row."""
    v = F.col(z)
    named = df.select(game, team, v.alias("_z"), F.coalesce(starter, F.lit(False)).alias("_starter"), F.coalesce(star, F.lit(False)).alias("_star"))

    def sums(name: str, when: Column) -> list[Column]:
        x = F.when(when, F.col("_z"))
        return [F.count(x).alias(f"{name}_n"), F.coalesce(F.sum(x), F.lit(0.0)).alias(f"{name}_s"), F.coalesce(F.sum(x * x), F.lit(0.0)).alias(f"{name}_q")]

    t = named.where("_z is not null").groupBy(game, team).agg(*sums("all", F.lit(True)), *sums("starter", F.col("_starter")), *sums("star", F.col("_star")))
    pairs = lambda n: (F.col(f"{n}_n") * (F.col(f"{n}_n") - 1) / 2)
    product = lambda n: ((F.col(f"{n}_s") * F.col(f"{n}_s") - F.col(f"{n}_q")) / 2)
    g = t.groupBy(game).agg(
        F.sum(pairs("starter")).alias("starter_k"), F.sum(product("starter")).alias("starter_p"), F.sum(pairs("all") - pairs("starter")).alias("team_k"), F.sum(product("all") - product("starter")).alias("team_p"),
        F.sum(pairs("star")).alias("own_star_k"), F.sum(product("star")).alias("own_star_p"), *(F.sum(f"star_{c}").alias(f"star_{c}") for c in "nsq"),
    ).withColumns({"game_star_k": pairs("star") - F.col("own_star_k"), "game_star_p": product("star") - F.col("own_star_p")})
    roles = ("starter", "team", "own_star", "game_star")
    one = F.explode(F.array(*(F.struct(F.lit(r).alias("role"), F.col(f"{r}_k").alias("k"), F.col(f"{r}_p").alias("p")) for r in roles)))
    per = g.select(one.alias("x")).where("x.k > 0").groupBy(F.col("x.role").alias("role")).agg(F.count("*").alias("games"), F.avg(F.col("x.p") / F.col("x.k")).alias("mean"))
    return per.withColumn("shrunk", F.col("mean") * F.col("games") / (F.col("games") + pseudo))


def dependence_factors(pairs: DataFrame) -> DataFrame:
    """One row of loadings that keep the joint distribution valid: what all of a team share, what its starters and the stars of a
    game share beyond it, and what takes the stars of one team apart, each within its bounds."""
    at = lambda r: F.coalesce(F.max(F.when(F.col("role") == r, F.col("shrunk"))), F.lit(0.0))
    clip = lambda c, hi: F.greatest(F.lit(0.0), F.least(F.lit(hi), c))
    s = pairs.agg(*(at(r).alias(f"_{r}") for r in ("team", "starter", "own_star", "game_star")))
    s = s.withColumn("team", clip(F.col("_team"), 0.08)).withColumn("starter", clip(F.col("_starter") - F.col("team"), 0.12)).withColumn("game_star", clip(F.col("_game_star"), 0.08))
    return s.select("team", "starter", "game_star", clip(F.col("team") + F.col("starter") + F.col("game_star") - F.col("_own_star"), 0.15).alias("star_split"))


def pace_arms(df: DataFrame, season: str, mean: str, pace: str, sigma: str, margin: str, won: str, grid: Sequence[float], seasons: int = 1000) -> DataFrame:
    """Rows (season, arm, n, k, s, loss, brier, mse): forecast margins and their spread scaled by pace, on each season by fits of the earlier ones.

    The margin becomes mean * (1 + k * pace), k by least squares; the spread sigma * exp(s * pace), s the value of `grid` with the least log loss given
    k, the smallest on ties. Arms: base (neither), margin (k), both (k and s), fixed (k = 1, s = 0.5). loss, brier and mse are differences from base.
    Rows with a null are left out, and a season without an earlier one.

    Rows that agree in all but the margin become one with their number and the sum of their margins, which is all that the sums need; the grid is
    evaluated for these, once a value and later season, in one grouped sum that combines before the shuffle. The folds, one number a season,
    go through the driver: over `seasons` of them is an error.
    """
    c = F.col
    rows = df.select(c(season), *(c(x).cast("double").alias(n) for x, n in ((mean, "_m"), (pace, "_lp"), (sigma, "_sd"), (margin, "_y"), (won, "_won")))).dropna()
    rows = stored(rows.groupBy(season, "_m", "_lp", "_sd", "_won").agg(F.count("*").alias("_n"), F.sum("_y").alias("_y")), "pace-rows")
    x = c("_m") * c("_lp")
    per = rows.groupBy(season).agg(F.sum(x * (c("_y") - c("_n") * c("_m"))).alias("a"), F.sum(c("_n") * x * x).alias("b")).orderBy(season).limit(seasons + 1).collect()
    if len(per) > seasons:
        raise ValueError(f"over {seasons} seasons")
    folds, a, b = [], 0.0, 0.0
    for row in per:
        if b > 0:
            folds.append((row[season], a / b))
        a, b = a + row["a"], b + row["b"]
    spark = df.sparkSession
    kind = df.schema[season].dataType.simpleString()
    fold = F.array(*(F.struct(F.lit(t).cast(kind).alias("test"), F.lit(k).alias("k")) for t, k in folds)) if folds else F.expr(f"CAST(array() AS array<struct<test:{kind},k:double>>)")

    def chance(k: Column, s: Column) -> Column:
        return norm_cdf(c("_m") * (1 + k * c("_lp")) / (c("_sd") * F.exp(s * c("_lp"))))

    long = rows.withColumn("_f", F.explode(F.filter(fold, lambda f: f["test"] > c(season)))).withColumn("s", F.explode(F.array(*(F.lit(float(v)) for v in grid))))
    losses = long.groupBy(c("_f.test").alias(season), c("_f.k").alias("k"), "s").agg((F.sum(c("_n") * log_loss(chance(c("_f.k"), c("s")), c("_won"))) / F.sum("_n")).alias("_l"))
    best = losses.groupBy(season, "k").agg(F.min(F.struct("_l", "s")).alias("_b")).select(season, "k", c("_b.s").alias("s"))
    fits = spark.createDataFrame(best.collect(), best.schema)  # one row a season, counted above
    zero = F.lit(0.0)
    arms = {"base": (zero, zero), "margin": (c("k"), zero), "both": (c("k"), c("s")), "fixed": (F.lit(1.0), F.lit(0.5))}

    def scores(k: Column, s: Column) -> Column:
        p, more = chance(k, s), k * x
        # the squared error beyond that of the mean itself, over all margins of the row
        return F.struct((c("_n") * log_loss(p, c("_won"))).alias("loss"), (c("_n") * brier(p, c("_won"))).alias("brier"), (more * (c("_n") * (2 * c("_m") + more) - 2 * c("_y"))).alias("mse"))

    scored = rows.join(F.broadcast(fits), season).withColumns({f"_{n}": scores(*a) for n, a in arms.items()})
    cells = scored.select(season, "k", "s", "_n", F.inline(F.array(*(F.struct(F.lit(n).alias("arm"), *((c(f"_{n}.{v}") - c(f"_base.{v}")).alias(v) for v in ("loss", "brier", "mse"))) for n in arms))))
    return cells.groupBy(season, "arm", "k", "s").agg(F.sum("_n").alias("n"), *((F.sum(v) / F.sum("_n")).alias(v) for v in ("loss", "brier", "mse"))).select(season, "arm", "n", "k", "s", "loss", "brier", "mse")


def model_table(spark: SparkSession, models: Sequence[dict]) -> DataFrame:
    """Fitted parameters as one row a model, for broadcast at scoring."""
    schema = T.StructType([T.StructField("model_id", T.StringType()), T.StructField("season", T.IntegerType()), T.StructField("features", T.ArrayType(T.StringType())), T.StructField("coef", T.ArrayType(T.DoubleType())), T.StructField("intercept", T.DoubleType()), T.StructField("sigma", T.DoubleType()), T.StructField("link", T.StringType()), T.StructField("version", T.IntegerType())])
    return spark.createDataFrame([tuple(m.get(f.name) for f in schema.fields) for m in models], schema)
