"""Scoring and summaries (A01-A42). Every function is one grouped aggregation (partial sums before the shuffle)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.prices import brier, decimal_payout, implied, log_loss, unit_profit
from .order import beside, quantiles, summed_below

MIN_ROWS = 10


def se(x: Column) -> Column:
    """Standard error of a mean; null under two values."""
    return F.stddev_samp(x) / F.sqrt(F.count(x))


def scoring(df: DataFrame, by: Sequence[str], p: str, q: str, y: str) -> DataFrame:
    """Model and price on identical rows: Brier, log loss, accuracy, paired difference and its standard error."""
    d = df.where(F.col(p).isNotNull() & F.col(q).isNotNull() & F.col(y).isNotNull())
    bp, bq, lp, lq = brier(F.col(p), F.col(y)), brier(F.col(q), F.col(y)), log_loss(F.col(p), F.col(y)), log_loss(F.col(q), F.col(y))
    right = lambda c: F.avg(((F.col(c) >= 0.5).cast("int") == F.col(y)).cast("double"))
    return d.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(bp).alias("brier_model"), F.avg(bq).alias("brier_price"), F.avg(lp).alias("loss_model"), F.avg(lq).alias("loss_price"),
        right(p).alias("accuracy_model"), right(q).alias("accuracy_price"), F.avg(lp - lq).alias("loss_diff"), se(lp - lq).alias("loss_diff_se"), F.avg(bp - bq).alias("brier_diff"), se(bp - bq).alias("brier_diff_se"),
    )


def reliability(df: DataFrame, p: str, y: str, bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """By equal bins of p: mean forecast, rate, and the error that the forecasts imply."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(*by, b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("forecast"), F.avg(F.col(y).cast("double")).alias("rate"), (F.sqrt(F.sum(F.col(p) * (1 - F.col(p)))) / F.count("*")).alias("implied_se"))


def market_calibration(sides: DataFrame, ml: str, q: str, won: str, rung: str) -> DataFrame:
    """By rung and side: no-vig expectation against results; the favourites pooled."""
    return sides.groupBy(rung, "side").agg(F.count("*").alias("n"), F.avg(q).alias("expected"), F.avg(F.col(won).cast("double")).alias("rate"), F.avg(implied(F.col(ml))).alias("implied"), F.avg((F.col(q) >= 0.5).cast("double")).alias("favorite_share"))


def roi(df: DataFrame, by: Sequence[str], ml: str, won: str, q: str) -> DataFrame:
    """Flat-stake return, its null under the fair price, the standard error and z of the difference. A row without a price keeps
    its win or loss and has no return."""
    units = unit_profit(F.col(ml), F.col(won))
    null = F.when(decimal_payout(F.col(ml)).isNotNull() & units.isNotNull(), F.col(q) * decimal_payout(F.col(ml)) - 1)
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.count(units).alias("n_priced"), F.sum(F.col(won).cast("long")).alias("wins"), F.sum(units).alias("units"), F.avg(units).alias("roi"), F.avg(null).alias("roi_null"), se(units).alias("roi_se"),
        F.when(F.stddev_samp(units - null) > 0, F.avg(units - null) / se(units - null)).alias("z"),
    )


def ats(df: DataFrame, by: Sequence[str], result: str) -> DataFrame:
    """Covers, losses, pushes, and the rate without pushes."""
    win, loss = F.count_if(F.col(result) == 1), F.count_if(F.col(result) == 0)
    return df.groupBy(*by).agg(win.alias("wins"), loss.alias("losses"), F.count_if(F.col(result) == 0.5).alias("pushes"), F.when(win + loss > 0, win / (win + loss)).alias("rate"))


def suppress_small(df: DataFrame, n: str, columns: Sequence[str], least: int = MIN_ROWS) -> DataFrame:
    """Figures of groups under `least` rows are null."""
    return df.withColumns({c: F.when(F.col(n) >= least, F.col(c)) for c in columns})


def split_rows(df: DataFrame, splits: Sequence[str], ml: str, won: str, q: str) -> DataFrame:
    """Returns by basis, book and season: never pooled over books."""
    return roi(df, splits, ml, won, q)


def pooled_and_split(df: DataFrame, keys: Sequence[str], error: str) -> DataFrame:
    """Pooled, and by each key alone, in one pass over grouping sets; A42 figures in each."""
    names = [F.col(k) for k in keys]
    sets = [[], *([k] for k in names)]
    a = F.abs(error)
    return df.groupingSets(sets, *keys).agg(F.grouping_id().alias("which"), F.count("*").alias("n"), F.avg(error).alias("bias"), F.avg(a).alias("mae"), F.sqrt(F.avg(F.col(error) * F.col(error))).alias("rmse"))


def unit_se(units: Column) -> Column:
    """Null where all bets won or all lost."""
    return F.when(F.min(F.signum(units)) != F.max(F.signum(units)), se(units))


def wilson(wins: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """A10: interval of a rate."""
    p = wins / n
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n > 0, mid - half), F.when(n > 0, mid + half)


def closing_value(df: DataFrame, by: Sequence[str], bet_q: str, close_q: str) -> DataFrame:
    """Mean move of the no-vig price toward the bet, its error, and the share that moved toward it."""
    m = F.col(close_q) - F.col(bet_q)
    return df.where(m.isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg(m).alias("clv"), se(m).alias("clv_se"), F.avg((m > 0).cast("double")).alias("toward"))


def lock_coverage(df: DataFrame, lock: str, tip: str, void: str, now: Column | None = None, tracked: Column | None = None, in_family: Column | None = None) -> DataFrame:
    """Rows with a lock, those without one whose tip has passed (without `now`: all), locks that are void, the median lead, and of the locks of
    `tracked` rows those inside and outside the model family."""
    has = F.col(lock).isNotNull()
    late = F.lit(True) if now is None else F.col(tip) <= now
    family = F.coalesce(in_family, F.lit(False)) if in_family is not None else F.lit(True)
    counted = has & (F.coalesce(tracked, F.lit(False)) if tracked is not None else F.lit(True))
    counts = df.agg(
        F.count_if(has).alias("locked"), F.count_if(~has & late).alias("missed"), F.count_if(has & F.col(void)).alias("void"), F.count_if(counted & family).alias("family_locked"), F.count_if(counted & ~family).alias("off_family"),
    )
    return beside(counts, quantiles(df, [], F.col(tip) - F.col(lock), {"median_lead": 0.5}), [], ["median_lead"])


def market_summary(df: DataFrame, by: Sequence[str], favorite_won: str, ml: str, error: str) -> DataFrame:
    """Favourites straight up and at their prices; error of the line."""
    e = F.col(error)
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.col(favorite_won).cast("double")).alias("straight_up"), F.avg(unit_profit(F.col(ml), F.col(favorite_won))).alias("roi"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"))


def against_favorite(df: DataFrame, model_units: str, favorite_units: str, agree: str) -> DataFrame:
    """Model and always-the-favourite on the same rows, and where they differ."""
    d = F.col(model_units) - F.col(favorite_units)
    return df.agg(F.count("*").alias("n"), F.avg(d).alias("diff"), se(d).alias("diff_se"), F.count_if(~F.col(agree)).alias("n_differ"), F.avg(F.when(~F.col(agree), F.col(model_units))).alias("model_differ"), F.avg(F.when(~F.col(agree), F.col(favorite_units))).alias("favorite_differ"))


def play_rates(df: DataFrame, lead: str, status: str, played: str) -> DataFrame:
    """A15."""
    return df.groupBy(lead, status).agg(F.avg(F.col(played).cast("double")).alias("rate"), F.count("*").alias("n"))


def centred_rates(df: DataFrame, key: Sequence[str], within: Sequence[str], value: str, minutes: str) -> DataFrame:
    """Totals by key, for each 100 minutes, centred on the minutes-weighted mean of `within`."""
    t = df.groupBy(*within, *key).agg(F.sum(value).alias("total"), F.sum(minutes).alias("minutes"))
    t = t.withColumn("rate", F.when(F.col("minutes") > 0, 100 * F.col("total") / F.col("minutes")))
    by = Window.partitionBy(*within)
    return t.withColumn("centred", F.col("rate") - F.sum(F.col("rate") * F.col("minutes")).over(by) / F.sum("minutes").over(by))


def talent(roster: DataFrame, values: DataFrame, team: Sequence[str], player: str, minutes: str, value: str) -> DataFrame:
    """Sum over a team's players of minutes share times value."""
    return roster.join(values, player).groupBy(*team).agg(F.sum(F.col(minutes) / 240 * F.col(value)).alias("talent"))


def auc(df: DataFrame, score: str, y: str) -> DataFrame:
    """Chance that a positive scores above a negative, ties half; from counts by score."""
    c = df.groupBy(score).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.sum(1 - F.col(y).cast("long")).alias("neg"))
    below = F.col("_below")
    return summed_below(c, [], score, "neg").agg((F.sum(F.col("pos") * (below + F.col("neg") / 2)) / (F.sum("pos") * F.sum("neg"))).alias("auc"))


def harmonic_top(df: DataFrame, group: Sequence[str], value: str, k: int, ties: Sequence[str]) -> DataFrame:
    """Top-k values weighted by 1/rank, and the ratio of the harmonic to the arithmetic mean of the top k."""
    r = df.withColumn("_k", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(value), *ties))).where(F.col("_k") <= k)
    v = F.col(value)
    return r.groupBy(*group).agg((F.sum(v / F.col("_k")) / F.sum(1 / F.col("_k"))).alias("weighted"), (F.count("*") / F.sum(1 / v) / F.avg(v)).alias("balance"))


def voted_line(votes: DataFrame, game: Sequence[str], side: str, line: str) -> DataFrame:
    """The side most providers name, then the median line of that side; a split vote is null."""
    c = votes.groupBy(*game, side).agg(F.count("*").alias("n"), F.median(line).alias("line"))
    top = c.groupBy(*game).agg(F.max("n").alias("top"), F.max_by(F.struct(side, "line"), "n").alias("x"), F.count_if(F.lit(True)).alias("_"))
    tied = c.join(top.select(*game, F.col("top")), list(game)).where("n = top").groupBy(*game).agg(F.count("*").alias("leaders"))
    return top.join(tied, list(game)).select(*game, F.when(F.col("leaders") == 1, F.col(f"x.{side}")).alias("side"), F.when(F.col("leaders") == 1, F.col("x.line")).alias("line"))


def per_game_mean(df: DataFrame, game: str, value: str, weight: str | None = None) -> DataFrame:
    """Weighted mean of each game, then the mean over games."""
    m = F.sum(F.col(value) * F.col(weight)) / F.sum(weight) if weight else F.avg(value)
    return df.groupBy(game).agg(m.alias("_m")).agg(F.avg("_m").alias("mean"), se(F.col("_m")).alias("se"), F.count("*").alias("games"))


def clustered_mean(df: DataFrame, cluster: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean with a standard error over clusters: sqrt(sum over clusters of (sum - n mean)^2) / n."""
    c = df.groupBy(*by, cluster).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    t = c.groupBy(*by).agg(F.sum("s").alias("S"), F.sum("n").alias("N"), F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum(F.col("s") * F.col("n")).alias("sn"), F.sum(F.col("n") * F.col("n")).alias("nn"))
    m = F.col("S") / F.col("N")
    return t.select(*by, F.col("N").alias("n"), m.alias("mean"), (F.sqrt(F.greatest(F.lit(0.0), F.col("ss") - 2 * m * F.col("sn") + m * m * F.col("nn"))) / F.col("N")).alias("se"))


def split_half(df: DataFrame, key: Sequence[str], half: str, value: str) -> DataFrame:
    """Correlation of two halves, its reliability (Spearman and Brown) and Fisher interval."""
    w = df.groupBy(*key).agg(F.avg(F.when(F.col(half) == 0, F.col(value))).alias("a"), F.avg(F.when(F.col(half) == 1, F.col(value))).alias("b")).where("a is not null and b is not null")
    r = w.agg(F.corr("a", "b").alias("r"), F.count("*").alias("n"))
    z, h = F.atanh("r"), 1.96 / F.sqrt(F.col("n") - 3)
    return r.select("n", "r", (2 * F.col("r") / (1 + F.col("r"))).alias("reliability"), F.tanh(z - h).alias("lo"), F.tanh(z + h).alias("hi"))


def increment_sigma(df: DataFrame, game: str, order: str, lead: str) -> DataFrame:
    """Standard deviation of increments inside games, and the correlation of neighbouring increments."""
    own = Window.partitionBy(game).orderBy(order)
    d = df.withColumn("_d", F.col(lead) - F.lag(lead, 1).over(own)).withColumn("_e", F.lag("_d").over(own))
    return d.agg(F.stddev_samp("_d").alias("sigma"), F.corr("_d", "_e").alias("lag_corr"))


def period_points(plays: DataFrame, game: str, period: str, pos: str, score: str) -> DataFrame:
    """Points of each period: its last score less that of the period before."""
    last = plays.groupBy(game, period).agg(F.max_by(score, pos).alias("_s"))
    return last.withColumn("points", F.col("_s") - F.coalesce(F.lag("_s").over(Window.partitionBy(game).orderBy(period)), F.lit(0))).drop("_s")


def gap_distribution(df: DataFrame, gap: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean, median, 90th percentile of the size of a gap, shares within 1, 2 and 5 points, signed mean."""
    a = F.abs(gap)
    sizes = df.groupBy(*by).agg(F.avg(a).alias("mean"), *(F.avg((a <= k / 100).cast("double")).alias(f"within_{k}") for k in (1, 2, 5)), F.avg(gap).alias("signed"))
    return beside(sizes, quantiles(df, by, a, {"median": 0.5, "p90": 0.9}), by, ["median", "p90"])


def agreement(df: DataFrame, projected: str, actual: str, by: Sequence[str] = ()) -> DataFrame:
    """Coverage, correlation, mean absolute error and bias of projections."""
    d = F.col(projected) - F.col(actual)
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.count(projected).alias("covered"), F.corr(projected, actual).alias("corr"), F.avg(F.abs(d)).alias("mae"), F.avg(d).alias("bias"))


def group_share(df: DataFrame, group: str, value: str) -> DataFrame:
    """Share of the variance that group means explain."""
    g = df.groupBy(group).agg(F.count(value).alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))
    total = F.sum("q") - F.sum("s") * F.sum("s") / F.sum("n")
    return g.agg(((F.sum(F.col("s") * F.col("s") / F.col("n")) - F.sum("s") * F.sum("s") / F.sum("n")) / total).alias("r2"), F.count("*").alias("groups"))


def matrix(df: DataFrame, row: str, column: str, columns: Sequence[int], value: str) -> DataFrame:
    """Joint cells as a matrix: rows of one band, a column for each of the other."""
    return df.groupBy(row).pivot(column, list(columns)).agg(F.avg(value))


def cell_roi(df: DataFrame, cell: Sequence[str], ml: str, won: str, q: str) -> DataFrame:
    """Return, null and difference of a cell, with the error of the difference."""
    units = unit_profit(F.col(ml), F.col(won))
    null = F.col(q) * decimal_payout(F.col(ml)) - 1
    return df.where(units.isNotNull()).groupBy(*cell).agg(F.count("*").alias("n"), F.avg(units).alias("roi"), F.avg(null).alias("roi_null"), F.avg(units - null).alias("gain"), se(units - null).alias("gain_se"))


def fit_bands(df: DataFrame, by: Sequence[str], band: str, outcome: str) -> DataFrame:
    """Median and mean of the outcome in each band; bands without rows take the nearest one through joins.nearest."""
    means = df.groupBy(*by, band).agg(F.avg(outcome).alias("mean"), F.count("*").alias("n"))
    return beside(means, quantiles(df, [*by, band], F.col(outcome), {"median": 0.5}), [*by, band], ["median"])


def confidence_bands(df: DataFrame, p: str, q: str, y: str, bounds: Sequence[float]) -> DataFrame:
    """Model and market by confidence of their own pick, on one set of rows."""
    from ..functions.prices import band

    one = lambda c, name: F.struct(F.lit(name).alias("source"), F.greatest(F.col(c), 1 - F.col(c)).alias("confidence"), ((F.col(c) >= 0.5).cast("int") == F.col(y)).alias("right"))
    long = df.where(F.col(p).isNotNull() & F.col(q).isNotNull()).select(F.explode(F.array(one(p, "model"), one(q, "market"))).alias("x")).select("x.*")
    return long.groupBy("source", band(F.col("confidence"), bounds).alias("band")).agg(F.count("*").alias("n"), F.avg("confidence").alias("confidence"), F.avg(F.col("right").cast("double")).alias("rate"))


def price_window(keys: DataFrame, sides: DataFrame, at: str, price: str, won: str, start: float, cap: float, enough: int = 60, least: int = 10, step: float = 1.5) -> DataFrame:
    """Sides within +-w of a key, w widened by steps until there are enough; null under `least` at the cap.

    Sides are counted by price first, so each key meets prices, not rows: those of the cells of the widest window around it.
    """
    widths, w = [], start
    while w < cap:
        widths.append(float(w))
        w *= step
    widths.append(float(cap))
    counts = sides.groupBy(price).agg(F.count("*").alias("_n"), F.sum(F.col(won).cast("long")).alias("_w"))
    cell = lambda c: F.floor(F.col(c) / widths[-1])
    near = keys.select(at).distinct().withColumn("_cell", F.explode(F.array(*(cell(at) + i for i in (-1, 0, 1)))))
    dim = near.join(counts.withColumn("_cell", cell(price)), "_cell").where(F.abs(F.col(at) - F.col(price)) <= widths[-1])
    wide = dim.groupBy(at).agg(*(F.sum(F.when(F.abs(F.col(at) - F.col(price)) <= x, F.col("_n"))).alias(f"n{i}") for i, x in enumerate(widths)), *(F.sum(F.when(F.abs(F.col(at) - F.col(price)) <= x, F.col("_w"))).alias(f"w{i}") for i, x in enumerate(widths)))
    pick = F.lit(len(widths) - 1)
    for i in range(len(widths) - 2, -1, -1):
        pick = F.when(F.col(f"n{i}") >= enough, i).otherwise(pick)
    get = lambda c: F.element_at(F.array(*(F.col(f"{c}{i}") for i in range(len(widths)))), pick + 1)
    out = wide.select(at, get("n").alias("n"), F.element_at(F.array(*map(F.lit, widths)), pick + 1).alias("width"), (get("w") / get("n")).alias("rate"))
    return keys.join(out, at, "left").withColumn("rate", F.when(F.col("n") >= least, F.col("rate")))


def backtest(bets: DataFrame, rule: str, first_half: Column, ml: str, q: str, close_ml: str, close_q: str, won: str) -> DataFrame:
    """Rows (rule, part, A04's figures, clv, clv_se, toward). Parts: all bets at their price (all), those of them with a close at the close's price (at
    close), and each half at the own price (first, second). The last three columns, A11's move of the fair price toward the bets, stand beside `at close`."""
    c = F.col
    part = lambda name, m, x: F.struct(F.lit(name).alias("part"), c(m).alias("_ml"), c(x).alias("_q"))
    parts = F.array(part("all", ml, q), F.when(c(close_q).isNotNull(), part("at close", close_ml, close_q)), F.when(first_half, part("first", ml, q)).otherwise(part("second", ml, q)))
    long = bets.select(rule, won, F.inline(F.filter(parts, lambda x: x.isNotNull())))
    figures = roi(long, [rule, "part"], "_ml", won, "_q")
    moves = closing_value(bets, [rule], q, close_q).select(rule, F.lit("at close").alias("part"), "clv", "clv_se", "toward")
    return beside(figures, moves, [rule, "part"], ["clv", "clv_se", "toward"])


def contribution_gap(df: DataFrame, names: Sequence[str], values: str, won: str) -> DataFrame:
    """Mean contribution of each feature in wins and in losses, and the difference with its error."""
    long = df.select(F.posexplode(values).alias("_i", "v"), F.col(won).alias("w")).withColumn("feature", F.element_at(F.array(*map(F.lit, names)), F.col("_i") + 1))
    v1, v0 = F.when(F.col("w") == 1, F.col("v")), F.when(F.col("w") == 0, F.col("v"))
    return long.groupBy("feature").agg(F.avg(v1).alias("in_wins"), F.avg(v0).alias("in_losses"), (F.avg(v1) - F.avg(v0)).alias("gap"), F.sqrt(F.var_samp(v1) / F.count(v1) + F.var_samp(v0) / F.count(v0)).alias("gap_se"))


def gap_explained(df: DataFrame, correction: str, x: str) -> DataFrame:
    """Share of the market's correction that a feature explains, and the share of its mean gap."""
    r2 = F.regr_r2(correction, x)
    return df.agg(F.count("*").alias("n"), r2.alias("r2"), (F.regr_slope(correction, x) * F.avg(x) / F.avg(correction)).alias("gap_share"))


def quantile_groups(df: DataFrame, x: str, n: int, value: str) -> DataFrame:
    """Groups cut at quantiles (equal values stay together, unlike ntile), scored each."""
    cuts = quantiles(df, [], F.col(x), {f"c{i}": i / n for i in range(1, n)})  # one row
    g = F.lit(0)
    for i in range(1, n):
        g = g + (F.col(x) > F.col(f"c{i}")).cast("int")
    return df.join(F.broadcast(cuts)).groupBy(g.alias("group")).agg(F.count("*").alias("n"), F.avg(x).alias("x"), F.avg(value).alias("value"))


def edge_ladder(df: DataFrame, edge: str, thresholds: Sequence[float], ml: str, won: str, q: str) -> DataFrame:
    """The same bets at successive thresholds of the edge: claimed and returned."""
    steps = F.filter(F.array(*(F.lit(float(t)) for t in thresholds)), lambda t: F.col(edge) >= t)
    long = df.withColumn("threshold", F.explode(steps))
    units = unit_profit(F.col(ml), F.col(won))
    return long.groupBy("threshold").agg(F.count("*").alias("n"), F.avg(edge).alias("claimed"), F.avg(units).alias("roi"), se(units).alias("roi_se"))


def residual_script(df: DataFrame, game: str, residual: str, script: str, mean: str) -> DataFrame:
    """Mean product of standardised residual and game script; slope of the residual's size on the projected mean."""
    z = lambda c: (F.col(c) - F.avg(c).over(Window.partitionBy(game))) / F.nullif(F.stddev_samp(c).over(Window.partitionBy(game)), F.lit(0.0))
    d = df.withColumns({"_z": z(residual), "_s": F.col(script), "_a": F.abs(residual)})
    return d.agg(F.avg(F.col("_z") * F.col("_s")).alias("product"), F.regr_slope("_a", mean).alias("sd_slope"), F.regr_intercept("_a", mean).alias("sd_at_zero"))


def leader_calibration(states: DataFrame, p: str, y: str, lead: str, underdog: str, at: str) -> DataFrame:
    """Calibration of the underdog's chance where it leads, at given times."""
    return states.where((F.col(lead) > 0) & F.col(underdog)).groupBy(at).agg(F.count("*").alias("n"), F.avg(p).alias("forecast"), F.avg(F.col(y).cast("double")).alias("rate"))


def comebacks(states: DataFrame, side: Sequence[str], at: str, p: str, won: str, low: float = 0.5, high: float = 0.8, bands: int = 5) -> DataFrame:
    """Sides of games that fell under a chance of `low`, by whether they were favourites at their first state and by bands of p0, the chance at the
    first state under it: how many came back past `high` after it and won, beside the expected p0 / high and p0.

    One grouped pass makes a row a side; states of one time count as the one of smaller chance first.
    """
    c = F.col
    under = c(p) < low
    one = states.where(c(p).isNotNull()).groupBy(*side).agg(
        F.min(F.struct(c(at), c(p))).alias("_tip"), F.min(F.when(under, F.struct(c(at).alias("at"), c(p).alias("p0")))).alias("_low"), F.max(F.when(c(p) > high, c(at))).alias("_high"), F.max(won).alias("_won"),
    )
    e = one.where("_low is not null").select((c(f"_tip.{p}") >= low).alias("favourite"), F.least(F.floor(c("_low.p0") * bands / low), F.lit(bands - 1)).cast("int").alias("band"), c("_low.p0").alias("p0"), F.coalesce(c("_high") > c("_low.at"), F.lit(False)).cast("double").alias("back"), c("_won").cast("double").alias("won"))
    err = lambda x: F.sqrt(F.avg(x) * (1 - F.avg(x)) / F.count("*"))
    return e.groupBy("favourite", "band").agg(
        F.count("*").alias("n"), F.avg("p0").alias("expected_win"), F.avg("won").alias("win"), err("won").alias("win_se"), F.avg(c("p0") / high).alias("expected_back"), F.avg("back").alias("back"), err("back").alias("back_se"),
    )


def error_table(df: DataFrame, by: Sequence[str], forecast: str, actual: str) -> DataFrame:
    """Bias, MAE, RMSE, median error and the shares below and equal."""
    e = F.col(actual) - F.col(forecast)
    sums = df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(e).alias("bias"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg((e < 0).cast("double")).alias("below"), F.avg((e == 0).cast("double")).alias("equal"))
    return beside(sums, quantiles(df, by, e, {"median_error": 0.5}), by, ["median_error"])
