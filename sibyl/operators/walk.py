"""Walk-forward folds, replays and comparisons.

Sums of normal equations are made once for each season (or date); the matrix of any fold is then a sum or a
difference of such blocks. Coefficients come back as a small table that is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.prices import brier, decimal_payout, log_loss, unit_profit
from . import fit, measure
from .causal import latest_n_before
from .order import quantiles
from .scope import best_arm
from .tables import stored


def _coef_table(df: DataFrame, key: str, coefs: dict) -> DataFrame:
    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("coef", T.ArrayType(T.DoubleType())), T.StructField("sigma", T.DoubleType()), T.StructField("train_rows", T.LongType())])
    return df.sparkSession.createDataFrame([(k, [float(x) for x in b], float(s), int(n)) for k, (b, s, n) in coefs.items()], schema)


def season_folds(df: DataFrame, x: Sequence[str], y: str, season: str, walk_forward: bool, ridge: float = 0.0) -> DataFrame:
    """Coefficients for every season from the earlier ones (walk-forward) or from all others, and the rows scored with them."""
    blocks = fit.grams(df, x, y, fold=season)
    made = {}
    for s in blocks:
        train = [b for t, b in blocks.items() if (t < s if walk_forward else t != s)]
        if train:
            g = train[0]
            for b in train[1:]:
                g = g + b
            beta = fit.solve(g, ridge)
            made[s] = (beta, (fit.sse(g, beta) / max(g.w - len(beta), 1)) ** 0.5, g.n)
    table = _coef_table(df, season, made)
    return df.join(F.broadcast(table), season).withColumn("prediction", _predict(x, F.col("coef")))


def _predict(x: Sequence[str], coef: Column) -> Column:
    out = coef[len(x)]
    for i, c in enumerate(x):
        out = out + F.col(c) * coef[i]
    return out


def slate_refits(df: DataFrame, x: str, y: str, season: str, day: str) -> DataFrame:
    """For each slate the simple fit on all earlier seasons and the earlier slates of its own: running sums of daily sums, so no slate is
    fitted by a pass of its own."""
    a, b = F.col(x), F.col(y)
    daily = df.groupBy(season, day).agg(F.count("*").alias("n"), F.sum(a).alias("sx"), F.sum(b).alias("sy"), F.sum(a * a).alias("sxx"), F.sum(a * b).alias("sxy"))
    past = Window.orderBy(day).rowsBetween(Window.unboundedPreceding, -1)  # one row a day
    s = {c: F.sum(c).over(past) for c in ("n", "sx", "sy", "sxx", "sxy")}
    run = daily.select(season, day, *(v.alias(f"p_{c}") for c, v in s.items()))
    det = F.col("p_n") * F.col("p_sxx") - F.col("p_sx") * F.col("p_sx")
    b1 = F.when((F.col("p_n") > 2) & (det > 0), (F.col("p_n") * F.col("p_sxy") - F.col("p_sx") * F.col("p_sy")) / det)
    run = run.withColumn("slope", b1).withColumn("intercept", (F.col("p_sy") - F.col("slope") * F.col("p_sx")) / F.col("p_n"))
    return df.join(run.select(season, day, "slope", "intercept", F.col("p_n").alias("train_rows")), [season, day])


def aged_refits(df: DataFrame, x: str, y: str, day: str, half_life: float) -> DataFrame:
    """As B02 with rows weighted by age in days; sums carry 2^(day / half_life), rebased to the first day."""
    a, b = F.col(x), F.col(y)
    daily = df.groupBy(day).agg(F.count("*").alias("n"), F.sum(a).alias("sx"), F.sum(b).alias("sy"), F.sum(a * a).alias("sxx"), F.sum(a * b).alias("sxy"))
    first = daily.agg(F.min(day).alias("_first"))
    g = F.pow(F.lit(2.0), (F.col(day) - F.col("_first")) / half_life)
    past = Window.orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    run = daily.join(F.broadcast(first)).select(day, *(F.sum(F.col(c) * g).over(past).alias(f"p_{c}") for c in ("n", "sx", "sy", "sxx", "sxy")))
    det = F.col("p_n") * F.col("p_sxx") - F.col("p_sx") * F.col("p_sx")
    return run.withColumn("slope", F.when(det > 1e-9, (F.col("p_n") * F.col("p_sxy") - F.col("p_sx") * F.col("p_sy")) / det)).select(day, "slope")


def arms_long(df: DataFrame, keep: Sequence[str], arms: dict[str, Column]) -> DataFrame:
    """Rows for each arm, only where every arm has a forecast (identical rows)."""
    ok = F.lit(True)
    for c in arms.values():
        ok = ok & c.isNotNull()
    return df.where(ok).select(*keep, F.explode(F.array(*(F.struct(F.lit(n).alias("arm"), c.alias("p")) for n, c in arms.items()))).alias("x")).select(*keep, "x.*")


def compare_arms(df: DataFrame, by: Sequence[str], arms: dict[str, Column], y: str) -> DataFrame:
    """Loss and Brier of each arm, by fold, on identical rows."""
    long = arms_long(df, [*by, y], arms)
    return long.groupBy(*by, "arm").agg(F.count("*").alias("n"), F.avg(log_loss(F.col("p"), F.col(y))).alias("loss"), F.avg(brier(F.col("p"), F.col(y))).alias("brier"))


def novig_arms(df: DataFrame, by: Sequence[str], home_ml: str, away_ml: str, y: str, methods: dict[str, Callable[[Column, Column], Column]], width: float = 0.1) -> DataFrame:
    """Loss and Brier of each method of removing the vig, by cohort and band of the first method's chance, on rows that all methods price. Each distinct
    pair of prices is priced once, where pairs are few beside rows."""
    pair = [home_ml, away_ml]
    pairs = stored(df.select(*pair).distinct(), "pairs").withColumns({f"_{n}": f(F.col(home_ml), F.col(away_ml)) for n, f in methods.items()})
    pairs = stored(pairs, "fair-prices")  # once, however often the plan below names a chance
    first = F.col(f"_{next(iter(methods))}")
    rows = df.select(*by, *pair, y).join(pairs, pair).withColumn("band", F.floor(first / width).cast("int"))
    return compare_arms(rows, [*by, "band"], {n: F.col(f"_{n}") for n in methods}, y)


def nested_select(losses: DataFrame, season: str, arm: str, loss: str) -> DataFrame:
    """For each season the arm of least loss over the earlier seasons. losses: one row a season and arm."""
    test = losses.select(F.col(season).alias("test")).distinct()
    return best_arm(test.join(F.broadcast(losses), F.col(season) < F.col("test")), ["test"], arm, loss)


def leakage(df: DataFrame, key: Sequence[str], train_max: str, test: str) -> DataFrame:
    """Violations: rows trained on their own or later seasons, and keys that repeat."""
    late = df.where(F.col(train_max) >= F.col(test)).select(*key, F.lit("training reaches the test season").alias("why"))
    twice = df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key, F.lit("repeated key").alias("why"))
    return late.unionByName(twice)


def flat_bets(df: DataFrame, p: str, q: str, home_ml: str, away_ml: str, home_won: str, min_edge: float = 0.0) -> DataFrame:
    """One unit on the forecast's side (home on ties) where its edge over the fair price reaches a floor."""
    home = F.col(p) >= 0.5
    edge = F.when(home, F.col(p) - F.col(q)).otherwise(F.col(q) - F.col(p))
    ml = F.when(home, F.col(home_ml)).otherwise(F.col(away_ml))
    won = F.when(home, F.col(home_won) == 1).otherwise(F.col(home_won) == 0)
    out = df.withColumns({"pick_home": home, "edge": edge, "ml": ml, "won": won, "pick_q": F.when(home, F.col(q)).otherwise(1 - F.col(q))})
    return out.withColumn("bet_units", unit_profit(F.col("ml"), F.col("won"))).where(F.col("edge") >= min_edge)


def signals(df: DataFrame, p: str, q: str, home_ml: str, away_ml: str, min_edge: float = 0.0) -> DataFrame:
    """The same membership test without results."""
    return flat_bets(df.withColumn("_won", F.lit(None).cast("int")), p, q, home_ml, away_ml, "_won", min_edge).drop("_won", "won", "bet_units")


def shadow_record(df: DataFrame, p: str, q: str, w: float, home_ml: str, away_ml: str, home_won: str) -> DataFrame:
    """Paper bets of a blend: the side of larger positive expected value."""
    from ..functions.prices import position, shrink_p

    # a lambda variable is evaluated once; as a plain column the blend would be repeated all over the generated code
    both = F.transform(F.array(shrink_p(F.col(p), F.col(q), w)), lambda b: F.struct(b.alias("blend"), position(b, F.col(home_ml), F.col(away_ml)).alias("bet")))[0]
    side = df.withColumn("_b", both).select("*", "_b.*").drop("_b").where("bet is not null")
    home = F.col("bet") == "home"
    ml = F.when(home, F.col(home_ml)).otherwise(F.col(away_ml))
    won = F.when(home, F.col(home_won) == 1).otherwise(F.col(home_won) == 0)
    return side.withColumns({"ml": ml, "won": won, "bet_units": unit_profit(ml, won)})


def line_moves(df: DataFrame, by: Sequence[str], p: str, q_open: str, q_close: str, floors: Sequence[float]) -> DataFrame:
    """How far prices move toward the model, by floor of the first disagreement; price ties counted."""
    gap, move = F.col(p) - F.col(q_open), F.col(q_close) - F.col(q_open)
    toward = F.signum(gap) * move
    long = df.withColumn("floor", F.explode(F.filter(F.array(*(F.lit(float(f)) for f in floors)), lambda f: F.abs(gap) >= f)))
    return long.groupBy(*by, "floor").agg(F.count("*").alias("n"), F.avg(toward).alias("toward"), F.avg((toward > 0).cast("double")).alias("share_toward"), F.count_if(move == 0).alias("ties"))


def calibration_check(df: DataFrame, by: Sequence[str], p: str, y: str) -> DataFrame:
    """Mean forecast against rate for each population and stage."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(p).alias("forecast"), F.avg(F.col(y).cast("double")).alias("rate"), measure.se(F.col(y) - F.col(p)).alias("gap_se"))


def claimed_and_returned(bets: DataFrame, edge: str, ml: str, units: str, width: float = 0.02) -> DataFrame:
    """By bins of the claimed edge: claimed and realised return."""
    return bets.where(F.col(units).isNotNull()).groupBy(F.floor(F.col(edge) / width).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg(F.col(edge) * decimal_payout(F.col(ml))).alias("claimed"), F.avg(units).alias("returned"))


def second_half(df: DataFrame, key: Sequence[str], season: str, day: str, value: str, weight: str) -> DataFrame:
    """How well the first half of a season (cut at its median day) foretells the second, weighted."""
    cut = df.groupBy(season).agg(F.percentile(day, F.lit(0.5)).alias("_cut"))
    d = df.join(F.broadcast(cut), season).withColumn("_h", F.col(day) > F.col("_cut"))
    w = d.groupBy(*key, season).agg(F.avg(F.when(~F.col("_h"), F.col(value))).alias("a"), F.avg(F.when(F.col("_h"), F.col(value))).alias("b"), F.sum(F.when(F.col("_h"), F.col(weight))).alias("w")).where("a is not null and b is not null")
    return w.groupBy(season).agg((F.sum(F.abs(F.col("a") - F.col("b")) * F.col("w")) / F.sum("w")).alias("mae"), F.corr("a", "b").alias("corr"), F.count("*").alias("n"))


def band_rule(df: DataFrame, season: str, line: str, residual: str, n: int = 4) -> DataFrame:
    """Quantile bands of a line cut on earlier seasons; the sign of the band's median residual there is the bet."""
    seasons = df.select(F.col(season).alias("test")).distinct()
    train = df.select(F.col(season).alias("_s"), F.col(line).alias("_l"), F.col(residual).alias("_r")).join(F.broadcast(seasons), F.col("_s") < F.col("test"))
    cuts = quantiles(train, ["test"], F.col("_l"), {f"c{i}": i / n for i in range(1, n)}).select("test", F.array(*(f"c{i}" for i in range(1, n))).alias("cuts"))
    of = lambda c: F.aggregate("cuts", F.lit(0), lambda a, k: a + (c > k).cast("int"))
    sign = quantiles(train.join(F.broadcast(cuts), "test").withColumn("band", of(F.col("_l"))), ["test", "band"], F.col("_r"), {"m": 0.5}).select("test", "band", F.signum("m").alias("side"))
    rows = df.withColumn("test", F.col(season)).join(F.broadcast(cuts), "test").withColumn("band", of(F.col(line))).drop("cuts")
    return rows.join(F.broadcast(sign), ["test", "band"]).drop("test")


def holdout(df: DataFrame, day: str, days: int = 2) -> tuple[DataFrame, DataFrame]:
    """Rows before the last days, and those of the last days."""
    last = df.select(day).distinct().orderBy(F.desc(day)).limit(days).agg(F.min(day).alias("_cut"))
    d = df.join(F.broadcast(last))
    return d.where(F.col(day) < F.col("_cut")).drop("_cut"), d.where(F.col(day) >= F.col("_cut")).drop("_cut")


def gate(test: DataFrame, new: str, old: str) -> DataFrame:
    """One row: the new loss is not worse."""
    return test.agg(F.avg(new).alias("new"), F.avg(old).alias("old"), (F.avg(new) <= F.avg(old)).alias("accepted"))


def replay_difference(frozen: DataFrame, replayed: DataFrame, key: str, value: str) -> DataFrame:
    """Frozen and replayed values of the same rows compared."""
    j = frozen.select(key, F.col(value).alias("a")).join(replayed.select(key, F.col(value).alias("b")), key)
    d = F.col("b") - F.col("a")
    return j.agg(F.count("*").alias("n"), F.count_if(d != 0).alias("changed"), F.avg(F.abs(d)).alias("mean_change"), F.max(F.abs(d)).alias("largest"))


def hindsight(df: DataFrame, by: Sequence[str], p: str, home_ml: str, away_ml: str, home_won: str, margin: str, spread: str) -> DataFrame:
    """Record of a rebuilt season: straight up, at prices, against the spread."""
    from ..functions.prices import ats_result

    home = F.col(p) >= 0.5
    won = F.when(home, F.col(home_won) == 1).otherwise(F.col(home_won) == 0)
    ml = F.when(home, F.col(home_ml)).otherwise(F.col(away_ml))
    ats = ats_result(F.when(home, F.col(margin)).otherwise(-F.col(margin)), F.when(home, F.col(spread)).otherwise(-F.col(spread)))
    d = df.withColumns({"_w": won, "_u": unit_profit(ml, won), "_a": ats})
    return d.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col("_w").cast("long")).alias("wins"), F.sum("_u").alias("units"), F.count_if(F.col("_a") == 1).alias("covers"), F.count_if(F.col("_a") == 0.5).alias("pushes"))


def sweep(df: DataFrame, parameter: str, values: Sequence[float], score: Callable[[DataFrame, float], DataFrame]) -> DataFrame:
    """One scored frame for each value of a parameter, in long form."""
    out = None
    for v in values:
        part = score(df, v).withColumn(parameter, F.lit(float(v)))
        out = part if out is None else out.unionByName(part)
    return out


def frozen_evaluation(df: DataFrame, by: Sequence[str], x: Sequence[str], coef: Sequence[float], y: str) -> DataFrame:
    """A frozen fit on another era."""
    e = F.col(y) - fit.linear(x, coef)
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(e).alias("bias"), F.sqrt(F.avg(e * e)).alias("rmse"))


def verdict(seasons: DataFrame, diff: str, se: str, close_diff: float) -> DataFrame:
    """Pre-set reading of season differences (negative is better): the pooled interval excludes 0, most seasons agree, the close is not worse."""
    w = 1 / (F.col(se) * F.col(se))
    m, s = F.sum(F.col(diff) * w) / F.sum(w), F.sqrt(1 / F.sum(w))
    return seasons.agg(m.alias("pooled"), s.alias("pooled_se"), (m + 1.96 * s < 0).alias("excludes_zero"), (F.avg((F.col(diff) < 0).cast("double")) > 0.5).alias("most_seasons"), F.bool_and(F.lit(close_diff <= 0)).alias("close_ok"))


def source_comparison(df: DataFrame, sources: Sequence[str], actual: str, cluster: str) -> DataFrame:
    """Absolute error of each source on the rows that all have, with errors over clusters."""
    ok = F.lit(True)
    for c in [*sources, actual]:
        ok = ok & F.col(c).isNotNull()
    long = df.where(ok).select(cluster, F.explode(F.array(*(F.struct(F.lit(s).alias("source"), F.abs(F.col(s) - F.col(actual)).alias("e")) for s in sources))).alias("x")).select(cluster, "x.*")
    return measure.clustered_mean(long, cluster, "e", ["source"])


def tracking(df: DataFrame, part: Column, p: str, price: str, game: str) -> DataFrame:
    """Gap of a live forecast and a price by part of the game, each game weighing the same."""
    g = df.withColumn("part", part).withColumn("gap", F.abs(F.col(p) - F.col(price))).groupBy("part", game).agg(F.avg("gap").alias("m"))
    return g.groupBy("part").agg(F.avg("m").alias("gap"), F.count("*").alias("games"))


def trailing_rate(df: DataFrame, cell: Sequence[str], day: str, order: Sequence[str], y: str, n: int) -> DataFrame:
    """Rate of the latest n earlier rows of a cell (the estimate that B19 and W22 compare)."""
    t = latest_n_before(df, cell, day, order, [y], n)
    return t.withColumn("trailing", F.when(F.col("members") > 0, F.col(f"{y}_sum") / F.col("members")))
