"""Expected quarters and pace of a game from what both teams and the league did on earlier days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .causal import before_day, decayed_mean
from .order import beside


def league_means(rows: DataFrame, season: Sequence[str], day: str, values: Sequence[str]) -> DataFrame:
    """Rows (season.., day, league_v..): mean of each value over all rows of earlier days. The window is over one row a day; nulls do not count."""
    daily = rows.groupBy(*season, day).agg(*(x for v in values for x in (F.sum(v).alias(f"_s_{v}"), F.count(v).alias(f"_c_{v}"))))
    past = Window.partitionBy(*season).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    mean = lambda v: F.when(F.sum(f"_c_{v}").over(past) > 0, F.sum(f"_s_{v}").over(past) / F.sum(f"_c_{v}").over(past))
    return daily.select(*season, day, *(mean(v).alias(f"league_{v}") for v in values))


def _sides(rows: DataFrame, game: Sequence[str], home: str, values: Sequence[str]) -> DataFrame:
    """One row a game with h_v and a_v of its two sides; games without both are left out."""
    of = lambda v, at, name: F.max(F.when(at, F.col(v))).alias(name)
    both = rows.groupBy(*game).agg(F.count_if(F.col(home)).alias("_h"), F.count_if(~F.col(home)).alias("_a"), *(x for v in values for x in (of(v, F.col(home), f"h_{v}"), of(v, ~F.col(home), f"a_{v}"))))
    return both.where("_h > 0 and _a > 0").drop("_h", "_a")


def expected_quarters(sides: DataFrame, season: str, team: str, day: str, game: str, home: str, scored: Sequence[str], allowed: Sequence[str]) -> DataFrame:
    """Rows (game, season, day, n_h, n_a, e1.., t1.., l1..), one for each game with two sides.

    e: points expected in a quarter, each side the mean of what it scored and what the other allowed on earlier days of the season; t: the
    sum of e dealt by the league's shares of the quarters so far, pace without shape; l: twice the league's mean. n_h and n_a are earlier
    games. Without earlier games of a team e and t are null, on a season's first day l too.
    """
    past = before_day([season, team], day)
    names = [*scored, *allowed]
    means = sides.withColumns({"_n": F.count("*").over(past)} | {f"_m_{c}": F.avg(c).over(past) for c in names})
    rows = _sides(means, [game, season, day], home, ["_n", *(f"_m_{c}" for c in names)])
    rows = beside(rows, league_means(sides, [season], day, scored), [season, day], [f"league_{c}" for c in scored])
    e = [(F.col(f"h__m_{s}") + F.col(f"a__m_{a}")) / 2 + (F.col(f"a__m_{s}") + F.col(f"h__m_{a}")) / 2 for s, a in zip(scored, allowed, strict=True)]
    level = [F.col(f"league_{s}") for s in scored]
    whole, league = sum(e[1:], e[0]), sum(level[1:], level[0])
    out = [(c.alias(f"e{k}"), (whole * F.try_divide(v, league)).alias(f"t{k}"), (2 * v).alias(f"l{k}")) for k, (c, v) in enumerate(zip(e, level, strict=True), 1)]
    return rows.select(game, season, day, F.col("h__n").alias("n_h"), F.col("a__n").alias("n_a"), *(x for part in zip(*out, strict=True) for x in part))


def game_pace(sides: DataFrame, season: str, team: str, day: str, game: str, home: str, possessions: str, half_life: float, delta: Column | None = None) -> DataFrame:
    """Rows (game, season, day, pace_h, pace_a, league, lp): decayed mean possessions of each team's earlier games of the season, the mean of all
    earlier days of the season, and lp = ln((pace_h + pace_a) / 2 / league), null without one of the three. delta: an expression over these
    columns and the game's; delta_lp is its product with lp."""
    own = decayed_mean(sides, [season, team], [day, game], possessions, half_life, "_pace")
    rows = _sides(own, [game, season, day], home, ["_pace"]).withColumnsRenamed({"h__pace": "pace_h", "a__pace": "pace_a"})
    rows = beside(rows, league_means(sides, [season], day, [possessions]), [season, day], [f"league_{possessions}"]).withColumnRenamed(f"league_{possessions}", "league")
    ratio = (F.col("pace_h") + F.col("pace_a")) / 2 / F.col("league")
    rows = rows.withColumn("lp", F.when(ratio > 0, F.ln(ratio)))
    return rows if delta is None else rows.withColumn("delta_lp", delta * F.col("lp"))
