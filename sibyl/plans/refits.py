"""Queries of fits with several regressors, aged and ablated fits, bootstraps of coefficients, and two-sided effects."""

from __future__ import annotations

from itertools import combinations, combinations_with_replacement

from pyspark.sql import functions as F

from ..operators import effects as E
from ..operators import refits as R
from .driver import games, query
from .oracles import drawn_sql, inverse_sql

X = ["spread", "pace", "p"]
_X = ["spread", "(total - 225) / 10", "p", "1e0"]
_PAIRS = list(combinations_with_replacement(range(4), 2))
_SUMS = ", ".join([*(f"sum({_X[i]} * {_X[j]}) AS h{i}{j}" for i, j in _PAIRS), *(f"sum({c} * margin) AS g{i}" for i, c in enumerate(_X)), "sum(margin * margin) AS yy", "CAST(count(*) AS DOUBLE) AS n"])
_NAMES = [*(f"h{i}{j}" for i, j in _PAIRS), *(f"g{i}" for i in range(4)), "yy", "n"]


def _coef(k: int) -> str:
    return ", ".join(" + ".join(f"({inverse_sql(k, i, j)}) * g{j}" for j in range(k)) + f" AS b{i}" for i in range(k))


def _rows(spark, sf):
    return games(spark, sf).withColumn("pace", (F.col("total") - 225) / 10)


def _terms(df, *names):
    return df.where("coef is not null").select(*names, *(F.col("coef")[i].alias(f"b{i}") for i in range(4)))


@query("B02", f"""WITH s AS (SELECT season, day, {_SUMS} FROM g GROUP BY 1, 2), c AS (SELECT season, day, {', '.join(f'sum({c}) OVER w AS {c}' for c in _NAMES)} FROM s WINDOW w AS (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT season, day, n::BIGINT AS train_rows, {_coef(4)} FROM c WHERE n >= 50""", "b0 b1 b2 b3")
def slate_refits_of_three(spark, sf):
    return _terms(R.slate_refits(_rows(spark, sf), X, "margin", "season", "day"), "season", "day", "train_rows")


@query("B03 B20", f"""WITH s AS (SELECT day, {_SUMS} FROM g GROUP BY 1), l AS (SELECT *, pow(2, (day - (SELECT min(day) FROM s)) / h) AS w FROM s, (SELECT unnest([25e0, 60e0, 120e0, 400e0, 1000e0]) AS h) x),
    c AS (SELECT h AS half_life, day, {', '.join(f'sum({c} * w) OVER o / w AS {c}' for c in _NAMES)} FROM l WINDOW o AS (PARTITION BY h ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT half_life, day, n AS weight, {_coef(4)} FROM c WHERE n >= 30""", "half_life weight b0 b1 b2 b3")
def half_life_refits(spark, sf):
    fits = R.aged_refits(_rows(spark, sf), X, "margin", "day", [25, 60, 120, 400, 1000])
    return _terms(fits.where("weight >= 30"), "half_life", "day", "weight")


def _arm(s: tuple[int, ...]) -> str:
    at = [*s, 3]
    k = len(at)
    low = lambda i, j: f"{min(at[i], at[j])}{max(at[i], at[j])}"
    train = ", ".join([*(f"c.h{low(i, j)} AS h{i}{j}" for i in range(k) for j in range(i, k)), *(f"c.g{a} AS g{i}" for i, a in enumerate(at)), *(f"t.h{low(i, j)} AS z{i}{j}" for i in range(k) for j in range(i, k)), *(f"t.g{a} AS y{i}" for i, a in enumerate(at)), "t.yy", "t.n"])
    error = " + ".join(["yy", *(f"-2 * b{i} * y{i}" for i in range(k)), *(f"b{i} * b{j} * z{min(i, j)}{max(i, j)}" for i in range(k) for j in range(k))])
    return f"SELECT season, '{','.join(X[i] for i in s)}' AS features, n::BIGINT AS n, ({error}) / n AS mse FROM (SELECT *, {_coef(k)} FROM (SELECT t.season, {train} FROM c JOIN s t USING (season) WHERE c.n IS NOT NULL) a) b"


_SUBSETS = [s for n in range(4) for s in combinations(range(3), n)]


@query("B19", f"""WITH s AS (SELECT season, {_SUMS} FROM g GROUP BY 1), c AS (SELECT season, {', '.join(f'sum({c}) OVER w AS {c}' for c in _NAMES)} FROM s WINDOW w AS (ORDER BY season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    m AS ({' UNION ALL '.join(map(_arm, _SUBSETS))}) SELECT season, features, n, sqrt(mse) AS rmse, mse - max(mse) FILTER (features = '{','.join(X)}') OVER (PARTITION BY season) AS added FROM m""", "rmse added")
def feature_ablation(spark, sf):
    return R.ablation(_rows(spark, sf), X, "margin", "season")


@query("R04", f"""WITH s AS (SELECT slate, {_SUMS} FROM g GROUP BY 1), r AS (SELECT rep, {', '.join(f'sum(k * {c}) AS {c}' for c in _NAMES)} FROM {drawn_sql('s', 'slate', 13)} d GROUP BY 1), b AS (SELECT {_coef(4)} FROM r)
    {' UNION ALL '.join(f"SELECT '{n}' AS term, avg(b{i}) AS coef, stddev_samp(b{i}) AS se FROM b" for i, n in enumerate([*X, 'one']))}""", "coef se")
def coefficient_bootstrap(spark, sf):
    return R.coefficient_bootstrap(_rows(spark, sf), "slate", X, "margin")


#: Teams of the two-sided fit.
_TEAMS = 120


@query("A28", f"WITH m AS (SELECT team % {_TEAMS} AS home, (game_id * 31 + team * 17) % {_TEAMS} AS away FROM g), t AS (SELECT home AS team FROM m UNION SELECT away FROM m) SELECT team, 0e0 AS gradient FROM t", "gradient")
def team_effects(spark, sf):
    """The gradient of the squared error at each team's effect is 0: the effects are the least squares."""
    c = F.col
    g = games(spark, sf).select((c("team") % _TEAMS).alias("home"), ((c("game_id") * 31 + c("team") * 17) % _TEAMS).alias("away"), "margin")
    found, _, _ = E.team_effects(g, "home", "away", "margin")
    return found.select("team", F.round("gradient", 5).alias("gradient"))
