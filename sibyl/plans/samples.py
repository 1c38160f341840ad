"""Queries of expected quarters, pace, fills, random splits, halves by experience and methods of removing the vig."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import prices as P
from ..operators import joins as J
from ..operators import pace as K
from ..operators import samples as R
from ..operators import walk as B
from .driver import games, query, ticks
from .prices import _PAIRS, _SIDE, _TEST

_QUARTERS = (1, 2, 3, 4)
_HOME, _AWAY = [f"20 + (game_id * {k}) % 13" for k in _QUARTERS], [f"18 + (game_id * {k + 3}) % 11" for k in _QUARTERS]


def _side(team: str, home: str, own: list[str], other: list[str]) -> str:
    cells = ", ".join(f"CAST({x} AS DOUBLE) AS o{k}, CAST({y} AS DOUBLE) AS d{k}" for k, x, y in zip(_QUARTERS, own, other, strict=True))
    return f"SELECT game_id, season, day, {team} AS team, {home} AS home, CAST(90 + (game_id * {7 if home == 'true' else 11}) % 23 AS DOUBLE) AS poss, {cells} FROM {{g}}"


#: Two teams a game, their quarters and possessions are arithmetic on the key.
_SIDES = f"{_side('game_id % 20', 'true', _HOME, _AWAY)} UNION ALL {_side('20 + floor(game_id / 20) % 20', 'false', _AWAY, _HOME)}"
_S = f"s AS ({_SIDES.format(g='g')})"
_PAST = "(PARTITION BY season, team ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_LEAGUE = "(PARTITION BY season ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def sides(spark, sf):
    return spark.sql(_SIDES.format(g="{g}").replace("{g}", "{rows}"), rows=games(spark, sf).select("game_id", "season", "day"))


def _each(template: str, sep: str = ", ") -> str:
    return sep.join(template.format(k=k) for k in _QUARTERS)


@query("W15", f"""WITH {_S}, p AS (SELECT *, count(*) OVER w AS n, {_each('avg(o{k}) OVER w AS po{k}, avg(d{k}) OVER w AS pd{k}')} FROM s WINDOW w AS {_PAST}),
    l AS (SELECT season, day, {_each('sum(s{k}) OVER v / sum(c) OVER v AS m{k}')} FROM (SELECT season, day, count(*) AS c, {_each('sum(o{k}) AS s{k}')} FROM s GROUP BY 1, 2) t WINDOW v AS {_LEAGUE}),
    x AS (SELECT h.game_id, h.season, h.day, h.n AS n_h, a.n AS n_a, {_each('(h.po{k} + a.pd{k}) / 2 + (a.po{k} + h.pd{k}) / 2 AS e{k}')} FROM p h JOIN p a ON h.game_id = a.game_id AND h.home AND NOT a.home)
    SELECT x.*, {_each('(e1 + e2 + e3 + e4) * m{k} / (m1 + m2 + m3 + m4) AS t{k}')}, {_each('2 * m{k} AS l{k}')} FROM x JOIN l USING (season, day)""", _each("e{k} t{k} l{k}", " "))
def expected_quarters(spark, sf):
    return K.expected_quarters(sides(spark, sf), "season", "team", "day", "game_id", "home", [f"o{k}" for k in _QUARTERS], [f"d{k}" for k in _QUARTERS])


@query("W37", f"""WITH {_S}, k AS (SELECT *, row_number() OVER (PARTITION BY season, team ORDER BY day, game_id) AS i FROM s),
    d AS (SELECT q.game_id, q.season, q.day, q.home, sum(p.poss * pow(0.5e0, (q.i - p.i) / 6e0)) / sum(pow(0.5e0, (q.i - p.i) / 6e0)) AS pace FROM k q LEFT JOIN k p ON q.season = p.season AND q.team = p.team AND p.i < q.i GROUP BY q.game_id, q.season, q.day, q.home),
    l AS (SELECT season, day, sum(t) OVER v / sum(c) OVER v AS league FROM (SELECT season, day, sum(poss) AS t, count(*) AS c FROM s GROUP BY 1, 2) t WINDOW v AS {_LEAGUE})
    SELECT h.game_id, h.season, h.day, h.pace AS pace_h, a.pace AS pace_a, league, ln((h.pace + a.pace) / 2 / league) AS lp, (h.pace - a.pace) * ln((h.pace + a.pace) / 2 / league) AS delta_lp
    FROM d h JOIN d a ON h.game_id = a.game_id AND h.home AND NOT a.home JOIN l ON l.season = h.season AND l.day = h.day""", "pace_h pace_a league lp delta_lp")
def game_pace(spark, sf):
    return K.game_pace(sides(spark, sf), "season", "team", "day", "game_id", "home", "poss", 6.0, F.col("pace_h") - F.col("pace_a"))


_SPLITS, _DRAWS = (3, 6), 4


@query("W36", f"""WITH d AS (SELECT game, event_id, value, draw FROM e, (SELECT unnest(range({_DRAWS})) AS draw) t WHERE value IS NOT NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY game, draw ORDER BY md5('7:' || draw || ':' || event_id), event_id) AS r, count(*) OVER (PARTITION BY game, draw) AS c FROM d),
    m AS (SELECT draw, game, {', '.join(f'avg(value) FILTER (r <= {n}) AS a{n}, avg(value) FILTER (r > {n} AND r <= {2 * n}) AS b{n}' for n in _SPLITS)} FROM r WHERE c >= {2 * max(_SPLITS)} GROUP BY 1, 2),
    z AS (SELECT draw, {', '.join(f'corr(a{n}, b{n}) AS c{n}' for n in _SPLITS)} FROM m GROUP BY 1), u AS ({' UNION ALL '.join(f'SELECT {n} AS n, avg(c{n}) AS reliability FROM z' for n in _SPLITS)})
    SELECT n, reliability, CASE WHEN reliability > 0 THEN n * (1 - reliability) / reliability END AS half_at FROM u""", "reliability half_at")
def split_reliability(spark, sf):
    return R.split_reliability(ticks(spark, sf), ["game"], "event_id", "value", _SPLITS, _DRAWS)


_LEVEL, _K, _EDGES = -2.0, 300.0, (300, 800)


def _pooled(seen: str, weight: str) -> str:
    return f"({_K}e0 * {_LEVEL}e0 + w0 * prior + {weight} * {seen}) / ({_K}e0 + w0 + {weight})"


@query("B14", f"""WITH c AS (SELECT season, floor(quantile_cont(CAST(day AS DOUBLE), 0.5)) AS cut FROM g GROUP BY 1),
    h AS (SELECT team, season, sum(margin * total) FILTER (day < cut) AS s1, sum(total) FILTER (day < cut) AS w1, sum(margin * total) FILTER (day >= cut) AS s2, sum(total) FILTER (day >= cut) AS w2, sum(margin * total) AS s, sum(total) AS w FROM g JOIN c USING (season) GROUP BY 1, 2),
    j AS (SELECT a.*, coalesce(b.w, 0) AS w0, coalesce(b.s / b.w, {_LEVEL}e0) AS prior FROM h a LEFT JOIN h b ON a.team = b.team AND a.season = b.season + 1 WHERE a.w1 > 0 AND a.w2 >= 100),
    x AS (SELECT CASE WHEN w0 = 0 THEN 0 WHEN w0 < {_EDGES[0]} THEN 1 WHEN w0 < {_EDGES[1]} THEN 2 ELSE 3 END AS experience, w2, s2 / w2 AS target, {_pooled('0', '0')} AS frozen, {_pooled('s1 / w1', 'w1')} AS pooled, s1 / w1 AS season_only FROM j),
    y AS ({' UNION ALL '.join(f"SELECT experience, '{n}' AS estimate, w2, target, {n} AS v FROM x" for n in ('frozen', 'pooled', 'season_only'))})
    SELECT experience, estimate, count(*) AS n, sum(w2 * abs(v - target)) / sum(w2) AS mae, CASE WHEN stddev_samp(v) > 1e-9 THEN corr(v, target) END AS corr FROM y GROUP BY 1, 2 HAVING count(*) >= 20""", "mae corr")
def half_estimates(spark, sf):
    return R.by_experience(R.half_estimates(games(spark, sf), ["team"], "season", "day", "margin", "total", _LEVEL, _K, 100.0), _EDGES)


_DAILY = "c AS (SELECT game, day, avg(value) AS quote FROM e WHERE kind = 'view' GROUP BY 1, 2), q AS (SELECT game, day, max(value) AS state FROM e WHERE kind = 'purchase' GROUP BY 1, 2)"


def _daily(spark, sf):
    t = ticks(spark, sf)
    of = lambda kind, v: t.where(F.col("kind") == kind).groupBy("game", "day").agg(v)
    return of("view", F.avg("value").alias("quote")), of("purchase", F.max("value").alias("state"))


@query("J07", f"WITH {_DAILY} SELECT c.game, c.day, c.quote, q.state, f.quote AS fill_quote FROM c ASOF LEFT JOIN q ON c.game = q.game AND c.day >= q.day LEFT JOIN c f ON f.game = c.game AND f.day = c.day + 2", "quote state fill_quote")
def filled_states(spark, sf):
    quotes, plays = _daily(spark, sf)
    return J.filled_states(quotes, plays, ["game"], "day", ["state"], ["quote"], 2)


@query("J16", f"WITH {_DAILY} SELECT c.game, c.day, c.quote, coalesce(q.state, c.quote - 1) AS state FROM c ASOF LEFT JOIN q ON c.game = q.game AND c.day > q.day", "quote state")
def values_before(spark, sf):
    quotes, plays = _daily(spark, sf)
    return J.value_before(quotes, plays, ["game"], "day", "state", F.col("quote") - 1)


def _halved(name: str, lo: str, hi: str, test: str) -> str:
    mid = "(lo + hi) / 2"
    return f"{name} AS (SELECT home_ml, away_ml, a, b, {lo} AS lo, {hi} AS hi, 0 AS i FROM m UNION ALL SELECT home_ml, away_ml, a, b, CASE WHEN {test} THEN {mid} ELSE lo END, CASE WHEN {test} THEN hi ELSE {mid} END, i + 1 FROM {name} WHERE i < 60)"


_SHIN = _SIDE.format("a").replace("z", "((lo + hi) / 2)")


@query("B11", _PAIRS + f"""{_halved('b', '0.2e0', '8e0', 'pow(a, (lo + hi) / 2) + pow(b, (lo + hi) / 2) > 1')}, {_halved('s', '0e0', '0.5e0', _TEST)},
    q AS (SELECT home_ml, away_ml, b.a / (b.a + b.b) AS proportional, pow(b.a, (b.lo + b.hi) / 2) AS power FROM b WHERE i = 60), z AS (SELECT home_ml, away_ml, CASE WHEN a + b <= 1 THEN a / (a + b) ELSE {_SHIN} END AS shin FROM s WHERE i = 60),
    x AS (SELECT basis, floor(proportional / 0.1e0) AS band, won, proportional, power, shin FROM g JOIN q USING (home_ml, away_ml) JOIN z USING (home_ml, away_ml)),
    l AS ({' UNION ALL '.join(f"SELECT basis, band, won, '{n}' AS arm, {n} AS p FROM x" for n in ('proportional', 'power', 'shin'))})
    SELECT basis, CAST(band AS INT) AS band, arm, count(*) AS n, avg(-ln(greatest(1e-6, least(1 - 1e-6, CASE WHEN won = 1 THEN p ELSE 1 - p END)))) AS loss, avg((p - won) * (p - won)) AS brier FROM l GROUP BY 1, 2, 3""", "loss brier")
def novig_arms(spark, sf):
    return B.novig_arms(games(spark, sf), ["basis"], "home_ml", "away_ml", "won", {"proportional": P.devig, "power": P.power_devig, "shin": P.shin_devig})
