"""Queries of team and player totals, rosters, reports, feeds and tables on disk, each over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import features as E
from ..functions import prices as P
from ..functions.normal import norm_cdf_sql
from ..operators import causal as W
from ..operators import fit as M
from ..operators import joins as J
from ..operators import scope as K
from ..operators import walk as B
from ..operators.tables import new_path
from ..sources import feeds
from .driver import games, query, table, ticks
from .oracles import newton_sql, terms_sql
from .prices import QSQL, priced

# ---------------------------------------------------------------- totals of a team, its opponents and a player, by game


def _totals(a: str, b: str) -> dict[str, str]:
    """Totals of one side as arithmetic on two numbers; both engines read the same text."""
    whole = {
        "fgm": f"30 + {b} % 15", "fga": f"78 + {a} % 20", "tpm": f"6 + {b} % 9", "tpa": f"25 + {a} % 13", "ftm": f"10 + {b} % 6", "fta": f"16 + ({a} + {b}) % 12", "orb": f"6 + {a} % 9",
        "drb": f"28 + {b} % 11", "tov": f"9 + ({a} + {b}) % 10", "ast": f"18 + {a} % 12", "stl": f"5 + {b} % 6", "blk": f"3 + {a} % 5", "pf": f"15 + {b} % 9", "minutes": "240",
    }
    whole["pts"] = f"2 * ({whole['fgm']}) + {whole['tpm']} + {whole['ftm']}"
    return {k: f"CAST({v} AS DOUBLE)" for k, v in whole.items()}


_A, _B = "(game_id * 31 + team * 17) % 1000", "(game_id * 7919 + team * 104729) % 97"
_SIDES = {"t": _totals(f"({_A})", f"({_B})"), "o": _totals(f"(({_A} + 333) % 1000)", f"(({_B} + 41) % 97)")}
_PLAYER = {k: f"CAST({v} * 0.2e0 AS DOUBLE)" for k, v in _SIDES["t"].items()} | {"minutes": f"CAST(30 + {_B} % 8 AS DOUBLE)"}
_ROWS = "SELECT game_id, season, " + ", ".join(f"{v} AS {side}_{k}" for side, own in (*_SIDES.items(), ("p", _PLAYER)) for k, v in own.items()) + " FROM g"


def _sides(spark, sf):
    own = lambda totals: F.struct(*(F.expr(v).alias(k) for k, v in totals.items()))
    return games(spark, sf).select("game_id", "season", own(_SIDES["t"]).alias("t"), own(_SIDES["o"]).alias("o"), own(_PLAYER).alias("p"))


def _poss(t: str, o: str) -> str:
    return f"({t}_fga + 0.4e0 * {t}_fta - 1.07e0 * {t}_orb / ({t}_orb + {o}_drb) * ({t}_fga - {t}_fgm) + {t}_tov)"


_MEAN = f"(({_poss('t', 'o')} + {_poss('o', 't')}) / 2)"
_W = [0.5, 0.3, 0.2, 0.1, 0.6, 0.25, 0.15, 0.05]


def _factors(opp_fgm: str = "o_fgm", opp_tpm: str = "o_tpm", share: bool = False) -> list[str]:
    mean = _MEAN.replace("o_fgm", f"({opp_fgm})") if opp_fgm != "o_fgm" else _MEAN
    rebounds = ("t_orb / (t_orb + o_drb)", "o_orb / (o_orb + t_drb)") if share else (f"t_orb / {mean}", f"o_orb / {mean}")
    return [
        "100 * (t_fgm + 0.5e0 * t_tpm) / t_fga", f"-100 * t_tov / {mean}", f"100 * {rebounds[0]}", "100 * t_fta / t_fga",
        f"-100 * (({opp_fgm}) + 0.5e0 * ({opp_tpm})) / o_fga", f"100 * o_tov / {mean}", f"-100 * {rebounds[1]}", "-100 * o_fta / o_fga",
    ]


def _sum(parts: list[str], weights: list[float]) -> str:
    return "(" + " + ".join(f"{w}e0 * ({x})" for w, x in zip(weights, parts, strict=True)) + ")"


@query("E01", f"WITH t AS ({_ROWS}) SELECT game_id, {_poss('t', 'o')} AS poss, {_MEAN} AS both_poss FROM t", "poss both_poss")
def possession_estimate(spark, sf):
    c = F.col
    return _sides(spark, sf).select("game_id", E.possessions(c("t"), c("o")).alias("poss"), E.mean_possessions(c("t"), c("o")).alias("both_poss"))


@query("E02", f"WITH t AS ({_ROWS}) SELECT game_id, {', '.join(f'{x} AS f{i}' for i, x in enumerate(_factors()))}, {_factors(share=True)[2]} AS own_share, {_factors(share=True)[6]} AS opp_share FROM t", "f0 f1 f2 f3 f4 f5 f6 f7 own_share opp_share")
def factor_vector(spark, sf):
    c = F.col
    t = _sides(spark, sf).select("game_id", E.eight_factors(c("t"), c("o")).alias("f"), E.eight_factors(c("t"), c("o"), True).alias("g"))
    return t.select("game_id", *(c("f")[i].alias(f"f{i}") for i in range(8)), c("g")[2].alias("own_share"), c("g")[6].alias("opp_share"))


@query("E03", f"WITH t AS ({_ROWS}) SELECT game_id, {_sum(_factors('o_fgm - o_tpm + o_tpa * 0.36e0', 'o_tpa * 0.36e0'), _W)} - {_sum(_factors(), _W)} AS luck FROM t", "luck")
def three_point_luck(spark, sf):
    return _sides(spark, sf).select("game_id", E.luck(F.col("t"), F.col("o"), F.lit(0.36), F.array(*map(F.lit, _W))).alias("luck"))


@query("E13", f"WITH t AS ({_ROWS}) SELECT game_id, {_sum(_factors()[:4], _W[:4])} AS off, {_sum(_factors()[4:], _W[4:])} AS def, {_sum(_factors(), _W)} AS total_gap, {_sum(_factors()[:4], _W[:4])} * {_sum(_factors()[4:], _W[4:])} AS cross_term FROM t", "off def total_gap cross_term")
def factor_halves(spark, sf):
    t = _sides(spark, sf).select("game_id", E.eight_factors(F.col("t"), F.col("o")).alias("f"))
    return t.select("game_id", *E.halves(F.col("f"), F.array(*map(F.lit, _W)))).withColumnsRenamed({"cross": "cross_term", "both": "total_gap"})


_LINE = "(1 - (1 - {0}_ftm / {0}_fta) * (1 - {0}_ftm / {0}_fta))"
_SHARES = f"""WITH t AS ({_ROWS}), l AS (SELECT season, sum(t_pts) AS l_pts, sum({_MEAN}) AS l_poss, sum(t_minutes) AS l_minutes, count(*) AS l_games FROM t GROUP BY 1),
a AS (SELECT *, {_MEAN} AS poss, p_minutes / (t_minutes / 5) AS mp5, t_fgm + {_LINE.format('t')} * t_fta * 0.4e0 AS sc, t_orb / (t_orb + o_drb) AS tr, o_orb / (o_orb + t_drb) AS dor, o_fgm / o_fga AS dfg,
    0.5e0 * ((t_pts - t_ftm) - (p_pts - p_ftm)) / (2 * (t_fga - p_fga)) * p_ast AS mates FROM t JOIN l USING (season)),
b AS (SELECT *, sc / (t_fga + t_fta * 0.4e0 + t_tov) AS play, 1 - 0.5e0 * ((p_pts - p_ftm) / (2 * p_fga)) * (mp5 * 1.14e0 * (t_ast - p_ast) / t_fgm + (t_ast / t_minutes * p_minutes * 5 - p_ast) / (t_fgm / t_minutes * p_minutes * 5 - p_fgm) * (1 - mp5)) AS shooting,
    dfg * (1 - dor) / (dfg * (1 - dor) + (1 - dfg) * dor) AS fm, 1 - 1.07e0 * dor AS live FROM a),
c AS (SELECT *, (1 - tr) * play / ((1 - tr) * play + tr * (1 - play)) AS w FROM b),
d AS (SELECT *, 1 - t_orb / sc * w * play AS keep, p_orb * w * play AS boards, 0.32e0 * l_pts / l_games * (48 * (2 * poss) / (2 * (t_minutes / 5))) / (48 * l_poss / (l_minutes / 5)) AS per_win, l_pts / l_poss AS ppp,
    p_stl + p_blk * fm * live + p_drb * (1 - fm) + ((o_fga - o_fgm - t_blk) / t_minutes * fm * live + (o_tov - t_stl) / t_minutes) * p_minutes + p_pf / t_pf * 0.4e0 * o_fta * (1 - o_ftm / o_fta) * (1 - o_ftm / o_fta) AS stops FROM c),
e2 AS (SELECT *, (p_fgm * shooting + mates + {_LINE.format('p')} * 0.4e0 * p_fta) * keep + boards + (p_fga - p_fgm) * (1 - 1.07e0 * tr) + (1 - {_LINE.format('p')}) * 0.4e0 * p_fta + p_tov AS used,
    (2 * (p_fgm + 0.5e0 * p_tpm) * shooting + 2 * (t_fgm - p_fgm + 0.5e0 * (t_tpm - p_tpm)) / (t_fgm - p_fgm) * mates + p_ftm) * keep + boards * t_pts / sc AS produced, stops * o_minutes / (poss * p_minutes) AS stop_share, 100 * o_pts / poss AS rtg FROM d)
SELECT game_id, (produced - 0.92e0 * ppp * used) / per_win AS offence, p_minutes / t_minutes * poss * (1.08e0 * ppp - (rtg + 0.2e0 * (100 * o_pts / (o_fgm + {_LINE.format('o')} * o_fta * 0.4e0) * (1 - stop_share) - rtg)) / 100) / per_win AS defence FROM e2"""


@query("E10", _SHARES, "offence defence")
def win_share_rows(spark, sf):
    c = F.col
    t = _sides(spark, sf)
    league = t.groupBy("season").agg(F.struct(F.sum("t.pts").alias("pts"), F.sum(E.mean_possessions(c("t"), c("o"))).alias("poss"), F.sum("t.minutes").alias("minutes"), F.count("*").alias("games")).alias("l"))
    return E.win_shares(t.join(F.broadcast(league), "season"), "p", "t", "o", "l").select("game_id", "offence", "defence")


_LIVE = "WITH x AS (SELECT *, margin / 4 AS lead_now, game_id % 10 / 10e0 AS left_now FROM g), y AS (SELECT *, CASE WHEN left_now <= 0 THEN 300 / 2880e0 ELSE left_now END AS t FROM x)"
_OVER = "CASE WHEN left_now <= 0 AND lead_now <> 0 THEN CASE WHEN lead_now > 0 THEN 1e0 ELSE 0e0 END ELSE {0} END"


@query("E09", f"{_LIVE}, z AS (SELECT *, (0.08e0 - 0.01e0 * t) * lead_now / sqrt(t) + (CASE WHEN t <= 0.5 THEN 0.07e0 ELSE 0.07e0 + (t - 0.5e0) * 0.01e0 END) * spread * sqrt(t) AS z FROM y) SELECT game_id, {_OVER.format(norm_cdf_sql('z'))} AS p FROM z", "p")
def live_wins(spark, sf):
    c = F.col
    left = (c("game_id") % 10) / 10.0
    return games(spark, sf).select("game_id", E.live_win(c("margin") / 4, c("spread"), left, [0.0, 0.5, 1.0], F.array(F.lit(0.08), F.lit(0.075), F.lit(0.07)), F.array(F.lit(0.07), F.lit(0.07), F.lit(0.075))).alias("p"))


@query("E06 E07 E08 E09", f"""{_LIVE}, z AS (SELECT *, (total - 220.5e0) / CASE WHEN game_id % 20 < 10 THEN 19 ELSE 17 END AS o, (lead_now + spread * t) / (13 * sqrt(t)) AS b FROM y)
    SELECT game_id, {norm_cdf_sql('o')} AS p_over, {_OVER.format(norm_cdf_sql('b'))} AS live, CASE WHEN game_id % 3 = 0 THEN 'report_v11' ELSE 'base_v11' END AS tag FROM z""", "p_over live")
def live_chances(spark, sf):
    c = F.col
    g = games(spark, sf)
    left = (c("game_id") % 10) / 10.0
    return g.select("game_id", E.p_over(c("total"), F.lit(220.5), c("game_id") % 20, 19.0, 17.0).alias("p_over"), E.brownian_win(c("margin") / 4, c("spread"), left, 13.0).alias("live"), E.route(F.when(c("game_id") % 3 == 0, c("p")), c("p"), F.lit(0.5), "v11")["tag"].alias("tag"))


# ---------------------------------------------------------------- books, reports, rosters


@query("P14", "SELECT game_id, CASE WHEN home_ml IS NOT NULL AND away_ml IS NOT NULL AND book = '1-URGENT' THEN 'own' WHEN close_home_ml IS NOT NULL AND close_away_ml IS NOT NULL THEN 'b' WHEN home_ml IS NOT NULL AND away_ml IS NOT NULL THEN 'own' END AS picked FROM g")
def picked_books(spark, sf):
    c = F.col
    book = lambda n, h, a: F.struct(F.lit(n).alias("book"), c(h).alias("home"), c(a).alias("away"))
    g = games(spark, sf).withColumn("books", F.array(book("own", "home_ml", "away_ml"), book("b", "close_home_ml", "close_away_ml")))
    return g.select("game_id", P.pick_book(c("books"), ["b", "own"], F.when(c("book") == "1-URGENT", F.lit("own")))["book"].alias("picked"))


@query("F12", """SELECT game_id FROM (SELECT game_id, game_id % 4 AS k, (game_id * 7919 + team * 104729) % 97 % 10 = 0 AS late_home, (game_id * 7919 + team * 104729) % 97 % 10 = 1 AND game_id % 4 IN (1, 3) AS late_away FROM g) t WHERE k IN (0, 1) AND NOT late_home AND NOT late_away""")
def covered_games(spark, sf):
    """Every game has a slate of its own, so that its report is known: a matchup with one team (0), both teams (1), one team (2), none (3)."""
    c = F.col
    g = games(spark, sf).withColumn("r", F.expr("(game_id * 7919 + team * 104729) % 97")).select(c("game_id"), c("game_id").alias("slate"), c("team").alias("home"), (c("team") + 1000000000).alias("away"), (c("game_id") % 4).alias("k"), (c("r") % 10).alias("r"))
    status = lambda late: F.when(late, "PENDING").otherwise("Out").alias("status")
    none = F.lit(None).cast("long")
    first = g.where("k < 3").select("slate", c("home").alias("team"), status(c("r") == 0), F.when(c("k") == 0, c("away")).alias("away"), F.when(c("k") == 0, c("home")).alias("home"))
    second = g.where("k = 1 or (k = 3 and r = 1)").select("slate", c("away").alias("team"), status(c("r") == 1), none.alias("away"), none.alias("home"))
    return K.covered(g.select("game_id", "slate", "home", "away"), first.unionByName(second)).select("game_id")


@query("W16", """WITH box AS (SELECT kind AS team, day, game AS member, sum(value) AS minutes FROM e GROUP BY 1, 2, 3),
    d AS (SELECT DISTINCT team, day FROM box), m AS (SELECT DISTINCT team, member FROM box), grid AS (SELECT d.team, day, member, coalesce(minutes, 0) AS minutes FROM d JOIN m USING (team) LEFT JOIN box USING (team, day, member)),
    w AS (SELECT *, avg(minutes) OVER (PARTITION BY team, member ORDER BY day ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS mean, max(minutes) OVER (PARTITION BY team, member ORDER BY day ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS seen FROM grid)
    SELECT team, day, coalesce(sum(CASE WHEN seen > 0 AND mean >= 4 AND minutes = 0 THEN mean END), 0) / 240e0 AS absent_share FROM w GROUP BY 1, 2""", "absent_share")
def absent_minutes(spark, sf):
    box = ticks(spark, sf).groupBy(F.col("kind").alias("team"), "day", F.col("game").alias("member")).agg(F.sum("value").alias("minutes"))
    grid = box.select("team", "day").distinct().join(box.select("team", "member").distinct(), "team").join(box, ["team", "day", "member"], "left")
    return W.absences(grid, ["team"], ["day"], "minutes", 4.0)


@query("J15", """WITH d AS (SELECT team, day, sum(amount) FILTER (margin > 0) AS s FROM g GROUP BY 1, 2) SELECT team, day, last_value(s IGNORE NULLS) OVER (PARTITION BY team ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS talent FROM d""", "talent")
def roster_before(spark, sf):
    return J.previous_roster(games(spark, sf), ["team"], "day", "game_id", "margin", F.col("amount"))


_FILL = """WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity AS m, CASE WHEN l_partkey % 7 > 0 THEN CAST(1 + l_partkey % 5 AS DOUBLE) END AS pos, l_suppkey % 4 = 0 AS gone FROM lineitem),
    j AS (SELECT p.l_orderkey, p.l_linenumber, q.l_linenumber AS g, q.m AS mm, p.m AS e, p.m * CASE WHEN q.pos IS NULL THEN 1 WHEN p.pos IS NULL THEN 0.5 ELSE greatest(0, 1 - abs(p.pos - q.pos) / 2) END AS w FROM x p JOIN x q ON p.l_orderkey = q.l_orderkey AND q.gone AND NOT p.gone),
    s AS (SELECT *, sum(w) OVER o AS sw, sum(e) OVER o AS se FROM j WINDOW o AS (PARTITION BY l_orderkey, g)),
    f AS (SELECT l_orderkey, l_linenumber, sum(mm * CASE WHEN sw > 0 THEN w / sw ELSE e / se END) AS extra FROM s GROUP BY 1, 2)
    SELECT x.l_orderkey, x.l_linenumber, coalesce(extra, 0) AS extra FROM x LEFT JOIN f USING (l_orderkey, l_linenumber) WHERE NOT gone"""


@query("J18", _FILL, "extra")
def filled_positions(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("id"), F.col("l_quantity").alias("m"), F.when(F.col("l_partkey") % 7 > 0, (1 + F.col("l_partkey") % 5).cast("double")).alias("pos"), (F.col("l_suppkey") % 4 == 0).alias("gone"))
    return J.positional_fill(li.where("gone"), li.where("not gone"), ["l_orderkey"], "pos", "m").select("l_orderkey", F.col("id").alias("l_linenumber"), "extra")


@query("J06", """WITH t AS (SELECT game, (day - min(day) OVER (PARTITION BY game)) AS since, event_id, value FROM e), m AS (SELECT game, max(since) AS stop FROM t GROUP BY 1), gr AS (SELECT game, unnest(range(0, stop + 1, 2)) AS grid FROM m),
    r AS (SELECT game, since, max(event_id) AS event_id FROM t GROUP BY 1, 2) SELECT gr.game, CAST(gr.grid AS INT) AS grid, r.event_id FROM gr ASOF LEFT JOIN r ON gr.game = r.game AND gr.grid >= r.since""")
def states_on_a_grid(spark, sf):
    from pyspark.sql import Window

    t = ticks(spark, sf).withColumn("at", F.col("day") - F.min("day").over(Window.partitionBy("game")))
    return J.grid_states(t, ["game"], "at", ["event_id"], 2, "at").select("game", "grid", "event_id")


@query("J29 J22 Q02", """WITH pr AS (SELECT * FROM (SELECT game AS team, kind AS name, sec AS ts, value AS points, row_number() OVER (PARTITION BY game, kind ORDER BY sec DESC, value DESC) AS k FROM e) y WHERE k = 1),
    sal AS (SELECT day AS slate, game AS team, kind AS name, max(1000 + event_id % 500) AS salary FROM e GROUP BY 1, 2, 3), sch AS (SELECT day AS slate, game AS team, min(event_id) AS game_id FROM e WHERE event_id % 3 > 0 GROUP BY 1, 2),
    ra AS (SELECT game AS team, kind AS name, avg(value) AS rate FROM e GROUP BY 1, 2)
    SELECT slate, team, name, salary, game_id, points, rate, CAST(row_number() OVER (PARTITION BY slate ORDER BY points / salary DESC NULLS LAST, team, name) AS INT) AS value_rank
    FROM sal LEFT JOIN sch USING (slate, team) LEFT JOIN (SELECT team, name, points FROM pr) p USING (team, name) LEFT JOIN ra USING (team, name)""", "points rate")
def assembled_slates(spark, sf):
    c = F.col
    t = ticks(spark, sf).select(c("day").alias("slate"), c("game").alias("team"), c("kind").alias("name"), c("sec").alias("ts"), c("value").alias("points"), "event_id")
    salaries = t.groupBy("slate", "team", "name").agg(F.max(1000 + c("event_id") % 500).alias("salary"))
    latest = t.groupBy("team", "name", "ts").agg(F.max("points").alias("points"))
    return J.daily_slate(salaries, t.where("event_id % 3 > 0").groupBy("slate", "team").agg(F.min("event_id").alias("game_id")), latest, t.groupBy("team", "name").agg(F.avg("points").alias("rate")))


# ---------------------------------------------------------------- trailing cells, sources, fits


_TRAIL = """SELECT game_id, {0} AS size, coalesce(sum(b_won), 0) AS wins, count(b_won) AS members FROM (SELECT a.game_id, b.won AS b_won, row_number() OVER (PARTITION BY a.game_id ORDER BY b.day DESC, b.game_id DESC) AS k FROM g a LEFT JOIN g b ON a.team = b.team AND b.day < a.day) t {1} GROUP BY 1"""


@query("W22", f"WITH t AS ({_TRAIL.format(3, 'WHERE k <= 3')} UNION ALL {_TRAIL.format(0, '')}) SELECT game_id, size, members, members > 0 AND wins / members > p AS bet FROM t JOIN g USING (game_id)")
def break_even_bets(spark, sf):
    t = W.break_even(games(spark, sf), ["team"], "day", ["game_id"], "won", "p", [3, None])
    return t.select("game_id", F.col("window").alias("size"), F.col("members").cast("long").alias("members"), "bet")


@query("B19", f"WITH t AS ({_TRAIL.format(5, 'WHERE k <= 5')}) SELECT game_id, CASE WHEN members > 0 THEN wins / members END AS rate FROM t", "rate")
def trailing_rates(spark, sf):
    return B.trailing_rate(games(spark, sf), ["team"], "day", ["game_id"], "won", 5).select("game_id", F.col("trailing").alias("rate"))


@query("B24", """WITH a AS (SELECT slate, unnest(['home_ml', 'away_ml']) AS source, unnest([abs(home_ml - amount / 1000), abs(away_ml - amount / 1000)]) AS x FROM g WHERE home_ml IS NOT NULL AND away_ml IS NOT NULL),
    m AS (SELECT source, avg(x) AS mean, count(*) AS n FROM a GROUP BY 1), c AS (SELECT source, slate, sum(x) AS s, count(*) AS c FROM a GROUP BY 1, 2)
    SELECT source, any_value(n) AS n, any_value(mean) AS mean, sqrt(sum((s - c * mean) * (s - c * mean))) / any_value(n) AS se FROM c JOIN m USING (source) GROUP BY 1""", "mean se")
def source_errors(spark, sf):
    return B.source_comparison(games(spark, sf).withColumn("actual", F.col("amount") / 1000), ["home_ml", "away_ml"], "actual", "slate")


@query("M11", f"{newton_sql('g', ['ln(p / (1 - p))'], 'won')} SELECT b0 AS slope, se0 AS slope_se, b1 AS intercept, se1 AS intercept_se FROM f", "slope slope_se intercept intercept_se")
def calibration_line(spark, sf):
    return spark.createDataFrame([M.calibration_slope(games(spark, sf), "p", "won")], "slope double, slope_se double, intercept double, intercept_se double")


@query("M12", f"{newton_sql(f'(SELECT *, {QSQL} AS q FROM g) a WHERE q IS NOT NULL', ['ln(q / (1 - q))', 'ln(p / (1 - p)) - ln(q / (1 - q))'], 'won')} {terms_sql(['market', 'disagreement', 'one'])}", "coef se")
def disagreement_fit(spark, sf):
    g = M.disagreement_weight(priced(spark, sf).where("q is not null"), "p", "q", "won")
    return spark.createDataFrame([(n, float(b), float(s)) for n, b, s in zip(["market", "disagreement", "one"], g.beta, g.se, strict=True)], "term string, coef double, se double")


# ---------------------------------------------------------------- feeds and tables on disk


def _folder(spark) -> str:
    return new_path(spark, "tables")


@query("S01", "SELECT o_orderkey, o_orderstatus, o_totalprice, 'dk' AS book, CAST(NULL AS DOUBLE) AS spread FROM orders", "o_totalprice spread")
def evolved_ledger(spark, sf):
    """Orders as a CSV of an old vintage, read in the full schema."""
    old = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_orderstatus", T.StringType()), T.StructField("o_totalprice", T.DoubleType())])
    full = T.StructType([*old.fields, T.StructField("book", T.StringType()), T.StructField("spread", T.DoubleType())])
    path = _folder(spark)
    table(spark, sf, "orders").select(*old.names).write.option("header", True).csv(path)
    return feeds.evolved_csv(spark, path, [old, full], full, {"book": "dk"})


@query("S02", "SELECT season, slate, game_id, amount FROM g", "amount")
def sorted_table(spark, sf):
    path = _folder(spark)
    feeds.write_sorted(games(spark, sf).select("season", "slate", "game_id", "amount"), path, "season", ["slate", "game_id"])
    return spark.read.parquet(path).select("season", "slate", "game_id", "amount")


@query("S03 S04", "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderpriority FROM orders")
def strict_logs(spark, sf):
    """Orders in one CSV folder a year, read by a pattern."""
    path = _folder(spark)
    table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", F.year("o_orderdate").alias("y")).write.partitionBy("y").option("header", True).csv(path)
    return feeds.strict_csv(spark, f"{path}/y=*", ["o_orderkey", "o_orderpriority"]).drop("source_file")


@query("S05", "SELECT game_id, amount FROM g WHERE won = 0", "amount")
def appended_ids(spark, sf):
    """All games offered to a table that holds those won: equal repeats are left out."""
    g = games(spark, sf).select("game_id", "amount", "won", F.current_timestamp().alias("captured"))
    return feeds.append_by_id(g.where("won = 1").withColumn("captured", F.lit(None).cast("timestamp")), g, "game_id", ["captured"]).select("game_id", "amount")


@query("S23 A04", "SELECT basis, book, season, count(*) AS n, avg(p) AS p FROM g GROUP BY 1, 2, 3", "p")
def summary_table(spark, sf):
    path = _folder(spark)
    feeds.summary_mart(games(spark, sf).groupBy("basis", "book", "season").agg(F.count("*").alias("n"), F.avg("p").alias("p")), ["basis", "book", "season"], path)
    return spark.read.parquet(path)


@query("S12", "SELECT CAST(c_custkey AS VARCHAR) AS player_id, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN 'PG-SG' ELSE 'C' END AS positions FROM customer WHERE c_acctbal >= 0 AND c_custkey % 5 > 0")
def active_players(spark, sf):
    c = F.col
    spots = F.when(c("c_custkey") % 5 == 0, F.array(F.lit("QB"))).when(c("c_custkey") % 3 == 0, F.array(F.lit("PG"), F.lit("SG"))).otherwise(F.array(F.lit("C")))
    one = F.struct(c("c_name").alias("full_name"), c("c_mktsegment").alias("team"), (c("c_acctbal") >= 0).alias("active"), spots.alias("fantasy_positions"))
    return feeds.players(table(spark, sf, "customer").select(F.to_json(F.create_map(c("c_custkey").cast("string"), one)).alias("t")), "t").select("player_id", "name", "positions")


@query("S13", "SELECT CAST(l_orderkey AS VARCHAR) AS slate_id, CAST(l_linenumber AS VARCHAR) AS code, CAST(l_quantity AS INT) AS salary FROM lineitem")
def salary_rows(spark, sf):
    c = F.col
    player = F.struct(c("l_linenumber").cast("string").alias("code"), F.lit("n").alias("name"), F.lit("T").alias("team"), F.lit("C").alias("position"), c("l_quantity").cast("int").alias("salary"), F.lit(1.0).alias("fppg"))
    slates = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(player).alias("players"))  # the lines of one order
    js = F.to_json(F.struct(F.array(F.struct(c("l_orderkey").cast("string").alias("id"), F.lit("s").alias("start"), "players")).alias("slates")))
    return feeds.salaries(slates.select(js.alias("t")), "t").select("slate_id", "code", "salary")


@query("S16 A20", "SELECT game_id, 'b' AS provider, CASE WHEN spread < 0 THEN 'BOS' END AS team, CASE WHEN spread < 0 THEN -spread END AS line FROM g", "line")
def provider_votes(spark, sf):
    c = F.col
    details = F.when(c("spread") < 0, F.concat(F.lit("BOS "), c("spread").cast("string"))).otherwise("EVEN")
    js = F.to_json(F.struct(F.array(F.struct(F.struct(F.lit("b").alias("name")).alias("provider"), details.alias("details"))).alias("pickcenter")))
    return feeds.line_votes(games(spark, sf).select("game_id", js.alias("t")), "t", "game_id")


@query("S17", """SELECT team AS file, season, CASE WHEN won = 1 THEN 'Last, First' END AS player, CASE WHEN won = 1 THEN 'Out' ELSE 'PENDING' END AS status, 'T' || game_id AS team, '0' || (1 + season % 9) || '/02/2024' AS game_date FROM g""")
def parsed_reports(spark, sf):
    """One report a customer: for every order a date line, a team line and a player line, or the mark of a late team."""
    c = F.col
    g = games(spark, sf).select("team", "game_id", "season", F.array(F.concat(F.lit("0"), 1 + c("season") % 9, F.lit("/02/2024 ABC@XYZ")), F.concat(F.lit("TEAM: T"), c("game_id")), F.when(c("won") == 1, "Last, First Out").otherwise("NOT YET SUBMITTED")).alias("lines"))
    lines = g.select(c("team").alias("file"), "season", "game_id", F.posexplode("lines").alias("i", "text")).withColumn("number", c("game_id") * 3 + c("i"))
    rows = feeds.report_rows(lines, "file", "number", "text")
    return rows.join(lines.select("file", "number", "season"), ["file", "number"]).select("file", "season", "player", "status", "team", "game_date")


@query("Q01", "SELECT game_id, CAST(row_number() OVER (ORDER BY season, amount DESC, game_id) AS BIGINT) AS place FROM g")
def ordered_games(spark, sf):
    """A table written in mixed order; places follow from the rows in each part and the parts before it."""
    from pyspark.sql import Window

    path = _folder(spark)
    c = F.col
    K.ordered(games(spark, sf).select("game_id", "season", "amount"), c("season"), c("amount").desc(), c("game_id")).withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id()}).write.parquet(path)
    t = spark.read.parquet(path)
    sizes = t.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row a part
    inside = F.row_number().over(Window.partitionBy("part").orderBy("row"))
    return t.withColumn("k", inside).join(sizes, "part").select("game_id", (c("k") + c("before")).alias("place"))
