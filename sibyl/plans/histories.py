"""Queries of causal windows, joins, snapshots, folds, resampling, constraints and feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import features as E
from ..functions import prices as P
from ..functions.normal import norm_ppf_sql
from ..operators import allocate as V
from ..operators import causal as W
from ..operators import fit as M
from ..operators import joins as J
from ..operators import quality as C
from ..operators import resample as R
from ..operators import walk as B
from ..sources import feeds as S
from ..streaming import snapshots as X
from .driver import games, query, table, ticks
from .oracles import drawn_sql, newton_sql, terms_sql, uniform_sql
from .prices import _DEC, CQ, QSQL, UNITS, priced

_BEFORE = "(PARTITION BY {0} ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
GAME_PAST, TEAM_PAST = _BEFORE.format("game"), _BEFORE.format("team")


@query("W01 W05 W12", f"SELECT event_id, count(*) OVER {GAME_PAST} AS played, row_number() OVER (PARTITION BY game ORDER BY day, event_id) - 1 AS ordinal, coalesce(sum(value) OVER {GAME_PAST}, 0) AS value_to_date FROM e", "value_to_date")
def before_slate_sum(spark, sf):
    t = W.to_date(W.games_before(ticks(spark, sf), ["game"], "day", ["day", "event_id"]), ["game"], "day", ["value"])
    return t.select("event_id", "played", F.col("ordinal").cast("long").alias("ordinal"), "value_to_date")


@query("W02", """WITH o AS (SELECT *, row_number() OVER (PARTITION BY game ORDER BY day, event_id) AS k FROM e) SELECT a.event_id, coalesce(sum(b.value * pow(0.5, (a.k - 1 - b.k) / 8e0)), 0) AS decayed FROM o a LEFT JOIN o b ON a.game = b.game AND b.k < a.k GROUP BY a.event_id""", "decayed")
def halflife_value(spark, sf):
    return W.decayed(ticks(spark, sf), ["game"], ["day", "event_id"], ["value"], 8.0).select("event_id", F.col("value_decayed").alias("decayed"))


@query("W13 W14", """WITH o AS (SELECT *, row_number() OVER (PARTITION BY game ORDER BY day, event_id) AS k FROM e) SELECT a.event_id, sum(b.value * pow(0.5, (a.k - 1 - b.k) / 3e0)) / sum(pow(0.5, (a.k - 1 - b.k) / 3e0)) - sum(b.value * pow(0.5, (a.k - 1 - b.k) / 12e0)) / sum(pow(0.5, (a.k - 1 - b.k) / 12e0)) AS form FROM o a LEFT JOIN o b ON a.game = b.game AND b.k < a.k GROUP BY a.event_id""", "form")
def form_term(spark, sf):
    return W.form(ticks(spark, sf), ["game"], ["day", "event_id"], "value", 3.0, 12.0).select("event_id", "form")


@query("W03 J20", """WITH o AS (SELECT *, row_number() OVER (PARTITION BY team, season ORDER BY day, game_id) AS k, count(*) OVER (PARTITION BY team, season) AS n FROM g), pe AS (SELECT team, season + 1 AS season, sum(margin * pow(0.5, (n - k) / 5e0)) AS pe FROM o GROUP BY 1, 2),
    c AS (SELECT a.game_id, a.team, a.season, a.k, coalesce(sum(b.margin * pow(0.5, (a.k - 1 - b.k) / 5e0)), 0) AS c FROM o a LEFT JOIN o b ON a.team = b.team AND a.season = b.season AND b.k < a.k GROUP BY ALL)
    SELECT game_id, c + coalesce(greatest(0, 1 - (k - 1) / 10e0) * pow(0.5, (k - 1) / 5e0) * pe, 0) AS faded FROM c LEFT JOIN pe USING (team, season)""", "faded")
def season_carry(spark, sf):
    return W.faded(games(spark, sf), ["team"], "season", ["day", "game_id"], "margin", 5.0).select("game_id", "faded")


@query("W04", """WITH o AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY day, game_id) AS k FROM g) SELECT a.game_id, coalesce(sum(b.margin * pow(0.5, (a.k - 1 - b.k) / 5e0)), 0) AS prior FROM o a LEFT JOIN o b ON a.team = b.team AND b.k < a.k GROUP BY 1""", "prior")
def recursive_decay(spark, sf):
    return W.recursive_decay(games(spark, sf), ["team"], "season", ["day", "game_id"], "margin", 5.0, True).select("game_id", F.col("margin_prior").alias("prior"))


@query("W05 W24", """WITH d AS (SELECT season, day, sum(margin) AS a, sum(total) AS b FROM g GROUP BY 1, 2), s AS (SELECT *, sum(a) OVER w AS pa, sum(b) OVER w AS pb FROM d WINDOW w AS (PARTITION BY season ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), l AS (SELECT season + 1 AS season, sum(a) / sum(b) AS last FROM d GROUP BY season)
    SELECT game_id, CASE WHEN coalesce(pb, 0) + CASE WHEN last IS NULL THEN 0 ELSE 500 END > 0 THEN (coalesce(pa, 0) + coalesce(500 * last, 0)) / (coalesce(pb, 0) + CASE WHEN last IS NULL THEN 0 ELSE 500 END) END AS league FROM g JOIN s USING (season, day) LEFT JOIN l USING (season)""", "league")
def league_level(spark, sf):
    return W.league_to_date(games(spark, sf), "season", "day", "margin", "total", 500.0).select("game_id", "league")


@query("W06 P06", """SELECT game_id, CASE WHEN n > 0 THEN (m * n + 3 * 5) / (n + 5e0) ELSE 3e0 END AS blended FROM (SELECT game_id, count(*) OVER w AS n, avg(margin) OVER w AS m FROM g WINDOW w AS (PARTITION BY team ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) t""", "blended")
def prior_blend(spark, sf):
    past = W.before_day(["team"], "day")
    g = games(spark, sf).withColumns({"n": F.count("*").over(past), "m": F.avg("margin").over(past)})
    return g.select("game_id", W.blended_prior(F.col("m"), F.col("n"), F.lit(3.0), 5.0).alias("blended"))


@query("W07", """SELECT game_id, CAST(coalesce(least(day - lag(day) OVER (PARTITION BY team, season ORDER BY day, game_id) - 1, 7), 7) AS INT) AS rest FROM g""")
def rest_gap(spark, sf):
    return W.rest_days(games(spark, sf), ["team", "season"], "slate", ["day", "game_id"]).select("game_id", "rest")


@query("W08 W09 W16 J15", """WITH gm AS (SELECT DISTINCT game AS grp, day FROM e), mem AS (SELECT DISTINCT game AS grp, kind AS member FROM e), seen AS (SELECT DISTINCT game AS grp, day, kind AS member FROM e), x AS (SELECT gm.grp, gm.day, member, CASE WHEN seen.member IS NULL THEN 0 ELSE 1 END AS present, row_number() OVER (PARTITION BY gm.grp, member ORDER BY gm.day) AS k FROM gm JOIN mem USING (grp) LEFT JOIN seen USING (grp, day, member)),
    s AS (SELECT a.grp, a.day, a.member, coalesce(sum(b.present * pow(0.5, (a.k - 1 - b.k) / 4e0)) / sum(pow(0.5, (a.k - 1 - b.k) / 4e0)), 0) AS share FROM x a LEFT JOIN x b ON a.grp = b.grp AND a.member = b.member AND b.k < a.k GROUP BY ALL) SELECT grp, day, sum(share * 2 * (0.5 - share)) AS availability, sum(share * 2) AS expected_role FROM s GROUP BY 1, 2""", "availability expected_role")
def player_grid(spark, sf):
    t = ticks(spark, sf).withColumnsRenamed({"game": "grp", "kind": "member"})
    grid = W.presence_grid(t.select("grp", "day").distinct(), t, ["grp"])
    grid = grid.join(t.select("grp", "day", "member", F.lit(True).alias("hit")).distinct(), ["grp", "day", "member"], "left")
    grid = grid.withColumns({"present": F.coalesce("hit", F.lit(False)), "role": F.lit(2.0), "chance": F.lit(0.5)})
    return W.availability(grid, ["grp"], ["day"], 4.0)


@query("W10", f"""SELECT event_id, least(coalesce(avg(value) OVER {GAME_PAST} / 48, 0.3e0), 1e0) AS role, least(coalesce(quantile_cont(value, 0.5) OVER {GAME_PAST} / 48, 0.3e0), 1e0) AS median_role FROM e""", "role median_role")
def role_to_date(spark, sf):
    return W.role_to_date(ticks(spark, sf).withColumn("base", F.lit(0.3)), ["game"], "day", "value", "base").select("event_id", "role", "median_role")


@query("W11", f"""WITH t AS (SELECT event_id, coalesce(sum(CAST(kind = 'view' AS INT)) OVER {GAME_PAST}, 0) AS n1, coalesce(sum(CAST(kind <> 'view' AS INT)) OVER {GAME_PAST}, 0) AS n0, coalesce(sum(CASE WHEN kind = 'view' THEN value ELSE 0 END) OVER {GAME_PAST}, 0) AS s1, coalesce(sum(CASE WHEN kind <> 'view' THEN value ELSE 0 END) OVER {GAME_PAST}, 0) AS s0 FROM e), m AS (SELECT *, CASE WHEN n1 + n0 > 0 THEN (s1 + s0) / (n1 + n0) ELSE 0 END AS m FROM t) SELECT event_id, (s1 + 4 * m) / (n1 + 4) - (s0 + 4 * m) / (n0 + 4) AS on_off FROM m""", "on_off")
def on_off(spark, sf):
    return W.on_off(ticks(spark, sf).withColumn("on", F.col("kind") == "view"), ["game"], "day", "on", "value", 4.0).select("event_id", "on_off")


@query("W17", f"""SELECT game_id, count(units) OVER w AS n, sum(units) OVER w AS units, sum(units) OVER w / count(units) OVER w AS roi FROM (SELECT *, {UNITS} AS units FROM g) t WHERE units IS NOT NULL WINDOW w AS (PARTITION BY season ORDER BY day, game_id ROWS UNBOUNDED PRECEDING)""", "units roi")
def running_record(spark, sf):
    g = priced(spark, sf).withColumn("units", P.unit_profit(F.col("home_ml"), F.col("home_won"))).where("units is not null")
    return W.running_record(g, ["season"], ["day", "game_id"], "units").select("game_id", "n", "units", "roi")


_CELL = "WITH c AS (SELECT *, CAST(floor(p * 5) AS INT) AS cell FROM g), k AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY day, game_id) AS o, count(*) OVER (PARTITION BY cell ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS kk FROM c), "


@query("W18 W19 X14", _CELL + """l AS (SELECT a.game_id, count(b.o) AS members, coalesce(sum(b.won), 0) AS w, coalesce(sum(b.p), 0) AS m FROM k a LEFT JOIN k b ON a.cell = b.cell AND b.o <= a.kk AND b.o > a.kk - 200 GROUP BY 1)
    SELECT game_id, CAST(members AS BIGINT) AS members, w AS won_sum, CASE WHEN members > 0 THEN (w - m) / (members + 200) ELSE 0 END AS shift FROM l""", "won_sum shift")
def latest_n_cell(spark, sf):
    g = games(spark, sf).withColumns({"cell": F.floor(F.col("p") * 5).cast("int"), "won": F.col("won").cast("double")})
    t = W.latest_n_before(g, ["cell"], "day", ["game_id"], ["won", "p"], 200)
    return t.select("game_id", F.col("members").cast("long").alias("members"), "won_sum", W.shrunk_cell(F.col("won_sum"), F.col("members"), F.col("p_sum")).alias("shift"))


@query("W20", """WITH k AS (SELECT *, won - p AS res, row_number() OVER (PARTITION BY season ORDER BY day, game_id) AS o, count(*) OVER (PARTITION BY season ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS kk FROM g)
    SELECT a.game_id, coalesce(sum(b.res * pow(0.5, (a.kk - b.o) / 150e0)), 0) / (coalesce(sum(pow(0.5, (a.kk - b.o) / 150e0)), 0) + 50) AS drift FROM k a LEFT JOIN k b ON a.season = b.season AND b.o <= a.kk AND b.o > a.kk - 600 GROUP BY a.game_id""", "drift")
def pooled_drift(spark, sf):
    g = games(spark, sf).withColumn("res", F.col("won") - F.col("p"))
    return W.drift(g, "day", ["game_id"], "res", 150.0, key=["season"]).select("game_id", "drift")


@query("W21 W22", f"""WITH c AS (SELECT *, CAST(floor(p * 5) AS INT) AS cell, {UNITS} - ({QSQL} * ({_DEC.format('home_ml')}) - 1) AS gain FROM g), t AS (SELECT game_id, coalesce(sum(gain) OVER (PARTITION BY cell, season ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, coalesce(sum(gain) OVER (PARTITION BY cell ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM c WHERE gain IS NOT NULL)
    SELECT game_id, a AS season_gain, b AS pooled_gain FROM t""", "season_gain pooled_gain")
def cell_gain(spark, sf):
    c = F.col
    g = priced(spark, sf).withColumns({"cell": F.floor(c("p") * 5).cast("int"), "gain": P.unit_profit(c("home_ml"), c("home_won")) - (c("q") * P.decimal_payout(c("home_ml")) - 1)}).where("gain is not null")
    return W.both_positive(g, ["cell"], "season", "day", ["game_id"], "gain").select("game_id", "season_gain", "pooled_gain")


@query("W23", "SELECT team, avg(abs(d)) AS jitter FROM (SELECT team, p - lag(p) OVER (PARTITION BY team ORDER BY day, game_id) AS d FROM g) t GROUP BY team", "jitter")
def estimate_jitter(spark, sf):
    return W.jitter(games(spark, sf), ["team"], ["day", "game_id"], "p")


@query("W25", """WITH p AS (SELECT *, row_number() OVER w AS pos, CASE WHEN abs(value - quantile_cont(value, 0.5) OVER (PARTITION BY game ORDER BY sec, event_id ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)) <= 40 THEN value END AS ok FROM e WINDOW w AS (PARTITION BY game ORDER BY sec, event_id)),
    f AS (SELECT *, last_value(ok IGNORE NULLS) OVER b AS a, first_value(ok IGNORE NULLS) OVER c AS z, last_value(CASE WHEN ok IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS pa, first_value(CASE WHEN ok IS NOT NULL THEN pos END IGNORE NULLS) OVER c AS pz FROM p WINDOW b AS (PARTITION BY game ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), c AS (PARTITION BY game ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT event_id, max(CASE WHEN pa = pz THEN a WHEN pa IS NULL THEN z WHEN pz IS NULL THEN a ELSE a + (z - a) * (pos - pa) / (pz - pa) END) OVER (PARTITION BY game ORDER BY pos ROWS UNBOUNDED PRECEDING) AS clean FROM f""", "clean")
def rolling_median_clean(spark, sf):
    return W.cleaned_clock(ticks(spark, sf), ["game"], ["sec", "event_id"], "value", 5, 40.0).select("event_id", "clean")


@query("W26", """WITH c AS (SELECT *, CASE WHEN lag(kind) OVER w IS NULL OR lag(kind) OVER w <> kind THEN sec END AS t FROM e WINDOW w AS (PARTITION BY game ORDER BY sec, event_id)) SELECT event_id, sec - last_value(t IGNORE NULLS) OVER (PARTITION BY game ORDER BY sec, event_id ROWS UNBOUNDED PRECEDING) AS quiet_seconds FROM c""")
def quiet_time(spark, sf):
    return W.since_change(ticks(spark, sf), ["game"], ["sec", "event_id"], "kind", "sec").select("event_id", "quiet_seconds")


@query("W27", "WITH c AS (SELECT *, min(CASE WHEN value < 5 THEN sec END) OVER (PARTITION BY game) AS t FROM e) SELECT game, min(t) AS crossed, max(CASE WHEN sec > t THEN value END) AS best_after FROM c WHERE t IS NOT NULL GROUP BY 1", "best_after")
def first_crossing(spark, sf):
    return W.first_crossing(ticks(spark, sf), ["game"], "sec", "value", 5.0)


@query("W28", """WITH s AS (SELECT team, day, min(p) AS p FROM g GROUP BY 1, 2), f AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY day) AS k FROM s WHERE p > 0.8) SELECT f.team, f.day, l.p AS filled FROM f LEFT JOIN s l ON l.team = f.team AND l.day = f.day + 1 WHERE k = 1""", "filled")
def first_signal(spark, sf):
    s = games(spark, sf).groupBy("team", "day").agg(F.min("p").alias("p"))
    return W.first_signal(s, ["team"], "day", F.col("p") > 0.8, "p", 1).select("team", "day", "filled")


@query("W29", """WITH d AS (SELECT day, sum(p) AS x, sum(margin) AS y FROM g GROUP BY 1), c AS (SELECT *, x - CASE WHEN lag(day) OVER w = day - 1 THEN lag(x) OVER w END AS dx, y - CASE WHEN lag(day) OVER w = day - 1 THEN lag(y) OVER w END AS dy FROM d WINDOW w AS (ORDER BY day)), l AS (SELECT *, CASE WHEN lag(day) OVER w = day - 1 THEN lag(dy) OVER w END AS d1 FROM c WINDOW w AS (ORDER BY day)) SELECT corr(dx, dy) AS corr_0, (SELECT corr(dx, d1) FROM l WHERE dx IS NOT NULL AND d1 IS NOT NULL) AS corr_1 FROM l WHERE dx IS NOT NULL AND dy IS NOT NULL""", "corr_0 corr_1")
def lagged_correlation(spark, sf):
    d = games(spark, sf).groupBy("day").agg(F.sum("p").alias("x"), F.sum("margin").alias("y")).withColumn("k", F.lit(1))
    return W.lagged_correlation(d, ["k"], "day", "x", "y", [0, 1], 1)


@query("W30", f"SELECT game_id, CASE WHEN count(total) OVER {TEAM_PAST} >= 5 THEN quantile_cont(total, 0.5) OVER {TEAM_PAST} END AS median_before FROM g", "median_before")
def team_context(spark, sf):
    return W.median_to_date(games(spark, sf), ["team"], "day", "total").select("game_id", "median_before")


@query("W31", """SELECT a.event_id, CASE WHEN count(b.value) >= 2 AND var_samp(b.value) > 0 THEN (any_value(a.value) - avg(b.value)) / stddev_samp(b.value) END AS loo_z FROM e a LEFT JOIN e b ON a.game = b.game AND a.event_id <> b.event_id GROUP BY 1""", "loo_z")
def leave_one_out(spark, sf):
    return W.leave_one_out(ticks(spark, sf), ["game"], "value").select("event_id", "loo_z")


@query("W32 W33", f"""SELECT game_id, avg(CAST(won AS DOUBLE)) OVER {TEAM_PAST} AS win_share, CASE WHEN count(won) OVER {TEAM_PAST} = 3 THEN coalesce(sum(won) OVER {TEAM_PAST}, 0) ELSE -1 END AS record FROM g""", "win_share record")
def team_standing(spark, sf):
    g = games(spark, sf).withColumns({"claimed": F.lit(3), "fallback": F.lit(-1.0)})
    return W.trusted_record(W.standing(g, ["team"], "day", "won", 10_000), ["team"], "day", "won", "claimed", "fallback").select("game_id", "win_share", "record")


@query("W34", "SELECT event_id, row_number() OVER (PARTITION BY game ORDER BY value DESC, event_id) AS rank, value / sum(value) OVER (PARTITION BY game) AS share FROM e", "share")
def shares_and_ranks(spark, sf):
    return W.shares(ticks(spark, sf), ["game"], "value", ["event_id"]).select("event_id", F.col("rank").cast("long").alias("rank"), "share")


@query("W35 W37 W15", f"SELECT game_id, CASE WHEN count(*) OVER {TEAM_PAST} >= 3 THEN sum(points) OVER {TEAM_PAST} / sum(total) OVER {TEAM_PAST} END AS rate, avg(margin) OVER {TEAM_PAST} AS margin_mean FROM g", "rate margin_mean")
def rate_to_date(spark, sf):
    return W.quarter_means(W.rate_to_date(games(spark, sf), ["team"], "day", "points", "total"), ["team"], "day", ["margin"]).select("game_id", "rate", "margin_mean")


@query("W36", "WITH r AS (SELECT game, value, row_number() OVER (PARTITION BY game ORDER BY sec, event_id) AS k FROM e), w AS (SELECT game, avg(value) FILTER (k <= 10) AS a, avg(value) FILTER (k > 10) AS b FROM r GROUP BY 1) SELECT corr(a, b) AS r10 FROM w WHERE a IS NOT NULL AND b IS NOT NULL", "r10")
def reliability_by_n(spark, sf):
    return W.reliability_by_n(ticks(spark, sf), ["game"], ["sec", "event_id"], "value", [10])


@query("J05 J06 J07 J16 J27", """WITH q AS (SELECT game, sec, max(value) AS value FROM e WHERE kind = 'purchase' GROUP BY 1, 2), c AS (SELECT event_id, game, sec FROM e WHERE kind = 'view'), m AS (SELECT c.event_id, q.sec AS qs, q.value, c.sec, row_number() OVER (PARTITION BY c.event_id ORDER BY q.sec DESC) AS k FROM c LEFT JOIN q ON q.game = c.game AND q.sec <= c.sec) SELECT event_id, CASE WHEN sec - qs <= 43200 THEN value END AS value FROM m WHERE k = 1""", "value")
def asof_tolerance(spark, sf):
    t = ticks(spark, sf)
    quotes = t.where("kind = 'purchase'").groupBy("game", "sec").agg(F.max("value").alias("value"))
    return J.as_of(t.where("kind = 'view'").select("event_id", "game", "sec"), quotes, ["game"], "sec", "sec", ["value"], 43200).select("event_id", "value")


@query("J08", "WITH c AS (SELECT DISTINCT game, sec AS at FROM e WHERE kind = 'signup'), q AS (SELECT game, sec, max(value) AS value FROM e WHERE kind = 'view' GROUP BY 1, 2) SELECT c.game, c.at, arg_max(q.value, q.sec) AS value FROM c JOIN q ON q.game = c.game AND q.sec BETWEEN c.at - 86400 AND c.at GROUP BY 1, 2".replace("c.at", "c.tip").replace("AS at", "AS tip"), "value")
def last_quote(spark, sf):
    t = ticks(spark, sf)
    quotes = t.where("kind = 'view'").groupBy("game", "sec").agg(F.max("value").alias("value"))
    return J.quote_near(quotes, t.where("kind = 'signup'").select("game", F.col("sec").alias("tip")).distinct(), ["game"], "sec", "tip", 86400).select("game", "tip", "value")


@query("J09 A32", "WITH l AS (SELECT n_nationkey * 40e0 AS at0, n_name FROM nation) SELECT event_id, (SELECT n_name FROM l ORDER BY abs(at0 - value), at0 LIMIT 1) AS n_name FROM events")
def nearest_lead(spark, sf):
    rates = table(spark, sf, "nation").select((F.col("n_nationkey") * 40.0).alias("at0"), "n_name")
    return J.nearest(table(spark, sf, "events"), rates, "value", "at0", ["n_name"]).select("event_id", "n_name")


@query("J11", "SELECT label, count(*) AS n, sum(l_extendedprice) AS total FROM lineitem JOIN (VALUES ('low', 0e0, 10e0), ('mid', 10e0, 30e0), ('high', 25e0, 50e0)) b(label, lo, hi) ON l_quantity BETWEEN lo AND hi GROUP BY 1", "total")
def band_join_ladder(spark, sf):
    bands = spark.createDataFrame([("low", 0.0, 10.0), ("mid", 10.0, 30.0), ("high", 25.0, 50.0)], "label string, lo double, hi double")
    return J.in_bands(table(spark, sf, "lineitem"), bands, "l_quantity").groupBy("label").agg(F.count("*").alias("n"), F.sum("l_extendedprice").alias("total"))


@query("J10 F08", f"""WITH x AS (SELECT *, {QSQL} AS q FROM g) SELECT r.key, season, count(*) AS n FROM x JOIN (VALUES ('a', DATE '1996-01-01', DATE '1998-01-01', 0.0e0), ('b', DATE '1997-06-01', NULL, 0.1e0)) r(key, since, until, edge) ON slate >= since AND (until IS NULL OR slate < until) AND p - q >= edge GROUP BY 1, 2""")
def rules_theta(spark, sf):
    rules = spark.createDataFrame([("a", "ml", "lock", "1996-01-01", "1998-01-01", 0.0), ("b", "ml", "lock", "1997-06-01", None, 0.1)], "key string, market string, kind string, since string, until string, edge double")
    rules = rules.withColumns({"since": F.col("since").cast("date"), "until": F.col("until").cast("date")})
    x = priced(spark, sf).withColumns({"market": F.lit("ml"), "kind": F.lit("lock")})
    return J.with_rules(x, rules).where("p - q >= edge").groupBy("key", "season").agg(F.count("*").alias("n"))


@query("J12 J13", """WITH ent AS (SELECT p_partkey AS id, p_name AS name, p_brand AS team FROM part), b AS (SELECT name, team, min(id) AS id FROM ent GROUP BY 1, 2 HAVING count(DISTINCT id) = 1), n AS (SELECT name, min(id) AS id FROM ent GROUP BY 1 HAVING count(DISTINCT id) = 1), x AS (SELECT p_partkey, p_name AS name, CASE WHEN p_partkey % 3 = 0 THEN 'none' ELSE p_brand END AS team FROM part) SELECT p_partkey, coalesce(b.id, n.id, -1) AS entity FROM x LEFT JOIN b USING (name, team) LEFT JOIN n USING (name)""")
def entity_two_step(spark, sf):
    c = F.col
    ent = table(spark, sf, "part").select(c("p_partkey").alias("id"), c("p_name").alias("name"), c("p_brand").alias("team"))
    x = table(spark, sf, "part").select("p_partkey", c("p_name").alias("name"), F.when(c("p_partkey") % 3 == 0, "none").otherwise(c("p_brand")).alias("team"))
    return J.resolve_entity(x, ent, "name", "team", "id").select("p_partkey", F.coalesce("entity", F.lit(-1)).alias("entity"))


@query("J17 J14", "WITH l AS (SELECT l_orderkey, l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2) SELECT a.l_orderkey, count(*) AS pairs, sum(a.q * b.q) AS product FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY 1", "product")
def within_group_pairs(spark, sf):
    li = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").alias("q"))
    return J.pairs(li, ["l_orderkey"], "l_partkey", ["q"]).groupBy("l_orderkey").agg(F.count("*").alias("pairs"), F.sum(F.col("a_q") * F.col("b_q")).alias("product"))


@query("J19 J18", "WITH p AS (SELECT c_custkey, c_mktsegment AS r, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer), s AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'HOUSEHOLD' ELSE 'MACHINERY' END AS r, row_number() OVER (PARTITION BY p_size % 2 ORDER BY p_retailprice DESC, p_partkey) AS k FROM part) SELECT c_custkey, p_partkey FROM p JOIN s USING (r, k)")
def rank_join(spark, sf):
    c = F.col
    slots = table(spark, sf, "part").withColumn("r", F.when(c("p_size") % 2 == 0, "HOUSEHOLD").otherwise("MACHINERY"))
    return J.by_rank(table(spark, sf, "customer").withColumn("r", c("c_mktsegment")), slots, ["r"], [F.desc("c_acctbal"), F.asc("c_custkey")], [F.desc("p_retailprice"), F.asc("p_partkey")]).select("c_custkey", "p_partkey")


@query("J01 J31", "SELECT a.l_orderkey AS game, max(a.q) - max(b.q) AS q_diff FROM (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1) a JOIN (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1) b USING (l_orderkey) GROUP BY 1", "q_diff")
def home_less_away(spark, sf):
    s = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("game"), (F.col("l_linestatus") == "O").alias("home")).agg(F.sum("l_quantity").alias("q"))
    return J.home_less_away(s, "game", "home", ["q"]).where("q_diff is not null")


@query("J21", "WITH a AS (SELECT team, season + 1 AS season, book, sum(total) AS t FROM g GROUP BY 1, 2, 3) SELECT team, season, coalesce(sum(t) FILTER ((team, season, book) IN (SELECT (team, season, book) FROM g)), 0) / sum(t) AS back FROM a GROUP BY 1, 2", "back")
def returning_share(spark, sf):
    g = games(spark, sf)
    return J.returning_share(g.withColumn("season", F.col("season") + 1), g, ["team", "season"], "book", "total").withColumnRenamed("returning", "back")


@query("J25 X12", "SELECT game_id, CASE WHEN game_id % 3 = 0 THEN total WHEN game_id % 3 = 1 THEN total + 1 END AS lock_total, CASE WHEN game_id % 3 = 0 THEN 'native' WHEN game_id % 3 = 1 THEN 'rescore' END AS source FROM g", "lock_total")
def lock_or_rescore(spark, sf):
    c = F.col
    g = games(spark, sf)
    locks = g.select("game_id", F.when(c("game_id") % 3 == 0, c("total")).alias("lock_total"))
    return J.lock_or_rescore(locks, g.where("game_id % 3 = 1").select("game_id", (c("total") + 1).alias("lock_total")), "game_id", ["lock_total"])


_SNAP = "WITH s AS (SELECT *, CAST(day AS BIGINT) * 86400 + 72000 AS tip FROM e), o AS (SELECT game, day, arg_max(value, sec * 1000000 + event_id) FILTER (sec < tip) AS pre, arg_min(value, sec * 1000000 + event_id) FILTER (sec < tip AND value >= 20) AS first, arg_min(value, sec * 1000000 + event_id) FILTER (sec < tip AND value >= 20 AND sec >= tip - 18000) AS lock, count(*) FILTER (sec >= tip) AS rejected FROM s GROUP BY 1, 2)"


@query("X01 X02 X03 X04 X05", _SNAP + " SELECT game, day, pre, first, lock, rejected FROM o".replace("first, lock", "\"first\", lock"), 'pre "first" lock')
def deadline_state(spark, sf):
    c = F.col
    t = ticks(spark, sf).withColumns({"at": c("sec").cast("timestamp"), "tip": (c("day").cast("long") * 86400 + 72000).cast("timestamp")})
    s = X.pregame_state(t, ["game", "day"], "at", "tip", ["value"], "event_id", c("value") >= 20)
    return s.select("game", "day", c("pre.value").alias("pre"), c("first.value").alias("first"), c("lock.value").alias("lock"), "rejected")


@query("X06 X07", "WITH v AS (SELECT * FROM e WHERE kind <> 'error'), l AS (SELECT game, max(sec) AS sec FROM v GROUP BY 1) SELECT game, event_id FROM v JOIN l USING (game, sec) WHERE kind <> 'view'")
def latest_valid_set(spark, sf):
    c = F.col
    t = ticks(spark, sf).withColumns({"ok": c("kind") != "error", "tip": F.lit(1 << 40), "member": F.when(c("kind") != "view", c("event_id"))})
    return X.latest_valid_set(t, ["game"], "sec", "tip", "ok", "member").select("game", "event_id")


@query("X09 X11 X16", f"""SELECT game_id, season, won, CASE WHEN game_id % 3 = 1 THEN 'own' WHEN won = 1 AND {CQ} IS NOT NULL THEN book END AS close_book, CASE WHEN game_id % 3 = 1 THEN p WHEN won = 1 THEN {CQ} END AS cq,
    CASE WHEN game_id % 3 <> 1 AND won = 1 AND {CQ} IS NOT NULL THEN spread END AS close_spread FROM (SELECT * REPLACE (CASE WHEN game_id % 2 = 0 OR won = 1 THEN won END AS won) FROM g) g""", "cq close_spread")
def graded_log(spark, sf):
    """Every game is in the log, some with a close of their own book already, which takes no other book's spread; games without a
    result take no close, and a spread without a usable moneyline close is left out."""
    c = F.col
    g = priced(spark, sf)
    led = g.select("game_id", "season", F.when((c("game_id") % 2 == 0) & (c("won") == 0), 0).alias("won"), F.when(c("game_id") % 3 == 1, c("p")).alias("cq"), F.when(c("game_id") % 3 == 1, "own").alias("close_book"), F.lit(None).cast("double").alias("close_spread"))
    results = g.select("game_id", F.when(c("won") == 1, c("won")).alias("won"), c("book").alias("close_book"), "cq", c("spread").alias("close_spread"))
    return X.apply_results(led, results, "game_id", ["won"], ["cq", "close_book", "close_spread"], c("cq").isNotNull()).select("game_id", "season", "won", "close_book", "cq", "close_spread")


@query("M14", "SELECT book, regr_count(margin, spread) AS n, regr_slope(margin, spread) AS slope, sqrt((regr_syy(margin, spread) - pow(regr_sxy(margin, spread), 2) / regr_sxx(margin, spread)) / (regr_count(margin, spread) - 2) / regr_sxx(margin, spread)) AS slope_se FROM g GROUP BY 1", "slope slope_se")
def slope_se(spark, sf):
    return M.slope(games(spark, sf), "spread", "margin", ["book"]).select("book", F.col("n").cast("long").alias("n"), "slope", "slope_se")


@query("M01 B01 U05", """WITH t AS (SELECT DISTINCT season AS test FROM g), f AS (SELECT test, regr_slope(margin, spread) AS b, regr_intercept(margin, spread) AS a, count(*) AS n FROM t JOIN g ON season < test GROUP BY 1) SELECT season, count(*) AS rows, sqrt(avg((margin - a - b * spread) * (margin - a - b * spread))) AS rmse, any_value(n) AS train_rows FROM g JOIN f ON test = season GROUP BY 1""", "rmse")
def fold_gram(spark, sf):
    d = B.season_folds(games(spark, sf), ["spread"], "margin", "season", True)
    e = F.col("margin") - F.col("prediction")
    return d.groupBy("season").agg(F.count("*").alias("rows"), F.sqrt(F.avg(e * e)).alias("rmse"), F.first("train_rows").alias("train_rows"))


@query("B02", """WITH d AS (SELECT DISTINCT day FROM g), f AS (SELECT d.day, count(*) AS n, regr_slope(margin, spread) AS b FROM d JOIN g ON g.day < d.day GROUP BY 1) SELECT day, n AS train_rows, b AS slope FROM f WHERE n > 2""", "slope")
def slate_refits(spark, sf):
    d = B.slate_refits(games(spark, sf), "spread", "margin", "season", "day")
    return d.where("train_rows > 2").select("day", "train_rows", "slope").distinct()


@query("B03", """WITH d AS (SELECT day, pow(2, (day - (SELECT min(day) FROM g)) / 100e0) AS w, count(*) AS n, sum(spread) AS sx, sum(margin) AS sy, sum(spread * spread) AS sxx, sum(spread * margin) AS sxy FROM g GROUP BY 1),
    f AS (SELECT a.day, sum(b.w * b.n) AS n, sum(b.w * b.sx) AS sx, sum(b.w * b.sy) AS sy, sum(b.w * b.sxx) AS sxx, sum(b.w * b.sxy) AS sxy FROM d a LEFT JOIN d b ON b.day < a.day GROUP BY 1)
    SELECT day, CASE WHEN n * sxx - sx * sx > 1e-9 THEN (n * sxy - sx * sy) / (n * sxx - sx * sx) END AS slope FROM f""", "slope")
def aged_refits(spark, sf):
    return B.aged_refits(games(spark, sf), "spread", "margin", "day", 100.0)


@query("B04 B11 B19 B20 B21", f"""WITH x AS (SELECT *, {QSQL} AS q FROM g), l AS (SELECT season, 'model' AS arm, p, won FROM x WHERE q IS NOT NULL UNION ALL SELECT season, 'price', q, won FROM x WHERE q IS NOT NULL) SELECT season, arm, count(*) AS n, avg(-ln(CASE WHEN won = 1 THEN p ELSE 1 - p END)) AS loss, avg((p - won) * (p - won)) AS brier FROM l GROUP BY 1, 2""", "loss brier")
def arm_comparison(spark, sf):
    return B.compare_arms(priced(spark, sf), ["season"], {"model": F.col("p"), "price": F.col("q")}, "won")


@query("B06 C05", "SELECT CAST(team AS VARCHAR) || '|' || day AS key, 'repeated key' AS rule FROM g GROUP BY team, day HAVING count(*) > 1")
def repeated_slates(spark, sf):
    return C.repeated_keys(games(spark, sf), ["team", "day"], "repeated key")


@query("B07 B08", f"""WITH x AS (SELECT *, {QSQL} AS q FROM g), b AS (SELECT season, CASE WHEN p >= 0.5 THEN p - q ELSE q - p END AS edge, CASE WHEN p >= 0.5 THEN home_ml ELSE away_ml END AS ml, CASE WHEN p >= 0.5 THEN won = 1 ELSE won = 0 END AS ok FROM x) SELECT season, count(*) AS n, sum(CASE WHEN ok THEN ({_DEC.format('ml')}) - 1 WHEN ({_DEC.format('ml')}) IS NOT NULL THEN -1.0 END) AS units FROM b WHERE edge >= 0.05 GROUP BY 1""", "units")
def flat_bets(spark, sf):
    return B.flat_bets(priced(spark, sf), "p", "q", "home_ml", "away_ml", "won", 0.05).groupBy("season").agg(F.count("*").alias("n"), F.sum("bet_units").alias("units"))


@query("B10", f"""SELECT floor, count(*) AS n, avg(sign(p - q) * (cq - q)) AS toward, avg(CAST(sign(p - q) * (cq - q) > 0 AS DOUBLE)) AS share_toward, count(*) FILTER (cq - q = 0) AS ties FROM (SELECT *, {QSQL} AS q, {CQ} AS cq FROM g) x JOIN (SELECT unnest([0e0, 0.1e0]) AS floor) f ON abs(p - q) >= floor WHERE cq IS NOT NULL GROUP BY 1""", "floor toward share_toward")
def line_moves(spark, sf):
    return B.line_moves(priced(spark, sf).where("cq is not null and q is not null"), [], "p", "q", "cq", [0.0, 0.1])


_BAND_OF = "CAST(spread > c1 AS INT) + CAST(spread > c2 AS INT) + CAST(spread > c3 AS INT)"


@query("B15", f"""WITH x AS (SELECT season, spread, margin + spread AS res FROM g), t AS (SELECT test, spread, res FROM x JOIN (SELECT DISTINCT season AS test FROM g) s ON season < test),
    k AS (SELECT test, quantile_cont(spread, 0.25) AS c1, quantile_cont(spread, 0.5) AS c2, quantile_cont(spread, 0.75) AS c3 FROM t GROUP BY 1), d AS (SELECT test, {_BAND_OF} AS band, CAST(sign(median(res)) AS DOUBLE) AS side FROM t JOIN k USING (test) GROUP BY 1, 2)
    SELECT y.season, y.band, count(*) AS n, max(side) AS side FROM (SELECT season, {_BAND_OF} AS band FROM x JOIN k ON season = test) y JOIN d ON d.test = y.season AND d.band = y.band GROUP BY 1, 2""", "side")
def band_rule(spark, sf):
    return B.band_rule(games(spark, sf).withColumn("res", F.col("margin") + F.col("spread")), "season", "spread", "res").groupBy("season", "band").agg(F.count("*").alias("n"), F.max("side").alias("side"))


@query("B23 A22", f"""WITH b AS (SELECT season, -ln(CASE WHEN won = 1 THEN p ELSE 1 - p END) + ln(CASE WHEN won = 1 THEN q ELSE 1 - q END) AS x FROM (SELECT *, {QSQL} AS q FROM g) a WHERE q IS NOT NULL),
    s AS (SELECT season, avg(x) AS d, stddev_samp(x) / sqrt(count(*)) AS s FROM b GROUP BY 1), m AS (SELECT sum(d / (s * s)) / sum(1 / (s * s)) AS pooled, sqrt(1 / sum(1 / (s * s))) AS pooled_se, avg(CASE WHEN d < 0 THEN 1e0 ELSE 0e0 END) AS below FROM s)
    SELECT pooled, pooled_se, pooled + 1.96e0 * pooled_se < 0 AS excludes_zero, below > 0.5 AS most_seasons, true AS close_ok FROM m""", "pooled pooled_se")
def preset_verdict(spark, sf):
    from ..operators.measure import scoring

    return B.verdict(scoring(priced(spark, sf), ["season"], "p", "q", "won"), "loss_diff", "loss_diff_se", 0.0)


@query("M15 M10", "SELECT season, regr_intercept(margin, p - 0.5) AS a, regr_slope(margin, p - 0.5) AS b FROM g GROUP BY 1", "a b")
def margin_mapping(spark, sf):
    return M.margin_mapping(games(spark, sf).withColumn("z", F.col("p") - 0.5), "z", "margin", "affine", by=["season"])


@query("M10 M21 Q05", f"""WITH x AS (SELECT *, {QSQL} AS q FROM g), l AS (SELECT season, w, sum((1 / (1 + exp(-((1 - w) * ln(q / (1 - q)) + w * ln(p / (1 - p))))) - won) * (1 / (1 + exp(-((1 - w) * ln(q / (1 - q)) + w * ln(p / (1 - p))))) - won)) AS loss FROM x, (SELECT unnest([0e0, 0.25e0, 0.5e0, 0.75e0, 1e0]) AS w) f WHERE q IS NOT NULL GROUP BY 1, 2) SELECT season, arg_min(w, loss) AS value, min(loss) AS loss FROM l GROUP BY 1""", "value loss")
def shrink_weight(spark, sf):
    c = F.col
    loss = lambda w: P.brier(P.shrink_p(c("p"), c("q"), w), c("won"))
    return M.grid_fit(priced(spark, sf).where("q is not null"), [0.0, 0.25, 0.5, 0.75, 1.0], loss, ["season"])


_QUOTES = "SELECT l_partkey, line, least(0.95e0, greatest(0.05e0, 1.1e0 - line / 50 + d)) AS p FROM (SELECT l_partkey, floor(l_quantity) + 0.5e0 AS line, avg(l_discount) AS d FROM lineitem GROUP BY 1, 2) t"


@query("M19", f"""WITH RECURSIVE z AS (SELECT *, {norm_ppf_sql('1 - p')} AS z FROM ({_QUOTES}) t), k AS (SELECT l_partkey, count(*) AS n, regr_intercept(line, z) AS fit, min(line) AS l, arg_min(p, line) AS p FROM z GROUP BY 1),
    b AS (SELECT l_partkey, l, p, 0.01e0 AS lo, 100e0 AS hi, 0 AS i FROM k WHERE n < 3 UNION ALL SELECT l_partkey, l, p, CASE WHEN below THEN mid ELSE lo END, CASE WHEN below THEN hi ELSE mid END, i + 1
        FROM (SELECT *, 1 - list_sum(list_transform(range(0, CAST(floor(l) AS BIGINT) + 1), lambda j: exp(j * ln(mid) - mid - lgamma(j + 1)))) < p AS below FROM (SELECT *, (lo + hi) / 2 AS mid FROM b WHERE i < 50) t) t)
    SELECT l_partkey, n, CASE WHEN n >= 3 THEN fit ELSE (lo + hi) / 2 END AS mean FROM k LEFT JOIN (SELECT * FROM b WHERE i = 50) s USING (l_partkey)""", "mean")
def ladder_means(spark, sf):
    c = F.col
    li = table(spark, sf, "lineitem").groupBy("l_partkey", (F.floor("l_quantity") + 0.5).alias("line")).agg(F.avg("l_discount").alias("d"))
    return M.ladder_mean(li.withColumn("over", F.least(F.lit(0.95), F.greatest(F.lit(0.05), 1.1 - c("line") / 50 + c("d")))), ["l_partkey"], "line", "over")


_WITH_Q, _LOGIT_P, _LOGIT_Q = f"(SELECT *, {QSQL} AS q FROM g) a WHERE q IS NOT NULL", "ln(p / (1 - p))", "ln(q / (1 - q))"


@query("M02 M11 M12 M07", f"{newton_sql(_WITH_Q, [_LOGIT_P, _LOGIT_Q], 'won', penalty=1.0, cluster='slate', sandwich=True)} {terms_sql(['p', 'q', 'one'])}", "coef se")
def calibration_fit(spark, sf):
    g = M.glm(priced(spark, sf).where("q is not null"), [P.logit(F.col("p")), P.logit(F.col("q"))], "won", l2=1.0, cluster="slate")
    return spark.createDataFrame([(n, float(b), float(s)) for n, b, s in zip(["p", "q", "one"], g.beta, g.se, strict=True)], "term string, coef double, se double")


@query("R01 R02", f"""WITH s AS (SELECT season, slate, sum(abs(points - total) - abs(points - 220)) AS s, count(*) AS n FROM g GROUP BY 1, 2), r AS (SELECT season, rep, sum(k * s) / nullif(sum(k * n), 0) AS m FROM {drawn_sql('s', 'slate', 11)} d GROUP BY 1, 2),
    p AS (SELECT season, sum(s) / sum(n) AS mean FROM s GROUP BY 1) SELECT season, any_value(mean) AS mean, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi, stddev_samp(m) AS se FROM r JOIN p USING (season) GROUP BY 1""", "mean lo hi se")
def cluster_bootstrap(spark, sf):
    g = games(spark, sf).withColumns({"a": F.abs(F.col("points") - F.col("total")), "b": F.abs(F.col("points") - 220)})
    return R.paired_bootstrap(g, "slate", "a", "b", by=["season"])


@query("R03", f"""WITH s AS (SELECT slate, x, sum(abs(points - x)) AS s FROM g, (SELECT unnest([218e0, 222e0, 226e0]) AS x) c GROUP BY 1, 2), r AS (SELECT rep, x, sum(k * s) AS l FROM {drawn_sql('s', 'slate', 12)} d GROUP BY 1, 2)
    SELECT x, count(*) AS times FROM (SELECT x, row_number() OVER (PARTITION BY rep ORDER BY l, x) AS place FROM r) t WHERE place = 1 GROUP BY 1""", "x")
def argmin_bootstrap(spark, sf):
    g = games(spark, sf).select("slate", F.explode(F.array(*(F.struct(F.lit(float(x)).alias("x"), F.abs(F.col("points") - x).alias("l")) for x in (218, 222, 226)))).alias("z")).select("slate", "z.*")
    return R.argmin_bootstrap(g, "slate", "x", "l")


@query("R04", f"""WITH s AS (SELECT slate, count(*) AS n, sum(spread) AS sx, sum(margin) AS sy, sum(spread * spread) AS sxx, sum(spread * margin) AS sxy FROM g GROUP BY 1), r AS (SELECT rep, sum(k * n) AS n, sum(k * sx) AS sx, sum(k * sy) AS sy, sum(k * sxx) AS sxx, sum(k * sxy) AS sxy FROM {drawn_sql('s', 'slate', 13)} d GROUP BY 1)
    SELECT avg(b) AS slope, stddev_samp(b) AS se FROM (SELECT (n * sxy - sx * sy) / nullif(n * sxx - sx * sx, 0) AS b FROM r) t""", "slope se")
def slope_bootstrap(spark, sf):
    return R.slope_bootstrap(games(spark, sf), "slate", "spread", "margin")


@query("R05", f"""WITH s AS (SELECT slate, book, sum(won - p) AS s, sum((won - p) * (won - p)) AS q FROM g GROUP BY 1, 2), o AS (SELECT max(z) AS z_max FROM (SELECT abs(sum(s)) / nullif(sqrt(sum(q)), 0) AS z FROM s GROUP BY book) t),
    r AS (SELECT rep, book, abs(sum(f)) / nullif(sqrt(sum(q)), 0) AS z FROM (SELECT *, CASE WHEN {uniform_sql(14, 'slate')} < 0.5 THEN -s ELSE s END AS f FROM s, (SELECT unnest(range(1, 101)) AS rep) d) t GROUP BY 1, 2), m AS (SELECT rep, max(z) AS m FROM r GROUP BY 1)
    SELECT any_value(z_max) AS z_max, avg(CAST(m >= z_max AS DOUBLE)) AS p_value, quantile_cont(m, 0.95) AS z_95 FROM m, o""", "z_max p_value z_95")
def sign_flip_test(spark, sf):
    return R.sign_flips(games(spark, sf).withColumn("x", F.col("won") - F.col("p")), "slate", "book", "x", 100)


@query("C01 C02 C04 C06", """SELECT CAST(o_orderkey AS VARCHAR) AS key, 'price range' AS rule FROM orders WHERE NOT o_totalprice BETWEEN 2000 AND 490000 UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'known status' FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
    UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'has lines' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def quality_violations(spark, sf):
    o = table(spark, sf, "orders")
    rules = [C.Constraint("price range", F.col("o_totalprice").between(2000, 490000)), C.Constraint("known status", F.col("o_orderstatus").isin("F", "O"), strict=True)]
    return C.all_of(C.violations(o, "o_orderkey", rules), C.orphans(o, table(spark, sf, "lineitem").select("l_orderkey").distinct(), "o_orderkey", "l_orderkey", "has lines"))


@query("C03", "SELECT CAST(l_orderkey AS VARCHAR) AS key, 'one ship date' AS rule FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_shipdate) > 1")
def one_snapshot(spark, sf):
    return C.one_value(table(spark, sf, "lineitem"), ["l_orderkey"], "l_shipdate", "one ship date")


@query("C07 C08", f"SELECT CAST(game_id AS VARCHAR) AS key, 'units' AS rule FROM g WHERE ({UNITS}) > 2")
def recomputed_units(spark, sf):
    c = F.col
    u = P.unit_profit(c("home_ml"), c("home_won"))
    return C.recomputed(priced(spark, sf).withColumn("stored", F.when(u > 2, 0.0).otherwise(u)), "game_id", "stored", u, "units")


@query("C09", "SELECT 'away_ml' AS \"column\", count(*) FILTER (away_ml IS NULL) AS missing FROM g UNION ALL SELECT 'p', count(*) FILTER (p IS NULL) FROM g")
def missing_inventory(spark, sf):
    return C.missing_inventory(games(spark, sf), ["away_ml", "p"])


@query("S17", "SELECT conv_id, turn, coalesce(last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), -1) AS asked FROM conversations")
def carry_forward_text(spark, sf):
    from pyspark.sql import Window

    past = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf, "conversations").select("conv_id", "turn", F.last(F.when(F.col("role") == "user", F.col("turn")), True).over(past).alias("asked")).fillna(-1, ["asked"])


@query("S06 S09 S13", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("S19 S20", "SELECT day FROM e GROUP BY day HAVING bool_and(value < 480)")
def closed_dates(spark, sf):
    t = ticks(spark, sf).withColumn("state", F.when(F.col("value") < 480, "post").otherwise("in"))
    return S.open_dates(t, t.where("false").select("day"), "day", "state")[1]


@query("V02", """WITH li AS (SELECT l_orderkey, l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER w - 1 AS k, sum(q) OVER (PARTITION BY l_orderkey) - (sum(q) OVER w - q) AS rest FROM li WINDOW w AS (PARTITION BY l_orderkey ORDER BY q DESC, l_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    x AS (SELECT l_orderkey, min_by((100 - k * 40) / rest, k) AS level FROM r WHERE q * (100 - k * 40) / rest <= 40 GROUP BY 1)
    SELECT li.l_orderkey, l_partkey, CAST(least(40, coalesce(q * level, 40)) AS DOUBLE) AS allocated FROM li LEFT JOIN x USING (l_orderkey)""", "allocated")
def water_filling(spark, sf):
    li = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").alias("q"))
    return V.allocate(li, ["l_orderkey"], "q", 100.0, 40.0, ["l_partkey"]).select("l_orderkey", "l_partkey", "allocated")



@query("E20 E05", "WITH t AS (SELECT event_id, game, value, quantile_cont(value, 0.9) OVER (PARTITION BY game) AS cut, percent_rank() OVER (PARTITION BY game ORDER BY value) AS r FROM e) SELECT event_id, greatest(value - cut, 0) AS star, r AS rank_share, r * r AS rank_power FROM t", "star rank_share rank_power")
def star_terms(spark, sf):
    return E.star_terms(ticks(spark, sf), ["game"], "value").select("event_id", "star", "rank_share", "rank_power")
