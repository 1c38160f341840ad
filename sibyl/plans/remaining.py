"""Queries of the functions that no other query calls, each over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import features as E
from ..functions import prices as P
from ..functions import scalars as S
from ..operators import causal as W
from ..operators import joins as J
from ..operators import measure as A
from ..operators import scope as K
from ..operators import walk as B
from ..sources import feeds
from ..streaming import snapshots as X
from .driver import games, query, table, ticks
from .histories import _SNAP
from .prices import QSQL, UNITS, priced


def _sides(spark, sf):
    """Two rows a game: the home team and, with an id of its own, the away team."""
    c = F.col
    row = lambda t, o, h, v: F.struct(t.alias("team"), o.alias("opp"), F.lit(h).alias("home"), v.alias("pts"))
    away = c("team") + 1000000000
    return games(spark, sf).select("game_id", F.explode(F.array(row(c("team"), away, True, c("points")), row(away, c("team"), False, c("total")))).alias("x")).select("game_id", "x.*")


def _reports(spark, sf):
    return table(spark, sf, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("team"), "c_mktsegment")


@query("S19 S22", "SELECT game_id, team, book FROM g WHERE NOT EXISTS (SELECT 1 FROM g s WHERE s.team = g.team AND s.book = g.book AND s.basis = 'F')")
def pending_pairs(spark, sf):
    g = games(spark, sf)
    return feeds.pending_work(g.select("game_id", "team", "book"), g.where("basis = 'F'"), ["team", "book"])


@query("S24", "SELECT game_id, unnest(['9', '40']) AS provider, 'n' AS name, unnest([spread + 1, spread]) AS spread FROM g", "spread")
def listed_providers(spark, sf):
    c = F.col
    item = lambda i, s: F.struct(F.struct(F.lit(i).alias("id"), F.lit("n").alias("name")).alias("provider"), s.alias("spread"))
    js = F.to_json(F.struct(F.array(item("9", c("spread") + 1), item("40", c("spread"))).alias("items")))
    return feeds.providers(games(spark, sf).select("game_id", js.alias("t")), "t", "game_id")


@query("J01", "SELECT game_id, team AS home, team + 1000000000 AS away, points AS h_pts, total AS a_pts FROM g", "h_pts a_pts")
def game_sides(spark, sf):
    return J.both_sides(_sides(spark, sf), "team", "opp", "game_id", "home", ["pts"])


@query("J14", "SELECT game_id, team, points AS pts, total AS opp_pts FROM g UNION ALL SELECT game_id, team + 1000000000, total, points FROM g", "pts opp_pts")
def opponent_totals(spark, sf):
    return J.with_opponent(_sides(spark, sf).select("game_id", "team", "pts"), "game_id", "team", ["pts"])


@query("J02", "SELECT team, game_id, c_mktsegment FROM g JOIN customer ON c_custkey = team WHERE c_acctbal >= 0")
def reported_games(spark, sf):
    return J.with_terms(games(spark, sf).select("team", "game_id"), _reports(spark, sf), ["team"])


@query("J03", "SELECT team, game_id, c_mktsegment FROM g LEFT JOIN (SELECT * FROM customer WHERE c_acctbal >= 0) c ON c_custkey = team")
def enriched_games(spark, sf):
    return J.enriched(games(spark, sf).select("team", "game_id"), _reports(spark, sf), ["team"])


@query("J13", "SELECT l_suppkey, l_orderkey, l_linenumber, min(l_partkey) OVER (PARTITION BY l_suppkey) AS l_partkey FROM lineitem")
def first_parts(spark, sf):
    li = table(spark, sf, "lineitem")
    return J.first_id(li.select("l_suppkey", "l_orderkey", "l_linenumber"), li, ["l_suppkey"], "l_partkey")


@query("J20", "WITH t AS (SELECT team, season, sum(margin) AS m FROM g GROUP BY 1, 2) SELECT a.team, a.season, a.m, b.m AS last_m FROM t a LEFT JOIN t b ON a.team = b.team AND a.season = b.season + 1", "m last_m")
def season_before(spark, sf):
    t = games(spark, sf).groupBy("team", "season").agg(F.sum("margin").alias("m"))
    return J.next_season(t, t, ["team"], "season", ["m"])


@query("J23", "SELECT game_id, CASE WHEN won = 1 THEN p / 2 ELSE p END AS p, spread FROM g", "p spread")
def rescored_games(spark, sf):
    g = games(spark, sf)
    return J.rescored(g.select("game_id", "p", "spread"), g.where("won = 1").select("game_id", (F.col("p") / 2).alias("p")), ["game_id"], ["p"])


@query("J24", "SELECT game_id, p, close_home_ml AS close_price, 1 - p AS close_q FROM g", "p close_price close_q")
def repriced_games(spark, sf):
    c = F.col
    g = games(spark, sf)
    at = lambda kind, price, q: F.struct(F.lit(kind).alias("kind"), price.alias("price"), q.alias("q"))
    prices = g.select("game_id", F.explode(F.array(at("open", c("home_ml"), c("p")), at("close", c("close_home_ml"), 1 - c("p")))).alias("x")).select("game_id", "x.*")
    return J.repriced(g.select("game_id", "p"), prices, ["game_id"], "close")


@query("J26", "WITH n AS (SELECT team, day, count(*) OVER w AS in_logs, count(*) FILTER (won = 1) OVER w AS in_boxes FROM g WINDOW w AS (PARTITION BY team ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT DISTINCT team, day AS slate, in_logs, in_boxes FROM n WHERE in_logs <> in_boxes")
def audited_counts(spark, sf):
    g = games(spark, sf)
    return J.count_audit(g, g.where("won = 1"), "team", "day", g.select("team", F.col("day").alias("slate")).distinct())


@query("J32", "SELECT basis, season, avg(CASE WHEN team IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) THEN 1e0 ELSE 0e0 END) AS listed, count(*) AS n FROM g GROUP BY 1, 2", "listed")
def listed_share(spark, sf):
    return J.listing_share(games(spark, sf), _reports(spark, sf), ["team"], ["basis", "season"])


@query("F11", """SELECT game_id, CASE WHEN won IS NULL THEN 'result' ELSE 'close' END AS why FROM (SELECT game_id, slate, CASE WHEN margin > 0 THEN won END AS won, CASE WHEN spread > 0 THEN close_home_ml END AS h, close_away_ml AS a FROM g) t
    WHERE slate < DATE '1998-01-01' AND (won IS NULL OR (slate >= DATE '1997-12-25' AND (h IS NULL OR a IS NULL)))""")
def pending_games(spark, sf):
    c = F.col
    g = games(spark, sf).select("game_id", "slate", F.when(c("margin") > 0, c("won")).alias("won"), F.when(c("spread") > 0, c("close_home_ml")).alias("close_home_ml"), "close_away_ml")
    return K.pending(g, "1998-01-01").select("game_id", "why")


@query("F13", "SELECT game, day, min(sec) AS sec FROM e WHERE sec < CAST(day AS BIGINT) * 86400 + 72000 AND sec >= CAST(day AS BIGINT) * 86400 + 54000 GROUP BY 1, 2")
def official_captures(spark, sf):
    c = F.col
    t = ticks(spark, sf).withColumns({"key": F.struct("game", "day"), "at": c("sec").cast("timestamp"), "tip": (c("day").cast("long") * 86400 + 72000).cast("timestamp")})
    return K.official(t, "key", "at", "at", "tip").select("game", "day", "sec")


@query("F15", "SELECT game, day, kind = 'view' AS pre, sec FROM (SELECT *, row_number() OVER (PARTITION BY game, day ORDER BY (kind = 'view') DESC, sec DESC) AS k FROM e WHERE sec < CAST(day AS BIGINT) * 86400 + 72000 AND kind <> 'error' AND value > 0) t WHERE k = 1")
def pregame_quotes(spark, sf):
    c = F.col
    t = ticks(spark, sf).select("game", "day", "sec", c("sec").alias("ts"), (c("day").cast("long") * 86400 + 72000).alias("tip_ts"), (c("kind") != "error").alias("active"), c("value").alias("points"), F.when(c("kind") == "view", "pre").otherwise("first").alias("kind"))
    return K.pregame_projections(t, ["game", "day"]).select("game", "day", (c("kind") == "pre").alias("pre"), "sec")


@query("F16", "SELECT game_id, CASE WHEN d >= 1.5 THEN 'large' WHEN d >= 0.5 THEN 'move' WHEN d > 0 THEN 'drift' ELSE 'none' END AS move FROM (SELECT game_id, abs(margin * 0.25e0 - spread) AS d FROM g) t")
def move_classes(spark, sf):
    return games(spark, sf).select("game_id", K.move_class(F.col("spread"), F.col("margin") * 0.25).alias("move"))


@query("F18", "SELECT avg(CASE WHEN l_quantity > 40 THEN 1e0 ELSE 0e0 END) AS heavy_share, count(*) AS n FROM (SELECT l_quantity, avg(l_quantity) OVER (PARTITION BY l_partkey) AS m FROM lineitem) t WHERE m >= 20", "heavy_share")
def heavy_lines(spark, sf):
    return K.heavy_minutes(table(spark, sf, "lineitem"), ["l_partkey"], "l_quantity", 20.0, 40.0)


@query("X04", _SNAP + " SELECT game, day, first AS first_total, lock AS lock_total FROM o".replace("first AS", '"first" AS'), "first_total lock_total")
def totals_slots(spark, sf):
    c = F.col
    t = ticks(spark, sf).withColumns({"at": c("sec").cast("timestamp"), "tip": (c("day").cast("long") * 86400 + 72000).cast("timestamp")})
    s = X.totals_state(t, ["game", "day"], "at", "tip", ["value"], "event_id", c("value") >= 20)
    return s.select("game", "day", c("first_total.value").alias("first_total"), c("lock_total.value").alias("lock_total"))


@query("X05", _SNAP + """ SELECT game, day, concat_ws('; ', CASE WHEN pre IS NULL THEN 'nothing before the deadline' END, CASE WHEN "first" IS NULL THEN 'no usable snapshot' END, CASE WHEN lock IS NULL THEN 'lock window missed' END) AS note FROM o""")
def slot_notes(spark, sf):
    c = F.col
    t = ticks(spark, sf).withColumns({"at": c("sec").cast("timestamp"), "tip": (c("day").cast("long") * 86400 + 72000).cast("timestamp")})
    return X.notes(X.pregame_state(t, ["game", "day"], "at", "tip", ["value"], "event_id", c("value") >= 20)).select("game", "day", "note")


@query("X07", "WITH s AS (SELECT *, min(sec) OVER w AS a, max(sec) OVER w AS b FROM e WHERE sec < CAST(day AS BIGINT) * 86400 + 72000 WINDOW w AS (PARTITION BY game, day)) SELECT event_id, 'first' AS slot FROM s WHERE sec = a UNION ALL SELECT event_id, 'pre' FROM s WHERE sec = b")
def snapshot_kinds(spark, sf):
    c = F.col
    t = ticks(spark, sf).select("game", "day", "event_id", "sec", (c("day").cast("long") * 86400 + 72000).alias("tip"))
    return X.two_kinds(t, ["game", "day"], "sec", "tip").select("event_id", c("kind").alias("slot"))


@query("X10 X11 X12", "SELECT game_id, team, season FROM g WHERE NOT EXISTS (SELECT 1 FROM g s WHERE s.team = g.team AND s.season = g.season AND s.won = 1)")
def unlogged_games(spark, sf):
    g = games(spark, sf)
    return X.new_only(g.select("game_id", "team", "season"), g.where("won = 1"), ["team", "season"])


@query("X14", "SELECT game_id FROM g WHERE slate < DATE '1998-01-01'")
def closed_games(spark, sf):
    return X.closed_slates(games(spark, sf), "slate", F.lit("1998-01-01 12:00:00").cast("timestamp")).select("game_id")


@query("B06", "SELECT team, day, 'training reaches the test season' AS why FROM g WHERE won = 1 UNION ALL SELECT team, day, 'repeated key' FROM g GROUP BY 1, 2 HAVING count(*) > 1")
def leaking_rows(spark, sf):
    return B.leakage(games(spark, sf).withColumn("trained", F.col("season") - 1 + F.col("won")), ["team", "day"], "trained", "season")


@query("B08", f"SELECT game_id, edge FROM (SELECT game_id, CASE WHEN p >= 0.5 THEN p - q ELSE q - p END AS edge FROM (SELECT *, {QSQL} AS q FROM g) x) y WHERE edge >= 0.05", "edge")
def bet_signals(spark, sf):
    return B.signals(priced(spark, sf), "p", "q", "home_ml", "away_ml", 0.05).select("game_id", "edge")


@query("B12", "SELECT book, season, count(*) AS n, avg(p) AS forecast, avg(CAST(won AS DOUBLE)) AS rate, stddev_samp(won - p) / sqrt(count(*)) AS gap_se FROM g GROUP BY 1, 2", "forecast rate gap_se")
def calibration_by_stage(spark, sf):
    return B.calibration_check(games(spark, sf), ["book", "season"], "p", "won")


@query("B20", "SELECT shrink, season, avg((p * shrink - won) * (p * shrink - won)) AS brier FROM g, (SELECT unnest([0.5e0, 0.75e0, 1e0]) AS shrink) s GROUP BY 1, 2", "shrink brier")
def shrink_sweep(spark, sf):
    return B.sweep(games(spark, sf), "shrink", [0.5, 0.75, 1.0], lambda d, v: d.groupBy("season").agg(F.avg(P.brier(F.col("p") * v, F.col("won"))).alias("brier")))


@query("B25", "SELECT part, avg(m) AS gap, count(*) AS games FROM (SELECT kind AS part, game, avg(abs(value - event_id % 50)) AS m FROM e GROUP BY 1, 2) t GROUP BY 1", "gap")
def tracked_quotes(spark, sf):
    return B.tracking(ticks(spark, sf).withColumn("price", F.col("event_id") % 50), F.col("kind"), "value", "price", "game")


@query("W19", "SELECT game_id, greatest(0.1e0, least(0.9e0, p + spread * 0.02e0)) AS q FROM g", "q")
def adjusted_chances(spark, sf):
    return games(spark, sf).select("game_id", W.adjusted(F.col("p"), F.col("spread") * 0.02, 0.1, 0.9).alias("q"))


@query("W24", "WITH d AS (SELECT season, day, sum(margin + spread) AS r, sum(total) AS v FROM g GROUP BY 1, 2), o AS (SELECT season, day, coalesce(sum(r) OVER w, 0) / (coalesce(sum(v) OVER w, 0) + 0.25e0) AS shift FROM d WINDOW w AS (PARTITION BY season ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT game_id, shift FROM g JOIN o USING (season, day)", "shift")
def season_offsets(spark, sf):
    g = games(spark, sf).withColumn("res", F.col("margin") + F.col("spread"))
    return W.season_offset(g, "season", "day", "res", "total", 2.0).select("game_id", F.col("offset").alias("shift"))


@query("A09", f"SELECT team, CASE WHEN min(sign(u)) <> max(sign(u)) THEN stddev_samp(u) / sqrt(count(u)) END AS se FROM (SELECT team, {UNITS} AS u FROM g) t GROUP BY 1", "se")
def unit_errors(spark, sf):
    return games(spark, sf).groupBy("team").agg(A.unit_se(P.unit_profit(F.col("home_ml"), F.col("won") == 1)).alias("se"))


@query("A32", "SELECT season, CAST(floor(p * 10) AS INT) AS pb, median(margin) AS median, avg(margin) AS mean, count(*) AS n FROM g GROUP BY 1, 2", "median mean")
def band_fits(spark, sf):
    return A.fit_bands(games(spark, sf).withColumn("pb", F.floor(F.col("p") * 10).cast("int")), ["season"], "pb", "margin")


@query("E05", "SELECT game_id, coalesce(away_ml, 0e0) AS away_ml, away_ml IS NULL AS changed FROM g", "away_ml")
def filled_terms(spark, sf):
    return E.neutral_fill(games(spark, sf).select("game_id", "away_ml"), ["away_ml"])


@query("E06", "SELECT game_id, 1 / (1 + exp(-(0.1e0 * spread - 0.05e0 * margin + 0.2e0))) AS p FROM g", "p")
def predicted_games(spark, sf):
    return games(spark, sf).select("game_id", E.predict(F.array("spread", "margin"), F.array(F.lit(0.1), F.lit(-0.05)), F.lit(0.2)).alias("p"))


@query("E11", "SELECT o_orderkey, 3 - 0.5e0 * ln(o_orderkey + 1) + 2 AS value FROM orders", "value")
def rookie_values(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", E.rookie_value(F.col("o_orderkey") + 1, 3.0, -0.5, -2.0).alias("value"))


_ASK = "({0} + 0.07e0 * {0} * (1 - {0}))"


@query("P15", f"""SELECT game_id, (hb + ha) / 2 / ((hb + ha) / 2 + (ab + aa) / 2) AS mid, CASE WHEN ha < 1 AND aa < 1 THEN coalesce((hb + ha) / 2 / ((hb + ha) / 2 + (ab + aa) / 2), {_ASK.format('ha')} / ({_ASK.format('ha')} + {_ASK.format('aa')})) END AS q
    FROM (SELECT game_id, CASE WHEN p <= 0.9 THEN p END AS hb, p + 0.02e0 AS ha, CASE WHEN p >= 0.2 THEN 1 - p END AS ab, 1 - p + 0.0605e0 AS aa FROM g) t""", "mid q")
def mid_chances(spark, sf):
    p = F.col("p")
    sides = (F.when(p <= 0.9, p), p + 0.02, F.when(p >= 0.2, 1 - p), 1 - p + 0.0605)
    return games(spark, sf).select("game_id", P.mid_q(*sides).alias("mid"), P.quoted_q(*sides).alias("q"))


@query("T14", "SELECT vec_id, list_inner_product(list_transform(embedding, lambda x: x::DOUBLE / 2), list_transform(embedding, lambda x: x::DOUBLE)) AS product FROM embeddings", "product")
def scaled_products(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    return e.select("vec_id", S.scaled_dot(F.col("e"), F.transform("e", lambda x: F.lit(2.0)), F.col("e")).alias("product"))
