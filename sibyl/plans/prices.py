"""Queries of prices, scopes and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import features as E
from ..functions import normal as N
from ..functions import prices as P
from ..functions import scalars as S
from ..operators import measure as A
from ..operators import scope as Q
from .driver import games, query, table, ticks

_IMPLIED = "CASE WHEN {0} >= 100 THEN 100 / ({0} + 100) WHEN {0} <= -100 THEN -{0} / (-{0} + 100) END"
_DEC = "CASE WHEN {0} >= 100 THEN 1 + {0} / 100 WHEN {0} <= -100 THEN 1 + 100 / -{0} END"
IH, IA = _IMPLIED.format("home_ml"), _IMPLIED.format("away_ml")
QSQL = f"(({IH}) / (({IH}) + ({IA})))"
CQ = f"(({_IMPLIED.format('close_home_ml')}) / (({_IMPLIED.format('close_home_ml')}) + ({_IMPLIED.format('close_away_ml')})))"
UNITS = f"(CASE WHEN won = 1 THEN ({_DEC.format('home_ml')}) - 1 WHEN ({_DEC.format('home_ml')}) IS NOT NULL THEN -1.0 END)"


def priced(spark, sf):
    c = F.col
    return games(spark, sf).withColumns({"q": P.devig(c("home_ml"), c("away_ml")), "cq": P.devig(c("close_home_ml"), c("close_away_ml")), "home_won": c("won") == 1})


@query("P01 P02 P05 P06 P07 A31", f"""SELECT game_id, {IH} AS implied, {QSQL} AS q, ({IH}) + ({IA}) - 1 AS hold, {UNITS} AS units,
    CASE WHEN p >= 0.5 THEN -round_even(100 * p / (1 - p), 0) ELSE round_even(100 * (1 - p) / p, 0) END AS fair, p + 0.07 * p * (1 - p) AS cost FROM g""", "implied q hold units fair cost")
def price_scalars(spark, sf):
    c = F.col
    return priced(spark, sf).select("game_id", P.implied(c("home_ml")).alias("implied"), "q", P.hold(c("home_ml"), c("away_ml")).alias("hold"), P.unit_profit(c("home_ml"), c("home_won")).alias("units"), P.american_from_prob(c("p")).alias("fair"), P.exchange_cost(c("p")).alias("cost"))


_PAIRS = f"WITH RECURSIVE m AS (SELECT DISTINCT home_ml, away_ml, {IH} AS a, {IA} AS b FROM g WHERE ({IH}) IS NOT NULL AND ({IA}) IS NOT NULL), "


def _pairs(spark, sf):
    """Distinct pairs of valid prices. A filter on what is computed of a pair would be moved below the distinct, to every row."""
    c = F.col
    return games(spark, sf).select("home_ml", "away_ml").where(P.hold(c("home_ml"), c("away_ml")).isNotNull()).distinct()


@query("P03 V03", _PAIRS + """b AS (SELECT home_ml, away_ml, a, b, 0.2e0 AS lo, 8e0 AS hi, 0 AS i FROM m UNION ALL
    SELECT home_ml, away_ml, a, b, CASE WHEN pow(a, (lo + hi) / 2) + pow(b, (lo + hi) / 2) > 1 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN pow(a, (lo + hi) / 2) + pow(b, (lo + hi) / 2) > 1 THEN hi ELSE (lo + hi) / 2 END, i + 1 FROM b WHERE i < 60)
    SELECT home_ml, away_ml, pow(a, (lo + hi) / 2) AS q FROM b WHERE i = 60""", "q")
def power_novig(spark, sf):
    return _pairs(spark, sf).withColumn("q", P.price_q(F.lit(None).cast("double"), F.col("home_ml"), F.col("away_ml"), P.power_devig))


_SIDE = "((sqrt(z * z + 4 * (1 - z) * {0} * {0} / (a + b)) - z) / (2 * (1 - z)))"
_TEST = f"({_SIDE.format('a')} + {_SIDE.format('b')} > 1)".replace("z", "((lo + hi) / 2)")


@query("P04", _PAIRS + f"""s AS (SELECT home_ml, away_ml, a, b, 0e0 AS lo, 0.5e0 AS hi, 0 AS i FROM m UNION ALL
    SELECT home_ml, away_ml, a, b, CASE WHEN {_TEST} THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {_TEST} THEN hi ELSE (lo + hi) / 2 END, i + 1 FROM s WHERE i < 60)
    SELECT home_ml, away_ml, CASE WHEN a + b <= 1 THEN a / (a + b) ELSE {_SIDE.format('a').replace('z', '((lo + hi) / 2)')} END AS q FROM s WHERE i = 60""", "q")
def shin_novig(spark, sf):
    return _pairs(spark, sf).withColumn("q", P.shin_devig(F.col("home_ml"), F.col("away_ml")))


_RUNG = "CASE " + " ".join(f"WHEN home_ml BETWEEN {lo!r} AND {hi!r} THEN '{label}'" for label, lo, hi in P.RUNGS) + " END"
_SPREADS = (-8, -4, 0, 4, 8)
_BAND = "CASE " + " ".join(f"WHEN spread >= {a} AND spread {'<=' if i == len(_SPREADS) - 2 else '<'} {b} THEN {i}" for i, (a, b) in enumerate(zip(_SPREADS, _SPREADS[1:], strict=False))) + " END"


@query("P08 P09 P10 P12 P13 P16 P21 P22", f"""SELECT game_id, CASE WHEN margin + spread > 0 THEN 1e0 WHEN margin + spread < 0 THEN 0e0 ELSE 0.5e0 END AS ats, {_RUNG} AS rung, CAST({_BAND} AS INT) AS band,
    CASE WHEN abs(spread - spread) > 1e-9 THEN NULL ELSE spread END AS home_line, coalesce(home_ml BETWEEN -135 AND 115 AND away_ml BETWEEN -135 AND 115, false) AS main_line, coalesce({CQ}, {QSQL}) AS q, p >= 0.5 AS lean_home,
    CASE WHEN p * ({_DEC.format('home_ml')}) - 1 > 0 AND p * ({_DEC.format('home_ml')}) - 1 >= coalesce((1 - p) * ({_DEC.format('away_ml')}) - 1, -1e300) THEN 'home' WHEN (1 - p) * ({_DEC.format('away_ml')}) - 1 > 0 THEN 'away' END AS side FROM g""", "ats q")
def sides_and_bands(spark, sf):
    c = F.col
    return priced(spark, sf).select("game_id", P.ats_result(c("margin"), c("spread")).alias("ats"), P.ladder_rung(c("home_ml")).alias("rung"), P.band(c("spread"), _SPREADS).alias("band"), P.home_spread(c("spread"), -c("spread")).alias("home_line"), P.main_line(c("home_ml"), c("away_ml")).alias("main_line"), P.price_q(c("cq"), c("home_ml"), c("away_ml")).alias("q"), P.lean_is_home(F.lit(None).cast("string"), F.lit("h"), F.lit("a"), c("p")).alias("lean_home"), P.position(c("p"), c("home_ml"), c("away_ml")).alias("side"))


_LOGIT = "ln(greatest(1e-6, least(1 - 1e-6, {0})) / (1 - greatest(1e-6, least(1 - 1e-6, {0}))))"


@query("P17 P18 P19 P20", f"""SELECT game_id, CASE WHEN q IS NOT NULL THEN 1 / (1 + exp(-({_LOGIT.format('q')} + 0.3 * ({_LOGIT.format('p')} - {_LOGIT.format('q')})))) END AS shrunk, {_LOGIT.format('p')} AS logit, (p - won) * (p - won) AS brier,
    -ln(CASE WHEN won = 1 THEN p ELSE 1 - p END) AS loss, {N.norm_cdf_sql('margin / 13.5e0')} AS cdf, {N.norm_ppf_sql('p')} AS ppf FROM (SELECT *, {QSQL} AS q FROM g) t""", "shrunk logit brier loss cdf ppf")
def probability_scalars(spark, sf):
    c = F.col
    return priced(spark, sf).select("game_id", P.shrink_p(c("p"), c("q"), 0.3).alias("shrunk"), P.logit(c("p")).alias("logit"), P.brier(c("p"), c("won")).alias("brier"), P.log_loss(c("p"), c("won")).alias("loss"), P.norm_cdf(c("margin") / 13.5).alias("cdf"), P.norm_ppf(c("p")).alias("ppf"))


@query("P11 P14 P15 P23 P24 P25 P26", """SELECT event_id, CASE WHEN k >= 100 THEN CAST(k AS DOUBLE) END AS american, CASE WHEN kind = 'view' THEN 0e0 WHEN value <= 60 THEN value END AS line, CASE WHEN value BETWEEN 100 AND 400 THEN value END AS total,
    CASE WHEN kind = 'error' THEN 'fd' ELSE kind END AS book, value * 1.5 + k * 2 AS points, CASE WHEN k % 2 = 0 THEN (value + k * 0.5e0) / 2 ELSE value END AS blend, ln(value / 0.8e0) - ln(1 + greatest(0, (1 + value * value) / 0.8e0 - (value / 0.8e0) * (value / 0.8e0)) / ((value / 0.8e0) * (value / 0.8e0))) / 2 AS mu
    FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM e) t""", "american line total points blend mu")
def feed_scalars(spark, sf):
    c = F.col
    k = F.get_json_object("props", "$.k").cast("long")
    t = ticks(spark, sf).withColumn("k", k)
    mu, _ = P.lognormal_moments(c("value"), F.lit(1.0), F.lit(0.8))
    rate = F.when(c("k") % 2 == 0, F.lit(0.5))
    return t.select("event_id", P.parse_american(F.concat(F.lit("+"), c("k").cast("string"))).alias("american"), P.parse_line(F.when(c("kind") == "view", "pk").otherwise(c("value").cast("string"))).alias("line"), P.parse_total(F.concat(F.lit("o "), c("value").cast("string"))).alias("total"), P.mapped(c("kind"), {"error": "fd"}).alias("book"), P.weighted_points([c("value"), c("k")], [1.5, 2.0]).alias("points"), P.mean_projection(c("value"), c("k"), rate).alias("blend"), mu.alias("mu"))


@query("T01 T02 T12", """SELECT c_custkey, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')) AS norm, 'Ana ' || c_name AS flipped, CASE WHEN c_mktsegment IN ('HOUSEHOLD', 'MACHINERY') THEN 'guard' ELSE 'big' END AS role,
    CASE WHEN c_mktsegment IN ('HOUSEHOLD', 'MACHINERY') THEN 1.5e0 ELSE 5e0 END AS position FROM customer""", "position")
def name_keys(spark, sf):
    c = F.col
    pos = F.when(c("c_mktsegment").isin("HOUSEHOLD", "MACHINERY"), "PG-SG").otherwise("C")
    return table(spark, sf, "customer").select("c_custkey", S.norm_name(c("c_name")).alias("norm"), S.first_last(F.concat(c("c_name"), F.lit(", Ana"))).alias("flipped"), S.position_group(pos).alias("role"), S.position_number(pos).alias("position"))


@query("T03 T04", """SELECT c_custkey, CASE WHEN right(c_name, 2) <> '07' AND right(c_name, 2) < '90' THEN 'T' || right(c_name, 2) END AS code, c_mktsegment AS away, 'CD' AS home FROM customer""")
def team_codes(spark, sf):
    """The last two digits of each customer's name against 90 full names, two of which end alike."""
    c = F.col
    codes = [(f"Team {i:02d}", f"T{i:02d}") for i in range(90)] + [("Other 07", "O07")]
    m = S.matchup(F.concat(c("c_mktsegment"), F.lit("@CD")))
    return table(spark, sf, "customer").select("c_custkey", S.unique_code(F.substring("c_name", -2, 2), codes).alias("code"), m["away"].alias("away"), m["home"].alias("home"))


@query("T05 T06 T07 T08 T09 T10 T13", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS parsed, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS utc, 65e0 AS clock, (2 - 1) * 720 + (720 - 65) + 0e0 AS elapsed, (2 * 720 + 65) / 2880e0 AS tau, CAST(year(o_orderdate) + CAST(month(o_orderdate) >= 8 AS INT) AS INT) AS season,
    strftime(o_orderdate - INTERVAL 6 HOUR, '%Y-%m-%d') AS shown, greatest(0e0, least(1e0, date_diff('day', make_date(CAST(year(o_orderdate) AS BIGINT), 1, 1), CAST(o_orderdate AS DATE)) / 175e0)) AS phase, dayofweek(o_orderdate) IN (2, 3, 4) AS midweek, dayofweek(o_orderdate) IN (0, 1) AS sun_mon FROM orders""", "clock elapsed tau phase")
def calendar_scalars(spark, sf):
    c = F.col
    o = table(spark, sf, "orders").withColumn("d", c("o_orderdate").cast("date"))
    opening = F.make_date(F.year("d"), F.lit(1), F.lit(1))
    utc = S.parse_utc(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    return o.select("o_orderkey", S.report_date(F.date_format("d", "MM/dd/yyyy")).cast("string").alias("parsed"), S.format_utc(utc).alias("utc"), S.clock_seconds(F.lit("1:05")).alias("clock"), S.elapsed(F.lit(2), F.lit(65.0)).alias("elapsed"), S.tau(F.lit(2), F.lit(65.0)).alias("tau"), S.season_of(c("d")).alias("season"), S.shown_slate(c("o_orderdate")).cast("string").alias("shown"), S.season_phase(c("d"), opening).alias("phase"), S.midweek(c("d")).alias("midweek"), S.sunday_monday(c("d")).alias("sun_mon"))


@query("T11 S05", """SELECT c_custkey, sha256('{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '"}') AS id FROM customer""")
def content_ids(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", S.content_id(["c_mktsegment", "c_custkey"]).alias("id"))


@query("T14 T15 T16 E15", """SELECT vec_id, list_inner_product(e, e) AS norm2, e[1] * 0.5e0 AS part, CASE WHEN t <= 0 THEN 1e0 WHEN t < 0.5 THEN 1 + 2 * t WHEN t < 1 THEN 2 + 2 * (t - 0.5) * 2 ELSE 4e0 END AS interp, spline AS spline
    FROM (SELECT vec_id, e, e[1] + 0.3 AS t, (pow(greatest(e[1] + 1, 0), 3) - pow(greatest(e[1] - 1, 0), 3)) / 2 - (pow(greatest(e[1], 0), 3) - pow(greatest(e[1] - 1, 0), 3)) / 1 AS spline FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings) a) b""", "norm2 part interp spline")
def array_scalars(spark, sf):
    c = F.col
    v = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e")).withColumn("t", c("e")[0] + 0.3)
    half = F.transform("e", lambda x: F.lit(0.5))
    return v.select("vec_id", S.dot(c("e"), c("e")).alias("norm2"), E.contributions(c("e"), half)[0].alias("part"), S.interpolate(c("t"), [0.0, 0.5, 1.0], F.array(F.lit(1.0), F.lit(2.0), F.lit(4.0))).alias("interp"), S.spline_basis(c("e")[0], [-1.0, 0.0, 1.0])[1].alias("spline"))


@query("F01 F02 F07 F09 F10", f"""SELECT game_id, lean_ml, other_ml, stage FROM (SELECT *, CASE WHEN p >= 0.5 THEN close_home_ml ELSE close_away_ml END AS lean_ml, CASE WHEN p >= 0.5 THEN close_away_ml ELSE close_home_ml END AS other_ml,
    CASE WHEN least(r1, r2) = 0 THEN '0' WHEN least(r1, r2) < 10 THEN '1-9' ELSE '10+' END AS stage FROM (SELECT *, game_id % 13 AS r1, team % 17 AS r2 FROM g) a WHERE abs(close_home_ml) >= 100 AND abs(close_away_ml) >= 100 AND book = '5-LOW') b WHERE stage IN ('0', '10+')""", "lean_ml other_ml")
def scoped_games(spark, sf):
    c = F.col
    g = Q.with_close(Q.graded(Q.on_book(games(spark, sf), "5-LOW", ["hidden"])).withColumn("lean_home", c("p") >= 0.5), "close_home_ml", "close_away_ml", "lean_home")
    return Q.public_stages(g.withColumn("stage", Q.stage(c("game_id") % 13, c("team") % 17, True)), ["0", "10+"]).select("game_id", "lean_ml", "other_ml", "stage")


@query("F03 F05 F06", """WITH t AS (SELECT *, CASE WHEN game_id % 3 = 0 THEN 'm_v11' ELSE 'm_v10' END AS tag FROM g) SELECT season, count(*) AS n, (SELECT strftime(min(slate), '%Y-%m-%d') FROM t WHERE tag LIKE '%\\_v11' ESCAPE '\\') AS activated FROM t
    WHERE slate >= DATE '1996-01-01' AND slate < DATE '1999-01-01' AND tag LIKE '%\\_v11' ESCAPE '\\' AND basis = 'F' AND game_id % 7 BETWEEN 0 AND 5 AND game_id % 7 > 0 GROUP BY season""")
def registered_scope(spark, sf):
    c = F.col
    t = games(spark, sf).withColumn("tag", F.when(c("game_id") % 3 == 0, "m_v11").otherwise("m_v10"))
    act = Q.activation(t, "_v11")
    t = t.withColumn("tip_ts", c("slate").cast("timestamp")).withColumn("lock_ts", c("tip_ts") - F.make_interval(hours=(c("game_id") % 7).cast("int")))
    s = Q.registered(Q.frozen_forecasts(t, "F", "1996-01-01", "_v11"), "1996-01-01", "1999-01-01", "_v11")
    return s.groupBy("season").agg(F.count("*").alias("n")).join(F.broadcast(act.withColumn("activated", F.col("activated").cast("string"))))


@query("F04 F11 F20 F08", f"""WITH x AS (SELECT *, {QSQL} AS q FROM g WHERE game_id % 10 <> 0) SELECT 'edge' AS rule, count(*) AS n FROM x WHERE p - q >= 0.05 UNION ALL SELECT 'fav', count(*) FROM x WHERE q >= 0.5 AND p - q >= 0.02""")
def rule_members(spark, sf):
    c = F.col
    g = priced(spark, sf)
    x = Q.without(g, g.where("game_id % 10 = 0"), "game_id")
    fav = F.struct(F.lit(None).cast("string").alias("stage"), F.lit("favorite").alias("side"), F.lit(0.02).alias("min_edge"))
    return Q.memberships(x, {"edge": c("p") - c("q") >= 0.05, "fav": Q.rule_member(c("p"), c("q"), F.lit("10+"), fav)}, "game_id").groupBy("rule").agg(F.count("*").alias("n"))


@query("F16 F17 F18 F19", """WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k, sum(l_quantity) OVER (PARTITION BY l_orderkey) AS s FROM lineitem)
    SELECT l_orderkey, count(*) FILTER (k <= 2) AS starters, max(CASE WHEN k = 1 THEN l_quantity END) AS star FROM r WHERE s BETWEEN 50 AND 150 GROUP BY l_orderkey""", "star")
def rotation_flags(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("tie", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    full = Q.complete_groups(li, ["l_orderkey"], "l_quantity", 50, 150)
    r = Q.rotation(full, ["l_orderkey"], "l_quantity", "tie", starters=2)
    return r.groupBy("l_orderkey").agg(F.count_if("starter").alias("starters"), F.max(F.when(F.col("star"), F.col("l_quantity"))).alias("star"))


@query("F12 F14", """WITH l AS (SELECT user_id, CAST(ts AS DATE) AS d, event_type FROM events), late AS (SELECT user_id, max(d) AS needed FROM l WHERE event_type = 'purchase' GROUP BY 1), own AS (SELECT user_id, max(d) AS have FROM l WHERE event_type = 'view' GROUP BY 1)
    SELECT user_id, strftime(needed, '%Y-%m-%d') AS needed, strftime(have, '%Y-%m-%d') AS have FROM late LEFT JOIN own USING (user_id) WHERE have IS NULL OR have < needed""")
def stale_logs(spark, sf):
    e = table(spark, sf, "events").withColumn("d", F.col("ts").cast("date"))
    return Q.stale_entities(e.where("event_type = 'view'"), e.where("event_type = 'purchase'"), "user_id", "d").select("user_id", F.col("needed").cast("string").alias("needed"), F.col("have").cast("string").alias("have"))


@query("Q02 Q03 Q04 F13 F15", """SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events) t WHERE k <= 3""", "value")
def top_per_key(spark, sf):
    return Q.latest_n(table(spark, sf, "events"), ["user_id"], [F.desc("value"), F.asc("event_id")], 3).select("user_id", "event_id", "value")


@query("Q01 Q06", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50", "o_totalprice")
def recent_rows(spark, sf):
    return Q.recent(table(spark, sf, "orders"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 50).select("o_orderkey", "o_totalprice")


@query("Q05 B05", """WITH l AS (SELECT season, book, sum((p - won) * (p - won)) AS loss FROM g GROUP BY 1, 2), t AS (SELECT a.season AS test, b.book AS arm, sum(b.loss) AS loss FROM (SELECT DISTINCT season FROM l) a JOIN l b ON b.season < a.season GROUP BY 1, 2)
    SELECT test, arm, loss FROM (SELECT *, row_number() OVER (PARTITION BY test ORDER BY loss, arm) AS k FROM t) x WHERE k = 1""", "loss")
def nested_arm(spark, sf):
    from ..operators import walk as B

    losses = games(spark, sf).groupBy("season", "book").agg(F.sum(P.brier(F.col("p"), F.col("won"))).alias("loss"))
    return B.nested_select(losses, "season", "book", "loss")


@query("U01", """SELECT game_id, CASE WHEN won = 1 THEN 'live' ELSE 'replay' END AS source FROM g""")
def precedence_union(spark, sf):
    g = games(spark, sf)
    return Q.with_precedence([g.where("won = 1").select("game_id", F.lit("live").alias("source")), g.select("game_id", F.lit("replay").alias("source"))], "game_id")


@query("U03 J23", "SELECT game_id, CASE WHEN game_id % 5 = 0 THEN p / 2 ELSE p END AS p FROM g", "p")
def replaced_rows(spark, sf):
    g = games(spark, sf).select("game_id", "p")
    return Q.replaced(g, g.where("game_id % 5 = 0").withColumn("p", F.col("p") / 2), ["game_id"])


@query("U04", "SELECT count(*) AS n FROM (SELECT DISTINCT team FROM g WHERE book = '5-LOW' INTERSECT SELECT DISTINCT team FROM g WHERE book = '1-URGENT') t")
def identical_rows(spark, sf):
    g = games(spark, sf)
    a, _ = Q.identical_keys([g.where("book = '5-LOW'").select("team").distinct(), g.where("book = '1-URGENT'")], ["team"])
    return a.agg(F.count("*").alias("n"))


@query("U05", "SELECT a.season AS test, b.season AS train FROM (SELECT DISTINCT season FROM g) a JOIN (SELECT DISTINCT season FROM g) b ON b.season < a.season")
def season_pairs(spark, sf):
    return Q.training_seasons(games(spark, sf).select("season").distinct())


@query("A01", f"""SELECT season, count(*) AS n, avg(bp) AS brier_model, avg(bq) AS brier_price, avg(lp) AS loss_model, avg(lq) AS loss_price, avg(CAST(CAST(p >= 0.5 AS INT) = won AS DOUBLE)) AS accuracy_model, avg(CAST(CAST(q >= 0.5 AS INT) = won AS DOUBLE)) AS accuracy_price,
    avg(lp - lq) AS loss_diff, stddev_samp(lp - lq) / sqrt(count(*)) AS loss_diff_se, avg(bp - bq) AS brier_diff, stddev_samp(bp - bq) / sqrt(count(*)) AS brier_diff_se
    FROM (SELECT *, (p - won) * (p - won) AS bp, (q - won) * (q - won) AS bq, -ln(CASE WHEN won = 1 THEN p ELSE 1 - p END) AS lp, -ln(CASE WHEN won = 1 THEN q ELSE 1 - q END) AS lq FROM (SELECT *, {QSQL} AS q FROM g) a WHERE q IS NOT NULL) b GROUP BY season""",
    "brier_model brier_price loss_model loss_price accuracy_model accuracy_price loss_diff loss_diff_se brier_diff brier_diff_se")
def scoring_summary(spark, sf):
    return A.scoring(priced(spark, sf), ["season"], "p", "q", "won")


@query("A02 B12", """SELECT season, CAST(least(floor(p * 10), 9) AS INT) AS bin, count(*) AS n, avg(p) AS forecast, avg(CAST(won AS DOUBLE)) AS rate, sqrt(sum(p * (1 - p))) / count(*) AS implied_se FROM g GROUP BY 1, 2""", "forecast rate implied_se")
def reliability_bins(spark, sf):
    return A.reliability(games(spark, sf), "p", "won", 10, ["season"])


@query("A03 U02", f"""WITH s AS (SELECT 'home' AS side, home_ml AS ml, {QSQL} AS q, won AS w FROM g UNION ALL SELECT 'away', away_ml, 1 - {QSQL}, 1 - won FROM g) SELECT {_RUNG.replace('home_ml', 'ml')} AS rung, side, count(*) AS n, avg(q) AS expected, avg(CAST(w AS DOUBLE)) AS rate, avg({_IMPLIED.format('ml')}) AS implied, avg(CAST(q >= 0.5 AS DOUBLE)) AS favorite_share FROM s GROUP BY 1, 2""", "expected rate implied favorite_share")
def two_sided_calibration(spark, sf):
    c = F.col
    s = Q.two_sides(priced(spark, sf), ["game_id"], {"ml": c("home_ml"), "q": c("q"), "w": c("won")}, {"ml": c("away_ml"), "q": 1 - c("q"), "w": 1 - c("won")})
    return A.market_calibration(s.withColumn("rung", P.ladder_rung(c("ml"))), "ml", "q", "w", "rung")


_ROI = f"""count(*) AS n, count(units) AS n_priced, CAST(sum(won) AS BIGINT) AS wins, sum(units) AS units, avg(units) AS roi, avg(nul) AS roi_null, stddev_samp(units) / sqrt(count(units)) AS roi_se,
    CASE WHEN stddev_samp(units - nul) > 0 THEN avg(units - nul) / (stddev_samp(units - nul) / sqrt(count(units - nul))) END AS z FROM (SELECT *, CASE WHEN ({_DEC.format('home_ml')}) IS NOT NULL AND units IS NOT NULL THEN q * ({_DEC.format('home_ml')}) - 1 END AS nul FROM (SELECT *, {UNITS} AS units, {QSQL} AS q FROM g) a) b"""
_ROI_D = "units roi roi_null roi_se z"


@query("A04 A07 S23", f"SELECT basis, book, season, {_ROI} GROUP BY 1, 2, 3", _ROI_D)
def roi_summary(spark, sf):
    return A.split_rows(priced(spark, sf), ["basis", "book", "season"], "home_ml", "home_won", "q")


@query("A06", f"SELECT rung, n, CASE WHEN n >= 10 THEN roi END AS roi FROM (SELECT {_RUNG} AS rung, {_ROI} GROUP BY 1) x", "roi")
def price_bands(spark, sf):
    d = A.roi(priced(spark, sf).withColumn("rung", P.ladder_rung(F.col("home_ml"))), ["rung"], "home_ml", "home_won", "q")
    return A.suppress_small(d, "n", ["roi"]).select("rung", "n", "roi")


@query("A05 A10", f"""WITH s AS (SELECT season, count(*) FILTER (margin + spread > 0) AS wins, count(*) FILTER (margin + spread < 0) AS losses, count(*) FILTER (margin + spread = 0) AS pushes FROM g GROUP BY 1), t AS (SELECT *, wins / (wins + losses) AS rate, (wins + losses) AS n FROM s)
    SELECT season, wins, losses, pushes, rate, ((rate + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n)) - 1.96 * sqrt(rate * (1 - rate) / n + 1.96 * 1.96 / (4 * n * n)) / (1 + 1.96 * 1.96 / n) AS lo, ((rate + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n)) + 1.96 * sqrt(rate * (1 - rate) / n + 1.96 * 1.96 / (4 * n * n)) / (1 + 1.96 * 1.96 / n) AS hi FROM t""", "rate lo hi")
def ats_wilson(spark, sf):
    c = F.col
    d = A.ats(games(spark, sf).withColumn("a", P.ats_result(c("margin"), c("spread"))), ["season"], "a")
    lo, hi = A.wilson(c("wins"), c("wins") + c("losses"))
    return d.withColumns({"lo": lo, "hi": hi})


@query("A08 A42", """SELECT coalesce(CAST(season AS VARCHAR), 'all') AS season, coalesce(book, 'all') AS book, CAST(grouping(season) * 2 + grouping(book) AS BIGINT) AS which, count(*) AS n, avg(e) AS bias, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse FROM (SELECT *, points - total AS e FROM g) t GROUP BY GROUPING SETS ((), (season), (book))""", "bias mae rmse")
def grouped_sets_metrics(spark, sf):
    return A.pooled_and_split(games(spark, sf).withColumn("e", F.col("points") - F.col("total")).withColumn("season", F.col("season").cast("string")), ["season", "book"], "e").fillna("all", ["season", "book"])


@query("A42", """SELECT book, count(*) AS n, avg(e) AS bias, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, median(e) AS median_error, avg(CAST(e < 0 AS DOUBLE)) AS below, avg(CAST(e = 0 AS DOUBLE)) AS equal FROM (SELECT *, points - total AS e FROM g) t GROUP BY book""", "bias mae rmse median_error below equal")
def forecast_errors(spark, sf):
    return A.error_table(games(spark, sf), ["book"], "total", "points")


@query("A11 J24", f"""SELECT season, count(*) AS n, avg(m) AS clv, stddev_samp(m) / sqrt(count(m)) AS clv_se, avg(CAST(m > 0 AS DOUBLE)) AS toward FROM (SELECT season, {CQ} - {QSQL} AS m FROM g) t WHERE m IS NOT NULL GROUP BY season""", "clv clv_se toward")
def closing_line_value(spark, sf):
    return A.closing_value(priced(spark, sf), ["season"], "q", "cq")


@query("A09 A13", f"""SELECT book, count(*) AS n, avg(CAST(f AS DOUBLE)) AS straight_up, avg(u) AS roi, avg(abs(margin + spread)) AS mae, sqrt(avg((margin + spread) * (margin + spread))) AS rmse, avg(margin + spread) AS bias FROM (SELECT *, won = 1 AS f, {UNITS} AS u FROM g) t GROUP BY book""", "straight_up roi mae rmse bias")
def market_figures(spark, sf):
    g = priced(spark, sf).withColumn("err", F.col("margin") + F.col("spread"))
    return A.market_summary(g, ["book"], "home_won", "home_ml", "err")


@query("A14", f"""WITH t AS (SELECT {UNITS} AS f, CASE WHEN p >= 0.5 THEN {UNITS} ELSE CASE WHEN won = 0 THEN ({_DEC.format('away_ml')}) - 1 WHEN ({_DEC.format('away_ml')}) IS NOT NULL THEN -1.0 END END AS m, p >= 0.5 AS agree FROM g)
    SELECT count(*) AS n, avg(m - f) AS diff, stddev_samp(m - f) / sqrt(count(m - f)) AS diff_se, count(*) FILTER (NOT agree) AS n_differ, avg(CASE WHEN NOT agree THEN m END) AS model_differ, avg(CASE WHEN NOT agree THEN f END) AS favorite_differ FROM t""", "diff diff_se model_differ favorite_differ")
def model_against_favorite(spark, sf):
    c = F.col
    g = priced(spark, sf).withColumn("f", P.unit_profit(c("home_ml"), c("home_won")))
    g = g.withColumns({"m": F.when(c("p") >= 0.5, c("f")).otherwise(P.unit_profit(c("away_ml"), ~c("home_won"))), "agree": c("p") >= 0.5})
    return A.against_favorite(g, "m", "f", "agree")


@query("A15", "SELECT event_type AS status, CAST(hour(ts) AS INT) AS lead, avg(CAST(value > 50 AS DOUBLE)) AS rate, count(*) AS n FROM events GROUP BY 1, 2", "rate")
def play_rate_table(spark, sf):
    e = table(spark, sf, "events").withColumns({"status": F.col("event_type"), "lead": F.hour("ts"), "played": F.col("value") > 50})
    return A.play_rates(e, "lead", "status", "played")


@query("A16", """WITH t AS (SELECT l_returnflag, l_suppkey, sum(l_extendedprice) AS total, sum(l_quantity) AS minutes, 100 * sum(l_extendedprice) / sum(l_quantity) AS rate FROM lineitem GROUP BY 1, 2)
    SELECT *, rate - sum(rate * minutes) OVER (PARTITION BY l_returnflag) / sum(minutes) OVER (PARTITION BY l_returnflag) AS centred FROM t""", "total minutes rate centred")
def centred_rates(spark, sf):
    return A.centred_rates(table(spark, sf, "lineitem"), ["l_suppkey"], ["l_returnflag"], "l_extendedprice", "l_quantity")


@query("A18", "WITH c AS (SELECT n_chars AS s, toxic AS y FROM documents JOIN labels USING (doc_id)) SELECT sum(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0 END) / count(*) AS auc FROM c a JOIN c b ON a.y = 1 AND b.y = 0", "auc")
def auc_rank(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    return A.auc(d, "n_chars", "toxic")


@query("A19", """WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events) SELECT user_id, sum(value / k) / sum(1.0 / k) AS weighted, count(*) / sum(1 / value) / avg(value) AS balance FROM r WHERE k <= 5 GROUP BY 1""", "weighted balance")
def harmonic_top(spark, sf):
    return A.harmonic_top(table(spark, sf, "events"), ["user_id"], "value", 5, ["event_id"])


@query("A20", """WITH c AS (SELECT l_orderkey, l_returnflag AS side, count(*) AS n, median(l_quantity) AS line FROM lineitem GROUP BY 1, 2), t AS (SELECT l_orderkey, max(n) AS top FROM c GROUP BY 1), l AS (SELECT c.l_orderkey, count(*) AS k, min(side) AS side, min(line) AS line FROM c JOIN t ON c.l_orderkey = t.l_orderkey AND n = top GROUP BY 1)
    SELECT l_orderkey, CASE WHEN k = 1 THEN side END AS side, CASE WHEN k = 1 THEN line END AS line FROM l""", "line")
def voted_lines(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("side", F.col("l_returnflag"))
    return A.voted_line(li, ["l_orderkey"], "side", "l_quantity")


@query("A21", "WITH m AS (SELECT l_orderkey, sum(l_discount * l_quantity) / sum(l_quantity) AS m FROM lineitem GROUP BY 1) SELECT avg(m) AS mean, stddev_samp(m) / sqrt(count(m)) AS se, count(*) AS games FROM m", "mean se")
def per_game_mean(spark, sf):
    return A.per_game_mean(table(spark, sf, "lineitem"), "l_orderkey", "l_discount", "l_quantity")


@query("A22 B24", """WITH c AS (SELECT book, slate, sum(abs(points - total)) AS s, count(*) AS n FROM g GROUP BY 1, 2), t AS (SELECT book, sum(s) AS S1, sum(n) AS N1 FROM c GROUP BY 1) SELECT book, CAST(any_value(N1) AS BIGINT) AS n, any_value(S1 / N1) AS mean, sqrt(greatest(0, sum((s - n * S1 / N1) * (s - n * S1 / N1)))) / any_value(N1) AS se FROM c JOIN t USING (book) GROUP BY 1""", "mean se")
def clustered_error(spark, sf):
    return A.clustered_mean(games(spark, sf).withColumn("e", F.abs(F.col("points") - F.col("total"))), "slate", "e", ["book"])


@query("A23", """WITH w AS (SELECT user_id, avg(CASE WHEN event_id % 2 = 0 THEN value END) AS a, avg(CASE WHEN event_id % 2 = 1 THEN value END) AS b FROM events GROUP BY 1), r AS (SELECT count(*) AS n, corr(a, b) AS r FROM w WHERE a IS NOT NULL AND b IS NOT NULL) SELECT n, r, 2 * r / (1 + r) AS reliability, tanh(atanh(r) - 1.96 / sqrt(n - 3)) AS lo, tanh(atanh(r) + 1.96 / sqrt(n - 3)) AS hi FROM r""", "r reliability lo hi")
def split_half(spark, sf):
    return A.split_half(table(spark, sf, "events").withColumn("half", F.col("event_id") % 2), ["user_id"], "half", "value")


@query("A24", """WITH d AS (SELECT user_id, event_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS d FROM events), l AS (SELECT *, lag(d) OVER (PARTITION BY user_id ORDER BY event_id) AS e FROM d) SELECT stddev_samp(d) AS sigma, (SELECT corr(d, e) FROM l WHERE d IS NOT NULL AND e IS NOT NULL) AS lag_corr FROM l""", "sigma lag_corr")
def increment_sigma(spark, sf):
    return A.increment_sigma(table(spark, sf, "events"), "user_id", "event_id", "value")


@query("A25", """WITH s AS (SELECT conv_id, CAST(turn // 2 AS BIGINT) AS period, max(turn) AS t FROM conversations GROUP BY 1, 2) SELECT conv_id, period, t - coalesce(lag(t) OVER (PARTITION BY conv_id ORDER BY period), 0) AS points FROM s""")
def period_points(spark, sf):
    t = table(spark, sf, "conversations").withColumn("period", F.floor(F.col("turn") / 2))
    return A.period_points(t, "conv_id", "period", "turn", "turn")


@query("A26 A27", """SELECT book, avg(abs(d)) AS mean, median(abs(d)) AS median, quantile_cont(abs(d), 0.9) AS p90, avg(CAST(abs(d) <= 0.01 AS DOUBLE)) AS within_1, avg(CAST(abs(d) <= 0.02 AS DOUBLE)) AS within_2, avg(CAST(abs(d) <= 0.05 AS DOUBLE)) AS within_5, avg(d) AS signed FROM (SELECT book, p - 0.5 AS d FROM g) t GROUP BY book""", "mean median p90 within_1 within_2 within_5 signed")
def gap_distribution(spark, sf):
    return A.gap_distribution(games(spark, sf).withColumn("d", F.col("p") - 0.5), "d", ["book"])


@query("A27", "SELECT season, count(*) AS n, count(total) AS covered, corr(total, points) AS corr, avg(abs(total - points)) AS mae, avg(total - points) AS bias FROM g GROUP BY 1", "corr mae bias")
def projection_agreement(spark, sf):
    return A.agreement(games(spark, sf), "total", "points", ["season"])


@query("A28", "WITH m AS (SELECT team, avg(margin) AS m FROM g GROUP BY 1) SELECT var_pop(m.m) / var_pop(margin) AS r2, count(DISTINCT team) AS groups FROM g JOIN m USING (team)", "r2")
def group_variance(spark, sf):
    return A.group_share(games(spark, sf), "team", "margin")


_SEASONS = range(1995, 2002)


@query("A29", f"SELECT CAST(floor(p * 4) AS INT) AS pb, {', '.join(f'avg(CASE WHEN season = {s} THEN margin END) AS "{s}"' for s in _SEASONS)} FROM g GROUP BY 1", " ".join(f'"{s}"' for s in _SEASONS))
def band_matrix(spark, sf):
    """A column for each season of the table; the SQL names those that the driver's tables have."""
    g = games(spark, sf).withColumn("pb", F.floor(F.col("p") * 4).cast("int"))
    seasons = [r["season"] for r in g.select("season").distinct().orderBy("season").collect()]
    return A.matrix(g, "pb", "season", seasons, "margin")


@query("A30 A32", f"SELECT book, count(*) AS n, avg(u) AS roi, avg(q * d - 1) AS roi_null, avg(u - (q * d - 1)) AS gain, stddev_samp(u - (q * d - 1)) / sqrt(count(u - (q * d - 1))) AS gain_se FROM (SELECT book, {UNITS} AS u, {QSQL} AS q, {_DEC.format('home_ml')} AS d FROM g) t WHERE u IS NOT NULL GROUP BY 1", "roi roi_null gain gain_se")
def cell_returns(spark, sf):
    return A.cell_roi(priced(spark, sf), ["book"], "home_ml", "home_won", "q")


@query("A33", f"""WITH l AS (SELECT 'model' AS source, greatest(p, 1 - p) AS c, (CAST(p >= 0.5 AS INT) = won) AS ok FROM (SELECT *, {QSQL} AS q FROM g) a WHERE q IS NOT NULL UNION ALL SELECT 'market', greatest(q, 1 - q), (CAST(q >= 0.5 AS INT) = won) FROM (SELECT *, {QSQL} AS q FROM g) a WHERE q IS NOT NULL)
    SELECT source, CAST(CASE WHEN c >= 0.5 AND c < 0.6 THEN 0 WHEN c >= 0.6 AND c < 0.75 THEN 1 WHEN c >= 0.75 AND c <= 1 THEN 2 END AS INT) AS band, count(*) AS n, avg(c) AS confidence, avg(CAST(ok AS DOUBLE)) AS rate FROM l GROUP BY 1, 2""", "confidence rate")
def confidence_bands(spark, sf):
    return A.confidence_bands(priced(spark, sf), "p", "q", "won", [0.5, 0.6, 0.75, 1.0])


@query("A34", """WITH k AS (SELECT home_ml AS price_at, count(*) AS n, sum(won) AS s FROM g GROUP BY 1), w AS (SELECT a.price_at, ww, sum(b.n) AS n, sum(b.s) AS s FROM k a JOIN (SELECT unnest([2e0, 3e0, 4.5e0, 6e0]) AS ww) x ON true JOIN k b ON abs(b.price_at - a.price_at) <= ww GROUP BY 1, 2)
    SELECT price_at, CAST(n AS BIGINT) AS n, ww AS width, CASE WHEN n >= 10 THEN s / n END AS rate FROM (SELECT *, row_number() OVER (PARTITION BY price_at ORDER BY CASE WHEN n >= 60 THEN 0 ELSE 1 END, CASE WHEN n >= 60 THEN ww ELSE -ww END) AS i FROM w) y WHERE i = 1""", "price_at width rate")
def price_windows(spark, sf):
    g = games(spark, sf)
    return A.price_window(g.select(F.col("home_ml").alias("price_at")).distinct(), g, "price_at", "home_ml", "won", 2.0, 6.0)


@query("A38", "WITH c AS (SELECT quantile_cont(amount, 1 / 3) AS a, quantile_cont(amount, 2 / 3) AS b FROM g) SELECT CAST(CAST(amount > a AS INT) + CAST(amount > b AS INT) AS INT) AS \"group\", count(*) AS n, avg(amount) AS x, avg(margin) AS value FROM g, c GROUP BY 1", "x value")
def quantile_groups(spark, sf):
    return A.quantile_groups(games(spark, sf), "amount", 3, "margin")


@query("A39", f"""SELECT t AS threshold, count(*) AS n, avg(edge) AS claimed, avg(units) AS roi, stddev_samp(units) / sqrt(count(units)) AS roi_se FROM (SELECT p - {QSQL} AS edge, {UNITS} AS units FROM g) a JOIN (SELECT unnest([0e0, 0.05e0, 0.1e0]) AS t) b ON edge >= t GROUP BY 1""", "threshold claimed roi roi_se")
def edge_ladder(spark, sf):
    return A.edge_ladder(priced(spark, sf).withColumn("edge", F.col("p") - F.col("q")), "edge", [0.0, 0.05, 0.1], "home_ml", "home_won", "q")


@query("A12", "SELECT count(*) FILTER (l) AS locked, count(*) FILTER (NOT l AND game_id % 300 < 200) AS missed, count(*) FILTER (l AND game_id % 11 = 0) AS void, median(CASE WHEN l THEN 900 + game_id % 300 - 400 END) AS median_lead, count(*) FILTER (l AND season >= 1995 AND won = 1) AS family_locked, count(*) FILTER (l AND season >= 1995 AND won = 0) AS off_family FROM (SELECT *, game_id % 5 <> 0 AS l FROM g) t", "median_lead")
def lock_coverage(spark, sf):
    c = F.col
    g = games(spark, sf).withColumns({"tip": 900 + c("game_id") % 300, "lock": F.when(c("game_id") % 5 != 0, 400), "void": c("game_id") % 11 == 0})
    return A.lock_coverage(g, "lock", "tip", "void", F.lit(1099), c("season") >= 1995, c("won") == 1)


@query("A36", "WITH l AS (SELECT unnest(['a', 'b']) AS feature, unnest([p * 2e0, margin * 0.5e0]) AS v, won FROM g) SELECT feature, avg(v) FILTER (won = 1) AS in_wins, avg(v) FILTER (won = 0) AS in_losses, avg(v) FILTER (won = 1) - avg(v) FILTER (won = 0) AS gap, sqrt(var_samp(v) FILTER (won = 1) / count(v) FILTER (won = 1) + var_samp(v) FILTER (won = 0) / count(v) FILTER (won = 0)) AS gap_se FROM l GROUP BY 1", "in_wins in_losses gap gap_se")
def contribution_gaps(spark, sf):
    c = F.col
    g = games(spark, sf).withColumn("x", E.contributions(F.array("p", "margin"), F.array(F.lit(2.0), F.lit(0.5))))
    return A.contribution_gap(g, ["a", "b"], "x", "won")


@query("A41", "SELECT season AS at, count(*) AS n, avg(p) AS forecast, avg(CAST(won AS DOUBLE)) AS rate FROM g WHERE margin > 0 AND spread > 0 GROUP BY 1", "forecast rate")
def leading_underdogs(spark, sf):
    return A.leader_calibration(games(spark, sf).withColumn("dog", F.col("spread") > 0), "p", "won", "margin", "dog", "season").withColumnRenamed("season", "at")
