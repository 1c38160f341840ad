"""Queries of roster changes, grids of report inputs, pace arms, rule sets, rescored locks, forward scores, backtests and comebacks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.normal import norm_cdf, norm_cdf_sql
from ..operators import causal as W
from ..operators import fit as M
from ..operators import measure as A
from ..operators import rosters as R
from ..operators import rules as C
from ..streaming import snapshots as X
from .driver import games, query, table, ticks
from .prices import _DEC, CQ, QSQL, UNITS, priced

_LINES = "n AS (SELECT *, CAST(year(l_shipdate) AS INT) AS season, l_partkey % 7 AS team, CAST(date_diff('day', DATE '1970-01-01', l_shipdate::DATE) AS INT) AS day, l_suppkey AS player FROM lineitem), li AS (SELECT *, team || ':' || day AS game FROM n)"


@query("J27 J16", f"""WITH {_LINES}, b AS (SELECT * FROM li WHERE l_quantity > 4), a AS (SELECT DISTINCT season, team, game, day FROM li), gm AS (SELECT *, lag(game) OVER (PARTITION BY season, team ORDER BY day, game) AS prev FROM a),
    st AS (SELECT team || ':' || (day + l_linenumber % 3) AS game, player, max(CASE l_returnflag WHEN 'A' THEN 'Out' WHEN 'R' THEN 'Questionable' ELSE 'Probable' END) AS status FROM n GROUP BY 1, 2),
    w AS (SELECT player, day, avg(l_discount * 100) AS value FROM n GROUP BY 1, 2), ap AS (SELECT season, player, day, arg_max(team, game) AS team FROM b GROUP BY 1, 2, 3), pl AS (SELECT DISTINCT season, team, player FROM b), bx AS (SELECT DISTINCT game, player FROM b),
    c AS (SELECT gm.season, gm.team, gm.game, gm.day, gm.prev, pl.player FROM gm JOIN pl USING (season, team)), l AS (SELECT c.*, ap.team AS last_team FROM c ASOF LEFT JOIN ap ON c.season = ap.season AND c.player = ap.player AND c.day > ap.day),
    r AS (SELECT l.*, bx.player IS NOT NULL AS was_on, st.status FROM l LEFT JOIN bx ON bx.game = l.prev AND bx.player = l.player LEFT JOIN st ON st.game = l.game AND st.player = l.player),
    k AS (SELECT * FROM r WHERE (was_on AND status = 'Out') OR (NOT was_on AND last_team = team AND coalesce(status <> 'Out', true))), v AS (SELECT k.*, coalesce(w.value, 0) AS value FROM k ASOF LEFT JOIN w ON k.player = w.player AND k.day > w.day)
    SELECT gm.season, gm.team, gm.game, gm.day, coalesce(sum(value) FILTER (was_on), 0) AS newly_out, coalesce(sum(value) FILTER (NOT was_on), 0) AS back, coalesce(sum(value) FILTER (NOT was_on AND status IS NOT NULL), 0) AS back_listed FROM gm LEFT JOIN v USING (season, game) GROUP BY 1, 2, 3, 4""", "newly_out back back_listed")
def roster_changes(spark, sf):
    """Parts fall into seven teams, their ship days are games, suppliers the players."""
    c = F.col
    li = table(spark, sf, "lineitem").select("*", F.year("l_shipdate").alias("season"), (c("l_partkey") % 7).alias("team"), F.datediff("l_shipdate", F.lit("1970-01-01").cast("date")).alias("day"), c("l_suppkey").alias("player"))
    game = lambda day: F.concat_ws(":", c("team").cast("string"), day.cast("string"))
    names = ["Out", "Probable", "Questionable"]  # in their order, so that the greatest name is that of the greatest number
    status = F.when(c("l_returnflag") == "A", 1).when(c("l_returnflag") == "R", 3).otherwise(2)
    box = li.select("season", game(c("day")).alias("game"), "day", "team", "player", F.greatest(c("l_quantity") - 4, F.lit(0.0)).alias("minutes"))
    statuses = li.groupBy(game(c("day") + c("l_linenumber") % 3).alias("game"), "player").agg(F.element_at(F.array(*map(F.lit, names)), F.max(status)).alias("status"))
    worths = li.groupBy("player", "day").agg(F.avg(c("l_discount") * 100).alias("value"))
    return R.roster_changes(box, statuses, worths).withColumnsRenamed({"returning": "back", "returning_listed": "back_listed"})


_LEADS = (1800, 18000)
_ARMS = (R.Arm("fixed", "fixed", "fixed", 1800), R.Arm("rates", "fixed", "rates", 1800), R.Arm("fixed here", "fixed", "fixed"), R.Arm("rates here", "rates", "rates"))
_TERM = {"fixed": "f", "rates": "r"}


def _cells() -> str:
    return " UNION ALL ".join(
        f"SELECT a.season, a.day, a.margin, a.lead, '{arm.name}' AS arm, {'b' if arm.fit_lead else 'a'}.{_TERM[arm.fit_rule]} AS x, a.{_TERM[arm.score_rule]} AS z FROM t a JOIN t b ON b.game = a.game AND b.lead = {_LEADS[0]}" for arm in _ARMS
    )


@query("B21 A15", f"""WITH m AS (SELECT g.season, g.day, l_orderkey AS game, l_linenumber AS player, l_linenumber % 2 = 1 AS home, CAST(g.day AS BIGINT) * 86400 + 72000 AS tip, CAST(l_quantity AS DOUBLE) AS value, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS played, l_partkey, l_suppkey, l_returnflag, margin FROM lineitem JOIN g ON game_id = l_orderkey),
    rp AS (SELECT game, player, tip - (l_partkey % 20) * 1800 AS ts, CASE l_returnflag WHEN 'A' THEN 'Out' WHEN 'R' THEN 'Questionable' ELSE 'Probable' END AS status FROM m UNION ALL SELECT game, player, tip - (l_suppkey % 10) * 3600, CASE WHEN l_partkey % 2 = 0 THEN 'Doubtful' ELSE 'Questionable' END FROM m),
    ld AS (SELECT m.*, lead FROM m, (SELECT unnest([{', '.join(map(str, _LEADS))}]) AS lead) q), lr AS (SELECT game, player, lead, arg_max(rp.status, struct_pack(a := ts, b := rp.status)) AS status FROM ld JOIN rp USING (game, player) WHERE ts <= tip - lead GROUP BY 1, 2, 3), li AS (SELECT ld.*, status FROM ld LEFT JOIN lr USING (game, player, lead)),
    n AS (SELECT season, lead, status, count(*) AS n, sum(played) AS k FROM li WHERE status IS NOT NULL GROUP BY 1, 2, 3), ch AS (SELECT season, lead, status, sum(k) OVER o / sum(n) OVER o AS chance FROM n WINDOW o AS (PARTITION BY lead, status ORDER BY season RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    pc AS (SELECT li.*, CASE status WHEN 'Out' THEN 0e0 WHEN 'Doubtful' THEN 0.25e0 WHEN 'Questionable' THEN 0.5e0 WHEN 'Probable' THEN 0.9e0 ELSE 1e0 END AS fx, chance FROM li LEFT JOIN ch USING (season, lead, status)),
    t AS (SELECT season, day, game, lead, any_value(margin) AS margin, sum(CASE WHEN home THEN value ELSE -value END * CASE WHEN fx < 0.5 THEN 1 ELSE 0 END) AS f, sum(CASE WHEN home THEN value ELSE -value END * (1 - coalesce(chance, fx))) AS r FROM pc GROUP BY 1, 2, 3, 4), c AS ({_cells()}),
    d AS (SELECT lead, arm, day, count(*) AS n, sum(x) AS sx, sum(margin) AS sy, sum(x * x) AS sxx, sum(x * margin) AS sxy FROM c GROUP BY 1, 2, 3), p AS (SELECT lead, arm, day, {', '.join(f'sum({s}) OVER o AS {s}' for s in ('n', 'sx', 'sy', 'sxx', 'sxy'))} FROM d WINDOW o AS (PARTITION BY lead, arm ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    f AS (SELECT *, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS slope FROM p WHERE n >= 30), er AS (SELECT season, c.lead, arm, margin - slope * z - (sy - slope * sx) / n AS e FROM c JOIN f USING (lead, arm, day)), s AS (SELECT season, lead, arm, count(*) AS n, avg(e * e) AS mse FROM er GROUP BY 1, 2, 3)
    SELECT season, lead, arm, n, sqrt(mse) AS rmse, mse - max(mse) FILTER (arm = 'fixed') OVER (PARTITION BY season, lead) AS added FROM s""", "rmse added")
def report_grid(spark, sf):
    """Orders are games, their lines the players, with two reports each."""
    c = F.col
    g = games(spark, sf)
    li = table(spark, sf, "lineitem").join(g.select(c("game_id").alias("l_orderkey"), "season", "day"), "l_orderkey").withColumn("tip", c("day").cast("long") * 86400 + 72000)
    members = li.select("season", "day", c("l_orderkey").alias("game"), c("l_linenumber").alias("player"), (c("l_linenumber") % 2 == 1).alias("home"), "tip", c("l_quantity").cast("double").alias("value"), (c("l_linestatus") == "O").alias("played"))
    one = F.when(c("l_returnflag") == "A", "Out").when(c("l_returnflag") == "R", "Questionable").otherwise("Probable")
    two = F.when(c("l_partkey") % 2 == 0, "Doubtful").otherwise("Questionable")
    report = lambda ts, s: F.struct(ts.alias("ts"), s.alias("status"))
    reports = li.select(c("l_orderkey").alias("game"), c("l_linenumber").alias("player"), F.inline(F.array(report(c("tip") - (c("l_partkey") % 20) * 1800, one), report(c("tip") - (c("l_suppkey") % 10) * 3600, two))))
    return R.report_grid(members, reports, g.select(c("game_id").alias("game"), "margin"), _LEADS, _ARMS)


_GRID = [x / 2 for x in range(-12, 13)]
_PACE = "(SELECT season, -spread AS m, ln(total / 225) AS lp, 13.5e0 AS sd, margin AS y, won FROM g)"


def _pace_loss(m: str, sd: str) -> str:
    p = norm_cdf_sql("z")
    return f"-ln(CASE WHEN won = 1 THEN q ELSE 1 - q END) AS loss FROM (SELECT *, greatest(1e-6, least(1 - 1e-6, {p})) AS q FROM (SELECT *, ({m}) / ({sd}) AS z FROM"


@query("M21", f"""WITH r AS {_PACE}, per AS (SELECT season, sum(m * lp * (y - m)) AS a, sum(m * lp * m * lp) AS b FROM r GROUP BY 1), k AS (SELECT season AS test, sum(a) OVER w / sum(b) OVER w AS k FROM per WINDOW w AS (ORDER BY season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    l AS (SELECT test, k, s, avg(loss) AS loss FROM (SELECT test, k, s, {_pace_loss('m * (1 + k * lp)', 'sd * exp(s * lp)')} r JOIN k ON season < test, (SELECT unnest([{', '.join(f'{v}e0' for v in _GRID)}]) AS s) gr) a) b) c GROUP BY 1, 2, 3), best AS (SELECT test, k, arg_min(s, struct_pack(a := loss, b := s)) AS s FROM l GROUP BY 1, 2),
    arm AS (SELECT test, k AS fit_k, s AS fit_s, unnest(['base', 'margin', 'both', 'fixed']) AS arm, unnest([0e0, k, k, 1e0]) AS k, unnest([0e0, 0e0, s, 0.5e0]) AS s FROM best),
    x AS (SELECT season, arm, fit_k, fit_s, loss, (q - won) * (q - won) AS brier, (y - m * (1 + k * lp)) * (y - m * (1 + k * lp)) AS mse FROM (SELECT *, {_pace_loss('m * (1 + k * lp)', 'sd * exp(s * lp)')} r JOIN arm ON season = test) a) b) c), z AS (SELECT season, arm, fit_k, fit_s, count(*) AS n, avg(loss) AS loss, avg(brier) AS brier, avg(mse) AS mse FROM x GROUP BY 1, 2, 3, 4)
    SELECT season, arm, n, fit_k AS k, fit_s AS s, loss - max(loss) FILTER (arm = 'base') OVER o AS loss, brier - max(brier) FILTER (arm = 'base') OVER o AS brier, mse - max(mse) FILTER (arm = 'base') OVER o AS mse FROM z WINDOW o AS (PARTITION BY season)""", "k s loss brier mse")
def pace_arms(spark, sf):
    g = games(spark, sf).withColumns({"m": -F.col("spread"), "lp": F.ln(F.col("total") / 225), "sd": F.lit(13.5)})
    return M.pace_arms(g, "season", "m", "lp", "sd", "margin", "won", _GRID)


_HOUR = "INTERVAL 1 HOUR"
_LEDGER = """l AS (SELECT game_id AS id, TIMESTAMP '1970-01-01 20:00:00' + to_days(day) AS tip, CASE WHEN game_id % 7 > 0 THEN strftime(TIMESTAMP '1970-01-01 20:00:00' + to_days(day) - to_hours(CAST(game_id % 13 AS INT)), '%Y-%m-%d %H:%M:%S') END AS first_at,
    CASE WHEN game_id % 5 = 0 THEN 'soon' WHEN game_id % 5 < 4 THEN strftime(TIMESTAMP '1970-01-01 20:00:00' + to_days(day) - to_hours(CAST(game_id % 8 AS INT)), '%Y-%m-%d %H:%M:%S') END AS lock_at, book AS lock_book, CASE WHEN u < 500 THEN book END AS close_book, CASE WHEN won = 1 OR u < 300 THEN q END AS close_q, spread AS close_spread, CASE WHEN game_id % 11 > 0 THEN won END AS home_won, p, p AS lock_p, margin FROM (SELECT *, (game_id * 7 + team * 3) % 900 AS u, """ + QSQL + """ AS q FROM g) x),
    t AS (SELECT *, try_cast(first_at AS TIMESTAMP) AS f, try_cast(lock_at AS TIMESTAMP) AS k FROM l)"""
_KNOWN = ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")
_IN = ", ".join(f"'{b}'" for b in _KNOWN)
_RULES = {
    "first_at before the tip": "first_at IS NOT NULL AND NOT coalesce(f < tip, false)",
    "lock_at before the tip": "lock_at IS NOT NULL AND NOT coalesce(k < tip, false)",
    "lock after first": "lock_at IS NOT NULL AND NOT coalesce(k >= f, false)",
    "lock in its window": "lock_at IS NOT NULL AND NOT coalesce(k >= tip - INTERVAL 301 MINUTES, false)",
    "close_book known": f"close_q IS NOT NULL AND NOT coalesce(close_book IN ({_IN}), false)",
    "lock_book known": f"lock_at IS NOT NULL AND NOT coalesce(lock_book IN ({_IN}), false)",
    "close_spread beside its moneyline": "close_spread IS NOT NULL AND close_q IS NULL",
    "home_won 0 or 1": "home_won NOT IN (0, 1)",
    "p in 0..1": "NOT p BETWEEN 0 AND 1",
    "lock_p beside its lock": "lock_at IS NOT NULL AND NOT coalesce(lock_p BETWEEN 0 AND 1, false)",
    "margin in range": "abs(margin) > 15",
    "margin and p agree": "margin <> 0 AND (margin > 0) <> (p > 0.5)",
}


def _ledger(spark, sf):
    c = F.col
    g = priced(spark, sf).withColumns({"u": (c("game_id") * 7 + c("team") * 3) % 900, "tip_s": c("day").cast("long") * 86400 + 72000})
    before = lambda hours: F.date_format(F.timestamp_seconds(c("tip_s") - hours * 3600), "yyyy-MM-dd HH:mm:ss")
    return g.select(
        c("game_id").alias("id"), F.timestamp_seconds("tip_s").alias("tip"), F.when(c("game_id") % 7 > 0, before(c("game_id") % 13)).alias("first_at"),
        F.when(c("game_id") % 5 == 0, "soon").when(c("game_id") % 5 < 4, before(c("game_id") % 8)).alias("lock_at"), c("book").alias("lock_book"), F.when(c("u") < 500, c("book")).alias("close_book"),
        F.when((c("won") == 1) | (c("u") < 300), c("q")).alias("close_q"), c("spread").alias("close_spread"), F.when(c("game_id") % 11 > 0, c("won")).alias("home_won"), "p", c("p").alias("lock_p"), "margin",
    )


@query("C01", f"WITH {_LEDGER} " + " UNION ALL ".join(f"SELECT CAST(id AS VARCHAR) AS key, '{n}' AS rule FROM t WHERE {w}" for n, w in _RULES.items()))
def ledger_rules(spark, sf):
    return C.ledger_violations(_ledger(spark, sf), "id", _KNOWN, widest=15.0)


_TOTALS = """l AS (SELECT game_id AS id, TIMESTAMP '1970-01-01 20:00:00' + to_days(day) AS tip, CASE WHEN game_id % 7 > 0 THEN TIMESTAMP '1970-01-01 20:00:00' + to_days(day) - to_hours(CAST(game_id % 13 AS INT)) END AS f, CASE WHEN game_id % 5 < 4 THEN TIMESTAMP '1970-01-01 20:00:00' + to_days(day) - to_hours(CAST(game_id % 8 AS INT)) END AS k, book, p * 1.05e0 AS p_over, CASE WHEN won = 1 OR margin > 0 THEN total END AS total, points AS line,
    home_ml AS over, away_ml AS under, CASE WHEN margin > -10 THEN won END AS home_won, points AS close_line FROM g)"""


def _totals_rules():
    for s, at in (("first", "f"), ("lock", "k")):
        yield f"{s}_ou_at before the tip", f"{at} IS NOT NULL AND NOT {at} < tip"
        yield f"{s}_ou_book known", f"{at} IS NOT NULL AND book NOT IN ({_IN})"
        yield f"{s}_ou_p_over with total and line", f"{at} IS NOT NULL AND (NOT p_over BETWEEN 0 AND 1 OR total IS NULL OR line IS NULL)"
        yield f"{s}_ou_line is the main line", f"{at} IS NOT NULL AND NOT coalesce(over BETWEEN -135 AND 115 AND under BETWEEN -135 AND 115, false)"
    yield "lock_ou in its window", "k IS NOT NULL AND k < tip - INTERVAL 301 MINUTES"
    yield "lock_ou after first_ou", "k IS NOT NULL AND NOT coalesce(k >= f, false)"
    yield "close_line with a result", "home_won IS NULL"


@query("C02", f"WITH {_TOTALS} " + " UNION ALL ".join(f"SELECT CAST(id AS VARCHAR) AS key, '{n}' AS rule FROM l WHERE {w}" for n, w in _totals_rules()))
def totals_rules(spark, sf):
    c = F.col
    g = games(spark, sf).withColumn("tip_s", c("day").cast("long") * 86400 + 72000)
    at = {"first": F.when(c("game_id") % 7 > 0, F.timestamp_seconds(c("tip_s") - c("game_id") % 13 * 3600)), "lock": F.when(c("game_id") % 5 < 4, F.timestamp_seconds(c("tip_s") - c("game_id") % 8 * 3600))}
    slot = lambda s: [x.alias(f"{s}_ou_{n}") for n, x in {"at": at[s], "book": c("book"), "p_over": c("p") * 1.05, "total": F.when((c("won") == 1) | (c("margin") > 0), c("total")), "line": c("points"), "over": c("home_ml"), "under": c("away_ml")}.items()]
    t = g.select(c("game_id").alias("id"), F.timestamp_seconds("tip_s").alias("tip"), *slot("first"), *slot("lock"), F.when(c("margin") > -10, c("won")).alias("home_won"), c("points").alias("close_line"))
    return C.totals_violations(t, "id", _KNOWN)


@query("C04", """WITH s AS (SELECT CAST(slate AS VARCHAR) AS slate, team AS player, CASE game_id % 6 WHEN 0 THEN 'PG' WHEN 1 THEN 'SG' WHEN 2 THEN 'SF' WHEN 3 THEN 'PF' WHEN 4 THEN 'C' ELSE 'G' END AS position, CASE WHEN game_id % 9 = 0 THEN 'free' ELSE CAST(CAST(margin AS BIGINT) AS VARCHAR) END AS salary, points / 2 AS cap, CASE WHEN game_id % 8 = 0 THEN 'late' ELSE CAST(slate AS VARCHAR) END AS start_at FROM g), t AS (SELECT *, slate || '|' || player AS key FROM s)
    SELECT key, 'position known' AS rule FROM t WHERE position = 'G' UNION ALL SELECT key, 'salary whole and positive' FROM t WHERE NOT coalesce(try_cast(salary AS DOUBLE) > 0, false) UNION ALL SELECT key, 'cap whole and positive' FROM t WHERE NOT (cap > 0 AND cap % 1 = 0) UNION ALL SELECT key, 'start readable' FROM t WHERE start_at = 'late' UNION ALL SELECT key, 'once a slate' FROM t GROUP BY slate, player, key HAVING count(*) > 1""")
def salary_rules(spark, sf):
    c = F.col
    place = F.element_at(F.array(*map(F.lit, [*C.POSITIONS, "G"])), (c("game_id") % 6 + 1).cast("int"))
    g = games(spark, sf).select(c("slate").cast("string").alias("slate"), c("team").alias("player"), place.alias("position"), F.when(c("game_id") % 9 == 0, "free").otherwise(c("margin").cast("long").cast("string")).alias("salary"), (c("points") / 2).alias("cap"), F.when(c("game_id") % 8 == 0, "late").otherwise(c("slate").cast("string")).alias("start_at"))
    return C.salary_violations(g)


@query("C06", """WITH r AS (SELECT *, TIMESTAMP '1970-01-01 12:00:00' + to_days(day) AS lock_at FROM g WHERE won = 1), n AS (SELECT *, lock_at + to_hours(CAST(game_id % 4 = 0 AS INT)) AS own, CASE WHEN game_id % 3 = 0 THEN 'base_1' ELSE 'base_2' END AS tag FROM r WHERE h > 20)
    SELECT CAST(game_id AS VARCHAR) AS key, 'tag' AS rule FROM r WHERE season = 1995 UNION ALL SELECT CAST(game_id AS VARCHAR), 'share and total' FROM r WHERE margin = 0 UNION ALL SELECT CAST(game_id AS VARCHAR), 'slate' FROM r WHERE slate < DATE '1993-01-01' UNION ALL SELECT CAST(game_id AS VARCHAR), 'report before the lock' FROM r WHERE game_id % 10 < 2
    UNION ALL SELECT CAST(game_id AS VARCHAR), 'at the ledger''s lock' FROM n WHERE tag <> 'base_1' OR own <> lock_at UNION ALL SELECT CAST(game_id AS VARCHAR), 'rest' FROM r WHERE spread NOT BETWEEN 0 AND 6 UNION ALL SELECT CAST(game_id AS VARCHAR), 'in the ledger' FROM r WHERE h <= 20""".replace("FROM g WHERE won", "FROM (SELECT *, (game_id * 31 + team * 17) % 1000 AS h FROM g) g WHERE won"))
def rescore_rules(spark, sf):
    c = F.col
    g = games(spark, sf).where("won = 1").withColumns({"h": (c("game_id") * 31 + c("team") * 17) % 1000, "at": c("day").cast("long") * 86400 + 43200})
    r = g.select("game_id", "slate", F.when(c("season") == 1995, "run_1").otherwise("run_2").alias("tag"), c("p").alias("p_over"), F.when(c("margin") != 0, c("total")).alias("total"), F.timestamp_seconds("at").alias("lock_at"), F.timestamp_seconds(c("at") + 7200 - c("game_id") % 10 * 3600 - 1).alias("report_at"), c("spread").alias("rest"))
    n = g.where("h > 20").select("game_id", F.when(c("game_id") % 3 == 0, "base_1").otherwise("base_2").alias("tag"), F.timestamp_seconds(c("at") + F.when(c("game_id") % 4 == 0, 3600).otherwise(0)).alias("lock_at"))
    return C.rescore_violations(r, n, "game_id", "_2", ["_1"], "1993-01-01", rest_most=6)


@query("X12", f"""WITH l AS (SELECT *, CAST(day AS BIGINT) * 86400 + 54000 AS lock_at FROM g WHERE game_id % 4 > 0 AND game_id % 3 = 1 AND slate >= DATE '1993-01-01' AND won = 0), r AS (SELECT team, CAST(day AS BIGINT) * 86400 + (game_id % 24) * 3600 AS ts, spread AS adjust, game_id AS report FROM g),
    k AS (SELECT l.game_id, l.slate, l.lock_at, l.total, l.points, (SELECT arg_max(struct_pack(ts := ts, adjust := adjust), struct_pack(a := ts, b := adjust, c := report)) FROM r WHERE r.team = l.team AND ts <= l.lock_at) AS x FROM l)
    SELECT game_id, slate, lock_at, x.ts AS report_at, total + coalesce(x.adjust, 0e0) AS total, {norm_cdf_sql('((total + coalesce(x.adjust, 0e0) - points) / 18e0)')} AS p_over FROM k""", "total p_over")
def rescored_pending(spark, sf):
    c = F.col
    g = games(spark, sf)
    led = g.select("game_id", "slate", "team", "total", "points", F.when(c("game_id") % 4 > 0, c("day").cast("long") * 86400 + 54000).alias("lock_at"), F.concat(F.lit("base_"), c("game_id") % 3).alias("tag"))
    reports = g.select("team", (c("day").cast("long") * 86400 + c("game_id") % 24 * 3600).alias("ts"), c("spread").alias("adjust"), c("game_id").alias("report"))
    again = c("total") + F.coalesce("adjust", F.lit(0.0))
    return X.rescored_locks(led, g.where("won = 1"), reports, "game_id", ["team"], "_1", F.lit("1993-01-01").cast("date"), {"total": again, "p_over": norm_cdf((again - c("points")) / 18)})


_PICK = "CASE WHEN {p} * ({h}) - 1 > 0 AND {p} * ({h}) >= coalesce((1 - {p}) * ({a}), -1e300) THEN 'home' WHEN (1 - {p}) * ({a}) - 1 > 0 THEN 'away' END"
_WON = f"CASE side WHEN 'home' THEN CASE WHEN y = 1 THEN ({_DEC.format('home_ml')}) - 1 WHEN y = 0 AND ({_DEC.format('home_ml')}) IS NOT NULL THEN -1 END WHEN 'away' THEN CASE WHEN y = 0 THEN ({_DEC.format('away_ml')}) - 1 WHEN y = 1 AND ({_DEC.format('away_ml')}) IS NOT NULL THEN -1 END END"


@query("X16", f"""WITH j AS (SELECT p, coalesce({QSQL}, 0.5) AS q, home_ml, away_ml, CASE WHEN game_id % 5 > 0 THEN won END AS y FROM g), c AS (SELECT 'model' AS estimator, p AS v, * FROM j UNION ALL SELECT 'market', q, * FROM j), s AS (SELECT estimator, v, y, home_ml, away_ml, CASE WHEN y IS NOT NULL THEN {_PICK.format(p='v', h=_DEC.format('home_ml'), a=_DEC.format('away_ml'))} END AS side FROM c
    UNION ALL SELECT 'favourite', NULL, y, home_ml, away_ml, CASE WHEN y IS NOT NULL THEN CASE WHEN q >= 0.5 THEN 'home' ELSE 'away' END END FROM j), u AS (SELECT *, {_WON} AS units FROM s)
    SELECT estimator, count(*) AS official, count(y) AS graded, count(*) - count(y) AS pending, avg((v - y) * (v - y)) AS brier, avg(-ln(CASE WHEN y = 1 THEN v WHEN y = 0 THEN 1 - v END)) AS loss, avg(CASE WHEN y IS NOT NULL THEN CAST((v >= 0.5) = (y = 1) AS DOUBLE) END) AS accuracy, count(side) AS bets, sum(units) AS units, sum(units) / count(side) AS roi FROM u GROUP BY 1""", "brier loss accuracy units roi")
def forward_score(spark, sf):
    c = F.col
    g = priced(spark, sf)
    log = g.select("game_id", "p", F.coalesce("q", F.lit(0.5)).alias("q"), "home_ml", "away_ml")
    return X.forward_score(log, g.where(c("game_id") % 5 > 0).select("game_id", "won"), "game_id", {"model": "p", "market": "q"}, "won", "home_ml", "away_ml", "q")


@query("A35 J24", f"""WITH b AS (SELECT book AS rule, won, month(slate) <= 6 AS fh, home_ml AS ml, close_home_ml AS cml, {QSQL} AS q, {CQ} AS cq FROM g WHERE p >= 0.5), l AS (SELECT rule, 'all' AS part, won, ml, q FROM b UNION ALL SELECT rule, 'at close', won, cml, cq FROM b WHERE cq IS NOT NULL UNION ALL SELECT rule, CASE WHEN fh THEN 'first' ELSE 'second' END, won, ml, q FROM b),
    u AS (SELECT *, CASE WHEN won = 1 THEN ({_DEC.format('ml')}) - 1 WHEN ({_DEC.format('ml')}) IS NOT NULL THEN -1.0 END AS units, q * ({_DEC.format('ml')}) - 1 AS nul FROM l), m AS (SELECT rule, avg(cq - q) AS clv, stddev_samp(cq - q) / sqrt(count(cq - q)) AS clv_se, avg(CAST(cq > q AS DOUBLE)) AS toward FROM b WHERE cq - q IS NOT NULL GROUP BY 1)
    SELECT s.*, clv, clv_se, toward FROM (SELECT rule, part, count(*) AS n, count(units) AS n_priced, CAST(sum(won) AS BIGINT) AS wins, sum(units) AS units, avg(units) AS roi, avg(nul) AS roi_null, stddev_samp(units) / sqrt(count(units)) AS roi_se, CASE WHEN stddev_samp(units - nul) > 0 THEN avg(units - nul) / (stddev_samp(units - nul) / sqrt(count(units - nul))) END AS z FROM u GROUP BY 1, 2) s LEFT JOIN m ON m.rule = s.rule AND part = 'at close'""", "units roi roi_null roi_se z clv clv_se toward")
def rule_backtest(spark, sf):
    g = priced(spark, sf).where("p >= 0.5").withColumn("rule", F.col("book"))
    return A.backtest(g, "rule", F.month("slate") <= 6, "home_ml", "q", "close_home_ml", "cq", "home_won")


@query("A41", """WITH s AS (SELECT game, day, sec * 1000 + event_id % 1000 AS ts, CAST((event_id * 37) % 1000 AS DOUBLE) / 1000 AS p, CAST((game * 7 + day * 3) % 11 < 4 AS INT) AS won FROM e), o AS (SELECT game, day, arg_min(p, struct_pack(a := ts, b := p)) AS tip, min(struct_pack(a := ts, b := p)) FILTER (p < 0.5) AS low, max(ts) FILTER (p > 0.8) AS high, max(won) AS won FROM s GROUP BY 1, 2),
    x AS (SELECT tip >= 0.5 AS favourite, CAST(least(floor(low.b * 10), 4) AS INT) AS band, low.b AS p0, CAST(coalesce(high > low.a, false) AS DOUBLE) AS back, CAST(won AS DOUBLE) AS won FROM o WHERE low IS NOT NULL)
    SELECT favourite, band, count(*) AS n, avg(p0) AS expected_win, avg(won) AS win, sqrt(avg(won) * (1 - avg(won)) / count(*)) AS win_se, avg(p0 / 0.8e0) AS expected_back, avg(back) AS back, sqrt(avg(back) * (1 - avg(back)) / count(*)) AS back_se FROM x GROUP BY 1, 2""", "expected_win win win_se expected_back back back_se")
def comebacks(spark, sf):
    c = F.col
    t = ticks(spark, sf).select("game", "day", (c("sec") * 1000 + c("event_id") % 1000).alias("at"), ((c("event_id") * 37) % 1000 / 1000).alias("p"), ((c("game") * 7 + c("day") * 3) % 11 < 4).cast("int").alias("won"))
    return A.comebacks(t, ["game", "day"], "at", "p", "won")


@query("W09", """WITH gm AS (SELECT DISTINCT game AS grp, day FROM e), mem AS (SELECT DISTINCT game AS grp, kind AS member FROM e), seen AS (SELECT DISTINCT game AS grp, day, kind AS member FROM e), x AS (SELECT gm.grp, gm.day, member, CASE WHEN seen.member IS NULL THEN 0 ELSE 1 END AS present, row_number() OVER (PARTITION BY gm.grp, member ORDER BY gm.day) AS k FROM gm JOIN mem USING (grp) LEFT JOIN seen USING (grp, day, member)),
    s AS (SELECT a.grp, a.day, a.member, coalesce(sum(b.present * pow(0.5, (a.k - 1 - b.k) / 4e0)) / sum(pow(0.5, (a.k - 1 - b.k) / 4e0)), 0) AS share FROM x a LEFT JOIN x b ON a.grp = b.grp AND a.member = b.member AND b.k < a.k GROUP BY ALL), v AS (SELECT grp, day, sum(share * 2 * (0.5 - share)) AS availability, sum(share * (1 + length(member)) * (0.5 - share)) AS form FROM s GROUP BY 1, 2)
    SELECT grp // 2 AS game, day, CASE WHEN count(*) = 2 THEN sum(availability) END AS total_availability, CASE WHEN count(*) = 2 THEN sum(form) END AS total_form FROM v GROUP BY 1, 2""", "total_availability total_form")
def totals_availability(spark, sf):
    """Two neighbouring users are the sides of a game on days on which both have events."""
    c = F.col
    t = ticks(spark, sf).withColumnsRenamed({"game": "grp", "kind": "member"})
    grid = W.presence_grid(t.select("grp", "day").distinct(), t, ["grp"])
    grid = grid.join(t.select("grp", "day", "member", F.lit(True).alias("hit")).distinct(), ["grp", "day", "member"], "left")
    grid = grid.withColumns({"present": F.coalesce("hit", F.lit(False)), "role": F.lit(2.0), "form_role": 1.0 + F.length("member"), "chance": F.lit(0.5)})
    sides = W.availability(grid, ["grp"], ["day"], 4.0, more={"form": "form_role"}).withColumn("game", F.floor(c("grp") / 2))
    return W.totals_availability(sides, ["game", "day"], ["availability", "form"])
