"""Findings of the third review: steps that grew faster than their input, and values at the edges."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from sibyl import catalog
from sibyl.functions import prices
from sibyl.operators import fit, rosters, rules
from sibyl.sources import feeds

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["power_novig", "shin_novig"])
def test_pairs_are_priced_once(spark, name):
    """the halving is done above the distinct, once a pair, and its plan does not repeat what it is given."""
    lines = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    distinct = next(i for i, line in enumerate(lines) if "Aggregate [" in line)
    count = lambda part: "\n".join(part).count("lambdafunction(")
    assert 1 <= count(lines[: distinct + 1]) <= 6 and count(lines[distinct + 1 :]) == 0


def _events(spark, tmp_path, values):
    rows = spark.createDataFrame([(i, 1, v) for i, v in enumerate(values)], "event_id long, user_id long, value double")
    rows.select("*", F.lit("view").alias("event_type"), F.lit('{"k": 4}').alias("props"), F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'").alias("ts")).write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def test_a_quote_of_zero(spark, tmp_path):
    """0 is a price of the query; of the function only where an empty side is quoted at 0."""
    sf = _events(spark, tmp_path, [0.0, 50.0, 100.0])
    assert {r["event_id"]: r["close"] for r in catalog.QUERIES["candle_feed"](spark, sf).collect()} == {0: 0.0, 1: 0.5, 2: None}
    price = lambda **k: feeds.candle_price(F.create_map(F.lit("close"), F.lit("0")), "close", **k).alias("p")
    assert tuple(spark.range(1).select(price(), price(zero=True)).first()) == (None, 0.0)


def test_moments_of_a_mean_of_zero(spark, tmp_path):
    """the limits of both parameters."""
    sf = _events(spark, tmp_path, [0.0, 1.0])
    mu = {r["event_id"]: r["mu"] for r in catalog.QUERIES["feed_scalars"](spark, sf).collect()}
    assert mu[0] == float("-inf") and mu[1] == pytest.approx(math.log(1 / 0.8) - math.log1p((2 / 0.8 - 1 / 0.64) * 0.64) / 2, abs=1e-6)
    at = lambda m, v: prices.lognormal_moments(F.lit(m).cast("double"), F.lit(v).cast("double"), F.lit(0.8))
    got = spark.range(1).select(*(x.alias(f"c{i}") for i, x in enumerate((*at(0, 1), *at(0, 0), *at(None, 1))))).first()
    assert tuple(got) == (float("-inf"), float("inf"), float("-inf"), 0.0, None, None)


def test_bins_give_their_share_that_played(spark):
    """of every bin, those with few rows too."""
    df = spark.createDataFrame([("a", 0.0, 1.0, 2.0), ("a", 3.0, 1.0, 2.0), ("b", 2.0, 1.0, 2.0)], "bin string, a double, f double, v double")
    assert {r["bin"]: r["play"] for r in fit.shrunk_bins(df, "bin", "a", "f", "v").collect()} == {"a": 0.5, "b": 1.0}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_league_goes_to_the_games(spark):
    """one row a season is broadcast whatever its size is taken for, so that no season is read by one task."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(catalog.QUERIES["win_share_rows"](spark, SF))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_quantiles_of_a_ladder_are_computed_once_a_quote(spark):
    """F8: the sums of the line do not hold the quantile's expression."""
    lines = catalog.QUERIES["ladder_means"](spark, SF)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not [x for x in lines if "regr_intercept" in x and "lambdafunction" in x.split("regr_intercept", 1)[1].split(" AS fit")[0]]


def test_rescored_rows_are_joined_by_their_times_alone(spark):
    """one narrow join; nulls, repeats and locks without a tag as before."""
    t = lambda h: f"2024-01-01 {h:02d}:00:00"
    r = spark.createDataFrame([(1, "a_2", t(5)), (2, "a_2", t(5)), (3, "a_2", t(5)), (4, "a_2", None), (5, "a_2", t(5)), (5, "a_2", t(5)), (None, "a_2", t(5))], "k int, tag string, lock_at string")
    n = spark.createDataFrame([(1, t(5), "x_1"), (2, t(6), "x_1"), (3, t(5), "x_3"), (4, None, None), (None, t(5), "x_1")], "k int, lock_at string, tag string")
    out = rules.rescore_violations(r, n, "k", "_2", ["_1"], "2024-01-01")
    got = sorted((str(x["key"]), x["rule"]) for x in out.collect())
    none, lock = "in the ledger", "at the ledger's lock"
    assert got == sorted([("2", lock), ("3", lock), ("5", none), ("5", none), ("5", "once"), ("None", none), ("", "once")])
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_pace_grid_is_evaluated_for_distinct_rows(spark, monkeypatch):
    """rows that agree in all but the margin are one."""
    kept, stored = [], fit.stored
    monkeypatch.setattr(fit, "stored", lambda df, name: kept.append(stored(df, name)) or kept[-1])
    rows = [(s, m, lp, 10.0, y, won) for s in (1, 2) for m, lp, won in ((3.0, 0.1, 1), (-2.0, -0.2, 0)) for y in (1.0, 4.0, -3.0)]
    df = spark.createDataFrame(rows, "season int, m double, lp double, sd double, y double, won int")
    got = {r["arm"]: r for r in fit.pace_arms(df, "season", "m", "lp", "sd", "y", "won", [0.0, 0.5]).collect()}
    assert kept[0].count() == 4 and {r["n"] for r in got.values()} == {6}
    old = [r for r in rows if r[0] == 1]
    k = sum(m * lp * (y - m) for _, m, lp, _, y, _ in old) / sum((m * lp) ** 2 for _, m, lp, *_ in old)
    mse = lambda k: sum((y - m * (1 + k * lp)) ** 2 for _, m, lp, _, y, _ in old) / 6
    assert got["margin"]["k"] == pytest.approx(k) and got["margin"]["mse"] == pytest.approx(mse(k) - mse(0)) and got["base"]["mse"] == 0


def _moved(spark, make) -> int:
    """Rows that making and running a table shuffles."""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    new = lambda: gateway.jvm.java.util.ArrayList()

    def total():
        stages = store.stageList(new(), False, False, gateway.new_array(gateway.jvm.double, 0), new())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = total()
    make().write.format("noop").mode("overwrite").save()
    return total() - before


def test_games_that_a_player_misses_are_not_moved(spark):
    """50 players with one game each and a team of 300 games."""
    box = spark.range(300).select(F.lit(1).alias("season"), F.col("id").alias("game"), F.col("id").cast("int").alias("day"), F.lit("A").alias("team"), F.when(F.col("id") < 50, F.col("id")).otherwise(999).alias("player"), F.lit(5.0).alias("minutes"))
    statuses = spark.createDataFrame([(80, 3, "Out"), (80, 4, "Questionable"), (80, 5, None), (4, 3, "Out")], "game long, player long, status string")
    worths = spark.createDataFrame([(p, d, v) for p in range(50) for d, v in ((0, None), (0, 2.0), (70, 3.0))] + [(4, None, 50.0)], "player long, day int, value double")
    make = lambda: rosters.roster_changes(box, statuses, worths)
    assert _moved(spark, make) < 3000
    got = make()
    rows = {r["game"]: r[4:] for r in got.collect()}
    worth = lambda d: 3.0 if d > 70 else 2.0 if d else 0.0
    want = {d: (2.0 if d == 4 else 0.0, (max(0, min(d, 50) - (1 if d <= 50 else 0)) - (d == 80)) * worth(d), worth(d) * (d == 80)) for d in range(300)}
    assert rows == want and len(rows) == 300


def test_members_and_reports_are_moved_once(spark):
    """1,000 members and 2,000 reports, whatever the leads and arms; the last report at a lead counts, a later one does not."""
    day = (F.col("id") / 100).cast("int")
    members = spark.range(1000).select((day / 5).cast("int").alias("season"), day.alias("day"), (F.col("id") / 25).cast("long").alias("game"), (F.col("id") % 25).alias("player"), (F.col("id") % 2 == 0).alias("home"), (day * 86400).cast("long").alias("tip"), (F.col("id") % 7).cast("double").alias("value"), (F.col("id") % 3 > 0).alias("played"))
    early = members.select("game", "player", (F.col("tip") - 500).alias("ts"), F.when(F.col("player") % 3 == 0, "Out").otherwise("Questionable").alias("status"))
    late = members.select("game", "player", (F.col("tip") - 100).alias("ts"), F.lit("Out").alias("status"))
    games = spark.range(40).select(F.col("id").alias("game"), (F.col("id") % 5).cast("double").alias("margin"))
    arms = [rosters.Arm("base", "fixed", "fixed"), rosters.Arm("rates", "rates", "rates")]
    make = lambda: rosters.report_grid(members, early.union(late), games, [300, 100, 501], arms, least=4)
    assert _moved(spark, make) < 4000
    got = {(r["season"], r["lead"], r["arm"]): r for r in make().collect()}
    term, margin = {}, lambda g: g % 5
    for i in range(1000):
        gone = lambda lead, p: lead == 100 or (lead == 300 and p % 3 == 0)
        for lead in (100, 300, 501):
            term[lead, i // 25] = term.get((lead, i // 25), 0) + (1 if i % 2 == 0 else -1) * (i % 7) * gone(lead, i % 25)
    for lead in (100, 300):
        errors = []
        for g in range(20, 40):
            past = range(4 * (g // 4))
            mx, my = sum(term[lead, k] for k in past) / len(past), sum(margin(k) for k in past) / len(past)
            slope = sum((term[lead, k] - mx) * (margin(k) - my) for k in past) / sum((term[lead, k] - mx) ** 2 for k in past)
            errors.append((margin(g) - my - slope * (term[lead, g] - mx)) ** 2)
        assert got[1, lead, "base"]["rmse"] == pytest.approx(math.sqrt(sum(errors) / 20)) and got[1, lead, "base"]["n"] == 20
    assert (1, 501, "base") not in got  # no report yet: a constant has no single fit


def test_members_are_the_last_games_of_earlier_days(spark, tmp_path):
    """of a day with many games too, and without moving a row a member."""
    day = F.least(F.col("id"), F.lit(30))
    orders = spark.range(75).select((F.col("id") + 1).alias("o_orderkey"), F.lit(7).cast("long").alias("o_custkey"), F.lit("F").alias("o_orderstatus"), F.lit(1.0).alias("o_totalprice"), F.date_add(F.lit("1995-01-01").cast("date"), day.cast("int")).cast("timestamp_ntz").alias("o_orderdate"), F.lit("1-URGENT").alias("o_orderpriority"))
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    make = lambda: catalog.QUERIES["captured_forecasts"](spark, str(tmp_path))
    assert _moved(spark, make) < 700
    assert {r["game_id"]: r["games"] for r in make().collect()} == {k + 1: min(k, 20) for k in range(1, 31)} | {k + 1: 20 for k in range(31, 75)}
