"""Hand-worked values of formulas, and long keys, late reports and separated fits."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from sibyl.functions import features as E
from sibyl.functions import prices as P
from sibyl.operators import causal as W
from sibyl.operators import fit as M
from sibyl.operators import joins as J
from sibyl.operators import scope as K

OWN = {"fgm": 40, "fga": 85, "tpm": 10, "tpa": 30, "ftm": 15, "fta": 20, "orb": 10, "drb": 33, "tov": 12}
OPP = {"fgm": 38, "fga": 88, "tpm": 12, "tpa": 36, "ftm": 17, "fta": 22, "orb": 8, "drb": 30, "tov": 14}


def side(totals):
    return F.struct(*(F.lit(float(v)).alias(k) for k, v in totals.items()))


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_possessions_and_factors(spark):
    own = 85 + 0.4 * 20 - 1.07 * 10 / (10 + 30) * (85 - 40) + 12
    opp = 88 + 0.4 * 22 - 1.07 * 8 / (8 + 33) * (88 - 38) + 14
    assert one(spark, E.possessions(side(OWN), side(OPP))) == pytest.approx(own)
    p = (own + opp) / 2
    want = [100 * 45 / 85, -100 * 12 / p, 100 * 10 / p, 100 * 20 / 85, -100 * 44 / 88, 100 * 14 / p, -100 * 8 / p, -100 * 22 / 88]
    assert one(spark, E.eight_factors(side(OWN), side(OPP))) == pytest.approx(want)
    share = one(spark, E.eight_factors(side(OWN), side(OPP), True))
    assert (share[2], share[6]) == pytest.approx((100 * 10 / 40, -100 * 8 / 41))


def test_luck_is_what_the_opponents_threes_add(spark):
    weights = F.array(*(F.lit(x) for x in (0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0)))
    # at a third of 36 attempts the opponents make the 12 they made
    assert one(spark, E.luck(side(OWN), side(OPP), F.lit(1 / 3), weights)) == pytest.approx(0)
    assert one(spark, E.luck(side(OWN), side(OPP), F.lit(0.25), weights)) == pytest.approx(100 * 1.5 * 3 / 88)


def test_midpoints(spark):
    x = lambda *v: [F.lit(y).cast("double") for y in v]
    assert one(spark, P.mid_q(*x(0.18, 0.76, 0.24, 0.82))) == pytest.approx(0.47 / (0.47 + 0.53))
    assert one(spark, P.mid_q(*x(None, 0.76, 0.24, 0.82))) is None
    cost = lambda a: a + 0.07 * a * (1 - a)
    assert one(spark, P.quoted_q(*x(None, 0.76, 0.24, 0.82))) == pytest.approx(cost(0.76) / (cost(0.76) + cost(0.82)))
    assert one(spark, P.quoted_q(*x(0.5, None, 0.24, 0.82))) is None


def test_pending_and_covered(spark):
    rows = [("a", "2024-01-01", None, 1.0, 1.0), ("b", "2024-01-10", None, None, None), ("c", "2024-01-10", 1, None, 1.0), ("d", "2024-01-03", 1, 1.0, None), ("e", "2024-01-09", 0, 1.0, None), ("f", "2024-01-09", 0, 1.0, 1.0), ("g", "2024-01-02", 0, None, None)]
    df = spark.createDataFrame(rows, "id string, slate string, won int, close_home_ml double, close_away_ml double").withColumn("slate", F.to_date("slate"))
    assert {(r["id"], r["why"]) for r in K.pending(df, "2024-01-10").collect()} == {("a", "result"), ("d", "close"), ("e", "close")}
    games = spark.createDataFrame([(1, 1, "B", "A"), (2, 1, "D", "C"), (3, 1, "F", "E"), (4, 1, "H", "G"), (5, 2, "B", "A")], "game long, slate long, home string, away string")
    report = [(1, "A", "Out", "A", "B"), (1, "C", "Out", None, None), (1, "D", "Out", None, None), (1, "E", "Out", None, None), (1, "G", "PENDING", "G", "H"), (1, None, "Out", "X", "Y")]
    rows = spark.createDataFrame(report, "slate long, team string, status string, away string, home string")
    assert sorted(r["game"] for r in K.covered(games, rows).collect()) == [1, 2]


def test_a_tie_at_the_end_goes_to_overtime(spark):
    t = 300 / 2880
    phi = lambda z: 0.5 * math.erfc(-z / math.sqrt(2))
    coefs = (F.array(F.lit(0.1), F.lit(0.1)), F.array(F.lit(0.2), F.lit(0.2)))
    chance = lambda lead, left: one(spark, E.live_win(F.lit(lead), F.lit(5.0), F.lit(left), [0.0, 1.0], *coefs))
    assert (chance(3.0, 0.0), chance(-3.0, 0.0)) == (1.0, 0.0)
    assert chance(0.0, 0.0) == pytest.approx(phi(0.2 * 5 * math.sqrt(t)))
    assert chance(4.0, 0.25) == pytest.approx(phi(0.1 * 4 / 0.5 + 0.2 * 5 * 0.5))


@pytest.mark.parametrize("half_life", [8.0, 0.4])
def test_decay_of_a_long_key(spark, half_life):
    n = 20_000
    df = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("o"), (F.col("id") % 7 - 3).cast("double").alias("x")).withColumn("x", F.when(F.col("o") % 11 > 0, F.col("x")))
    got = {r["o"]: (r["x_decayed"], r["x_decayed_weight"]) for r in W.decayed(df, ["k"], ["o"], ["x"], half_life).collect()}
    total = weight = 0.0
    for i in range(n):
        assert got[i] == pytest.approx((total, weight), rel=1e-9, abs=1e-12)
        known = i % 11 > 0
        total, weight = 0.5 ** (1 / half_life) * total + (i % 7 - 3 if known else 0), 0.5 ** (1 / half_life) * weight + known


def test_drift_of_a_long_season(spark):
    n = 200_000
    df = spark.range(n).select(F.lit(1).alias("season"), F.floor(F.col("id") / 50).cast("int").alias("day"), "id", F.lit(2.0).alias("res"))
    got = W.drift(df, "day", ["id"], "res", 150.0, key=["season"])
    last = got.where("day = 3999").first()["drift"]
    weight = sum(0.5 ** (j / 150) for j in range(600))
    assert last == pytest.approx(2 * weight / (weight + 50))
    assert got.where("drift is null or isnan(drift)").count() == 0 and got.where("day = 0").first()["drift"] == 0


def test_slopes_and_separation(spark):
    rows = [(i / 400, int((i * 7919) % 400 < i)) for i in range(1, 400)]
    fit = M.calibration_slope(spark.createDataFrame(rows, "p double, y int"), "p", "y")
    assert fit[0] == pytest.approx(1, abs=3 * fit[1])
    assert M.calibration_slope(spark.createDataFrame([(p, int(p > 0.5)) for p, _ in rows], "p double, y int"), "p", "y") is None
    assert M.calibration_slope(spark.createDataFrame([(p, 1) for p, _ in rows], "p double, y int"), "p", "y") is None


def test_minutes_of_missing_players(spark):
    present = spark.createDataFrame([("t", 1, 20.0, 1.0), ("t", 2, 30.0, 2.0), ("t", 3, 10.0, None), ("u", 4, 12.0, 5.0)], "team string, id long, m double, pos double")
    missing = spark.createDataFrame([("t", 9, 24.0, 1.0), ("u", 8, 6.0, 1.0)], "team string, id long, m double, pos double")
    got = {r["id"]: r["extra"] for r in J.positional_fill(missing, present, ["team"], "pos", "m").collect()}
    weight = 20 + 15 + 5
    assert got == pytest.approx({1: 24 * 20 / weight, 2: 24 * 15 / weight, 3: 24 * 5 / weight, 4: 6.0})
