"""Fits from sums against numpy on the rows, two-sided effects against its least squares, and what a batch may repeat."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sibyl.operators import effects, fit, refits
from sibyl.plans.driver import games
from sibyl.sources import feeds

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    data = []
    for i in range(600):
        a, b, c = rng.normal(size=3)
        day = int(rng.integers(0, 60))
        data.append((i, day // 20, day, float(a), float(b), float(c), float(1 + a - 2 * b + 0.5 * c + rng.normal()) if i % 50 else None))
    return spark.createDataFrame(data, "i int, season int, day int, a double, b double, c double, y double")


def fitted(df, weight=None):
    df = df.dropna()
    x = np.column_stack([df.a, df.b, df.c, np.ones(len(df))])
    w = np.sqrt(np.ones(len(df)) if weight is None else weight.loc[df.index].to_numpy())
    return np.linalg.lstsq(x * w[:, None], df.y.to_numpy() * w, rcond=None)[0]


def test_slate_refits(rows):
    pdf = rows.toPandas()
    got = refits.slate_refits(rows, ["a", "b", "c"], "y", "season", "day", least=30).collect()
    assert len(got) == 60
    for r in got:
        past = pdf[pdf.day < r["day"]]
        assert r["train_rows"] == past.y.notna().sum()
        assert (r["coef"] is None) == (r["train_rows"] < 30)
        if r["coef"]:
            assert np.allclose(r["coef"], fitted(past))


def test_aged_refits_of_many_half_lives(rows):
    pdf = rows.toPandas()
    found = refits.aged_refits(rows, ["a", "b", "c"], "y", "day", [3, 10, 1e9])
    assert str(found._jdf.queryExecution().executedPlan()).count("Scan ExistingRDD") + str(found._jdf.queryExecution().executedPlan()).count("LocalTableScan") == 1
    for r in found.where("weight > 8").collect():
        past = pdf[pdf.day < r["day"]]
        assert np.allclose(r["coef"], fitted(past, 0.5 ** ((r["day"] - past.day) / r["half_life"])), atol=1e-6)


def test_ablation(rows):
    pdf = rows.toPandas().dropna()
    got = {(r["season"], r["features"]): r for r in refits.ablation(rows, ["a", "b", "c"], "y", "season").collect()}
    assert len(got) == 2 * 8
    for (season, names), r in got.items():
        cols = [c for c in names.split(",") if c]
        train, test = pdf[pdf.season < season], pdf[pdf.season == season]
        x = lambda d: np.column_stack([*(d[c] for c in cols), np.ones(len(d))])  # noqa: E731, B023
        e = test.y - x(test) @ np.linalg.lstsq(x(train), train.y, rcond=None)[0]
        assert (r["n"], r["rmse"]) == (len(test), pytest.approx(float(np.sqrt((e * e).mean()))))
        assert r["added"] == pytest.approx(r["rmse"] ** 2 - got[season, "a,b,c"]["rmse"] ** 2)


def test_blocks_without_one_answer(spark):
    df = spark.createDataFrame([(1, float(i), 2.0 * i, float(i)) for i in range(9)], "s int, a double, b double, y double")
    assert refits.solved(refits.packed_sums(df, ["s"], ["a", "b"], "y"), 3).first()["coef"] is None
    assert np.allclose(refits.solved(refits.packed_sums(df, ["s"], ["a"], "y"), 2).first()["coef"], [1, 0])
    assert refits.slate_refits(df.withColumn("d", F.lit(1)).limit(0), ["a"], "y", "s", "d").count() == 0


def test_bootstrap_errors(rows):
    got = {r["term"]: r for r in refits.coefficient_bootstrap(rows, "day", ["a", "b", "c"], "y").collect()}
    assert np.allclose([got[t]["coef"] for t in ("a", "b", "c", "one")], fitted(rows.toPandas()), atol=0.03)
    assert all(0.02 < got[t]["se"] < 0.09 for t in got)


def least_squares(pdf):
    teams = sorted(set(pdf.home) | set(pdf.away))
    x = np.zeros((len(pdf), len(teams)))
    for k, (h, a) in enumerate(zip(pdf.home, pdf.away, strict=True)):
        x[k, teams.index(h)] += 1
        x[k, teams.index(a)] -= 1
    r = pdf.y - np.column_stack([np.ones(len(pdf)), x]) @ np.linalg.lstsq(np.column_stack([np.ones(len(pdf)), x]), pdf.y, rcond=None)[0]
    return x, teams, r, 1 - r.var() / pdf.y.var(ddof=0) * (len(pdf) / len(pdf))


def test_team_effects(spark):
    c = F.col
    g = games(spark, SF).select((c("team") % 40).alias("home"), ((c("game_id") * 31 + c("team") * 17) % 40).alias("away"), c("margin").alias("y"))
    found, intercept, share = effects.team_effects(g, "home", "away", "y")
    pdf = g.toPandas()
    x, teams, r, _ = least_squares(pdf)
    assert share == pytest.approx(1 - np.var(r) / np.var(pdf.y))
    b = {t["team"]: t["effect"] for t in found.collect()}
    assert np.allclose(pdf.y - intercept - x @ np.array([b[t] for t in teams]), r, atol=1e-6)
    assert all(abs(t["gradient"]) < 1e-6 for t in found.collect())


def test_team_effects_of_odd_games(spark):
    """Two sets of teams that never meet, a team against itself, nulls, one team at home alone; and none."""
    df = spark.createDataFrame([("a", "b", 3.0), ("a", "b", 5.0), ("c", "d", -2.0), ("e", "e", 9.0), ("a", None, 1.0), ("c", "a", None), ("b", "c", 1.0), ("x", "y", 4.0)], "h string, a string, m double")
    found, _, share = effects.team_effects(df, "h", "a", "m")
    pdf = df.toPandas().dropna().set_axis(["home", "away", "y"], axis=1).reset_index(drop=True)
    assert share == pytest.approx(1 - np.var(least_squares(pdf)[2]) / np.var(pdf.y))
    assert found.count() == 7
    assert effects.team_effects(df.limit(0), "h", "a", "m")[0].count() == 0


def test_repeats_inside_a_batch(spark):
    schema = "id int, v string, seen int"
    old = spark.createDataFrame([(1, "a", 5)], schema)
    new = spark.createDataFrame([(2, "x", 7), (2, "x", 6), (3, None, 1), (1, "a", 9)], schema)
    assert sorted(tuple(r) for r in feeds.append_by_id(old, new, "id", ["seen"]).collect()) == [(2, "x", 6), (3, None, 1)]
    for bad in ([(3, "x", 1), (3, "y", 1)], [(3, None, 1), (3, "y", 1)], [(1, None, 1)]):
        with pytest.raises(Exception, match="conflicting"):
            feeds.append_by_id(old, spark.createDataFrame(bad, schema), "id", ["seen"]).collect()


def test_bins_and_roles(spark):
    df = spark.createDataFrame([("low", 0.0, 2.0, 4.0)] * 150 + [("low", 3.0, 2.0, 4.0)] * 150 + [("high", 9.0, 2.0, 4.0)] * 20, "bin string, a double, f double, v double")
    ratio = {r["bin"]: r["ratio"] for r in fit.shrunk_bins(df, "bin", "a", "f", "v").collect()}
    assert ratio == pytest.approx({"low": (2.5 / 4 * 300 + 100) / 400, "high": min(4, (49 / 4 * 20 + 100) / 120)})
    mix = fit.play_mixture(df, "bin", "a", "f", "v").collect()
    assert [(r["bin"], r["play"], r["ratio"]) for r in mix] == [("low", 0.5, 0.25)]
    z = spark.createDataFrame([(1, "x", 1.0, True, True), (1, "x", 2.0, True, True), (1, "x", 3.0, False, False), (1, "y", 5.0, False, True), (2, "x", 1.0, False, False)], "g int, t string, z double, starter boolean, star boolean")
    got = {r["role"]: (r["games"], r["mean"]) for r in fit.pair_dependence(z, "g", "t", "z", F.col("starter"), F.col("star")).collect()}
    assert got == {"starter": (1, 2.0), "team": (1, 4.5), "own_star": (1, 2.0), "game_star": (1, 7.5)}
