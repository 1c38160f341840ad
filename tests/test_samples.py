"""Random splits, halves, fills and expected quarters: nulls, constants, empty tables and small cases by hand."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from sibyl.operators import joins, pace, samples


def test_splits_of_constants_and_of_nothing(spark):
    df = spark.createDataFrame([(k, i, 1.0 if i else None) for k in "abc" for i in range(6)], "k string, i int, v double")
    got = samples.split_reliability(df, ["k"], "i", "v", [2], draws=3).collect()
    assert [tuple(r) for r in got] == [(2, None, None)]
    assert [tuple(r) for r in samples.split_reliability(df.where("false"), ["k"], "i", "v", [2], draws=3).collect()] == [(2, None, None)]
    # two disjoint sets of a key whose rows are alike agree wholly
    alike = df.withColumn("v", F.ascii("k").cast("double"))
    got = samples.split_reliability(alike, ["k"], "i", "v", [2, 3], draws=3).collect()
    assert [(r["n"], r["reliability"], r["half_at"]) for r in got] == [(2, pytest.approx(1.0), pytest.approx(0.0)), (3, pytest.approx(1.0), pytest.approx(0.0))]


def test_halves_by_hand(spark):
    rows = [("a", 1, 1, 2.0, 10.0), ("a", 1, 9, 4.0, 30.0), ("a", 2, 1, 1.0, 10.0), ("a", 2, 9, 5.0, 20.0), ("b", 2, 1, 3.0, 10.0), ("b", 2, 9, 7.0, 5.0), ("c", 2, 9, 7.0, 50.0), ("d", 2, 1, 7.0, 50.0), ("b", 2, 2, None, 4.0)]
    df = spark.createDataFrame(rows, "k string, s int, d int, v double, w double")
    got = {(r["k"], r["s"]): r for r in samples.half_estimates(df, ["k"], "s", "d", "v", "w", -2.0, 100.0, 10.0).collect()}
    assert got.keys() == {("a", 1), ("a", 2)}  # b's second half is too short, c and d have one half
    r = got["a", 2]
    assert (r["w0"], r["target"], r["season_only"]) == (40.0, 5.0, 1.0)
    assert r["frozen"] == pytest.approx((-200 + 40 * 3.5) / 140) and r["pooled"] == pytest.approx((-200 + 140 + 10) / 150)
    assert (got["a", 1]["w0"], got["a", 1]["frozen"]) == (0.0, -2.0)
    report = {(r["experience"], r["estimate"]): (r["n"], r["mae"], r["corr"]) for r in samples.by_experience(samples.half_estimates(df, ["k"], "s", "d", "v", "w", -2.0, 100.0, 10.0), (30, 90), least_rows=1).collect()}
    assert report[2, "season_only"] == (1, 4.0, None) and report[0, "frozen"] == (1, 6.0, None) and len(report) == 6


def test_fills_and_values_before(spark):
    q = spark.createDataFrame([("a", 10, 1.0), ("a", 12, 2.0), ("a", 13, None)], "k string, t int, p double")
    plays = spark.createDataFrame([("a", 11, 5.0), ("a", 12, 6.0)], "k string, t int, m double")
    got = {r["t"]: (r["m"], r["fill_p"]) for r in joins.filled_states(q, plays, ["k"], "t", ["m"], ["p"], 2).collect()}
    assert got == {10: (None, 2.0), 12: (6.0, None), 13: (6.0, None)}
    got = {r["t"]: r["m"] for r in joins.value_before(q, plays, ["k"], "t", "m", F.lit(-1.0)).collect()}
    assert got == {10: -1.0, 12: 5.0, 13: 6.0}


def test_quarters_and_pace_by_hand(spark):
    rows = [(1, 1, "x", True, 10.0, 8.0), (1, 1, "y", False, 8.0, 10.0), (2, 2, "y", True, 12.0, 6.0), (2, 2, "x", False, 6.0, 12.0), (3, 3, "x", True, 9.0, 9.0)]
    s = spark.createDataFrame(rows, "game int, day int, team string, home boolean, o double, d double").withColumn("season", F.lit(1))
    got = {r["game"]: r for r in pace.expected_quarters(s, "season", "team", "day", "game", "home", ["o"], ["d"]).collect()}
    assert got.keys() == {1, 2}  # a game of one side is none
    assert (got[1]["e1"], got[1]["t1"], got[1]["l1"], got[1]["n_h"]) == (None, None, None, 0)
    assert (got[2]["e1"], got[2]["t1"], got[2]["l1"], got[2]["n_h"]) == (18.0, 18.0, 18.0, 1)
    lp = {r["game"]: r["lp"] for r in pace.game_pace(s, "season", "team", "day", "game", "home", "o", 5.0).collect()}
    assert lp == {1: None, 2: pytest.approx(math.log((8 + 10) / 2 / 9))}
