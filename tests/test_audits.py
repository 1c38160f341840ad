"""Roster changes, report grids, pace arms, lineage, rule sets, rescored locks, forward scores and comebacks on small rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sibyl.operators import fit, joins, measure, rosters, rules
from sibyl.streaming import snapshots

BOX = "season int, game int, day int, team string, player string, minutes double"


def brute(box, statuses, worths):
    listed = {(g, p): s for g, p, s in statuses}
    played = [r for r in box if r[5] and r[5] > 0]
    out = {}
    for season, team in {(r[0], r[3]) for r in box}:
        games = sorted({(r[2], r[1]) for r in box if (r[0], r[3]) == (season, team)})
        prev = set()
        for day, game in games:
            worth = lambda p: max(((d, v) for q, d, v in worths if q == p and d < day), default=(0, 0.0))[1]  # noqa: B023, E731
            new, back, named = 0.0, 0.0, 0.0
            for p in {r[4] for r in played if r[0] == season}:
                gone = listed.get((game, p)) in rosters.GONE
                last = max(((r[2], r[1], r[3]) for r in played if (r[0], r[4]) == (season, p) and r[2] < day), default=None)
                if p in prev:
                    new += worth(p) * gone
                elif last and last[2] == team and not gone:
                    back += worth(p)
                    named += worth(p) * ((game, p) in listed)
            out[season, team, game] = (new, back, named)
            prev = {r[4] for r in played if (r[0], r[1], r[3]) == (season, game, team)}
    return out


def test_roster_changes_as_defined(spark):
    rng = random.Random(5)
    box = []
    for game in range(40):
        for team in rng.sample("ABC", 2):
            box += [(2000 + game // 20, game, game // 2, team, p, float(rng.choice([0, 10, 20]))) for p in rng.sample("pqrstu", 3) if not any(r[1] == game and r[4] == p for r in box)]
    statuses = [(g, p, rng.choice(["Out", "Doubtful", "Questionable"])) for g in range(40) for p in "pqrstu" if rng.random() < 0.4]
    worths = [(p, d, float(rng.randint(1, 9))) for p in "pqrst" for d in range(0, 20, 3)]
    frame = spark.createDataFrame([*box, box[0], (2000, None, 1, "A", "p", 5.0), (2000, 3, 1, None, "p", 5.0)], BOX)
    got = rosters.roster_changes(frame, spark.createDataFrame(statuses, "game int, player string, status string"), spark.createDataFrame(worths, "player string, day int, value double"))
    found = {(r.season, r.team, r.game): (r.newly_out, r.returning, r.returning_listed) for r in got.collect()}
    want = brute(box, statuses, worths)
    assert {k for k in want if found[k] != pytest.approx(want[k])} == set() and found.keys() == want.keys()
    assert any(v[0] for v in found.values()) and any(v[1] > v[2] > 0 for v in found.values())
    assert rosters.roster_changes(frame.limit(0), spark.createDataFrame([], "game int, player string, status string"), spark.createDataFrame([], "player string, day int, value double")).count() == 0


def chain(spark, n):
    return spark.range(n).select(F.col("id").alias("key"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), (F.col("id") >= n // 2).alias("edge"), F.lit(None).cast("int").alias("none"))


def test_lineage_of_a_long_chain_stops_where_fields_change(spark):
    twins = {r.key: r.twin for r in joins.lineage(chain(spark, 3000), ["edge", "none"]).collect()}
    assert twins == {k: 1500 * (k >= 1500) for k in range(3000)}


def test_lineage_stops_at_closed_and_unknown_parents_and_refuses_cycles(spark):
    schema = "key string, parent string, edge int, closed boolean"
    rows = [("a", None, 1, True), ("b", "a", 1, None), ("c", "b", 1, False), ("d", "x", 1, None)]
    assert {r.key: r.twin for r in joins.lineage(spark.createDataFrame(rows, schema), ["edge"], "closed").collect()} == {"a": "a", "b": "b", "c": "b", "d": "d"}
    for ring in ("ab", "abc"):
        with pytest.raises(ValueError, match="cycle"):
            joins.lineage(spark.createDataFrame([(k, ring[i - 1], 1, None) for i, k in enumerate(ring)], schema), ["edge"])


def test_pace_arms_find_planted_scales(spark):
    rng = random.Random(2)
    rows = []
    for i in range(900):
        m, lp = rng.uniform(-12, 12), rng.uniform(-0.15, 0.15)
        margin = m * (1 + 2 * lp) + rng.gauss(0, 3)
        rows.append((2000 + i % 3, m, lp, 3.0, margin, int(margin > 0)))
    df = spark.createDataFrame([*rows, (2001, None, 0.1, 3.0, 1.0, 1)], "season int, m double, lp double, sd double, margin double, won int")
    got = {(r.season, r.arm): r for r in fit.pace_arms(df, "season", "m", "lp", "sd", "margin", "won", [-2.0, 0.0, 2.0]).collect()}
    assert {s for s, _ in got} == {2001, 2002} and all(r.n == 300 for r in got.values())
    assert got[2002, "base"].mse == 0 and got[2002, "margin"].mse < 0 and abs(got[2002, "margin"].k - 2) < 0.5
    assert fit.pace_arms(df.where("season = 2000"), "season", "m", "lp", "sd", "margin", "won", [0.0]).count() == 0


def test_rules_take_text_times_nulls_and_older_vintages(spark):
    df = spark.createDataFrame([("1", "2024-01-01 20:00:00", "soon", None), ("2", None, "2024-01-01 19:00:00", 1.5), ("2", "2024-01-01 20:00:00", None, 0.5)], "id string, tip string, first_at string, p double")
    found = {(r.key, r.rule) for r in rules.ledger_violations(df, "id", ["x"]).collect()}
    assert found == {("1", "first_at before the tip"), ("2", "first_at before the tip"), ("2", "p in 0..1"), ("2", "id once")}
    assert rules.vintage(["a", "b"], {"old": ["a"], "new": ["a", "b"]}) == "new" and rules.vintage(["b", "a"], {"new": ["a", "b"]}) is None
    assert rules.ledger_violations(df.limit(0), "id", []).count() == 0


def test_rescored_locks_know_only_reports_up_to_the_lock(spark):
    led = spark.createDataFrame([("a", "t", 100, "v_1", 5), ("b", "t", 90, "v_1", 5), ("c", "t", None, "v_1", 5), ("d", "t", 100, "v_2", 5), ("e", "t", 100, "v_1", 4), ("f", "u", 100, "v_1", 5)], "id string, team string, lock_at long, tag string, slate int")
    rep = spark.createDataFrame([("t", 95, 1.0), ("t", 100, 2.0), ("t", 101, 9.0)], "team string, ts long, x double")
    got = snapshots.rescored_locks(led, spark.createDataFrame([("z",)], "id string"), rep, "id", ["team"], "_1", F.lit(5), {"y": F.coalesce("x", F.lit(-1.0))})
    assert {(r.id, r.report_at, r.y) for r in got.collect()} == {("a", 100, 2.0), ("b", None, -1.0), ("f", None, -1.0)}


def test_forward_score_keeps_pending_rows_and_infinite_loss(spark):
    log = spark.createDataFrame([("a", 1.0, 0.6, -110.0, -110.0), ("b", 0.7, 0.4, 150.0, -170.0), ("c", 0.5, 0.5, None, None)], "id string, p double, q double, h double, w double")
    res = spark.createDataFrame([("a", 0), ("b", 1), ("c", None)], "id string, won int")
    got = {r.estimator: r for r in snapshots.forward_score(log, res, "id", {"m": "p", "k": "q"}, "won", "h", "w", "q").collect()}
    assert (got["m"].official, got["m"].graded, got["m"].pending, got["m"].bets) == (3, 2, 1, 2) and got["m"].loss == float("inf")
    assert got["m"].units == pytest.approx(0.5) and got["favourite"].bets == 2 and got["favourite"].units == pytest.approx(-2)


def test_comebacks_count_only_states_after_the_low_one(spark):
    rows = [("a", 1, 0.9, 1), ("a", 2, 0.3, 1), ("b", 1, 0.2, 1), ("b", 5, 0.85, 1), ("c", 1, 0.6, 1), ("d", 1, None, 0)]
    got = measure.comebacks(spark.createDataFrame(rows, "side string, at int, p double, won int"), ["side"], "at", "p", "won").collect()
    assert {(r.favourite, r.band, r.n, r.back, r.win) for r in got} == {(True, 3, 1, 0.0, 1.0), (False, 2, 1, 1.0, 1.0)}
