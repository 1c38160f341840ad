"""Operators on hand-made rows: limits, nulls, causality, state and sources."""

from __future__ import annotations

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sibyl.functions import normal, prices, scalars
from sibyl.operators import allocate, causal, fit, joins, quality, resample, scope, walk
from sibyl.sources import feeds
from sibyl.streaming import snapshots


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_prices(spark):
    lit = F.lit
    assert one(spark, prices.implied(lit(-150.0))) == pytest.approx(0.6)
    assert one(spark, prices.implied(lit(99.0))) is None
    assert one(spark, prices.devig(lit(-110.0), lit(-110.0))) == pytest.approx(0.5)
    assert one(spark, prices.power_devig(lit(-110.0), lit(-110.0))) == pytest.approx(0.5)
    assert one(spark, prices.shin_devig(lit(-200.0), lit(170.0))) == pytest.approx(0.6481, abs=2e-3)
    assert one(spark, prices.unit_profit(lit(150.0), lit(True))) == pytest.approx(1.5)
    assert one(spark, prices.unit_profit(lit(50.0), lit(True))) is None
    assert one(spark, prices.american_from_prob(lit(0.6))) == -150
    assert one(spark, prices.ats_result(lit(3.0), lit(-3.0))) == 0.5
    assert one(spark, prices.band(lit(1.0), [0, 0.5, 1])) == 1
    assert one(spark, prices.log_loss(lit(1.0), lit(0), None)) == math.inf
    assert one(spark, prices.position(lit(0.5), lit(-110.0), lit(-110.0))) is None
    books = F.array(F.struct(lit("b").alias("book"), lit(1.0).alias("home"), lit(None).cast("double").alias("away")), F.struct(lit("a").alias("book"), lit(2.0).alias("home"), lit(3.0).alias("away")))
    assert one(spark, prices.pick_book(books, ["b", "a"])["book"]) == "a"


def test_normal(spark):
    for x in (-6.0, -1.3, 0.0, 0.7, 8.0):
        assert one(spark, normal.norm_cdf(F.lit(x))) == pytest.approx(0.5 * math.erfc(-x / math.sqrt(2)), abs=1e-14)
        p = 0.5 * math.erfc(-x / math.sqrt(2))
        if 0 < p < 1 - 1e-12:
            assert one(spark, normal.norm_ppf(F.lit(p))) == pytest.approx(x, abs=1e-7)


def test_scalars(spark):
    lit = F.lit
    assert one(spark, scalars.norm_name(lit("José O'Neal Jr."))) == "jose oneal"
    assert one(spark, scalars.first_last(lit("SmithJr., Bob"))) == "Bob Smith Jr."
    assert one(spark, scalars.clock_seconds(lit("1:05"))) == 65
    assert one(spark, scalars.interpolate(lit(0.25), [0.0, 0.5, 1.0], F.array(lit(0.0), lit(1.0), lit(0.0)))) == pytest.approx(0.5)
    assert spark.range(1).select(allocate.exact_name(lit("Łukasz Šarić III")).alias("x")).first()["x"].endswith("saric")


def test_causality(spark):
    rows = [(k, d, float(v)) for k in "ab" for d, v in enumerate([1, 2, 2, 5])] + [("a", 1, 9.0)]
    df = spark.createDataFrame(rows, "k string, d int, v double").withColumn("i", F.monotonically_increasing_id())
    t = causal.latest_n_before(df, ["k"], "d", ["i"], ["v"], 2)
    late = causal.latest_n_before(df.withColumn("v", F.when(F.col("d") >= 2, 100.0).otherwise(F.col("v"))), ["k"], "d", ["i"], ["v"], 2)
    pick = lambda x: sorted(tuple(r) for r in x.where("d <= 2").select("k", "d", "v_sum", "members").collect())
    assert pick(t) == pick(late)
    assert {r["members"] for r in t.where("d = 1").collect()} == {1}


def test_decay_matches_direct_sum(spark):
    x = np.arange(1.0, 31.0)
    df = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(x)], "k int, i int, v double")
    got = [r["v_decayed"] for r in causal.decayed(df, ["k"], ["i"], ["v"], 4.0).orderBy("i").collect()]
    want = [sum(x[k] * 0.5 ** ((i - 1 - k) / 4) for k in range(i)) for i in range(30)]
    assert got == pytest.approx(want)


def test_as_of_and_nearest(spark):
    left = spark.createDataFrame([(1, 10), (1, 100), (2, 5)], "k int, t int")
    right = spark.createDataFrame([(1, 8, "a"), (1, 10, "b"), (2, 6, "c")], "k int, s int, v string")
    got = {(r["k"], r["t"]): r["v"] for r in joins.as_of(left, right, ["k"], "t", "s", ["v"], tolerance=20).collect()}
    assert got == {(1, 10): "b", (1, 100): None, (2, 5): None}
    strict = {(r["k"], r["t"]): r["v"] for r in joins.as_of(left, right, ["k"], "t", "s", ["v"], strict=True).collect()}
    assert strict[1, 10] == "a"


def test_one_to_one_raises(spark):
    left, right = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(1, 2), (1, 3)], "k int, v int")
    with pytest.raises(Exception, match="not one to one"):
        joins.one_to_one(left, right, ["k"]).collect()


def test_lineage(spark):
    rules = spark.createDataFrame([("a", None, 1.0), ("b", "a", 1.0), ("c", "b", 2.0)], "key string, parent string, edge double")
    assert {r["key"]: r["twin"] for r in joins.lineage(rules, ["edge"]).collect()} == {"a": "a", "b": "a", "c": "c"}


def test_allocation(spark):
    df = spark.createDataFrame([(1, "a", 10.0), (1, "b", 1.0), (1, "c", 1.0)], "g int, n string, w double")
    got = {r["n"]: r["allocated"] for r in allocate.allocate(df, ["g"], "w", 10.0, 6.0, ["n"]).collect()}
    assert got == pytest.approx({"a": 6.0, "b": 2.0, "c": 2.0})


def test_fits(spark):
    rng = np.random.default_rng(3)
    x, z = rng.normal(size=2000), rng.normal(size=2000)
    y = 2 + 3 * x - z + rng.normal(size=2000) * 0.5
    won = (rng.random(2000) < 1 / (1 + np.exp(-(0.3 + 1.2 * x)))).astype(int)
    df = spark.createDataFrame([(float(a), float(b), float(c), int(w), i % 7) for i, (a, b, c, w) in enumerate(zip(x, z, y, won, strict=True))], "x double, z double, y double, won int, g int")
    beta, sigma = fit.ols(df, ["x", "z"], "y")
    want = np.linalg.lstsq(np.stack([x, z, np.ones(2000)], 1), y, rcond=None)[0]
    assert beta == pytest.approx(want) and sigma == pytest.approx(0.5, abs=0.05)
    g = fit.glm(df, ["x"], "won", cluster="g")
    assert g.beta == pytest.approx([1.2, 0.3], abs=0.15)
    p = fit.glm(df, ["x"], "won", link="probit")
    assert p.beta[0] == pytest.approx(g.beta[0] / 1.7, abs=0.1)
    folds = walk.season_folds(df, ["x", "z"], "y", "g", walk_forward=True)
    assert folds.where("g = 0").count() == 0 and folds.agg(F.max("train_rows")).first()[0] < 2000


def test_bootstrap_is_seeded(spark):
    df = spark.createDataFrame([(i % 20, float(i % 7), 3.0) for i in range(400)], "c int, a double, b double")
    a, b = (resample.paired_bootstrap(df, "c", "a", "b", draws=100).first() for _ in range(2))
    assert a == b and a["lo"] < a["mean"] < a["hi"]


SNAPSHOTS = [("g1", 10, 100, 1.0), ("g1", 95, 100, 2.0), ("g1", 100, 100, 3.0), ("g1", 40, 100, None), ("g2", 500, 400, 9.0)]


def state(df):
    t = df.withColumns({"ts": F.timestamp_seconds(F.col("sec") * 3600), "tip": F.timestamp_seconds(F.col("tip_sec") * 3600)})
    return snapshots.pregame_state(t, ["game"], "ts", "tip", ["p"], "sec", F.col("p").isNotNull())


def test_state_in_batch_and_stream(spark, tmp_path):
    rows = spark.createDataFrame(SNAPSHOTS, "game string, sec long, tip_sec long, p double")
    want = {r["game"]: r for r in state(rows).collect()}
    assert want["g1"]["pre"]["p"] == 2.0 and want["g1"]["first"]["p"] == 1.0 and want["g1"]["lock"]["p"] == 2.0 and want["g1"]["rejected"] == 1
    assert want["g2"]["pre"] is None and want["g2"]["lock"] is None
    for i, r in enumerate([3, 4, 2, 0, 1]):  # another order of arrival, one file each
        spark.createDataFrame([SNAPSHOTS[r]], rows.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = snapshots.start_state_stream(stream, "state_out", str(tmp_path / "cp"), state)
    q.processAllAvailable()
    q.stop()
    got = {r["game"]: r for r in spark.table("state_out").collect()}
    assert got == want


def test_upsert_stream(spark, tmp_path):
    schema = "k int, ts int, start int, v string"
    spark.createDataFrame([(1, 1, 9, "a"), (1, 5, 9, "b"), (1, 9, 9, "late"), (2, 1, 9, "c")], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    snapshots.start_upsert_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"), ["k"], "ts", "start").awaitTermination()
    assert sorted(r["v"] for r in spark.read.parquet(str(tmp_path / "out" / "v0")).collect()) == ["b", "c"]


def test_failed_fetch_keeps_state(spark):
    df = spark.createDataFrame([("g", 1, 9, True, "a"), ("g", 2, 9, False, None), ("h", 1, 9, True, "b"), ("h", 2, 9, True, None)], "g string, ts int, tip int, ok boolean, m string")
    assert [r["m"] for r in snapshots.latest_valid_set(df, ["g"], "ts", "tip", "ok", "m").collect()] == ["a"]


def test_feeds(spark):
    board = {"events": [{"id": "1", "date": "2024", "status": {"type": {"state": "post"}}, "competitions": [{"competitors": [{"homeAway": "home", "score": "100", "team": {"abbreviation": "BOS"}}, {"homeAway": "away", "score": "90", "team": {"abbreviation": "NYK"}}]}]}]}
    r = feeds.scoreboard(spark.createDataFrame([(json.dumps(board),)], "t string"), "t").first()
    assert (r["home"], r["away_score"]) == ("BOS", 90.0)
    inj = {"injuries": [{"team": {"abbreviation": "BOS"}, "injuries": [{"athlete": {"id": "7", "displayName": "X"}, "status": "Out"}]}]}
    rows = feeds.injuries(spark.createDataFrame([("g", "BOS", "NYK", json.dumps(inj)), ("h", "A", "B", "{}")], "k string, h string, a string, t string"), "t", "k", "h", "a").collect()
    assert sorted((x["team"], x["status"]) for x in rows) == [("BOS", "Out"), ("NYK", "NONE")]
    box = {"boxscore": {"players": [{"team": {"abbreviation": "BOS"}, "statistics": [{"keys": ["minutes", "points"], "athletes": [{"athlete": {"id": "1", "displayName": "A"}, "stats": ["30", "12"]}, {"athlete": {"id": "2", "displayName": "B"}, "didNotPlay": True, "stats": []}]}]}]}}
    df = spark.createDataFrame([("g", json.dumps(box))], "k string, t string")
    assert [x["points"] for x in feeds.box_rows(df, "t", "k", ["points"]).collect()] == [12.0]
    assert sorted(x["points"] for x in feeds.box_rows(df, "t", "k", ["points"], dnp_zero=True).collect()) == [0.0, 12.0]
    lines = [(1, "10/22/2024"), (2, "BOS@NYK"), (3, "TEAM: Boston"), (4, "Tatum, Jayson Out"), (5, "TEAM: New York"), (6, "NOT YET SUBMITTED")]
    rep = feeds.report_rows(spark.createDataFrame([("f", *x) for x in lines], "f string, n int, t string"), "f", "n", "t").orderBy("n").collect()
    assert [(x["team"], x["player"], x["status"]) for x in rep] == [("Boston", "Tatum, Jayson", "Out"), ("New York", None, "PENDING")]


def test_append_by_id(spark):
    old = spark.createDataFrame([(1, "a", 5)], "id int, v string, seen int")
    new = spark.createDataFrame([(1, "a", 6), (2, "b", 6)], "id int, v string, seen int")
    assert [r["id"] for r in feeds.append_by_id(old, new, "id", ["seen"]).collect()] == [2]
    with pytest.raises(Exception, match="conflicting"):
        feeds.append_by_id(old, new.withColumn("v", F.lit("z")), "id", ["seen"]).collect()


def test_csv_vintages(spark, tmp_path):
    from pyspark.sql import types as T

    (tmp_path / "a.csv").write_text("id,p\n1,\n")
    full = T.StructType([T.StructField("id", T.StringType()), T.StructField("p", T.DoubleType()), T.StructField("book", T.StringType())])
    old = T.StructType(full.fields[:2])
    assert tuple(feeds.evolved_csv(spark, str(tmp_path / "a.csv"), [old, full], full, {"book": "dk"}).first()) == ("1", None, "dk")
    with pytest.raises(ValueError):
        feeds.strict_csv(spark, str(tmp_path / "a.csv"), ["id"])


def test_constraints(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 1.5), (3, None)], "id int, p double")
    bad = quality.violations(df, "id", [quality.Constraint("range", F.col("p").between(0, 1)), quality.Constraint("present", F.col("p").isNotNull(), True)])
    assert sorted((r["key"], r["rule"]) for r in bad.collect()) == [("2", "range"), ("3", "present")]


def test_empty_tables(spark):
    e = spark.createDataFrame([], "k string, d int, v double, i int")
    assert causal.latest_n_before(e, ["k"], "d", ["i"], ["v"], 5).count() == 0
    assert causal.decayed(e, ["k"], ["i"], ["v"], 3.0).count() == 0
    assert scope.latest_n(e, ["k"], [F.desc("v")], 2).count() == 0


def test_sorted_write_replaces_only_its_partitions(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    feeds.write_sorted(spark.createDataFrame([(1, 2), (1, 1), (2, 5)], "season int, i int"), path, "season", ["i"])
    feeds.write_sorted(spark.createDataFrame([(1, 9)], "season int, i int"), path, "season", ["i"])
    assert sorted((r["season"], r["i"]) for r in spark.read.parquet(path).collect()) == [(1, 9), (2, 5)]


def test_strict_scan_of_many_files(spark, tmp_path):
    for season in (2026, 2027):
        (tmp_path / f"log_{season}.csv").write_text(f"id,p\n{season},0.5\n")
    got = feeds.strict_csv(spark, f"{tmp_path}/log_*.csv", ["id", "p"]).collect()
    assert sorted((r["id"], r["source_file"]) for r in got) == [("2026", "log_2026.csv"), ("2027", "log_2027.csv")]


def test_precedence_and_members(spark):
    live = spark.createDataFrame([(1, "void")], "id int, s string")
    replay = spark.createDataFrame([(1, "ok"), (2, "ok")], "id int, s string")
    assert sorted(tuple(r) for r in scope.with_precedence([live, replay], "id").collect()) == [(1, "void"), (2, "ok")]


def test_cells_of_one_slate_do_not_see_each_other(spark):
    df = spark.createDataFrame([(1, 1, 1.0), (2, 1, 1.0), (3, 2, 1.0)], "i int, d int, w double").withColumn("c", F.lit(0))
    got = {r["i"]: r["members"] for r in causal.latest_n_before(df, ["c"], "d", ["i"], ["w"], 200).collect()}
    assert got == {1: 0, 2: 0, 3: 2}
