"""Captures with proofs: written once, evidence first, and every kind of change comes out."""

from __future__ import annotations

import hashlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sibyl.streaming import evidence as E

SAID = ["game", "slate", "p", "forecast", "tip"]
NOON, TIP = datetime(2026, 1, 5, 12), datetime(2026, 1, 5, 20)


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rows = [("g1", d, f"m{d}", d % 2) for d in range(1, 5)] + [("g2", 2, "m2", 0), ("g2", 1, "m1", 1)]
    members = spark.createDataFrame(rows, "game string, day int, member string, won int")
    proved = E.proofs(members, "game", "day", "member", "won", 4.0, 0.5)
    forecasts = spark.createDataFrame([("g1", 5, 0.6, NOON, TIP), ("g2", 5, None, NOON, TIP), ("g3", 5, 0.7, NOON, TIP)], "game string, slate long, p double, forecast timestamp, tip timestamp")
    return forecasts, proved


def taken(forecasts, proved, now=datetime(2026, 1, 5, 18)):
    return E.captures(forecasts, proved, "game", SAID, "forecast", "tip", F.lit(now), F.lit(True))


def test_proofs(made):
    rows = {r["game"]: r for r in made[1].collect()}
    text = E.canonical({"pseudo": 4.0, "prior": 0.5, "members": [{"day": 1, "game": "m1", "won": 1}, {"day": 2, "game": "m2", "won": 0}]})
    assert rows["g2"]["evidence"] == text and rows["g2"]["evidence_id"] == hashlib.sha256(text.encode()).hexdigest()
    assert (rows["g1"]["games"], rows["g1"]["wins"], rows["g1"]["chance"]) == (4, 2, 0.5)


def test_record(spark, made, tmp_path):
    path, clock = f"file://{tmp_path}/log", lambda: F.lit(datetime(2026, 1, 5, 18, 1))
    forecasts, proved = made
    assert E.record(taken(forecasts, proved), proved, path, "tip", clock) == 2
    # rendered again later: the same capture, its first time stays
    assert E.record(taken(forecasts, proved, datetime(2026, 1, 5, 19)), proved, path, "tip", clock) == 0
    log, kept = spark.read.parquet(f"{path}/captures"), spark.read.parquet(f"{path}/evidence")
    assert {r["captured"] for r in log.collect()} == {datetime(2026, 1, 5, 18)} and kept.count() == 2
    assert E.verify(log, kept, SAID, "slate", "forecast", "tip").count() == 0
    # a new forecast is a new capture; a write that ends after the tip leaves evidence alone
    other = forecasts.withColumn("p", F.lit(0.1))
    assert E.record(taken(other, proved), proved, path, "tip", lambda: F.lit(TIP)) == 0
    assert E.record(taken(other, proved), proved, path, "tip", clock) == 2
    assert taken(forecasts, proved, TIP).count() == 0 and taken(forecasts, proved, datetime(2026, 1, 5, 11)).count() == 0
    assert [r["p"] for r in E.official(spark.read.parquet(f"{path}/captures").where("game = 'g1'").withColumn("forecast", F.lit(datetime(2026, 1, 5, 16))), "game", "forecast", "tip").collect()] in ([0.6], [0.1])
    assert E.official(spark.read.parquet(f"{path}/captures"), "game", "forecast", "tip").count() == 0  # forecasts of noon are too old
    with pytest.raises(Exception, match="conflicting"):
        E.record(taken(forecasts, proved).withColumn("p", F.lit(0.9)), proved, path, "tip", clock)


def rules(log, kept):
    return {r["rule"] for r in E.verify(log, kept, SAID, "slate", "forecast", "tip").collect()}


def test_every_change_is_found(spark, made):
    forecasts, proved = made
    log, kept = taken(forecasts, proved), proved.select("evidence_id", "evidence")
    swap = lambda old, new: kept.withColumn("evidence", F.replace("evidence", F.lit(old), F.lit(new)))
    assert rules(log, kept) == set()
    assert rules(log, swap('"won":0', '"won":1')) == {"evidence digest", "figures"}
    assert rules(log, swap('"day":2', '"day":5')) >= {"evidence digest", "not earlier"}
    assert rules(log, swap('"game":"m2"', '"game":"m1"')) == {"evidence digest", "repeated game"}
    assert rules(log, swap('"prior":0.5', '"prior":0.6')) == {"evidence digest", "figures"}
    assert rules(log, kept.withColumn("evidence", F.lit("{}"))) >= {"evidence digest", "evidence text"}
    assert rules(log, kept.union(kept)) == {"evidence twice"}
    assert rules(log.union(log), kept) == {"capture twice"}
    assert rules(log, kept.limit(0)) == {"no evidence"}
    assert rules(log.withColumn("p", F.lit(0.99)), kept) == {"capture digest"}
    assert rules(log.withColumn("captured", F.col("tip")), kept) == {"capture time"}
    assert rules(log.withColumn("captured", F.lit(None).cast("timestamp")), kept) == {"capture time"}
