"""Streams that end: the batch operators on any order of arrival, restarts, moved deadlines, and no state left behind."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sibyl.streaming import ledger, snapshots

START = datetime(2026, 1, 1)
SCHEMA = "game string, ts timestamp, tip timestamp, n long, p double, total double"


@pytest.fixture
def store(spark):
    for k, v in ledger.STORE.items():
        spark.conf.set(k, v)
    yield
    for k in ledger.STORE:
        spark.conf.unset(k)


def hours(h: float) -> datetime:
    return START + timedelta(hours=h)


def snapshots_of(games: int, seed: int) -> list[tuple]:
    """Every game has some snapshots around its tip; some tips move later or earlier with a later snapshot."""
    rng = random.Random(seed)
    out = []
    for g in range(games):
        tip, n = rng.uniform(10, 60), 0
        moved = tip + rng.choice([0, 0, 4, -3])
        for h in sorted(rng.uniform(tip - 9, tip + 3) for _ in range(rng.randint(1, 8))):
            n += 1
            now = tip if h < tip - 5 else moved
            out.append((f"g{g}", hours(round(h, 2)), hours(round(now, 2)), n, rng.choice([None, 0.5, 0.6]), rng.choice([None, 200.0])))
    return out


def batch(df):
    return snapshots.pregame_state(df, ["game"], "ts", "tip", ["p", "total"], "n", F.col("p").isNotNull()), snapshots.totals_state(df, ["game"], "ts", "tip", ["p", "total"], "n", F.col("total").isNotNull())


def streamed(spark, build, folder, out, cp):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    q = build(stream).writeStream.outputMode("append").format("parquet").option("checkpointLocation", cp).option("path", out).trigger(availableNow=True).start()
    q.awaitTermination()
    return q.lastProgress


def arrive(spark, rows, folder, chunk):
    for i in range(0, len(rows), chunk):
        spark.createDataFrame(rows[i : i + chunk], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def slot(x):
    return None if x is None else (x["p"], x["total"])


def test_stream_equals_batch_after_a_restart(spark, store, tmp_path):
    rows = snapshots_of(25, 1)
    # arrival is out of order by up to ten hours
    rng = random.Random(2)
    arrival = sorted(rows, key=lambda r: r[1] + timedelta(hours=rng.uniform(0, 10)))
    folder, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    build = lambda s: ledger.deadline_ledger(s, ["game"], "ts", "tip", ["p", "total"], "n", F.col("p").isNotNull(), total_ready=F.col("total").isNotNull(), lateness="10 hours")
    half = len(arrival) // 2
    arrive(spark, arrival[:half], folder, 20)
    streamed(spark, build, folder, out, cp)
    # rows far ahead push the watermark over all tips; their own key stays open
    arrive(spark, [*arrival[half:], ("end", hours(500), hours(900), 1, 0.5, None)], folder, 20)
    arrive(spark, [("end", hours(501), hours(900), 2, 0.5, None)], folder, 20)
    progress = streamed(spark, build, folder, out, cp)
    got = {r["game"]: r for r in spark.read.parquet(out).collect()}
    a, b = (x.collect() for x in batch(spark.createDataFrame(rows, SCHEMA)))
    want, totals = {r["game"]: r for r in a if r["accepted"]}, {r["game"]: r for r in b}
    assert set(got) == set(want) and len(got) > 15
    assert spark.read.parquet(out).count() == len(got)
    for g, r in got.items():
        assert (r["accepted"], r["first_seen"]) == (want[g]["accepted"], want[g]["first_seen"])
        assert [slot(r[s]) for s in ("pre", "first", "lock")] == [slot(want[g][s]) for s in ("pre", "first", "lock")]
        assert [slot(r[s]) for s in ("first_total", "lock_total")] == [slot(totals[g][s]) for s in ("first_total", "lock_total")]
    held = spark.read.format("statestore").option("stateVarName", "game").load(cp).select("key.*").collect()
    assert [r[0] for r in held] == ["end"]
    for s in ("pre", "first", "lock"):
        assert {r[0] for r in spark.read.format("statestore").option("stateVarName", s).load(cp).select("key.*").collect()} <= {"end"}
    assert progress is not None


def test_late_snapshots_open_nothing(spark, store, tmp_path):
    folder, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    build = lambda s: ledger.deadline_ledger(s, ["game"], "ts", "tip", ["p", "total"], "n", F.col("p").isNotNull())
    for rows in ([("a", hours(1), hours(5), 1, None, None)], [("a", hours(2), hours(5), 2, 0.5, None)], [("end", hours(50), hours(90), 1, 0.5, None)], [("end", hours(51), hours(90), 2, 0.5, None)], [("a", hours(3), hours(5), 3, 0.9, None), ("a", hours(60), hours(5), 4, 0.9, None)], [("end", hours(61), hours(90), 3, 0.5, None)]):
        arrive(spark, rows, folder, 9)
    streamed(spark, build, folder, out, cp)
    r = spark.read.parquet(out).collect()
    assert len(r) == 1 and r[0]["game"] == "a" and r[0]["accepted"] == 2
    assert (r[0]["seen_note"], r[0]["first"]["at"], r[0]["pre"]["p"], r[0]["lock"]["p"]) == ("not usable", hours(2), 0.5, 0.5)
    assert [x[0] for x in spark.read.format("statestore").option("stateVarName", "game").load(cp).select("key.*").collect()] == ["end"]


def test_two_kinds(spark, store, tmp_path):
    rng = random.Random(4)
    rows = [(f"g{g}", hours(f), hours(20 + g), m, float(f), None) for g in range(6) for f in sorted(rng.sample(range(30), 4)) for m in range(rng.randint(1, 3))]
    want = {tuple(r) for r in snapshots.two_kinds(spark.createDataFrame(rows, SCHEMA), ["game"], "ts", "tip").select("game", "kind", "n", "p").collect()}
    rng.shuffle(rows)
    folder, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    arrive(spark, rows, folder, 12)
    arrive(spark, [("end", hours(500), hours(900), 1, 0.5, None)], folder, 9)
    arrive(spark, [("end", hours(501), hours(900), 1, 0.5, None)], folder, 9)
    streamed(spark, lambda s: ledger.two_kind_ledger(s, ["game"], "ts", "tip", ["n", "p"], "40 hours"), folder, out, cp)
    got = [tuple(r) for r in spark.read.parquet(out).select("game", "kind", "n", "p").collect()]
    assert set(got) == want and len(got) == len(want)


def pair_of_streams(spark, tmp_path, left, right, build):
    """Two streams through a join: rows and, of the last batch, rows held in state."""
    for name, rows, schema in (("l", *left), ("r", *right)):
        for r in rows:
            spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    read = lambda n, s: spark.readStream.schema(s).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / n))
    q = build(read("l", left[1]), read("r", right[1])).writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(str(tmp_path / "out")).collect(), q.lastProgress.stateOperators[0].numRowsTotal, sum(p.stateOperators[0].numRowsDroppedByWatermark for p in q.recentProgress if p.stateOperators)


def test_live_quotes(spark, tmp_path):
    states = [("a", hours(1), 0.5), ("a", hours(3), 0.6), ("b", hours(2), 0.4), ("a", hours(90), 0.1), ("a", hours(91), 0.1), ("a", hours(1.5), 0.9)]
    quotes = [("a", hours(2.5), 55), ("a", hours(0.9), 50), ("b", hours(2.1), 44), ("z", hours(90), 1), ("z", hours(91), 1), ("z", hours(92), 1)]
    got, held, late = pair_of_streams(spark, tmp_path, (states, "game string, at timestamp, chance double"), (quotes, "game string, quoted timestamp, mid int"), lambda s, q: ledger.live_quotes(s, q, ["game"], "at", "quoted", 3600, "4 hours"))
    assert sorted((r["game"], r["chance"], r["mid"]) for r in got if r["chance"] != 0.1) == [("a", 0.5, 50), ("a", 0.6, 55), ("b", 0.4, None)]
    assert held <= 5 and late == 1


def test_graded_stream(spark, tmp_path):
    games = [("a", hours(1)), ("b", hours(2)), ("z", hours(300)), ("z", hours(301))]
    results = [("a", hours(4), 1), ("b", hours(100), 0), ("y", hours(300), 1), ("y", hours(301), 1)]
    got, _, _ = pair_of_streams(spark, tmp_path, (games, "game string, tip timestamp"), (results, "game string, ended timestamp, won int"), lambda g, r: ledger.graded_stream(g, r, "game", "tip", "ended", 2))
    assert sorted((r["game"], r["won"]) for r in got if r["game"] != "z") == [("a", 1), ("b", None)]
