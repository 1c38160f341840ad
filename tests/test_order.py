"""Exact quantiles, ranks and day-level prefix sums against direct computation, whatever the number of blocks."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sibyl.operators import causal, measure, order


def rows(seed: int, n: int = 400) -> list[tuple]:
    rng = np.random.default_rng(seed)
    keys = np.where(rng.random(n) < 0.6, "hot", rng.choice(["a", "b"], n))  # one key holds most rows
    return [(str(k), int(d), i, None if rng.random() < 0.05 else float(v)) for i, (k, d, v) in enumerate(zip(keys, rng.integers(0, 25, n), rng.integers(-9, 9, n), strict=True))]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([*rows(1), (None, 3, 900, 2.0), (None, 4, 901, 4.0), ("only_null", 3, 902, None)], "k string, d int, i int, v double").cache()


@pytest.mark.parametrize("blocks", [2, 7, 256])
def test_quantiles(table, blocks):
    got = {r["k"]: (r["q1"], r["m"], r["p90"]) for r in order.quantiles(table, ["k"], F.col("v"), {"q1": 0.25, "m": 0.5, "p90": 0.9}, blocks).collect()}
    held: dict = {}
    for r in table.collect():
        if r["v"] is not None:
            held.setdefault(r["k"], []).append(r["v"])
    assert got.keys() == held.keys()
    for k, v in held.items():
        assert got[k] == pytest.approx(tuple(np.quantile(v, [0.25, 0.5, 0.9])))


def test_quantiles_of_nothing(table):
    assert order.quantiles(table.where("false"), ["k"], F.col("v"), {"m": 0.5}).count() == 0
    empty = measure.lock_coverage(table.where("false").withColumns({"t": F.lit(1), "w": F.lit(False)}), "d", "t", "w").collect()
    assert [tuple(r) for r in empty] == [(0, 0, 0, 0, 0, None)]
    assert measure.auc(table.where("false").withColumn("y", F.lit(1)), "v", "y").first()["auc"] is None


def test_auc_with_ties(table):
    d = table.where("v is not null").withColumn("y", (F.col("i") % 3 == 0).cast("int"))
    held = [(r["v"], r["y"]) for r in d.collect()]
    pos, neg = [v for v, y in held if y], [v for v, y in held if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert measure.auc(d, "v", "y").first()["auc"] == pytest.approx(want)


@pytest.mark.parametrize("n", [5, 60, None])
def test_latest_rows_of_earlier_days(table, n):
    held = sorted(table.collect(), key=lambda r: (r["d"], r["i"]))
    got = {r["i"]: (r["v_sum"], r["members"]) for r in causal.latest_n_before(table, ["k"], "d", ["i"], ["v"], n).collect()}
    assert len(got) == len(held)
    for r in held:
        past = [x["v"] or 0.0 for x in held if x["k"] == r["k"] and x["d"] < r["d"]]
        past = past[-n:] if n else past
        assert got[r["i"]] == (pytest.approx(sum(past)), len(past))


def test_running_record(table):
    got = {r["i"]: (r["n"], r["units"]) for r in causal.running_record(table, ["k"], ["d", "i"], "v").collect()}
    held = sorted(table.collect(), key=lambda r: (r["d"], r["i"]))
    for r in held:
        upto = [x["v"] for x in held if x["k"] == r["k"] and (x["d"], x["i"]) <= (r["d"], r["i"]) and x["v"] is not None]
        assert got[r["i"]] == (len(upto), pytest.approx(sum(upto)) if upto else None)


def test_drift_of_a_long_key(spark):
    x = np.random.default_rng(3).normal(size=6000)
    df = spark.createDataFrame([(i // 40, i, float(v)) for i, v in enumerate(x)], "d int, i int, v double")
    got = {r["i"]: r["drift"] for r in causal.drift(df, "d", ["i"], "v", 20.0, 100, 50.0).collect()}
    for i in (0, 39, 40, 100, 777, 5999):
        past = x[: i // 40 * 40][-100:]
        weight = 0.5 ** (np.arange(len(past), 0, -1) / 20 - 1 / 20)
        assert got[i] == pytest.approx(float((past * weight).sum() / (weight.sum() + 50)), abs=1e-12)


@pytest.mark.parametrize("fan", [2, 3, 16])
def test_medians_of_earlier_days(table, fan, monkeypatch):
    monkeypatch.setattr(order, "FAN", fan)
    held = table.collect()
    got = {(r["k"], r["d"]): (r["_median"], r["_seen"]) for r in order.medians_before(table.unionByName(table.limit(1).withColumn("d", F.lit(None).cast("int"))), ["k"], "d", "v").collect()}
    assert got.keys() == {(r["k"], r["d"]) for r in held}
    for (k, d), (median, seen) in got.items():
        past = [r["v"] for r in held if r["k"] == k and r["d"] < d and r["v"] is not None]
        assert (median, seen) == (pytest.approx(float(np.median(past))) if past else None, len(past))
    assert order.medians_before(table.where("false"), ["k"], "d", "v").count() == 0


def test_medians_of_a_long_key(spark):
    """A key of 50,000 days, each with a value of its own: a growing frame would look at 1.25 billion values."""
    n = 50_000
    df = spark.range(n).select(F.col("id").cast("int").alias("d"), (F.pmod(F.xxhash64("id"), F.lit(1_000_000_007)) / 7).alias("v"), F.lit(1).alias("k"))
    held = np.array([r["v"] for r in df.orderBy("d").collect()])
    got = {r["d"]: r["median_before"] for r in causal.median_to_date(df, ["k"], "d", "v").where("d % 997 = 0 or d < 12").collect()}
    for d, median in got.items():
        assert median == (None if d < 5 else pytest.approx(float(np.median(held[:d])), rel=1e-12))


def test_role_without_earlier_days(spark):
    df = spark.createDataFrame([("a", 1, 24.0), ("a", 2, 36.0), ("a", 2, None), ("a", 3, 60.0), ("a", 4, 12.0)], "k string, d int, m double").withColumn("base", F.lit(0.25))
    got = {(r["d"], r["m"]): (r["role"], r["median_role"]) for r in causal.role_to_date(df, ["k"], "d", "m", "base", cap=0.8).collect()}
    assert got == {(1, 24.0): (0.25, 0.25), (2, 36.0): (0.5, 0.5), (2, None): (0.5, 0.5), (3, 60.0): (0.625, 0.625), (4, 12.0): (0.8, 0.75)}
