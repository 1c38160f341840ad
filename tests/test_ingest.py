"""Stored seasons, closed dates and guarded lookups: what is computed again, what is refused, and batches that run twice."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sibyl.sources import ingest

ROWS = [(2024, "a", 1.0), (2024, "b", 2.0), (2025, "a", 3.0), (2026, "c", 4.0)]


@pytest.fixture
def terms(spark, tmp_path):
    asked = []

    def call(rows=ROWS, parameters=None, running=2026, failed=()):
        df = spark.createDataFrame(rows, "season int, team string, v double")

        def compute(some):
            asked.append(sorted(r[0] for r in some.select("season").distinct().collect()))
            bad = spark.createDataFrame([(s,) for s in failed], "season int") if failed else None
            return some.groupBy("season").agg(F.sum("v").alias("v")), bad

        out = ingest.season_terms(df, "season", ["team", "v"], parameters or {"lead": 300}, f"file://{tmp_path}/terms", compute, running)
        return {r["season"]: r["v"] for r in out.collect()}

    return call, asked


def test_seasons_are_computed_once(terms):
    call, asked = terms
    want = {2024: 3.0, 2025: 3.0, 2026: 4.0}
    assert call() == want and call(list(reversed(ROWS))) == want
    assert asked == [[2024, 2025, 2026], [2026]]  # the running season is never stored


def test_changed_inputs_replace_their_season_alone(terms):
    call, asked = terms
    call(running=2027)
    assert call([(2024, "a", 9.0), *ROWS[1:]], running=2027) == {2024: 11.0, 2025: 3.0, 2026: 4.0}
    assert call([(2024, "a", 9.0), *ROWS[1:]], running=2027)[2024] == 11.0
    assert asked[1:] == [[2024]]
    assert call([*ROWS[:2], ROWS[1], *ROWS[2:]], running=2027)[2024] == 5.0  # a repeated row is another input
    call(parameters={"lead": 60}, running=2027)
    assert asked[2:] == [[2024], [2024, 2025, 2026]]


def test_failed_seasons_are_tried_again(terms):
    call, asked = terms
    assert call(running=2027, failed=[2025])[2025] == 3.0
    call(running=2027)
    assert asked == [[2024, 2025, 2026], [2025]]


def test_lookup_of_another_fit_is_refused(spark, tmp_path):
    path, meta = f"file://{tmp_path}/q", {"seasons": [2024, 2025], "leads": [60, 300], "rule": "x"}
    df = spark.createDataFrame([(60, "Out", 0.1), (300, "Out", 0.2)], "lead int, status string, rate double")
    ingest.write_lookup(df, path, meta)
    rows = ingest.read_lookup(spark, path, meta, "lead", [60, 300])
    assert [r["rate"] for r in ingest.nearest_lead(rows, "lead", 200).collect()] == [0.2]
    assert [r["rate"] for r in ingest.nearest_lead(rows, "lead", 180).collect()] == [0.1]
    for wrong in ({"seasons": [2025]}, {"rule": "y"}, {"leads": [60]}):
        with pytest.raises(ValueError, match="made for"):
            ingest.read_lookup(spark, path, meta | wrong)
    ingest.write_lookup(df.where("lead = 60"), path, meta)
    with pytest.raises(ValueError, match="leads"):
        ingest.read_lookup(spark, path, meta, "lead", [60, 300])


SCHEMA = "id int, day int, pending boolean, v string"


def run(spark, tmp_path, checkpoint="cp"):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ingest.start_ingest(stream, f"file://{tmp_path}/out", str(tmp_path / checkpoint), "day", "id", F.col("pending"), F.lit(9)).awaitTermination()
    rows = sorted((r["id"], r["v"]) for r in spark.read.parquet(f"file://{tmp_path}/out/rows").collect())
    return rows, sorted(r["day"] for r in spark.read.parquet(f"file://{tmp_path}/out/done").collect())


def put(spark, tmp_path, *rows):
    spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))


def test_dates_close(spark, tmp_path):
    put(spark, tmp_path, (1, 1, False, "a"), (2, 1, True, "wait"), (3, 2, False, "b"), (3, 2, False, "b"), (9, 9, False, "today"))
    assert run(spark, tmp_path) == ([(1, "a"), (3, "b")], [2])
    put(spark, tmp_path, (1, 1, False, "again"), (2, 1, False, "c"), (4, 2, False, "late for a closed day"))
    assert run(spark, tmp_path) == ([(1, "a"), (2, "c"), (3, "b")], [1, 2])
    assert run(spark, tmp_path) == ([(1, "a"), (2, "c"), (3, "b")], [1, 2])


def test_a_batch_that_runs_again_adds_nothing(spark, tmp_path):
    put(spark, tmp_path, (1, 1, False, "a"), (2, 1, False, "b"))
    first = run(spark, tmp_path)
    assert run(spark, tmp_path, "another checkpoint, so batch 0 runs again") == first
