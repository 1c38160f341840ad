"""Captures that prove what they rest on (X10), and the proof read again.

An estimate of a game is a share of earlier members, pulled to a prior. Its evidence is the canonical JSON of those members and of the terms of
the estimate, named by its digest, so equal evidence is one row and changed evidence is another. A capture carries that name and is itself
named by the digest of what it says, not of when it was taken. Evidence is written before the captures that name it: what is
interrupted leaves evidence without a capture, never the reverse.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.tables import exists, stored
from ..sources.feeds import append_by_id

#: A member of an estimate, in this order of fields.
MEMBERS = "array<struct<day:bigint,game:string,won:bigint>>"
_PROOF = f"struct<pseudo:double,prior:double,members:{MEMBERS}>"


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def member(day: str, game: str, won: str) -> Column:
    return F.struct(F.col(day).cast("long").alias("day"), F.col(game).cast("string").alias("game"), F.col(won).cast("long").alias("won"))


def proofs(members: DataFrame, key: str, day: str, game: str, won: str, pseudo: float, prior: float) -> DataFrame:
    """Rows (key, evidence_id, evidence, games, wins, chance): the members of each key, ordered by day and game, as canonical JSON. A key's members
    are one row, so they have to be a window of a stated size."""
    return proofs_of(members.groupBy(key).agg(F.array_sort(F.collect_list(member(day, game, won))).alias("members")), key, pseudo, prior)


def proofs_of(m: DataFrame, key: str, pseudo: float, prior: float) -> DataFrame:
    """`proofs` of rows (key, members) whose members are already arrays in order, so that they are not moved once more."""
    m = m.withColumn("evidence", F.to_json(F.struct(F.lit(float(pseudo)).alias("pseudo"), F.lit(float(prior)).alias("prior"), F.col("members"))))
    games, wins = F.size("members").cast("long"), F.aggregate("members", F.lit(0).cast("long"), lambda a, x: a + x["won"])
    return m.select(key, digest(F.col("evidence")).alias("evidence_id"), "evidence", games.alias("games"), wins.alias("wins"), ((wins + pseudo * prior) / (games + pseudo)).alias("chance"))


def identity(df: DataFrame, said: Sequence[str]) -> Column:
    """Digest of what a capture says; JSON keeps nulls, so a missing value is not another's absence."""
    return digest(F.to_json(F.struct(*said), {"ignoreNullFields": "false"}))


def captures(forecasts: DataFrame, proved: DataFrame, key: str, said: Sequence[str], forecast_at: str, tip: str, now: Column, usable: Column) -> DataFrame:
    """Rows (capture_id, said, evidence_id, games, wins, chance, captured): forecasts that exist, that were made before now and whose game has not
    begun, with an estimate of at least one member."""
    open_ = (F.col(forecast_at) <= now) & (now < F.col(tip)) & usable & (F.col("games") > 0)
    j = forecasts.join(proved.drop("evidence"), key).where(open_)
    told = [*said, "evidence_id", "games", "wins", "chance"]
    return j.select(identity(j, told).alias("capture_id"), *told, now.alias("captured"))


def _table(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def record(taken: DataFrame, proved: DataFrame, path: str, tip: str, clock) -> int:
    """Append evidence, then captures that are still before their tip by the clock after that write; equal ones are left out, and one name with other
    contents raises. clock: () -> a timestamp column. Returns how many captures are new."""
    spark = taken.sparkSession
    taken = stored(taken, "captures", "zstd")
    # names that are already there hold equal evidence by their digest
    proofs_ = proved.join(taken.select("evidence_id").distinct(), "evidence_id", "left_semi").select("evidence_id", "evidence")
    old = _table(spark, f"{path}/evidence", proofs_.schema)
    append_by_id(old, proofs_, "evidence_id").write.mode("append").parquet(f"{path}/evidence", compression="zstd")
    late = taken.where(clock() < F.col(tip))
    written = Observation()
    new = append_by_id(_table(spark, f"{path}/captures", late.schema), late, "capture_id", ["captured"]).observe(written, F.count(F.lit(1)).alias("n"))
    new.write.mode("append").parquet(f"{path}/captures", compression="zstd")
    return written.get["n"]


def verify(taken: DataFrame, evidence: DataFrame, said: Sequence[str], slate: str, forecast_at: str, tip: str, tolerance: float = 1e-9) -> DataFrame:
    """Rows (id, rule) of every capture and evidence that does not hold: names that are not the digests of their contents or not unique, evidence
    that is missing or that is out of order, repeats a game or is not strictly earlier than its slate, figures that are not those of the members, and
    captures that were not taken between forecast and tip."""
    e = evidence.withColumn("proof", F.from_json("evidence", _PROOF)).withColumn("members", F.col("proof.members"))
    broken = lambda d, id_, rule, when: d.where(when).select(F.col(id_).alias("id"), F.lit(rule).alias("rule"))
    games = F.transform("members", lambda x: x["game"])
    out = [
        broken(e, "evidence_id", "evidence digest", ~F.col("evidence_id").eqNullSafe(digest(F.col("evidence")))),
        broken(e, "evidence_id", "evidence text", F.col("members").isNull() | (F.to_json("proof") != F.col("evidence"))),
        broken(e, "evidence_id", "evidence order", F.array_sort("members") != F.col("members")),
        broken(e, "evidence_id", "repeated game", F.size(F.array_distinct(games)) != F.size("members")),
        broken(evidence.groupBy("evidence_id").agg(F.count("*").alias("n")), "evidence_id", "evidence twice", F.col("n") > 1),
        broken(taken.groupBy("capture_id").agg(F.count("*").alias("n")), "capture_id", "capture twice", F.col("n") > 1),
        broken(taken, "capture_id", "capture time", ~F.coalesce((F.col(forecast_at) <= F.col("captured")) & (F.col("captured") < F.col(tip)), F.lit(False))),
        broken(taken, "capture_id", "capture digest", ~F.col("capture_id").eqNullSafe(identity(taken, [*said, "evidence_id", "games", "wins", "chance"]))),
    ]
    one = e.groupBy("evidence_id").agg(F.first("proof").alias("proof"))
    j = taken.select("capture_id", "evidence_id", F.col(slate).alias("_slate"), "games", "wins", "chance").join(one, "evidence_id", "left")
    wins = F.aggregate("proof.members", F.lit(0).cast("long"), lambda a, x: a + x["won"])
    n = F.size("proof.members")
    chance = (wins + F.col("proof.pseudo") * F.col("proof.prior")) / (n + F.col("proof.pseudo"))
    out += [
        broken(j, "capture_id", "no evidence", F.col("proof").isNull()),
        broken(j, "capture_id", "not earlier", F.exists("proof.members", lambda x: x["day"] >= F.col("_slate"))),
        broken(j, "capture_id", "figures", (n != F.col("games")) | (wins != F.col("wins")) | (F.abs(chance - F.col("chance")) > tolerance)),
    ]
    rows = out[0]
    for part in out[1:]:
        rows = rows.unionByName(part)
    return rows


def official(taken: DataFrame, game: str, forecast_at: str, tip: str, hours: int = 5) -> DataFrame:
    """The first capture of each game inside the hours before its tip whose forecast is as fresh; ties go to the smaller name."""
    since = F.col(tip) - F.expr(f"interval {hours} hours")
    fit = (F.col("captured") >= since) & (F.col("captured") < F.col(tip)) & (F.col(forecast_at) >= since) & (F.col(forecast_at) <= F.col("captured"))
    order = Window.partitionBy(game).orderBy("captured", "capture_id")
    return taken.where(fit).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def canonical(value: object) -> str:
    """The JSON text that `proofs` writes, for callers outside Spark."""
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False)
