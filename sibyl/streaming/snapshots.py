"""Snapshot state with a deadline (X01-X16), the same code in batch and in Structured Streaming.

State of a key is an aggregation over its snapshots: the latest row before the deadline, the first usable row, the
first row inside the lock window. Spark keeps such aggregates as streaming state, so `pregame_state` runs on a
static or a streaming frame; a snapshot at or after its deadline (a column of the row, not a fixed lateness) is
dropped before the aggregation, whatever order rows arrive in.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prices import brier, log_loss, position, unit_profit
from ..operators.joins import as_of
from ..operators.scope import replaced


def _slot(pick, values: Sequence[str], ts: str, when: Column, tie: str) -> Column:
    row = F.when(when, F.struct(*(F.col(v) for v in values), F.col(ts)))
    order = F.when(when, F.struct(F.col(ts), F.col(tie)))
    return pick(row, order)


def pregame_state(rows: DataFrame, key: Sequence[str], ts: str, tip: str, values: Sequence[str], tie: str, usable: Column, stale: Column | None = None, hours: int = 5, graded: Column | None = None) -> DataFrame:
    """For each key the latest snapshot before the tip (pre), the first usable one (first), the first usable one inside
    the hours before the tip with fresh sources (lock), when it was first seen, and how many came too late."""
    t, end = F.col(ts), F.col(tip)
    open_ = t < end
    if graded is not None:
        open_ = open_ & ~F.coalesce(graded, F.lit(False))
    fresh = ~F.coalesce(stale, F.lit(False)) if stale is not None else F.lit(True)
    window = open_ & usable & fresh & (t >= end - F.expr(f"interval {hours} hours"))
    return rows.groupBy(*key).agg(
        _slot(F.max_by, values, ts, open_, tie).alias("pre"), _slot(F.min_by, values, ts, open_ & usable, tie).alias("first"), _slot(F.min_by, values, ts, window, tie).alias("lock"),
        F.min(F.when(open_, t)).alias("first_seen"), F.count_if(~open_).alias("rejected"), F.count_if(open_).alias("accepted"),
    )


def totals_state(rows: DataFrame, key: Sequence[str], ts: str, tip: str, values: Sequence[str], tie: str, ready: Column, hours: int = 5) -> DataFrame:
    """First and lock slots of totals, on their own readiness test."""
    s = pregame_state(rows, key, ts, tip, values, tie, ready, hours=hours)
    return s.select(*key, F.col("first").alias("first_total"), F.col("lock").alias("lock_total"))


def notes(state: DataFrame) -> DataFrame:
    """Why a slot is empty."""
    why = F.concat_ws("; ", F.when(F.col("pre").isNull(), "nothing before the deadline"), F.when(F.col("first").isNull(), "no usable snapshot"), F.when(F.col("lock").isNull(), "lock window missed"))
    return state.withColumn("note", why)


def latest_valid_set(rows: DataFrame, key: Sequence[str], ts: str, tip: str, ok: str, member: str) -> DataFrame:
    """Members of the latest successful fetch before the tip. A failed fetch keeps the one before; an empty but valid one (a row
    whose member is null) replaces it."""
    good = rows.where(F.col(ok) & (F.col(ts) < F.col(tip)))
    last = good.groupBy(*key).agg(F.max(ts).alias(ts))
    return good.join(last, [*key, ts], "left_semi").where(F.col(member).isNotNull())


def two_kinds(rows: DataFrame, key: Sequence[str], ts: str, tip: str) -> DataFrame:
    """The set of the first snapshot (kept once) and of the last one (replaced each time) before the tip."""
    early = rows.where(F.col(ts) < F.col(tip))
    ends = early.groupBy(*key).agg(F.min(ts).alias("_a"), F.max(ts).alias("_b"))
    j = early.join(ends, list(key))
    kind = F.explode(F.filter(F.array(F.when(F.col(ts) == F.col("_a"), F.lit("first")), F.when(F.col(ts) == F.col("_b"), F.lit("pre"))), lambda x: x.isNotNull()))
    return j.withColumn("kind", kind).drop("_a", "_b")


def frozen_upsert(old: DataFrame, new: DataFrame, key: Sequence[str], ts: str, start: str) -> DataFrame:
    """Rows of a key are replaced until their start; for use in foreachBatch."""
    return replaced(old, new.where(F.col(ts) < F.col(start)), key)


def apply_results(ledger: DataFrame, results: DataFrame, key: str, outcome: Sequence[str], close: Sequence[str] = (), usable: Column | None = None) -> DataFrame:
    """Outcome and close, each written once and as a whole. outcome: columns whose first one says that there is a result. close: columns
    of one book, the first one its moneyline price or chance; all of them come from one row of results, and only if `usable` (of results' columns)
    holds for that price, so a spread never stands beside another book's price or none. A row without a result takes no close."""
    r = results.select(key, F.struct(*outcome).alias("_result"), F.struct(*close).alias("_close") if close else F.lit(None).alias("_close"), F.coalesce(usable, F.lit(False)).alias("_usable") if usable is not None else F.lit(False).alias("_usable"))
    j = ledger.join(r, key, "left")
    finished = F.col(f"_result.{outcome[0]}").isNotNull()
    take = F.col(outcome[0]).isNull() & finished
    out = j.withColumns({c: F.when(take, F.col(f"_result.{c}")).otherwise(F.col(c)) for c in outcome})
    if close:
        fresh = F.col(close[0]).isNull() & F.col("_usable") & finished
        out = out.withColumn("_fresh", fresh).withColumns({c: F.when(F.col("_fresh"), F.col(f"_close.{c}")).when(F.col(close[0]).isNotNull(), F.col(c)) for c in close})
    return out.select(*ledger.columns)


def new_only(rows: DataFrame, logged: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose key is not in the log yet (write-once append; pending work)."""
    return rows.join(logged.select(*key), list(key), "left_anti")


def due(schedule: DataFrame, state: DataFrame, key: str, tip: str, now: Column, hours: int = 5, refresh_minutes: int = 30) -> DataFrame:
    """Games that need a lock or a refresh now, and when their window opens."""
    j = schedule.join(state, key, "left")
    opens = F.col(tip) - F.expr(f"interval {hours} hours")
    lock = (now >= opens) & (now < F.col(tip)) & F.col("lock").isNull()
    refresh = (now < F.col(tip)) & (now >= F.col(tip) - F.expr(f"interval {refresh_minutes} minutes"))
    return j.select(key, lock.alias("needs_lock"), refresh.alias("needs_refresh"), F.when(now < opens, opens).alias("opens"))


def closed_slates(rows: DataFrame, slate: str, watermark: Column) -> DataFrame:
    """Rows of slates that no row can join any more."""
    return rows.where(F.col(slate) < F.to_date(watermark))


def live_track(states: DataFrame, quotes: DataFrame, key: Sequence[str], minute: str, chance: Column) -> DataFrame:
    """Win chance from the in-game state beside the quote of the same minute. Runs on streams with watermarks as well, as an
    equi-join on key and minute."""
    return states.withColumn("live", chance).join(quotes, [*key, minute])


def rescored_locks(ledger: DataFrame, done: DataFrame, reports: DataFrame, key: str, by: Sequence[str], tag: str, since: Column, scores: dict[str, Column]) -> DataFrame:
    """Rows (key, slate, lock_at, report_at, scores) of locks not rescored yet, each with what was known at its own time.

    Pending are rows with a lock (lock_at, seconds) whose tag ends in `tag`, of slates from `since` on, that `done` lacks. reports: (by, ts, ...), ts in seconds;
    the last one at or before the lock counts, its columns (null without one) and those of the ledger may be used in `scores`. Writing the rows once to
    `done` makes a second run find nothing.
    """
    open_ = new_only(ledger.where(F.col("lock_at").isNotNull() & F.col("tag").endswith(tag) & (F.col("slate") >= since)), done, [key])
    named = reports.withColumn("report_at", F.col("ts"))
    known = as_of(open_, named, by, "lock_at", "ts", [c for c in named.columns if c not in (*by, "ts")])
    return known.select(key, "slate", "lock_at", "report_at", *(x.alias(n) for n, x in scores.items()))


def forward_score(log: DataFrame, results: DataFrame, key: str, estimators: dict[str, str], won: str, home_ml: str, away_ml: str, market: str) -> DataFrame:
    """Rows (estimator, official, graded, pending, brier, loss, accuracy, bets, units, roi) of a log with its results (key, won).

    An estimator is a column of chances; it bets its side of positive value (P22) at the log's fixed prices. Log loss is infinite where a certainty is
    contradicted. One more row, favourite, bets on the side that the estimator `market` prefers in every graded game.
    """
    c = F.col
    j = log.join(results.where(c(won).isin(0, 1)).select(key, c(won).alias("_y")), key, "left")
    y = c("_y")
    bet = lambda side: F.when(side == "home", unit_profit(c(home_ml), y == 1)).when(side == "away", unit_profit(c(away_ml), y == 0))
    cell = lambda name, p, side: F.struct(F.lit(name).alias("estimator"), p.alias("p"), F.when(y.isNotNull(), side).alias("side"))
    favourite = F.when(c(market) >= 0.5, "home").when(c(market) < 0.5, "away")
    cells = F.array(*(cell(n, c(p), position(c(p), c(home_ml), c(away_ml))) for n, p in estimators.items()), cell("favourite", F.lit(None).cast("double"), favourite))
    long = j.select("_y", home_ml, away_ml, F.inline(cells)).withColumn("units", bet(c("side")))
    right = ((c("p") >= 0.5) == (y == 1)).cast("double")
    return long.groupBy("estimator").agg(
        F.count("*").alias("official"), F.count("_y").alias("graded"), F.count_if(y.isNull()).alias("pending"), F.avg(brier(c("p"), y)).alias("brier"), F.avg(log_loss(c("p"), y, None)).alias("loss"), F.avg(F.when(y.isNotNull(), right)).alias("accuracy"),
        F.count("side").alias("bets"), F.sum("units").alias("units"), (F.sum("units") / F.nullif(F.count("side"), F.lit(0))).alias("roi"),
    )


def start_state_stream(rows: DataFrame, name: str, checkpoint: str, build) -> object:
    """Run a state function over a stream of snapshots into an in-memory table (complete state after every trigger)."""
    return build(rows).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()


def start_upsert_stream(rows: DataFrame, path: str, checkpoint: str, key: Sequence[str], ts: str, start: str) -> object:
    """X08, X10 as a stream: every batch keeps the latest row of a key before its start. Each batch writes a new version; the pointer
    is the largest finished version, so a failed write leaves the last one."""

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        fresh = batch.where(F.col(ts) < F.col(start)).groupBy(*key).agg(F.max_by(F.struct(*batch.columns), ts).alias("x")).select("x.*")
        old = spark.read.schema(batch.schema).parquet(f"{path}/v{epoch - 1}") if epoch else spark.createDataFrame([], batch.schema)
        newer = old.unionByName(fresh).groupBy(*key).agg(F.max_by(F.struct(*batch.columns), ts).alias("x")).select("x.*")
        newer.write.mode("overwrite").parquet(f"{path}/v{epoch}")

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
