"""Snapshot state that ends (X01-X07): one state per key with a timer at its own deadline.

A key's state has one slot for each kind of snapshot. Slots are decided by the time of a snapshot, never by its arrival, so any
order of arrival gives what `snapshots.pregame_state` gives on the whole table. When the watermark reaches the deadline of the
latest snapshot, the key comes out once, in append mode, and its state is removed. A deadline that moves takes the timer with
it. Snapshots at or after their own deadline change no slot.

A snapshot later than the watermark is dropped by Spark before it gets here; one of a key that already came out has its
deadline behind the watermark and opens nothing. A key of which only such snapshots were ever seen does not come out.
State lives in RocksDB (`STORE`), which timers need.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The store that has to be set before a stream with timers starts.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: Slots, whether the latest snapshot fills them (else the earliest one), and the flag that a snapshot needs.
SLOTS = {"pre": (True, None), "first": (False, "snap_first"), "lock": (False, "snap_lock"), "first_total": (False, "snap_first_total"), "lock_total": (False, "snap_lock_total")}
_FLAGS = [f for _, f in SLOTS.values() if f]


def _micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


class _Deadlines(StatefulProcessor):
    """values: names and types of the columns that a slot keeps."""

    def __init__(self, key: Sequence[str], values: Sequence[T.StructField]):
        self.key, self.values = list(key), list(values)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        order = [T.StructField("snap_at", T.LongType()), T.StructField("snap_tie", T.LongType())]
        self.slots = {s: handle.getValueState(s, T.StructType([*order, *self.values])) for s in SLOTS}
        # deadline and its snapshot, first seen, what was missing then, accepted
        self.game = handle.getValueState("game", "tip long, at long, tie long, seen long, seen_tie long, note string, accepted long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        game = self.game.get()
        slots = {s: v.get() for s, v in self.slots.items()}
        old = dict(slots)
        before = game[0] if game else None
        for chunk in rows:
            for r in chunk.astype(object).where(chunk.notna(), None).to_dict("records"):
                at, tie, tip = int(r["snap_at"]), int(r["snap_tie"]), int(r["snap_tip"])
                if at >= tip:
                    continue
                g = game or (tip, at, tie, at, tie, r["snap_note"], 0)
                latest, earliest = (at, tie) >= g[1:3], (at, tie) <= g[3:5]
                game = (tip if latest else g[0], *((at, tie) if latest else g[1:3]), *((at, tie, r["snap_note"]) if earliest else g[3:6]), g[6] + 1)
                row = (at, tie, *(r[f.name] for f in self.values))
                for s, (last, flag) in SLOTS.items():
                    if (flag is None or r[flag]) and (slots[s] is None or (row[:2] > tuple(slots[s][:2])) == last):
                        slots[s] = row
        if game:
            for s, row in slots.items():
                if row is not old[s]:
                    self.slots[s].update(row)
            self.game.update(game)
            if before != game[0]:
                if before is not None:
                    self.handle.deleteTimer(before // 1000)
                self.handle.registerTimer(game[0] // 1000)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        game = self.game.get()
        if game is None or game[0] // 1000 > expiredTimerInfo.getExpiryTimeInMs():
            yield pd.DataFrame()
            return
        out = dict(zip(self.key, key, strict=True)) | {"tip": pd.Timestamp(game[0], unit="us"), "first_seen": pd.Timestamp(game[3], unit="us"), "seen_note": game[5], "accepted": game[6]}
        for s, state in self.slots.items():
            row = state.get()
            out[s] = None if row is None else {f.name: v for f, v in zip(self.values, row[2:], strict=True)} | {"at": pd.Timestamp(row[0], unit="us")}
            state.clear()
        self.game.clear()
        yield pd.DataFrame([out])

    def close(self) -> None:
        pass


def deadline_ledger(
    rows: DataFrame, key: Sequence[str], ts: str, tip: str, values: Sequence[str], tie: str, usable: Column, stale: Column | None = None, total_ready: Column | None = None, note: Column | None = None,
    hours: int = 5, lateness: str = "0 seconds",
) -> DataFrame:
    """X01-X05 as a stream: one row for each key once its deadline is behind the watermark, with the slots of SLOTS (null where no snapshot
    was fit), the time of the first snapshot and what it lacked. tie orders snapshots of one time; lateness: how far out of order they arrive."""
    fresh = ~F.coalesce(stale, F.lit(False)) if stale is not None else F.lit(True)
    ok, total = F.coalesce(usable, F.lit(False)), F.coalesce(total_ready, F.lit(False)) if total_ready is not None else F.lit(False)
    in_lock = fresh & (F.col(ts) >= F.col(tip) - F.expr(f"interval {hours} hours"))
    why = note if note is not None else F.when(ok, "").otherwise("not usable")
    flags = dict(zip(_FLAGS, (ok, ok & in_lock, total, total & in_lock), strict=True))
    named = rows.withWatermark(ts, lateness).select(ts, *key, *values, _micros(ts).alias("snap_at"), _micros(tip).alias("snap_tip"), F.col(tie).cast("long").alias("snap_tie"), why.alias("snap_note"), *(c.alias(n) for n, c in flags.items()))
    fields = [T.StructField(v, rows.schema[v].dataType) for v in values]
    slot = T.StructType([*fields, T.StructField("at", T.TimestampType())])
    out = T.StructType([*(T.StructField(k, rows.schema[k].dataType) for k in key), T.StructField("tip", T.TimestampType()), T.StructField("first_seen", T.TimestampType()), T.StructField("seen_note", T.StringType()), T.StructField("accepted", T.LongType()), *(T.StructField(s, slot) for s in SLOTS)])
    return named.where("snap_at is not null and snap_tip is not null").groupBy(*key).transformWithStateInPandas(_Deadlines(key, fields), out, "append", "eventtime")


class _Kinds(StatefulProcessor):
    """Two sets a key: that of the first fetch and that of the last one."""

    def __init__(self, key: Sequence[str], values: Sequence[T.StructField]):
        self.key, self.values = list(key), list(values)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sets = {k: handle.getListState(k, T.StructType([T.StructField("snap_at", T.LongType()), *self.values])) for k in ("first", "pre")}
        self.game = handle.getValueState("game", "first long, pre long, tip long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        game = self.game.get()
        before = game[2] if game else None
        first, pre, tip = game or (None, None, None)
        new: dict[str, list] = {"first": [], "pre": []}
        for chunk in rows:
            for r in chunk.astype(object).where(chunk.notna(), None).to_dict("records"):
                at = int(r["snap_at"])
                if at >= int(r["snap_tip"]):
                    continue
                row = (at, *(r[f.name] for f in self.values))
                if pre is None or at >= pre:
                    tip = int(r["snap_tip"])
                first, pre = at if first is None else min(at, first), at if pre is None else max(at, pre)
                new["first"].append(row)
                new["pre"].append(row)
        if first is None:
            yield pd.DataFrame()
            return
        for kind, at in (("first", first), ("pre", pre)):
            kept = [x for x in new[kind] if x[0] == at]
            if game and game[0 if kind == "first" else 1] == at:
                if kept:
                    self.sets[kind].appendList(kept)
            elif kept:
                self.sets[kind].put(kept)
        self.game.update((first, pre, tip))
        if before != tip:
            if before is not None:
                self.handle.deleteTimer(before // 1000)
            self.handle.registerTimer(tip // 1000)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        game = self.game.get()
        if game is None or game[2] // 1000 > expiredTimerInfo.getExpiryTimeInMs():
            yield pd.DataFrame()
            return
        out = []
        for kind, state in self.sets.items():
            out += [dict(zip(self.key, key, strict=True)) | {"kind": kind, "at": pd.Timestamp(row[0], unit="us")} | {f.name: v for f, v in zip(self.values, row[1:], strict=True)} for row in state.get()]
            state.clear()
        self.game.clear()
        yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def two_kind_ledger(rows: DataFrame, key: Sequence[str], ts: str, tip: str, values: Sequence[str], lateness: str = "0 seconds") -> DataFrame:
    """X07 as a stream: the members of the first and of the last fetch before the deadline, once it is behind the watermark. State is two
    fetches a key, however many there were."""
    named = rows.withWatermark(ts, lateness).select(ts, *key, *values, _micros(ts).alias("snap_at"), _micros(tip).alias("snap_tip")).where("snap_at is not null and snap_tip is not null")
    fields = [T.StructField(v, rows.schema[v].dataType) for v in values]
    out = T.StructType([*(T.StructField(k, rows.schema[k].dataType) for k in key), T.StructField("kind", T.StringType()), T.StructField("at", T.TimestampType()), *fields])
    return named.groupBy(*key).transformWithStateInPandas(_Kinds(key, fields), out, "append", "eventtime")


def live_quotes(states: DataFrame, quotes: DataFrame, key: Sequence[str], at: str, quoted: str, seconds: int, lateness: str = "0 seconds") -> DataFrame:
    """X15 as a stream: each state with the quotes of its key made within so many seconds before it, and the state alone (quote columns
    null) once the watermark says that none can come any more. Both sides are kept no longer than the range needs."""
    on = [F.col(f"s.{k}") == F.col(f"q.{k}") for k in key]
    near = (F.col(f"q.{quoted}") <= F.col(f"s.{at}")) & (F.col(f"q.{quoted}") > F.col(f"s.{at}") - F.expr(f"interval {seconds} seconds"))
    s, q = states.withWatermark(at, lateness).alias("s"), quotes.withWatermark(quoted, lateness).alias("q")
    joined = s.join(q, [*on, near], "left_outer")
    return joined.select("s.*", *(F.col(f"q.{c}") for c in quotes.columns if c not in key))


def graded_stream(ledger: DataFrame, results: DataFrame, key: str, tip: str, ended: str, days: int, lateness: str = "0 seconds") -> DataFrame:
    """X09 as a stream: a closed row of the ledger with its result, which comes within so many days of the deadline; without one, the row
    alone after that time."""
    near = (F.col(f"r.{ended}") >= F.col(f"l.{tip}")) & (F.col(f"r.{ended}") <= F.col(f"l.{tip}") + F.expr(f"interval {days} days"))
    left, right = ledger.withWatermark(tip, lateness).alias("l"), results.withWatermark(ended, lateness).alias("r")
    return left.join(right, [F.col(f"l.{key}") == F.col(f"r.{key}"), near], "left_outer").select("l.*", *(F.col(f"r.{c}") for c in results.columns if c != key))
