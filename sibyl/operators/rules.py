"""Rule sets of the stored tables (C01, C02, C04, C06), as constraints of one pass each.

Times come as text, as in the files, or as timestamps: text that is no time breaks a rule of its own slot instead of the query. Rules whose columns a
table does not have are left out, since older vintages lack them; `vintage` says which one a table is of.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prices import main_line
from .quality import Constraint, all_of, repeated_keys, violations

#: Positions of a salary table.
POSITIONS = ("PG", "SG", "SF", "PF", "C")
#: Minutes that a lock may be older than its window, for the time a capture takes.
GRACE_MINUTES = 1


def vintage(columns: Sequence[str], known: Mapping[str, Sequence[str]]) -> str | None:
    """The vintage with exactly these columns in this order; None: the table is of none."""
    return next((name for name, cols in known.items() if list(cols) == list(columns)), None)


def when_there(value: Column, holds: Column) -> Column:
    """True where there is no value, else whether the rule holds; a rule that is null does not hold."""
    return value.isNull() | F.coalesce(holds, F.lit(False))


def _time(name: str) -> Column:
    return F.try_to_timestamp(F.col(name).cast("string"))


def _share(name: str) -> Column:
    return F.col(name).between(0, 1)


def _made(df: DataFrame, rules: Iterable[tuple[str, Sequence[str], Column]]) -> list[Constraint]:
    have = set(df.columns)
    return [Constraint(name, holds, strict=True) for name, needs, holds in rules if have >= set(needs)]


def _within(at: str, hours: float) -> Column:
    return _time(at) >= _time("tip") - F.expr(f"INTERVAL {round(hours * 60) + GRACE_MINUTES} MINUTES")


def ledger_violations(df: DataFrame, key: str, books: Sequence[str], lock_hours: float = 5.0, widest: float = 60.0, first_games: int = 10) -> DataFrame:
    """Rows (key, rule) of a ledger.

    Columns, as far as there are any: tip, seen_at, first_at, pre_at, lock_at; book, q and spread of the slots pre, first, lock and close; exchange_q, p,
    first_p, lock_p, carry_p, first_carry_p, margin, home_won, gp_home, gp_away. A slot's time must be readable and before the tip, and seen,
    first, lock in this order, first before the latest snapshot too, the lock within its hours; a price needs a known book, a spread its own
    moneyline, a close or exchange price a result; shares lie in 0..1; a margin needs its chance, on the same side of a half.
    """
    c = F.col
    rules = [
        *((f"{s}_at before the tip", [f"{s}_at", "tip"], when_there(c(f"{s}_at"), _time(f"{s}_at") < _time("tip"))) for s in ("seen", "first", "pre", "lock")),
        ("seen before first", ["seen_at", "first_at"], when_there(_time("seen_at"), when_there(_time("first_at"), _time("seen_at") <= _time("first_at")))),
        ("first before the latest", ["first_at", "pre_at"], when_there(_time("first_at"), when_there(_time("pre_at"), _time("first_at") <= _time("pre_at")))),
        ("lock after first", ["lock_at", "first_at"], when_there(c("lock_at"), _time("lock_at") >= _time("first_at"))),
        ("lock in its window", ["lock_at", "tip"], when_there(c("lock_at"), _within("lock_at", lock_hours))),
        *((f"{s}_book known", [f"{s}_book", on], when_there(c(on), c(f"{s}_book").isin(*books))) for s, on in (("pre", "pre_q"), ("close", "close_q"), ("first", "first_at"), ("lock", "lock_at"))),
        *((f"{s}_spread beside its moneyline", [f"{s}_spread", f"{s}_q"], when_there(c(f"{s}_spread"), c(f"{s}_q").isNotNull())) for s in ("pre", "first", "lock", "close")),
        ("exchange_q inside 0..1", ["exchange_q"], when_there(c("exchange_q"), (c("exchange_q") > 0) & (c("exchange_q") < 1))),
        ("exchange_q with a result", ["exchange_q", "home_won"], when_there(c("exchange_q"), c("home_won").isNotNull())),
        ("home_won 0 or 1", ["home_won"], when_there(c("home_won"), c("home_won").isin(0, 1))),
        *((f"{p} in 0..1", [p], when_there(c(p), _share(p))) for p in ("p", "first_p", "carry_p", "first_carry_p")),
        ("lock_p beside its lock", ["lock_at", "lock_p"], when_there(c("lock_at"), _share("lock_p"))),
        *((f"{p} in the first games", [p, "gp_home", "gp_away"], when_there(c(p), F.least("gp_home", "gp_away") < first_games)) for p in ("carry_p", "first_carry_p")),
        ("margin beside p", ["margin", "p"], when_there(c("margin"), c("p").isNotNull())),
        ("margin in range", ["margin"], when_there(c("margin"), F.abs("margin") <= widest)),
        ("margin and p agree", ["margin", "p"], when_there(c("margin"), (c("margin") == 0) | c("p").isNull() | ((c("margin") > 0) == (c("p") > 0.5)))),
    ]
    return all_of(violations(df, key, _made(df, rules)), repeated_keys(df, [key], f"{key} once"))


def totals_violations(df: DataFrame, key: str, books: Sequence[str], lock_hours: float = 5.0) -> DataFrame:
    """Rows (key, rule) of the totals slots first and lock: time, book, share over, total and line together, a line near even prices, the lock in
    its window and not before the first, and a closing line only with a result. Columns: tip, home_won, close_line and of each slot at, book,
    p_over, total, line, over, under, with ou_ between slot and name (first_ou_at)."""
    c = F.col
    rules = []
    for s in ("first", "lock"):
        n = lambda x, s=s: f"{s}_ou_{x}"
        rules += [
            (f"{n('at')} before the tip", [n("at"), "tip"], when_there(c(n("at")), _time(n("at")) < _time("tip"))),
            (f"{n('book')} known", [n("at"), n("book")], when_there(c(n("at")), c(n("book")).isin(*books))),
            (f"{n('p_over')} with total and line", [n("at"), n("p_over"), n("total"), n("line")], when_there(c(n("at")), _share(n("p_over")) & c(n("total")).isNotNull() & c(n("line")).isNotNull())),
            (f"{n('line')} is the main line", [n("at"), n("over"), n("under")], when_there(c(n("at")), main_line(c(n("over")), c(n("under"))))),
        ]
    rules += [
        ("lock_ou in its window", ["lock_ou_at", "tip"], when_there(c("lock_ou_at"), _within("lock_ou_at", lock_hours))),
        ("lock_ou after first_ou", ["lock_ou_at", "first_ou_at"], when_there(c("lock_ou_at"), _time("lock_ou_at") >= _time("first_ou_at"))),
        ("close_line with a result", ["close_line", "home_won"], when_there(c("close_line"), c("home_won").isNotNull())),
    ]
    return violations(df, key, _made(df, rules))


def salary_violations(df: DataFrame, slate: str = "slate", player: str = "player", positions: Sequence[str] = POSITIONS) -> DataFrame:
    """Rows (key, rule) of a salary table; the key is slate|player. One row a player and slate, a known position, whole positive salary and cap, and
    a readable start. Numbers may be text."""
    number = lambda x: F.expr(f"try_cast(`{x}` AS double)")
    whole = lambda x: (number(x) > 0) & (number(x) % 1 == 0)
    rules = [
        ("position known", ["position"], F.col("position").isin(*positions)),
        *((f"{x} whole and positive", [x], whole(x)) for x in ("salary", "cap")),
        ("start readable", ["start_at"], _time("start_at").isNotNull()),
    ]
    keyed = df.withColumn("_key", F.concat_ws("|", F.col(slate).cast("string"), F.col(player).cast("string")))
    return all_of(violations(keyed, "_key", _made(df, rules)), repeated_keys(df, [slate, player], "once a slate"))


def rescore_violations(rescored: DataFrame, ledger: DataFrame, key: str, tag: str, earlier: Sequence[str], since: str, voided: Sequence[str] = (), rest_most: int | None = None) -> DataFrame:
    """Rows (key, rule) of a log of rescored locks: one a game, its tag's ending, a share and a total, no slate before `since`, no voided lock, days
    of rest in bounds, no report later than the lock, and a lock of the ledger at the same time under an earlier tag. Columns:
    key, slate, tag, p_over, total, lock_at, report_at and, if any, rest; of the ledger: key, lock_at, tag."""
    c = F.col
    ends = F.lit(False)
    for e in earlier:
        ends = ends | c("tag").endswith(e)
    lock = _time("lock_at")
    own = ledger.select(key, lock.alias("_lock"), F.coalesce(ends, F.lit(False)).alias("_ends"), (c("tag").isNull() & lock.isNull()).alias("_blank")).dropDuplicates([key])
    # only the times go through the join; what a row says by itself is judged where it is read
    timed = "lock_at" in rescored.columns
    joined = rescored.select(key, *([lock.alias("_at")] if timed else [])).join(own, key, "left")
    both = [("at the ledger's lock", ["_at"], F.coalesce("_blank", F.lit(True)) | (c("_ends") & (c("_lock") == c("_at")))), ("in the ledger", [], c("_blank").isNotNull())]
    rules = [
        ("tag", ["tag"], c("tag").endswith(tag)),
        ("share and total", ["p_over", "total"], _share("p_over") & c("total").isNotNull()),
        ("slate", ["slate"], c("slate").cast("date") >= F.lit(since).cast("date")),
        ("report before the lock", ["report_at", "lock_at"], when_there(c("report_at"), _time("report_at") <= _time("lock_at"))),
        *([("not voided", [key], ~c(key).cast("string").isin(*voided))] if voided else []),
        *([("rest", ["rest"], c("rest").between(0, rest_most))] if rest_most is not None else []),
    ]
    return all_of(violations(rescored, key, _made(rescored, rules)), violations(joined, key, _made(joined, both)), repeated_keys(rescored, [key], "once"))
