"""Windows that read strictly earlier data.

"Earlier" means an earlier day: rows of the same day never see each other. Frames are ranges over day numbers, or
prefix sums read at the number of rows on earlier days. League-wide values are first summed by day, so that a
window without a partition key sees one row a day, and are then joined back.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import beside, medians_before, same


def day_number(date: Column) -> Column:
    return F.datediff(date, F.lit("1970-01-01").cast("date"))


def before_day(key: Sequence[str], day: str):
    """Frame of all rows of the key on earlier days; day is a day number."""
    return Window.partitionBy(*key).orderBy(day).rangeBetween(Window.unboundedPreceding, -1)


def days_back(key: Sequence[str], day: str, days: int):
    return Window.partitionBy(*key).orderBy(day).rangeBetween(-days, -1)


def earlier_rows(key: Sequence[str], order: Sequence[Column | str]):
    return Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def games_before(df: DataFrame, key: Sequence[str], day: str, order: Sequence[str]) -> DataFrame:
    """Rows on earlier days, and the ordinal inside the key."""
    return df.withColumns({"played": F.count("*").over(before_day(key, day)), "ordinal": F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1})


def before_days(df: DataFrame, key: Sequence[str], day: str, values: Sequence[Column | str] = ()) -> DataFrame:
    """One row for each key and day: `_c`, the rows of the key on earlier days, and `_d0`.. with the sums of values over them."""
    daily = df.groupBy(*key, day).agg(F.count("*").alias("_c"), *(F.sum(v).alias(f"_d{n}") for n, v in enumerate(values)))
    past = Window.partitionBy(*key).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    return daily.select(*key, day, F.coalesce(F.sum("_c").over(past), F.lit(0)).alias("_c"), *(F.coalesce(F.sum(f"_d{n}").over(past), F.lit(0.0)).alias(f"_d{n}") for n in range(len(values))))


def placed(df: DataFrame, key: Sequence[str], order: Sequence[str], values: Sequence[Column | str] = ()) -> DataFrame:
    """df with `_o`, the number of a row in its key from 1, and `_s0`.. with the sums of values up to and with the row.

    Sums by key and first column of the order (a day) are summed up over the days, and rows are numbered inside one key and day, so
    that no task holds a whole key. Nulls of key and day are keys and days of their own.
    """
    day, *rest = order
    inside = Window.partitionBy(*key, day).orderBy(*(rest or [day])).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = df.withColumns({"_i": F.count("*").over(inside)} | {f"_p{n}": F.coalesce(F.sum(v).over(inside), F.lit(0.0)) for n, v in enumerate(values)})
    joined = rows.alias("l").join(before_days(df, key, day, values).alias("r"), same([*key, day]))
    return joined.select(*(F.col(f"l.{c}") for c in df.columns), (F.col("_i") + F.col("_c")).alias("_o"), *((F.col(f"_p{n}") + F.col(f"_d{n}")).alias(f"_s{n}") for n in range(len(values))))


#: Half-lives of a block of decayed sums, and earlier blocks that still count: what is older has a weight below 2^-256.
BLOCK_HALF_LIVES, CARRIED = 64, 4


def decayed(df: DataFrame, key: Sequence[str], order: Sequence[str], values: Sequence[str], half_life: float, suffix: str = "_decayed", place: str | None = None) -> DataFrame:
    """Sum over prior rows of the key of value * 0.5^(rows ago / half_life).

    Rows of a key are cut into blocks of 64 half-lives. Inside a block the sum is 0.5^(i/h) times a prefix sum of x_k 2^(k/h), counted
    from the block's first row, so powers stay below 2^64 however many rows a key has; sums of whole blocks are carried on.
    Nulls count neither in the sum nor in the weight. place: a column that numbers the rows of a key from 1, if there is one.
    """
    size = math.ceil(BLOCK_HALF_LIVES * half_life)
    number = F.col(place) if place else F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    out = df.withColumn("_k", number - 1).withColumns({"_b": F.floor(F.col("_k") / size), "_i": F.col("_k") % size})
    grow = F.pow(F.lit(2.0), F.col("_i") / half_life)
    terms = {}
    for v in values:
        terms[v + suffix] = F.col(v) * grow
        terms[v + suffix + "_weight"] = F.when(F.col(v).isNotNull(), grow)
    sums = out.groupBy(*key, "_b").agg(*(F.coalesce(F.sum(t), F.lit(0.0)).alias(f"_s{n}") for n, t in enumerate(terms.values())))
    blocks = Window.partitionBy(*key).orderBy("_b")
    carry = lambda n: sum(F.coalesce(F.lag(f"_s{n}", j).over(blocks), F.lit(0.0)) * 0.5 ** (j * size / half_life) for j in range(1, CARRIED + 1))
    carried = sums.select(*key, "_b", *(carry(n).alias(f"_c{n}") for n in range(len(terms))))
    inside = Window.partitionBy(*key, "_b").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    back = F.pow(F.lit(0.5), (F.col("_i") - 1) / half_life)
    names = list(terms)
    joined = out.withColumns({f"_p{n}": F.coalesce(F.sum(t).over(inside), F.lit(0.0)) for n, t in enumerate(terms.values())}).alias("l").join(carried.alias("r"), [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*key, "_b"]])
    return joined.select(*(F.col(f"l.{c}") for c in df.columns), *((back * (F.col(f"_p{n}") + F.col(f"_c{n}"))).alias(name) for n, name in enumerate(names)))


def decayed_mean(df: DataFrame, key: Sequence[str], order: Sequence[str], value: str, half_life: float, name: str) -> DataFrame:
    """Decayed mean of prior non-null values (as of opponents' ratings)."""
    out = decayed(df, key, order, [value], half_life, "_d")
    return out.withColumn(name, F.when(F.col(f"{value}_d_weight") > 0, F.col(f"{value}_d") / F.col(f"{value}_d_weight"))).drop(f"{value}_d", f"{value}_d_weight")


def season_end(df: DataFrame, entity: Sequence[str], season: str, order: Sequence[str], value: str, half_life: float) -> DataFrame:
    """Decayed sum over the whole season, as read after its last row."""
    own = Window.partitionBy(*entity, season)
    k = F.row_number().over(own.orderBy(*order))
    ranked = df.withColumns({"_k": k, "_n": F.count("*").over(own)})
    return ranked.groupBy(*entity, season).agg(F.sum(F.col(value) * F.pow(F.lit(0.5), (F.col("_n") - F.col("_k")) / half_life)).alias("prior_end"))


def faded(df: DataFrame, entity: Sequence[str], season: str, order: Sequence[str], value: str, half_life: float, games: int = 10) -> DataFrame:
    """Decayed sum of this season plus last season's end value, decayed on and faded to nothing by game `games`.
    A season without the one before it has no carry (J20)."""
    current = decayed(df, [*entity, season], order, [value], half_life, "_c").withColumn("_i", F.row_number().over(Window.partitionBy(*entity, season).orderBy(*order)) - 1)
    last = season_end(df, entity, season, order, value, half_life).withColumn(season, F.col(season) + 1)
    rho = F.greatest(F.lit(0.0), 1 - F.col("_i") / games)
    carry = F.coalesce(rho * F.pow(F.lit(0.5), F.col("_i") / half_life) * F.col("prior_end"), F.lit(0.0))
    return current.join(last, [*entity, season], "left").withColumn("faded", F.col(f"{value}_c") + carry).drop(f"{value}_c", f"{value}_c_weight", "_i", "prior_end")


def recursive_decay(df: DataFrame, entity: Sequence[str], season: str, order: Sequence[str], value: str, half_life: float, across: bool) -> DataFrame:
    """One decay that restarts each season or carries on over seasons."""
    return decayed(df, [*entity] if across else [*entity, season], order, [value], half_life, "_prior")


def league_to_date(df: DataFrame, season: str, day: str, numerator: str, denominator: str, weight: float = 0.0) -> DataFrame:
    """Ratio of sums over earlier days of the season, with the last season's ratio as `weight` pseudo counts."""
    daily = df.groupBy(season, day).agg(F.sum(numerator).alias("_a"), F.sum(denominator).alias("_b"))
    past = Window.partitionBy(season).orderBy(day).rangeBetween(Window.unboundedPreceding, -1)
    sums = daily.withColumns({"_pa": F.coalesce(F.sum("_a").over(past), F.lit(0.0)), "_pb": F.coalesce(F.sum("_b").over(past), F.lit(0.0))})
    last = daily.groupBy(season).agg((F.sum("_a") / F.sum("_b")).alias("_last")).withColumn(season, F.col(season) + 1)
    filled = sums.join(F.broadcast(last), season, "left")  # one row a season
    use = F.when(F.col("_last").isNotNull(), F.lit(float(weight))).otherwise(0.0)
    level = F.when(F.col("_pb") + use > 0, (F.col("_pa") + use * F.coalesce("_last", F.lit(0.0))) / (F.col("_pb") + use))
    return df.join(filled.select(season, day, level.alias("league")), [season, day])


def blended_prior(value: Column, n: Column, prior: Column, k: float) -> Column:
    """Value weighted by n / (n + k), the prior for the rest."""
    return F.when(prior.isNull(), value).otherwise((F.coalesce(value, F.lit(0.0)) * n + prior * k) / (n + k))


def rest_days(df: DataFrame, key: Sequence[str], date: str, order: Sequence[str], cap: int = 7) -> DataFrame:
    """Days off before a row, capped; the first has the cap; back-to-back flag."""
    gap = F.datediff(F.col(date), F.lag(date).over(Window.partitionBy(*key).orderBy(*order))) - 1
    return df.withColumn("rest", F.coalesce(F.least(gap, F.lit(cap)), F.lit(cap))).withColumn("b2b", F.col("rest") == 0)


def presence_grid(games: DataFrame, members: DataFrame, group: Sequence[str]) -> DataFrame:
    """Every member of a group beside every game of it; bounded by the group's own size."""
    return games.join(members.select(*group, "member").distinct(), list(group))


def availability(grid: DataFrame, group: Sequence[str], order: Sequence[str], half_life: float, present: str = "present", role: str = "role", chance: str = "chance", more: Mapping[str, str] | None = None) -> DataFrame:
    """Decayed share of presence times role times (chance to play less that share), summed over a group's members for each game. more: further
    sums under other tables of values, name to role column, from the same shares."""
    seen = decayed(grid.withColumn("_one", F.col(present).cast("double")), [*group, "member"], order, ["_one"], half_life, "_d")
    share = F.when(F.col("_one_d_weight") > 0, F.col("_one_d") / F.col("_one_d_weight")).otherwise(0.0)
    term = lambda r: share * F.col(r) * (F.col(chance) - share)
    return seen.groupBy(*group, *order).agg(F.sum(term(role)).alias("availability"), F.sum(share * F.col(role)).alias("expected_role"), *(F.sum(term(r)).alias(n) for n, r in (more or {}).items()))


def totals_availability(sides: DataFrame, game: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Availability under each table of values summed over the two teams of a game; null unless both are there."""
    both = F.count("*") == 2
    return sides.groupBy(*game).agg(*(F.when(both, F.sum(v)).alias(f"total_{v}") for v in values))


def role_to_date(df: DataFrame, key: Sequence[str], day: str, minutes: str, fallback: str, cap: float = 1.0) -> DataFrame:
    """Mean and median of minutes / 48 on earlier days, capped; without any, the fallback."""
    seen = beside(df, medians_before(df, key, day, minutes), [*key, day], ["_median"])
    mean = F.avg(minutes).over(before_day(key, day)) / 48
    capped = lambda v: F.least(F.coalesce(v, F.col(fallback)), F.lit(cap))
    return seen.withColumns({"role": capped(mean), "median_role": capped(F.col("_median") / 48)}).drop("_median")


def on_off(df: DataFrame, key: Sequence[str], day: str, on: str, value: str, shrink: float) -> DataFrame:
    """Mean with less mean without, on earlier days, each shrunk to the whole by `shrink` rows."""
    past = before_day(key, day)
    total = lambda c: F.coalesce(F.sum(c).over(past), F.lit(0.0))
    n1, n0 = total(F.col(on).cast("double")), total(1 - F.col(on).cast("double"))
    s1, s0 = total(F.when(F.col(on), F.col(value)).otherwise(0.0)), total(F.when(~F.col(on), F.col(value)).otherwise(0.0))
    mean = F.when(n1 + n0 > 0, (s1 + s0) / (n1 + n0)).otherwise(0.0)
    return df.withColumn("on_off", (s1 + shrink * mean) / (n1 + shrink) - (s0 + shrink * mean) / (n0 + shrink))


def to_date(df: DataFrame, key: Sequence[str], day: str, sums: Sequence[str], suffix: str = "_to_date") -> DataFrame:
    """Sums over earlier days in one pass."""
    past = before_day(key, day)
    return df.withColumns({f"{c}{suffix}": F.coalesce(F.sum(c).over(past), F.lit(0.0)) for c in sums})


def form(df: DataFrame, key: Sequence[str], order: Sequence[str], value: str, short: float, long: float) -> DataFrame:
    """Decayed mean of a short half-life less that of a long one."""
    out = decayed_mean(decayed_mean(df, key, order, value, short, "_s"), key, order, value, long, "_l")
    return out.withColumn("form", F.col("_s") - F.col("_l")).drop("_s", "_l")


def quarter_means(df: DataFrame, key: Sequence[str], day: str, quarters: Sequence[str]) -> DataFrame:
    """Means of each quarter on earlier days."""
    past = before_day(key, day)
    return df.withColumns({f"{q}_mean": F.avg(q).over(past) for q in quarters})


def absences(grid: DataFrame, group: Sequence[str], order: Sequence[str], minutes: str, least: float, recent: int = 3, window: int = 10, total: float = 240.0) -> DataFrame:
    """Share of the team's minutes that absent members of the rotation leave open: seen in the last `recent` games, with a mean of at
    least `least` over the last `window`, and without minutes now. grid: every member in every game of the group."""
    past = Window.partitionBy(*group, "member").orderBy(*order)
    mean, seen = F.avg(F.coalesce(minutes, F.lit(0.0))).over(past.rowsBetween(-window, -1)), F.max((F.col(minutes) > 0).cast("int")).over(past.rowsBetween(-recent, -1))
    out = grid.withColumns({"_mean": mean, "_seen": seen})
    gone = (F.col("_seen") == 1) & (F.col("_mean") >= least) & (F.coalesce(minutes, F.lit(0.0)) == 0)
    return out.groupBy(*group, *order).agg((F.coalesce(F.sum(F.when(gone, F.col("_mean"))), F.lit(0.0)) / total).alias("absent_share"))


def running_record(df: DataFrame, key: Sequence[str], order: Sequence[str], units: str) -> DataFrame:
    """Running number, units and return in order; the order's first column is a day."""
    run = placed(df, key, order, [units, F.col(units).isNotNull().cast("long")])
    made = {"n": F.col("_s1").cast("long"), "units": F.when(F.col("_s1") > 0, F.col("_s0"))}
    return run.withColumns(made).withColumn("roi", F.when(F.col("n") > 0, F.col("units") / F.col("n"))).drop("_o", "_s0", "_s1")


def latest_n_before(df: DataFrame, cell: Sequence[str], day: str, order: Sequence[str], values: Sequence[str], n: int | None) -> DataFrame:
    """Sums over the latest n rows of the cell on earlier days (n None: all), and how many there were.

    With S(k) the sum over the first k rows, that is S(c) - S(c - n) after c rows on earlier days. c is one number a cell and day, so
    S(c) comes from sums by day, and S(c - n) from one equi-join of days with numbered rows: no lists, no caps, no
    task with a whole cell, and rows of the same day never see each other.
    """
    days = before_days(df, cell, day, values).withColumn("_lo", F.greatest(F.col("_c") - n, F.lit(0)) if n else F.lit(0))
    sums = {f"{v}_sum": F.col(f"_d{i}") for i, v in enumerate(values)}
    if n:
        upto = placed(df, cell, [day, *order], values).select(*cell, F.col("_o").alias("_lo"), *(f"_s{i}" for i in range(len(values))))
        days = days.alias("l").join(upto.alias("r"), same([*cell, "_lo"]), "left").select("l.*", *(f"_s{i}" for i in range(len(values))))
        sums = {f"{v}_sum": F.col(f"_d{i}") - F.coalesce(f"_s{i}", F.lit(0.0)) for i, v in enumerate(values)}
    ready = days.select(*cell, day, *(c.alias(name) for name, c in sums.items()), (F.col("_c") - F.col("_lo")).alias("members"))
    return df.alias("l").join(ready.alias("r"), same([*cell, day])).select(*(F.col(f"l.{c}") for c in df.columns), *sums, "members")


def shrunk_cell(wins: Column, games: Column, market: Column, k: float = 200.0) -> Column:
    """Mean residual of a cell, shrunk by n / (n + k)."""
    return F.when(games > 0, (wins - market) / games * games / (games + k)).otherwise(0.0)


def adjusted(q: Column, shift: Column, lo: Column | float, hi: Column | float) -> Column:
    """The estimate moved by the adjustment, kept inside its band."""
    return F.greatest(F.lit(lo) if not isinstance(lo, Column) else lo, F.least(F.lit(hi) if not isinstance(hi, Column) else hi, q + shift))


def drift(df: DataFrame, day: str, order: Sequence[str], residual: str, half_life: float, latest: int = 600, pseudo: float = 50.0, key: Sequence[str] = ()) -> DataFrame:
    """Half-life weighted mean residual of the latest rows on earlier days, pulled to 0 by pseudo counts.

    With D(k) the decayed sum of the first k rows, the window after n rows is D(n) - 0.5^(latest/h) D(n - latest). n is one number a
    day, so D is read by two joins of days with rows; powers stay in range as in `decayed`.
    """
    ratio = 0.5 ** (1 / half_life)
    rows = decayed(placed(df, key, [day, *order]), key, [day, *order], [residual], half_life, "_d", place="_o")
    upto = rows.select(*key, "_o", (ratio * F.col(f"{residual}_d") + F.coalesce(residual, F.lit(0.0))).alias("_D"))
    days = before_days(df, key, day).withColumnRenamed("_c", "_n")
    at = lambda n, name: upto.select(*key, F.col("_o").alias(n), F.col("_D").alias(name))
    days = days.withColumn("_from", F.col("_n") - latest).join(at("_n", "_hi"), [*key, "_n"], "left").join(at("_from", "_lo"), [*key, "_from"], "left")
    total = F.coalesce("_hi", F.lit(0.0)) - 0.5 ** (latest / half_life) * F.coalesce("_lo", F.lit(0.0))
    weight = (1 - F.pow(F.lit(ratio), F.least("_n", F.lit(latest)))) / (1 - ratio)
    return df.join(days.select(*key, day, (total / (weight + pseudo)).alias("drift")), [*key, day]).select(*df.columns, "drift")


def both_positive(df: DataFrame, cell: Sequence[str], season: str, day: str, order: Sequence[str], gain: str) -> DataFrame:
    """Bet only if the cell's gain on earlier days is positive in this season and over all seasons."""
    one = latest_n_before(df, [*cell, season], day, order, [gain], None).withColumnsRenamed({f"{gain}_sum": "season_gain", "members": "season_n"})
    every = latest_n_before(one, list(cell), day, order, [gain], None).withColumnsRenamed({f"{gain}_sum": "pooled_gain", "members": "pooled_n"})
    return every.withColumn("bet", (F.col("season_gain") > 0) & (F.col("pooled_gain") > 0))


def break_even(df: DataFrame, cell: Sequence[str], day: str, order: Sequence[str], won: str, need: str, sizes: Sequence[int | None]) -> DataFrame:
    """For each window size, whether the cell's trailing win rate passes the break-even rate; long form."""
    parts = []
    for n in sizes:
        t = latest_n_before(df, cell, day, order, [won], n)
        parts.append(t.withColumns({"window": F.lit(n or 0), "bet": (F.col("members") > 0) & (F.col(f"{won}_sum") / F.col("members") > F.col(need))}))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def jitter(df: DataFrame, key: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Mean absolute change between successive estimates."""
    return df.withColumn("_d", F.abs(F.col(value) - F.lag(value).over(Window.partitionBy(*key).orderBy(*order)))).groupBy(*key).agg(F.avg("_d").alias("jitter"))


def season_offset(df: DataFrame, season: str, day: str, residual: str, variance: str, tau: float) -> DataFrame:
    """Shift of a season from residuals on earlier days, with a prior of variance tau: sum r / (sum v + 1 / tau^2)."""
    daily = df.groupBy(season, day).agg(F.sum(residual).alias("_r"), F.sum(variance).alias("_v"))
    past = Window.partitionBy(season).orderBy(day).rangeBetween(Window.unboundedPreceding, -1)
    level = F.coalesce(F.sum("_r").over(past), F.lit(0.0)) / (F.coalesce(F.sum("_v").over(past), F.lit(0.0)) + 1 / tau**2)
    return df.join(daily.select(season, day, level.alias("offset")), [season, day])


def cleaned_clock(df: DataFrame, key: Sequence[str], order: Sequence[str], value: str, radius: int = 5, off: float = 600.0) -> DataFrame:
    """Values far from the centred median are dropped, gaps filled on a line, and the result made to rise."""
    own = Window.partitionBy(*key).orderBy(*order)
    near = F.percentile(value, F.lit(0.5)).over(own.rowsBetween(-radius, radius))
    out = df.withColumn("_pos", F.row_number().over(own)).withColumn("_ok", F.when(F.abs(F.col(value) - near) <= off, F.col(value)))
    spot = F.when(F.col("_ok").isNotNull(), F.col("_pos"))
    back, ahead = own.rowsBetween(Window.unboundedPreceding, Window.currentRow), own.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    a, b = F.last("_ok", True).over(back), F.first("_ok", True).over(ahead)
    pa, pb = F.last(spot, True).over(back), F.first(spot, True).over(ahead)
    line = F.when(pa == pb, a).when(pa.isNull(), b).when(pb.isNull(), a).otherwise(a + (b - a) * (F.col("_pos") - pa) / (pb - pa))
    return out.withColumn("_line", line).withColumn("clean", F.max("_line").over(back)).drop("_pos", "_ok", "_line")


def since_change(df: DataFrame, key: Sequence[str], order: Sequence[str], value: str, ts: str) -> DataFrame:
    """Seconds since the value last changed (from the first row on)."""
    own = Window.partitionBy(*key).orderBy(*order)
    before = F.lag(value).over(own)
    changed = df.withColumn("_c", F.when(before.isNull() | (before != F.col(value)), F.col(ts)))
    return changed.withColumn("quiet_seconds", F.col(ts) - F.last("_c", True).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_c")


def first_crossing(df: DataFrame, key: Sequence[str], ts: str, p: str, level: float) -> DataFrame:
    """First time below the level, and the highest value after it."""
    low = F.min(F.when(F.col(p) < level, F.col(ts))).over(Window.partitionBy(*key))
    return df.withColumn("_t", low).where("_t is not null").groupBy(*key).agg(F.first("_t").alias("crossed"), F.max(F.when(F.col(ts) > F.col("_t"), F.col(p))).alias("best_after"))


def first_signal(df: DataFrame, key: Sequence[str], ts: str, signal: Column, fill: str, lag: int) -> DataFrame:
    """The first row with a signal, filled with the quote exactly `lag` later (null if there is none)."""
    first = df.where(signal).withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(ts))).where("_r = 1").drop("_r")
    later = df.select(*key, (F.col(ts) - lag).alias(ts), F.col(fill).alias("filled"))
    return first.join(later, [*key, ts], "left")


def lagged_correlation(df: DataFrame, key: Sequence[str], ts: str, x: str, y: str, lags: Sequence[int], step: int = 60) -> DataFrame:
    """Correlation of changes of x with changes of y some steps earlier, over exact steps only."""
    own = Window.partitionBy(*key).orderBy(ts)
    exact = lambda c, k: F.when(F.lag(ts, k).over(own) == F.col(ts) - k * step, F.lag(c, k).over(own))
    d = df.withColumns({"_dx": F.col(x) - exact(x, 1), "_dy": F.col(y) - exact(y, 1)})
    made = d.withColumns({f"_y{k}": F.when(F.lag(ts, k).over(own) == F.col(ts) - k * step, F.lag("_dy", k).over(own)) if k else F.col("_dy") for k in lags})
    return made.agg(*(F.corr("_dx", f"_y{k}").alias(f"corr_{k}") for k in lags))


def median_to_date(df: DataFrame, key: Sequence[str], day: str, value: str, least: int = 5) -> DataFrame:
    """Median over earlier days; null under `least` rows."""
    seen = beside(df, medians_before(df, key, day, value), [*key, day], ["_median", "_seen"])
    return seen.withColumn("median_before", F.when(F.col("_seen") >= least, F.col("_median"))).drop("_median", "_seen")


def leave_one_out(df: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """Value less the mean of the others, over their standard deviation; null under three rows."""
    own = Window.partitionBy(*key)
    n, s, q = F.count(value).over(own), F.sum(value).over(own), F.sum(F.col(value) * F.col(value)).over(own)
    m = (s - F.col(value)) / (n - 1)
    var = (q - F.col(value) * F.col(value) - (n - 1) * m * m) / (n - 2)
    return df.withColumn("loo_z", F.when((n >= 3) & (var > 0), (F.col(value) - m) / F.sqrt(var)))


def standing(df: DataFrame, key: Sequence[str], day: str, won: str, late_day: int, low: float = 0.35, high: float = 0.65) -> DataFrame:
    """Share of wins on earlier days, and late-season incentive flags."""
    share = F.avg(F.col(won).cast("double")).over(before_day(key, day))
    return df.withColumn("win_share", share).withColumns({"tanking": (F.col(day) >= late_day) & (F.col("win_share") <= low), "resting": (F.col(day) >= late_day) & (F.col("win_share") >= high)})


def trusted_record(df: DataFrame, key: Sequence[str], day: str, won: str, claimed: str, fallback: str) -> DataFrame:
    """Wins on earlier days if their number of games equals the claimed one, else the fallback."""
    past = before_day(key, day)
    n = F.count(won).over(past)
    return df.withColumn("record", F.when(n == F.col(claimed), F.coalesce(F.sum(F.col(won).cast("double")).over(past), F.lit(0.0))).otherwise(F.col(fallback)))


def shares(df: DataFrame, group: Sequence[str], value: str, ties: Sequence[str]) -> DataFrame:
    """Rank and share of a value in its group."""
    by = Window.partitionBy(*group)
    return df.withColumns({"rank": F.row_number().over(by.orderBy(F.desc(value), *ties)), "share": F.col(value) / F.sum(value).over(by)})


def rate_to_date(df: DataFrame, key: Sequence[str], day: str, points: str, minutes: str, least: int = 3) -> DataFrame:
    """Points for each minute on earlier days; null under `least` rows."""
    past = before_day(key, day)
    return df.withColumn("rate", F.when(F.count("*").over(past) >= least, F.sum(points).over(past) / F.sum(minutes).over(past)))


def reliability_by_n(df: DataFrame, key: Sequence[str], order: Sequence[str], value: str, sizes: Sequence[int]) -> DataFrame:
    """Correlation over keys of the mean of the first n rows with the mean of the rest."""
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    means = [F.avg(F.when(F.col("_r") <= n, F.col(value))).alias(f"a{n}") for n in sizes] + [F.avg(F.when(F.col("_r") > n, F.col(value))).alias(f"b{n}") for n in sizes]
    wide = ranked.groupBy(*key).agg(*means)
    return wide.agg(*(F.corr(f"a{n}", f"b{n}").alias(f"r{n}") for n in sizes))
