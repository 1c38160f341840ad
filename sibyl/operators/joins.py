"""Joins (J01-J32): equi, as-of, interval, nearest, band, rule, pair and rank joins.

As-of joins are a union of both sides and a running last value, so they need one shuffle by key and no range join.
Dimensions that are broadcast are rules, bands and rate tables: tens of rows that do not grow with the facts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import new_path, removed


def both_sides(log: DataFrame, team: str, opp: str, date: str, home: str, keep: Sequence[str]) -> DataFrame:
    """Home row beside the away row of the same game."""
    h = log.where(F.col(home)).select(F.col(date), F.col(team).alias("home"), F.col(opp).alias("away"), *(F.col(c).alias(f"h_{c}") for c in keep))
    a = log.where(~F.col(home)).select(F.col(date), F.col(team).alias("away"), F.col(opp).alias("home"), *(F.col(c).alias(f"a_{c}") for c in keep))
    return h.join(a, [date, "home", "away"])


def with_terms(games: DataFrame, terms: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner, so games without a report drop out."""
    return games.join(terms, list(keys), "inner")


def enriched(df: DataFrame, side: DataFrame, keys: Sequence[str]) -> DataFrame:
    """J03."""
    return df.join(side, list(keys), "left")


def one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], agree: Column | None = None) -> DataFrame:
    """Raises while running if a key repeats on the right, has no partner, or the rows contradict each other."""
    counted = right.withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    joined = left.join(counted.withColumn("_hit", F.lit(True)), list(keys), "left")
    ok = F.coalesce(F.col("_hit") & (F.col("_n") == 1), F.lit(False))
    if agree is not None:
        ok = ok & F.coalesce(agree, F.lit(False))
    guard = F.assert_true(ok, F.lit("not one to one"))
    return joined.withColumn("_guard", guard.isNull()).where("_guard").drop("_guard", "_n", "_hit")


def as_of(left: DataFrame, right: DataFrame, key: Sequence[str], left_ts: str, right_ts: str, values: Sequence[str], tolerance: int | None = None, strict: bool = False) -> DataFrame:
    """Each left row with the last right row at or before it (strict: before it), within a tolerance in
    seconds; null without one. Times are numbers (seconds or days). Ties on the right: the largest values win."""
    cols = left.columns
    packed = F.struct(F.col(right_ts).cast("double").alias("t"), *(F.col(v).alias(v) for v in values))
    r = right.select(*key, F.col(right_ts).cast("double").alias("_t"), F.lit(1 if strict else 0).alias("_side"), packed.alias("_r"))
    l = left.withColumn("_l", F.struct(*cols)).select(*key, F.col(left_ts).cast("double").alias("_t"), F.lit(0 if strict else 1).alias("_side"), F.lit(None).cast(r.schema["_r"].dataType).alias("_r"), "_l")
    both = r.withColumn("_l", F.lit(None).cast(l.schema["_l"].dataType)).unionByName(l)
    past = Window.partitionBy(*key).orderBy("_t", "_side", F.col("_r").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = both.withColumn("_m", F.last("_r", True).over(past)).where("_l is not null")
    near = F.lit(True) if tolerance is None else F.col("_t") - F.col("_m.t") <= tolerance
    return out.select(*(F.col(f"_l.{c}").alias(c) for c in cols), *(F.when(near, F.col(f"_m.{v}")).alias(v) for v in values))


def grid_states(plays: DataFrame, key: Sequence[str], ts: str, values: Sequence[str], step: int, end: str) -> DataFrame:
    """The state at each step of a grid from 0 to the key's end."""
    grid = plays.groupBy(*key).agg(F.max(end).alias("_end")).select(*key, F.explode(F.sequence(F.lit(0), F.col("_end").cast("int"), F.lit(step))).alias("grid"))
    return as_of(grid, plays, key, "grid", ts, values)


def quote_near(quotes: DataFrame, events: DataFrame, key: Sequence[str], ts: str, at: str, before: int, last: bool = True) -> DataFrame:
    """The last (or first) quote in the seconds before each event. Time is cut into cells of the window's length: a quote joins the events of
    its own cell and of the next one, so a key with many of both is not joined with itself."""
    cell = lambda c: F.floor(F.col(c) / before)
    q = quotes.withColumn("_cell", F.explode(F.array(cell(ts), cell(ts) + 1)))
    j = events.withColumn("_cell", cell(at)).join(q, [*key, "_cell"]).where(F.col(ts).between(F.col(at) - before, F.col(at)))
    pick = F.max_by if last else F.min_by
    keep = [c for c in quotes.columns if c not in key]
    return j.groupBy(*key, at).agg(pick(F.struct(*keep), F.col(ts)).alias("q")).select(*key, at, *(F.col(f"q.{c}").alias(c) for c in keep))


def nearest(df: DataFrame, table: DataFrame, x: str, at: str, values: Sequence[str]) -> DataFrame:
    """Values of the table row whose key is nearest; ties go to the smaller key. table: a small rate table."""
    rows = table.select(F.collect_list(F.struct(F.col(at).alias("_at"), *values)).alias("_rows"))
    best = F.array_min(F.transform("_rows", lambda r: F.struct(F.abs(r["_at"] - F.col(x)).alias("d"), r["_at"].alias("at"), r.alias("r"))))["r"]
    return df.join(F.broadcast(rows)).withColumn("_best", best).select(*df.columns, *(F.col(f"_best.{v}").alias(v) for v in values))


def with_rules(prices: DataFrame, rules: DataFrame) -> DataFrame:
    """Every rule beside the prices of its market and kind inside its range of slates. rules: tens of rows."""
    r = F.broadcast(rules.withColumnsRenamed({"market": "_market", "kind": "_kind"}))
    on = (F.col("market") == F.col("_market")) & (F.col("kind") == F.col("_kind")) & (F.col("slate") >= F.col("since")) & (F.col("until").isNull() | (F.col("slate") < F.col("until")))
    return prices.join(r, on).drop("_market", "_kind")


def in_bands(df: DataFrame, bands: DataFrame, value: str) -> DataFrame:
    """Rows beside the bands [lo, hi] that hold their value. bands: a small dimension."""
    b = F.broadcast(bands)
    return df.join(b, (df[value] >= b["lo"]) & (df[value] <= b["hi"]))


def resolve_entity(df: DataFrame, entities: DataFrame, name: str, team: str, id_: str) -> DataFrame:
    """By (name, team) if that is unique, else by name if that is; ambiguous names never match."""
    once = lambda keys, out: entities.groupBy(*keys).agg(F.count_distinct(id_).alias("_n"), F.min(id_).alias(out)).where("_n = 1").drop("_n")
    out = df.join(once([name, team], "_both"), [name, team], "left").join(once([name], "_name"), [name], "left")
    return out.withColumn("entity", F.coalesce("_both", "_name")).drop("_both", "_name")


def first_id(rows: DataFrame, entities: DataFrame, keys: Sequence[str], id_: str) -> DataFrame:
    """The first id of each key."""
    return rows.join(entities.groupBy(*keys).agg(F.min(id_).alias(id_)), list(keys), "left")


def with_opponent(df: DataFrame, game: str, team: str, values: Sequence[str]) -> DataFrame:
    """Totals of the other team of the same game."""
    other = df.select(game, F.col(team).alias("_t"), *(F.col(v).alias(f"opp_{v}") for v in values))
    return df.join(other, game).where(F.col(team) != F.col("_t")).drop("_t")


def previous_roster(box: DataFrame, team: Sequence[str], day: str, player: str, minutes: str, value: Column) -> DataFrame:
    """For each team and day, the sum of a value over the players with minutes on the team's latest earlier day; null before the first."""
    days = box.select(*team, day).distinct()
    played = box.where(F.col(minutes) > 0).groupBy(*team, day).agg(F.sum(value).alias("_talent"))
    known = days.join(played, [*team, day], "left")
    return known.withColumn("talent", F.last("_talent", True).over(Window.partitionBy(*team).orderBy(day).rowsBetween(Window.unboundedPreceding, -1))).drop("_talent")


def pairs(df: DataFrame, group: Sequence[str], id_: str, keep: Sequence[str]) -> DataFrame:
    """Pairs i < j inside a group whose size is bounded by its nature (players of a game, lines of an order)."""
    a = df.select(*group, F.col(id_).alias("a"), *(F.col(c).alias(f"a_{c}") for c in keep))
    b = df.select(*group, F.col(id_).alias("b"), *(F.col(c).alias(f"b_{c}") for c in keep))
    return a.join(b, list(group)).where("a < b")


def positional_fill(missing: DataFrame, present: DataFrame, group: Sequence[str], position: str, minutes: str, unknown: float = 0.5) -> DataFrame:
    """Minutes of missing players given to the present ones of the group, in proportion to their own minutes by nearness of position
    (none from two positions away; `unknown` for a team mate without one); by minutes alone if the missing player has no position or
    nobody is near. Rows of present with `extra`, 0 without missing players; allocate (V02) scales and caps the sums."""
    m = missing.where(F.col(minutes) > 0).select(*group, F.col("id").alias("gone"), F.col(position).alias("_pm"), F.col(minutes).alias("_mm"))
    p = present.select(*group, "id", F.col(position).alias("_pp"), F.col(minutes).alias("_e"))
    near = F.when(F.col("_pm").isNull(), 1.0).when(F.col("_pp").isNull(), unknown).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(F.col("_pp") - F.col("_pm")) / 2))
    own = Window.partitionBy(*group, "gone")
    j = m.join(p, list(group)).withColumn("_w", F.col("_e") * near)
    share = F.when(F.sum("_w").over(own) > 0, F.col("_w") / F.sum("_w").over(own)).otherwise(F.col("_e") / F.sum("_e").over(own))
    extra = j.withColumn("extra", F.col("_mm") * share).groupBy(*group, "id").agg(F.sum("extra").alias("extra"))
    return present.join(extra, [*group, "id"], "left").withColumn("extra", F.coalesce("extra", F.lit(0.0)))


def by_rank(players: DataFrame, slots: DataFrame, role: Sequence[str], player_order: Sequence[Column], slot_order: Sequence[Column]) -> DataFrame:
    """The k-th player of a role takes its k-th slot."""
    k = lambda d, order: d.withColumn("k", F.row_number().over(Window.partitionBy(*role).orderBy(*order)))
    return k(players, player_order).join(k(slots, slot_order), [*role, "k"])


def next_season(df: DataFrame, previous: DataFrame, entity: Sequence[str], season: str, values: Sequence[str]) -> DataFrame:
    """Values of the season before; a gap season finds none."""
    last = previous.select(*entity, (F.col(season) + 1).alias(season), *(F.col(v).alias(f"last_{v}") for v in values))
    return df.join(last, [*entity, season], "left")


def returning_share(last: DataFrame, first_box: DataFrame, team: Sequence[str], player: str, minutes: str) -> DataFrame:
    """Share of last season's minutes that is on this season's first box. team: its columns, with the season of first_box if there are several."""
    back = last.join(first_box.select(*team, player).distinct(), [*team, player], "left_semi").groupBy(*team).agg(F.sum(minutes).alias("_b"))
    return last.groupBy(*team).agg(F.sum(minutes).alias("_a")).join(back, list(team), "left").select(*team, (F.coalesce("_b", F.lit(0.0)) / F.col("_a")).alias("returning"))


def scheduled(props: DataFrame, schedule: DataFrame, keys: Sequence[str], provider: str, first: str, ts: str) -> DataFrame:
    """Props of a scheduled game by exact keys; one provider goes first, then the latest."""
    from .scope import keep_one

    return keep_one(props.join(schedule, list(keys)), [*keys, "name", "stat"], [(F.col(provider) == first).desc(), F.col(ts).desc()])


def rescored(stored: DataFrame, fresh: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Model columns of the fresh rows take the place of the stored ones; all else stays."""
    new = fresh.select(*key, F.lit(True).alias("_new"), *(F.col(c).alias(f"_n_{c}") for c in columns))
    j = stored.join(new, list(key), "left")
    return j.withColumns({c: F.when(F.col("_new"), F.col(f"_n_{c}")).otherwise(F.col(c)) for c in columns}).select(*stored.columns)


def repriced(bets: DataFrame, prices: DataFrame, key: Sequence[str], kind: str) -> DataFrame:
    """The same bet at another price point of its game."""
    other = prices.where(F.col("kind") == kind).select(*key, F.col("price").alias(f"{kind}_price"), F.col("q").alias(f"{kind}_q"))
    return bets.join(other, list(key), "left")


def lock_or_rescore(locks: DataFrame, rescore: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Native lock values, else those of the one-time rescore, else null; with the source."""
    r = rescore.select(key, *(F.col(c).alias(f"_r_{c}") for c in columns))
    native = F.col(columns[0]).isNotNull()
    j = locks.join(r, key, "left")
    source = F.when(native, "native").when(F.col(f"_r_{columns[0]}").isNotNull(), "rescore")
    return j.withColumns({"source": source} | {c: F.when(native, F.col(c)).otherwise(F.col(f"_r_{c}")) for c in columns}).select(*locks.columns, "source")


def count_audit(logs: DataFrame, boxes: DataFrame, team: str, day: str, slates: DataFrame) -> DataFrame:
    """Rows of each team before a slate in two tables, where they differ. slates: (team, slate). Both tables and the slates are counts by team and day,
    and a slate reads the running sums of the days before it: no row meets another one."""
    count = lambda d, at, name: d.groupBy(team, F.col(at).alias("_d")).agg(F.count("*").alias(name))
    parts = [count(logs, day, "_a"), count(boxes, day, "_b"), count(slates, "slate", "_s")]
    rows = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    rows = rows.groupBy(team, "_d").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("_a", "_b", "_s")))
    past = Window.partitionBy(team).orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)  # a row a day
    so_far = lambda c: F.coalesce(F.sum(c).over(past), F.lit(0))
    out = rows.select(team, F.col("_d").alias("slate"), so_far("_a").alias("in_logs"), so_far("_b").alias("in_boxes"), "_s")
    return out.where((F.col("_s") > 0) & (F.col("in_logs") != F.col("in_boxes"))).drop("_s")


def lineage(rules: DataFrame, fields: Sequence[str], ends: str | None = None) -> DataFrame:
    """For each rule the earliest ancestor that decides as it does: up along `parent` while all `fields` stay the same (nulls are equal) and the parent
    is known and not closed (`ends`, a boolean column). A rule without such a parent is its own twin. Keys must be single.

    Every round doubles the jumps over a stored table, so a chain of n rules takes log2(n) joins; a cycle raises ValueError."""
    above = rules.select(F.col("key").alias("_up"), *(F.col(f).alias(f"_{i}") for i, f in enumerate(fields)), (F.coalesce(F.col(ends), F.lit(False)) if ends else F.lit(False)).alias("_closed"))
    same = F.col("_up").isNotNull() & ~F.col("_closed")
    for i, f in enumerate(fields):
        same = same & F.col(f).eqNullSafe(F.col(f"_{i}"))
    first = rules.join(above, F.col("parent") == F.col("_up"), "left").select("key", F.when(same, F.col("parent")).otherwise(F.col("key")).alias("twin"))
    spark = rules.sparkSession
    path = new_path(spark, "lineage")
    first.withColumns({"root": F.col("twin") == F.col("key"), "moved": F.lit(True)}).write.parquet(path)
    jumps = spark.read.parquet(path)
    rounds = jumps.count().bit_length() + 1
    while jumps.where("moved").limit(1).count():
        if rounds == 0:
            raise ValueError("rules whose parents form a cycle")
        rounds -= 1
        far = jumps.select(F.col("key").alias("twin"), F.col("twin").alias("_far"), F.col("root").alias("_root"))
        newer = new_path(spark, "lineage")
        jumps.join(far, "twin").select("key", F.col("_far").alias("twin"), F.col("_root").alias("root"), (F.col("twin") != F.col("_far")).alias("moved")).write.parquet(newer)
        removed(spark, path)
        path, jumps = newer, spark.read.parquet(newer)
    if jumps.where("not root").limit(1).count():
        raise ValueError("rules whose parents form a cycle")
    return jumps.select("key", "twin")


def daily_slate(salaries: DataFrame, schedule: DataFrame, projections: DataFrame, rates: DataFrame) -> DataFrame:
    """Salaries with game, latest projection and rate; value rank inside the slate."""
    from .scope import keep_one

    latest = keep_one(projections, ["team", "name"], [F.col("ts").desc()]).drop("ts")
    out = salaries.join(schedule, ["slate", "team"], "left").join(latest, ["team", "name"], "left").join(rates, ["team", "name"], "left")
    return out.withColumn("value_rank", F.row_number().over(Window.partitionBy("slate").orderBy((F.col("points") / F.col("salary")).desc_nulls_last(), "team", "name")))


def override(df: DataFrame, injuries: DataFrame, keys: Sequence[str], ts: str, lag: int) -> DataFrame:
    """The status of a second feed counts if it was taken no later than `lag` seconds after the row."""
    i = injuries.select(*keys, F.col("status").alias("_st"), F.col(ts).alias("_its"))
    j = df.join(i, list(keys), "left")
    ok = F.col("_its") <= F.col(ts) + lag
    return j.withColumn("status", F.when(ok, F.coalesce("_st", "status")).otherwise(F.col("status"))).drop("_st", "_its")


def home_less_away(df: DataFrame, game: str, home: str, values: Sequence[str]) -> DataFrame:
    """Features of the home team less those of the away team."""
    side = lambda v, h: F.max(F.when(F.col(home) == h, F.col(v)))
    return df.groupBy(game).agg(*((side(v, True) - side(v, False)).alias(f"{v}_diff") for v in values))


def listing_share(rows: DataFrame, listing: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Share of rows that a listing has, by status and season."""
    hit = rows.join(listing.select(*keys).distinct().withColumn("_hit", F.lit(1)), list(keys), "left")
    return hit.groupBy(*by).agg(F.avg(F.coalesce("_hit", F.lit(0)).cast("double")).alias("listed"), F.count("*").alias("n"))


def filled_states(quotes: DataFrame, plays: DataFrame, key: Sequence[str], ts: str, state: Sequence[str], fill: Sequence[str], lag: int) -> DataFrame:
    """Each quote with the state of the last play at or before it, and fill_c of the quote exactly `lag` later: what a decision made on this
    state is filled with. Quotes have one row for each key and time; null where there is no play before, or no quote at that time."""
    seen = as_of(quotes, plays, key, ts, ts, state)
    later = quotes.select(*key, (F.col(ts) - lag).alias(ts), *(F.col(c).alias(f"fill_{c}") for c in fill))
    return seen.join(later, [*key, ts], "left")


def value_before(df: DataFrame, history: DataFrame, key: Sequence[str], day: str, value: str, fallback: Column) -> DataFrame:
    """Df with the key's value as of the day before: the last one dated strictly earlier, else the fallback. Of values of one day the largest counts."""
    found = as_of(df, history.select(*key, F.col(day), F.col(value).alias("_value")), key, day, day, ["_value"], strict=True)
    return found.withColumn(value, F.coalesce("_value", fallback)).drop("_value")
