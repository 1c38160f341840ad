"""Filters, scopes (F01-F20), order and top-k (Q01-Q06) and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def graded(df: DataFrame, result: str = "won") -> DataFrame:
    """rows whose result is 0 or 1, as a double."""
    return df.withColumn(result, F.col(result).try_cast("double")).where(F.col(result).isin(0.0, 1.0))


def with_close(df: DataFrame, home_ml: str, away_ml: str, lean_home: str) -> DataFrame:
    """rows with a usable closing pair, and the price of the side leaned to."""
    ok = (F.abs(home_ml) >= 100) & (F.abs(away_ml) >= 100)
    return df.where(ok).withColumns({"lean_ml": F.when(F.col(lean_home), F.col(home_ml)).otherwise(F.col(away_ml)), "other_ml": F.when(F.col(lean_home), F.col(away_ml)).otherwise(F.col(home_ml))})


def frozen_forecasts(df: DataFrame, basis: str, first_slate: str, suffix: str, hours: int = 5) -> DataFrame:
    """of one basis and tag family, locked inside the hours before the tip, with a probability."""
    inside = (F.col("lock_ts") < F.col("tip_ts")) & (F.col("lock_ts") >= F.col("tip_ts") - F.expr(f"interval {hours} hours"))
    scope = (F.col("basis") == basis) & (F.col("slate") >= F.lit(first_slate).cast("date")) & F.col("tag").endswith(suffix) & inside & F.col("p").between(0, 1)
    return df.where(scope).withColumn("pick_home", F.col("p") >= 0.5)


def without(df: DataFrame, void: DataFrame, key: str, only: bool = False) -> DataFrame:
    """rows not on a list of void keys; with `only`, just those."""
    return df.join(void.select(key).distinct(), key, "left_semi" if only else "left_anti")


def registered(df: DataFrame, since: str, until: str | None, suffix: str, slate: str = "slate", tag: str = "tag") -> DataFrame:
    """slates in [since, until) of a tag family."""
    ok = (F.col(slate) >= F.lit(since).cast("date")) & F.col(tag).endswith(suffix)
    return df.where(ok & (F.col(slate) < F.lit(until).cast("date")) if until else ok)


def activation(df: DataFrame, suffix: str, slate: str = "slate", tag: str = "tag") -> DataFrame:
    """one row with the first slate that carries the tag family."""
    return df.where(F.col(tag).endswith(suffix)).agg(F.min(slate).alias("activated"))


def stage(home_played: Column, away_played: Column, unknown_is_late: bool) -> Column:
    """experience by the lower number of games; both rules for unknown numbers exist."""
    low = F.when(home_played.isNotNull() & away_played.isNotNull(), F.least(home_played, away_played))
    out = F.when(low == 0, "0").when(low < 10, "1-9").when(low >= 10, "10+")
    return F.coalesce(out, F.lit("10+" if unknown_is_late else "unknown"))


def rule_member(p: Column, q: Column, stage_: Column, rule: Column) -> Column:
    """whether a bet is in a rule (struct stage, side, min_edge), decided by its data alone."""
    edge = p - q
    side = F.when(rule["side"] == "favorite", q >= 0.5).when(rule["side"] == "underdog", q < 0.5).otherwise(True)
    return F.coalesce((rule["stage"].isNull() | (rule["stage"] == stage_)) & side & (edge >= rule["min_edge"]), F.lit(False))


def on_book(df: DataFrame, book: str, hidden: Sequence[str] = (), column: str = "book") -> DataFrame:
    """one book, never pooled; hidden books give nothing."""
    return df.where((F.col(column) == book) & ~F.col(column).isin(*hidden)) if hidden else df.where(F.col(column) == book)


def public_stages(df: DataFrame, stages: Sequence[str]) -> DataFrame:
    """F10."""
    return df.where(F.col("stage").isin(*stages))


def pending(df: DataFrame, today: str, days: int = 7) -> DataFrame:
    """ungraded rows of earlier slates, and graded rows of the slates of the last days that still miss a closing pair."""
    day = F.lit(today).cast("date")
    ungraded = (F.col("slate") < day) & F.col("won").isNull()
    no_pair = F.col("close_home_ml").isNull() | F.col("close_away_ml").isNull()
    no_close = (F.col("slate") < day) & (F.col("slate") >= F.date_sub(day, days)) & F.col("won").isin(0, 1) & no_pair
    return df.where(ungraded | no_close).withColumn("why", F.when(ungraded, "result").otherwise("close"))


def covered(games: DataFrame, rows: DataFrame) -> DataFrame:
    """games that a report speaks for: their matchup, or both teams, are on it, and neither team is still to file. A game that
    it does not reach is never read as 'nobody out'. rows: (slate, team, status, away, home), the last two from the matchup or null."""
    late = rows.where("status = 'PENDING'").select("slate", "team").distinct()
    teams, matchups = rows.where("team is not null").select("slate", "team").distinct(), rows.select("slate", "away", "home").where("away is not null and home is not null").distinct()
    as_side = lambda d, side, mark: d.withColumnRenamed("team", side).withColumn(mark, F.lit(True))
    out = games.join(matchups.withColumn("_m", F.lit(True)), ["slate", "away", "home"], "left")
    for side in ("home", "away"):
        out = out.join(as_side(teams, side, f"_t_{side}"), ["slate", side], "left").join(as_side(late, side, f"_l_{side}"), ["slate", side], "left_anti")
    return out.where("_m or (_t_home and _t_away)").select(*games.columns)


def stale_entities(have: DataFrame, finals: DataFrame, key: str, date: str) -> DataFrame:
    """entities whose own history ends before their latest final."""
    last = finals.groupBy(key).agg(F.max(date).alias("needed"))
    own = have.groupBy(key).agg(F.max(date).alias("have"))
    return last.join(own, key, "left").where("have is null or have < needed")


def official(df: DataFrame, key: str, captured: str, forecast: str, tip: str, hours: int = 5) -> DataFrame:
    """the first capture of each key with capture and forecast inside the hours before the tip."""
    inside = lambda c: (F.col(c) < F.col(tip)) & (F.col(c) >= F.col(tip) - F.expr(f"interval {hours} hours"))
    return keep_one(df.where(inside(captured) & inside(forecast)), [key], [F.col(captured).asc(), F.col(forecast).asc()])


def pregame_projections(df: DataFrame, key: Sequence[str], tip: str = "tip_ts", ts: str = "ts") -> DataFrame:
    """the best kind (pre before first), then the latest, before the tip; active and positive only."""
    usable = df.where((F.col(ts) < F.col(tip)) & F.col("active") & (F.col("points") > 0))
    return keep_one(usable, key, [(F.col("kind") == "pre").desc(), F.col(ts).desc()])


def move_class(open_: Column, close: Column, small: float = 0.5, large: float = 1.5) -> Column:
    """F16: class of a line move, the stronger first."""
    d = F.abs(close - open_)
    return F.when(d >= large, "large").when(d >= small, "move").when(d > 0, "drift").when(d == 0, "none")


def rotation(df: DataFrame, group: Sequence[str], minutes: str, id_: str, starters: int = 5, rotation_: int = 9) -> DataFrame:
    """rank by minutes in the group; star, starter and rotation flags."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(minutes), id_))
    return df.withColumn("minutes_rank", rank).withColumns({"star": F.col("minutes_rank") == 1, "starter": F.col("minutes_rank") <= starters, "in_rotation": F.col("minutes_rank") <= rotation_})


def heavy_minutes(df: DataFrame, player: Sequence[str], minutes: str, regular: float, cap: float) -> DataFrame:
    """of regulars (mean of minutes at least `regular`), the share of rows over the cap."""
    mean = F.avg(minutes).over(Window.partitionBy(*player))
    return df.withColumn("m", mean).where(F.col("m") >= regular).agg(F.avg((F.col(minutes) > cap).cast("double")).alias("heavy_share"), F.count("*").alias("n"))


def complete_groups(df: DataFrame, group: Sequence[str], value: str, lo: float, hi: float) -> DataFrame:
    """rows of groups whose sum is plausible."""
    good = df.groupBy(*group).agg(F.sum(value).alias("s")).where(F.col("s").between(lo, hi)).drop("s")
    return df.join(good, list(group), "left_semi")


def memberships(df: DataFrame, rules: dict[str, Column], key: str) -> DataFrame:
    """long table (rule, key) of all rules in one pass."""
    flags = F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()))
    return df.select(F.explode(F.filter(flags, lambda x: x.isNotNull())).alias("rule"), key).distinct()


def ordered(df: DataFrame, *keys: Column) -> DataFrame:
    """Q01: mixed directions."""
    return df.orderBy(*keys)


def keep_one(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Q02: the first row of each key; the order must be total for a stable result."""
    return latest_n(df, key, order, 1)


def latest_n(df: DataFrame, key: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """Q03, Q04: the first n rows of each key (planned as a group limit before the shuffle)."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def best_arm(df: DataFrame, group: Sequence[str], arm: str, loss: str) -> DataFrame:
    """Q05: the arm of least summed loss in each group; ties go to the smaller name."""
    sums = df.groupBy(*group, arm).agg(F.sum(loss).alias("loss"))
    return sums.groupBy(*group).agg(F.min(F.struct(F.col("loss"), F.col(arm).alias("arm"))).alias("x")).select(*group, "x.arm", "x.loss")


def recent(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """Q06."""
    return df.orderBy(*order).limit(n)


def with_precedence(parts: Sequence[DataFrame], key: str) -> DataFrame:
    """Union in which any row of an earlier part, whatever its state, blocks its key in later ones."""
    out, seen = parts[0], parts[0].select(key)
    for p in parts[1:]:
        out, seen = out.unionByName(p.join(seen, key, "left_anti")), seen.unionByName(p.select(key))
    return out


def two_sides(df: DataFrame, keep: Sequence[str], home: dict[str, Column], away: dict[str, Column]) -> DataFrame:
    """Each row as two, one for each side."""
    side = lambda name, cols: F.struct(F.lit(name).alias("side"), *(c.alias(k) for k, c in cols.items()))
    return df.select(*keep, F.explode(F.array(side("home", home), side("away", away))).alias("x")).select(*keep, "x.*")


def replaced(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """New rows take the place of old ones of their key."""
    return old.join(new.select(*key).distinct(), list(key), "left_anti").unionByName(new)


def identical_keys(parts: Sequence[DataFrame], key: Sequence[str]) -> list[DataFrame]:
    """All parts cut down to the keys that every one has."""
    common = parts[0].select(*key).distinct()
    for p in parts[1:]:
        common = common.intersect(p.select(*key).distinct())
    return [p.join(common, list(key), "left_semi") for p in parts]


def training_seasons(seasons: DataFrame, season: str = "season", walk_forward: bool = True) -> DataFrame:
    """(test, train) pairs of a small dimension: earlier seasons only, or all others."""
    test, train = seasons.select(F.col(season).alias("test")), seasons.select(F.col(season).alias("train"))
    return test.join(F.broadcast(train), (F.col("train") < F.col("test")) if walk_forward else (F.col("train") != F.col("test")))
