"""Who is missing: players newly out and players coming back (J27), and grids of report leads and rules."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.features import play_chance
from .joins import as_of
from .refits import packed_sums, cumulated, solved, width
from .tables import stored

#: Statuses that keep a player out.
GONE = ("Out", "Doubtful")
#: A day after all others.
_NEVER = 2**31 - 1


def roster_changes(box: DataFrame, statuses: DataFrame, worths: DataFrame, season: str = "season", gone: Sequence[str] = GONE) -> DataFrame:
    """Rows (season, team, game, day, newly_out, returning, returning_listed), sums of players' values for every game of a team.

    newly_out: players with minutes in the team's previous game who are listed out. returning: players whose latest appearance on an
    earlier day of the season, for any team, was for this one, who were not in its previous game and are not listed out;
    returning_listed: those of them with another status. The game's own box says nothing.

    box: (season, game, day, team, player, minutes), days as whole numbers; statuses: (game, player, status), one row a player and game;
    worths: (player, day, value): the value in force is the last one of an earlier day, 0 without any. Rows without season, game, day or team
    are left out; of two appearances on a day the one with the larger game is the latest, and repeated rows count once.

    Everything about a player is one line of its season: appearances and new values hold from the next day on, and the games it was in before or
    is listed for stand for themselves. Between two of those neither team nor value changes, so such a run is spread over its games where it
    is read and added up before anything is moved: no pair of a player and a game it misses is shuffled, and no key is longer than a player's season.
    """
    key, mine = [season, "team"], [season, "player"]
    known = box.dropna(subset=[season, "team", "game", "day"])
    in_order = Window.partitionBy(*key).orderBy("day", "game")
    games = known.select(*key, "game", "day").distinct().withColumns({"_n": F.row_number().over(in_order), "_at": F.lead("day").over(in_order)})
    games = stored(games, "team-games")
    last = games.groupBy(season).agg(F.max("day").alias("_last"))
    dates = games.groupBy(*key, "day").agg(F.max("_n").alias("_to")).withColumn("_end", F.lead("day").over(Window.partitionBy(*key).orderBy("day"))).join(last, season)
    until = F.coalesce(F.col("_end") - 1, F.col("_last"))
    # how many games of the team are on or before each day of the season; beyond it there are all
    calendar = stored(dates.select(*key, F.explode(F.concat(F.sequence("day", until.cast(dates.schema["day"].dataType)), F.when(F.col("_end").isNull(), F.array(F.lit(_NEVER))).otherwise(F.array()))).alias("_day"), "_to"), "team-days")

    played = known.where(F.col("minutes") > 0).where("player is not null").select(*key, "game", "day", "player")
    # _kind 0: a game, seen before the day's changes; 1: changes that hold after the day
    none = lambda c: F.lit(None).cast(games.schema[c].dataType)
    seen = F.struct(F.col("day"), F.lit(1).alias("_kind"), none("team").alias("_team"), none("_n").alias("_n"), F.struct("game", "team").alias("_on"), F.lit(False).alias("_before"))
    then = F.struct(F.col("_at").alias("day"), F.lit(0).alias("_kind"), F.col("team").alias("_team"), (F.col("_n") + 1).alias("_n"), F.lit(None).cast(games.select(F.struct("game", "team").alias("_on")).schema["_on"].dataType).alias("_on"), F.lit(True).alias("_before"))
    rows = played.join(games, [*key, "game", "day"]).select(*mine, F.inline(F.when(F.col("_at").isNull(), F.array(seen)).otherwise(F.array(seen, then))))
    listed = statuses.where("status is not null").join(games, "game").select(*mine, "day", F.lit(0).alias("_kind"), F.col("team").alias("_team"), "_n", "status")
    first = played.groupBy(*mine).agg(F.min("day").alias("_first")).join(last, season)
    worth = worths.select("player", "day", "value", F.lead("day").over(Window.partitionBy("player").orderBy("day", "value")).alias("_until")).where("_until is null or _until > day").join(first, "player")
    worth = worth.where((F.col("day") < F.col("_last")) & (F.col("_until").isNull() | (F.col("_until") >= F.col("_first"))))
    worth = worth.select(*mine, "day", F.lit(1).alias("_kind"), F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("_worth"))
    line = rows.unionByName(listed, True).unionByName(worth, True).repartition(*mine)

    order = ["day", "_kind", "_team", "_n"]
    line = line.groupBy(*mine, *order).agg(F.max("_on")["team"].alias("_on"), *(F.max(c).alias(c) for c in ("_before", "status", "_worth")))
    past = Window.partitionBy(*mine).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    line = line.select(*mine, *order, F.coalesce("_before", F.lit(False)).alias("_before"), "status", F.last("_on", True).over(past).alias("team"), F.coalesce(F.last("_worth", True).over(past), F.lit(0.0)).alias("value"))
    change, own = F.col("_kind") == 1, F.coalesce(F.col("_team") == F.col("team"), F.lit(False))
    line = line.where((change & F.col("team").isNotNull()) | own | F.col("_before"))
    # days are even numbers and games odd ones, as a window moves numbers faster than structs
    line = line.withColumn("_edge", F.when(change, F.col("day").cast("long") * 2).when(own, F.col("_n").cast("long") * 2 + 1))
    line = line.withColumn("_next", F.expr(f"lead(_edge) IGNORE NULLS OVER (PARTITION BY `{season}`, player ORDER BY {', '.join(order)})"))
    next_game = F.col("_next") % 2 != 0
    # a run begins behind its own edge and ends before the next one
    upto = lambda name, out: calendar.select(*key, F.col("_day").alias(name), F.col("_to").alias(out))
    line = line.withColumns({"_from_day": F.when(change, F.col("day")), "_to_day": F.when(F.col("_next").isNull(), F.lit(_NEVER).cast("long")).when(~next_game, F.shiftright("_next", 1))})
    line = line.join(upto("_from_day", "_lo"), [*key, "_from_day"], "left").join(upto("_to_day", "_hi"), [*key, "_to_day"], "left")
    lo, hi = F.coalesce(F.col("_lo"), F.col("_n")) + 1, F.coalesce(F.col("_hi"), F.shiftright("_next", 1).cast("int") - 1)
    out = F.coalesce(F.col("status").isin(*gone), F.lit(False))
    before = F.col("_before")
    item = lambda team, a, b, what: F.struct(F.col(team).alias("team"), a.alias("_a"), b.alias("_b"), F.lit(what).alias("_what"))
    n = F.col("_n")
    items = F.array(
        F.when((change | own) & (lo <= hi), item("team", lo, hi, 0)),  # in no report
        F.when(~change & before & out, item("_team", n, n, 1)),
        F.when(~change & own & ~before & ~out, item("_team", n, n, 2)),
    )
    runs = line.select(season, "value", F.inline(F.filter(items, lambda x: x.isNotNull()))).select(*key, "value", "_what", F.explode(F.sequence("_a", "_b")).alias("_n"))
    some = lambda *what: F.sum(F.when(F.col("_what").isin(*what), F.col("value")).otherwise(0.0))
    sums = runs.groupBy(*key, "_n").agg(some(1).alias("newly_out"), some(0, 2).alias("returning"), some(2).alias("returning_listed"))
    return games.join(sums, [*key, "_n"], "left").select(*key, "game", "day", *(F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ("newly_out", "returning", "returning_listed")))


@dataclass(frozen=True)
class Arm:
    """Inputs of one arm: the rule and lead (None: the lead that is scored) of the rows it is fitted on, and the rule of those it scores."""

    name: str
    fit_rule: str
    score_rule: str
    fit_lead: int | None = None


def fitted_chances(listed: DataFrame, season: str = "season") -> DataFrame:
    """Rows (season, lead, status, chance): the share of listed players of earlier seasons who played."""
    n = listed.where("status is not null").groupBy(season, "lead", "status").agg(F.count("*").alias("_n"), F.sum(F.col("played").cast("double")).alias("_k"))
    past = Window.partitionBy("lead", "status").orderBy(season).rangeBetween(Window.unboundedPreceding, -1)
    return n.select(season, "lead", "status", (F.sum("_k").over(past) / F.sum("_n").over(past)).alias("chance"))


def report_grid(members: DataFrame, reports: DataFrame, games: DataFrame, leads: Sequence[int], arms: Sequence[Arm], season: str = "season", least: int = 30) -> DataFrame:
    """Rows (season, lead, arm, n, rmse, added): every arm at every lead on the same games; added is its mean squared error less that of the first arm.

    members: (season, day, game, player, home, tip, value, played); reports: (game, player, ts, status); games: (game, margin). tip and ts are
    seconds, day a whole number. The status in force is the last one at least a lead before the tip. Rule "fixed" takes those listed out (E12's
    chances below a half) as missing, "rates" takes away one less the chance of earlier seasons, the fixed chance where there is none. A day is
    predicted by the fit of the margin on all earlier days; days after fewer than `least` games are left out.

    Members and reports are moved once, by game: the statuses of all leads are frames of one sorted line, and a game is one row with a term for
    each lead and rule. Statuses and terms are stored, as the shares that played are made of all statuses and the fits of all terms.
    """
    at = F.struct(F.col("ts").alias("t"), F.col("status").alias("status"))
    said = reports.select("game", "player", F.col("ts").alias("_t"), at.alias("_r"))
    one = members.select(season, "day", "game", "player", F.col("tip").alias("_t"), (F.when(F.col("home"), 1.0).otherwise(-1.0) * F.coalesce(F.col("value"), F.lit(0.0))).alias("_side"), F.col("played").cast("double").alias("_played"), F.lit(True).alias("_member"))
    line = one.unionByName(said, True).repartition("game")
    until = lambda lead: Window.partitionBy("game", "player").orderBy("_t").rangeBetween(Window.unboundedPreceding, -lead)
    statuses = [F.max("_r").over(until(lead))["status"].alias(f"_status_{i}") for i, lead in enumerate(leads)]
    listed = stored(line.select(season, "day", "game", "_side", "_played", "_member", *statuses).where("_member").drop("_member"), "listed")
    long = listed.select(season, "_played", F.inline(F.array(*(F.struct(F.lit(lead).alias("lead"), F.col(f"_status_{i}").alias("status")) for i, lead in enumerate(leads)))))
    shares = fitted_chances(long.withColumnRenamed("_played", "played"), season)
    # a row a season with the shares of all leads and statuses
    known = shares.where("chance is not null").groupBy(season).agg(F.map_from_entries(F.collect_list(F.struct(F.struct("lead", "status").alias("key"), "chance"))).alias("_chances"))
    chance = listed.join(F.broadcast(known), season, "left")
    name = lambda lead, rule: f"_{rule}_{lead}"
    sums = []
    for i, lead in enumerate(leads):
        status = F.col(f"_status_{i}")
        rate = F.when(status.isNotNull(), F.try_element_at(F.col("_chances"), F.struct(F.lit(lead).alias("lead"), status.alias("status"))))
        gone = {"fixed": (play_chance(status) < 0.5).cast("double"), "rates": 1 - F.coalesce(rate, play_chance(status))}
        sums += [F.sum(F.col("_side") * g).alias(name(lead, rule)) for rule, g in gone.items()]
    terms = stored(chance.groupBy(season, "day", "game").agg(*sums).join(games.select("game", "margin"), "game"), "terms")

    def cell(lead: int, arm: Arm) -> Column:
        fit = F.col(name(lead if arm.fit_lead is None else arm.fit_lead, arm.fit_rule))
        return F.struct(F.lit(lead).alias("lead"), F.lit(arm.name).alias("arm"), fit.alias("_fit"), F.col(name(lead, arm.score_rule)).alias("_score"))

    cells = terms.select(season, "day", "margin", F.inline(F.array(*(cell(lead, a) for lead in leads for a in arms))))
    by = ["lead", "arm"]
    fits = solved(cumulated(packed_sums(cells, [*by, "day"], ["_fit"], "margin"), "day", width(2), by), 2, least)
    error = F.col("margin") - (F.col("coef")[0] * F.col("_score") + F.col("coef")[1])
    scored = cells.join(F.broadcast(fits.where("coef is not null")), [*by, "day"])  # a row a day, lead and arm
    scored = scored.groupBy(season, *by).agg(F.count("*").alias("n"), F.avg(error * error).alias("_mse"))
    first = F.max(F.when(F.col("arm") == arms[0].name, F.col("_mse"))).over(Window.partitionBy(season, "lead"))
    return scored.select(season, *by, "n", F.sqrt("_mse").alias("rmse"), (F.col("_mse") - first).alias("added"))
