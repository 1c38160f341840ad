"""Landed files and JSON text to tables (S01-S24). Schemas are stated, never inferred; blanks become null."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def evolved_csv(spark: SparkSession, path: str, vintages: Sequence[T.StructType], full: T.StructType, defaults: dict[str, object] | None = None) -> DataFrame:
    """A CSV of any known vintage as the full schema; absent columns are null, or a default for legacy rows."""
    header = spark.read.option("header", True).csv(path).columns
    found = next((v for v in vintages if v.names == header), None)
    if found is None:
        raise ValueError(f"unknown columns: {header}")
    df = spark.read.schema(found).option("header", True).option("nullValue", "").csv(path)
    absent = [f for f in full.fields if f.name not in header]
    df = df.withColumns({f.name: F.lit((defaults or {}).get(f.name)).cast(f.dataType) for f in absent})
    return df.select(*full.names)


def write_sorted(df: DataFrame, path: str, partition: str, keys: Sequence[str]) -> None:
    """Partitions replaced as a whole, rows sorted inside; the commit protocol makes it atomic."""
    df.repartition(partition).sortWithinPartitions(*keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def strict_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """All strings, from one file or a pattern; any drift of columns raises. The file name is kept."""
    df = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    if df.columns != list(columns):
        raise ValueError(f"columns are {df.columns}, not {list(columns)}")
    return df.withColumn("source_file", F.col("_metadata.file_name"))


def append_by_id(old: DataFrame, new: DataFrame, key: str, ignore: Sequence[str] = ()) -> DataFrame:
    """One row of every new id. An id repeated with equal values, in the batch or against what is there, counts once; with other
    values it raises while running. Columns of ignore (when a row was captured) are not compared; the smallest stays."""
    compared = [c for c in new.columns if c != key and c not in ignore]
    values = F.struct(*compared) if compared else F.struct(F.lit(0))
    conflict = F.raise_error(F.concat(F.lit("conflicting rows of id "), F.col(key).cast("string"))).cast("boolean")
    # of equal rows the smallest differs in the ignored columns alone
    rest = [c for c in new.columns if c in ignore]
    own = new.groupBy(key).agg(F.min(values).alias("_low"), F.max(values).alias("_high"), *([F.min(F.struct(*rest)).alias("_rest")] if rest else []))
    o = old.select(key, values.alias("_old"), F.lit(True).alias("_there"))
    j = own.join(o, key, "left")
    ok = F.when(~F.col("_low").eqNullSafe(F.col("_high")), conflict).when(F.col("_there").isNull(), True).when(F.col("_old").eqNullSafe(F.col("_low")), False).otherwise(conflict)
    return j.where(ok).select(*(F.col(key) if c == key else F.col(f"{'_rest' if c in rest else '_low'}.{c}").alias(c) for c in new.columns))


_TEAM = "struct<homeAway:string,score:string,winner:boolean,team:struct<abbreviation:string>>"
SCOREBOARD = f"struct<events:array<struct<id:string,date:string,season:struct<type:int>,status:struct<type:struct<state:string>>,competitions:array<struct<competitors:array<{_TEAM}>>>>>>"


def scoreboard(df: DataFrame, text: str) -> DataFrame:
    """One row a game."""
    e = df.select(F.explode(F.from_json(text, SCOREBOARD)["events"]).alias("e"))
    side = lambda h: F.try_element_at(F.filter(F.col("e.competitions")[0]["competitors"], lambda c: c["homeAway"] == h), F.lit(1))
    home, away = side("home"), side("away")
    return e.select(F.col("e.id").alias("game_id"), F.col("e.date").alias("tip"), F.col("e.season.type").alias("season_type"), F.col("e.status.type.state").alias("state"), home["team"]["abbreviation"].alias("home"), away["team"]["abbreviation"].alias("away"), home["score"].try_cast("double").alias("home_score"), away["score"].try_cast("double").alias("away_score"))


INJURIES = "struct<injuries:array<struct<team:struct<abbreviation:string>,injuries:array<struct<athlete:struct<id:string,displayName:string>,status:string>>>>>"


def injuries(df: DataFrame, text: str, key: str, home: str, away: str) -> DataFrame:
    """One row a listed player; a team with nobody listed has a NONE row; a missing block gives no rows at all."""
    parsed = df.select(key, home, away, F.from_json(text, INJURIES)["injuries"].alias("blocks")).where("blocks is not null")
    teams = parsed.select(key, F.explode(F.array(home, away)).alias("team"), "blocks")
    own = F.flatten(F.transform(F.filter("blocks", lambda b: b["team"]["abbreviation"] == F.col("team")), lambda b: b["injuries"]))
    rows = teams.select(key, "team", F.explode_outer(own).alias("p"))
    return rows.select(key, "team", F.col("p.athlete.id").alias("player_id"), F.col("p.athlete.displayName").alias("name"), F.coalesce("p.status", F.lit("NONE")).alias("status"))


_PRICE = "struct<american:string>"
_SIDE = f"struct<current:struct<moneyLine:{_PRICE}>,open:struct<moneyLine:{_PRICE}>,close:struct<moneyLine:{_PRICE}>>"
ODDS = f"struct<items:array<struct<provider:struct<id:string,name:string>,spread:double,overUnder:double,homeTeamOdds:{_SIDE},awayTeamOdds:{_SIDE}>>>"


def book_odds(df: DataFrame, text: str, key: str, books: dict[str, str]) -> DataFrame:
    """The first item of each known book: current, open and close moneylines, spread and total."""
    from ..functions.prices import mapped, parse_american

    items = df.select(key, F.posexplode(F.from_json(text, ODDS)["items"]).alias("pos", "i")).where(F.col("i.provider.id").isin(*books))
    first = items.groupBy(key, F.col("i.provider.id").alias("provider")).agg(F.min_by("i", "pos").alias("i"))
    ml = lambda side, kind: parse_american(F.col(f"i.{side}TeamOdds.{kind}.moneyLine.american")).alias(f"{kind}_{side}_ml")
    return first.select(key, mapped(F.col("provider"), books).alias("book"), F.col("i.spread").alias("spread"), F.col("i.overUnder").alias("total"), *(ml(s, k) for k in ("current", "open", "close") for s in ("home", "away")))


def providers(df: DataFrame, text: str, key: str) -> DataFrame:
    """Every listed provider, whatever the book."""
    return df.select(key, F.explode(F.from_json(text, ODDS)["items"]).alias("i")).select(key, F.col("i.provider.id").alias("provider"), F.col("i.provider.name").alias("name"), F.col("i.spread").alias("spread"))


BOX = "struct<boxscore:struct<players:array<struct<team:struct<abbreviation:string>,statistics:array<struct<keys:array<string>,athletes:array<struct<athlete:struct<id:string,displayName:string>,didNotPlay:boolean,stats:array<string>>>>>>>>>"


def box_rows(df: DataFrame, text: str, key: str, stats: Sequence[str], dnp_zero: bool = False) -> DataFrame:
    """Player rows from positional keys and values; players who did not play are left out, or count 0."""
    p = df.select(key, F.explode(F.from_json(text, BOX)["boxscore"]["players"]).alias("p"))
    s = p.select(key, F.col("p.team.abbreviation").alias("team"), F.explode("p.statistics").alias("s"))
    a = s.select(key, "team", F.col("s.keys").alias("keys"), F.explode("s.athletes").alias("a"))
    full = F.size("keys") == F.size("a.stats")
    value = F.when(full, F.map_from_arrays("keys", "a.stats"))
    dnp = F.coalesce("a.didNotPlay", F.lit(False))
    rows = a.select(key, "team", F.col("a.athlete.id").alias("player_id"), F.col("a.athlete.displayName").alias("name"), dnp.alias("dnp"), *(F.try_element_at(value, F.lit(k)).try_cast("double").alias(k) for k in stats))
    if dnp_zero:
        return rows.withColumns({k: F.when(F.col("dnp"), 0.0).otherwise(F.col(k)) for k in stats})
    return rows.where("not dnp").drop("dnp")


PROJECTIONS = "array<struct<player_id:string,date:string,team:string,updated:bigint,stats:map<string,double>>>"


def projections(df: DataFrame, text: str) -> DataFrame:
    """One row a player and game; seconds to minutes; listed without a line is 0 minutes; of repeats the last."""
    rows = df.select(F.posexplode(F.from_json(text, PROJECTIONS)).alias("pos", "r")).select("pos", "r.*")
    last = rows.withColumn("_n", F.row_number().over(Window.partitionBy("player_id", "date").orderBy(F.desc_nulls_last("updated"), F.desc("pos")))).where("_n = 1")
    return last.select("player_id", "date", "team", (F.coalesce(F.try_element_at("stats", F.lit("sp")), F.lit(0.0)) / 60).alias("minutes"), F.try_element_at("stats", F.lit("pts")).alias("pts"))


PLAYERS = "map<string,struct<full_name:string,team:string,active:boolean,fantasy_positions:array<string>>>"


def players(df: DataFrame, text: str, positions: Sequence[str] = ("PG", "SG", "SF", "PF", "C", "G", "F")) -> DataFrame:
    """Active players at a known position from a map of ids."""
    rows = df.select(F.explode(F.from_json(text, PLAYERS)).alias("player_id", "p"))
    known = F.arrays_overlap("p.fantasy_positions", F.array(*map(F.lit, positions)))
    return rows.where(F.col("p.active") & known).select("player_id", F.col("p.full_name").alias("name"), F.col("p.team").alias("team"), F.array_join("p.fantasy_positions", "-").alias("positions"))


SALARIES = "struct<slates:array<struct<id:string,start:string,players:array<struct<code:string,name:string,team:string,position:string,salary:int,fppg:double>>>>>"


def salaries(df: DataFrame, text: str) -> DataFrame:
    """S13."""
    s = df.select(F.explode(F.from_json(text, SALARIES)["slates"]).alias("s"))
    return s.select(F.col("s.id").alias("slate_id"), F.col("s.start").alias("start"), F.explode("s.players").alias("p")).select("slate_id", "start", "p.*")


PROPS = "struct<lines:array<struct<appearance_id:string,stat:string,value:double>>,appearances:array<struct<id:string,player_id:string,match_id:string>>,players:array<struct<id:string,name:string,team:string>>,games:array<struct<id:string,start:string>>>"


def linked_props(df: DataFrame, text: str) -> DataFrame:
    """Lines, appearances, players and games joined on their ids inside each payload: arrays of one document, so no join is needed."""
    p = df.select(F.from_json(text, PROPS).alias("x"))
    find = lambda arr, key: F.try_element_at(F.filter(arr, lambda r: r["id"] == key), F.lit(1))
    rows = p.select("x", F.explode("x.lines").alias("l")).withColumn("a", find(F.col("x.appearances"), F.col("l.appearance_id")))
    rows = rows.withColumn("pl", find(F.col("x.players"), F.col("a.player_id"))).withColumn("g", find(F.col("x.games"), F.col("a.match_id")))
    return rows.where("a is not null").select(F.col("g.id").alias("game"), F.col("g.start").alias("start"), F.col("pl.name").alias("name"), F.col("pl.team").alias("team"), F.col("l.stat").alias("stat"), F.col("l.value").alias("line"))


NESTED_PROPS = "array<struct<events:array<struct<id:string,startTime:bigint,displayGroups:array<struct<markets:array<struct<description:string,outcomes:array<struct<description:string,price:struct<american:string,handicap:string>>>>>>>>>>>"


def nested_props(df: DataFrame, text: str) -> DataFrame:
    """Groups, events, display groups, markets and outcomes; the player and team come from the label."""
    from ..functions.prices import parse_american

    e = df.select(F.explode(F.from_json(text, NESTED_PROPS)).alias("g")).select(F.explode("g.events").alias("e"))
    m = e.select("e.id", F.timestamp_millis("e.startTime").alias("start"), F.explode("e.displayGroups").alias("d")).select("id", "start", F.explode("d.markets").alias("m"))
    o = m.select("id", "start", F.col("m.description").alias("label"), F.explode("m.outcomes").alias("o"))
    label = r"^(.*?) - (.*?) \(([A-Z]+)\)$"
    return o.select("id", "start", F.regexp_extract("label", label, 1).alias("stat"), F.regexp_extract("label", label, 2).alias("name"), F.regexp_extract("label", label, 3).alias("team"), F.col("o.description").alias("side"), F.col("o.price.handicap").try_cast("double").alias("line"), parse_american(F.col("o.price.american")).alias("ml"))


PLAYS = "struct<plays:array<struct<period:struct<number:int>,clock:struct<displayValue:string>,homeScore:int,awayScore:int>>,pickcenter:array<struct<provider:struct<name:string>,details:string>>>"


def plays(df: DataFrame, text: str, key: str) -> DataFrame:
    """Plays in their order."""
    from ..functions.scalars import clock_seconds

    p = df.select(key, F.posexplode(F.from_json(text, PLAYS)["plays"]).alias("pos", "p"))
    return p.select(key, "pos", F.col("p.period.number").alias("period"), clock_seconds(F.col("p.clock.displayValue")).alias("clock"), F.col("p.homeScore").alias("home"), F.col("p.awayScore").alias("away"))


def line_votes(df: DataFrame, text: str, key: str) -> DataFrame:
    """S16: 'BOS -5.5' to (team, 5.5) for each provider."""
    v = df.select(key, F.explode(F.from_json(text, PLAYS)["pickcenter"]).alias("v"))
    team = F.regexp_extract("v.details", r"^([A-Z]+) -([0-9.]+)$", 1)
    return v.select(key, F.col("v.provider.name").alias("provider"), F.when(team != "", team).alias("team"), F.regexp_extract("v.details", r"^([A-Z]+) -([0-9.]+)$", 2).try_cast("double").alias("line"))


def report_rows(lines: DataFrame, file: str, number: str, text: str) -> DataFrame:
    """Date, matchup and team are carried down to the player lines; NOT YET SUBMITTED gives a coverage row."""
    t = F.col(text)
    got = lambda p: F.nullif(F.regexp_extract(t, p, 1), F.lit(""))
    past = Window.partitionBy(file).orderBy(number).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = lines.withColumns({"game_date": F.last(got(r"(\d{2}/\d{2}/\d{2,4})"), True).over(past), "matchup": F.last(got(r"\b([A-Z]{3}@[A-Z]{3})\b"), True).over(past), "team": F.last(got(r"^TEAM: (.+)$"), True).over(past)})
    player = got(r"^([^,:]+, [^,:]+) (?:Out|Doubtful|Questionable|Probable|Available)\b")
    status = got(r"^[^,:]+, [^,:]+ (Out|Doubtful|Questionable|Probable|Available)\b")
    late = t.contains("NOT YET SUBMITTED")
    return carried.withColumns({"player": player, "status": F.when(late, "PENDING").otherwise(status)}).where(F.col("status").isNotNull()).select(file, number, "game_date", "matchup", "team", "player", "status")


def candle_price(candle: Column, name: str, zero: bool = False) -> Column:
    """Dollars, dollar text or cents as a price in (0, 1), in [0, 1) with `zero`, where an empty side is quoted at 0. candle: a map of texts."""
    v = F.coalesce(F.try_element_at(candle, F.lit(f"{name}_dollars")).try_cast("double"), F.try_element_at(candle, F.lit(name)).try_cast("double") / 100)
    return F.when(((v >= 0) if zero else (v > 0)) & (v < 1), v)


def pending_work(wanted: DataFrame, stored: DataFrame, keys: Sequence[str] = ("season", "fingerprint")) -> DataFrame:
    """Seasons whose fingerprint the store lacks."""
    return wanted.join(stored.select(*keys).distinct(), list(keys), "left_anti")


def open_dates(rows: DataFrame, done: DataFrame, date: str, state: str, final: str = "post") -> tuple[DataFrame, DataFrame]:
    """Rows of dates without a done marker, and the dates that may be marked (nothing in them is pending)."""
    left = rows.join(done.select(date), date, "left_anti")
    return left, left.groupBy(date).agg(F.bool_and(F.col(state) == final).alias("_all")).where("_all").select(date)


def summary_mart(record: DataFrame, keys: Sequence[str], path: str) -> None:
    """The summary table by basis, book and season, replaced as a whole."""
    record.coalesce(1).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)
