"""Domain views over the driver's tables, and the registration of queries with their oracles.

`games` reads orders as games: the customer is the team, the order date the slate, its year the season, the
priority the book, the status the basis. Prices, probabilities and results are arithmetic on the keys, so that
both engines derive the same rows. `ticks` reads events as quotes: the user is the game, the value the quote.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, Sequence[str]] = {}

_BASE = """
    SELECT o_orderkey AS game_id, o_custkey AS team, CAST(o_orderdate AS DATE) AS slate, CAST(year(o_orderdate) AS INT) AS season, o_orderpriority AS book, o_orderstatus AS basis,
           o_totalprice AS amount, (o_orderkey * 31 + o_custkey * 17) % 1000 AS h, (o_orderkey * 7919 + o_custkey * 104729) % 97 AS r, (o_orderkey * 7 + o_custkey * 3) % 900 AS u
    FROM orders"""
_ML = """CAST(CASE WHEN {h} % 50 = 0 THEN 50 WHEN {h} < 500 THEN -(102 + {h} % 300) ELSE 100 + {h} % 280 END AS DOUBLE)"""
_AWAY = """CAST(CASE WHEN {h} % 70 = 0 THEN NULL WHEN {h} < 500 THEN 100 + floor(({h} % 300) * 0.85e0) ELSE -(112 + floor(({h} % 280) * 1.1e0)) END AS DOUBLE)"""
_GAMES = f"""
    SELECT game_id, team, slate, season, book, basis, amount, {{day}} AS day, {_ML.format(h="h")} AS home_ml, {_AWAY.format(h="h")} AS away_ml,
           {_ML.format(h="((h + 37) % 1000)")} AS close_home_ml, {_AWAY.format(h="((h + 37) % 1000)")} AS close_away_ml,
           CAST(u + 50 AS DOUBLE) / 1000 AS p, CAST(CASE WHEN (h + 3 * r) % 1000 < 520 THEN 1 ELSE 0 END AS INT) AS won,
           CAST((h + 3 * r) % 41 - 20 AS DOUBLE) AS margin, CAST((h + r) % 31 - 15 AS DOUBLE) / 2 AS spread, CAST(200 + r % 50 AS DOUBLE) AS total, CAST(195 + (h + r) % 60 AS DOUBLE) AS points
    FROM ({_BASE})"""
_TICKS = """
    SELECT event_id, user_id AS game, CAST(ts AS DATE) AS slate, {day} AS day, {sec} AS sec, event_type AS kind, value, props FROM events"""

_SPARK = {"game_day": "datediff(slate, DATE'1970-01-01')", "tick_day": "datediff(CAST(ts AS DATE), DATE'1970-01-01')", "sec": "CAST(unix_seconds(CAST(ts AS TIMESTAMP)) AS BIGINT)"}
_DUCK = {"game_day": "CAST(date_diff('day', DATE '1970-01-01', slate) AS INT)", "tick_day": "CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INT)", "sec": "CAST(floor(epoch(ts)) AS BIGINT)"}

GAMES_SQL = _GAMES.replace("{day}", _DUCK["game_day"])
TICKS_SQL = _TICKS.replace("{day}", _DUCK["tick_day"]).replace("{sec}", _DUCK["sec"])


#: Added before rounding, so that values half-way between two roundings fall on one side in both engines.
NUDGE = 3.3e-8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _BASE.replace("FROM orders", "FROM {orders}")
    return spark.sql(_GAMES.replace(_BASE, base).replace("{day}", _SPARK["game_day"]), orders=table(spark, sf_dir, "orders"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = _TICKS.replace("{day}", _SPARK["tick_day"]).replace("{sec}", _SPARK["sec"]).replace("FROM events", "FROM {events}")
    return spark.sql(text, events=table(spark, sf_dir, "events"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, off exact ties: sums differ in the last digits between engines."""
    return df.select(*((F.round(F.col(c) + NUDGE, digits) + 0.0).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes))


def query(covers: str, sql: str | None = None, doubles: str = "", name: str | None = None):
    """Register a query and, with SQL, its oracle; `g` and `e` are the games and ticks views in the SQL. doubles: its double columns."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        COVERS[key] = covers.split()
        if sql:
            views = []
            recursive = "RECURSIVE " if "RECURSIVE" in sql else ""
            body = sql.replace("RECURSIVE ", "")
            for alias, text in (("g", GAMES_SQL), ("e", TICKS_SQL)):
                views.append(f"{alias} AS ({text})")
            inner = f"WITH {recursive}{', '.join(views)}{', ' + body.strip()[5:] if body.strip().startswith('WITH ') else ' ' + body}"
            replace = f" REPLACE ({', '.join(f'round({c} + {NUDGE}, 6) + 0.0 AS {c}' for c in doubles.split())})" if doubles else ""
            ORACLES[key] = f"SELECT *{replace} FROM ({inner}) t"
        return f

    return register
