"""These queries leave out no row, day, season or key of their table."""

from __future__ import annotations

import duckdb
import pytest

from sibyl import catalog
from sibyl.plans.driver import GAMES_SQL

SF = "/root/testdata/sf0.001"
ROWS = {
    "odds_feed": "count(*)", "scoreboard_feed": "count(*)", "nested_prop_feed": "count(*)", "due_games": "count(*)", "graded_log": "count(*)",
    "aged_refits": "count(DISTINCT day)", "price_windows": "count(DISTINCT home_ml)",
}


@pytest.fixture(scope="module")
def value():
    con = duckdb.connect()
    for t in ("orders", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    con.execute(f"CREATE VIEW g AS {GAMES_SQL}")
    return lambda sql: con.execute(sql).fetchone()[0]


@pytest.mark.parametrize("name", sorted(ROWS))
def test_rows_of_all_games(spark, value, name):
    assert catalog.QUERIES[name](spark, SF).count() == value(f"SELECT {ROWS[name]} FROM g")


@pytest.mark.parametrize("name", ["rule_lineage", "team_codes"])
def test_rows_of_all_customers(spark, value, name):
    assert catalog.QUERIES[name](spark, SF).count() == value("SELECT count(*) FROM customer")


def test_all_forecasts_and_seasons(spark, value):
    assert {r["official"] for r in catalog.QUERIES["forward_score"](spark, SF).collect()} == {value("SELECT count(*) FROM g")}
    assert catalog.QUERIES["band_matrix"](spark, SF).columns == ["pb", *map(str, value("SELECT list_sort(list(DISTINCT season)) FROM g"))]
