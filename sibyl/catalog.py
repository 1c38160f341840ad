"""All registered queries over the driver's tables, with DuckDB oracles where SQL can express them."""

from __future__ import annotations

from .plans import audits, driver, feeds, histories, ingest, prices, refits, remaining, samples, teams  # noqa: F401  (importing registers)

QUERIES, ORACLES, COVERS = driver.QUERIES, driver.ORACLES, driver.COVERS
FLAGSHIP = "roi_summary"
