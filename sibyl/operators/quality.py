"""Data-quality constraints (C01-C09): one runner that returns violations as rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Constraint:
    """A name and what must hold of every row; null counts as a violation only with `strict`."""

    name: str
    holds: Column
    strict: bool = False


def violations(df: DataFrame, key: str, constraints: Sequence[Constraint]) -> DataFrame:
    """Rows (key, rule) that break a rule; all rules in one pass over the table."""
    broken = F.array(*(F.when(~F.coalesce(c.holds, F.lit(not c.strict)), F.lit(c.name)) for c in constraints))
    return df.select(F.col(key).cast("string").alias("key"), F.explode(F.filter(broken, lambda x: x.isNotNull())).alias("rule"))


def repeated_keys(df: DataFrame, keys: Sequence[str], rule: str) -> DataFrame:
    """Keys that are null or repeat."""
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where((F.col("n") > 1) | null).select(F.concat_ws("|", *(F.col(k).cast("string") for k in keys)).alias("key"), F.lit(rule).alias("rule"))


def one_value(df: DataFrame, keys: Sequence[str], value: str, rule: str) -> DataFrame:
    """Keys whose rows do not all have one value (one snapshot time a game)."""
    return df.groupBy(*keys).agg(F.count_distinct(value).alias("n")).where("n > 1").select(F.concat_ws("|", *(F.col(k).cast("string") for k in keys)).alias("key"), F.lit(rule).alias("rule"))


def orphans(df: DataFrame, parent: DataFrame, key: str, parent_key: str, rule: str) -> DataFrame:
    """Keys without a parent."""
    p = parent.select(F.col(parent_key).alias(key))
    return df.join(p, key, "left_anti").select(F.col(key).cast("string").alias("key"), F.lit(rule).alias("rule"))


def recomputed(df: DataFrame, key: str, stored: str, again: Column, rule: str, tolerance: float = 1e-9) -> DataFrame:
    """Stored figures that a recomputation does not give."""
    off = ~F.coalesce(F.abs(F.col(stored) - again) <= tolerance, F.col(stored).isNull() & again.isNull())
    return df.where(off).select(F.col(key).cast("string").alias("key"), F.lit(rule).alias("rule"))


def missing_inventory(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows (column, missing): nulls and NaNs."""
    kinds = dict(df.dtypes)
    bad = lambda c: F.col(c).isNull() | (F.isnan(c) if kinds[c] in ("double", "float") else F.lit(False))
    wide = df.agg(*(F.count_if(bad(c)).alias(c) for c in columns))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in columns))).alias("x")).select("x.*")


def all_of(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
