"""Capped proportional allocation inside groups (water-filling)."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def allocate(df: DataFrame, group: Sequence[str], weight: str, total: float, cap: float, ties: Sequence[str]) -> DataFrame:
    """Shares of `total` in proportion to weights, none above `cap`; what is cut goes to the others in proportion.

    Sorted by weight, the k largest are capped where k is the least number for which the next share fits; so prefix
    sums over the group give the answer without a loop.
    """
    down = Window.partitionBy(*group).orderBy(F.desc(weight), *ties)
    rest = F.sum(weight).over(Window.partitionBy(*group)) - F.coalesce(F.sum(weight).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    k = F.row_number().over(down) - 1
    share = F.when(rest > 0, F.col(weight) / rest * (total - k * cap)).otherwise(0.0)
    d = df.withColumns({"_k": k, "_s": share, "_rest": rest}).withColumn("_fits", F.col("_s") <= cap)
    first = F.min(F.when(F.col("_fits"), F.col("_k"))).over(Window.partitionBy(*group))
    d = d.withColumn("_first", first)
    at = lambda c: F.max(F.when(F.col("_k") == F.col("_first"), F.col(c))).over(Window.partitionBy(*group))
    level = F.when(at("_rest") > 0, (total - F.col("_first") * cap) / at("_rest")).otherwise(0.0)
    return d.withColumn("allocated", F.when(F.col("_first").isNull() | (F.col("_k") < F.col("_first")), F.lit(cap)).otherwise(F.col(weight) * level)).drop("_k", "_s", "_fits", "_first", "_rest")


@F.pandas_udf(T.StringType())
def exact_name(names: pd.Series) -> pd.Series:
    """Name key by Unicode decomposition, where the accent map of norm_name is not enough."""
    import re
    import unicodedata

    def one(x: str | None) -> str | None:
        if x is None:
            return None
        plain = "".join(c for c in unicodedata.normalize("NFKD", x.lower()) if not unicodedata.combining(c))
        words = re.sub(r"[^a-z0-9]+", " ", re.sub(r"[.'’`]", "", plain)).strip()
        return re.sub(r" (jr|sr|ii|iii|iv|v)$", "", words)

    return names.map(one)


def keyed_values(df: DataFrame, values: DataFrame, keys: Sequence[str], default: Column) -> DataFrame:
    """A value function (player, date) as a keyed table in place of a closure."""
    return df.join(values, list(keys), "left").withColumn("value", F.coalesce("value", default))
