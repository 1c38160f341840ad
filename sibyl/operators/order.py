"""Exact ranks and quantiles of large groups: counts by value, cut into blocks of neighbouring values.

No task holds a whole group: windows run over one block of one group, and over the sums of a group's blocks. Blocks are cut at
approximate quantiles of all values; where the cuts lie decides the balance and no result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import stored

BLOCKS = 256
#: Children of a node in the descent of medians_before.
FAN = 16


def same(columns: Sequence[str]) -> Column:
    """Condition of a join of `l` with `r` on columns in which nulls are equal."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    return out


def summed_below(counts: DataFrame, by: Sequence[str], value: str, number: str, blocks: int = BLOCKS) -> DataFrame:
    """counts (one row for each group and value) with `_below`, the sum of `number` over smaller values of the group, and `_total`.

    The cuts, at most `blocks` numbers, go to the driver. A null value is the smallest.
    """
    found = counts.agg(F.percentile_approx(value, [i / blocks for i in range(1, blocks)], 10 * blocks)).first()[0] or []
    block = F.size(F.filter(F.array(*(F.lit(c) for c in sorted(set(found)))), lambda c: c < F.col(value))) if found else F.lit(0)
    cut = counts.withColumn("_block", F.coalesce(block, F.lit(0)))
    inside = Window.partitionBy(*by, "_block").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy(*by)
    sums = cut.groupBy(*by, "_block").agg(F.sum(number).alias("_s"))
    sums = sums.select(*by, "_block", F.coalesce(F.sum("_s").over(group.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"), F.sum("_s").over(group).alias("_t"))
    rows = cut.withColumn("_i", F.coalesce(F.sum(number).over(inside), F.lit(0))).alias("l").join(sums.alias("r"), same([*by, "_block"]))
    return rows.select(*(F.col(f"l.{c}") for c in counts.columns), (F.col("_i") + F.col("_b")).alias("_below"), F.col("_t").alias("_total"))


def quantiles(df: DataFrame, by: Sequence[str], value: Column, shares: Mapping[str, float], blocks: int = BLOCKS) -> DataFrame:
    """One row for each group with values: exact quantiles, on a line between the two values around each place. Nulls do not count."""
    counts = df.select(*by, value.alias("_x")).where("_x is not null").groupBy(*by, "_x").agg(F.count("*").alias("_n"))
    placed = summed_below(counts, by, "_x", "_n", blocks)
    aggs, out = [], []
    for i, (name, share) in enumerate(shares.items()):
        at = F.lit(float(share)) * (F.col("_total") - 1)
        holds = lambda k: (F.col("_below") <= k) & (k < F.col("_below") + F.col("_n"))
        low, high = F.col(f"_lo{i}").cast("double"), F.col(f"_hi{i}").cast("double")
        aggs += [F.max(F.when(holds(F.floor(at)), F.col("_x"))).alias(f"_lo{i}"), F.max(F.when(holds(F.ceil(at)), F.col("_x"))).alias(f"_hi{i}"), F.max(at - F.floor(at)).alias(f"_f{i}")]
        out.append((low + (high - low) * F.col(f"_f{i}")).alias(name))
    return placed.groupBy(*by).agg(*aggs).select(*by, *out)


def beside(df: DataFrame, others: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    """df, one row a group, with columns of others, at most one row a group; without `by` both have one row at most."""
    left, right = (df, others) if by else (df.withColumn("_one", F.lit(1)), others.withColumn("_one", F.lit(1)))
    joined = left.alias("l").join(right.alias("r"), same(by or ["_one"]), "left")
    return joined.select(*(F.col(f"l.{c}") for c in df.columns), *(F.col(f"r.{c}") for c in names))


def medians_before(df: DataFrame, by: Sequence[str], day: str, value: str) -> DataFrame:
    """Rows (by.., day, _median, _seen): the exact median of the values on earlier days of the group and their number, one row for each group and day.

    Values are numbered by how many lie below them in their group, and the two middle places of a day walk down a tree of these numbers, FAN
    children at a time: a running count over the days of one node says in which child the place lies. A level moves one row for each day, node and middle
    place, so the work grows with n log n, where a growing frame of values grows with n^2. Nulls of the group are a group; null values
    do not count; rows without a day have no earlier days and are on none. Days may be of any type with an order.
    """
    rows = df.select(*by, F.col(day).alias("_day"), F.col(value).alias("_x")).where("_day is not null")
    counts = rows.where("_x is not null").groupBy(*by, "_day", "_x").agg(F.count("*").alias("_n"))
    values = stored(summed_below(counts.groupBy(*by, "_x").agg(F.sum("_n").alias("_n")), by, "_x", "_n").select(*by, "_x", F.col("_below").alias("_id"), "_total"), "values")
    items = stored(counts.alias("l").join(values.alias("r"), same([*by, "_x"])).select(*(F.col(f"l.{c}") for c in [*by, "_day", "_n"]), "_id"), "places")
    largest, levels = values.agg(F.max("_total")).first()[0] or 0, 1
    while FAN**levels < largest:
        levels += 1
    past = Window.partitionBy(*by).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = rows.groupBy(*by, "_day").agg(F.count("_x").alias("_c")).withColumn("_seen", F.coalesce(F.sum("_c").over(past), F.lit(0))).drop("_c")
    middle = F.array_distinct(F.array(F.floor((F.col("_seen") - 1) / 2), F.floor(F.col("_seen") / 2)))
    asked = days.where("_seen > 0").select(*by, "_day", F.explode(middle).alias("_k"), F.lit(0).cast("long").alias("_node"))
    for level in reversed(range(levels)):
        width = FAN**level
        child = F.expr(f"_id div {width} % {FAN}")
        held = items.groupBy(*by, F.expr(f"_id div {width * FAN}").alias("_node"), "_day").agg(*(F.sum(F.when(child == c, F.col("_n")).otherwise(0)).alias(f"_n{c}") for c in range(FAN)))
        both = held.withColumn("_k", F.lit(None).cast("long")).unionByName(asked.withColumns({f"_n{c}": F.lit(0).cast("long") for c in range(FAN)}))
        # a day's places stand before its values
        before = Window.partitionBy(*by, "_node").orderBy("_day", F.col("_k").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        run = both.select(*by, "_day", "_k", "_node", *(F.sum(f"_n{c}").over(before).alias(f"_n{c}") for c in range(FAN))).where("_k is not null")
        upto = F.array(*(sum((F.col(f"_n{i}") for i in range(1, c + 1)), F.col("_n0")) for c in range(FAN)))
        run = run.select(*by, "_day", "_k", "_node", upto.alias("_upto")).withColumn("_child", F.size(F.filter("_upto", lambda s: s <= F.col("_k"))))
        left = F.when(F.col("_child") > 0, F.get("_upto", F.col("_child") - 1)).otherwise(0)
        asked = run.select(*by, "_day", (F.col("_k") - left).alias("_k"), (F.col("_node") * FAN + F.col("_child")).alias("_node"))
    found = asked.withColumn("_id", F.col("_node")).alias("l").join(values.alias("r"), same([*by, "_id"])).select(*(F.col(f"l.{c}") for c in [*by, "_day"]), "_x")
    medians = found.groupBy(*by, "_day").agg(F.avg("_x").alias("_median"))
    return beside(days, medians, [*by, "_day"], ["_median"]).withColumnRenamed("_day", day)
