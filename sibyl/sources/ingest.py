"""Tables that are filled a part at a time: seasons that are stored under a fingerprint of their inputs (S19), dates that close (S20), and
lookups that refuse to serve another fit (S22)."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import exists, stored


def fingerprints(inputs: DataFrame, season: str, columns: Sequence[str], parameters: dict) -> DataFrame:
    """Rows (season, fingerprint): a digest of a season's rows, whatever their order, and of the parameters. Repeated rows count; one shuffle of sums."""
    row = F.struct(*(F.col(c) for c in columns))
    halves = [F.xxhash64(row, F.lit(n)).cast("decimal(20,0)") for n in (1, 2)]
    s = inputs.groupBy(season).agg(F.count("*").alias("n"), *(F.sum(h).alias(f"_h{i}") for i, h in enumerate(halves)))
    fixed = hashlib.sha256(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()
    return s.select(season, F.sha2(F.concat_ws(":", F.lit(fixed), "n", "_h0", "_h1"), 256).alias("fingerprint"))


def season_terms(inputs: DataFrame, season: str, columns: Sequence[str], parameters: dict, path: str, compute: Callable[[DataFrame], tuple[DataFrame, DataFrame | None]], running: int) -> DataFrame:
    """Terms of all seasons of inputs, computed only where nothing is stored under the same fingerprint.

    compute(inputs of some seasons) -> terms with a season column, and the seasons that could not be read whole (None: all could). Those and seasons
    from `running` on are served but not stored, so the next call tries again. A stored season is replaced as a whole, by a dynamic overwrite
    of its partition; a season that is not computed again keeps its files. Seasons are a small dimension.
    """
    spark = inputs.sparkSession
    keys = stored(fingerprints(inputs, season, columns, parameters), "fingerprints")
    held = spark.read.parquet(path) if exists(spark, path) else None
    fresh = held.join(F.broadcast(keys), [season, "fingerprint"], "left_semi") if held is not None else None
    work = keys if held is None else keys.join(held.select(season, "fingerprint").distinct(), [season, "fingerprint"], "left_anti")
    work = stored(work, "stale-seasons")
    if work.isEmpty():
        return fresh.drop("fingerprint")
    kept = stored(fresh, "fresh-terms") if fresh is not None else None  # read before its neighbours are overwritten
    terms, failed = compute(inputs.join(F.broadcast(work.select(season)), season, "left_semi"))
    names = terms.columns
    terms = stored(terms.join(F.broadcast(work), season).select(*names, "fingerprint"), "season-terms")
    keep = terms.where(F.col(season) < running)
    if failed is not None:
        keep = keep.join(F.broadcast(failed.select(season)), season, "left_anti")
    if not keep.isEmpty():
        keep.repartition(season).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(season).parquet(path)
    out = terms if kept is None else terms.unionByName(kept.select(*terms.columns))
    return out.drop("fingerprint")


def write_lookup(df: DataFrame, path: str, meta: dict) -> None:
    """A lookup table with what it was made for; the description is written last, so a table without one is unfinished."""
    df.write.mode("overwrite").parquet(f"{path}/rows")
    df.sparkSession.createDataFrame([(json.dumps(meta, sort_keys=True),)], "meta string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def read_lookup(spark: SparkSession, path: str, meta: dict, lead: str | None = None, leads: Sequence[int] = ()) -> DataFrame:
    """The lookup table, if it was made for just this; else an error that names both. With lead, its rows have to cover those leads and no others."""
    found = json.loads(spark.read.parquet(f"{path}/meta").first()[0])
    if found != json.loads(json.dumps(meta)):
        raise ValueError(f"{path} was made for {found}, not for {meta}")
    rows = spark.read.parquet(f"{path}/rows")
    if lead is not None:
        held = {r[0] for r in rows.select(lead).distinct().limit(len(leads) + 1).collect()}
        if held != set(leads):
            raise ValueError(f"{path} has leads {sorted(held)}, not {sorted(leads)}")
    return rows


def nearest_lead(rows: DataFrame, lead: str, minutes: int) -> DataFrame:
    """Rows of the lead nearest to so many minutes, the smaller one of two."""
    best = rows.agg(F.min(F.struct(F.abs(F.col(lead) - minutes).alias("d"), F.col(lead).alias("lead")))["lead"].alias("_lead"))
    return rows.join(F.broadcast(best), F.col(lead) == F.col("_lead")).drop("_lead")


def _parts(spark: SparkSession, path: str, schema, epoch: int) -> DataFrame | None:
    """What other batches wrote: a batch that runs again does not see itself."""
    if not exists(spark, path):
        return None
    return spark.read.schema(schema).parquet(path).where(F.col("batch") != epoch)


def start_ingest(rows: DataFrame, path: str, checkpoint: str, date: str, key: str, pending: Column, today: Column):
    """A stream of rows into `<path>/rows`, with `<path>/done` naming the dates that are closed.

    Of each batch, rows of closed dates, of today and later, and of keys that are already there are left out; pending rows say only
    that their date stays open. A date closes when a batch brings rows of it and none is pending. Every batch writes its own partition,
    data first and the marks of closed dates after it, so a batch that was killed and runs again adds nothing twice and never
    closes a date whose rows are missing.
    """
    names = [c for c in rows.columns]

    def ingest(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        batch = batch.withColumn("_pending", F.coalesce(pending, F.lit(False))).where(F.col(date) < today)
        done = _parts(spark, f"{path}/done", f"{batch.schema[date].simpleString().replace(':', ' ')}, batch long", epoch)
        if done is not None:
            batch = batch.join(done.select(date), date, "left_anti")
        batch = stored(batch, "ingest-batch")
        new = batch.where("not _pending").dropDuplicates([key]).select(*names)
        there = _parts(spark, f"{path}/rows", ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new.schema) + ", batch long", epoch)
        if there is not None:
            new = new.join(there.select(key), key, "left_anti")
        new.write.mode("overwrite").parquet(f"{path}/rows/batch={epoch}")
        closed = batch.groupBy(date).agg(F.max("_pending").alias("open")).where("not open").select(date)
        closed.write.mode("overwrite").parquet(f"{path}/done/batch={epoch}")

    return rows.writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
