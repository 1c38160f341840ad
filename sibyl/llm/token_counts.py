"""Token counts through a digest cache.

Content and tokenizer each have a SHA-256 digest. Digests are joined to a table of stored counts; of those that
it lacks, one text each is encoded and the counts are appended. Documents then take their counts by digest.

Defined results: a null text counts as empty (0 tokens); equal texts are encoded once however many rows hold them;
rows that repeat stay; ids of any type, equal hashes of ids included; an empty table gives no rows; columns other than id and text are not read. A digest that
two runs append at the same time has the same count twice, so reads keep one.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe, places
from .text import Schema, map_slices

_CACHE = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("tokenizer", T.StringType()), T.StructField("n_tokens", T.LongType())])


def stored_counts(docs: DataFrame, cache_path: str) -> DataFrame:
    try:
        return docs.sparkSession.read.schema(_CACHE).parquet(cache_path)
    except AnalysisException:
        return docs.sparkSession.createDataFrame([], _CACHE)


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_bytes, n_tokens). cache_path: a folder that all executors share; None starts an empty cache.

    Only digests and ids are grouped, so a text that a third of the rows hold costs no more than any other; texts
    are moved once, by id, to keep one of each digest that the cache lacks.
    """
    spark = docs.sparkSession
    tokenizer = bpe.version(tokenizer_path)
    cache_path = cache_path or places.new_path(spark, "token-counts")
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    keys = [F.when(F.col("id").isNotNull(), F.xxhash64("id")).otherwise(F.xxhash64("text")).alias("k"), F.unhex(F.sha2("text", 256)).alias("digest")]
    keyed = places.stored(named.select("id", *keys, F.octet_length("text").cast("long").alias("n_bytes")), "digests")
    known = stored_counts(docs, cache_path).where(F.col("tokenizer") == tokenizer)
    misses = places.stored(keyed.groupBy("digest").agg(F.min("k").alias("k")).join(known, "digest", "left_anti"), "misses")
    if not misses.isEmpty():
        _append(named.select("text", *keys), misses, tokenizer_path, tokenizer, cache_path)
    counts = stored_counts(docs, cache_path).where(F.col("tokenizer") == tokenizer).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    # a table of its own, so that the join below is a plain one whose skewed digests Spark can split
    counts = places.stored(counts, "counts")
    return keyed.join(counts, "digest").select(F.col("id").alias(id_col), "n_bytes", "n_tokens")


def _append(texts: DataFrame, misses: DataFrame, tokenizer_path: str, tokenizer: str, cache_path: str) -> None:
    """Encode one text of each missing digest and append its count to the cache."""
    # rows of one id may hold several texts, so the digest is compared too; rows that repeat are encoded once
    texts = texts.join(misses.withColumnRenamed("digest", "missed"), "k")
    wanted = texts.where(F.col("digest") == F.col("missed")).dropDuplicates(["k", "digest"])
    counted = map_slices(
        wanted, ["digest", "text"], "text",
        lambda part, flat: {"digest": part.column("digest"), "n_tokens": bpe.loaded(tokenizer_path).counts(flat)}, Schema(digest="binary", n_tokens="long"),
    )
    counted.select("digest", F.lit(tokenizer).alias("tokenizer"), "n_tokens").write.mode("append").partitionBy("tokenizer").parquet(cache_path)


def compacted(docs: DataFrame, cache_path: str, new_path: str) -> str:
    """The cache written once more without repeated digests, in fewer files: many small appends make reads slow."""
    stored_counts(docs, cache_path).groupBy("digest", "tokenizer").agg(F.max("n_tokens").alias("n_tokens")).write.partitionBy("tokenizer").parquet(new_path)
    return new_path
