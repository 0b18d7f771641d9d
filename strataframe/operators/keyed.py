"""Keyed tables in Parquet whose upserts rewrite only the partitions that they touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.operators.store import last_per_key, upsert_ignore, upsert_merge, upsert_replace

PART = "part"


def part_of(key: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def create(rows: DataFrame, path: str, key: str, parts: int = 256) -> None:
    """A new table at ``path``: rows dealt by a hash of the key over ``parts`` partitions, a file each."""
    rows.withColumn(PART, part_of(key, parts)).repartition(PART).write.partitionBy(PART).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(PART)


def upsert(path: str, new: DataFrame, key: str, parts: int = 256, how: str = "replace", order: str | None = None, take: tuple[str, ...] = (), fill: tuple[str, ...] = ()) -> int:
    """Put new rows into the table; how many partitions were rewritten.

    ``how``: ``replace`` (new rows win whole), ``ignore`` (rows that are there
    win) or ``merge`` (``take`` and ``fill`` columns, as ``upsert_merge``).
    ``order`` decides between new rows of one key; without it, keys must come
    once. Only partitions with new keys are read and written: the filter on
    them prunes the scan, and dynamic overwrite leaves the other files alone.
    All three ways give the same table when a batch is put in again, so one
    that was stopped is put in once more. Rows with a null key go to a
    partition of their own kind and never match.
    """
    spark = new.sparkSession
    stored = spark.read.parquet(path)
    new = (new if order is None else last_per_key(new, key, order)).select([c for c in stored.columns if c != PART])
    dealt = new.withColumn(PART, part_of(key, parts))
    touched = sorted(r[0] for r in dealt.select(PART).distinct().collect())  # ``parts`` numbers at most
    if not touched:
        return 0
    old = stored.filter(F.col(PART).isin(touched)).drop(PART)
    if how == "merge":
        merged = upsert_merge(old, new, key, take, fill)
    else:
        merged = (upsert_replace if how == "replace" else upsert_ignore)(old, new, key)
    merged.withColumn(PART, part_of(key, parts)).repartition(PART).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(path)
    return len(touched)


def delete(path: str, keys: DataFrame, key: str, parts: int = 256) -> int:
    """Remove the rows of some keys; how many partitions were rewritten. A partition that loses all its rows keeps an empty file."""
    spark = keys.sparkSession
    stored = spark.read.parquet(path)
    touched = sorted(r[0] for r in keys.select(part_of(key, parts).alias(PART)).distinct().collect())
    if not touched:
        return 0
    left = stored.filter(F.col(PART).isin(touched)).join(keys.select(key).distinct(), key, "left_anti")
    kept = left.repartition(PART)
    emptied = set(touched) - {r[0] for r in left.select(PART).distinct().collect()}
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(path)
    for p in emptied:
        stored.filter("false").drop(PART).coalesce(1).write.mode("overwrite").parquet(f"{path}/{PART}={p}")
    return len(touched)
