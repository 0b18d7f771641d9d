"""Relational store: lookups, upserts, integrity checks and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lookup(df: DataFrame, **keys) -> DataFrame:
    """The row with these key values (the first one when there are several)."""
    return reduce(lambda d, k: d.filter(F.col(k[0]) == F.lit(k[1])), keys.items(), df).limit(1)


def matching(df: DataFrame, **values) -> DataFrame:
    """Equalities of the arguments that are not None, all of them optional."""
    given = [F.col(k) == F.lit(v) for k, v in values.items() if v is not None]
    return df.filter(reduce(lambda a, b: a & b, given, F.lit(True)))


def under(df: DataFrame, code: str, prefix: str) -> DataFrame:
    """Rows whose hierarchical code is ``prefix`` or lies below it."""
    return df.filter((F.col(code) == prefix) | F.startswith(F.col(code), F.lit(prefix + ":")))


def pending(df: DataFrame, done: Column, blocked: Column, priority: str, most: int, then: str) -> DataFrame:
    """Open work up to a priority, most urgent first."""
    return df.filter(~done & blocked.isNull() & (F.col(priority) <= most)).orderBy(priority, then)


def latest(df: DataFrame, key: str, at: str, tie: str, open_only: Column | None = None) -> DataFrame:
    """The newest row of each key; one aggregation, no sort."""
    rows = df if open_only is None else df.filter(open_only)
    rest = [c for c in df.columns if c != key]
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(F.col(at), F.col(tie))).alias("row"))
    return newest.select(key, *[F.col(f"row.{c}").alias(c) for c in rest])


def containing(df: DataFrame, column: str, *needles: str) -> DataFrame:
    """Rows whose text contains any needle; an empty needle is in every text."""
    return df.filter(reduce(lambda a, b: a | b, [F.contains(F.lower(F.col(column)), F.lit(n.lower())) for n in needles]))


def last_per_key(new: DataFrame, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return new.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def upsert_replace(existing: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """New rows win whole; ``order`` decides between new rows of one key."""
    new = new if order is None else last_per_key(new, key, order)
    return existing.join(new.select(key), key, "left_anti").unionByName(new.select(existing.columns))


def upsert_ignore(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows that are there win."""
    return existing.unionByName(new.join(existing.select(key), key, "left_anti").select(existing.columns))


def upsert_merge(existing: DataFrame, new: DataFrame, key: str, take: tuple[str, ...] = (), fill: tuple[str, ...] = ()) -> DataFrame:
    """For keys on both sides: ``take`` columns from the new row, ``fill`` columns from it unless NULL, the rest stays."""
    cols = existing.columns
    n = new.select(*[F.col(c).alias(f"n_{c}") for c in cols])
    both = existing.join(n, F.col(key) == F.col(f"n_{key}"), "full")
    here, there = F.col(key).isNotNull(), F.col(f"n_{key}").isNotNull()

    def pick(c: str) -> Column:
        if c == key:
            return F.coalesce(key, f"n_{key}")
        if c in take:
            return F.when(there, F.col(f"n_{c}")).otherwise(F.col(c))
        if c in fill:
            return F.coalesce(f"n_{c}", c)
        return F.when(here, F.col(c)).otherwise(F.col(f"n_{c}"))

    return both.select(*[pick(c).alias(c) for c in cols])


def update_where(df: DataFrame, cond: Column, **values: Column) -> DataFrame:
    """Set columns on matching rows; a NULL value keeps the old one."""
    return df.withColumns({c: F.when(cond, F.coalesce(v, F.col(c))).otherwise(F.col(c)) for c, v in values.items()})


def table_counts(tables: dict[str, DataFrame | None]) -> DataFrame:
    """table_name, n; a missing table counts 0."""
    spark = next(t.sparkSession for t in tables.values() if t is not None)
    parts = [(t.agg(F.count("*").alias("n")) if t is not None else spark.range(1).select(F.lit(0).cast("long").alias("n"))).select(F.lit(name).alias("table_name"), "n") for name, t in tables.items()]
    return reduce(DataFrame.unionAll, parts)


def counts_with_total(df: DataFrame, by: str) -> DataFrame:
    """Counts of each value and, in the row with NULL, of all."""
    return df.rollup(by).agg(F.count("*").alias("n"), F.grouping(by).cast("long").alias("is_total"))


def marginals(df: DataFrame, *dims: str) -> DataFrame:
    """dimension, value, n: independent histograms in one pass."""
    sets = [[F.col(d)] for d in dims]
    grouped = df.groupingSets(sets, *dims).agg(F.count("*").alias("n"), F.grouping_id().alias("gid"))
    width = len(dims)
    which = reduce(lambda c, i: c.when(F.col("gid") == (2**width - 1 - 2 ** (width - 1 - i)), F.lit(dims[i])), range(1, width), F.when(F.col("gid") == (2**width - 1 - 2 ** (width - 1)), F.lit(dims[0])))
    value = reduce(lambda c, i: c.when(F.col("dimension") == dims[i], F.col(dims[i]).cast("string")), range(1, width), F.when(F.col("dimension") == dims[0], F.col(dims[0]).cast("string")))
    return grouped.withColumn("dimension", which).select("dimension", value.alias("value"), "n")


def with_zero_buckets(df: DataFrame, bucket: Column, first: int, last: int) -> DataFrame:
    """bucket, n for every bucket from first to last."""
    own = df.groupBy(bucket.cast("int").alias("b")).agg(F.count("*").alias("k"))
    every = df.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("bucket"))
    return every.join(own, F.col("bucket") == F.col("b"), "left").select("bucket", F.coalesce("k", F.lit(0)).cast("long").alias("n"))


def field_coverage(df: DataFrame, *fields: str) -> DataFrame:
    """field, filled, pct: how often each field is neither NULL nor empty; one pass."""
    counts = df.agg(F.count("*").alias("total"), *[F.count(F.nullif(F.trim(F.col(f).cast("string")), F.lit(""))).alias(f) for f in fields])
    stacked = counts.selectExpr("total", f"stack({len(fields)}, " + ", ".join(f"'{f}', `{f}`" for f in fields) + ") AS (field, filled)")
    return stacked.select("field", "filled", F.when(F.col("total") > 0, F.bround(F.col("filled") * 100.0 / F.col("total"), 1)).otherwise(0.0).alias("pct"))


def issues(**found: DataFrame) -> DataFrame:
    """Union of issue frames (entity_id) labelled by their kind."""
    return reduce(DataFrame.unionAll, [d.select(F.lit(kind).alias("issue"), F.col("entity_id").cast("string").alias("entity_id")) for kind, d in found.items()])


def orphans(child: DataFrame, key: str, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Rows whose reference is set and has no target."""
    return child.filter(F.col(fk).isNotNull()).join(parent.select(F.col(pk).alias("__pk")), F.col(fk) == F.col("__pk"), "left_anti").select(F.col(key).alias("entity_id"))


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(F.col(key).alias("entity_id")).agg(F.count("*").alias("n")).filter("n > 1").select("entity_id")
