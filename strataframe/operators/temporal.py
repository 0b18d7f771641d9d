"""Versions in time: timelines, currentness, conflicts. The newest is never assumed current."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataframe.operators.patterns import occurring


def superseded(versions: DataFrame, key: str, year: Column, edges: DataFrame, target: str) -> DataFrame:
    """Versions an edge names by id, or whose year lies anywhere in its target; targets are searched for all years at once."""
    t = edges.select(F.col(target).cast("string").alias("__t")).distinct()
    by_id = versions.join(t, F.col(key).cast("string") == F.col("__t"), "left_semi")
    aged = versions.select(key, year.cast("string").alias("__y"))
    years = occurring(t, "__t", "__t", aged, "__y").select("pattern").distinct()
    by_year = aged.join(years, F.col("__y") == F.col("pattern"), "left_semi")
    return by_id.select(key).unionByName(by_year.select(key)).distinct()


def with_amendments(versions: DataFrame, v_key: str, v_std: str, amendments: DataFrame, a_key: str, a_version: str, a_std: str) -> DataFrame:
    """Amendments of each version; those without a version belong to every version of their standard.

    Two equi-joins instead of one OR condition.
    """
    v = versions.select(v_key, v_std)
    a = amendments.select(a_key, F.col(a_version).alias("__v"), F.col(a_std).alias("__s"))
    direct = v.join(a.filter("__v IS NOT NULL"), F.col(v_key) == F.col("__v")).select(v_key, a_key)
    wide = v.join(a.filter("__v IS NULL"), F.col(v_std) == F.col("__s")).select(v_key, a_key)
    return direct.unionByName(wide).groupBy(v_key).agg(F.array_sort(F.collect_set(a_key)).alias("amendments"))


def timeline(df: DataFrame, withdrawn: Column, is_superseded: Column, effective: Column, published: Column) -> DataFrame:
    """state and validity interval of each version."""
    state = F.when(withdrawn.isNotNull(), "withdrawn").when(is_superseded, "superseded").when(effective.isNotNull(), "current_supported").when(published.isNotNull(), "uncertain").otherwise("unknown")
    return df.withColumn("state", state).withColumn("valid_from", F.coalesce(effective, published)).withColumn("valid_until", withdrawn).withColumn("is_open", withdrawn.isNull() & F.coalesce(effective, published).isNotNull())


def conflicts(df: DataFrame, standard: str, version: str, active: Column) -> DataFrame:
    """Standards with more than one active version."""
    return df.filter(active).groupBy(standard).agg(F.array_sort(F.collect_list(version)).alias("versions")).filter(F.size("versions") > 1)


def currentness(df: DataFrame, standard: str, version: str, order: list[str], state: str, year: Column, asked_year: Column, historical: Column, amended: Column | None = None, status: Column | None = None, target: Column | None = None, source: Column | None = None, confirmed: Column | None = None) -> DataFrame:
    """standard, resolution, resolved: one answer per standard by an ordered list of rules; the newest is never assumed current.

    ``amended`` marks the version that a requested amendment belongs to,
    ``status`` is the recorded status (published, effective, withdrawn, ..),
    ``target`` marks versions that a supersession names as replaced, ``source``
    is the rank of the first supersession that names a version as the new one,
    ``confirmed`` says that the catalogue calls the standard current. Every
    rule is a column of one aggregation over the versions in their order. A
    standard without versions has no row here: left-join and fill
    TEMPORALLY_UNCERTAIN.
    """
    never, none = F.lit(False), F.lit(None)
    no = lambda c: F.coalesce(c, never)
    amended, target, confirmed = (never if c is None else no(c) for c in (amended, target, confirmed))
    status = none.cast("string") if status is None else status
    source = none.cast("long") if source is None else source
    place = F.struct(*order, version)
    w = Window.partitionBy(standard).orderBy(*order, version)
    old = F.col(state).isin("superseded", "withdrawn", "historical")
    active = status.isin("effective", "published") & (F.col(state) != "withdrawn")
    rows = df.withColumn("__before", F.lag(version).over(w))
    last = lambda value, where: F.max_by(value, F.when(where, place))
    g = rows.groupBy(standard).agg(
        F.count("*").alias("n"),
        F.min_by(version, F.when(amended, place)).alias("amended"),
        F.bool_or(amended).alias("has_amended"),
        F.min_by(F.struct(F.col(version).alias("v"), F.col(state).alias("s")), F.when(year == asked_year, place)).alias("asked"),
        F.bool_or(historical).alias("historical"),
        last(F.col(version), old).alias("old"),
        F.bool_or(old).alias("has_old"),
        last(F.col(version), target).alias("replaced"),
        F.bool_or(target).alias("has_replaced"),
        F.max_by("__before", place).alias("before"),
        F.count_if(F.col(state) == "current_supported").alias("n_current"),
        F.min_by(version, F.when(active & source.isNotNull(), F.struct(source.alias("r"), *order, version))).alias("new"),
        F.bool_or(active & source.isNotNull()).alias("has_new"),
        F.max_by(version, place).alias("only"),
        F.max_by(status, place).alias("status"),
        F.bool_or(confirmed).alias("confirmed"),
    )
    c = F.col
    answer = lambda kind, which: F.struct(F.lit(kind).alias("resolution"), (none if which is None else which).cast(dict(df.dtypes)[version]).alias("resolved"))
    past = no(c("historical"))
    rules = [
        (no(c("has_amended")), answer("AMENDED", c("amended"))),
        (c("asked").isNotNull() & (c("asked.s") == "superseded"), answer("SUPERSEDED", c("asked.v"))),
        (c("asked").isNotNull() & (c("asked.s") == "withdrawn"), answer("WITHDRAWN", c("asked.v"))),
        (c("asked").isNotNull(), answer("HISTORICAL", c("asked.v"))),
        (past & no(c("has_old")), answer("HISTORICAL", c("old"))),
        (past & no(c("has_replaced")), answer("HISTORICAL", c("replaced"))),
        (past & (c("n") > 1), answer("HISTORICAL", c("before"))),
        (c("n_current") > 1, answer("TEMPORALLY_UNCERTAIN", None)),
        (no(c("has_new")), answer("CURRENT_SUPPORTED", c("new"))),
        ((c("n") == 1) & (c("status") == "withdrawn"), answer("WITHDRAWN", c("only"))),
        ((c("n") == 1) & (c("status") == "effective") & no(c("confirmed")), answer("CURRENT_SUPPORTED", c("only"))),
        (c("n") == 1, answer("TEMPORALLY_UNCERTAIN", c("only"))),
    ]
    (c0, v0), *rest = rules
    found = reduce(lambda a, r: a.when(*r), rest, F.when(c0, v0)).otherwise(answer("TEMPORALLY_UNCERTAIN", None))
    return g.select(standard, found.alias("r")).select(standard, "r.resolution", "r.resolved")


def audit(df: DataFrame, kind: str) -> DataFrame:
    return df.groupBy(kind).agg(F.count("*").alias("n"))
