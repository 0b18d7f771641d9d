"""Temporal queries: a customer's orders stand for the versions of a standard."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataframe.operators import joins, temporal
from strataframe.plans import query

_V = """v AS (SELECT o_custkey AS std, o_orderkey AS ver, year(o_orderdate) AS y, o_orderdate, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS withdrawn, o_orderkey % 5 = 0 AS sup,
    CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate END AS effective, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate END AS published FROM orders),
    s AS (SELECT *, CASE WHEN withdrawn IS NOT NULL THEN 'withdrawn' WHEN sup THEN 'superseded' WHEN effective IS NOT NULL THEN 'current_supported' WHEN published IS NOT NULL THEN 'uncertain' ELSE 'unknown' END AS state FROM v)"""


def _versions(t):
    o = t("orders").select(F.col("o_custkey").alias("std"), F.col("o_orderkey").alias("ver"), F.year("o_orderdate").alias("y"), "o_orderdate", "o_orderstatus")
    d = F.col("o_orderdate")
    return temporal.timeline(o, F.when(F.col("o_orderstatus") == "F", d), F.col("ver") % 5 == 0, F.when(F.col("ver") % 3 == 0, d), F.when(F.col("ver") % 7 != 0, d))


@query("t01_timeline", f"WITH {_V} SELECT std, ver, state, coalesce(effective, published) AS valid_from, withdrawn AS valid_until, withdrawn IS NULL AND coalesce(effective, published) IS NOT NULL AS is_open FROM s")
def _(t):
    return _versions(t).select("std", "ver", "state", "valid_from", "valid_until", "is_open")


@query("t02_currentness", f"""
    WITH {_V}, q AS (SELECT *, CASE WHEN std % 4 = 0 THEN 1995 END AS ask, std % 4 = 1 AS hist, std % 10 = 3 AND ver % 2 = 0 AS amd, ver % 3 = 1 AS tgt, CASE WHEN ver % 11 = 0 THEN 10000000 - ver END AS src, CASE WHEN withdrawn IS NOT NULL THEN 'withdrawn' WHEN ver % 2 = 0 THEN 'effective' ELSE 'published' END AS stt,
      lag(ver) OVER (PARTITION BY std ORDER BY o_orderdate, ver) AS bef FROM s),
    g AS (SELECT std, count(*) AS n, arg_min(ver, (o_orderdate, ver)) FILTER (amd) AS amd_ver, bool_or(hist) AS hist, arg_min(state, (o_orderdate, ver)) FILTER (y = ask) AS ask_state, arg_min(ver, (o_orderdate, ver)) FILTER (y = ask) AS ask_ver,
      arg_max(ver, (o_orderdate, ver)) FILTER (state IN ('superseded', 'withdrawn')) AS old_ver, arg_max(ver, (o_orderdate, ver)) FILTER (tgt) AS rep_ver, first(bef ORDER BY o_orderdate DESC, ver DESC) AS bef, count(*) FILTER (state = 'current_supported') AS n_cur,
      arg_min(ver, (src, o_orderdate, ver)) FILTER (src IS NOT NULL AND stt IN ('effective', 'published') AND state <> 'withdrawn') AS new_ver, arg_max(ver, (o_orderdate, ver)) AS only_ver, arg_max(stt, (o_orderdate, ver)) AS only_stt FROM q GROUP BY std)
    SELECT std, CASE WHEN amd_ver IS NOT NULL THEN 'AMENDED' WHEN ask_state = 'superseded' THEN 'SUPERSEDED' WHEN ask_state = 'withdrawn' THEN 'WITHDRAWN' WHEN ask_ver IS NOT NULL THEN 'HISTORICAL' WHEN hist AND (old_ver IS NOT NULL OR rep_ver IS NOT NULL OR n > 1) THEN 'HISTORICAL'
      WHEN n_cur > 1 THEN 'TEMPORALLY_UNCERTAIN' WHEN new_ver IS NOT NULL THEN 'CURRENT_SUPPORTED' WHEN n = 1 AND only_stt = 'withdrawn' THEN 'WITHDRAWN' WHEN n = 1 AND only_stt = 'effective' AND std % 2 = 0 THEN 'CURRENT_SUPPORTED' ELSE 'TEMPORALLY_UNCERTAIN' END AS resolution,
      CASE WHEN amd_ver IS NOT NULL THEN amd_ver WHEN ask_ver IS NOT NULL THEN ask_ver WHEN hist AND old_ver IS NOT NULL THEN old_ver WHEN hist AND rep_ver IS NOT NULL THEN rep_ver WHEN hist AND n > 1 THEN bef WHEN n_cur > 1 THEN NULL WHEN new_ver IS NOT NULL THEN new_ver WHEN n = 1 THEN only_ver END AS resolved FROM g""")
def _(t):
    v = F.col("ver")
    status = F.when(F.col("state") == "withdrawn", "withdrawn").when(v % 2 == 0, "effective").otherwise("published")
    return temporal.currentness(
        _versions(t), "std", "ver", ["o_orderdate"], "state", F.col("y"), F.when(F.col("std") % 4 == 0, 1995), F.col("std") % 4 == 1,
        amended=(F.col("std") % 10 == 3) & (v % 2 == 0), status=status, target=v % 3 == 1, source=F.when(v % 11 == 0, 10000000 - v), confirmed=F.col("std") % 2 == 0,
    )


@query("t03_conflicts", f"WITH {_V} SELECT std, list_sort(list(ver)) AS versions FROM s WHERE state = 'current_supported' GROUP BY 1 HAVING count(*) > 1")
def _(t):
    return temporal.conflicts(_versions(t), "std", "ver", F.col("state") == "current_supported")


@query("t05_audit", f"WITH {_V} SELECT state, count(*) AS n FROM s GROUP BY 1")
def _(t):
    return temporal.audit(_versions(t), "state")


@query("j09_null_fallback_join", """
    SELECT o_orderkey, list_sort(list(DISTINCT event_id)) AS amendments FROM orders JOIN (SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN value_key END AS ver, user_id AS std FROM (SELECT *, event_id % 1500 AS value_key FROM events)) a
    ON o_orderkey = a.ver OR (a.ver IS NULL AND o_custkey = a.std) GROUP BY 1""")
def _(t):
    a = t("events").select("event_id", F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 1500).alias("ver"), F.col("user_id").alias("std"))
    return temporal.with_amendments(t("orders"), "o_orderkey", "o_custkey", a, "event_id", "ver", "std")


@query("j10_semi_substring", """
    SELECT DISTINCT o_orderkey FROM orders WHERE CAST(o_orderkey AS VARCHAR) IN (SELECT 'std_' || y FROM (VALUES ('1993'), ('1996')) x(y)) OR year(o_orderdate) IN (1993, 1996) OR o_orderkey = 42""")
def _(t):
    edges = t("region").filter("r_regionkey < 3").select(F.element_at(F.array(F.lit("std_1993"), F.lit("std_1996"), F.lit("42")), (F.col("r_regionkey") + 1).cast("int")).alias("target"))
    return temporal.superseded(t("orders"), "o_orderkey", F.year("o_orderdate"), edges, "target")


@query("j11_full_evolution", """
    SELECT coalesce(a.k, b.k) AS clause, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN lower(trim(a.t)) = lower(trim(b.t)) THEN 'unchanged' ELSE 'modified' END AS change
    FROM (SELECT p_partkey AS k, p_name AS t FROM part WHERE p_partkey % 3 <> 0) a FULL JOIN (SELECT p_partkey AS k, CASE WHEN p_size > 40 THEN p_brand ELSE upper(p_name) || ' ' END AS t FROM part WHERE p_partkey % 5 <> 0) b ON a.k = b.k""")
def _(t):
    p = t("part").withColumnRenamed("p_partkey", "clause")
    new = p.filter("clause % 5 <> 0").select("clause", F.when(F.col("p_size") > 40, F.col("p_brand")).otherwise(F.concat(F.upper("p_name"), F.lit(" "))).alias("title"))
    return joins.evolution(p.filter("clause % 3 <> 0").select("clause", F.col("p_name").alias("title")), new, "clause", "title")
