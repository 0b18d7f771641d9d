"""Store queries: parts stand for standards, suppliers for laboratories, line items for edges, events for jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strataframe.operators import joins, keyed
from strataframe.operators import store as S
from strataframe.plans import query
from strataframe.session import shared_dir


@query("f01_point_lookup", "SELECT p_partkey, p_name, p_brand FROM part WHERE p_partkey = 17")
def _(t):
    return S.lookup(t("part"), p_partkey=17).select("p_partkey", "p_name", "p_brand")


@query("f02_fk_list", "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders WHERE o_custkey = 7 ORDER BY o_orderdate, o_orderkey")
def _(t):
    return S.matching(t("orders"), o_custkey=7).orderBy("o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_orderstatus")


@query("f03_dynamic_filter", "SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F'")
def _(t):
    return S.matching(t("lineitem"), l_returnflag="R", l_linestatus="F", l_suppkey=None).select("l_orderkey", "l_linenumber", "l_suppkey")


@query("f04_filter_limit", "SELECT p_partkey, p_type FROM part WHERE p_size > 25 ORDER BY p_partkey LIMIT 100")
def _(t):
    return t("part").filter("p_size > 25").orderBy("p_partkey").limit(100).select("p_partkey", "p_type")


@query("f05_two_key_sort", "SELECT p_type, p_name, p_partkey FROM part ORDER BY p_type, p_name, p_partkey")
def _(t):
    return t("part").orderBy("p_type", "p_name", "p_partkey").select("p_type", "p_name", "p_partkey")


@query("f06_prefix_filter", """
    SELECT s_suppkey, 'R' || n_regionkey || ':N' || n_nationkey AS code FROM supplier JOIN nation ON s_nationkey = n_nationkey
    WHERE 'R' || n_regionkey || ':N' || n_nationkey = 'R1' OR starts_with('R' || n_regionkey || ':N' || n_nationkey, 'R1:')""")
def _(t):
    coded = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.concat(F.lit("R"), "n_regionkey", F.lit(":N"), "n_nationkey").alias("code"))
    return S.under(coded, "code", "R1")


@query("f07_post_filter", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1")
def _(t):
    return S.matching(t("orders"), o_orderstatus="O").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("f08_pending_work", "SELECT event_id, CAST(user_id % 6 AS INT) AS priority FROM events WHERE event_type <> 'purchase' AND event_type <> 'error' AND user_id % 6 <= 2 ORDER BY priority, event_id")
def _(t):
    e = t("events").withColumn("priority", (F.col("user_id") % 6).cast("int"))
    return S.pending(e, F.col("event_type") == "purchase", F.when(F.col("event_type") == "error", F.lit("quarantined")), "priority", 2, "event_id").select("event_id", "priority")


@query("f09_work_list", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def _(t):
    return t("orders").filter("o_orderstatus = 'P'").orderBy(F.col("o_orderdate").desc(), "o_orderkey").limit(50).select("o_orderkey")


@query("f10_latest_open", """
    SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type
    FROM events WHERE event_type IN ('view', 'click') GROUP BY user_id""")
def _(t):
    return S.latest(t("events").select("user_id", "event_id", "event_type", "ts"), "user_id", "ts", "event_id", F.col("event_type").isin("view", "click")).select("user_id", "event_id", "event_type")


@query("f11_contains_search", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'red') OR contains(lower('IS ' || p_partkey), 'is 12')")
def _(t):
    p = t("part").withColumn("both", F.concat("p_name", F.lit("\n"), F.lit("IS "), F.col("p_partkey").cast("string")))
    return S.containing(p, "both", "red", "is 12").select("p_partkey", "p_name")


@query("f12_arm_filter", "SELECT label, count(*) AS n FROM embeddings WHERE label = 3 GROUP BY 1")
def _(t):
    return S.matching(t("embeddings"), label=3, vec_id=None).groupBy("label").agg(F.count("*").alias("n"))


@query("f15_row_decoder", """
    SELECT event_id, CASE WHEN event_type IN ('view', 'click', 'purchase') THEN event_type ELSE 'unknown' END AS status,
           json_extract_string(props, '$.k') AS page FROM events""")
def _(t):
    return t("events").select("event_id", F.when(F.lower("event_type").isin("view", "click", "purchase"), F.lower("event_type")).otherwise("unknown").alias("status"), F.get_json_object("props", "$.k").alias("page"))


@query("f16_falsy_coalesce", "SELECT c_custkey, coalesce(nullif(CASE WHEN c_custkey % 3 = 0 THEN 0.0 ELSE c_acctbal END, 0.0), nullif(CAST(c_nationkey AS DOUBLE), 0.0), 0.0) AS score FROM customer")
def _(t):
    from strataframe.functions.text import first_nonzero

    return t("customer").select("c_custkey", first_nonzero(F.when(F.col("c_custkey") % 3 == 0, 0.0).otherwise(F.col("c_acctbal")), F.col("c_nationkey").cast("double")).alias("score"))


@query("f22_quarantine_split", "SELECT CASE WHEN event_type IN ('error', 'signup') THEN 'quarantined' ELSE 'queued' END AS state, count(*) AS n FROM events GROUP BY 1")
def _(t):
    return t("events").groupBy(F.when(F.col("event_type").isin("error", "signup"), "quarantined").otherwise("queued").alias("state")).agg(F.count("*").alias("n"))


_HALF = "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0"
_NEW = "SELECT o_orderkey, 'N' AS o_orderstatus, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice + 1 END AS o_totalprice FROM orders WHERE o_orderkey % 2 = 0"


def _halves(t):
    o = t("orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = o.filter("o_orderkey % 2 = 0").select("o_orderkey", F.lit("N").alias("o_orderstatus"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice") + 1).alias("o_totalprice"))
    return o.filter("o_orderkey % 3 <> 0"), new


@query("s07_upsert_replace", f"WITH a AS ({_HALF}), b AS ({_NEW}) SELECT * FROM a WHERE o_orderkey NOT IN (SELECT o_orderkey FROM b) UNION ALL SELECT * FROM b")
def _(t):
    return S.upsert_replace(*_halves(t), "o_orderkey")


@query("s07_keyed_upsert", """
    SELECT o_orderkey, CASE WHEN o_orderkey % 97 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 97 = 0 AND o_orderkey % 2 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 5 <> 1 OR o_orderkey % 97 = 0""")
def _(t):
    """A stored table, an upsert of one row in a hundred (new keys among them), and the table again."""
    o = t("orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    path = f"{shared_dir(o.sparkSession)}/keyed-{uuid.uuid4().hex}"
    keyed.create(o.filter("o_orderkey % 5 <> 1"), path, "o_orderkey", 64)
    new = o.filter("o_orderkey % 97 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice") + 1).otherwise(F.when(F.col("o_orderkey") % 5 == 1, F.col("o_totalprice"))).alias("o_totalprice"))
    keyed.upsert(path, new, "o_orderkey", 64, how="merge", take=("o_orderstatus",), fill=("o_totalprice",))
    return keyed.read(o.sparkSession, path)


@query("s08_upsert_ignore", f"WITH a AS ({_HALF}), b AS ({_NEW}) SELECT * FROM a UNION ALL SELECT * FROM b WHERE o_orderkey NOT IN (SELECT o_orderkey FROM a)")
def _(t):
    return S.upsert_ignore(*_halves(t), "o_orderkey")


@query("s09_upsert_merge", f"""
    WITH a AS ({_HALF}), b AS ({_NEW}) SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey,
    CASE WHEN b.o_orderkey IS NOT NULL THEN b.o_orderstatus ELSE a.o_orderstatus END AS o_orderstatus, coalesce(b.o_totalprice, a.o_totalprice) AS o_totalprice
    FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey""")
def _(t):
    return S.upsert_merge(*_halves(t), "o_orderkey", take=("o_orderstatus",), fill=("o_totalprice",))


@query("s10_point_update", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'DONE' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def _(t):
    return S.update_where(t("orders").select("o_orderkey", "o_orderstatus"), F.col("o_orderstatus") == "P", o_orderstatus=F.lit("DONE"))


@query("j01_labs_for_standard", """
    SELECT DISTINCT s_suppkey, s_name FROM supplier JOIN lineitem ON l_suppkey = s_suppkey WHERE l_returnflag = 'R' AND ('IS ' || l_partkey = 'IS 42' OR contains('IS ' || l_partkey, '421')) ORDER BY s_name""")
def _(t):
    edges = t("lineitem").select(F.concat(F.lit("IS "), F.col("l_partkey").cast("string")).alias("source_id"), F.col("l_suppkey").alias("target_id"), F.col("l_returnflag").alias("edge_type"))
    return joins.linked(t("supplier").select("s_suppkey", "s_name"), "s_suppkey", edges, "R", (F.col("source_id") == "IS 42") | F.contains("source_id", F.lit("421"))).orderBy("s_name")


@query("j02_derived_key_join", """
    SELECT p_partkey, min(o_orderkey) AS o_orderkey FROM part JOIN orders ON p_partkey % 100 = o_orderkey % 100
    AND (p_size % 5 = 0 OR o_custkey % 5 = 0 OR p_size % 5 = o_custkey % 5) GROUP BY p_partkey""")
def _(t):
    p = t("part").select("p_partkey", (F.col("p_partkey") % 100).alias("base"), F.nullif(F.col("p_size") % 5, F.lit(0)).cast("long").alias("part_no"))
    o = t("orders").select("o_orderkey", (F.col("o_orderkey") % 100).alias("o_base"), F.nullif(F.col("o_custkey") % 5, F.lit(0)).alias("o_part"))
    least = o.groupBy("o_base", "o_part").agg(F.min("o_orderkey").alias("o_orderkey"))  # the join tells orders apart by these two only
    return joins.wildcard_part(p, least, "base", "o_base", "part_no", "o_part").groupBy("p_partkey").agg(F.min("o_orderkey").alias("o_orderkey"))


@query("j03_link_resolution", """
    SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'N' THEN 'unlinked' WHEN p_partkey IS NULL OR s_suppkey IS NULL THEN 'dangling' ELSE 'resolved' END AS link,
    list_filter([CASE WHEN l_returnflag <> 'N' AND p_partkey IS NULL THEN 'part' END, CASE WHEN l_returnflag <> 'N' AND s_suppkey IS NULL THEN 'supplier' END], lambda x: x IS NOT NULL) AS missing
    FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_partkey % 10 <> 3 LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_suppkey % 7 <> 1""")
def _(t):
    chunks = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_returnflag") != "N").alias("has_identity"))
    targets = {"part": (t("part").filter("p_partkey % 10 <> 3").select("p_partkey"), "p_partkey", "l_partkey"), "supplier": (t("supplier").filter("s_suppkey % 7 <> 1").select("s_suppkey"), "s_suppkey", "l_suppkey")}
    return joins.resolve_links(chunks, "has_identity", targets).select("l_orderkey", "l_linenumber", "link", "missing")


@query("j04_reverse_explode", """
    SELECT l_partkey, list_sort(list(DISTINCT l_orderkey)) AS orders FROM lineitem GROUP BY l_partkey""")
def _(t):
    per = t("lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("parts"))
    return joins.reverse_list(per, "l_orderkey", "parts", "l_partkey", "orders")


@query("j06_parent_clause", """
    WITH c AS (SELECT l_orderkey, l_orderkey || '.' || l_linenumber AS num FROM lineitem UNION ALL SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey % 2 = 0)
    SELECT c.num, p.num AS parent FROM c LEFT JOIN c p ON contains(c.num, '.') AND p.num = regexp_replace(c.num, '\\.[^.]+$', '') AND p.l_orderkey = c.l_orderkey""")
def _(t):
    a = t("lineitem").select("l_orderkey", F.concat_ws(".", "l_orderkey", "l_linenumber").alias("num"))
    b = t("orders").filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderkey").cast("string").alias("num"))
    return joins.with_parent(a.unionAll(b), "l_orderkey", "num").select("num", "parent")


@query("j07_reference_resolution", """
    WITH m AS (SELECT o_orderkey, unnest([CAST(o_custkey AS VARCHAR), CAST(o_custkey + 1000 AS VARCHAR)]) AS n FROM orders)
    SELECT o_orderkey, 'IS ' || n AS reference, CASE WHEN p_partkey IS NULL THEN 'UNRESOLVED' ELSE 'RESOLVED' END AS state FROM m LEFT JOIN part ON CAST(p_partkey AS VARCHAR) = n WHERE n <> CAST(o_orderkey % 100 AS VARCHAR)""")
def _(t):
    rendered = t("orders").select("o_orderkey", F.concat(F.lit("see IS "), "o_custkey", F.lit(" and is: "), F.col("o_custkey") + 1000, F.lit(".")).alias("text"))
    known = t("part").select(F.concat(F.lit("IS "), F.col("p_partkey").cast("string")).alias("number"))
    return joins.references(rendered, "o_orderkey", "text", known, "number", F.concat(F.lit("IS "), F.col("o_orderkey") % 100))


@query("j08_or_join", """
    SELECT s_suppkey, count(*) AS orders, min(l_orderkey) AS first, max(l_orderkey) AS last, sum(l_orderkey)::BIGINT AS total FROM
    (SELECT s_suppkey, l_orderkey FROM supplier JOIN lineitem ON l_suppkey = s_suppkey UNION SELECT s_suppkey, l_orderkey FROM supplier JOIN lineitem ON l_partkey = s_suppkey) GROUP BY 1""")
def _(t):
    edges = t("lineitem").select("l_orderkey", "l_suppkey", "l_partkey")
    return joins.either_end(t("supplier").select("s_suppkey"), "s_suppkey", edges, "l_suppkey", "l_partkey").select("s_suppkey", "l_orderkey").distinct().groupBy("s_suppkey").agg(F.count("*").alias("orders"), F.min("l_orderkey").alias("first"), F.max("l_orderkey").alias("last"), F.sum("l_orderkey").alias("total"))


@query("j17_citation_antijoin", """
    SELECT o_orderkey, o_custkey AS cited, c_custkey IS NULL AS unknown FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_nationkey < 20""")
def _(t):
    return joins.citations(t("orders").select("o_orderkey", F.array("o_custkey").alias("ids")), "o_orderkey", "ids", t("customer").filter("c_nationkey < 20"), "c_custkey")


@query("j18_antijoin_union", "SELECT l_partkey AS p_partkey, 'found' AS origin FROM (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity >= 50) UNION ALL SELECT p_partkey, 'known' FROM part WHERE p_size = 50 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50)")
def _(t):
    found = t("lineitem").filter("l_quantity >= 50").select(F.col("l_partkey").alias("p_partkey")).distinct()
    return joins.add_missing(found, t("part").filter("p_size = 50").select("p_partkey"), "p_partkey")


@query("j19_integrity_issues", """
    SELECT 'orphan_customer' AS issue, CAST(o_orderkey AS VARCHAR) AS entity_id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 11 <> 0)
    UNION ALL SELECT 'orphan_part', CAST(l_orderkey AS VARCHAR) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 13 <> 0)
    UNION ALL SELECT 'repeated_key', CAST(l_orderkey AS VARCHAR) FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1""")
def _(t):
    return S.issues(
        orphan_customer=S.orphans(t("orders"), "o_orderkey", "o_custkey", t("customer").filter("c_custkey % 11 <> 0"), "c_custkey"),
        orphan_part=S.orphans(t("lineitem"), "l_orderkey", "l_partkey", t("part").filter("p_partkey % 13 <> 0"), "p_partkey"),
        repeated_key=S.repeated_keys(t("lineitem"), "l_orderkey"),
    )


@query("j21_rejected_antijoin", "SELECT event_id, CASE WHEN value < 10 THEN 'low_score' ELSE 'not_selected' END AS reason FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE value >= 50)")
def _(t):
    return joins.rejected(t("events"), t("events").filter("value >= 50"), "event_id", F.when(F.col("value") < 10, "low_score").otherwise("not_selected"))


@query("j22_hash_dedupe", "SELECT doc_id FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0) AND doc_id % 2 = 1")
def _(t):
    return joins.unseen_content(t("documents").filter("doc_id % 2 = 1"), t("documents").filter("doc_id % 2 = 0"), "text").select("doc_id")


@query("j23_edge_walk", """
    SELECT n_name, r_name, count(*) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def _(t):
    walk = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return walk.groupBy("n_name", "r_name").agg(F.count("*").alias("suppliers"))


_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


@query("a01_table_counts", " UNION ALL ".join(f"SELECT '{x}' AS table_name, count(*) AS n FROM {x}" for x in _TABLES) + " UNION ALL SELECT 'missing', 0")
def _(t):
    return S.table_counts({x: t(x) for x in _TABLES} | {"missing": None})


@query("a02_edge_counts", "SELECT l_returnflag, count(*) AS n, grouping(l_returnflag) AS is_total FROM lineitem GROUP BY ROLLUP (l_returnflag)")
def _(t):
    return S.counts_with_total(t("lineitem"), "l_returnflag")


@query("a03_group_status", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def _(t):
    return t("orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("a04_grouping_sets", "SELECT 'o_orderstatus' AS dimension, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2")
def _(t):
    return S.marginals(t("orders"), "o_orderstatus", "o_orderpriority")


@query("a05_conditional_counts", """
    SELECT coalesce(nullif(CASE WHEN p_size % 4 = 0 THEN '' ELSE p_type END, ''), 'General Industrial') AS category, count(*) AS total,
    count(*) FILTER (p_size > 25) AS large, count(*) FILTER (p_retailprice > 1200) AS costly FROM part GROUP BY 1""")
def _(t):
    category = F.coalesce(F.nullif(F.when(F.col("p_size") % 4 == 0, "").otherwise(F.col("p_type")), F.lit("")), F.lit("General Industrial"))
    return t("part").groupBy(category.alias("category")).agg(F.count("*").alias("total"), F.count_if(F.col("p_size") > 25).alias("large"), F.count_if(F.col("p_retailprice") > 1200).alias("costly"))


@query("a08_field_coverage", """
    SELECT 'page' AS field, count(nullif(trim(json_extract_string(props, '$.k')), '')) AS filled, round_even(count(nullif(trim(json_extract_string(props, '$.k')), '')) * 100.0 / count(*), 1) AS pct FROM events
    UNION ALL SELECT 'event_type', count(nullif(trim(event_type), '')), round_even(count(nullif(trim(event_type), '')) * 100.0 / count(*), 1) FROM events""")
def _(t):
    return S.field_coverage(t("events").withColumn("page", F.get_json_object("props", "$.k")), "page", "event_type")


@query("a19_status_totals", "SELECT event_type, count(*) AS n, round_even(sum(value), 4) AS total FROM events GROUP BY 1")
def _(t):
    return t("events").groupBy("event_type").agg(F.count("*").alias("n"), F.bround(F.sum("value"), 4).alias("total"))


@query("a20_zero_buckets", "SELECT CAST(b AS INT) AS bucket, count(event_id) AS n FROM range(0, 6) r(b) LEFT JOIN events ON user_id % 9 = b GROUP BY b")
def _(t):
    return S.with_zero_buckets(t("events"), F.col("user_id") % 9, 0, 5)


@query("a21_distinct_sorted", "SELECT DISTINCT p_type FROM part WHERE p_type IS NOT NULL ORDER BY p_type")
def _(t):
    return t("part").filter("p_type IS NOT NULL").select("p_type").distinct().orderBy("p_type")


@query("a22_group_first_max", """
    SELECT l_partkey, arg_min(l_suppkey, (l_orderkey, l_linenumber)) AS first_supp, max(l_quantity) AS max_qty, list_sort(list(DISTINCT l_orderkey)) AS orders FROM lineitem GROUP BY 1""")
def _(t):
    return t("lineitem").groupBy("l_partkey").agg(F.min_by("l_suppkey", F.struct("l_orderkey", "l_linenumber")).alias("first_supp"), F.max("l_quantity").alias("max_qty"), F.array_sort(F.collect_set("l_orderkey")).alias("orders"))


@query("a24_conflict_agg", """
    SELECT l_partkey, bool_or(l_returnflag = 'R') AND bool_or(l_returnflag = 'A') AS verdicts_conflict, count(l_quantity) >= 2 AND max(l_quantity) > 1.15 * min(l_quantity) AS values_conflict FROM lineitem GROUP BY 1""")
def _(t):
    return t("lineitem").groupBy("l_partkey").agg(
        (F.bool_or(F.col("l_returnflag") == "R") & F.bool_or(F.col("l_returnflag") == "A")).alias("verdicts_conflict"),
        ((F.count("l_quantity") >= 2) & (F.max("l_quantity") > 1.15 * F.min("l_quantity"))).alias("values_conflict"),
    )


@query("a25_having_conflicts", """
    SELECT o_custkey, list_sort(list(o_orderkey)) AS active, substring(sha256(CAST(o_custkey AS VARCHAR) || ':' || array_to_string(list_sort(list(o_orderkey)), ',')), 1, 16) AS conflict_id
    FROM orders WHERE o_orderstatus = 'P' GROUP BY 1 HAVING count(*) > 1""")
def _(t):
    return joins.competing(t("orders").filter("o_orderstatus = 'P'"), "o_custkey", "o_orderkey").withColumnRenamed("members", "active")


@query("a26_distinct_evidence", "SELECT source, count(*) AS n, count(DISTINCT sha256(text)) AS n_distinct, count(*) - count(DISTINCT sha256(text)) AS n_repeated FROM documents GROUP BY 1")
def _(t):
    d = F.count_distinct(F.sha2("text", 256))
    return t("documents").groupBy("source").agg(F.count("*").alias("n"), d.alias("n_distinct"), (F.count("*") - d).alias("n_repeated"))
