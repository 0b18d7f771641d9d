"""Rule queries: parts stand for products and requirements, events for sources and jobs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strataframe.functions import extract as E
from strataframe.functions import grounding as G
from strataframe.functions import intent as I
from strataframe.functions import text as X
from strataframe.operators import joins
from strataframe.operators import retrieval as R
from strataframe.operators import rules as D
from strataframe.plans import query, spread
from strataframe.streaming import state as ST


_CLASSES = ["QCO", "QCO_AMENDMENT", "GAZETTE_NOTIFICATION", "STANDARD", "AMENDMENT", "PRODUCT_MANUAL", "TESTING_SCHEME", "CERTIFICATION_GUIDANCE", "LABORATORY_DIRECTORY", "STANDARD_SPECIFICATION", "standard metadata", "Revision", "OTHER"]
_HOSTS = ["egazette.gov.in", "www.manakonline.in", "standardsbis.bsbedge.com", "example.org", "www.bis.gov.in", "dpiit.gov.in"]
_PATHS = ["/Product-Manual/1", "/login", "/a/pm_2.pdf", "/x", "/Uploads/y", "/standards"]


def _one_of(words, k):
    return F.element_at(F.array(*[F.lit(w) for w in words]), (1 + k % len(words)).cast("int"))


_KIND, _HOST = f"{_CLASSES!r}[1 + user_id % 13]", f"{_HOSTS!r}[1 + event_id % 6]"


@query("f18_rights_case", f"""
    WITH e AS (SELECT event_id, {_KIND} AS k, {_HOST} AS h FROM events),
    r AS (SELECT event_id, CASE WHEN contains(h, 'egazette.gov.in') OR k IN ('QCO', 'QCO_AMENDMENT', 'GAZETTE_NOTIFICATION') THEN 'PUBLIC'
      WHEN contains(h, 'manakonline.in') AND k IN ('PRODUCT_MANUAL', 'TESTING_SCHEME', 'CERTIFICATION_GUIDANCE', 'LABORATORY_DIRECTORY') THEN 'PUBLIC'
      WHEN contains(h, 'standardsbis.bsbedge.com') OR k IN ('STANDARD', 'AMENDMENT') THEN 'LICENSED' ELSE 'UNKNOWN_RIGHTS' END AS license FROM e)
    SELECT event_id, license, license = 'PUBLIC' AS can_reproduce, license <> 'UNKNOWN_RIGHTS' AS can_index FROM r""")
def _(t):
    r = D.rights(_one_of(_HOSTS, F.col("event_id")), _one_of(_CLASSES, F.col("user_id")))
    return t("events").select("event_id", r.alias("r")).select("event_id", "r.*")


@query("f19_access_case", f"""
    WITH e AS (SELECT event_id, {_KIND} AS k, lower('https://' || {_HOST} || {_PATHS!r}[1 + (event_id // 6) % 6]) AS u FROM events),
    r AS (SELECT event_id, CASE WHEN contains(u, 'bis.gov.in') AND regexp_matches(u, 'product-manual|pm_|guideline|cart|uploads') THEN 'PUBLIC' WHEN regexp_matches(u, 'egazette.gov.in|dpiit.gov.in') OR k IN ('QCO', 'GAZETTE_NOTIFICATION') THEN 'PUBLIC'
      WHEN contains(u, 'standardsbis.bsbedge.com') OR k IN ('STANDARD', 'STANDARD_SPECIFICATION') THEN 'LICENSE_REQUIRED' WHEN contains(u, 'login') THEN 'LOGIN_REQUIRED' ELSE 'UNKNOWN' END AS rights FROM e)
    SELECT event_id, rights, CASE rights WHEN 'PUBLIC' THEN 'PENDING' ELSE 'BLOCKED_ACCESS' END AS status FROM r""")
def _(t):
    i = F.col("event_id")
    url = F.concat(F.lit("https://"), _one_of(_HOSTS, i), _one_of(_PATHS, F.floor(i / 6)))
    return t("events").select("event_id", D.access(url, _one_of(_CLASSES, F.col("user_id"))).alias("a")).select("event_id", "a.*")


@query("f20_priority_case", f"""
    WITH e AS (SELECT event_id, upper({_KIND}) AS k, event_id % 2 = 0 AS pub, ['IS 1293', 'IS 5', 'IS 9873-2'][1 + event_id % 3] AS i FROM events)
    SELECT event_id, CASE WHEN regexp_matches(k, 'QCO|GAZETTE|STATUTORY') THEN 0 WHEN regexp_matches(k, 'MANUAL|STI|TESTING') THEN 1 WHEN contains(k, 'METADATA') THEN 2 WHEN pub AND contains(k, 'STANDARD') THEN 3 WHEN regexp_matches(k, 'AMENDMENT|REVISION|CORRIGENDA') THEN 4 ELSE 5 END AS priority,
      CASE WHEN k IN ('QCO', 'QCO_AMENDMENT', 'GAZETTE_NOTIFICATION') THEN 1 WHEN k IN ('PRODUCT_MANUAL', 'TESTING_SCHEME', 'LABORATORY_DIRECTORY') THEN 2 WHEN i <> 'IS 5' THEN 3 ELSE 4 END AS class FROM e""")
def _(t):
    kind, i = _one_of(_CLASSES, F.col("user_id")), F.col("event_id")
    return t("events").select("event_id", D.priority(kind, F.when(i % 2 == 0, "PUBLIC").otherwise("UNKNOWN")).alias("priority"), D.queue_class(kind, _one_of(["IS 1293", "IS 5", "IS 9873-2"], i)).alias("class"))


@query("f21_quality_gate", "SELECT doc_id, n_chars > 200 AND lang IN ('en', 'fr') AND length(text) = n_chars AS passes FROM documents")
def _(t):
    return t("documents").select("doc_id", ((F.col("n_chars") > 200) & F.col("lang").isin("en", "fr") & (F.length("text") == F.col("n_chars"))).alias("passes"))


@query("a06_group_by_standard", "SELECT source, count(DISTINCT sha256(text)) AS n_unique, min(doc_id) AS first_doc, arg_min(lang, doc_id) AS lang FROM documents GROUP BY 1")
def _(t):
    d = t("documents").select("doc_id", "source", "lang", F.sha2("text", 256).alias("h"))
    return d.groupBy("source").agg(F.count_distinct("h").alias("n_unique"), F.min("doc_id").alias("first_doc"), F.min_by("lang", "doc_id").alias("lang"))


# Parameter names as specifications and requirements write them: equal, contained, synonymous, sharing only words that identify nothing.
_NAMES = ["Capacity", "storage volume", "operating temperature", "temp", "pressure", "working pressure", "wall thickness", "nominal thickness of the pipe", "maximum power", "rated power", "scale", "measuring range", "maximum speed", "outer diameter", "diameter", "colour"]
_SQL_NAMES = "[" + ", ".join(f"'{n}'" for n in _NAMES) + "]"
_WORDS = "list_distinct(list_filter(string_split_regex(lower(trim({0})), '\\s+'), lambda w: w <> ''))"


def _sql_list(words):
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _sql_groups(u, v, groups):
    return " OR ".join(f"(list_has_any({u}, {_sql_list(g)}) AND list_has_any({v}, {_sql_list(g)}))" for g in groups)


_SPEC = f"""
    n AS (SELECT l_orderkey, l_linenumber, l_partkey, {_SQL_NAMES}[1 + (l_partkey * 7 + l_linenumber) % 16] AS name FROM lineitem),
    q AS (SELECT l_orderkey AS k, l_linenumber AS ln, l_partkey AS pk, name FROM n WHERE l_linenumber % 2 = 1), p AS (SELECT l_orderkey AS k, l_linenumber AS pos, l_partkey AS ppk, name AS pname FROM n WHERE l_linenumber % 2 = 0)"""


def _names(t):
    """Odd lines of an order ask for a parameter, even lines are its specification."""
    pick = F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (1 + (F.col("l_partkey") * 7 + F.col("l_linenumber")) % 16).cast("int"))
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", pick.alias("name"))


def _asked_and_given(t):
    n = _names(t)
    key = F.concat_ws(".", "l_orderkey", "l_linenumber", "l_partkey")
    asked = n.filter("l_linenumber % 2 = 1").select(key.alias("ask"), "l_orderkey", "name")
    given = n.filter("l_linenumber % 2 = 0").select(key.alias("given"), F.col("l_orderkey").alias("g_order"), F.col("name").alias("g_name"), F.col("l_linenumber").alias("pos"))
    return asked, given


@query("j12_ranked_fuzzy_match", f"""
    WITH {_SPEC}, x AS (SELECT q.*, p.*, lower(name) AS a, lower(pname) AS b, {_WORDS.format("name")} AS u, {_WORDS.format("pname")} AS v FROM q JOIN p USING (k)),
    y AS (SELECT k || '.' || ln || '.' || pk AS ask, k || '.' || pos || '.' || ppk AS given, pos, CASE WHEN a = b THEN 1 WHEN contains(a, b) OR contains(b, a) THEN 2
      WHEN len(list_filter(list_intersect(u, v), lambda w: NOT list_contains({_sql_list(joins.STOP)}, w))) > 0 OR {_sql_groups("u", "v", joins.SYNONYMS)} THEN 3 END AS tier FROM x),
    z AS (SELECT ask, arg_min(given, (tier, pos, given)) AS given, min(tier) AS tier FROM y WHERE tier IS NOT NULL GROUP BY 1)
    SELECT DISTINCT k || '.' || ln || '.' || pk AS ask, given, tier FROM q LEFT JOIN z ON ask = k || '.' || ln || '.' || pk""")
def _(t):
    asked, given = _asked_and_given(t)
    asked = asked.distinct()
    return joins.match_parameters(asked, "ask", "l_orderkey", "name", given, "given", "g_order", "g_name", "pos")


@query("j13_fuzzy_fanout", f"""
    WITH {_SPEC}, c AS (SELECT *, name || ' shall be as stated' AS text, CASE WHEN pk % 3 = 0 THEN 'power' WHEN pk % 3 = 1 THEN '' END AS cat FROM q),
    x AS (SELECT c.*, p.*, lower(name) AS a, lower(pname) AS b, list_filter(list_distinct(list_concat({_WORDS.format("name")}, {_WORDS.format("text")})), lambda w: NOT list_contains({_sql_list(joins.TENDER_STOP)}, w)) AS u,
      list_filter(list_distinct(list_concat({_WORDS.format("pname")}, {_WORDS.format("pname || ' of steel'")})), lambda w: NOT list_contains({_sql_list(joins.TENDER_STOP)}, w)) AS v FROM c JOIN p USING (k)),
    y AS (SELECT k || '.' || ln || '.' || pk AS ask, k || '.' || pos || '.' || ppk AS given FROM x WHERE contains(a, b) OR contains(b, a) OR len(list_filter(list_intersect(u, v), lambda w: len(w) >= 4)) > 0
      OR {_sql_groups("u", "v", joins.TENDER_SYNONYMS)} OR (cat <> '' AND (contains(b, cat) OR contains(b || ' of steel', cat))))
    SELECT k || '.' || ln || '.' || pk AS ask, coalesce(given, 'GAP') AS given FROM q LEFT JOIN y ON ask = k || '.' || ln || '.' || pk""")
def _(t):
    asked, given = _asked_and_given(t)
    part = F.element_at(F.split("ask", r"\."), 3).cast("long")
    asked = asked.withColumn("text", F.concat("name", F.lit(" shall be as stated"))).withColumn("cat", F.when(part % 3 == 0, "power").when(part % 3 == 1, ""))
    given = given.withColumn("g_text", F.concat("g_name", F.lit(" of steel")))
    return joins.tender_links(asked, "ask", "l_orderkey", "name", "text", "cat", given, "given", "g_order", "g_name", "g_text").select("ask", F.coalesce("given", F.lit("GAP")).alias("given"))


_EV = """e AS (SELECT l_partkey AS k, l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity END AS v, CASE WHEN l_linenumber % 3 = 0 THEN CASE l_returnflag WHEN 'R' THEN 'FAIL' WHEN 'A' THEN 'PASS' END END AS verdict,
      l_tax > 0.06 AS expired, l_discount > 0.02 AS named, l_discount * 10 AS sure, CASE WHEN l_linenumber % 2 = 0 THEN CASE WHEN l_quantity <= 30 THEN 'MATCH' ELSE 'MISMATCH' END END AS state FROM lineitem),
    g AS (SELECT k, bool_or(verdict = 'PASS') AS p, bool_or(verdict = 'FAIL') AS f, max(v) AS hi, min(v) AS lo, count(v) AS c, bool_or(NOT expired) AS live,
      arg_min(named, (l_orderkey, l_linenumber)) FILTER (NOT expired) AS named, arg_min(sure, (l_orderkey, l_linenumber)) FILTER (NOT expired) AS sure, first(state ORDER BY l_orderkey, l_linenumber) FILTER (NOT expired) AS state FROM e GROUP BY 1),
    st AS (SELECT k, CASE WHEN p AND f THEN 'CONFLICTING' WHEN c >= 2 AND hi > 1.15 * lo THEN 'CONFLICTING' WHEN NOT live THEN 'EXPIRED' WHEN NOT named AND sure < 0.5 THEN 'UNVERIFIED' WHEN state IN ('PARTIAL_MATCH', 'MISMATCH') THEN 'PARTIAL' ELSE 'SUPPORTED' END AS status FROM g)"""


def _evidence(t):
    from strataframe.functions.units import compare

    n, none = F.col("l_linenumber"), F.lit(None).cast("double")
    measured = F.when(n % 2 == 0, F.col("l_quantity").cast("double"))
    verdict = F.when(n % 3 == 0, F.when(F.col("l_returnflag") == "R", "FAIL").when(F.col("l_returnflag") == "A", "PASS"))
    state = F.when(measured.isNotNull(), compare(measured, none, F.lit("bar"), F.lit("LE"), none, F.lit(30.0), none, F.lit("bar")))
    return D.evidence_status(t("lineitem"), "l_partkey", F.struct("l_orderkey", "l_linenumber"), measured, verdict, state, F.col("l_tax") > 0.06, F.col("l_discount") > 0.02, F.col("l_discount") * 10)


@query("j14_evidence_decision", f"WITH {_EV} SELECT k AS l_partkey, status FROM st")
def _(t):
    return _evidence(t)


_EVIDENCE_NAMES = ["Wall thickness", "wall-thickness", "Maximum wall thickness", "Working pressure", "pressure", "certification", "mass", "Rated working pressure test", "Thick"]


@query("j14_gathered", f"""
    WITH a AS (SELECT p_partkey AS req, p_partkey % 40 AS scope, {_EVIDENCE_NAMES!r}[1 + p_size % 9] AS asked FROM part), an AS (SELECT *, regexp_replace(lower(asked), '[^a-z0-9]', '', 'g') AS ap, list_distinct(regexp_extract_all(lower(asked), '\\b[a-z]{{3,}}\\b')) AS aw FROM a),
    p AS (SELECT s_suppkey % 40 AS scope, s_suppkey AS doc, pos, {_EVIDENCE_NAMES!r}[1 + (s_suppkey + pos * 5) % 9] AS matched, s_nationkey + pos AS value FROM supplier, range(3) r(pos)), pn AS (SELECT *, regexp_replace(lower(matched), '[^a-z0-9]', '', 'g') AS pp, list_distinct(regexp_extract_all(lower(matched), '\\b[a-z]{{3,}}\\b')) AS pw FROM p),
    m AS (SELECT req, doc, matched, value, row_number() OVER (PARTITION BY req, doc ORDER BY CASE WHEN asked = matched THEN 0 WHEN ap = pp THEN 1 ELSE 2 END, CASE WHEN ap = pp THEN 0 ELSE -len(list_intersect(aw, pw)) END, pos) AS r FROM an JOIN pn USING (scope) WHERE ap = pp OR len(list_intersect(aw, pw)) >= 2)
    SELECT req, doc, 'parameter' AS source, matched, CAST(value AS VARCHAR) AS value, NULL AS verdict FROM m WHERE r = 1
    UNION ALL SELECT req, doc, 'test', matched, CAST(value AS VARCHAR), CASE WHEN value % 2 = 0 THEN 'PASS' ELSE 'FAIL' END FROM an JOIN pn USING (scope) WHERE pos < 2 AND (contains(ap, pp) OR contains(pp, ap))
    UNION ALL SELECT req, s_suppkey, 'standard', 'standard_reference', 'IS ' || s_nationkey, NULL FROM an JOIN supplier ON s_suppkey % 40 = scope WHERE lower(asked) = 'certification'""")
def _(t):
    """Requirements of parts against the parameters and test rows of suppliers' documents."""
    asked = t("part").select("p_partkey", (F.col("p_partkey") % 40).alias("scope"), _one_of(_EVIDENCE_NAMES, F.col("p_size")).alias("asked"))
    docs = t("supplier").select((F.col("s_suppkey") % 40).alias("scope"), F.col("s_suppkey").alias("doc"), "s_nationkey", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("pos"))
    rows = docs.select("scope", "doc", "pos", _one_of(_EVIDENCE_NAMES, F.col("doc") + F.col("pos") * 5).alias("name"), (F.col("s_nationkey") + F.col("pos")).alias("value"))
    tests = rows.filter("pos < 2").withColumn("verdict", F.when(F.col("value") % 2 == 0, "PASS").otherwise("FAIL"))
    standards = t("supplier").select((F.col("s_suppkey") % 40).alias("scope"), F.col("s_suppkey").alias("doc"), F.concat(F.lit("IS "), "s_nationkey").alias("number"))
    return D.gather_evidence(asked, "p_partkey", "scope", "asked", rows, tests, standards)


@query("a12_gap_pivot", f"""
    WITH {_EV}, r AS (SELECT p_type, coalesce(status, 'MISSING') AS status FROM part LEFT JOIN st ON k = p_partkey)
    SELECT p_type, count(*) AS total, count(*) FILTER (status = 'SUPPORTED') AS supported, count(*) FILTER (status = 'PARTIAL') AS partial, count(*) FILTER (status = 'EXPIRED') AS expired, count(*) FILTER (status = 'MISSING') AS missing,
    count(*) FILTER (status = 'CONFLICTING') AS conflicting, count(*) FILTER (status = 'UNVERIFIED') AS unverified,
    CASE WHEN count(*) FILTER (status = 'CONFLICTING') > 0 THEN 'CONFLICT' WHEN count(*) FILTER (status = 'EXPIRED') > 0 THEN 'EXPIRED' WHEN count(*) FILTER (status = 'MISSING') > 0 THEN 'GAP' WHEN count(*) FILTER (status = 'SUPPORTED') = count(*) THEN 'COMPLETE' ELSE 'INSUFFICIENT' END AS overall
    FROM r GROUP BY 1""")
def _(t):
    ev = _evidence(t).withColumnRenamed("l_partkey", "k")
    r = t("part").select("p_partkey", "p_type").join(ev, F.col("p_partkey") == F.col("k"), "left").withColumn("status", F.coalesce("status", F.lit("MISSING")))
    return D.gap_report(r, "p_type", "status", ["SUPPORTED", "PARTIAL", "EXPIRED", "MISSING", "CONFLICTING", "UNVERIFIED"])


@query("j15_tripartite", """
    SELECT p_partkey, CASE WHEN p_size <= 30 THEN 'MATCH' ELSE 'MISMATCH' END AS product_tender, CASE WHEN p_size <= 40 THEN 'MATCH' ELSE 'MISMATCH' END AS product_standard FROM part""")
def _(t):
    from strataframe.functions.units import compare

    none = F.lit(None).cast("double")
    one = lambda limit: compare(F.col("p_size").cast("double"), none, F.lit("mm"), F.lit("LE"), none, F.lit(limit), none, F.lit("mm"))
    return t("part").select("p_partkey", one(30.0).alias("product_tender"), one(40.0).alias("product_standard"))


_LOW = "lower(p_name || ' ' || p_type || CASE WHEN p_size % 4 = 0 THEN ' apply rings' ELSE '' END)"


@query("j16_scored_match", f"""
    WITH c AS (SELECT p_brand AS brand, list_sort(list(DISTINCT p_name)) AS products, min(p_type) || ' specification part' AS title, max(p_type) AS category FROM part GROUP BY 1),
    q AS (SELECT p_partkey, {_LOW} AS d, list_filter(regexp_extract_all({_LOW}, '\\b[a-z]{{3,}}\\b'), lambda w: NOT list_contains({_sql_list(joins.ASK_STOP)}, w)) AS w FROM part),
    s AS (SELECT p_partkey, brand, list_sum(list_transform(products, lambda p: CASE WHEN contains(d, lower(p)) THEN 10 ELSE 3 * len(list_filter(string_split(lower(p), ' '), lambda x: len(x) > 3 AND contains(d, x))) END))
      + 2 * len(list_filter(regexp_extract_all(lower(title), '\\b[a-z]{{4,}}\\b'), lambda x: NOT list_contains({_sql_list(joins.TITLE_STOP)}, x) AND list_contains(w, x)))
      + len(list_filter(regexp_extract_all(lower(category), '\\b[a-z]{{4,}}\\b'), lambda x: list_contains(w, x))) AS score FROM q, c)
    SELECT p_partkey, arg_min(brand, (-score, brand)) AS brand, CAST(max(score) AS INT) AS score FROM s WHERE score >= 3 GROUP BY 1""")
def _(t):
    p = t("part")
    catalogue = p.groupBy(F.col("p_brand").alias("brand")).agg(F.array_sort(F.collect_set("p_name")).alias("products"), F.concat(F.min("p_type"), F.lit(" specification part")).alias("title"), F.max("p_type").alias("category"))
    asks = p.select("p_partkey", F.concat("p_name", F.lit(" "), "p_type", F.when(F.col("p_size") % 4 == 0, " apply rings").otherwise("")).alias("text"))
    return joins.match_catalogue(asks, "p_partkey", "text", catalogue, "brand", "products", "title", "category")


@query("a11_mapping_metrics", """
    WITH r AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id % 13, vec_id) AS k FROM embeddings), p AS (SELECT label, max(CASE WHEN k = 1 AND vec_id % 2 = 0 THEN 1 ELSE 0 END) AS p1, sum(CASE WHEN k <= 3 AND vec_id % 2 = 0 THEN 1 ELSE 0 END) AS p3 FROM r GROUP BY 1)
    SELECT round_even(avg(p1), 4) AS p_at_1, round_even(sum(p3) / (3.0 * count(*)), 4) AS p_at_3 FROM p""")
def _(t):
    w = Window.partitionBy("label").orderBy(F.col("vec_id") % 13, "vec_id")
    r = t("embeddings").select("label", "vec_id", F.row_number().over(w).alias("k"))
    good = F.col("vec_id") % 2 == 0
    p = r.groupBy("label").agg(F.max(F.when((F.col("k") == 1) & good, 1).otherwise(0)).alias("p1"), F.count_if((F.col("k") <= 3) & good).alias("p3"))
    return p.agg(F.bround(F.avg("p1"), 4).alias("p_at_1"), F.bround(F.sum("p3") / (3.0 * F.count("*")), 4).alias("p_at_3"))


@query("a13_comparison_counts", "SELECT p_type, count(*) FILTER (p_size <= 25) AS n_match, count(*) FILTER (p_size > 25) AS n_mismatch, bool_or(p_size > 48) AS needs_check FROM part GROUP BY 1")
def _(t):
    return t("part").groupBy("p_type").agg(F.count_if(F.col("p_size") <= 25).alias("n_match"), F.count_if(F.col("p_size") > 25).alias("n_mismatch"), F.bool_or(F.col("p_size") > 48).alias("needs_check"))


@query("a14_tender_gaps", "SELECT l_orderkey, count(*) FILTER (l_returnflag = 'N') AS n_match, count(*) FILTER (l_returnflag = 'R') AS n_conflict, arg_min(l_linenumber, l_linenumber) FILTER (l_returnflag = 'N') AS first_match FROM lineitem GROUP BY 1")
def _(t):
    ok = F.col("l_returnflag") == "N"
    return t("lineitem").groupBy("l_orderkey").agg(F.count_if(ok).alias("n_match"), F.count_if(F.col("l_returnflag") == "R").alias("n_conflict"), F.min(F.when(ok, F.col("l_linenumber"))).alias("first_match"))


@query("a16_grounding_rollup", """
    WITH x AS (SELECT l_orderkey, CASE WHEN l_orderkey % 7 = 0 THEN NULL WHEN l_returnflag = 'N' THEN 'SUPPORTED' WHEN l_returnflag = 'A' THEN 'PARTIAL' ELSE 'UNSUPPORTED' END AS st, l_linenumber % 3 > 0 AS fact, CASE WHEN l_orderkey % 2 = 0 THEN 'Verification Required.' ELSE 'yes' END AS answer FROM lineitem)
    SELECT l_orderkey, CASE WHEN count(*) FILTER (st IS NOT NULL AND fact) > 0 THEN round_even(count(*) FILTER (st = 'SUPPORTED' AND fact) / count(*) FILTER (st IS NOT NULL AND fact), 4) ELSE 1.0 END AS coverage,
    CASE WHEN count(st) > 0 THEN round_even((count(*) FILTER (st = 'SUPPORTED') + 0.5 * count(*) FILTER (st = 'PARTIAL')) / count(st), 4) ELSE CASE WHEN l_orderkey % 2 = 0 THEN 1.0 ELSE 0.0 END END AS score,
    CASE WHEN count(*) FILTER (st = 'UNSUPPORTED') > 0 THEN 'UNSUPPORTED' WHEN count(*) FILTER (st = 'PARTIAL') > 0 THEN 'PARTIALLY_GROUNDED' WHEN count(st) = 0 THEN 'UNVERIFIABLE' ELSE 'FULLY_GROUNDED' END AS overall,
    count(*) FILTER (st = 'SUPPORTED') AS supported, count(*) FILTER (st = 'PARTIAL') AS partial, count(*) FILTER (st = 'UNSUPPORTED') AS unsupported FROM x GROUP BY 1""")
def _(t):
    s = F.when(F.col("l_orderkey") % 7 == 0, None).when(F.col("l_returnflag") == "N", "SUPPORTED").when(F.col("l_returnflag") == "A", "PARTIAL").otherwise("UNSUPPORTED")
    rows = t("lineitem").withColumn("status", s).withColumn("answer", F.when(F.col("l_orderkey") % 2 == 0, "Verification Required.").otherwise("yes"))
    return D.grounding(rows, "l_orderkey", "status", F.col("l_linenumber") % 3 > 0, "answer")


@query("a17_readiness", """
    WITH a AS (SELECT l_partkey AS k, avg(CASE WHEN l_returnflag = 'R' THEN 1.0 WHEN l_returnflag = 'A' THEN 0.5 ELSE 0.0 END) AS app, bool_or(l_returnflag = 'R') AS fits FROM lineitem GROUP BY 1),
    x AS (SELECT p_partkey, coalesce(app, 0) AS app, coalesce(fits, false) AS fits, CASE WHEN p_size % 4 <> 0 THEN p_size % 5 END AS m, CASE WHEN p_size % 4 <> 0 THEN p_size % 3 END AS g, CASE WHEN p_size % 6 <> 0 THEN p_size % 7 END AS req,
      least(p_size % 7, p_size % 5) AS sup, p_size % 11 = 0 AS con, p_size % 13 = 0 AS ex, p_size % 9 = 0 AS un FROM part LEFT JOIN a ON k = p_partkey)
    SELECT p_partkey, round_even(greatest(0, least(1, 0.25 * app + 0.35 * CASE WHEN m IS NULL THEN 0.3 WHEN m + g > 0 THEN m / (m + g) ELSE 0.5 END + 0.40 * CASE WHEN req IS NULL THEN 0.2 WHEN req > 0 THEN sup / req ELSE 0.5 END
      - CASE WHEN con THEN 0.30 ELSE 0 END - CASE WHEN ex THEN 0.20 ELSE 0 END - CASE WHEN un THEN 0.15 ELSE 0 END)), 6) AS readiness,
    CASE WHEN con THEN 'VERIFICATION_REQUIRED' WHEN un THEN 'TEMPORAL_UNCERTAINTY' WHEN g > 0 THEN 'TECHNICAL_GAPS_FOUND' WHEN ex THEN 'DOCUMENT_GAPS_FOUND' WHEN req IS NULL OR sup < req THEN 'EVIDENCE_INCOMPLETE' WHEN fits THEN 'READY_FOR_HUMAN_REVIEW' ELSE 'VERIFICATION_REQUIRED' END AS state FROM x""")
def _(t):
    status = F.when(F.col("l_returnflag") == "R", "APPLICABLE").when(F.col("l_returnflag") == "A", "POTENTIALLY_APPLICABLE").otherwise("INSUFFICIENT_EVIDENCE")
    a = t("lineitem").withColumn("s", status).groupBy(F.col("l_partkey").alias("k")).agg(D.applicable_share(F.col("s")).alias("app"), F.bool_or(F.col("s") == "APPLICABLE").alias("fits"))
    x, s = t("part").join(a, F.col("p_partkey") == F.col("k"), "left"), F.col("p_size")
    m, g, req = F.when(s % 4 != 0, s % 5), F.when(s % 4 != 0, s % 3), F.when(s % 6 != 0, s % 7)
    sup, con, ex, un = F.least(s % 7, s % 5), s % 11 == 0, s % 13 == 0, s % 9 == 0
    score = D.readiness(F.col("app"), m, g, sup, req, con, ex, un)
    return x.select("p_partkey", F.bround(score, 6).alias("readiness"), D.readiness_state(con, un, g, ex, sup < req, req, F.col("fits")).alias("state"))


@query("a18_link_summary", "SELECT CASE WHEN l_returnflag = 'N' THEN 'unlinked' WHEN l_partkey % 10 = 3 THEN 'dangling' ELSE 'resolved' END AS link, count(*) AS n FROM lineitem GROUP BY 1")
def _(t):
    targets = {"part": (t("part").filter("p_partkey % 10 <> 3").select("p_partkey"), "p_partkey", "l_partkey")}
    linked = joins.resolve_links(t("lineitem").select("l_partkey", (F.col("l_returnflag") != "N").alias("has_identity")), "has_identity", targets)
    return linked.groupBy("link").agg(F.count("*").alias("n"))


@query("j20_containment_antijoin", """
    WITH c AS (SELECT conv_id, turn, role, list_filter(list_transform(string_split_regex(text, '[.\n]+'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM conversations),
    g AS (SELECT conv_id, flatten(list(parts ORDER BY turn) FILTER (role = 'assistant')) AS claims, flatten(list(parts ORDER BY turn) FILTER (role <> 'assistant')) AS more FROM c GROUP BY 1)
    SELECT conv_id, list_reduce(list_prepend(coalesce(claims, []::VARCHAR[]), list_transform(coalesce(more, []::VARCHAR[]), lambda x: [x])),
      lambda acc, x: CASE WHEN len(list_filter(acc, lambda e: contains(lower(e), lower(x[1])) OR contains(lower(x[1]), lower(e)))) > 0 THEN acc ELSE list_concat(acc, x) END) AS claims FROM g""")
def _(t):
    parts = F.filter(F.transform(F.split("text", r"[.\n]+"), lambda x: F.trim(x)), lambda x: x != "")
    rows = t("conversations").select("conv_id", "turn", "role", parts.alias("parts"))
    ordered = lambda cond: F.flatten(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("turn", "parts")))), lambda x: x["parts"]))
    g = rows.groupBy("conv_id").agg(ordered(F.col("role") == "assistant").alias("claims"), ordered(F.col("role") != "assistant").alias("more"))
    return g.select("conv_id", joins.add_unseen_claims(F.col("claims"), F.col("more")).alias("claims"))


def _pair_scores(pairs):
    """A stand-in for a caller's pair model: words that both texts have, three each, and the length of the second."""
    return [3.0 * len(set(a.split()) & set(b.split())) + len(b) for a, b in pairs]


@query("r07_rerank", """
    WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, 3.0 * len(list_intersect(string_split(a.p_name, ' '), string_split(b.p_name, ' '))) + length(b.p_name) AS s FROM lineitem JOIN part a ON a.p_partkey = l_partkey JOIN part b ON b.p_partkey = l_orderkey % 100)
    SELECT l_orderkey, l_linenumber, CAST(s AS DOUBLE) AS score, row_number() OVER (PARTITION BY l_orderkey ORDER BY s DESC, l_linenumber, l_partkey) AS rank FROM x QUALIFY rank <= 5""")
def _(t):
    """Candidates of each order scored in pairs by a model that the caller brings, the five best kept."""
    p = t("part").select("p_partkey", "p_name")
    a, b = p.toDF("a_key", "a_name"), p.toDF("b_key", "b_name")
    pairs = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(a, F.col("l_partkey") == F.col("a_key")).join(b, F.col("l_orderkey") % 100 == F.col("b_key"))
    scored = R.rescore(pairs, "a_name", "b_name", _pair_scores, "score")
    return R.top_k(scored, "l_orderkey", 5, F.col("score").desc(), F.col("l_linenumber"), F.col("l_partkey")).select("l_orderkey", "l_linenumber", "score", "rank")


@query("r08_confidence", """
    WITH y AS (SELECT event_id, value / 10 - 5 AS best, event_id % 4 AS n, event_id % 97 = 0 AS f1, event_id % 11 = 0 AS f2, event_id % 13 = 0 AS f3, event_id % 17 = 0 AS f4, event_id % 19 = 0 AS f5, event_id % 23 = 0 AS s1, event_id % 29 = 0 AS s2, event_id % 31 = 0 AS un,
      CASE event_type WHEN 'view' THEN 1.0 WHEN 'click' THEN 0.95 WHEN 'error' THEN 0.85 ELSE 0.75 END AS w FROM events),
    x AS (SELECT *, round_even((0.30 / (1 + exp(-greatest(-10, least(10, best)))) + CASE WHEN event_id % 2 = 0 THEN 0.05 ELSE 0 END + 0.25 + 0.10 + CASE WHEN event_id % 3 = 0 THEN 0.05 ELSE 0 END
      + CASE WHEN n >= 3 THEN 0.15 WHEN n = 2 THEN 0.10 WHEN n = 1 THEN 0.05 ELSE 0 END) * w, 4) AS raw, CASE WHEN f1 THEN 0.30 WHEN f2 THEN 0.28 WHEN f3 THEN 0.20 WHEN f4 THEN 0.40 WHEN f5 THEN 0.35 END AS hard, best < -4.5 AS weak FROM y),
    z AS (SELECT *, least(greatest(0, least(1, raw)), coalesce(hard, 1.0), CASE WHEN weak THEN 0.30 ELSE 1.0 END, CASE WHEN un THEN 0.40 ELSE 1.0 END, CASE WHEN s1 THEN 0.60 ELSE 1.0 END, CASE WHEN s2 THEN 0.65 ELSE 1.0 END) AS score FROM x),
    v AS (SELECT *, hard IS NOT NULL OR weak OR un OR score < 0.45 AS verify FROM z)
    SELECT event_id, score, CASE WHEN verify THEN 'LOW' WHEN score >= 0.70 THEN 'HIGH' ELSE 'MEDIUM' END AS level, CASE WHEN verify THEN 'VERIFICATION_REQUIRED' WHEN score >= 0.70 THEN 'ANSWER' ELSE 'QUALIFIED_ANSWER' END AS decision,
    CASE WHEN weak OR un THEN 'INSUFFICIENT_EVIDENCE' WHEN f1 THEN 'VERIFICATION_REQUIRED' WHEN f2 THEN 'CONFLICTING_EVIDENCE' WHEN f3 OR f4 THEN 'INSUFFICIENT_EVIDENCE' WHEN f5 THEN 'AMBIGUOUS_QUERY' WHEN verify THEN 'INSUFFICIENT_EVIDENCE' ELSE 'ANSWERABLE' END AS state FROM v""")
def _(t):
    i = F.col("event_id")
    authority = F.when(F.col("event_type") == "view", "standard").when(F.col("event_type") == "click", "gazette").when(F.col("event_type") == "error", "manual").otherwise("blog")
    failures = {"missing_context": i % 97 == 0, "conflict": i % 11 == 0, "standard_absent": i % 13 == 0, "clause_absent": i % 17 == 0, "ambiguous": i % 19 == 0, "amendment_absent": i % 23 == 0, "year_differs": i % 29 == 0, "uncertain": i % 31 == 0}
    c = D.confidence(F.col("value") / 10 - 5, i % 2 == 0, F.lit(0.25), F.lit(1.0), i % 3 == 0, i % 4, authority, failures)
    return t("events").select("event_id", c.alias("c")).select("event_id", "c.*")


@query("r09_mapping_score", """
    WITH y AS (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.9 WHEN 2 THEN 0.85 WHEN 3 THEN 0.5 ELSE 0.0 END AS title, p_size % 4 / 3.0 AS terms, CASE p_size % 6 WHEN 0 THEN 0.0 WHEN 1 THEN 0.5 WHEN 2 THEN 0.75 ELSE 1.0 END AS cl,
      p_size / 50.0 AS sem, p_size % 3 / 2.0 AS tech, CASE WHEN p_partkey % 2 = 0 THEN 1.0 ELSE 0.0 END AS kg, p_partkey % 3 AS n, p_partkey % 7 = 0 AS low FROM part),
    x AS (SELECT *, round_even(least(1, greatest(0, 0.25 * title + 0.25 * terms + 0.20 * cl + 0.15 * sem + 0.10 * tech + 0.05 * kg)), 4) AS score, cl > 0 OR terms > 0 OR n > 1 AS sup FROM y)
    SELECT p_partkey, score, CASE WHEN score >= 0.70 AND (title > 0 OR terms >= 0.8) AND sup AND NOT low THEN 'STRONG_CANDIDATE' WHEN score >= 0.45 OR (title >= 0.8 AND NOT sup) THEN 'POSSIBLE_CANDIDATE' WHEN score >= 0.20 THEN 'WEAK_CANDIDATE' ELSE 'INSUFFICIENT_EVIDENCE' END AS status FROM x""")
def _(t):
    s, k = F.col("p_size"), F.col("p_partkey")
    title = F.element_at(F.array(*[F.lit(x) for x in (1.0, 0.9, 0.85, 0.5, 0.0)]), (s % 5 + 1).cast("int"))
    n = F.element_at(F.array(*[F.lit(x) for x in (0, 1, 2, 3, 4, 5)]), (s % 6 + 1).cast("int"))
    score, status = D.mapping_status(title, s % 4 / 3.0, D.clause_score(n), s / 50.0, s % 3 / 2.0, F.when(k % 2 == 0, 1.0).otherwise(0.0), k % 3, k % 7 == 0)
    return t("part").select("p_partkey", score.alias("score"), status.alias("status"))


# What is asked, its intent, score, first signal and strategy; the number of the part stands in for {0}.
_QUESTIONS = [
    ("which accredited labs are near Pune", "LABORATORY_SEARCH", 0.99, "laboratory_search", "SEMANTIC_CONTEXTUAL"),
    ("show clause 4.2 of IS {0}", "CLAUSE_LOOKUP", 0.98, "clause", "IDENTIFIER_HEAVY"),
    ("open IS {0} please", "STANDARD_LOOKUP", 0.96, "standard_number", "STANDARD_METADATA"),
    ("IS{0}", "STANDARD_LOOKUP", 0.96, "standard_number", "STANDARD_METADATA"),
    ("compare cement and steel", "COMPARISON_QUERY", 0.90, "comparison", "SEMANTIC_CONTEXTUAL"),
    ("cement", "AMBIGUOUS_QUERY", 0.30, "single_word_fragment", "BROAD_FALLBACK"),
    ("is the qco notified for toys", "QCO_APPLICABILITY", 0.98, "qco_applicability", "APPLICABILITY_EVALUATION"),
    ("is a lab test mandatory", "AMBIGUOUS_QUERY", 0.40, "no_distinct_signal", "BROAD_FALLBACK"),
    ("which certification scheme covers pumps", "SCHEME_GUIDANCE", 0.96, "scheme_guidance", "STANDARD_METADATA"),
    ("how do i get bis certification", "PROCESS_EXPLANATION", 0.96, "process_explanation", "STANDARD_METADATA"),
    ("amendment 2 of IS {0}", "AMENDMENT_LOOKUP", 0.98, "amendment", "TEMPORAL_AWARE"),
    ("is IS {0} still in force", "CURRENTNESS_QUERY", 0.96, "currentness", "TEMPORAL_AWARE"),
    ("the previous edition of IS {0}", "VERSION_LOOKUP", 0.95, "version_signal", "TEMPORAL_AWARE"),
    ("what papers required to file", "DOCUMENT_REQUIREMENT_QUERY", 0.92, "document_requirement", "SEMANTIC_CONTEXTUAL"),
    ("marking requirements of toys", "REQUIREMENT_DISCOVERY", 0.75, "requirement_discovery", "SEMANTIC_CONTEXTUAL"),
    ("weather in Delhi", "UNSUPPORTED", 0.95, "unsupported_topic", "BROAD_FALLBACK"),
    ("सीमेंट के लिए कौन सा मानक है", "STANDARD_DISCOVERY", 0.95, "standard_discovery", "STANDARD_DISCOVERY"),
    ("", "AMBIGUOUS_QUERY", 0.10, "empty_query", "BROAD_FALLBACK"),
]


def _sql_pick(column, cast="VARCHAR"):
    values = ", ".join("'" + str(q[column]) + "'" for q in _QUESTIONS)
    return f"CAST([{values}][1 + p_partkey % {len(_QUESTIONS)}] AS {cast})"


def _asked():
    shown = F.element_at(F.array(*[F.lit(q[0]) for q in _QUESTIONS]), (1 + F.col("p_partkey") % len(_QUESTIONS)).cast("int"))
    return F.replace(shown, F.lit("{0}"), (F.col("p_partkey") + 100).cast("string"))


@query("q01_intent", f"SELECT p_partkey, {_sql_pick(1)} AS intent, {_sql_pick(2, 'DOUBLE')} AS confidence, {_sql_pick(3)} AS signal, {_sql_pick(1)} = 'AMBIGUOUS_QUERY' AS ambiguous FROM part")
def _(t):
    found = t("part").select("p_partkey", I.intent(_asked()).alias("i"))
    return found.select("p_partkey", "i.intent", "i.confidence", F.element_at("i.signals", 1).alias("signal"), "i.ambiguous")


@query("q03_strategy", f"SELECT p_partkey, {_sql_pick(4)} AS strategy FROM part")
def _(t):
    return t("part").select("p_partkey", I.strategy(I.intent(_asked())["intent"]).alias("strategy"))


@query("x22_entities", "SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS number, 2000 + p_size AS year, CAST(p_size AS VARCHAR) || '.2' AS clause FROM part")
def _(t):
    from strataframe.functions.query import entities

    q = F.concat(F.lit("what does IS "), "p_partkey", F.lit(" : "), 2000 + F.col("p_size"), F.lit(" Clause "), "p_size", F.lit(".2 say"))
    return t("part").select("p_partkey", entities(q).alias("e")).select("p_partkey", "e.number", "e.year", "e.clause")


_DOC_PARTS = ["test report of the nabl lab", "user manual", "we hereby declare", "circuit diagram, scale: 1", "calibration due", "qap", "datasheet", "spectroscopy", "valid up to", "plain words"]
_FILES = ["a/test_report.pdf", "b.pdf", "manual.txt", "calib.pdf", "x/manual/plain.txt"]


def _sql_class():
    scores = []
    for i, (kind, (w, words, names)) in enumerate(E.DOCUMENT_KINDS.items()):
        counts = " + ".join(f"least(3, (len(d) - len(replace(d, '{x}', ''))) // {len(x)})" for x in words)
        scores.append(f"{{'s': (({counts}) * 2.5 + CASE WHEN regexp_matches(f, '{'|'.join(names)}') THEN 1.5 ELSE 0 END) * {w}, 'at': {-i}, 'kind': '{kind}'}}")
    return "[" + ", ".join(scores) + "]"


@query("x32_doc_class", f"""
    WITH x AS (SELECT p_partkey, lower(repeat({_DOC_PARTS!r}[1 + p_partkey % 10] || '; ', 1 + p_size % 5) || {_DOC_PARTS!r}[1 + p_size % 10]) AS d, regexp_extract({_FILES!r}[1 + p_partkey % 5], '([^/]*)$', 1) AS f FROM part),
    y AS (SELECT p_partkey, list_reverse_sort({_sql_class()}) AS r FROM x)
    SELECT p_partkey, CASE WHEN r[1].s < 2 THEN 'OTHER' ELSE r[1].kind END AS kind, round_even(CASE WHEN r[1].s < 2 THEN 0.2 ELSE greatest(0.55, least(0.98, 0.60 + 0.35 * (r[1].s - r[2].s) / greatest(r[1].s, 1.0))) END, 6) AS confidence FROM y""")
def _(t):
    of = lambda words, k: F.element_at(F.array(*[F.lit(w) for w in words]), (1 + k % len(words)).cast("int"))
    text = F.concat(F.repeat(F.concat(F.upper(of(_DOC_PARTS, F.col("p_partkey"))), F.lit("; ")), (1 + F.col("p_size") % 5).cast("int")), of(_DOC_PARTS, F.col("p_size")))
    return t("part").select("p_partkey", E.document_class(text, of(_FILES, F.col("p_partkey"))).alias("c")).select("p_partkey", "c.kind", F.bround("c.confidence", 6).alias("confidence"))


_RX = lambda words: "|".join(words).replace("'", "''")
# lookbehind and lookahead have no form here: a mark is put where a sentence ends
_CLAIMS = f"""
    a AS (SELECT doc_id, text || chr(10) || chr(10) || CASE WHEN doc_id % 3 = 0 THEN 'Sources: [EV1], [EV2]' WHEN doc_id % 3 = 1 THEN '- It seems good [ev3]. Not missing? ' ELSE 'Status: in force' END AS t FROM documents),
    b AS (SELECT doc_id, t, list_transform(regexp_extract_all(regexp_extract(t, '(?i)(?:Sources|References)\\s*:\\s*((?:\\[(?:EV\\d+|citation-\\d+)\\][,\\s]*)+)', 1), '(?i)\\[(EV\\d+|citation-\\d+)\\]', 1), lambda x: upper(x)) AS foot,
          trim(regexp_replace(t, '(?is)\\n*(?:\\*\\*Sources:\\*\\*|Sources:|References:).*$', ''), ' ' || chr(9) || chr(10) || chr(13)) AS body FROM a),
    c AS (SELECT doc_id, foot, unnest(string_split(regexp_replace(regexp_replace(regexp_replace(body, '([.!?।॥])\\s+', '\\1' || chr(1), 'g'), '\\n{{2,}}', chr(1), 'g'), '\\n([-*•]|\\d+\\.)', chr(1) || '\\1', 'g'), chr(1))) AS part FROM b),
    d AS (SELECT doc_id, foot, trim(regexp_replace(trim(part, ' ' || chr(9) || chr(10) || chr(13)), '^[-*•\\d.]+\\s*', ''), ' ' || chr(9) || chr(10) || chr(13)) AS s FROM c),
    e AS (SELECT doc_id, foot, regexp_extract_all(s, '(?i)\\[(EV\\d+|citation-\\d+)\\]', 1) AS own, trim(regexp_replace(s, '(?i)\\[(EV\\d+|citation-\\d+)\\]', '', 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS claim FROM d),
    f AS (SELECT *, lower(claim) AS low, trim(lower(claim), '*: ,' || chr(9) || chr(10)) AS line FROM e WHERE claim <> ''),
    g AS (SELECT *, CASE WHEN regexp_matches(low, '{_RX(G.UNCERTAIN)}') THEN 'UNCERTAINTY' WHEN regexp_matches(low, '{_RX(G.INTERPRETING)}') THEN 'INTERPRETATION' ELSE 'FACT' END AS kind, len(own) = 0 AND len(foot) > 0 AS footer
          FROM f WHERE NOT regexp_matches(line, '^(?:{_RX((*G.SOURCE_HEADS, *G.STATUS_LINES))})$|^(?:{_RX((*G.SOURCE_STARTS, "status:"))})|(?:{_RX(G.CONSUMER_TIPS)})'))"""


@query("x35_claims", f"WITH {_CLAIMS} SELECT doc_id, kind, footer, count(*) AS claims, sum(length(claim))::BIGINT AS chars, sum(CASE WHEN len(own) > 0 THEN len(own) ELSE len(foot) END)::BIGINT AS cited FROM g GROUP BY 1, 2, 3")
def _(t):
    """Claims of whole documents with a line of sources, a bullet or a status line under them."""
    k = F.col("doc_id") % 3
    tail = F.when(k == 0, "Sources: [EV1], [EV2]").when(k == 1, "- It seems good [ev3]. Not missing? ").otherwise("Status: in force")
    said = D.claims(t("documents").withColumn("answer", F.concat("text", F.lit("\n\n"), tail)), "doc_id", "answer")
    return said.groupBy("doc_id", "kind", "footer").agg(F.count("*").alias("claims"), F.sum(F.length("claim")).alias("chars"), F.sum(F.size("citations")).alias("cited"))


_WORDS_OF = lambda c: f"list_distinct(regexp_extract_all({c}, '[a-z]{{3,}}'))"


@query("x38_claim_support", """
    WITH x AS (SELECT l.p_partkey, l.p_size AS said, r.p_size AS found, list_distinct(regexp_extract_all(lower(l.p_name), '[a-z]{3,}')) AS own, 'the shape of all is ' || lower(r.p_name) || ' with a thickness of ' || r.p_size || ' millimetres everywhere' AS source FROM part l JOIN part r ON r.p_partkey = l.p_partkey // 2),
    y AS (SELECT *, list_filter(own, lambda w: NOT contains(source, CASE WHEN w LIKE '%s' AND len(w) > 3 THEN w[:-2] ELSE w END)) AS lost FROM x),
    z AS (SELECT p_partkey, len(own) + 4 AS n, list_sort(lost) AS lost, said, found, source FROM y)
    SELECT p_partkey, list_concat(CASE WHEN contains(source, said || ' mm') OR regexp_matches(source, '\\b' || said || '\\b') AND contains(source, 'mm') THEN [] ELSE ['unsupported_numerical_value:' || said || ' mm'] END,
      CASE WHEN len(lost) * 1.0 / n >= 0.5 THEN ['unsupported_terms:missing=' || array_to_string(lost, ',')] WHEN 1 - len(lost) * 1.0 / n < 0.7 THEN ['partial_content_support:overlap=' || printf('%.2f', 1 - len(lost) * 1.0 / n)] ELSE [] END) AS issues FROM z""")
def _(t):
    """Sizes and names of parts claimed of other parts."""
    l = spread(t("part")).select("p_partkey", "p_name", "p_size")
    r = t("part").select(F.col("p_partkey").alias("r_key"), F.col("p_name").alias("r_name"), F.col("p_size").alias("r_size"))
    x = l.join(r, F.col("r_key") == F.floor(F.col("p_partkey") / 2))
    no = F.lit(None).cast("string")
    content = F.concat(F.lit("The shape of all is "), "r_name", F.lit(" with a thickness of "), "r_size", F.lit(" mmillimetres everywhere"))
    content = F.replace(content, F.lit("mmilli"), F.lit("milli"))
    e = F.struct(F.lit("EV1").alias("id"), no.alias("hash"), content.alias("content"), no.alias("number"), no.alias("clause"), no.alias("edition"), no.alias("amendment"), no.alias("year"), F.lit(None).cast("boolean").alias("is_current"), F.array().cast("array<string>").alias("titles"))
    claim = F.concat(F.lit("The thickness everywhere of a shape of millimetres for "), F.initcap("p_name"), F.lit(" is of "), "p_size", F.lit(" mm"))
    v = G.validated(claim, F.lit("FACT"), F.array(F.lit("EV1")), F.lit(False), F.array(e))
    return x.select("p_partkey", v.alias("v")).select("p_partkey", "v.issues")


@query("x42_title_score", """
    WITH x AS (SELECT p_partkey, lower(CASE p_size % 4 WHEN 0 THEN p_name || ' - specification' WHEN 1 THEN 'Code for ' || p_name WHEN 2 THEN 'for ' || string_split(p_name, ' ')[2] || ' and others' ELSE p_type END) AS t, lower(p_name) AS p FROM part),
    y AS (SELECT *, list_filter(list_distinct(regexp_extract_all(t, '\\b[a-z]{3,}\\b')), lambda w: w NOT IN ('the', 'and', 'for', 'with')) AS a, list_filter(list_distinct(regexp_extract_all(p, '\\b[a-z]{3,}\\b')), lambda w: w NOT IN ('the', 'and', 'for', 'with')) AS b FROM x),
    z AS (SELECT *, len(list_intersect(a, b)) / least(len(a), len(b)) AS o FROM y)
    SELECT p_partkey, CAST(CASE WHEN starts_with(t, p) THEN 1.0 WHEN contains(t, p) THEN 0.9 WHEN least(len(a), len(b)) = 0 THEN 0.0 WHEN o >= 0.66 THEN 0.85 WHEN o >= 0.33 THEN 0.5 ELSE 0.0 END AS DOUBLE) AS score FROM z""")
def _(t):
    k = F.col("p_size") % 4
    title = F.when(k == 0, F.concat("p_name", F.lit(" - specification"))).when(k == 1, F.concat(F.lit("Code for "), "p_name")).when(k == 2, F.concat(F.lit("for "), F.element_at(F.split("p_name", " "), 2), F.lit(" and others"))).otherwise(F.col("p_type"))
    return t("part").select("p_partkey", D.title_score(title, F.col("p_name")).alias("score"))


@query("x42_sub_scores", """
    WITH x AS (SELECT p_partkey, string_split(lower(p_name), ' ') AS w, [lower(p_brand || ' made of ' || string_split(p_name, ' ')[1]), lower(CASE WHEN p_size % 3 = 0 THEN p_name || ' in steel' ELSE p_type END)] AS texts, p_size FROM part),
    y AS (SELECT *, list_filter(list_distinct(w), lambda v: len(v) >= 3) AS terms FROM x)
    SELECT p_partkey, CAST(CASE WHEN len(terms) = 0 THEN 0.0 ELSE round_even(list_max(list_transform(texts, lambda t: len(list_filter(terms, lambda v: contains(t, v))))) / len(terms), 2) END AS DOUBLE) AS terms,
    CAST(CASE WHEN contains(array_to_string(texts, '|'), 'steel') THEN CASE WHEN contains(array_to_string(texts, '|'), 'economy') THEN 1.0 ELSE 0.5 END WHEN contains(array_to_string(texts, '|'), 'economy') THEN 0.5 ELSE 0.0 END AS DOUBLE) AS technical,
    round_even(CASE p_size % 4 WHEN 0 THEN 1 / (1 + exp(-(p_size / 10.0))) WHEN 1 THEN least(1, p_size / 1000.0 * 20) WHEN 2 THEN greatest(0, least(1, p_size / 40.0)) END, 6) AS semantic FROM y""")
def _(t):
    s, words = F.col("p_size"), F.split("p_name", " ")
    texts = F.array(F.concat("p_brand", F.lit(" made of "), F.element_at(words, 1)), F.when(s % 3 == 0, F.concat("p_name", F.lit(" in steel"))).otherwise(F.col("p_type")))
    semantic = D.semantic_score(F.when(s % 4 == 0, s / 10.0), F.when(s % 4 == 1, s / 1000.0), F.when(s % 4 == 2, s / 40.0))
    facts = F.array(F.lit("Steel"), F.lit(None).cast("string"), F.lit("economy"), F.lit(""))
    return t("part").select("p_partkey", D.term_score(F.col("p_name"), texts).alias("terms"), D.technical_score(facts, texts).alias("technical"), F.bround(semantic, 6).alias("semantic"))


_SCOPE = """CASE p_size % 4 WHEN 0 THEN 'This standard covers ' || string_split(p_name, ' ')[2] || 's for homes. It does not apply to industrial use.' WHEN 1 THEN 'Scope excludes: commercial kitchens; other matters' WHEN 2 THEN 'General text about ' || p_name ELSE 'Nothing of note' END"""


@query("d01_applicability", f"""
    WITH x AS (SELECT p_partkey, p_size, CASE WHEN p_size % 9 = 0 THEN 'SUPERSEDED' END AS temporal, CASE WHEN p_size % 10 <> 0 THEN p_name END AS name, CASE p_size % 3 WHEN 0 THEN 'industrial' WHEN 1 THEN 'commercial kitchens' ELSE '' END AS env, lower(p_type || ' domestic goods') AS title, lower({_SCOPE}) AS scope, p_partkey % 100 / 100.0 AS score FROM part),
    y AS (SELECT *, title || ' ' || scope AS text, list_filter(regexp_extract_all(lower(coalesce(name, '')), '\\b[a-z]{{3,}}\\b'), lambda w: NOT list_contains({_sql_list(D.SCOPE_STOP)}, w)) AS words FROM x),
    z AS (SELECT *, (p_size % 4 = 0 AND env = 'industrial') OR (p_size % 4 = 1 AND env = 'commercial kitchens') AS excluded,
      len(list_filter(words, lambda w: contains(title, regexp_replace(w, 's+$', '')) OR (p_size % 4 = 0 AND contains(regexp_extract(scope, 'covers ([^.;]+)', 1), regexp_replace(w, 's+$', ''))))) > 0 AS noun, env = 'industrial' AND NOT contains(text, 'industrial') AS clash FROM y)
    SELECT p_partkey, CASE WHEN temporal IS NOT NULL THEN 'VERIFICATION_REQUIRED' WHEN name IS NULL THEN 'INSUFFICIENT_EVIDENCE' WHEN excluded THEN 'NOT_APPLICABLE' WHEN noun AND NOT clash AND score >= 0.70 THEN 'APPLICABLE'
      WHEN score >= 0.45 OR len(list_filter(words, lambda w: len(w) > 3 AND contains(text, w))) > 0 THEN 'POTENTIALLY_APPLICABLE' ELSE 'INSUFFICIENT_EVIDENCE' END AS status,
    CAST(CASE WHEN temporal IS NOT NULL THEN 0.40 WHEN name IS NULL THEN 0.20 WHEN excluded THEN 0.90 WHEN noun AND NOT clash AND score >= 0.70 THEN greatest(0.75, score) ELSE score END AS DOUBLE) AS confidence FROM z""")
def _(t):
    s, words = F.col("p_size"), F.split("p_name", " ")
    scope = (
        F.when(s % 4 == 0, F.concat(F.lit("This standard covers "), F.element_at(words, 2), F.lit("s for homes. It does not apply to industrial use."))).when(s % 4 == 1, "Scope excludes: commercial kitchens; other matters")
        .when(s % 4 == 2, F.concat(F.lit("General text about "), "p_name")).otherwise("Nothing of note")
    )
    use = F.when(s % 3 == 0, "industrial").when(s % 3 == 1, "commercial kitchens").otherwise("")
    a = D.applicability(F.when(s % 9 == 0, "SUPERSEDED"), F.when(s % 10 != 0, F.col("p_name")), F.lit(None).cast("string"), F.when(s % 10 != 0, use), F.concat("p_type", F.lit(" domestic goods")), scope, F.col("p_partkey") % 100 / 100.0)
    return t("part").select("p_partkey", a.alias("a")).select("p_partkey", "a.*")


@query("d03_scheme", """
    WITH x AS (SELECT p_partkey, p_size, CASE WHEN p_size % 7 = 0 THEN 'IS 1417' WHEN p_size % 7 = 1 THEN 'IS 269' WHEN p_size % 7 = 2 THEN 'IS 13252' ELSE '' END AS std, lower(p_name || CASE p_size % 5 WHEN 0 THEN ' led driver' WHEN 1 THEN ' solar cable' WHEN 2 THEN ' in silver' WHEN 3 THEN ' imported goods' ELSE '' END) AS d FROM part),
    y AS (SELECT *, lower(std) || ' ' || d AS text, p_size % 2 = 0 AS must, p_size % 11 = 0 OR contains(d, 'imported') AS abroad, contains(std, '1417') OR contains(d, 'silver') AS gold FROM x)
    SELECT p_partkey, CASE WHEN std = '' AND p_size % 3 = 0 THEN 'SCHEME-CLARIFICATION-REQUIRED' WHEN gold THEN 'SCHEME-IV' WHEN must AND (contains(text, 'led driver') OR contains(text, 'solar') OR contains(text, '13252')) AND NOT contains(text, 'cable') THEN 'SCHEME-II'
      WHEN must AND abroad THEN 'SCHEME-X' WHEN must THEN 'SCHEME-I' ELSE 'SCHEME-I-VOLUNTARY' END AS scheme FROM y""")
def _(t):
    s, k, m = F.col("p_size"), F.col("p_size") % 5, F.col("p_size") % 7
    product = F.concat("p_name", F.when(k == 0, " led driver").when(k == 1, " solar cable").when(k == 2, " in silver").when(k == 3, " imported goods").otherwise(""))
    std = F.when(m == 0, "IS 1417").when(m == 1, "IS 269").when(m == 2, "IS 13252").otherwise("")
    none = F.lit(None).cast("string")
    return t("part").select("p_partkey", D.scheme(std, product, none, none, s % 2 == 0, F.when(s % 11 == 0, "Overseas"), (std != "") | (s % 3 != 0)).alias("scheme"))


@query("d04_checklist", """
    WITH x AS (SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'SCHEME-IV' WHEN 1 THEN 'Scheme II' WHEN 2 THEN 'fmcs' WHEN 3 THEN 'SCHEME-X' WHEN 4 THEN 'SCHEME-I' END AS code, p_name || CASE p_size % 5 WHEN 0 THEN ' plug' WHEN 1 THEN ' of gold' WHEN 2 THEN ' laptop' WHEN 3 THEN ' for export to india' ELSE '' END AS d FROM part),
    y AS (SELECT *, lower(d || ' ' || coalesce(code, '')) AS text, upper(coalesce(code, '')) AS up FROM x),
    z AS (SELECT *, contains(up, 'IV') OR contains(text, 'gold') AS gold, (contains(up, 'II') OR contains(text, 'laptop')) AND NOT contains(text, 'plug') AS crs, contains(up, 'X') OR contains(up, 'FMCS') OR contains(text, 'export to india') AS abroad FROM y),
    k AS (SELECT p_partkey, CASE WHEN gold THEN 'SCHEME-IV' WHEN crs THEN 'SCHEME-II' WHEN abroad THEN 'SCHEME-X' ELSE 'SCHEME-I' END AS kind FROM z)
    SELECT p_partkey, kind, CASE WHEN kind IN ('SCHEME-IV', 'SCHEME-II') THEN 4 ELSE 5 END AS steps FROM k""")
def _(t):
    k, j = F.col("p_size") % 6, F.col("p_size") % 5
    code = F.when(k == 0, "SCHEME-IV").when(k == 1, "Scheme II").when(k == 2, "fmcs").when(k == 3, "SCHEME-X").when(k == 4, "SCHEME-I")
    product = F.concat("p_name", F.when(j == 0, " plug").when(j == 1, " of gold").when(j == 2, " laptop").when(j == 3, " for export to india").otherwise(""))
    kind = D.checklist_kind(F.lit(None).cast("string"), F.lit(None).cast("string"), product, code)
    rows = D.checklist(t("part").withColumn("kind", kind), "p_partkey", F.col("kind")).groupBy("p_partkey").agg(F.count("*").cast("int").alias("steps"))
    return t("part").select("p_partkey", kind.alias("kind")).join(rows, "p_partkey")


@query("d05_justification", "SELECT p_partkey, 'IS ' || p_partkey || ' is ' || CASE WHEN p_size > 25 THEN 'mandatory' ELSE 'voluntary' END || ' for ' || p_name AS reason FROM part")
def _(t):
    return t("part").select("p_partkey", F.concat_ws(" ", F.concat(F.lit("IS "), "p_partkey"), F.lit("is"), F.when(F.col("p_size") > 25, "mandatory").otherwise("voluntary"), F.lit("for"), "p_name").alias("reason"))


@query("x47_product_id", "SELECT p_partkey, substring(sha256(lower(p_name || '::' || p_type)), 1, 12) AS product_id FROM part")
def _(t):
    return t("part").select("p_partkey", X.digest(F.lower(F.concat_ws("::", "p_name", "p_type")), 12).alias("product_id"))


@query("st1_job_state", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, count(*) AS n, round_even(sum(value), 4) AS total FROM events GROUP BY 1")
def _(t):
    return ST.job_states(t("events")).select("user_id", "state", "n", F.bround("total", 4).alias("total"))


@query("st2_counters", "SELECT user_id, count(*) FILTER (event_type = 'view') AS n_view, count(*) FILTER (event_type = 'click') AS n_click, count(*) FILTER (event_type = 'error') AS n_error, max(event_id) AS cursor FROM events GROUP BY 1")
def _(t):
    """Counted up to a stop, then resumed over all events again."""
    e, kinds = t("events"), ["view", "click", "error"]
    saved = ST.counters(e.filter("event_id % 1000 < 600 AND user_id % 3 > 0").filter("event_id < 700"), "user_id", "event_type", kinds, "event_id")
    done = ST.counters(e.join(saved.select(F.col("user_id").alias("u"), F.col("cursor").alias("c")), F.col("user_id") == F.col("u")).filter("event_id <= c"), "user_id", "event_type", kinds, "event_id")
    return ST.resumed_counters(done, e, "user_id", "event_type", kinds, "event_id")


@query("st3_dedupe_incremental", "SELECT min(doc_id) AS doc_id, sha256(text) AS content_hash FROM documents GROUP BY 2")
def _(t):
    return ST.first_by_hash(t("documents"), "doc_id", "text")


@query("st4_assessment_sessions", """
    WITH c AS (SELECT conv_id, turn, role, CASE WHEN role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 1 ELSE 0 END AS new FROM conversations)
    SELECT conv_id, turn, CAST(sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS session FROM c""")
def _(t):
    return ST.sessions(t("conversations"), "conv_id", "turn", "role").select("conv_id", "turn", "session")


@query("st7_sliding_rate_limit", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts) RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS in_window FROM events")
def _(t):
    return ST.requests_in_window(t("events"), "user_id", "ts", 3600).select("event_id", "in_window")


@query("st7_accepted_requests")
def _(t):
    return ST.accepted(t("events"), "user_id", "ts", "event_id", limit=2, seconds=86400)
