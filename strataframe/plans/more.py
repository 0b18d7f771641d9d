"""Sources, extraction and remaining rule queries over rendered text."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strataframe.functions import context as K
from strataframe.functions import extract as E
from strataframe.functions import grounding as G
from strataframe.functions import text as X
from strataframe.operators import chunking as C
from strataframe.operators import postings as P
from strataframe.operators import retrieval as R
from strataframe.operators import rules as D
from strataframe.operators import store as S
from strataframe.plans import query, spread
from strataframe.session import shared_dir
from strataframe.sources import files, html



def _columns():
    return F.col("p_partkey"), F.col("p_size")


@query("s01_pages_to_markdown", "SELECT conv_id, string_agg('<!-- PAGE ' || turn || ' -->' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS markdown FROM conversations GROUP BY 1")
def _(t):
    return files.pages_to_markdown(t("conversations"), "conv_id", "turn", "text")


@query("s03_chunk_envelope", "SELECT CAST(conv_id AS VARCHAR) AS document_id, CAST(conv_id AS VARCHAR) || '-' || turn AS chunk_id, text AS content FROM conversations")
def _(t):
    c = t("conversations").select("conv_id", "turn", F.concat_ws("-", "conv_id", "turn").alias("chunk_id"), F.col("text").alias("content"), F.create_map(F.lit("role"), F.col("role")).alias("metadata"), F.lit("x.md").alias("source"))
    wire = files.to_envelopes(c, "conv_id", "source", "turn").select(F.to_json(F.struct("*")).alias("j")).select(F.from_json("j", files.ENVELOPE).alias("e")).select("e.*")
    return files.from_envelopes(wire).select("document_id", "chunk_id", "content")


@query("s04_corpus_scan", "SELECT doc_id FROM documents WHERE trim(text) <> ''")
def _(t):
    return files.scan_corpus(t("documents"), "text").select("doc_id")


@query("s05_vector_upsert", "SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END AS label FROM embeddings WHERE vec_id % 2 = 0 OR vec_id % 3 = 0")
def _(t):
    e = t("embeddings").select("vec_id", "label")
    return S.upsert_replace(e.filter("vec_id % 2 = 0"), e.filter("vec_id % 3 = 0").withColumn("label", F.col("label") + 100), "vec_id", "label")


_TYPES, _OFTEN = [*files.SOURCE_TYPES, "carrier pigeon", None, "gazette"], [*files.FREQUENCIES, "hourly", None]


@query("s12_registry_enums", """
    SELECT s_suppkey, coalesce(['OFFICIAL_PORTAL', 'GAZETTE', 'STANDARDS_BODY', 'MINISTRY_PORTAL', 'REGULATOR_PORTAL', 'LABORATORY_REGISTRY'][1 + s_suppkey % 9], 'OFFICIAL_PORTAL') AS source_type,
      coalesce(['DAILY', 'WEEKLY', 'BIWEEKLY', 'MONTHLY', 'MANUAL'][1 + s_suppkey % 7], 'DAILY') AS crawl_frequency FROM supplier""")
def _(t):
    of = lambda words: F.element_at(F.array(*[F.lit(w) for w in words]), (1 + F.col("s_suppkey") % len(words)).cast("int"))
    return files.with_known_enums(t("supplier").select("s_suppkey", of(_TYPES).alias("source_type"), of(_OFTEN).alias("crawl_frequency")))


@query("s13_html_tables", """
    WITH p AS (SELECT page_id, length(html) % 4 AS n, length(html) AS z, regexp_extract(html, '<h1>([^<&]*)', 1) AS h FROM pages), r AS (SELECT *, unnest(range(1, n + 1))::INT AS k FROM p)
    SELECT page_id, k AS row, 'IS ' || (z + k) || CASE WHEN k % 2 = 1 THEN ': ' || (1990 + k) ELSE '' END AS number, trim(regexp_replace(h, '\\s+', ' ', 'g')) || ' & inner ' || k AS title,
      CASE k WHEN 1 THEN 'https://h.example/d/a' || z || '.pdf' WHEN 2 THEN 'https://h.example/b.PDF' END AS pdf_url, CASE WHEN k % 2 = 1 THEN 1990 + k END AS year FROM r""")
def _(t):
    """Whole pages with a table put before their article: signs in attributes, comments, a table inside a cell, rows without ends."""
    z, n = F.length("html"), F.length("html") % 4
    row = lambda k: F.concat(
        F.lit("<tr class='x>y'><!-- <tr><td>no</td> --><td title=\"a > <td>\">IS "), (z + k).cast("string"), F.when(k % 2 == 1, F.concat(F.lit(": "), (k + 1990).cast("string"))).otherwise(""), F.lit("<td><b>"), F.regexp_extract("html", "<h1>([^<&]*)", 1),
        F.lit("</b>&amp;<table><tr><td>inner</td><td>"), k.cast("string"), F.lit("</td></tr></table></td><td><a href=\"/x.html\">x</a> <a href='"), F.when(k == 1, F.concat(F.lit("a"), z.cast("string"), F.lit(".pdf"))).when(k == 2, "/b.PDF").otherwise("c.doc"), F.lit("'>pdf</a>"),
    )
    rows = F.array_join(F.transform(F.filter(F.sequence(F.lit(1), F.lit(3)), lambda k: k <= n), row), "\n")
    table = F.concat(F.lit("<script>var a='<table><tr><td>';</script><TABLE data-a='>'><tr><th>Number<th>Title</tr>"), rows, F.lit("</TABLE><table><tr><td>second</table>"))
    page = F.concat(F.substring_index("html", "<article>", 1), table, F.lit("<article>"), F.substring_index("html", "<article>", -1))
    return html.table_rows(t("pages").withColumn("page", page), "page_id", "page", F.lit("https://h.example/d/list.html"))


@query("s15_download_outcome", """
    SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'NOT_ALLOWED' WHEN event_type = 'error' THEN 'BLOCKED' WHEN event_type = 'click' THEN 'RETRY' WHEN event_type = 'signup' THEN 'FAILED' WHEN event_id % 2 = 0 THEN 'NOT_A_PDF' ELSE 'DOWNLOADED' END AS outcome FROM events""")
def _(t):
    k = F.col("event_type")
    status = F.when(k == "error", 403).when(k == "click", 503).when(k == "signup", 404).otherwise(200)
    host = F.when(F.col("event_id") % 5 == 0, "elsewhere.example").otherwise("files.example")
    return t("events").select("event_id", files.download_outcome(status, F.when(F.col("event_id") % 2 == 0, "<html>").otherwise("%PDF-1.7"), host, ["files.example"]).alias("outcome"))


@query("s17_ingestion_registry", "SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1")
def _(t):
    return t("documents").groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


@query("s19_release_manifest")
def _(t):
    every = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
    return files.manifest(S.table_counts({x: t(x) for x in every}), t("orders"), "o_orderstatus")


@query("s20_report_lines", "SELECT 'status' AS section, o_orderstatus || ' | ' || count(*) AS line FROM orders GROUP BY o_orderstatus UNION ALL SELECT 'priority', o_orderpriority || ' | ' || count(*) FROM orders GROUP BY o_orderpriority")
def _(t):
    by = lambda c: t("orders").groupBy(c).agg(F.count("*").alias("n"))
    return files.report_lines({"status": by("o_orderstatus"), "priority": by("o_orderpriority")})


@query("f13_null_tolerant_scope", "SELECT l_orderkey, l_linenumber FROM (SELECT *, count(*) FILTER (l_returnflag = 'R' OR l_linestatus = 'F') OVER (PARTITION BY l_orderkey) AS k FROM lineitem) WHERE k = 0 OR l_returnflag = 'R' OR l_linestatus = 'F'")
def _(t):
    ok = (F.col("l_returnflag") == "R") | (F.col("l_linestatus") == "F")
    kept = F.count_if(ok).over(Window.partitionBy("l_orderkey"))
    return t("lineitem").withColumn("k", kept).filter((F.col("k") == 0) | ok).select("l_orderkey", "l_linenumber")


@query("f14_contract_projection", "SELECT p_partkey, coalesce(nullif(CASE WHEN p_size % 2 = 0 THEN '' ELSE p_name END, ''), p_brand) AS title, coalesce(CASE WHEN p_size % 5 <> 0 THEN p_size END, -1) AS page FROM part")
def _(t):
    P, Z = _columns()
    title = X.first_filled(F.when(Z % 2 == 0, "").otherwise(F.col("p_name")), F.col("p_brand"))
    return t("part").select("p_partkey", title.alias("title"), X.encode_int(F.when(Z % 5 != 0, Z)).alias("page"))


_LINES = ["4.2 {0}", "GENERAL REQUIREMENTS", "the quick brown fox", "Annex A of {0}", "appendix", "Scope", "IV. {0}", "B. {0}", "{0} is red", "TOO", "TABLE 12 {0}", "12) {0}", "12.{0}", "LONG LINE " * 13, "  2.1. {0}  ", "scopes of {0}", "x" * 190, "3 " + "y" * 190, ""]


@query("x05_heading_candidate", f"""
    WITH x AS (SELECT p_partkey, trim(replace({[line for line in _LINES]!r}[1 + p_partkey % {len(_LINES)}], '{{0}}', CASE WHEN p_size % 2 = 0 THEN upper(p_name) ELSE p_name END)) AS t FROM part)
    SELECT p_partkey, t <> '' AND len(t) <= 180 AND (regexp_matches(t, '^((?i:annex|appendix|foreword|introduction|scope))\\b|^\\d+(\\.\\d+)*[.)]?\\s+\\S|^[A-Z]\\.\\s+\\S|^[IVXL]+\\.\\s+\\S')
      OR (len(t) < 120 AND NOT regexp_matches(t, '[a-z]') AND len(regexp_replace(t, '[^A-Z]', '', 'g')) >= 4)) AS heading FROM x""")
def _(t):
    P, Z = _columns()
    line = F.replace(F.element_at(F.array(*[F.lit(x) for x in _LINES]), (1 + P % len(_LINES)).cast("int")), F.lit("{0}"), F.when(Z % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")))
    return t("part").select("p_partkey", X.heading_candidate(line).alias("heading"))


@query("x09_header_fields", """
    WITH p AS (SELECT *, p_partkey % 6 AS k, p_size % 4 AS z FROM part)
    SELECT p_partkey, 'IS ' || p_partkey || CASE WHEN k < 3 THEN '-' || p_size ELSE '' END AS number, CASE WHEN z > 0 THEN 2000 + p_size END AS year, CASE WHEN k < 3 THEN CAST(p_size AS VARCHAR) END AS part,
      CASE WHEN k = 1 THEN CAST(p_size AS VARCHAR) END AS amendment, CASE z WHEN 1 THEN 'Second Edition' WHEN 2 THEN '3rd edition' END AS edition, CASE WHEN z = 3 THEN '12 May 2004' WHEN z = 0 THEN '2004-05-12' END AS published,
      CASE WHEN k = 5 THEN NULL ELSE p_name END AS title, CASE WHEN k IN (1, 4) THEN 'amendment' WHEN k = 2 OR z = 1 THEN 'indian_standard' WHEN k = 3 THEN 'guideline' WHEN k = 0 THEN 'draft' END AS document_type FROM p""")
def _(t):
    P, Z = _columns()
    k, z = P % 6, Z % 4
    head = F.concat(
        F.lit("<!-- PAGE 1 -->\n# <!-- PAGE 2 -->\n#\n"), F.when(k == 5, "no heading\n").when(k % 2 == 0, F.concat(F.lit("  # "), "p_name", F.lit("\r\nTITLE: other\n"))).otherwise(F.concat(F.lit("Title: "), "p_name", F.lit("\n# other\n"))),
        F.lit("IS "), F.when(k < 2, F.concat(P, F.lit(" (Part "), Z, F.lit(")"))).when(k == 2, F.concat(P, F.lit(" - "), Z)).otherwise(P.cast("string")), F.when(z > 0, F.concat(F.lit(" : "), 2000 + Z)).otherwise(""), F.lit("\n"),
        F.when(k == 1, F.concat(F.lit("Amd. No. "), Z, F.lit(" is an AMENDMENT\n"))).when(k == 2, "Indian Standard of pipes\n").when(k == 3, "A guideline, no draft\n").when(k == 0, "DRAFT\n").otherwise(""),
        F.when(z == 1, "Second Edition\n").when(z == 2, "3rd edition\n").when(z == 3, "Dated: 12 May 2004\n").otherwise("effective 2004-05-12\n"),
    )
    name = F.when(k == 4, "x_AMD_2.pdf").when(z == 1, "IS_1.pdf").otherwise("this.pdf")
    return t("part").select("p_partkey", E.header(head, name).alias("h")).select("p_partkey", "h.*")


@query("x12_chunk_id", "SELECT doc_id, substring(sha256('d::s::' || trim(text)), 1, 16) AS raw FROM documents")
def _(t):
    return t("documents").select("doc_id", X.chunk_id(F.lit("d"), F.lit("s"), F.col("text"), F.lit(0)).alias("raw"))


_KINDS = ["indian_standard", "amendment", "draft", "gazette", "qco", "manual", "other"]


@query("x14_relation", f"""
    SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'none' WHEN kind IN ('indian_standard', 'amendment', 'draft') THEN 'identity' ELSE 'reference' END AS relation FROM (SELECT *, {_KINDS!r}[1 + p_partkey % 7] AS kind FROM part)""")
def _(t):
    P, Z = _columns()
    kind = F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (1 + P % 7).cast("int"))
    return t("part").select("p_partkey", E.relation(F.when(Z % 5 != 0, P.cast("string")), kind).alias("relation"))


@query("x18_context_check", """
    WITH x AS (SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS own, CAST(p_partkey + p_size % 2 AS VARCHAR) AS other, ['4', '4.2', '4.2.1', '7'][1 + p_size % 4] AS a, ['4.1', '4', '9.9'][1 + p_partkey % 3] AS b FROM part)
    SELECT p_partkey, list_concat(CASE WHEN other <> own THEN ['standard IS ' || other] ELSE [] END,
      list_concat(list_transform(list_filter(CASE WHEN a = b THEN [a] ELSE [a, b] END, lambda c: c <> '4.2' AND NOT starts_with('4.2', c || '.')), lambda c: 'clause ' || c),
      CASE WHEN p_partkey % 4 = 1 THEN ['amendment 1'] ELSE [] END)) AS wrong FROM x""")
def _(t):
    P, Z = _columns()
    a = F.element_at(F.array(*[F.lit(x) for x in ("4", "4.2", "4.2.1", "7")]), (1 + Z % 4).cast("int"))
    b = F.element_at(F.array(*[F.lit(x) for x in ("4.1", "4", "9.9")]), (1 + P % 3).cast("int"))
    c = F.concat(F.lit("From IS "), P, F.lit(" clause "), a, F.lit(" and IS-"), P + Z % 2, F.lit(" Clause "), b, F.when(P % 4 > 0, F.concat(F.lit(" by Amendment "), P % 4)).otherwise(""))
    return t("part").select("p_partkey", E.context_contradictions(c, F.concat(F.lit("IS "), P), F.lit("4.2"), F.when(P % 4 == 1, 2).when(P % 4 != 0, P % 4)).alias("wrong"))


_PLURAL = list(E.SINGULAR)


@query("x23_product_text", f"""
    WITH w AS (SELECT p_partkey, {_PLURAL!r}[1 + p_partkey % 26] AS p, {list(E.SINGULAR.values())!r}[1 + p_partkey % 26] AS s, p_size % 3 AS z FROM part)
    SELECT p_partkey, 'copper ' || CASE z WHEN 0 THEN s WHEN 1 THEN upper(s) ELSE upper(s[1]) || s[2:] END || ' ' || p_partkey || ' glass a-b' AS name FROM w""")
def _(t):
    P, Z = _columns()
    w = F.element_at(F.array(*[F.lit(x) for x in _PLURAL]), (1 + P % 26).cast("int"))
    cased = F.when(Z % 3 == 0, w).when(Z % 3 == 1, F.upper(w)).otherwise(F.initcap(w))
    return t("part").select("p_partkey", E.product_text(F.concat(F.lit(" cop-\nper  "), cased, F.lit(" '"), P, F.lit("' `glass` a-b "))).alias("name"))


_SAID = [
    "We manufacture stainless steel pressure cookers for household use", "which standard covers copper wire in India", "an Infrared thermometer of 12 V and 5.5 litre", "GI pipes", "requirements for ceiling fans under IS 374 and IS 1234-2", "PVC cables, hydraulic press 20 MPa", "portland cement 50 kg with compression",
    "apply to our garden hoses.", "rubber toys 10mm x 20mm, electrical", "nothing stated", "solar water heater pressurised 3 bar for hospital use", "standards for IS 5 goods in Pune", "mild steel, mercury and gold", "hospital beds, home use",
]


def _sql_first(table, d="d"):
    return "CASE " + " ".join(f"WHEN regexp_matches({d}, '(?i)\\b(?:{p})\\b') THEN '{v}'" for p, v in table) + " END"


def _sql_target(pattern, d="d"):
    return f"nullif(trim(regexp_replace(trim(regexp_extract({d}, '{pattern}', 1)), '(?i)^(?:our|the|a|an)\\s+', '')), '')"


def _sql_said(texts):
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in texts) + f"][1 + p_partkey % {len(texts)}]"


def _said(texts, P):
    return F.element_at(F.array(*[F.lit(x) for x in texts]), (1 + P % len(texts)).cast("int"))


@query("x24_product_context", f"""
    WITH x AS (SELECT p_partkey, {_sql_said(_SAID)} || ' ' || p_size || ' g' AS d FROM part),
    y AS (SELECT *, [{", ".join(_sql_target(p) for p in K.TARGETS)}] AS named FROM x)
    SELECT p_partkey, coalesce({_sql_first(K.PRODUCTS)}, list_filter(named, lambda n: n IS NOT NULL AND len(n) BETWEEN 3 AND 59 AND NOT regexp_matches(n, '(?i)\\bIS\\s+\\d+\\b'))[1]) AS product, {_sql_first(K.MATERIALS)} AS material,
    {_sql_first(K.TECHNOLOGIES)} AS technology, {_sql_first(K.PRINCIPLES)} AS principle, {_sql_first(K.USES)} AS use, regexp_extract_all(d, '{K.CAPACITY}', 1) AS capacities,
    list_transform(regexp_extract_all(d, '(?i)\\bIS\\s+(\\d+(?:-\\d+)?)\\b', 1), lambda n: 'IS ' || n) AS standards FROM y""")
def _(t):
    P, Z = _columns()
    c = K.product_context(F.concat(_said(_SAID, P), F.lit(" "), Z, F.lit(" g")))
    return t("part").select("p_partkey", c.alias("c")).select("p_partkey", "c.*")


_ASKERS = [
    "we are manufacturers of toys, our factory in Sonipat and at Delhi", "As an importer we source from abroad", "an MSME startup based in Pune making PVC pipes", "trader of steel bars in January", "who sells locally", "a foreign manufacturer, exporting to India, located in Goa", "we supply to Hospitals with ISI mark",
    "hallmarked gold for retailers in Detail", "assembly of wires for use in schools", "large scale production of cement", "is it for the garden hose.", "in Kerala we distribute insulated cables", "for our IS 5 goods in Bihar",
]


@query("x25_business_context", f"""
    WITH x AS (SELECT p_partkey, p_size, {_sql_said(_ASKERS)} AS d FROM part),
    y AS (SELECT *, list_filter(list_zip(regexp_extract_all(d, '{K.LOCATION}', 1), regexp_extract_all(d, '{K.LOCATION}', 2)), lambda z: NOT list_contains({list(K.NO_PLACES)!r}, lower(z[2])) AND (list_contains({list(K.PLACES)!r}, lower(z[2])) OR regexp_matches(z[1], '(?i)(?:factory|plant) in')))[1][2] AS place,
      [{", ".join(f"nullif(trim(regexp_extract(d, '(?i)" + chr(92) + "b(?:" + p + ")" + chr(92) + "b')), '')" for p in K.CATEGORIES)}] AS cats, {_sql_target(K.ABOUT)} AS about, [{", ".join(f"nullif(trim(regexp_extract(d, '{p}', 1)), '')" for p in K.CUSTOMERS)}] AS cust FROM x),
    z AS (SELECT *, {_sql_first(K.ACTIVITIES)} AS act, {_sql_first(K.BUSINESS_TYPES)} AS typ, {_sql_first(K.SIZES)} AS siz,
      list_filter([CASE WHEN regexp_matches(d, '(?i)\\b(?:isi\\s+mark|isi\\s+certified)\\b') THEN 'ISI Mark' END, CASE WHEN regexp_matches(d, '(?i)\\b(?:hallmark|hallmarked)\\b') THEN 'Hallmark' END], lambda v: v IS NOT NULL) AS marks FROM y)
    SELECT p_partkey, act AS activity, coalesce(typ, 'manufacturer') AS type, coalesce(siz, CASE WHEN p_size % 2 = 0 THEN 'Startup' END) AS size, place AS location,
    coalesce(list_filter(cats, lambda v: v IS NOT NULL)[1], CASE WHEN len(about) BETWEEN 3 AND 59 AND NOT regexp_matches(about, '(?i)\\b(?:IS\\s+\\d+|clause|section|standard)\\b') THEN about END) AS category,
    list_filter(cust, lambda v: v IS NOT NULL AND NOT list_contains({list(K.NO_PLACES)!r}, lower(v)))[1] AS customer, list_concat(['Hallmark'], list_filter(marks, lambda m: m <> 'Hallmark')) AS certifications FROM z""")
def _(t):
    P, Z = _columns()
    none = F.lit(None).cast("string")
    fields = ["activity", "type", "size", "location", "category", "customer", "certifications"]
    profile = F.struct(none.alias("activity"), F.lit("manufacturer").alias("type"), F.when(Z % 2 == 0, "Startup").alias("size"), none.alias("location"), none.alias("category"), none.alias("customer"), F.array(F.lit("Hallmark")).alias("certifications"))
    c = X.let(K.business_context(_said(_ASKERS, P)), lambda q: K.merged(q, profile, fields, ("certifications",)))
    return t("part").select("p_partkey", c.alias("c")).select("p_partkey", "c.*")


@query("x26_query_variants", """
    WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_name END AS n, CASE WHEN p_size % 3 = 0 THEN '' WHEN p_size % 3 = 1 THEN lower(p_type) ELSE p_name END AS c, CASE WHEN p_size % 2 = 0 THEN 'solar' END AS tech,
        CASE WHEN p_partkey % 3 = 0 THEN 'steel' END AS m, CASE WHEN p_partkey % 7 = 0 THEN 'domestic' END AS u, CASE WHEN p_partkey % 4 = 0 THEN ['IS 5', 'is 5', 'IS 6'] ELSE [] END AS s, p_size, lower(p_type) AS t FROM part),
    x AS (SELECT *, coalesce(n, nullif(c, '')) AS pr, coalesce(nullif(c, ''), n) AS w FROM p),
    y AS (SELECT *, list_filter(list_concat([pr, pr || ' requirements', pr || ' standard', tech || ' ' || w, m || ' ' || w, u || ' ' || w, tech || ' ' || m || ' ' || w], s), lambda v: v IS NOT NULL) AS a FROM x),
    z AS (SELECT *, list_slice(list_filter(a, lambda v, i: list_position(list_transform(a, lambda q: lower(q)), lower(v)) = i), 1, 6) AS q FROM y)
    SELECT p_partkey, CASE WHEN len(q) > 0 THEN q ELSE ['pump of ' || p_size] END AS product,
      CASE p_partkey % 4 WHEN 0 THEN list_concat(['what is IS 5'], CASE WHEN w IS NULL THEN [] ELSE ['Indian Standard specification ' || w, 'Quality Control Order ' || w] END) WHEN 1 THEN list_concat(['what is IS 5'], CASE WHEN w IS NULL THEN [] ELSE ['IS 5 scope ' || w, 'IS 5 clause 1 scope'] END)
        WHEN 2 THEN CASE WHEN p_size % 2 = 0 THEN ['is 5 CLAUSE 4.1', 'IS 5 section 4.1'] ELSE ['is 5 CLAUSE 4.1', 'IS 5 clause 7', 'IS 5 section 7'] END ELSE ['what is IS 5'] END AS variants FROM z""")
def _(t):
    P, Z = _columns()
    P, Z = P.cast("long"), Z.cast("int")
    name = F.when(P % 5 != 0, F.col("p_name"))
    category = F.when(Z % 3 == 0, "").when(Z % 3 == 1, F.lower("p_type")).otherwise(F.col("p_name"))
    standards = F.when(P % 4 == 0, F.array(F.lit("IS 5"), F.lit("is 5"), F.lit("IS 6")))
    product = E.product_queries(name, category, F.when(Z % 2 == 0, "solar"), F.when(P % 3 == 0, "steel"), F.when(P % 7 == 0, "domestic"), standards, F.concat(F.lit("pumps of "), Z.cast("string")))
    intent = F.element_at(F.array(*[F.lit(x) for x in ("STANDARD_DISCOVERY", "APPLICABILITY_QUERY", "CLAUSE_LOOKUP", "OTHER")]), (1 + P % 4).cast("int"))
    known = F.coalesce(F.nullif(category, F.lit("")), name)
    asked = E.query_variants(F.when(P % 4 == 2, "is 5 CLAUSE 4.1").otherwise("what is IS 5"), intent, F.lit("IS 5"), F.when(Z % 2 == 0, "4.1").otherwise("7"), known)
    return t("part").select("p_partkey", product.alias("product"), asked.alias("variants"))


@query("x29_requirements", """
    SELECT p_partkey, 'Thickness' AS name, CASE p_size % 3 WHEN 0 THEN CAST(p_size AS DOUBLE) WHEN 2 THEN CAST(p_size AS DOUBLE) END AS value, CASE p_size % 3 WHEN 1 THEN CAST(p_size AS DOUBLE) WHEN 2 THEN p_size - 0.5::DOUBLE END AS lower,
      CASE p_size % 3 WHEN 0 THEN CAST(p_size AS DOUBLE) WHEN 1 THEN p_size + 2::DOUBLE ELSE p_size + 0.5::DOUBLE END AS upper, CASE p_size % 3 WHEN 0 THEN 'LE' WHEN 1 THEN 'RANGE' ELSE 'EQ' END AS op, 'mm' AS unit FROM part
    UNION ALL SELECT p_partkey, 'Pressure', 5.5::DOUBLE, 5.5::DOUBLE, NULL, 'GE', 'bar' FROM part UNION ALL SELECT p_partkey, 'mass', p_size + 0.25::DOUBLE, p_size + 0.25::DOUBLE, NULL, 'GE', 'kg' FROM part""")
def _(t):
    P, Z = _columns()
    limit = F.when(Z % 3 == 0, F.concat(F.lit("shall not exceed "), Z, F.lit(" mm"))).when(Z % 3 == 1, F.concat(F.lit("shall be between "), Z, F.lit(" and "), Z + 2, F.lit(" mm"))).otherwise(F.concat(F.lit("shall be "), Z, F.lit(" ± 0.5 mm")))
    text = F.concat(F.lit("Thickness "), limit, F.lit(";\nno number here. Pressure shall not be less than 5.5 bar\nmass > "), Z, F.lit(".25kg"))
    return E.requirements(spread(t("part")).withColumn("text", text), "p_partkey", "text").select("p_partkey", "name", "p.value", "p.lower", "p.upper", "p.op", "p.unit")


@query("x29_specification", """
    WITH p AS (SELECT p_partkey, p_size AS z, p_size % 3 AS k FROM part)
    SELECT p_partkey, 'Capacity' AS name, z + 1.0::DOUBLE AS value, NULL AS lower, NULL AS upper, NULL AS text, 'L' AS unit FROM p UNION ALL SELECT p_partkey, 'thickness', 2.5, 2.4, 2.6, NULL, 'mm' FROM p UNION ALL SELECT p_partkey, 'heat resistance', NULL, NULL, NULL, CASE k WHEN 0 THEN 'high' ELSE 'low' END, NULL FROM p
    UNION ALL SELECT p_partkey, CASE k WHEN 1 THEN 'working pressure' ELSE 'working pressure >' END, z, CASE k WHEN 1 THEN z END, NULL, NULL, 'bar' FROM p WHERE k > 0 UNION ALL SELECT p_partkey, 'calibrated range', NULL, z, z + 10, NULL, 'V' FROM p UNION ALL SELECT p_partkey, 'mass', z + 0.5, NULL, NULL, NULL, 'kg' FROM p WHERE k = 2""")
def _(t):
    P, Z = _columns()
    text = F.concat(
        F.lit("Capacity: "), Z, F.lit(" L, thickness = 2.5 ± 0.1 mm;heat resistance: "), F.when(Z % 3 == 0, "high").otherwise("low"), F.lit("\n"), F.when(Z % 3 > 0, F.concat(F.when(Z % 3 == 1, "working pressure > ").otherwise("working pressure >= "), Z, F.lit(" bar"))).otherwise("nothing here"),
        F.lit("\r\ncalibrated range: between "), Z, F.lit(" and "), Z + 10, F.lit(" V, Capacity: "), Z + 1, F.lit(" L"), F.when(Z % 3 == 2, F.concat(F.lit("; mass:"), Z, F.lit(".5 kg, : x"))).otherwise(""),
    )
    return E.specification(spread(t("part")).withColumn("text", text), "p_partkey", "text").select("p_partkey", "name", "p.value", "p.lower", "p.upper", "p.text", "p.unit")


_TENDER = [
    "1) Supply voltage shall be 230 V", "the width must not be more than 5 mm", "a) Capacity shall be at least 500 L", "A test certificate is compulsory", "colour", "Warranty: 12 months", "Working temperature between 5 and 40 °C", "Report on torque", "rated POWER <= 3 kW", "BIS certification as per IS 12701", "Grade shall be as agreed", "abc",
    "- Pressure shall not exceed 10.5 bar", "tensile inspection of IS 5-2 goods", "Noise level maximum 60 dB",
]
_CATEGORY = " ".join(f"WHEN regexp_matches(d, '(?i)\\b(?:{p})\\b') THEN '{name}'" for name, p in E.TENDER_CATEGORIES)


@query("x31_tender_category", f"""
    WITH x AS (SELECT p_partkey, {_sql_said(_TENDER)} AS d FROM part)
    SELECT p_partkey, CASE {_CATEGORY} ELSE 'general' END AS category, nullif(lower(regexp_extract(d, '(?i)\\b({E.MANDATORY})\\b', 1)), '') AS mandatory FROM x""")
def _(t):
    P, Z = _columns()
    clause = _said(_TENDER, P)
    return t("part").select("p_partkey", E.tender_category(clause).alias("category"), E.mandatory_word(clause).alias("mandatory"))


@query("x31_tender_requirements", """
    SELECT p_partkey, 0 AS pos, 'Supply voltage' AS name, 'performance' AS category, 'shall' AS mandatory, 'EQ' AS op, CAST(CAST(200 + p_size AS DOUBLE) AS VARCHAR) AS value, 'V' AS unit, NULL::DOUBLE AS lower, NULL::DOUBLE AS upper FROM part
    UNION ALL SELECT p_partkey, 1, 'Capacity', 'capacity', 'shall', 'GE', CAST(CAST(p_size AS DOUBLE) AS VARCHAR), 'L', p_size, NULL FROM part
    UNION ALL SELECT p_partkey, 3, 'Conformance,', 'certification', NULL, 'EQ', CAST(CAST(p_partkey AS DOUBLE) AS VARCHAR), NULL, NULL, NULL FROM part WHERE p_size % 2 = 0
    UNION ALL SELECT p_partkey, 3, 'Length', 'dimension', 'must', 'RANGE', NULL, 'mm', p_size, p_size + 5 FROM part WHERE p_size % 2 = 1
    UNION ALL SELECT p_partkey, 4, 'Noise maximum', 'general', NULL, 'LE', CAST(CAST(p_size AS DOUBLE) AS VARCHAR), 'dB', NULL, p_size FROM part WHERE p_size % 2 = 1""")
def _(t):
    P, Z = _columns()
    text = F.concat(F.lit("1) Supply voltage shall be "), 200 + Z, F.lit(" V;Capacity shall be at least "), Z, F.lit(" L\nabc;"), F.when(Z % 2 == 0, F.concat(F.lit("Conformance, IS "), P)).otherwise(F.concat(F.lit("Length must be between "), Z, F.lit(" and "), Z + 5, F.lit(" mm"))), F.lit(". Noise maximum <= "), Z, F.lit(" dB"))
    rows = E.tender_requirements(spread(t("part")).withColumn("text", text), "p_partkey", "text")
    return rows.select("p_partkey", "pos", "r.name", "r.category", "r.mandatory", "r.op", "r.value", "r.unit", "r.lower", "r.upper")


@query("x33_evidence_fields", """
    SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'AB/X-1/' || (10000 + o_orderkey) ELSE 'TR/' || o_orderkey END AS number, CASE WHEN o_orderkey % 2 = 0 THEN 'NABL Accredited lab no 7' END AS accreditation, CASE WHEN o_orderkey % 5 <> 0 THEN 'National Laboratory of ' || o_orderpriority END AS issuer,
    ['IS 129 PART 2 : 1999', 'IS ' || o_custkey] AS standards, CAST(o_orderdate AS DATE) AS issued, CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderdate AS DATE) + 400 END AS expires, CASE WHEN o_orderkey % 4 = 0 AND CAST(o_orderdate AS DATE) + 400 < DATE '1996-01-01' THEN 'EXPIRED' ELSE 'ACTIVE' END AS status FROM orders""")
def _(t):
    k = F.col("o_orderkey")
    one = lambda cond, *parts: F.when(cond, F.concat(*parts)).otherwise("")
    text = F.concat(
        F.lit("Paper\n"), one(k % 5 != 0, F.lit(" National Laboratory of "), "o_orderpriority"), F.lit("\n"), F.when(k % 3 == 0, F.concat(F.lit("see AB/X-1/"), k + 10000)).otherwise(F.concat(F.lit("Test Report No: TR/"), k)),
        F.lit("\nIS 129 Part 2 : 1999 and is  "), "o_custkey", F.lit(" and IS 129  Part 2 : 1999\n"), one(k % 2 == 0, F.lit("by NABL Accredited lab no 7. More")), F.lit("\n"),
        F.when(k % 6 < 3, F.concat(F.lit("Date of Issue: "), F.date_format("o_orderdate", "dd/MM/yyyy"))).otherwise(F.concat(F.lit("made "), F.date_format("o_orderdate", "d MMMM yyyy"))), F.lit("\n"),
        one(k % 4 == 0, F.lit("Valid until: "), F.date_format(F.date_add("o_orderdate", 400), "yyyy-MM-dd")),
    )
    return t("orders").select("o_orderkey", E.evidence_fields(text, F.lit("1996-01-01").cast("date")).alias("e")).select("o_orderkey", "e.*")


@query("x33_test_rows", """
    SELECT o_orderkey, 1 AS pos, 'Wall thickness' AS parameter, (o_orderkey % 90) || '.5 mm' AS observed, CASE WHEN o_orderkey % 2 = 0 THEN '> 2 mm' END AS specified, CASE o_orderkey % 3 WHEN 0 THEN 'PASS' WHEN 1 THEN 'FAIL' ELSE 'COMPLIES' END AS verdict FROM orders
    UNION ALL SELECT o_orderkey, 3, 'Finish', NULL, NULL, 'SATISFACTORY' FROM orders""")
def _(t):
    k = F.col("o_orderkey")
    row = F.concat(F.lit("Wall thickness: "), k % 90, F.lit(".5 mm | "), F.when(k % 2 == 0, "specified > 2 mm; ").otherwise(""), F.when(k % 3 == 0, "pass").when(k % 3 == 1, "Fail").otherwise("complies"))
    text = F.concat(F.lit("Results\n"), row, F.lit("\nno pass\n  Finish: satisfactory\nLength: 5 mm"))
    return E.verdict_rows(t("orders").withColumn("text", text), "o_orderkey", "text")


@query("x41_citation", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '' ELSE 'reference to ' END || 'IS ' || p_partkey || ' : 2001' || CASE WHEN p_size % 3 = 0 THEN ', Clause 4.1' ELSE '' END || ', Page ' || p_size AS cite FROM part")
def _(t):
    P, Z = _columns()
    return t("part").select("p_partkey", E.citation(F.concat(F.lit("IS "), P), F.lit(2001), F.when(Z % 3 == 0, "4.1"), Z, Z % 2 == 0).alias("cite"))


@query("x43_temporal_statements", """
    SELECT p_partkey, 'SUPERSEDES' AS relation, 'IS ' || p_size AS target, substring(sha256(p_partkey || '::SUPERSEDES::is ' || p_size), 1, 16) AS statement_id FROM part
    UNION ALL SELECT p_partkey, 'EFFECTIVE', '2001', substring(sha256(p_partkey || '::EFFECTIVE::2001'), 1, 16) FROM part WHERE p_size % 2 = 0""")
def _(t):
    P, Z = _columns()
    text = F.concat(F.lit("This supersedes IS "), Z, F.lit(". "), F.when(Z % 2 == 0, "It is effective from 2001.").otherwise(""))
    return E.temporal_statements(t("part").withColumn("text", text), "p_partkey", "text")


@query("x44_translation_check", """
    WITH x AS (SELECT p_partkey, p_size, p_partkey + 1000 AS a, p_partkey + 1000 + CASE WHEN p_size % 4 = 0 THEN 1 ELSE 0 END AS a2, 10 + p_size AS z, 10 + p_size + CASE WHEN p_size % 3 = 0 THEN 100 ELSE 0 END AS z2, 1 + p_partkey % 3 AS c, 1 + p_size % 3 AS c2, p_size % 5 = 0 AS latin FROM part),
    y AS (SELECT *, CASE WHEN latin THEN 'needs under' ELSE 'पंप के लिए दबाव आवश्यक है मानक' END || ' IS ' || a2 || ' ' || z2 || ' bar' AS body FROM x),
    i AS (SELECT *, list_filter([CASE WHEN latin THEN 'insufficient_devanagari_script' END, CASE WHEN c <> c2 THEN 'hallucinated_citation_tokens:EV' || c2 END, CASE WHEN a <> a2 THEN 'missing_standard_numbers:IS ' || a END,
      CASE WHEN z <> z2 AND z <> a2 THEN 'missing_numerical_values:' || z END], lambda v: v IS NOT NULL) AS found FROM y)
    SELECT p_partkey, list_filter(found, lambda v: NOT starts_with(v, 'hallucinated') OR true) AS issues, len(found) = 0 AS valid,
    '**Head**' || chr(10) || chr(10) || body || CASE WHEN c = c2 THEN ' [EV' || c2 || ']' ELSE ' [EV' || c2 || ']' || chr(10) || chr(10) || 'Sources: [EV' || c || ']' END AS text FROM i""")
def _(t):
    P, Z = _columns()
    a, z, c, c2 = P + 1000, Z + 10, 1 + P % 3, 1 + Z % 3
    source = F.concat(F.lit("**Head**\nIS "), a, F.lit(" needs "), z, F.lit(" bar [EV"), c, F.lit("]"))
    body = F.when(Z % 5 == 0, "needs under").otherwise("पंप के लिए दबाव आवश्यक है मानक")
    other = F.concat(body, F.lit(" IS "), a + F.when(Z % 4 == 0, 1).otherwise(0), F.lit(" "), z + F.when(Z % 3 == 0, 100).otherwise(0), F.lit(" bar [EV"), c2, F.lit("]"))
    return t("part").select("p_partkey", E.translation_check(source, other, F.lit(False)).alias("r")).select("p_partkey", "r.issues", "r.valid", "r.text")


@query("x49_reply_check", "SELECT l_orderkey, CASE WHEN count(*) > 4 THEN ['missing'] ELSE [] END AS problems FROM lineitem GROUP BY 1")
def _(t):
    g = t("lineitem").groupBy("l_orderkey").agg(F.count("*").cast("int").alias("n"))
    expected = F.sequence(F.lit(1), F.col("n"))
    ids = F.sequence(F.lit(1), F.least(F.col("n"), F.lit(4)))
    return g.select("l_orderkey", E.decisions_problems(ids, expected, F.array(F.lit(2))).alias("problems"))


@query("a15_typed_counts", "SELECT count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'click') AS clicks, count(*) AS total FROM events")
def _(t):
    k = F.col("event_type")
    return t("events").agg(F.count_if(k == "view").alias("views"), F.count_if(k == "click").alias("clicks"), F.count("*").alias("total"))


@query("a29_diagnostics", "SELECT count(*) AS lines, count(DISTINCT l_orderkey) AS orders, count(*) FILTER (l_partkey % 10 = 3) AS unresolved FROM lineitem")
def _(t):
    return t("lineitem").agg(F.count("*").alias("lines"), F.count_distinct("l_orderkey").alias("orders"), F.count_if(F.col("l_partkey") % 10 == 3).alias("unresolved"))


@query("d02_qco_applicability", f"""
    WITH x AS (SELECT p_partkey, lower(trim(CASE WHEN p_size % 8 <> 0 THEN p_name ELSE ' ' END)) AS p, CASE WHEN p_size % 5 <> 0 THEN 'Order for ' || string_split(p_name, ' ')[2] || 's' END AS title,
      CASE p_size % 4 WHEN 0 THEN 'This order excludes ' || p_name || ' of brass.' WHEN 1 THEN 'not applicable to toys' WHEN 2 THEN '' END AS ev FROM part),
    y AS (SELECT *, lower(coalesce(title, '')) || ' ' || lower(coalesce(ev, '')) AS text FROM x)
    SELECT p_partkey, CASE WHEN p = '' THEN 'UNKNOWN' WHEN title IS NULL AND coalesce(ev, '') = '' THEN 'UNKNOWN' WHEN contains(regexp_extract(text, 'excludes ([^.;]+)', 1), p) THEN 'NO_MATCH'
      WHEN len(list_filter(regexp_extract_all(p, '\\b[a-z]{{3,}}\\b'), lambda w: w NOT IN {tuple(D.ORDER_STOP)} AND contains(text, w))) > 0 THEN 'MATCH' ELSE 'UNKNOWN' END AS state FROM y""")
def _(t):
    P, Z = _columns()
    title = F.when(Z % 5 != 0, F.concat(F.lit("Order for "), F.element_at(F.split("p_name", " "), 2), F.lit("s")))
    evidence = F.when(Z % 4 == 0, F.concat(F.lit("This order excludes "), "p_name", F.lit(" of brass."))).when(Z % 4 == 1, "not applicable to toys").when(Z % 4 == 2, "")
    return t("part").select("p_partkey", D.qco_applicability(F.when(Z % 8 != 0, F.col("p_name")).otherwise(" "), title, evidence).alias("state"))


@query("d06_extractive_answer", """
    WITH u AS (SELECT conv_id, text, min(turn) AS turn, arg_min(role, turn) AS role FROM conversations GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM u QUALIFY i <= 4),
    l AS (SELECT *, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM r),
    p AS (SELECT conv_id, i, '#### ' || i || '. ' || CASE WHEN role = 'user' THEN 'Requirement Section ' || i ELSE role END || ' [EV' || i || ']' || chr(10) || chr(10) || array_to_string(ls[1:2], chr(10)) || CASE WHEN len(ls) > 2 THEN chr(10) || '*(additional requirements in source document)*' ELSE '' END AS part,
      coalesce(substring(ls[1], 1, 50), CASE WHEN role = 'user' THEN 'Requirement Section ' || i ELSE role END) AS claim FROM l)
    SELECT conv_id, string_agg(part, chr(10) || chr(10) ORDER BY i) || chr(10) || chr(10) || 'Sources: ' || string_agg('[EV' || i || ']', ', ' ORDER BY i) AS answer, list(claim ORDER BY i) AS claims FROM p GROUP BY 1""")
def _(t):
    head = F.when(F.col("role") != "user", F.col("role"))
    a = R.extractive_answer(t("conversations"), "conv_id", [F.col("turn")], head, "text", lines=2, chars=50)
    return a.select("conv_id", "answer", F.transform("claims", lambda c: c["text"]).alias("claims"))


@query("d07_final_decision", """
    WITH x AS (SELECT event_id, ['ANSWER', 'QUALIFIED_ANSWER', 'VERIFICATION_REQUIRED'][1 + event_id % 3] AS d, ['ANSWERABLE', 'INSUFFICIENT_EVIDENCE', 'CONFLICTING_EVIDENCE', 'AMBIGUOUS_QUERY', 'ANSWERABLE', 'ANSWERABLE'][1 + event_id % 6] AS s, ['HIGH', 'MEDIUM', 'LOW', 'HIGH', 'HIGH'][1 + event_id % 5] AS l,
      ['GROUNDED', 'PARTIALLY_GROUNDED', 'UNVERIFIABLE', 'UNSUPPORTED', 'GROUNDED', 'GROUNDED', 'GROUNDED'][1 + event_id % 7] AS g, user_id % 4 = 0 AS cur, user_id % 3 = 0 AS uns, user_id % 5 = 0 AS sch, user_id % 7 = 0 AS need, user_id % 2 = 0 AS cand FROM events),
    y AS (SELECT *, g = 'UNSUPPORTED' OR (cur AND uns) OR ((s = 'INSUFFICIENT_EVIDENCE' OR l = 'LOW') AND NOT sch) OR (need AND NOT cand) AS forced FROM x),
    z AS (SELECT *, CASE WHEN forced THEN 'VERIFICATION_REQUIRED' WHEN g IN ('PARTIALLY_GROUNDED', 'UNVERIFIABLE') AND d = 'ANSWER' THEN 'QUALIFIED_ANSWER' ELSE d END AS f, forced OR d = 'VERIFICATION_REQUIRED' OR s <> 'ANSWERABLE' AS verify FROM y)
    SELECT event_id, CASE WHEN verify AND f = 'ANSWER' THEN 'VERIFICATION_REQUIRED' ELSE f END AS decision, verify, CASE WHEN verify AND s = 'ANSWERABLE' THEN 'INSUFFICIENT_EVIDENCE' ELSE s END AS state FROM z""")
def _(t):
    i, u = F.col("event_id"), F.col("user_id")
    of = lambda words: F.element_at(F.array(*[F.lit(w) for w in words]), (1 + i % len(words)).cast("int"))
    d, s = of(["ANSWER", "QUALIFIED_ANSWER", "VERIFICATION_REQUIRED"]), of(["ANSWERABLE", "INSUFFICIENT_EVIDENCE", "CONFLICTING_EVIDENCE", "AMBIGUOUS_QUERY", "ANSWERABLE", "ANSWERABLE"])
    level, g = of(["HIGH", "MEDIUM", "LOW", "HIGH", "HIGH"]), of(["GROUNDED", "PARTIALLY_GROUNDED", "UNVERIFIABLE", "UNSUPPORTED", "GROUNDED", "GROUNDED", "GROUNDED"])
    out = E.final_decision(d, s, level, g, u % 4 == 0, u % 3 == 0, u % 5 == 0, u % 7 == 0, u % 2 == 0)
    return t("events").select("event_id", out.alias("r")).select("event_id", "r.*")


@query("r10_discovery")
def _(t):
    docs = t("documents").select("doc_id", "text", F.concat(F.lit("IS "), F.col("doc_id") % 40).alias("standard"), (F.col("doc_id") % 7).cast("string").alias("clause"))
    titles = t("benchmark").select(F.concat(F.lit("IS "), F.col("item_id")).alias("standard"), F.col("text").alias("title"))
    products = t("benchmark").select("item_id", F.regexp_replace("text", r"\s+", " ").alias("name")).withColumn("facts", F.slice(F.split("name", " "), 1, 3))
    vectors = t("embeddings").select("vec_id", "embedding")
    rows = vectors.join(t("documents").select("doc_id"), F.col("vec_id") == F.col("doc_id")).select("doc_id", "embedding")
    asked = t("benchmark").select("item_id").join(vectors, F.col("item_id") == F.col("vec_id")).select("item_id", "embedding")
    dense = R.knn(rows, "doc_id", "embedding", asked, "item_id", "embedding", 10)
    known = t("benchmark").select("item_id", F.concat(F.lit("IS "), (F.col("item_id") + 1) % 40).alias("standard"))
    index = P.stored(t("documents"), "doc_id", "text", shared_dir(docs.sparkSession))
    best = lambda asked, q_key, text, pool: P.search(index, asked, q_key, text, pool).withColumnRenamed("key", "doc_id")
    return D.discover(products, "item_id", "name", docs, "doc_id", "text", "standard", "clause", titles, "title", known, k=5, dense=dense, facts="facts", lexical=best)


@query("r10_titles", """
    WITH t AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN p_name || ' - specification' WHEN 1 THEN 'Code for ' || p_name || 's' WHEN 2 THEN string_split(p_name, ' ')[2] || ' and other goods of brass' ELSE p_type END AS title FROM supplier JOIN part ON p_partkey = s_suppkey),
    n AS (SELECT DISTINCT p_name FROM part), w AS (SELECT p_name, lower(p_name) AS p, s_suppkey, lower(title) AS t FROM n, t),
    y AS (SELECT *, list_filter(list_distinct(regexp_extract_all(t, '\\b[a-z]{3,}\\b')), lambda x: x NOT IN ('the', 'and', 'for', 'with')) AS a, list_filter(list_distinct(regexp_extract_all(p, '\\b[a-z]{3,}\\b')), lambda x: x NOT IN ('the', 'and', 'for', 'with')) AS b FROM w),
    z AS (SELECT *, CASE WHEN least(len(a), len(b)) = 0 THEN 0 ELSE len(list_intersect(a, b)) / least(len(a), len(b)) END AS o FROM y)
    SELECT p_name, s_suppkey, CAST(CASE WHEN starts_with(t, p) THEN 1.0 WHEN contains(t, p) THEN 0.9 WHEN o >= 0.66 THEN 0.85 WHEN o >= 0.33 THEN 0.5 ELSE 0.0 END AS DOUBLE) AS score FROM z WHERE starts_with(t, p) OR contains(t, p) OR o >= 0.33""")
def _(t):
    """Names of all parts against titles: by containment, plurals among them, and by shared words."""
    p, k = t("part"), F.col("s_suppkey") % 4
    named = t("supplier").join(p, F.col("s_suppkey") == F.col("p_partkey"))
    title = F.when(k == 0, F.concat("p_name", F.lit(" - specification"))).when(k == 1, F.concat(F.lit("Code for "), "p_name", F.lit("s"))).when(k == 2, F.concat(F.element_at(F.split("p_name", " "), 2), F.lit(" and other goods of brass"))).otherwise(F.col("p_type"))
    return D.titled(p.select("p_name").distinct().withColumn("name", F.col("p_name")), "p_name", "name", named.select("s_suppkey", title.alias("title")), "s_suppkey", "title")


@query("q04_query_context", """
    SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'CLAUSE_LOOKUP' WHEN 1 THEN 'APPLICABILITY_QUERY' ELSE 'CURRENTNESS_QUERY' END AS intent, CASE p_size % 3 WHEN 0 THEN 'IDENTIFIER_HEAVY' WHEN 1 THEN 'APPLICABILITY_EVALUATION' ELSE 'TEMPORAL_AWARE' END AS strategy,
    CASE p_size % 3 WHEN 0 THEN 'IDENTIFIER_SPECIFIC' WHEN 1 THEN CASE WHEN p_size % 2 = 0 THEN 'NORMAL' ELSE 'MISSING_REQUIRED_CONTEXT' END ELSE 'TEMPORAL' END AS state, CASE WHEN p_size % 3 <> 1 THEN CAST(p_partkey AS VARCHAR) END AS number FROM part""")
def _(t):
    from strataframe.functions.intent import query_context

    P, Z = _columns()
    q = F.when(Z % 3 == 0, F.concat(F.lit("show clause4.1 of is-"), P)).when(Z % 3 == 1, F.concat(F.lit("which rules apply to "), F.when(Z % 2 == 0, "cement ").otherwise(""), F.lit("goods"))).otherwise(F.concat(F.lit("latest IS "), P))
    c = t("part").select("p_partkey", query_context(q).alias("c"))
    return c.select("p_partkey", F.col("c.intent.intent").alias("intent"), "c.strategy", "c.state", F.col("c.entities.number").alias("number"))


@query("w19_document_tree", """
    WITH l AS (SELECT l_orderkey, l_linenumber AS pos, 1 + (l_partkey % 3) AS level FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey) = 1)
    SELECT a.l_orderkey, a.pos, max(b.pos) AS parent FROM l a LEFT JOIN l b ON a.l_orderkey = b.l_orderkey AND b.pos < a.pos AND b.level < a.level GROUP BY 1, 2""")
def _(t):
    lines = R.keep_first(t("lineitem").select("l_orderkey", F.col("l_linenumber").alias("pos"), "l_partkey"), [F.col("l_partkey")], F.col("l_orderkey"), F.col("pos"))
    return C.parents(lines.withColumn("level", (1 + F.col("l_partkey") % 3).cast("int")), "l_orderkey", "pos", "level", 3).select("l_orderkey", "pos", "parent")


@query("s14_api_rows", "SELECT event_id, json_extract_string(props, '$.k') AS page, event_type AS kind FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def _(t):
    page = F.get_json_object("props", "$.k")
    return t("events").filter(page.isNotNull()).select("event_id", page.alias("page"), F.col("event_type").alias("kind"))


@query("s13_page_links", "SELECT page_id, len(regexp_extract_all(html, '(?i)href\\s*=\\s*[\"'']([^\"'']+)[\"'']', 1)) AS n FROM pages")
def _(t):
    return t("pages").select("page_id", F.size(html.links(F.col("html"))).cast("long").alias("n"))


_MD = """m AS (SELECT doc_id, pos, CASE WHEN pos % 5 = 0 THEN '## ' || line WHEN pos % 5 IN (2, 3) THEN '| a | ' || pos || ' |' ELSE lower(line) END AS line
    FROM (SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INT) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE trim(line) <> ''),
    k AS (SELECT *, CASE WHEN pos % 5 = 0 THEN 'heading' WHEN pos % 5 IN (2, 3) THEN 'table' ELSE 'paragraph' END AS kind FROM m),
    b AS (SELECT *, sum(CASE WHEN kind = 'heading' OR kind IS DISTINCT FROM prev THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS block FROM (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM k))"""


def _markdown(t):
    raw = C.lines(t("documents"), "doc_id", "text").filter("trim(line) <> ''")
    k = F.col("pos") % 5
    return raw.select("doc_id", "pos", F.when(k == 0, F.concat(F.lit("## "), "line")).when(k.isin(2, 3), F.concat(F.lit("| a | "), "pos", F.lit(" |"))).otherwise(F.lower("line")).alias("line"))


@query("x48_blocks", f"WITH {_MD} SELECT doc_id, CAST(block AS BIGINT) AS block, kind, string_agg(line, chr(10) ORDER BY pos) AS text FROM b GROUP BY ALL")
def _(t):
    return C.blocks(_markdown(t), "doc_id", fallback=False).select("doc_id", "block", "kind", "text")


@query("x48_render", f"WITH {_MD}, x AS (SELECT doc_id, block, kind, string_agg(line, chr(10) ORDER BY pos) AS text FROM b GROUP BY ALL) SELECT doc_id, string_agg(CASE WHEN kind = 'heading' THEN '## ' || trim(regexp_replace(text, '^## ', '')) ELSE text END, chr(10) || chr(10) ORDER BY block) AS markdown FROM x GROUP BY 1")
def _(t):
    return C.render(C.blocks(_markdown(t), "doc_id", fallback=False), "doc_id")


@query("x48_semantics", f"""
    WITH {_MD}, x AS (SELECT doc_id, CAST(block AS BIGINT) AS block, kind, string_agg(line, chr(10) ORDER BY pos) AS text FROM b GROUP BY ALL),
    d AS (SELECT *, CASE WHEN doc_id % 3 = 0 AND block % 4 = 1 THEN CASE WHEN block % 8 = 1 THEN 'heading' ELSE 'content' END END AS said FROM x),
    g AS (SELECT *, kind = 'paragraph' AND NOT contains(text, chr(10)) AND trim(text) <> '' AND len(trim(text)) <= 180 AND regexp_matches(trim(text), '^((?i:annex|appendix|foreword|introduction|scope))\\b|^\\d+(\\.\\d+)*[.)]?\\s+\\S') AS guess FROM d)
    SELECT doc_id, block, CASE WHEN kind = 'table' THEN 'content' WHEN said IS NOT NULL THEN said WHEN kind = 'heading' OR guess THEN 'heading' ELSE 'content' END AS semantic_type,
    CASE WHEN said IS NOT NULL THEN 0.8 WHEN guess THEN 0.6 ELSE 1.0 END AS semantic_confidence, CASE WHEN said IS NOT NULL THEN 'model' ELSE 'rules' END AS semantic_source FROM g""")
def _(t):
    b = C.blocks(_markdown(t), "doc_id", fallback=False)
    said = b.filter("doc_id % 3 = 0 AND block % 4 = 1").select("doc_id", "block", F.when(F.col("block") % 8 == 1, "heading").otherwise("content").alias("semantic_type"), F.lit(2).alias("level"), F.lit(0.8).alias("confidence"))
    return C.with_semantics(b, "doc_id", said).select("doc_id", "block", "semantic_type", "semantic_confidence", "semantic_source")


@query("x48_metadata", """
    SELECT p_partkey, 'IS ' || p_partkey || ' (Part 2) : ' || (1990 + p_size % 20) AS standard_number, p_name || ' of quality' AS document_title FROM part""")
def _(t):
    P, Z = _columns()
    body = F.concat(F.lit("# Annex A of it\n\n# short\n\n## "), "p_name", F.lit("  of quality\n\n| IS 1 : 1999 |\n\nsee IS "), P, F.lit(" (Part 2) : "), 1990 + Z % 20, F.lit(" and IS 5 : 2001"))
    lines = C.lines(t("part").withColumn("body", body), "p_partkey", "body")
    return C.block_metadata(C.with_semantics(C.blocks(lines, "p_partkey", fallback=False), "p_partkey"), "p_partkey")


@query("a30_preservation", "SELECT 'missing' AS issue, o_orderkey AS entity_id FROM orders WHERE o_orderkey % 100 = 0 UNION ALL SELECT 'repeated', o_orderkey FROM orders WHERE o_orderkey % 100 = 7")
def _(t):
    o = t("orders").select("o_orderkey")
    return C.preservation(o, o.filter("o_orderkey % 100 <> 0").unionAll(o.filter("o_orderkey % 100 = 7")), "o_orderkey")


_WANTS = [
    ("find accredited labs for cement pipes under IS 458", "LABORATORY_SEARCH", "cement pipes", None, ["IS 458"], "India", "testing_laboratory"), ("which scheme applies to overseas makers.", "SCHEME_GUIDANCE", None, None, [], "Foreign Manufacturer", "certification"),
    ("testing requirements for a kettle used for boiling water with 230 V and 1500 W", "TESTING_REQUIREMENT", "kettle used", "boiling water with", [], "India", "testing_requirement"), ("IS 5 and IS 7-2", "STANDARD_LOOKUP", None, None, ["IS 5", "IS 7-2"], "India", "standard"), ("hm", "AMBIGUOUS_QUERY", None, None, [], "India", None),
]


@query("x45_structured_intent", f"""
    WITH w AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{w[1]}', '{w[5]}', {'NULL' if w[6] is None else repr(w[6])}, {w[4]!r}::VARCHAR[])" for i, w in enumerate(_WANTS))}) v(i, intent, jurisdiction, service, standards))
    SELECT p_partkey, intent, jurisdiction, service, list_concat(standards, CASE WHEN p_size % 2 = 0 THEN ['IS ' || (p_partkey + 10000)] ELSE [] END) AS standards FROM part JOIN w ON i = p_partkey % {len(_WANTS)} WHERE i < 4 OR p_size % 2 = 1""")
def _(t):
    P, Z = _columns()
    q = F.concat(_said([w[0] for w in _WANTS], P), F.when(Z % 2 == 0, F.concat(F.lit(" and IS "), P + 10000)).otherwise(""))
    rows = spread(t("part")).filter((P % len(_WANTS) < 4) | (Z % 2 == 1)).select("p_partkey", K.structured_intent(q).alias("i"))
    return rows.select("p_partkey", "i.intent", "i.jurisdiction", "i.service", "i.standards")


@query("r02_hashed_embedding")
def _(t):
    return t("benchmark").select("item_id", R.hashed_embedding(F.col("text")).alias("embedding"))


@query("x19_cache_key", """SELECT p_partkey, substring(sha256('{"k0":"' || p_name || '","k1":' || p_size || CASE WHEN p_size % 2 = 0 THEN ',"k2":"' || p_brand || '"' ELSE '' END || '}'), 1, 32) AS key FROM part""")
def _(t):
    P, Z = _columns()
    return t("part").select("p_partkey", E.cache_key(F.col("p_name"), Z, F.when(Z % 2 == 0, F.col("p_brand"))).alias("key"))


@query("d04_checklist_steps", "SELECT p_partkey, count(*) AS steps FROM part, range(CASE WHEN p_size % 3 = 0 THEN 4 ELSE 5 END) GROUP BY 1")
def _(t):
    P, Z = _columns()
    name = F.when(Z % 3 == 0, "SCHEME-IV").when(Z % 3 == 1, "SCHEME-X").otherwise("SCHEME-I-VOLUNTARY")
    return D.checklist(t("part"), "p_partkey", name, F.array(F.lit("Lab A"))).groupBy("p_partkey").agg(F.count("*").alias("steps"))


@query("w03_nine_keys", """
    SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_partkey % 2 = 0 THEN 2 ELSE -3 END DESC, CASE WHEN l_suppkey % 5 = 0 THEN -3 WHEN l_suppkey % 3 = 0 THEN 2 ELSE 1 END DESC,
    CASE WHEN l_partkey % 7 = 0 THEN 1 WHEN l_returnflag = 'R' THEN 2 ELSE -1 END DESC, CASE l_linenumber % 4 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE 0 END DESC, CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END DESC,
    CASE WHEN l_tax > 0.04 THEN 1 ELSE 0 END DESC, CASE WHEN l_discount > 0.05 THEN 1 ELSE -1 END DESC, l_quantity DESC, l_extendedprice DESC, l_linenumber, l_partkey) AS rank FROM lineitem""")
def _(t):
    c = F.col
    no = F.lit(None).cast("string")
    k = c("l_linenumber") % 4
    r = {
        "title": F.array(F.when(c("l_partkey") % 2 == 0, "pump").otherwise("valve")), "products": F.array().cast("array<string>"), "opening": F.array().cast("array<string>"),
        "is_lab": c("l_suppkey") % 5 == 0, "is_qco": c("l_suppkey") % 3 == 0, "is_testing": F.lit(False), "standard": F.when(c("l_partkey") % 7 != 0, c("l_returnflag")),
        "clause": F.when(k == 1, "4").when(k == 2, "4.1").when(k == 3, "5"), "amendment": no, "year": c("l_linestatus"), "is_authority": c("l_tax") > 0.04, "is_current": c("l_discount") > 0.05,
        "reranker": c("l_quantity"), "fusion": c("l_extendedprice"),
    }
    q = {"words": F.array(F.lit("pump")), "wants_lab": F.lit(False), "standard": F.lit("R"), "clause": F.lit("4"), "amendment": no, "year": F.lit("O")}
    return R.tiers(t("lineitem"), "l_orderkey", D.ranking_keys(r, q), F.struct("l_linenumber", "l_partkey")).select("l_orderkey", "l_linenumber", "l_partkey", "rank")


@query("r08_scope_share", """
    SELECT p_partkey, round_even(CASE WHEN p_size % 4 = 3 THEN 0.35 / (1 + exp(-(p_size / 10.0 - 2))) ELSE greatest(0, least(0.35, CASE WHEN p_size % 4 = 2 THEN -0.30 WHEN p_size % 4 = 1 THEN 0.15 ELSE 0.0 END
    + CASE WHEN p_size % 2 = 0 THEN 0.15 ELSE 0.0 END + 0.05 + 0.05)) END, 6) AS share FROM part""")
def _(t):
    P, Z = _columns()
    k, no = Z % 4, F.lit(False)
    asked = k != 3
    share = D.scope_share({"standard": asked, "clause": asked, "amendment": no, "year": no}, {"standard": k == 1, "clause": Z % 2 == 0, "amendment": no, "year": no}, k == 2, no, Z / 10.0 - 2)
    return t("part").select("p_partkey", F.bround(share, 6).alias("share"))


@query("x38_claim_issues", """
    WITH x AS (SELECT p_partkey AS p, p_size AS z, p_partkey % 5 AS s, p_size % 4 AS c, p_partkey % 3 AS a, p_size % 5 AS q FROM part),
    y AS (SELECT p, list_concat(list_concat(list_concat(list_concat(list_concat(
        CASE WHEN q = 4 THEN ['fake_or_unknown_citation_id:EV9'] ELSE [] END,
        CASE WHEN z % 6 = 5 THEN ['unsupported_legal_conclusion'] ELSE [] END),
        CASE WHEN s <> 0 AND p % 2 = 1 THEN ['standard_mismatch:claim=IS ' || (1200 + s)] ELSE [] END),
        CASE WHEN ['4.1', '4', '4.1.3', '7'][1 + c] = '7' THEN ['clause_mismatch:claim=Clause 7'] ELSE [] END),
        CASE WHEN a = 1 THEN ['amendment_mismatch:claim=Amendment 2'] ELSE [] END),
        CASE WHEN z % 3 = 0 THEN ['unsupported_numerical_value:' || z || '.5 kg'] ELSE [] END) AS issues FROM x)
    SELECT p AS p_partkey, issues, CASE WHEN len(issues) = 0 THEN 'SUPPORTED' ELSE 'UNSUPPORTED' END AS verdict FROM y""")
def _(t):
    """Standard, clause, amendment, number, phrase and citation vary each by itself."""
    P, Z = _columns()
    of = lambda words, k: F.element_at(F.array(*[F.lit(w) for w in words]), (1 + k).cast("int"))
    s, no = P % 5, F.lit(None).cast("string")
    text = F.concat(
        F.lit("Clause "), of(["4.1", "4", "4.1.3", "7"], Z % 4), F.lit(" of IS "), 1200 + s, F.when(P % 3 > 0, F.concat(F.lit(" with Amendment "), F.when(P % 3 == 1, 2).otherwise(1))).otherwise(""),
        F.lit(" gives pipes of weight "), Z, F.lit(".5 kg"), F.when(Z % 6 == 5, " that are legally invalid").otherwise(""),
    )
    content = F.concat(F.lit("It gives invalid pipes, legally, a weight of "), F.when(Z % 3 == 0, Z + 1).otherwise(Z), F.lit(".5 kg"), F.when(P % 2 == 0, F.concat(F.lit(" under IS "), 1200 + s)).otherwise(""))
    e = F.struct(F.lit("EV1").alias("id"), no.alias("hash"), content.alias("content"), F.lit("IS 1200").alias("number"), F.lit("4.1").alias("clause"), no.alias("edition"), F.lit("1").alias("amendment"), no.alias("year"), F.lit(None).cast("boolean").alias("is_current"), F.array().cast("array<string>").alias("titles"))
    cited = F.when(Z % 5 == 4, F.array(F.lit("EV9"), F.lit("EV1"))).otherwise(F.array(F.lit("EV1")))
    v = G.validated(text, F.lit("FACT"), cited, F.lit(False), F.array(e))
    return spread(t("part")).select("p_partkey", v.alias("v")).select("p_partkey", "v.issues", F.col("v.status").alias("verdict"))
