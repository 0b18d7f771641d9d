"""Text queries. The documents hold no Markdown, so it is rendered from their lines, and alike in the SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataframe.functions import contract as K
from strataframe.functions import grounding as G
from strataframe.functions import text as X
from strataframe.functions import units as U
from strataframe.operators import chunking as C
from strataframe.plans import query

_LINES = """r AS (SELECT doc_id, pos, CASE WHEN pos % 4 = 0 THEN repeat('#', CAST(1 + (doc_id + pos) % 3 AS INT)) || ' ' || line WHEN pos % 7 = 5 THEN '<!-- PAGE ' || pos || ' -->' ELSE line END AS line
    FROM (SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INT) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE trim(line) <> '' OR pos % 4 <> 0)"""


def _rendered(t):
    raw = C.lines(t("documents"), "doc_id", "text").filter("trim(line) <> '' OR pos % 4 <> 0")
    marked = F.when(F.col("pos") % 4 == 0, F.concat(F.repeat(F.lit("#"), (1 + (F.col("doc_id") + F.col("pos")) % 3).cast("int")), F.lit(" "), "line"))
    return raw.select("doc_id", "pos", marked.when(F.col("pos") % 7 == 5, F.concat(F.lit("<!-- PAGE "), "pos", F.lit(" -->"))).otherwise(F.col("line")).alias("line"))


@query("w09_carry_forward", f"WITH {_LINES} SELECT doc_id, pos, last_value(CAST(nullif(regexp_extract(line, '^\\s*<!-- PAGE (\\d+) -->', 1), '') AS INT) IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS page FROM r")
def _(t):
    return C.carry_pages(_rendered(t), "doc_id").select("doc_id", "pos", "page")


@query("w10_islands", f"WITH {_LINES} SELECT doc_id, pos, CAST(sum(CASE WHEN regexp_matches(line, '^ {{0,3}}#{{1,6}}\\s+\\S') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS section FROM r")
def _(t):
    return C.sections(_rendered(t), "doc_id").select("doc_id", "pos", "section")


@query("w08_heading_path", f"""
    WITH {_LINES}, h AS (SELECT doc_id, pos, len(regexp_extract(line, '^ {{0,3}}(#{{1,6}})', 1)) AS level, trim(regexp_replace(line, '^ {{0,3}}#{{1,6}}\\s+', '')) AS title FROM r WHERE regexp_matches(line, '^ {{0,3}}#{{1,6}}\\s+\\S')),
    w AS (SELECT *, last_value(CASE WHEN level = 1 THEN pos END IGNORE NULLS) OVER o AS p1, last_value(CASE WHEN level = 1 THEN title END IGNORE NULLS) OVER o AS t1,
      last_value(CASE WHEN level = 2 THEN pos END IGNORE NULLS) OVER o AS p2, last_value(CASE WHEN level = 2 THEN title END IGNORE NULLS) OVER o AS t2 FROM h WINDOW o AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING))
    SELECT doc_id, pos, array_to_string(list_filter([CASE WHEN level > 1 THEN t1 END, CASE WHEN level > 2 AND p2 > coalesce(p1, -1) THEN t2 END, title], lambda x: x IS NOT NULL), ' > ') AS path FROM w""")
def _(t):
    return C.heading_paths(_rendered(t), "doc_id").select("doc_id", "pos", X.encode_path(F.col("path")).alias("path"))


@query("w06_occurrence", "SELECT doc_id, CAST(row_number() OVER (PARTITION BY sha256(trim(text)) ORDER BY doc_id) - 1 AS INT) AS occurrence FROM documents")
def _(t):
    d = t("documents").select("doc_id", "text", F.lit("d").alias("doc"), F.lit("s").alias("section"))
    return C.with_chunk_ids(d, "doc", "section", "text", "doc_id").select("doc_id", F.col("occurrence").cast("int").alias("occurrence"))


@query("w07_ordinal", f"WITH {_LINES} SELECT doc_id, pos, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INT) AS chunk_index FROM r")
def _(t):
    from pyspark.sql import Window

    return _rendered(t).select("doc_id", "pos", (F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1).cast("int").alias("chunk_index"))


@query("w11_greedy_merge")
def _(t):
    parts = C.section_texts(C.sections(C.carry_pages(_rendered(t), "doc_id"), "doc_id"), "doc_id")
    return C.merged_sections(parts, "doc_id").select("doc_id", "piece", "heading", F.length("body").alias("chars"))


@query("w12_pack")
def _(t):
    return t("documents").select("doc_id", F.posexplode(C.pack_lines(F.col("text"), 600)).alias("piece", "body")).select("doc_id", "piece", F.length("body").alias("chars"))


@query("w13_adjacent_repeats", "SELECT l_orderkey, list_transform(list_filter(list_zip(f, list_prepend('', f[:-2])), lambda z: z[1] <> z[2]), lambda z: z[1]) AS flags FROM (SELECT l_orderkey, list(l_returnflag ORDER BY l_linenumber, l_returnflag) AS f FROM lineitem GROUP BY 1)")
def _(t):
    per = t("lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))), lambda x: x["l_returnflag"]).alias("cells"))
    return per.select("l_orderkey", X.without_repeats(F.col("cells")).alias("flags"))


@query("a07_provenance_quality", "SELECT count(*) AS total, count(*) FILTER (lang = 'en') AS english, round_even(count(*) FILTER (lang = 'en') * 100.0 / count(*), 1) AS english_pct, count(*) FILTER (n_chars > 1000) AS long, round_even(count(*) FILTER (n_chars > 1000) * 100.0 / count(*), 1) AS long_pct FROM documents")
def _(t):
    return C.provenance_report(t("documents"), english=F.col("lang") == "en", long=F.col("n_chars") > 1000)


@query("a09_index_state", """
    WITH x AS (SELECT source, lang, n_chars, n_chars % 5 > 0 AS readable FROM documents),
    y AS (SELECT l.lang AS version, count(*) AS n, count(*) FILTER (readable AND x.lang IS DISTINCT FROM l.lang) AS mismatches, count(*) FILTER (readable AND x.lang = l.lang AND n_chars % 3 = 0) AS violations, count(*) FILTER (readable) AS seen
          FROM x, (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL) l WHERE x.lang = l.lang OR l.lang = 'en' GROUP BY 1)
    SELECT version, n, mismatches, violations, CASE WHEN seen = 0 THEN 'INDEX_CORRUPT' WHEN mismatches > 0 THEN 'INDEX_SCHEMA_MISMATCH' WHEN violations > 0 THEN 'INDEX_CORRUPT' ELSE 'INDEX_READY' END AS state FROM y""")
def _(t):
    """The index of each language by itself, and of all rows taken for English."""
    d, out = t("documents"), []
    for lang in ("de", "en", "es", "fr"):
        own = d if lang == "en" else d.filter(F.col("lang") == lang)
        out.append(C.index_state(own, lang, "lang", F.col("n_chars") % 3 != 0, F.col("n_chars") % 5 > 0).filter("n > 0").withColumn("version", F.lit(lang)))
    return reduce(DataFrame.unionByName, out)


@query("a27_token_coverage", """
    WITH p AS (SELECT doc_id, regexp_replace(text, '[^A-Za-z\\s]', '', 'g') AS t FROM documents),
    c AS (SELECT doc_id, t, array_to_string(list_transform(range(0, length(t), 500), lambda i: substring(t, i + 1, 500)), ' ') AS chunks FROM p),
    x AS (SELECT doc_id, list_distinct(list_filter(string_split_regex(lower(t), '\\s+'), lambda w: w <> '')) AS a,
    list_distinct(list_filter(string_split_regex(lower(chunks), '\\s+'), lambda w: w <> '')) AS b FROM c)
    SELECT doc_id, CASE WHEN len(a) = 0 THEN 1.0 ELSE round_even(len(list_intersect(a, b)) / len(a), 6) END AS coverage FROM x""")
def _(t):
    plain = t("documents").select("doc_id", F.regexp_replace("text", r"[^A-Za-z\s]", "").alias("plain"))
    chunks = F.regexp_replace("plain", r"(?s)(.{500})", "$1 ")  # one pass; words on a border of two chunks are cut
    return plain.select("doc_id", C.token_coverage(F.col("plain"), chunks).alias("coverage"))


@query("a30_block_check", f"WITH {_LINES} SELECT doc_id, count(*) AS blocks, count(*) FILTER (regexp_matches(line, '^#{{1,3}} ')) AS headings FROM r GROUP BY 1")
def _(t):
    return _rendered(t).groupBy("doc_id").agg(F.count("*").alias("blocks"), F.count_if(X.heading_level(F.col("line")).isNotNull()).alias("headings"))


@query("s06_write_gate", "SELECT doc_id, list_filter([CASE WHEN n_chars <= 100 THEN 'short' END, CASE WHEN lang NOT IN ('en', 'de') THEN 'language' END], lambda x: x IS NOT NULL) AS problems FROM documents WHERE n_chars <= 100 OR lang NOT IN ('en', 'de')")
def _(t):
    return C.write_gate(t("documents"), {"short": F.col("n_chars") > 100, "language": F.col("lang").isin("en", "de")}, strict=False)[1].select("doc_id", "problems")


@query("s13_html_source", "SELECT page_id, regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1) AS title, regexp_extract(url, '^https?://([^/:]+)', 1) AS host FROM pages")
def _(t):
    from strataframe.sources.html import headline, host

    return t("pages").select("page_id", headline(F.col("html")).alias("title"), host(F.col("url")).alias("host"))


@query("x01_clean", "SELECT doc_id, trim(regexp_replace(replace(replace(replace(replace(text, ' ', '  '), '&', '&amp;'), '&amp;', '&'), chr(10), ' ' || chr(10)), '[ \\t]+(\\n|$)', '\\1', 'g'), ' ' || chr(10) || chr(9)) AS cleaned FROM documents")
def _(t):
    noisy = F.replace(F.replace(F.replace(F.col("text"), F.lit(" "), F.lit("  ")), F.lit("&"), F.lit("&amp;")), F.lit("\n"), F.lit(" \r\n"))
    return t("documents").select("doc_id", X.clean_markdown(noisy).alias("cleaned"))


@query("x02_normalize", "SELECT p_partkey, p_name || '|' || p_brand || '*' AS line FROM part")
def _(t):
    return t("part").select("p_partkey", X.normalize_markdown(F.concat("p_name", F.lit("\\|"), "p_brand", F.lit("%5C*"))).alias("line"))


@query("x03_comparison_form", "SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_brand || ', ' || p_name || '!'), '[^\\w\\s]', '', 'g'), '\\s+', ' ', 'g')) AS form FROM part")
def _(t):
    return t("part").select("p_partkey", X.comparison_form(F.concat("p_brand", F.lit(", "), "p_name", F.lit("!"))).alias("form"))


@query("x06_table_row", "SELECT p_partkey, [trim(p_name), trim(p_brand), CAST(p_size AS VARCHAR)] AS cells FROM part")
def _(t):
    return t("part").select("p_partkey", X.table_cells(F.concat(F.lit("|  "), "p_name", F.lit(" | "), "p_brand", F.lit("  |"), F.col("p_size").cast("string"), F.lit("|"))).alias("cells"))


@query("x07_clause_number", "SELECT l_orderkey, l_linenumber, l_orderkey || '.' || l_linenumber AS clause FROM lineitem")
def _(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", X.clause_number(F.concat(F.lit("Clause "), "l_orderkey", F.lit("."), "l_linenumber", F.lit(" Requirements"))).alias("clause"))


@query("x08_std_number", "SELECT p_partkey, 'IS ' || p_partkey || '-' || p_size AS number FROM part")
def _(t):
    return t("part").select("p_partkey", X.standard_number(F.concat(F.lit("is: "), "p_partkey", F.lit(" (Part "), "p_size", F.lit(")"))).alias("number"))


@query("x10_document_id", "SELECT doc_id, 'doc_' || substring(sha256(text), 1, 16) AS document_id, substring(sha256(text), 1, 32) AS content_hash FROM documents")
def _(t):
    return t("documents").select("doc_id", X.document_id(F.col("text")).alias("document_id"), X.content_hash(F.col("text")).alias("content_hash"))


@query("x11_ids", """
    SELECT p_partkey, 'std_' || substring(sha256('is ' || p_partkey), 1, 16) AS standard_id,
    'ver_' || 'std_' || substring(sha256('is ' || p_partkey), 1, 16) || '_' || substring(sha256(CAST(2000 + p_size AS VARCHAR)), 1, 12) AS version_id FROM part""")
def _(t):
    std = X.standard_id(F.concat(F.lit("IS "), "p_partkey"))
    return t("part").select("p_partkey", std.alias("standard_id"), X.version_id(std, X.version_key(F.lit(""), 2000 + F.col("p_size"))).alias("version_id"))


@query("x13_clause_hierarchy", "SELECT l_orderkey, l_linenumber, 2 AS level, CAST(l_orderkey AS VARCHAR) AS parent FROM lineitem")
def _(t):
    n = F.concat_ws(".", "l_orderkey", "l_linenumber")
    return t("lineitem").select("l_orderkey", "l_linenumber", X.clause_level(n).alias("level"), X.parent_clause(n).alias("parent"))


@query("x15_codecs", "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN -1 ELSE p_size END AS encoded, CASE WHEN p_size % 3 = 0 THEN '' WHEN p_size > 25 THEN 'true' ELSE 'false' END AS state FROM part")
def _(t):
    return t("part").select("p_partkey", X.encode_int(F.when(F.col("p_size") % 5 != 0, F.col("p_size"))).alias("encoded"), X.encode_tristate(F.when(F.col("p_size") % 3 != 0, F.col("p_size") > 25)).alias("state"))


@query("x16_contract_problems", """
    WITH o AS (SELECT o_orderkey AS k, o_orderkey % 4 AS a, o_orderkey % 3 AS b, o_orderkey % 5 AS c, o_custkey % 7 AS d FROM orders)
    SELECT k AS o_orderkey, list_filter([CASE a WHEN 1 THEN 'missing fields: [''part'', ''section'']' END, CASE b WHEN 1 THEN 'unexpected fields: [''colour'']' END, CASE d WHEN 1 THEN 'required field ''chunk_id'' is empty' END, CASE c WHEN 1 THEN 'schema_version ''5.0'' != current ''6.0''' END,
      CASE b WHEN 2 THEN 'field ''chunk_index'' must be int, got str' END, CASE c WHEN 2 THEN 'page_start 0 is not a valid page number' END, CASE d WHEN 2 THEN 'inverted page range: page_start=' || (k % 100 + 2) || ' > page_end=' || (k % 100 + 1) END,
      CASE a WHEN 2 THEN 'standard_relation=''none'' must not carry standard_id ''std_' || k || '''' END, CASE a WHEN 2 THEN 'standard_relation=''none'' must not carry version_id ''ver_std_' || (k + d // 6) || '_1''' END,
      CASE WHEN d = 6 THEN 'version_id ''ver_std_' || (k + 1) || '_1'' does not belong to standard_id ''std_' || k || '''' END], lambda x: x IS NOT NULL) AS problems FROM (SELECT k, a, b, CASE WHEN d = 2 THEN 0 ELSE c END AS c, d FROM o)""")
def _(t):
    """Metadata of every order with one fault or several, each varied by itself."""
    k, d = F.col("o_orderkey"), F.col("o_custkey") % 7
    a, b, c = k % 4, k % 3, F.when(d == 2, 0).otherwise(k % 5)
    fixed = {"schema_version", "chunk_id", "chunk_index", "page_start", "page_end", "part", "section", "standard_id", "version_id", "standard_relation"}
    fields = [F.lit(1 if kind == "int" else "x").alias(n) for n, kind in K.FIELDS.items() if n not in fixed]
    page = k % 100 + 2
    fields += [
        F.when(c == 1, "5.0").otherwise("6.0").alias("schema_version"), F.when(d == 1, "").otherwise("c1").alias("chunk_id"), F.when(c == 2, 0).otherwise(page).alias("page_start"), F.when(d == 2, page - 1).otherwise(page).alias("page_end"),
        F.when(a != 1, "p").alias("part"), F.when(a != 1, "s").alias("section"), F.when(b == 1, "red").alias("colour"), F.when(a == 2, "none").otherwise("identity").alias("standard_relation"),
        F.concat(F.lit("std_"), k).alias("standard_id"), F.concat(F.lit("ver_std_"), k + F.when(d == 6, 1).otherwise(0), F.lit("_1")).alias("version_id"), F.when(b != 2, k).alias("chunk_index"),
    ]
    body = F.to_json(F.struct(*fields))
    body = F.when(b == 2, F.concat(F.lit('{"chunk_index":"7",'), F.substring(body, F.lit(2), F.length(body)))).otherwise(body)
    return t("orders").select("o_orderkey", K.contract_problems(body).alias("problems"))


@query("x17_context_prefix", """
    SELECT p_partkey, '[Standard: IS ' || p_partkey || ' | Edition: ' || p_brand || CASE WHEN p_size % 2 = 0 THEN ' | Clause: ' || p_size ELSE '' END || ' | Page: ' || p_size || ']' AS prefix FROM part""")
def _(t):
    none = F.lit(None).cast("string")
    return t("part").select("p_partkey", X.context_prefix(F.concat(F.lit("IS "), "p_partkey"), F.col("p_brand"), none, F.when(F.col("p_size") % 2 == 0, F.col("p_size")), F.col("p_size")).alias("prefix"))


@query("x20_tokenize", "SELECT doc_id, list_filter(list_transform(string_split_regex(lower(text), '\\s+'), lambda t: trim(t, '" + X.PUNCTUATION.replace("'", "''") + "')), lambda t: t <> '') AS tokens FROM documents")
def _(t):
    return t("documents").select("doc_id", X.tokens(F.col("text")).alias("tokens"))


@query("x21_normalize_query", "SELECT p_partkey, 'IS ' || p_partkey || ' : ' || (2000 + p_size) || ' Clause ' || p_size || '.1 Amendment 2' AS q FROM part")
def _(t):
    return t("part").select("p_partkey", X.normalize_query(F.concat(F.lit("is-"), "p_partkey", F.lit(":"), 2000 + F.col("p_size"), F.lit("  clause"), "p_size", F.lit(".1 AMD 2 "))).alias("q"))


_UNITS = ", ".join(f"('{u}', '{c}', {f!r}::DOUBLE, {o!r}::DOUBLE, {i})" for i, (u, c, f, o, _) in enumerate(U.UNITS))


@query("x27_units", f"""
    WITH u(unit, canonical, f, o, i) AS (VALUES {_UNITS}) SELECT p_partkey, round_even(CASE WHEN f IS NULL THEN p_size ELSE p_size * f + o END, 6) AS value, coalesce(canonical, 'furlong') AS unit
    FROM part LEFT JOIN u ON i = p_partkey % {len(U.UNITS) + 1}""")
def _(t):
    names = F.array(*[F.lit(f" {u[0].upper().replace(' ', '_')} " if i % 2 else u[0]) for i, u in enumerate(U.UNITS)], F.lit("furlong"))
    unit = F.element_at(names, (F.col("p_partkey") % (len(U.UNITS) + 1) + 1).cast("int"))
    return t("part").select("p_partkey", F.bround(U.canonical_value(F.col("p_size").cast("double"), unit), 6).alias("value"), U.canonical_unit(unit).alias("unit"))


@query("x28_parameter", """
    WITH x AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS s, p_partkey % 7 AS k FROM part)
    SELECT p_partkey, CASE WHEN k IN (0, 2, 4, 5) THEN 'wall size' WHEN k = 6 THEN 'finish' ELSE 'parameter' END AS name, CASE WHEN k NOT IN (1, 3, 6) THEN s END AS value, CASE k WHEN 0 THEN s - 2 WHEN 1 THEN s WHEN 3 THEN s WHEN 4 THEN s END AS lower,
    CASE k WHEN 0 THEN s + 2 WHEN 1 THEN s + 5 WHEN 3 THEN s + 5 WHEN 5 THEN s END AS upper, CASE k WHEN 0 THEN s WHEN 2 THEN s END AS nominal, CASE k WHEN 0 THEN 'EQ' WHEN 1 THEN 'RANGE' WHEN 2 THEN 'EQ' WHEN 3 THEN 'RANGE' WHEN 4 THEN 'GE' WHEN 5 THEN 'LE' END AS op,
    CASE WHEN k < 6 THEN 'mm' END AS unit, CASE k WHEN 6 THEN 'polished brass' END AS text FROM x""")
def _(t):
    s, k = F.col("p_size").cast("string"), F.col("p_partkey") % 7
    five = (F.col("p_size") + 5).cast("string")
    text = (
        F.when(k == 0, F.concat(F.lit("1) wall size: "), s, F.lit(" ± 2 mm"))).when(k == 1, F.concat(s, F.lit(" - "), five, F.lit(" mm"))).when(k == 2, F.concat(F.lit("- wall size = "), s, F.lit(" mm")))
        .when(k == 3, F.concat(F.lit("between "), s, F.lit(" and "), five, F.lit(" mm"))).when(k == 4, F.concat(F.lit("wall size: >= "), s, F.lit("mm"))).when(k == 5, F.concat(F.lit("(2) wall size: < "), s, F.lit(" mm"))).otherwise("polished brass")
    )
    return t("part").select("p_partkey", U.parameter(text, F.when(k == 6, "finish")).alias("p")).select("p_partkey", "p.name", "p.value", "p.lower", "p.upper", "p.nominal", "p.op", "p.unit", "p.text")


@query("x30_compare_param", """
    WITH p AS (SELECT p_partkey, p_partkey % 10 AS k, p_size * 1.0 AS v, p_size % 7 AS z, p_size % 3 AS r FROM part),
    m AS (SELECT *, CASE r WHEN 0 THEN 15.0 ELSE 20.0 END AS lo, CASE r WHEN 2 THEN 30.0 ELSE 35.0 END AS hi FROM p)
    SELECT p_partkey, CASE
      WHEN k = 0 THEN CASE WHEN v + 2 <= 25.000001 THEN 'MATCH' WHEN v <= 25.000001 THEN 'PARTIAL_MATCH' ELSE 'MISMATCH' END
      WHEN k = 1 THEN CASE WHEN v - 2 >= 24.999999 THEN 'MATCH' WHEN v >= 24.999999 THEN 'PARTIAL_MATCH' ELSE 'MISMATCH' END
      WHEN k = 2 THEN CASE WHEN v - 2 >= lo - 0.000001 AND v + 2 <= hi + 0.000001 THEN 'MATCH' WHEN v - 2 <= hi AND v + 2 >= lo THEN 'PARTIAL_MATCH' ELSE 'MISMATCH' END
      WHEN k = 3 THEN CASE WHEN abs(v - 25) <= 0.0025 THEN 'MATCH' ELSE 'MISMATCH' END
      WHEN k = 4 THEN 'UNVERIFIABLE'
      WHEN k = 5 THEN CASE WHEN v >= lo - 0.000001 AND v + z <= hi + 0.000001 THEN 'MATCH' WHEN v <= hi AND v + z >= lo THEN 'PARTIAL_MATCH' ELSE 'MISMATCH' END
      WHEN k = 6 THEN CASE WHEN p_size_cm + 0.2 <= 25.000001 THEN 'MATCH' WHEN p_size_cm <= 25.000001 THEN 'PARTIAL_MATCH' ELSE 'MISMATCH' END
      WHEN k = 7 THEN CASE z WHEN 0 THEN 'MATCH' WHEN 1 THEN 'UNVERIFIABLE' ELSE 'MISMATCH' END
      WHEN k = 8 THEN CASE WHEN v >= 22.999999 AND v <= 27.000001 THEN 'MATCH' ELSE 'MISMATCH' END
      ELSE CASE z WHEN 0 THEN 'MISSING' WHEN 1 THEN 'UNVERIFIABLE' ELSE CASE WHEN v <= 25.000001 THEN 'MATCH' ELSE 'MISMATCH' END END END AS state
    FROM (SELECT m.*, v / 10.0 AS p_size_cm FROM m)""")
def _(t):
    """LE, GE, RANGE and EQ by values; other dimensions; ranges; a unit on one side; texts; a requirement's tolerance; what is missing."""
    P, Z = F.col("p_partkey"), F.col("p_size")
    k, z, none, word = P % 10, Z % 7, F.lit(None).cast("double"), F.lit(None).cast("string")
    num = lambda v: F.lit(v).cast("double")
    op = F.when(k.isin(0, 6), "LE").when(k == 1, "GE").when(k.isin(2, 5), "RANGE").when(k == 7, F.when(z == 1, "LE").when(z % 2 == 0, "CONTAINS").otherwise("EQ")).when(k == 9, "LE").otherwise("EQ")
    ranged = k.isin(2, 5)
    lo, hi = F.when(ranged, F.when(Z % 3 == 0, 15.0).otherwise(20.0)), F.when(ranged, F.when(Z % 3 == 2, 30.0).otherwise(35.0))
    value = F.when(~k.isin(5, 7) & ~((k == 9) & (z < 2)), Z / 10.0)
    state = U.compare(
        value, F.when(k.isin(3, 5, 8, 9), none).otherwise(0.2), F.when(k == 6, word).otherwise("cm"), op, lo, hi, F.when(~ranged & (k != 7), num(25)), F.when(k == 4, "bar").when(k == 7, word).otherwise("mm"),
        F.when((k == 5) | ((k == 9) & (z == 1)), Z / 10.0), F.when(k == 5, Z / 10.0 + z / 10.0), F.when(k == 7, F.when(z == 0, " Stainless Steel ").otherwise("brass")), F.lit("shall be of STAINLESS steel"), F.when(k == 8, num(2)),
    )
    return t("part").select("p_partkey", state.alias("state"))


@query("x34_dates", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders")
def _(t):
    form = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(F.date_format("o_orderdate", "d MMM yyyy"))
    return t("orders").select("o_orderkey", X.parse_date(form).alias("d"))


_SIZES = ["10mm", "1,100 V", "IS 3055 : 1994", "Clause 4.1", "six months", "2.50", "Amendment 3", "x9y", "15 January 2025", "Part 2 of 7 pieces", "३ kg"]


@query("x36_numbers", f"""
    WITH t AS (SELECT p_partkey, 'Of ' || p_size || ' ' || ['mm', 'and', 'kg', 'years', 'parts'][1 + p_partkey % 5] || ', ' || {_SIZES!r}[1 + p_partkey % 11] || ' or ' || {_SIZES!r}[1 + p_size % 11] || '; ' || p_partkey || ' units' AS t FROM part),
    m AS (SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(translate(t, '०१२३४५६७८९', '0123456789'), '(?i)\\bIS\\s*\\d+(?:\\s*[:/ -]\\s*\\d{{4}})?\\b', ' ', 'g'), '(?i)\\bClause\\s*\\d+(?:\\.\\d+)*\\b', ' ', 'g'), '(?i)\\b(?:Part|Amd|Amendment|Edition)\\s*\\d+\\b', ' ', 'g') AS m FROM t),
    u AS (SELECT p_partkey, m, list_transform(regexp_extract_all(m, '{G.MEASURE}'), lambda x: lower(x)) AS u, regexp_extract_all(m, '{G.BARE}') AS n, regexp_extract_all(m, '{G.COUNTED}') AS w FROM m),
    z AS (SELECT p_partkey, list_concat(list_concat(u, list_filter(n, lambda x: NOT list_contains(list_transform(u, lambda y: regexp_extract(y, '^[^ ]+')), x))), list_transform(w, lambda x: '6' || regexp_extract(lower(x), ' [a-z]+$'))) AS all_ FROM u)
    SELECT p_partkey, list_filter(all_, lambda x, i: list_position(all_, x) = i) AS found FROM z""")
def _(t):
    of = lambda words, k: F.element_at(F.array(*[F.lit(w) for w in words]), (1 + k % len(words)).cast("int"))
    P, Z = F.col("p_partkey"), F.col("p_size")
    text = F.concat(F.lit("Of "), Z, F.lit(" "), of(["mm", "and", "kg", "years", "parts"], P), F.lit(", "), of(_SIZES, P), F.lit(" or "), of(_SIZES, Z), F.lit("; "), P, F.lit(" units"))
    return t("part").select("p_partkey", G.quantities(text).alias("found"))


_STEM = " ".join(f"WHEN len(w) > {len(x) + 2} AND ends_with(w, '{x}') THEN w[:-{len(x) + 1}]" for x in X.SUFFIXES)


@query("x37_stem", f"""
    WITH x AS (SELECT event_id, event_type || ['ation', 'ations', 'ment', 'ments', 'ing', 'tions', 'ies', 'ied', 'ed', 'ly', 'es', 's', 'er', 'ings', ''][1 + event_id % 15] AS w FROM events) SELECT event_id, CASE {_STEM} ELSE w END AS stem FROM x""")
def _(t):
    endings = F.array(*[F.lit(x) for x in ("ation", "ations", "ment", "ments", "ing", "tions", "ies", "ied", "ed", "ly", "es", "s", "er", "ings", "")])
    return t("events").select("event_id", X.stem(F.concat("event_type", F.element_at(endings, (1 + F.col("event_id") % 15).cast("int")))).alias("stem"))


@query("x39_sigmoid", "SELECT event_id, round_even(1 / (1 + exp(-greatest(-10, least(10, value - 50)))), 8) AS s FROM events")
def _(t):
    return t("events").select("event_id", F.bround(X.sigmoid(F.col("value") - 50), 8).alias("s"))


@query("x40_completeness", "SELECT p_partkey, CAST(0.25 * (2 + CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS share FROM part")
def _(t):
    return t("part").select("p_partkey", X.share_filled(F.col("p_name"), F.col("p_brand"), F.when(F.col("p_size") % 2 == 0, F.col("p_size")), F.lit("")).alias("share"))


@query("x46_huid", "SELECT p_partkey, len(CAST(p_partkey AS VARCHAR)) = 4 AS ok FROM part")
def _(t):
    return t("part").select("p_partkey", X.valid_huid(F.concat(F.lit(" ab"), F.col("p_partkey").cast("string"), F.lit(" "))).alias("ok"))
