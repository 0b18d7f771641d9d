"""The opN_ queries of the training-data operators and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from strataframe.llm import centroids, exact_dedup, fill_in_middle, jaccard_join, langid, line_dedup, packing, pii, quality_classifier, quality_rules, secret_scan, sentencepiece_codec, token_files
from strataframe.llm._common import id_crc_mod, table


def op1_pii(spark, sf_dir):
    return pii.digest(pii.find_pii(table(spark, sf_dir, "documents")))


def op2_sentencepiece(spark, sf_dir):
    return sentencepiece_codec.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit(docs))
    return found.select("doc_id", F.coalesce(id_crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op4_secret_scan(spark, sf_dir):
    return secret_scan.digest(secret_scan.scan_secrets(table(spark, sf_dir, "documents")))


def op6_quality_rules(spark, sf_dir):
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op5_jaccard_join(spark, sf_dir):
    return jaccard_join.jaccard_classes(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096)


def op8_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = quality_classifier.classify(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(id_crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op9_token_files(spark, sf_dir):
    return token_files.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


def op10_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), keep="max")


def op11_fill_in_middle(spark, sf_dir):
    return fill_in_middle.digest(fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents"), seed=7, fim_percent=100, spm_percent=50))


def op12_centroids(spark, sf_dir):
    return centroids.cluster(table(spark, sf_dir, "embeddings"), k=8, rounds=10, seed=3)


def op13_line_dedup(spark, sf_dir):
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)


QUERIES = {
    "op1_pii": op1_pii,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_language_id": op3_language_id,
    "op4_secret_scan": op4_secret_scan,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_quality_rules": op6_quality_rules,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_token_files": op9_token_files,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_centroids": op12_centroids,
    "op13_line_dedup": op13_line_dedup,
}


def _centroids_sql(k: int = 8, rounds: int = 10, dim: int = 64) -> str:
    """Lloyd's rounds one after another, a table of assignments and one of centroids each."""
    parts = [
        f"""v AS MATERIALIZED (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS c FROM embeddings
            WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim})""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS num, c FROM v ORDER BY num LIMIT {k})",
    ]
    gap = f"list_sum(list_transform(range(1, {dim + 1}), lambda i: (v.c[i] - m.c[i]) * (v.c[i] - m.c[i])))::BIGINT"
    for r in range(rounds + 1):
        parts.append(f"d{r} AS (SELECT vec_id, v.c, num, {gap} AS d FROM v, c{r} m)")
        parts.append(f"a{r} AS MATERIALIZED (SELECT vec_id, any_value(c) AS c, min(d) AS d, min_by(num, d * {k} + num)::INT AS num FROM d{r} GROUP BY vec_id)")
        if r < rounds:
            parts.append(f"s{r} AS (SELECT num, i, sum(c[i]) AS s, count(*) AS n FROM a{r}, range(1, {dim + 1}) t(i) GROUP BY num, i)")
            floor = "((s - ((s % n) + n) % n) // n)::BIGINT"
            parts.append(f"m{r} AS (SELECT num, list({floor} ORDER BY i) AS c FROM s{r} GROUP BY num)")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT num, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (num))")
    last = f"""SELECT vec_id, a.num AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.num))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
               sha256(array_to_string(m.c, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} m USING (num)"""
    return "WITH " + ", ".join(parts) + " " + last

ORACLES = {
    "op10_exact_dedup": """
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(body) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY body)
    """,
    "op11_fill_in_middle": """
        WITH u AS (SELECT doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS units, sha256('7:' || doc_id) AS h FROM documents),
        d AS (SELECT *, len(units) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM u),
        c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                     CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d),
        p AS (SELECT *, array_to_string(units[1:a], '') AS pre, array_to_string(units[a + 1:b], '') AS mid, array_to_string(units[b + 1:], '') AS suf FROM c)
        SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
               sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE body END) AS output_sha256,
               sha256(body) AS restored_sha256
        FROM p
    """,
    "op12_centroids": _centroids_sql(),
    "op13_line_dedup": """
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        l AS (SELECT r, i, lines[i] AS line, translate(trim(lines[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
              FROM d, unnest(range(1, len(lines) + 1)) t(i)),
        f AS (SELECT k FROM l WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT r) >= 10),
        kept AS (SELECT r, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS body FROM l WHERE k NOT IN (SELECT k FROM f) GROUP BY r)
        SELECT doc_id, len(lines)::BIGINT AS n_lines, (len(lines) - coalesce(n, 0))::BIGINT AS n_dropped, sha256(coalesce(body, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
    """,
}
