"""Stored indexes and the search for many strings, against brute force."""

import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataframe.operators import joins
from strataframe.operators import neighbours as N
from strataframe.operators import patterns as A
from strataframe.operators import postings as P
from strataframe.operators import retrieval as R
from strataframe.operators import temporal


def texts(n, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(300)], k=rng.randint(0, 60)))) for i in range(n)]
    return [*rows, (n, None), (n + 1, ""), (n + 2, "only once"), (n + 3, " ".join(["w0"] * 500))]


def best_by_scan(docs, queries, k):
    scored = R.bm25(docs, "id", "text", queries, "q", "text").withColumn("score", F.bround("score", 6))
    return sorted((r.q, r["rank"], r.id, r.score) for r in R.top_k(scored, "q", k, F.col("score").desc(), F.col("id")).collect())


def best_by_index(index, queries, k):
    return sorted((r.q, r["rank"], r.key, r.score) for r in P.search(index, queries, "q", "text", k).collect())


@pytest.fixture
def queries(spark):
    return spark.createDataFrame([(1, "w0 w1 w250 w299"), (2, "w5 w5 w17"), (3, "only"), (4, "no such words"), (5, None), (6, "w0"), (7, "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9")], "q long, text string")


@pytest.mark.parametrize("shard", [P.SHARD_DOCS, 20])
def test_index_gives_what_a_scan_gives(spark, tmp_path, monkeypatch, queries, shard):
    monkeypatch.setattr(P, "SHARD_DOCS", shard)
    rows = texts(400)
    docs = spark.createDataFrame(rows, "id long, text string")
    path = str(tmp_path / "i")
    for batch in range(3):  # three batches of documents, appended
        P.append(docs.filter(F.col("id") % 3 == batch), "id", "text", path, batch)
    index = P.load(spark, path)
    for k in (1, 10, 1000):
        assert best_by_index(index, queries, k) == best_by_scan(docs, queries, k)
    monkeypatch.setattr(P, "ASKED_TERMS", 3)  # one pass a query or two
    assert best_by_index(index, queries, 5) == best_by_scan(docs, queries, 5)
    idf = {r.term: r.idf for r in P.weights(index)[0].collect()}
    scan = {r.term: r.idf for r in R.idf(R.term_counts(docs, "text"))[0].collect()}
    assert idf.keys() == scan.keys() and all(abs(idf[t] - scan[t]) < 1e-9 for t in idf)


def test_postings_are_bounded_and_texts_are_not_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(P, "SHARD_DOCS", 50)
    docs = spark.createDataFrame(texts(300), "id string, text string")
    path = str(tmp_path / "i")
    P.append(docs, "id", "text", path)
    index = P.load(spark, path)
    assert index.postings.agg(F.max(F.size("list"))).first()[0] < 110  # of over 200 documents with w0
    got = P.search(index, spark.createDataFrame([("a", "w0 only")], "q string, text string"), "q", "text", 3)
    assert got.first().key == "302" and "tokens" not in got._jdf.queryExecution().toString()


def test_stored_index_is_built_once_for_the_files(spark, tmp_path):
    path = str(tmp_path / "d")
    spark.createDataFrame(texts(50), "id long, text string").write.parquet(path)
    folder = str(tmp_path / "stored")
    one = P.stored(spark.read.parquet(path), "id", "text", folder)
    two = P.stored(spark.read.parquet(path), "id", "text", folder)
    assert one.postings.inputFiles() == two.postings.inputFiles()
    spark.createDataFrame([(900, "a new document")], "id long, text string").write.mode("append").parquet(path)
    three = P.stored(spark.read.parquet(path), "id", "text", folder)
    assert three.postings.inputFiles() != one.postings.inputFiles() and three.lengths.agg(F.sum("docs")).first()[0] == 55


def test_shards_below_the_best_are_skipped():
    """Bounds of a shard under the k-th best score leave it unread, and lose nothing."""
    best = P._Best(1, 2)
    best.add(0, np.array([3.0, 1.0, 2.0]), ["a", "b", "c"])
    assert best.floor[0] == 2.0 and sorted(best.keys[0]) == ["a", "c"]
    best.add(0, np.array([2.0]), ["d"])
    assert sorted(best.keys[0]) == ["a", "c", "d"]  # ties at the floor stay


@pytest.mark.parametrize("clustered", [True, False])
def test_cells_find_the_nearest(spark, clustered, monkeypatch):
    monkeypatch.setattr(N, "ROW_BLOCK", 40)
    monkeypatch.setattr(N, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 12)) * (0.3 if clustered else 1.0) + (rng.normal(0, 3, (15, 12))[rng.integers(0, 15, 900)] if clustered else 0.0)
    x[300:600] = x[300]  # one vector is a third of all rows
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None)]
    corpus = spark.createDataFrame(rows, "id long, v array<double>").repartition(5)
    asked = corpus.filter("id % 20 = 0").withColumnRenamed("id", "q")
    cells = N.fit(corpus, "id", "v", k=10)
    indexed = N.index(corpus, "id", "v", cells)
    assert indexed.count() == 900
    exact = {(r.q, r.id): r.distance for r in R.knn(corpus, "id", "v", asked, "q", "v", 10).collect()}
    got = N.search(indexed, cells, "id", "v", asked, "q", "v", 10).collect()
    far = {q: max(d for (p, _), d in exact.items() if p == q) for q, _ in exact}
    recall = np.mean([r.distance <= far[r.q] + 1e-9 for r in got])  # rows as near as the k-th nearest
    assert len(got) == len(exact) and recall >= 0.9
    assert cells.probes < len(cells.centroids) / 2 or not clustered
    whole = N.search(indexed, cells, "id", "v", asked, "q", "v", 10, probes=len(cells.centroids)).collect()
    assert {(r.q, r.id) for r in whole} == set(exact)


def test_cells_are_stored_and_empty_tables_pass(spark, tmp_path):
    corpus = spark.createDataFrame([(i, [float(i % 5), 1.0]) for i in range(50)], "id long, v array<double>")
    cells = N.fit(corpus, "id", "v", k=3)
    N.save(N.index(corpus, "id", "v", cells), cells, str(tmp_path / "c"))
    rows, again = N.load(spark, str(tmp_path / "c"))
    assert rows.count() == 50 and again.probes == cells.probes and np.allclose(again.centroids, cells.centroids)
    none = corpus.filter("false")
    empty = N.fit(none, "id", "v")
    assert N.search(N.index(none, "id", "v", empty), empty, "id", "v", corpus.withColumnRenamed("id", "q"), "q", "v", 3).count() == 0
    assert N.search(rows, again, "id", "v", none.withColumnRenamed("id", "q"), "q", "v", 3).count() == 0


@pytest.mark.parametrize("part_chars", [A.PART_CHARS, 10])
def test_many_strings_at_once(spark, part_chars):
    rng = random.Random(3)
    strings = [rng.choice("ab") + "".join(rng.choices("abc ", k=rng.randint(0, 5))) for _ in range(60)] + ["äé", "x" * 40, "", None, "aba", "aba"]
    rows = [(str(i), "".join(rng.choices("abcé äx ", k=rng.randint(0, 80)))) for i in range(80)] + [("n", None), ("e", ""), ("x", "x" * 41)]
    df = spark.createDataFrame(rows, "k string, t string")
    got = Counter(tuple(r) for r in A.occurring(df, "k", "t", spark.createDataFrame([(s,) for s in strings], "s string"), "s", part_chars).collect())
    assert got == Counter((k, s) for k, t in rows for s in {s for s in strings if s} if s in (t or ""))
    assert A.occurring(df, "k", "t", spark.createDataFrame([], "s string"), "s").columns == ["k", "pattern"]


def test_a_word_of_a_megabyte_takes_seconds(spark):
    catalogue = spark.createDataFrame([(1, ["hidden pipe"], "other things", "x"), (2, ["valves"], "t", "c")], "c long, products array<string>, title string, category string")
    asks = spark.createDataFrame([(7, "a" * 1_000_000 + "hidden" + "b" * 1_000), (8, "nothing")], "q long, t string")
    began = time.time()
    got = joins.match_catalogue(asks, "q", "t", catalogue, "c", "products", "title", "category").collect()
    assert [tuple(r) for r in got] == [(7, 1, 3)] and time.time() - began < 30
    assert joins.match_catalogue(asks, "q", "t", catalogue.filter("false"), "c", "products", "title", "category").count() == 0


def test_years_anywhere_in_a_target(spark):
    versions = spark.createDataFrame([("v1", 2004), ("v2", 1999), ("v3", None)], "id string, year int")
    edges = spark.createDataFrame([("std_120042",), ("v3",), (None,)], "target string")
    got = {r.id for r in temporal.superseded(versions, "id", F.col("year"), edges, "target").collect()}
    assert got == {"v1", "v3"}


def test_words_are_dealt_once_for_an_index(spark, monkeypatch):
    monkeypatch.setattr(P, "SHARD_DOCS", 20)
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 3} W{i % 3}, x") for i in range(60)] + [(60, None), (5, "w9 w9 x")], "id long, text string")
    index = P.blocks(docs, "id", "text")
    assert index.postings._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = {r.term: r.df for r in index.terms.collect()}
    assert got["x"] == 61 and got["w9"] == 1 and got["w6"] == 8 and P.ALL not in got
    assert index.lengths.agg(F.sum("docs"), F.sum(F.col("dl") * F.col("docs"))).first()[:] == (62, 243)


def test_discovery_through_an_index(spark):
    from strataframe.operators import rules as D

    docs = spark.createDataFrame([(1, "red water pump of brass", "IS 1", "4"), (2, "water pump test", "IS 1", "5"), (3, "lamp", "IS 2", "")], "id long, text string, std string, clause string")
    titles = spark.createDataFrame([("IS 1", "Water pump"), ("IS 9", "Kettles")], "std string, title string")
    products = spark.createDataFrame([(7, "water pump"), (8, "kettle")], "p long, name string")
    known = spark.createDataFrame([(7, "IS 9")], "p long, std string")
    words = lambda asked, q_key, text, pool: P.search(P.blocks(docs, "id", "text"), asked, q_key, text, pool).withColumnRenamed("key", "id")
    scan, index = (sorted(map(tuple, D.discover(products, "p", "name", docs, "id", "text", "std", "clause", titles, "title", known, **how).collect())) for how in ({}, {"lexical": words}))
    assert scan == index and len(scan) == 3


def test_a_scan_deals_a_frequent_word_over_many_tasks(spark, queries):
    docs = spark.createDataFrame(texts(50), "id long, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = R.bm25(docs, "id", "text", queries, "q", "text")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(term" in plan and any("__salt" in x for x in plan.split("Exchange hashpartitioning(")[1:] for x in [x.split(")")[0]])


def test_a_scan_adds_up_a_document_in_its_task(spark, queries):
    docs = spark.createDataFrame(texts(50), "id long, text string")
    plan = R.bm25(docs, "id", "text", queries, "q", "text")._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange hashpartitioning\(q#\d+L?, id#", plan) and re.search(r"Exchange hashpartitioning\(id#\d+L?, \d+\), REPARTITION_BY_COL", plan)
    # no condition on the term reaches the texts, so all statistics read one exchange
    assert not re.search(r"Filter \([^\n]* AND (NOT )?StartsWith", plan)


def test_a_scan_scores_alike_with_few_and_many_words_of_queries(spark, monkeypatch, queries):
    odd = [(None, "w0 w1 w250"), (None, "w0 only"), (7, None), (7, ""), (400, "w5 w5 w17"), (400, "w5 w5 w17"), (401, "  ,; ")]
    docs = spark.createDataFrame([*texts(40), *odd], "id long, text string")
    asked = queries.unionByName(spark.createDataFrame([(None, "w0 w17"), (1, "w0 w0")], "q long, text string"))
    score = lambda: {(r.q, r.id): round(r.score, 6) for r in R.bm25(docs, "id", "text", asked, "q", "text").collect()}
    held = score()
    monkeypatch.setattr(R, "HELD_TERMS", 1)
    assert score() == held and (None, None) in held and (1, 400) not in held
    assert R.bm25(docs.filter("false"), "id", "text", asked, "q", "text").count() == 0 == R.bm25(docs, "id", "text", asked.filter("false"), "q", "text").count()


def test_weights_read_the_terms_in_one_way(spark, tmp_path, queries):
    P.append(spark.createDataFrame(texts(50), "id long, text string"), "id", "text", str(tmp_path / "i"))
    idf, _ = P.weights(P.load(spark, str(tmp_path / "i")))
    plan = queries.selectExpr("explode(split(text, ' ')) AS term").join(idf, "term")._jdf.queryExecution().executedPlan().toString()
    reads = [x for x in plan.splitlines() if "FileScan" in x and "df:bigint" in x]
    assert len(reads) > 1 and all("IsNotNull(term)" in x for x in reads)  # floor and weights share one exchange


def test_contained_items_read_the_posts_once(spark, tmp_path):
    rows = [(1, "a b c d e"), (2, "x a b c d"), (2, "b c d"), (2, "x a b c d"), (None, "a b c d"), (3, None), (4, ""), (5, "a b  c d"), (6, "foo barx"), (7, "bar"), (None, "bar")]
    spark.createDataFrame(rows, "id long, text string").write.parquet(str(tmp_path / "d"))
    items = spark.createDataFrame([(1, "a b c d"), (2, "b c"), (3, None), (4, "foo bar"), (None, "a b"), (5, "none of it"), (1, "b c d e")], "item long, text string")
    got = R.texts_containing(spark.read.parquet(str(tmp_path / "d")), "id", "text", items, "item", "text")
    # "foo" is rarer than "bar" only with the document of no id
    assert {tuple(r) for r in got.collect()} == {(1, 1), (1, 2), (2, 1), (2, 2), (4, 6)}
    final = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert re.search(r"ReusedExchange \[id#\d+L?, term#\d+\], Exchange hashpartitioning\(term", final)
