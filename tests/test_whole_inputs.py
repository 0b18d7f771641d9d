"""Queries read whole tables."""

import random

import pytest

import __spark_entry__ as entry
from strataframe.sources import files

QUERIES = entry.queries()


def test_every_50th_vector_is_a_query(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, [rng.random() for _ in range(20)], i % 3) for i in range(260)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    for name in ("r01_knn", "j05_full_outer_fuse", "w01_rrf"):
        got = QUERIES[name](spark, str(tmp_path)).select("query_id").distinct().collect()
        assert {r[0] for r in got} == set(range(0, 260, 50)), name


def test_joins_take_all_orders(spark, tmp_path):
    rng = random.Random(5)
    parts = [(i, rng.randint(1, 50)) for i in range(1, 300)]
    orders = [(i, rng.randint(1, 400)) for i in range(900, 3200, 3)]
    lines = [(o, n) for o, _ in orders for n in range(1, 3)]
    spark.createDataFrame(parts, "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = {}
    for p, size in parts:
        fits = [o for o, c in orders if o % 100 == p % 100 and (size % 5 == 0 or c % 5 == 0 or size % 5 == c % 5)]
        if fits:
            want[p] = min(fits)
    assert max(want.values()) >= 1000
    assert {r.p_partkey: r.o_orderkey for r in QUERIES["j02_derived_key_join"](spark, str(tmp_path)).collect()} == want
    even = {o for o, _ in orders if o % 2 == 0}
    want = [(f"{o}.{n}", str(o) if o in even else None) for o, n in lines] + [(str(o), None) for o in even]
    got = [tuple(r) for r in QUERIES["j06_parent_clause"](spark, str(tmp_path)).select("num", "parent").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_corpus_statistics_name_every_term(spark, tmp_path):
    texts = [(1, "alpha beta beta"), (2, "alpha gamma"), (3, "delta"), (4, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["a28_corpus_stats"](spark, str(tmp_path)).select("term").collect()
    assert sorted(r.term for r in got) == ["alpha", "beta", "delta", "gamma"]
