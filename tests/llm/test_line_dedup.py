import hashlib
from collections import Counter

import numpy as np
import pytest

from strataframe.llm import line_dedup as L
from tests.llm import docs as D

SPACE = " \t\n\x0b\x0c\r"


def fold(line):
    return "".join(c.lower() if c.isascii() else c for c in line.strip(SPACE))


def brute(texts, min_docs, min_chars):
    cut = [(t or "").split("\n") for t in texts]
    n = Counter(k for lines in cut for k in {fold(x) for x in lines} if len(k) >= min_chars)
    out = []
    for lines in cut:
        kept = [x for x in lines if n[fold(x)] < min_docs]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def rows_of():
    rows = [D.row(i, "\n".join(["  Shared FOOTER\t", D.prose(i, 6), "", "ÄÖ é" if i % 2 else "äö é", " Shared footer", "x" * (i % 5), "dup", "dup"][i % 3 :])) for i in range(60)]
    rows += [D.row(100, None), D.row(101, ""), D.row(102, "\n\n"), D.row(103, "shared footer"), D.row(None, "shared footer\nown line"), D.row(None, "dup\r\nkeep"), D.row(5, "one\nshared footer"), D.row(5, "one\nshared footer")]
    rows += [D.row(200 + i, "copies\nof one text") for i in range(30)] + [D.row(300, "once " * 40_000 + "\n" + "\n".join(f"l{i}" for i in range(5000)) + "\nSHARED footer")]
    return rows


@pytest.mark.parametrize(("min_docs", "min_chars", "shard_keys", "slice_rows"), [(10, 1, L.SHARD_KEYS, L.SLICE_ROWS), (2, 3, 40, 7), (1, 1, 1, 1), (10**6, 1, 500, 50)])
def test_matches_brute_force(spark, monkeypatch, min_docs, min_chars, shard_keys, slice_rows):
    monkeypatch.setattr(L, "SHARD_KEYS", shard_keys)
    monkeypatch.setattr(L, "SLICE_ROWS", slice_rows)
    rows = rows_of()
    df = D.frame(spark, rows)
    want = brute([r[1] for r in rows], min_docs, min_chars)
    got = sorted(map(tuple, L.line_dedup(df, min_docs, min_chars).collect()), key=repr)
    assert got == sorted(((r[0], n, d, hashlib.sha256(t.encode()).hexdigest()) for r, (n, d, t) in zip(rows, want)), key=repr)
    kept = L.without_frequent_lines(df, min_docs, min_chars)
    assert kept.schema == df.schema
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted(((*r[:1], t, *r[2:]) for r, (_, _, t) in zip(rows, want)), key=repr)


def test_awkward_and_empty_tables(spark):
    assert L.line_dedup(D.empty(spark)).count() == 0 and L.without_frequent_lines(D.empty(spark)).columns == D.empty(spark).columns
    df = D.awkward(spark).toDF("doc_id", "text", "slice", "keys", "counts", "hits", "n_lines", "n_dropped", "c0", "c1")
    out = L.without_frequent_lines(df, 2)
    assert out.columns == df.columns and out.count() == df.count()
    nothing = D.frame(spark, [D.row(1, ""), D.row(2, None)])
    assert [r.n_dropped for r in L.line_dedup(nothing, 1).collect()] == [0, 0]


@pytest.mark.parametrize("n", [0, 1, 2, 63, 5000])
def test_index_is_minimal_and_perfect(n, monkeypatch):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 2**64, (n, 2), np.uint64)
    counts = rng.integers(1, 2**40, n)
    for levels in (L.LEVELS, 1):  # with one level most keys are listed as they are
        monkeypatch.setattr(L, "LEVELS", levels)
        index = L.LineIndex.of(*L.LineIndex.build(keys, counts).fields())
        assert sorted(index.slots(keys).tolist()) == list(range(n))
        assert index.find(keys).tolist() == np.minimum(counts, 2**32 - 1).tolist()
        others = rng.integers(0, 2**64, (5000, 2), np.uint64)
        assert not index.find(others).any()
    if n == 5000:
        monkeypatch.setattr(L, "LEVELS", 48)
        index = L.LineIndex.build(keys, counts)
        assert len(index.bits) / n < 3.5 and not len(index.rest)


def test_a_hot_line_reaches_its_shard_once_a_task(spark):
    df = spark.range(4000, numPartitions=4).selectExpr("id AS doc_id", "concat('hot line\n', id) AS text")
    lines = L.sliced(df).filter("length(keys) > 0").select("slice", "keys", "counts")
    dealt = lines.select("keys", "counts").mapInArrow(L._counts_by_shard(1), "shard long, keys binary, counts binary")
    assert dealt.count() <= 4
    index = L.LineIndex.of(*L.build_index(lines, 1).drop("shard").first())
    assert sorted(index.counts.tolist())[-2:] == [1, 4000] and len(index.counts) == 4001
