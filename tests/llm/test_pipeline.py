"""The pipeline against its stages' brute-force twins, on a small fixture."""

import os
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import docs as D
from tests.llm.test_jaccard_join import brute
from tests.llm.test_langid import DE, EN
from tests.llm.test_pii import base
from tests.llm.test_tokens import WORD, library


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows = []
    for i in range(60):
        words = EN if i % 2 else DE
        rows.append(D.row(i, " ".join(words[(i * 3 + j * (1 + i % 4)) % len(words)] + (str(i * j) if j % 9 == 0 else "") for j in range(40)), "en" if i % 2 else "de"))
    rows += [D.row(100 + i, rows[i][1]) for i in range(5)]  # exact copies
    rows += [D.row(110 + i, rows[20 + i][1] + " more") for i in range(5)]  # near copies
    rows += [D.row(120, "12345 67890"), D.row(121, None), D.row(122, rows[1][1] + " write to a.b@c.example or +1 (499) 555-6503")]
    path = tmp_path_factory.mktemp("in")
    D.frame(spark, rows).write.parquet(os.path.join(path, "documents.parquet"))
    return str(path), {r[0]: r[1] for r in rows}


def test_every_stage_takes_effect(spark, folder):
    path, texts = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, left = docs.columns, set(texts)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == columns
        docs = docs.cache()
        ids = {r.doc_id for r in docs.collect()}
        if name == "language_id":
            want = left - {120, 121}
        elif name == "exact_dedup":
            want = left - {0, 1, 2, 3, 4}  # the largest id stays
        elif name == "jaccard_join":
            root, _ = brute([(i, texts[i]) for i in left])
            want = {i for i in left if root[i] == i}
            assert want != left
        else:
            want = left
            for r in docs.collect():
                plain = texts[r.doc_id]
                assert not base(r.text) and (base(plain) or re.sub(r"\[[A-Z_]+\]", "", r.text) == r.text)
        assert ids == want, name
        left = want
    final = {r.doc_id: r.text for r in docs.collect()}
    out = corpus_pipeline.run(spark, path).toPandas()
    lib = library(WORD)
    assert set(out.doc_id) == set(final)
    for r in out.itertuples():
        ids = (lib.encode(final[r.doc_id], add_special_tokens=False).ids + [1])[r.start : r.start + r.length]
        assert zlib.crc32(np.array(ids, "<u4").tobytes()) == r.ids_crc32
    assert (out.groupby("sequence_id").length.sum() <= 4096).all()


def test_clean_documents_stay(spark, folder):
    path, texts = folder
    kept = corpus_pipeline.STAGES[0][1](spark, spark.read.parquet(f"{path}/documents.parquet"), path)
    assert kept.filter(F.col("doc_id") < 60).count() == 60


def test_one_row_of_each_group_stays_whatever_the_ids(spark, tmp_path):
    a, b, c, d = (" ".join(f"{w}{k}" for w in EN[:30]) for k in "abcd")
    rows = [D.row(1, a), D.row(None, a), D.row(None, a), D.row(None, b), D.row(None, b)]  # null ids, with and without an owner
    rows += [D.row(3, c), D.row(3, c), D.row(3, c)]  # repeated rows
    rows += [D.row(5, a.upper()), D.row(5, d), D.row(6, "one two three four five six seven"), D.row(6, d.replace("d ", "d  "))]  # ids with two texts
    near = [D.row(None, d + " more"), D.row(None, b + " more"), D.row(None, b + " still")]
    stages = dict(corpus_pipeline.STAGES)
    docs = D.frame(spark, rows + near)
    exact = stages["exact_dedup"](spark, docs, "")
    got = sorted(((r.doc_id, r.text) for r in exact.collect()), key=repr)
    want = [(5, a.upper()), (None, b), (3, c), (5, d), (6, rows[10][1]), (6, rows[11][1]), *((None, r[1]) for r in near)]
    assert exact.columns == docs.columns and got == sorted(want, key=repr)
    for left in (exact, docs):
        out = stages["jaccard_join"](spark, left, "").collect()
        groups = ["a " if r.text.lower().startswith(a[:9]) else r.text[:9] for r in out]
        assert len(out) == len(set(groups)) == 5, out
        assert all(r.doc_id is not None for r in out if not r.text.startswith(b[:9]))
