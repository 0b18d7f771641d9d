"""The opN_ queries themselves, over a driver table, against the wording of their contracts."""

import hashlib
import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from strataframe.llm import langid, quality_classifier
from strataframe.llm.queries import QUERIES
from tests.llm import test_pii, test_quality_rules, test_secret_scan

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


@pytest.fixture(scope="module")
def texts():
    rows = duckdb.sql(f"SELECT doc_id, text, lang FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()
    assert len(rows) == len({r[0] for r in rows})
    return {i: (t, lang) for i, t, lang in rows}


def run(spark, name, texts, columns):
    df = QUERIES[name](spark, SF)
    types = dict(df.dtypes)
    assert {c: types.get(c) for c in columns} == columns
    return {r.doc_id: r for r in df.collect()} if name not in ("op7_best_fit_packing",) else df.collect()


def crc(i, m):
    return zlib.crc32(str(i).encode()) % m


def ids_crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def encoded(name, end):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [end]


def test_op1(spark, texts):
    got = run(spark, "op1_pii", texts, {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"})
    assert set(got) == set(texts)
    for i, (t, _) in texts.items():
        b = test_pii.base(t)
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in b)
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and got[i].spans.startswith(joined)
        assert [got[i][f"n_{k}"] for k in test_pii.RX] == [sum(x[0] == k for x in b) for k in test_pii.RX]


def test_op2(spark, texts):
    got = run(spark, "op2_sentencepiece", texts, {"doc_id": "bigint", "n_pieces": "bigint"})
    assert set(got) == set(texts) and all(r.same for r in got.values())


def test_op3(spark, texts):
    got = run(spark, "op3_language_id", texts, {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"})
    assert set(got) == set(texts) and all(r.held_out == (crc(i, 4) == 2) for i, r in got.items())
    # the model again in plain Python, from the rows that may be learnt
    counts = {n: {} for n in (0, *langid.ORDERS)}
    for i, (t, lang) in texts.items():
        if lang and crc(i, 4) != 2:
            for w in re.findall(r"[^\W\d_]+", (t or "").lower()):
                counts[0].setdefault(lang, Counter())[w] += 1
                for n in langid.ORDERS:
                    for g in langid.grams(w, n):
                        counts[n].setdefault(lang, Counter())[g] += 1
    langs = sorted(counts[0])
    kept = {n: {g for c in by.values() for g, k in c.items() if k >= langid.MIN_COUNT} for n, by in counts.items()}
    logs = {}
    for n, by in counts.items():
        table = np.array([[by[x][g] if by[x][g] >= langid.MIN_COUNT else 0 for x in langs] for g in sorted(kept[n])]) + 0.1
        logs[n] = dict(zip(sorted(kept[n]), np.log(table / table.sum(axis=0))))

    def word(w):
        if w in logs[0]:
            return logs[0][w]
        for n in langid.ORDERS:
            hits = [logs[n][g] for g in langid.grams(w, n) if g in logs[n]]
            if hits:
                return np.mean(hits, axis=0)
        return np.zeros(len(langs))

    right = total = 0
    for i, (t, lang) in texts.items():
        words = re.findall(r"[^\W\d_]+", (t or "").lower())
        if not words:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        z = np.sum([word(w) for w in words], axis=0) * min(1.0, langid.EVIDENCE / len(words))
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert abs(got[i].score - p.max()) < 1e-3 and (got[i].lang_pred == langs[p.argmax()] or np.sort(p)[-2] > p.max() - 1e-3)
        if lang and crc(i, 4) == 2 and len(words) >= 10:
            right, total = right + (got[i].lang_pred == lang), total + 1
    assert total > 20 and right / total > 0.95


def test_op4(spark, texts):
    got = run(spark, "op4_secret_scan", texts, {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"})
    assert set(got) == set(texts)
    for i, (t, _) in texts.items():
        joined = test_secret_scan.base(t)
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(got[i].spans.split(","))
        assert [got[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [joined.count(k) for k in ("assign", "access", "hex")]


def test_op6(spark, texts):
    got = run(spark, "op6_quality_rules", texts, {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"})
    assert set(got) == set(texts)
    rows = duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{SF}/documents.parquet'").fetchall()
    want = test_quality_rules.verdicts(rows)
    for i, (t, _) in texts.items():
        r, b = got[i], test_quality_rules.brute(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == b
        assert r.base_failed == (b[0] < 50 or 100 * b[4] > 50 * b[0]) and r.kept == want[i]


def test_op7(spark, texts):
    rows = run(spark, "op7_best_fit_packing", texts, {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"})
    ids_of = encoded("word_bpe_49k.json", 1)
    want = []
    for i, (t, _) in texts.items():
        ids = ids_of(t)
        want += [(i, p, s, len(ids[s : s + 4096]), ids_crc(ids[s : s + 4096])) for p, s in enumerate(range(0, len(ids), 4096))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    by = {}
    for r in sorted(rows, key=lambda r: r.offset):
        assert by.get(r.sequence_id, 0) == r.offset
        by[r.sequence_id] = r.offset + r.length
    assert max(by.values()) <= 4096 and len(by) <= 1.02 * -(-sum(by.values()) // 4096) + 1


def test_op8(spark, texts):
    got = run(spark, "op8_quality_classifier", texts, {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"})
    assert set(got) == set(texts)
    for i, r in got.items():
        assert r.held_out == (crc(i, 5) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    labels = duckdb.sql(f"SELECT DISTINCT doc_id, quality FROM '{SF}/labels.parquet' WHERE quality IS NOT NULL ORDER BY 1, 2").fetchall()
    learn = [(i, q) for i, q in labels if i in texts and crc(i, 5) != 0 and len((texts[i][0] or "").encode()) <= quality_classifier.TEXT_BYTES]
    model = quality_classifier.train([(texts[i][0] or "").encode() for i, _ in learn], np.array([q for _, q in learn]))
    scores = quality_classifier.Scorer(model)([(t or "").encode() for t, _ in texts.values()])
    assert np.allclose([got[i].score for i in texts], scores, atol=1e-5)  # learnt from exactly these rows


def test_op9(spark, texts):
    got = run(spark, "op9_token_files", texts, {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"})
    ids_of, at = encoded("byte_bpe_50k.json", 0), 0
    for i, (t, _) in texts.items():
        ids = ids_of(t)
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), ids_crc(ids))
        at += len(ids)
    assert set(got) == set(texts)
