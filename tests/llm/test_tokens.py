"""Packing, token files and SentencePiece, against their libraries."""

import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from strataframe.llm import _tokens as T
from strataframe.llm import packing as K
from strataframe.llm import sentencepiece_codec as S
from strataframe.llm import token_files as B
from tests.llm import docs as D

ALPHABET = list("aAbé ß\n\t'’.,!&0189sStTrRlL  ̀İſKÿØ　\xa0中文😀-_<|>\x85\x1c\x0b\r\x00▁")
WORD, BYTE, PIECE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))


def library(path):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def noise(n, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 25))) for _ in range(n)] + ["", None, "\n", "a\n\n b  c d's <|endoftext|>", "x" * 3000]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_chunked_encoding_equals_the_library(path, monkeypatch):
    monkeypatch.setattr(T.ChunkTable, "cache", 2000)  # forgets along the way
    enc, lib = T.ChunkEncoder(path, 7), library(path)
    for seed in range(4):
        texts = noise(1500, seed)
        ids, n = enc.encode_column(pa.array(texts, pa.string()))
        at = 0
        for t, k in zip(texts, n.tolist()):
            assert ids[at : at + k].tolist() == lib.encode(t or "", add_special_tokens=False).ids + [7]
            at += k


def test_packing_is_whole_and_tight(spark):
    df = D.awkward(spark)
    got = K.pack(df, WORD, capacity=256, per_partition=5).toPandas()
    lib = library(WORD)
    want = []
    for r in df.collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids + [1]
        want += [(r.doc_id, p, s, len(ids[s : s + 256]), zlib.crc32(np.array(ids[s : s + 256], "<u4").tobytes())) for p, s in enumerate(range(0, len(ids), 256))]
    key = lambda x: tuple(-1 if v is None or v != v else int(v) for v in x)
    assert sorted(map(key, want)) == sorted(map(key, got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)))
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == (g.length.cumsum() - g.length).tolist() and g.length.sum() <= 256
    assert K.pack(D.empty(spark), WORD).count() == 0


def test_packing_goes_on_until_the_gap_stops_shrinking(spark):
    rng = random.Random(4)
    df = D.frame(spark, [D.row(i, "word " * rng.randint(20, 180)) for i in range(600)])
    got = K.pack(df, WORD, capacity=256, per_partition=40).toPandas()
    assert sorted(got.doc_id) == list(range(600)) and (got.groupby("sequence_id").length.sum() <= 256).all()
    assert (got.bound <= got.bins).all() and (got.sequence_id.to_numpy() >> 56).max() >= 1  # more than one round
    whole = K.lower_bound(got.length.to_numpy(), 256)
    assert got.sequence_id.nunique() <= 1.05 * whole


def test_bounds_never_exceed_an_optimum():
    rng = random.Random(9)
    for _ in range(300):
        c = rng.choice([10, 31, 100])
        bins = [sorted(rng.sample(range(1, c), k=rng.randint(0, 3))) for _ in range(rng.randint(1, 8))]
        items = [b - a for cuts in bins for a, b in zip([0, *cuts], [*cuts, c])]  # packs into len(bins) full bins
        lengths = np.array(items)
        bound = K.lower_bound(lengths, c)
        own, offset, used = K.best_fit(lengths, c)
        assert bound == len(bins) <= used
        assert (np.bincount(own, lengths) <= c).all()
    assert K.lower_bound(np.array([6, 6, 6, 5, 5]), 10) == 4  # the sum alone says 3


def test_token_files_round_trip(spark):
    df = D.awkward(spark)
    got = B.round_trip(df, BYTE).toPandas()
    lib = library(BYTE)
    rows = sorted(df.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    by_id = {}
    for r in rows:
        ids = lib.encode(r.text or "", add_special_tokens=False).ids + [0]
        by_id.setdefault(r.doc_id, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    got = got.sort_values("start")
    assert got.start.tolist() == (got.n_tokens.cumsum() - got.n_tokens).tolist()
    seen = {}
    for r in got.itertuples():
        seen.setdefault(None if r.doc_id != r.doc_id else int(r.doc_id), []).append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in seen.items()} == {k: sorted(v) for k, v in by_id.items()}
    ids = [int(x) for x in got.doc_id.dropna()]
    assert ids == sorted(ids)
    assert B.round_trip(D.empty(spark), BYTE).count() == 0


@pytest.mark.parametrize("kind", ["text", "constant", "noise", "wide"])
def test_images_are_lossless_and_checked(kind):
    rng = np.random.default_rng(3)
    for n in (1, 2, 1023, 1024, 1025, 9000):
        ids = {"text": rng.zipf(1.3, n) % 50000, "constant": np.zeros(n), "noise": rng.integers(0, 50000, n), "wide": rng.integers(0, 2**32, n)}[kind].astype(np.uint32)
        counts = np.array([n // 2, n - n // 2])
        image = B.pack_image(np.array([-5, 2**40]), counts, ids)
        d, c, back, nulls = B.unpack_image(image)
        assert (back == ids).all() and c.tolist() == counts.tolist() and d.tolist() == [-5, 2**40] and not nulls.any()
    if kind != "constant":  # there the last words hold next to nothing
        broken = bytearray(image)
        broken[-len(image) // 8] ^= 64
        with pytest.raises(ValueError):
            B.unpack_image(bytes(broken))


def test_order_0_adapts_in_each_block():
    rng = np.random.default_rng(1)
    blocks = [rng.choice(5000, 1024, p=rng.dirichlet(np.full(5000, 0.01))) for _ in range(40)]  # few ids a block, others in each
    ids = np.concatenate(blocks).astype(np.uint32)
    image = B.pack_image(np.array([1]), np.array([len(ids)]), ids)
    _, tally = np.unique(ids, return_counts=True)
    by_file = -(tally * np.log2(tally / len(ids))).sum() / 8
    payload = len(image) - 8 - int.from_bytes(image[4:8], "little")
    assert payload < 0.9 * by_file  # frequencies of the file alone cannot do that; a quarter of a block comes before its recount
    assert (B.unpack_image(image)[2] == ids).all()


def test_extreme_ids_and_hot_ids(spark):
    ids = [-(2**63), 2**63 - 1, 0, -1, None, None, 5, 5, 5]
    df = spark.createDataFrame([(i, f"text {k}") for k, i in enumerate(ids)], "doc_id long, text string")
    got = B.round_trip(df, BYTE).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, -(2**63), -1, 0, 5, 5, 5, 2**63 - 1]
    parts = B.write_images(spark.range(4000).selectExpr("cast(null as long) doc_id", "cast(id as string) text"), BYTE, 0)
    assert parts.select("part").distinct().count() > 1  # a hot null is split


def test_files_on_a_shared_folder(spark, tmp_path):
    images = B.write_images(D.awkward(spark), BYTE, 0)
    B.export_files(images, str(tmp_path))
    files = sorted(tmp_path.glob("*.sft"))
    assert files and sum(B.unpack_image(f.read_bytes())[1].sum() for f in files) == images.agg({"n_tokens": "sum"}).first()[0]


def test_sentencepiece_equals_the_library(spark):
    enc, dec = S.codec(PIECE)
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    rng = random.Random(1)
    texts = noise(1500) + ["".join(rng.choice("etaoinshr dlu") for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    ids, n = enc.encode_column(pa.array(texts, pa.string()))
    at = 0
    for t, k, back in zip(texts, n.tolist(), dec(ids, n)):
        assert ids[at : at + k].tolist() == lib.encode(t or "")
        assert back.decode() == (t or "").replace("▁", " ")
        at += k
    df = D.awkward(spark)
    assert S.round_trip(df, PIECE).filter("same").count() == df.count()
    there = S.decode(S.encode(df, PIECE), PIECE)
    assert sorted(str(r.text) for r in there.collect()) == sorted(str(r.text or "") for r in df.collect())
    assert S.round_trip(D.empty(spark), PIECE).count() == 0


def test_long_chunks_without_spaces(monkeypatch):
    monkeypatch.setattr(S, "_WINDOW", 64)
    enc, dec = S.codec(PIECE)
    enc._clear()
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    rng = random.Random(11)
    texts = ["".join(rng.choice("中文字符测试語言日本語한국어") for _ in range(3000)), "".join(rng.choice("ABCDEFabcdef0123456789+/") for _ in range(1500)), "a" * 1200, "the" * 400 + "😀" * 300, "x" * 257]
    ids, n = enc.encode_column(pa.array(texts))
    at = 0
    for t, k in zip(texts, n.tolist()):
        assert ids[at : at + k].tolist() == lib.encode(t)
        at += k
    parts = enc._parts("中文字符" * 100)
    assert "".join(parts) == "中文字符" * 100 and len(parts) > 100


def field(number, value):
    if isinstance(value, int):
        return bytes([number << 3, value])
    if isinstance(value, float):
        return bytes([number << 3 | 5]) + struct.pack("<f", value)
    return bytes([number << 3 | 2]) + bytes([len(value)]) + value


def test_unigram_viterbi_equals_the_library(tmp_path):
    rng = random.Random(7)
    pieces = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(60)} | set("abc") | {"▁", "▁a", "▁ab"}
    body = field(1, field(1, b"<unk>") + field(2, 0.0) + field(3, 2)) + field(1, field(1, b"<s>") + field(3, 3)) + field(1, field(1, b"</s>") + field(3, 3))
    for p in sorted(pieces):
        body += field(1, field(1, p.encode()) + field(2, -1.0 - rng.random() * 9))
    body += field(2, field(3, 1)) + field(3, field(1, b"identity") + field(3, 1) + field(4, 0) + field(5, 1))
    path = tmp_path / "unigram.model"
    path.write_bytes(body)
    lib = sentencepiece.SentencePieceProcessor(model_file=str(path))
    enc = S.PieceEncoder(str(path))
    texts = ["".join(rng.choice("abc ") for _ in range(rng.randint(0, 20))) for _ in range(400)]
    ids, n = enc.encode_column(pa.array(texts))
    at = 0
    for t, k in zip(texts, n.tolist()):
        got, want = ids[at : at + k].tolist(), lib.encode(t)
        total = lambda x: sum(enc.m.scores[i] for i in x)
        # the library adds over the whole text, so rounding may break a tie the other way
        assert got == want or (abs(total(got) - total(want)) < 1e-4 and [enc.m.pieces[i] for i in got] and "".join(enc.m.pieces[i] for i in got) == "".join(enc.m.pieces[i] for i in want))
        at += k


def test_other_models_are_refused():
    body = field(1, field(1, b"<unk>") + field(3, 2)) + field(1, field(1, b"x") + field(3, 4)) + field(2, field(3, 2)) + field(3, field(4, 0))
    with pytest.raises(ValueError):
        S.Model(body)
