import random
import zlib

from strataframe.llm import langid as L
from tests.llm import docs as D

EN = "the house and the garden with a small window near that river".split()
DE = "das haus und der garten mit einem kleinen fenster bei jenem fluss".split()


def corpus(spark, n=80):
    rows = []
    for i in range(n):
        words, lang = (EN, "en") if i % 2 else (DE, "de")
        rows.append(D.row(i, " ".join(words[(i * 3 + j * (1 + i % 4)) % len(words)] for j in range(25)), lang))
    return D.frame(spark, rows)


def test_held_out_accuracy_and_backoff(spark):
    df = corpus(spark)
    model = L.fit(df)
    got = {r.doc_id: r for r in L.identify(df, model).collect()}
    held = [i for i in range(80) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and all(got[i].lang_pred == ("en" if i % 2 else "de") for i in held)
    unseen = L.identify(D.frame(spark, [D.row(1, "gartenhaus fensterfluss"), D.row(2, "housewindow thatriver")]), model).collect()
    assert {r.doc_id: r.lang_pred for r in unseen} == {1: "de", 2: "en"}


def test_only_the_allowed_rows_are_learnt(spark):
    df = corpus(spark)
    ids = {r.doc_id for r in L.training_rows(df).collect()}
    assert ids and all(zlib.crc32(str(i).encode()) % 4 != 2 for i in ids)


def test_awkward_rows(spark):
    df = D.awkward(spark)
    model = L.fit(df)
    got = L.identify(df, model)
    assert got.count() == df.count()
    und = {r.doc_id for r in got.filter("lang_pred = 'und'").collect()}
    assert {8, 9, 10} <= und
    assert all(0 <= r.score <= 1 for r in got.collect())
    none = L.fit(D.empty(spark))
    assert {r.lang_pred for r in L.identify(df, none).collect()} == {"und"}
    assert L.identify(D.empty(spark), model).count() == 0
    kept = L.keep_identified(df, model)
    assert kept.columns == df.columns and kept.filter("text IS NULL OR trim(text) = ''").count() == 0


def test_score_matches_the_plain_formula(spark):
    model = L.Model(["a", "b"], [("a", 0, "x", 5), ("b", 0, "x", 2), ("a", 1, "y", 1), ("a", 1, "q", 9), ("b", 1, "y", 9), ("b", 1, "q", 1)])
    best, score = L.Scorer(model)(["x x", "y", "12", None, "zz"])
    assert best.tolist() == [0, 1, -1, -1, best[4]] and score[2] == 0
    assert abs(score[4] - 0.5) < 1e-6  # nothing known: no preference


def test_a_dirty_lang_column_is_bounded(spark):
    rows = [(r.doc_id, r.text, r.lang) for r in corpus(spark).collect()] + [(1000 + i, "x y z", f"dirt{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert L.fit(df, max_langs=2).langs == ["de", "en"]


def test_only_undetermined_rows_go(spark):
    model = L.Model(["a", "b", "c", "d"], [(x, 0, w, 3) for x in "abcd" for w in ("x", x * 3)] + [(x, 1, x, 9) for x in "abcd"])
    df = D.frame(spark, [D.row(1, "x"), D.row(2, "zz"), D.row(3, "aaa aaa"), D.row(4, "12 34"), D.row(5, None)])
    found = {r.doc_id: r for r in L.identify(df, model).collect()}
    assert found[1].score < 0.5 and found[2].score < 0.5  # words of all languages, words of none
    kept = {r.doc_id for r in L.keep_identified(df, model).collect()}
    assert kept == {i for i, r in found.items() if r.lang_pred != "und"} == {1, 2, 3}


def test_many_languages_bound_the_model(spark, monkeypatch):
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz"
    own = {f"l{k}": ["".join(rng.choices(letters, k=6)) for _ in range(40)] for k in range(30)}
    rows = [D.row(100 * k + i, " ".join(rng.choices(words, k=30)), lang) for k, (lang, words) in enumerate(own.items()) for i in range(12)]
    monkeypatch.setattr(L, "MODEL_CELLS", 30 * 30 * 6 * 20)
    model = L.fit(D.frame(spark, rows))
    assert len(model.langs) == 30 and model.logs.size <= L.MODEL_CELLS
    got = {r.doc_id: r.lang_pred for r in L.identify(D.frame(spark, rows), model).collect()}
    assert sum(got[r[0]] == r[2] for r in rows) > 0.95 * len(rows)
