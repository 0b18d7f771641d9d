"""Language identification by word-first backoff.

A known word scores by its per-language log frequency. A word that training
did not keep falls back to its longest known character n-grams (5 down to 1,
with word-boundary marks), scored by the mean of their log frequencies. A
document's score is the posterior of the summed, length-capped log
likelihoods.

The model is fitted on a bounded sample: about ``docs_per_lang`` labelled rows
of each of the ``max_langs`` languages with the most rows, drawn by a hash of
doc_id (whole texts), words and n-grams seen at least ``min_count`` times. That
bounds its size, which is checked before it is collected and broadcast. Every row is then scored in one pass without a
shuffle.

Defined cases: null text, or text without letters, is ``und`` with score 0, as
is everything when there are no labelled rows; null or empty lang is never
learned; rows with a null doc_id are scored but not learned from; repeated
rows get equal results; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataframe.llm._common import drop_stages, id_crc_mod, release_memory, slices, stage_mark, stage_table

WORD = re.compile(r"[^\W\d_]+")
ORDERS = (5, 4, 3, 2, 1)
DOCS_PER_LANG = 1200
MIN_COUNT = 2
#: Languages that are learned, the most frequent ones; a dirty lang column has many more values.
MAX_LANGS = 256
#: Cells (grams times languages) that the model may have, 4 bytes each; with more languages the model keeps the most frequent grams of each.
MODEL_CELLS = 64_000_000
#: Words of evidence beyond which a document's likelihood is scaled down.
EVIDENCE = 30.0
_CACHE = 200_000


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows whose crc32(doc_id) mod 4 is not 2 and whose lang is known."""
    return docs.filter(F.col("doc_id").isNotNull() & (id_crc_mod("doc_id", 4) != 2) & (F.coalesce(F.col("lang"), F.lit("")) != ""))


def grams(word: str, n: int) -> list[str]:
    w = f"^{word}$" if n > 1 else word
    return [w[i : i + n] for i in range(len(w) - n + 1)]


def _count(batches):
    found: dict[str, Counter] = {}
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if text:
                found.setdefault(lang, Counter()).update(WORD.findall(text.lower()))
    out = [[], [], [], []]
    for lang, words in found.items():
        by = {0: words}
        for n in ORDERS:
            c = by[n] = Counter()
            for w, k in words.items():
                for g in grams(w, n):
                    c[g] += k
        for n, c in by.items():
            out[0] += [lang] * len(c)
            out[1] += [n] * len(c)
            out[2] += list(c)
            out[3] += list(c.values())
    yield pa.record_batch([pa.array(out[0], pa.string()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.string()), pa.array(out[3], pa.int64())], names=["lang", "n", "gram", "k"])
    del found, out
    release_memory()


class Model:
    """langs; rows[n][gram] -> row of ``logs`` (one column a language). n = 0: words."""

    def __init__(self, langs: list[str], rows: list[tuple[str, int, str, int]]):
        self.langs = langs
        at = {lang: i for i, lang in enumerate(langs)}
        self.rows: dict[int, dict[str, int]] = {n: {} for n in (0, *ORDERS)}
        owner, col, k, order = [], [], [], []
        size = 0
        for lang, n, g, count in rows:
            own = self.rows[n]
            if g not in own:
                own[g] = size
                order.append(n)
                size += 1
            owner.append(own[g])
            col.append(at[lang])
            k.append(count)
        counts = np.zeros((size, len(langs)))
        np.add.at(counts, (owner, col), k)
        order = np.array(order, np.int64)
        self.logs = np.zeros((size, len(langs)), np.float32)
        for n in (0, *ORDERS):
            mine = order == n
            if mine.any():
                c = counts[mine] + 0.1
                self.logs[mine] = np.log(c / c.sum(axis=0))

    def score(self, word: str) -> np.ndarray:
        at = self.rows[0].get(word)
        if at is not None:
            return self.logs[at]
        for n in ORDERS:
            own = self.rows[n]
            hits = [r for r in map(own.get, grams(word, n)) if r is not None]
            if hits:
                return self.logs[hits].mean(axis=0)
        return np.zeros(len(self.langs), np.float32)


def fit(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG, min_count: int = MIN_COUNT, max_langs: int = MAX_LANGS) -> Model:
    """Count words and n-grams of the bounded sample on the executors."""
    train = training_rows(docs).select(F.col("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    most = train.groupBy(F.col("lang").alias("own_lang")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "own_lang").limit(max_langs)
    langs = sorted((r["own_lang"], r["n"]) for r in most.collect())
    if not langs:
        return Model([], [])
    # the share of each language's rows that goes into the sample: at most ``max_langs`` rows to broadcast
    shares = docs.sparkSession.createDataFrame([(lang, min(1.0, docs_per_lang / n)) for lang, n in langs], "own_lang string, share double")
    draw = (F.pmod(F.xxhash64(F.lit("langid"), F.col("doc_id")), F.lit(1 << 30)) / F.lit(float(1 << 30))) < F.col("share")
    sample = train.join(F.broadcast(shares), F.col("lang") == F.col("own_lang")).filter(draw).select("lang", "text")
    counted = sample.mapInArrow(_count, "lang string, n int, gram string, k long")
    before = stage_mark()
    kept = stage_table(counted.groupBy("lang", "n", "gram").agg(F.sum("k").alias("k")).filter(F.col("k") >= min_count), "langid-model")
    most = MODEL_CELLS // len(langs)
    if kept.count() > most:
        by_count = Window.partitionBy("lang", "n").orderBy(F.col("k").desc(), "gram")
        kept = kept.withColumn("place", F.row_number().over(by_count)).filter(F.col("place") <= max(1, most // (len(langs) * (1 + len(ORDERS))))).drop("place")
    rows = kept.toArrow()
    drop_stages(docs.sparkSession, before, stage_mark())
    order = rows.sort_by([("lang", "ascending"), ("n", "ascending"), ("gram", "ascending")])
    return Model([lang for lang, _ in langs], list(zip(*(order.column(c).to_pylist() for c in ("lang", "n", "gram", "k")))))


class Scorer:
    """Scores batches of texts; remembers the rows of words it has met."""

    def __init__(self, model: Model):
        self.model, self.width = model, len(model.langs) + 1
        self._clear()

    def _clear(self):
        self.known: dict[str, int] = {}
        self.table = np.zeros((1024, self.width), np.float32)

    def _learn(self, words) -> None:
        need = len(self.known) + len(words)
        if need > len(self.table):
            grown = np.zeros((max(need, 2 * len(self.table)), self.width), np.float32)
            grown[: len(self.known)] = self.table[: len(self.known)]
            self.table = grown
        for w in words:
            at = self.known[w] = len(self.known)
            if w.isalpha() or any(c.isalpha() for c in w):
                self.table[at, :-1] = self.model.score(w)
                self.table[at, -1] = 1.0

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language (-1: und) and score of each text."""
        found = [WORD.findall(t.lower()) if t else [] for t in texts]
        n = np.array([len(f) for f in found], np.int64)
        best, score = np.full(len(texts), -1), np.zeros(len(texts))
        total = int(n.sum())
        if not total or self.width == 1:
            return best, score
        flat = [w for f in found for w in f]
        if len(self.known) > _CACHE:
            self._clear()
        at = np.fromiter(map(self.known.get, flat, repeat(-1)), np.int64, total)
        new = np.flatnonzero(at < 0)
        if len(new):
            self._learn(dict.fromkeys(flat[i] for i in new.tolist()))
            at[new] = [self.known[flat[i]] for i in new.tolist()]
        some = n > 0
        starts = (np.cumsum(n) - n)[some]
        sums = np.add.reduceat(self.table[at], starts, axis=0, dtype=np.float64)
        words = sums[:, -1]
        logs = sums[:, :-1] * np.minimum(1.0, EVIDENCE / np.maximum(words, 1.0))[:, None]
        p = np.exp(logs - logs.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        ok = words > 0
        best[some] = np.where(ok, p.argmax(axis=1), -1)
        score[some] = np.where(ok, p.max(axis=1), 0.0)
        return best, score


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        score = Scorer(held.value)
        names = np.array([*held.value.langs, "und"], object)
        for whole in batches:
            for b in slices(whole, 1, 512):
                best, p = score(b.column(1).to_pylist())
                yield pa.record_batch([b.column(0), pa.array(names[best], pa.string()), pa.array(p)], names=["doc_id", "lang_pred", "score"])
        del score
        release_memory()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` with a language (not ``und``), columns unchanged."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        score = Scorer(held.value)
        for whole in batches:
            for b in slices(whole, at, 512):
                best, _ = score(b.column(at).cast(pa.string()).to_pylist())
                yield b.filter(pa.array(best >= 0))
        del score
        release_memory()

    return docs.mapInArrow(run, docs.schema)
