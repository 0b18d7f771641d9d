"""Quality classifier: supervised subword embeddings.

Every white-space token contributes its hashed whole-word vector and the
hashed vectors of its character 3- to 5-grams (bytes, with boundary marks),
and every ordered pair of neighbouring tokens a hashed bigram vector. A
document is the average of all of them, followed by a softmax. Vectors and
output layer are trained together by numpy stochastic gradient descent on a
bounded sample of at most about ``sample_rows`` labelled rows (drawn by a hash
of doc_id, whole texts of at most ``TEXT_BYTES`` bytes, so the sample is
bounded in bytes too); documents with crc32(doc_id) mod 5 = 0 are never
learned from. Scoring is one pass over all rows without a shuffle: a token's
logits are the sum of its vectors' products with the output layer, so they are
computed once for each distinct token of a batch.

Defined cases: null or empty text scores from the bias alone; without labelled
rows of both classes every score is the share of label 1 (0.5 without any);
null labels are not learned; a document labelled 0 and 1 counts once for each,
and repeated label rows or repeated rows of a doc_id count once (of several
texts the least); repeated rows get equal scores; other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataframe.llm._common import id_crc_mod, release_memory, slices, text_buffer

BUCKETS = 1 << 16
DIM = 10
EPOCHS = 5
BATCH = 16
RATE = 40.0
SAMPLE_ROWS = 2400
#: Longer texts are not learned from (they are scored like others): with SAMPLE_ROWS the most bytes of a sample.
TEXT_BYTES = 1 << 17
_CACHE = 300_000
_P = np.uint64(0x9E3779B97F4A7C15)
_M = np.uint64(0xBF58476D1CE4E5B9)


def tokens(text: bytes) -> list[bytes]:
    return text.split()


def _bucket(hashed: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashed >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def word_hashes(words: list[bytes]) -> np.ndarray:
    h = np.array([zlib.crc32(w) for w in words], np.uint64) * _P
    return (h ^ (h >> np.uint64(32))) * _M


def bigrams(hashes: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of the ordered pairs of neighbouring word hashes."""
    d = (hashes[:-1] * _P + hashes[1:]) * _M
    return _bucket((d ^ (d >> np.uint64(29))) * _P, buckets)


def features(words: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words' features, word after word, and how many each has."""
    marked = [b"\x02" + w + b"\x03" for w in words]
    size = np.array([len(w) for w in marked], np.int64)
    raw = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64) + np.uint64(1)
    word_of = np.repeat(np.arange(len(words)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(raw))  # bytes from here to the word's end
    parts, owners = [np.array([zlib.crc32(w) for w in words], np.uint64) * _M], [np.arange(len(words))]
    h = raw * _P
    for n in (2, 3, 4, 5):
        h = h[: len(raw) - n + 1] * _P + raw[n - 1 :] if len(raw) >= n else h[:0]
        if n >= 3:
            ok = left[: len(h)] >= n
            parts.append((h[ok] ^ (h[ok] >> np.uint64(29)) ^ np.uint64(n)) * _M)
            owners.append(word_of[: len(h)][ok])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    hashed = np.concatenate(parts)[order]
    return _bucket(hashed, buckets), np.bincount(owner, minlength=len(words))


def _flat(counts: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Positions starts[i] .. starts[i] + counts[i] - 1, one run after another."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)


def train(texts: list[bytes], y: np.ndarray, seed: int = 7, buckets: int = BUCKETS, dim: int = DIM, epochs: int = EPOCHS) -> dict:
    """Output: {"logit": per bucket, difference of the two classes' logits; "bias"}."""
    share = float(np.mean(y)) if len(y) else 0.5
    if len(set(y.tolist())) < 2:
        p = min(max(share, 1e-3), 1 - 1e-3)
        return {"logit": np.zeros(buckets, np.float32), "bias": float(np.log(p / (1 - p))) if len(y) else 0.0}
    rng = np.random.default_rng(seed)
    vocab: dict[bytes, int] = {}
    doc_ids = [np.fromiter((vocab.setdefault(w, len(vocab)) for w in tokens(t)), np.int64) for t in texts]
    hashes = word_hashes(list(vocab))
    doc_words, doc_counts, doc_pairs, pair_counts = [], [], [], []
    for ids in doc_ids:
        for units, values, counts in ((ids, doc_words, doc_counts), (bigrams(hashes[ids], buckets), doc_pairs, pair_counts)):
            u, c = np.unique(units, return_counts=True)
            values.append(u)
            counts.append(c)
    del doc_ids
    feats, n_feats = features(list(vocab), buckets) if vocab else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    first = np.cumsum(n_feats) - n_feats
    emb = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    out = np.zeros((2, dim), np.float32)
    bias = np.zeros(2, np.float32)
    steps, step = epochs * -(-len(texts) // BATCH), 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), BATCH):
            rate = RATE * (1 - step / steps)
            step += 1
            docs = [d for d in order[lo : lo + BATCH] if len(doc_words[d])]
            if not docs:
                continue
            words, where = np.unique(np.concatenate([doc_words[d] for d in docs]), return_inverse=True)
            sizes = np.array([len(doc_words[d]) for d in docs])
            weight = np.concatenate([doc_counts[d] for d in docs]).astype(np.float32)
            own = np.repeat(np.arange(len(docs)), sizes)
            at = feats[_flat(n_feats[words], first[words])]
            heads = np.cumsum(n_feats[words]) - n_feats[words]
            vec = np.add.reduceat(emb[at], heads, axis=0)
            pairs = np.concatenate([doc_pairs[d] for d in docs])
            times = np.concatenate([pair_counts[d] for d in docs]).astype(np.float32)
            whose = np.repeat(np.arange(len(docs)), [len(doc_pairs[d]) for d in docs])
            total = np.bincount(own, weight * n_feats[words][where], minlength=len(docs)) + np.bincount(whose, times, minlength=len(docs))
            mix = np.zeros((len(docs), len(words)), np.float32)
            mix[own, where] = weight
            mix /= total[:, None]
            times /= total[whose]
            near = np.zeros((len(docs), dim), np.float32)
            np.add.at(near, whose, emb[pairs] * times[:, None])
            doc = mix @ vec + near
            z = doc @ out.T + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            g = p
            g[np.arange(len(docs)), y[docs]] -= 1.0
            g /= len(docs)
            d_doc = g @ out
            d_vec = mix.T @ d_doc
            out -= 0.1 * rate * (g.T @ doc)
            bias -= 0.01 * rate * g.sum(axis=0)
            np.subtract.at(emb, at, np.repeat(rate * d_vec, n_feats[words], axis=0))
            np.subtract.at(emb, pairs, rate * times[:, None] * d_doc[whose])
    logits = emb @ (out[1] - out[0])
    return {"logit": logits.astype(np.float32), "bias": float(bias[1] - bias[0])}


class Scorer:
    def __init__(self, model: dict):
        self.logit, self.bias = model["logit"], model["bias"]
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.table, self.hashes = np.zeros((0, 2), np.float64), np.zeros(0, np.uint64)

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        found = [tokens(t) for t in texts]
        n = np.array([len(f) for f in found], np.int64)
        flat = [w for f in found for w in f]
        z = np.full(len(texts), self.bias)
        if flat:
            if len(self.known) > _CACHE:
                self._clear()
            at = np.fromiter(map(self.known.get, flat, repeat(-1)), np.int64, len(flat))
            miss = np.flatnonzero(at < 0)
            if len(miss):
                new = list(dict.fromkeys(flat[i] for i in miss.tolist()))
                feats, k = features(new, len(self.logit))
                sums = np.add.reduceat(self.logit[feats].astype(np.float64), np.cumsum(k) - k)
                self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
                self.table = np.concatenate([self.table, np.stack([sums, k], axis=1)])
                self.hashes = np.concatenate([self.hashes, word_hashes(new)])
                at[miss] = [self.known[flat[i]] for i in miss.tolist()]
            each = self.table[at]
            if len(at) > 1:  # a pair counts with its first word
                inside = np.ones(len(at), bool)
                inside[np.cumsum(n)[n > 0] - 1] = False
                each[:-1, 0] += self.logit[bigrams(self.hashes[at], len(self.logit))] * inside[:-1]
                each[:, 1] += inside
            some = n > 0
            s = np.add.reduceat(each, (np.cumsum(n) - n)[some], axis=0)
            z[some] += s[:, 0] / s[:, 1]
        return 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))


def training_rows(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The bounded labelled sample: doc_id, text, quality, one row for each label of a document.

    Only the sampled labels (at most about ``sample_rows``, whatever the input)
    are broadcast, so no text but the sample's is shuffled.
    """
    own = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (id_crc_mod("doc_id", 5) != 0)).select(F.col("doc_id").cast("long").alias("label_id"), (F.col("quality") > 0).cast("int").alias("quality")).distinct()
    n = own.count()
    draw = (F.pmod(F.xxhash64(F.lit("quality"), F.col("label_id")), F.lit(1 << 30)) / F.lit(float(1 << 30))) < F.lit(min(1.0, sample_rows / max(n, 1)))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= TEXT_BYTES)
    return texts.join(F.broadcast(own.filter(draw)), F.col("doc_id") == F.col("label_id")).groupBy("doc_id", "quality").agg(F.min("text").alias("text")).select("doc_id", "text", "quality")


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> dict:
    """Train in one task on the bounded sample; only the model comes back."""

    def run(batches):
        t = pa.Table.from_batches(list(batches), pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("quality", pa.int32())])).sort_by([("doc_id", "ascending"), ("quality", "ascending")])
        texts = [(x or "").encode() for x in t.column("text").to_pylist()]
        model = train(texts, (t.column("quality").to_numpy() > 0).astype(np.int64))
        yield pa.record_batch([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    rows = training_rows(docs, labels, sample_rows).repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(bytes(rows[0]["model"])) if rows else train([], np.zeros(0, np.int64))


def classify(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id and score (0 to 1, higher: label 1 likelier) of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        score = Scorer(held.value)
        for whole in batches:
            for b in slices(whole, 1, 512):
                data, off = text_buffer(b.column(1))
                yield pa.record_batch([b.column(0), pa.array(score([data[x:y] for x, y in zip(off[:-1].tolist(), off[1:].tolist())]))], names=["doc_id", "score"])
        del score
        release_memory()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
