import zlib

import numpy as np

from strataframe.llm import quality_classifier as Q
from tests.llm import docs as D


def test_held_out_accuracy(spark):
    rows = [D.row(i, D.prose(i) if i % 3 else " ".join(w.upper() + "!!" for w in D.prose(i).split())) for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(200)] + [(3, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    df = D.frame(spark, rows)
    model = Q.fit(df, labels)
    held = [r for r in Q.classify(df, model).collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert held and np.mean([(r.score >= 0.3) == (r.doc_id % 3 > 0) for r in held]) > 0.95
    learnt = {r.doc_id for r in Q.training_rows(df, labels).collect()}
    assert learnt and all(zlib.crc32(str(i).encode()) % 5 for i in learnt)


def test_scores_equal_the_plain_average():
    model = {"logit": np.random.default_rng(0).normal(size=Q.BUCKETS).astype(np.float32), "bias": 0.25}
    text = b"one two two three"
    z = []
    words = text.split()
    for w in words:
        f, _ = Q.features([w])
        z += model["logit"][f].tolist()
    for pair in zip(words, words[1:]):
        z += model["logit"][Q.bigrams(Q.word_hashes(list(pair)))].tolist()
    assert abs(Q.Scorer(model)([text, b""])[0] - 1 / (1 + np.exp(-(np.mean(z) + 0.25)))) < 1e-6
    assert abs(Q.Scorer(model)([b""])[0] - 1 / (1 + np.exp(-0.25))) < 1e-12
    many = [b"a b", b"", b"c", b"one two two three", b"x"]
    alone = [Q.Scorer(model)([t])[0] for t in many]
    assert np.allclose(Q.Scorer(model)(many), alone, atol=1e-9)  # pairs do not cross texts


def test_bigrams_are_ordered_pairs():
    h = Q.word_hashes([b"a", b"a", b"b", b"b", b"a", b"c"])
    assert len(set(Q.bigrams(h).tolist())) == 5


def test_training_is_gradient_descent_on_the_cross_entropy():
    """The same steps by finite differences of the loss, one document and one feature after another."""
    rng = np.random.default_rng(5)
    words = [b"ab", b"cde", b"fghij", b"k", b"lmn", b"opq"]
    texts = [b" ".join(rng.choice(words, rng.integers(0, 7))) for _ in range(20)]
    y, buckets, dim, epochs, seed = rng.integers(0, 2, 20), 23, 3, 1, 11

    def features_of(text):
        w = text.split()
        return [f for x in w for f in Q.features([x], buckets)[0].tolist()] + [int(Q.bigrams(Q.word_hashes(list(p)), buckets)[0]) for p in zip(w, w[1:])]

    def loss(theta, docs):
        emb, out, bias = theta[: buckets * dim].reshape(buckets, dim), theta[buckets * dim : -2].reshape(2, dim), theta[-2:]
        total = 0.0
        for d in docs:
            z = np.mean([emb[f] for f in features_of(texts[d])], axis=0) @ out.T + bias
            total += np.log(np.exp(z).sum()) - z[y[d]]
        return total / len(docs)

    draw = np.random.default_rng(seed)
    theta = np.concatenate([draw.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32).ravel(), np.zeros(2 * dim + 2)]).astype(np.float64)
    scale = np.concatenate([np.full(buckets * dim, 1.0), np.full(2 * dim, 0.1), np.full(2, 0.01)])
    steps, order = -(-len(texts) // Q.BATCH), draw.permutation(len(texts))
    for step in range(steps):
        docs = [d for d in order[step * Q.BATCH : (step + 1) * Q.BATCH] if texts[d].split()]
        grad = np.array([(loss(theta + e, docs) - loss(theta - e, docs)) / 2e-5 for e in np.eye(len(theta)) * 1e-5])
        theta = theta - Q.RATE * (1 - step / steps) * scale * grad
    emb, out = theta[: buckets * dim].reshape(buckets, dim), theta[buckets * dim : -2].reshape(2, dim)
    model = Q.train(texts, y, seed, buckets, dim, epochs)
    assert np.allclose(model["logit"], emb @ (out[1] - out[0]), atol=2e-3) and abs(model["bias"] - (theta[-1] - theta[-2])) < 1e-3


def test_long_texts_are_not_learned_from(spark):
    df = D.frame(spark, [D.row(1, "x " * Q.TEXT_BYTES), D.row(2, None), D.row(3, D.prose(3))])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in (1, 2, 3)], "doc_id long, quality int, toxic int")
    assert sorted(r.doc_id for r in Q.training_rows(df, labels).collect()) == [2, 3]
    assert Q.classify(df, Q.fit(df, labels)).count() == 3


def test_repeated_rows_do_not_grow_the_sample(spark):
    df = D.frame(spark, [D.row(1, D.prose(1))] * 50 + [D.row(1, D.prose(2)), D.row(2, D.prose(3))])
    labels = spark.createDataFrame([(1, 1, 0)] * 70 + [(1, 0, 0), (2, 5, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    got = sorted((r.doc_id, r.quality, r.text) for r in Q.training_rows(df, labels).collect())
    least = min(D.prose(1), D.prose(2))
    assert got == [(1, 0, least), (1, 1, least), (2, 1, D.prose(3))]


def test_one_class_and_awkward_rows(spark):
    df = D.awkward(spark)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1, 12)], "doc_id long, quality int, toxic int")
    got = Q.classify(df, Q.fit(df, labels))
    assert got.count() == df.count() and all(0 <= r.score <= 1 for r in got.collect())
    none = Q.fit(df, labels.filter("false"))
    assert {r.score for r in Q.classify(df, none).collect()} == {0.5}
    assert Q.classify(D.empty(spark), none).count() == 0
