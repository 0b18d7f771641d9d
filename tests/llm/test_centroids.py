import hashlib
import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from strataframe.llm import centroids as C


def brute(rows, k, rounds, seed, dim, scale=1024):
    kept = [(i, [min(max(math.floor(scale * x), -C.LARGEST), C.LARGEST) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    cents = [list(v) for _, v in sorted(kept, key=lambda r: (name(r[0]), np.array(r[1], "<i4").tobytes()))[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((dist(v, c), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        for j in range(len(cents)):
            mine = [v for (_, v), a in zip(kept, at) if a == j]
            if mine:
                cents[j] = [sum(x) // len(mine) for x in zip(*mine)]
    last = [(i, *near(v)) for i, v in kept]
    sums = [sum(d for _, d, j in last if j == n) for n in range(len(cents))]
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, j, d, sums[j], sum(sums), shas[j]) for i, d, j in last), key=repr)


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, 0, "n") for i, v in rows], "vec_id long, embedding array<double>, cluster int, norms string").repartition(parts)


def test_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    middles = rng.normal(0, 3, (6, 8))
    rows = [(i, (middles[i % 6] + rng.normal(0, 0.6, 8)).tolist()) for i in range(400)]
    rows += [(500 + i, rows[0][1]) for i in range(150)] + [(7, rows[7][1]), (7, rows[8][1]), (None, rows[3][1]), (None, None), (600, None), (601, []), (602, [1.0] * 7), (603, [1.0] * 7 + [None]), (604, [float("nan")] * 8), (605, [math.inf] * 8), (606, [1e9, -1e30] + [0.0] * 6), (607, [-0.0001] * 8)]
    for k, rounds in ((8, 10), (3, 0), (1, 2)):
        got = sorted(map(tuple, C.cluster(frame(spark, rows), k, rounds, 3, dim=8, blocks=4).collect()), key=repr)
        assert got == brute(rows, k, rounds, 3, 8)


def test_few_equal_and_no_vectors(spark):
    rows = [(i, [1.0, 2.0]) for i in range(5)]
    got = C.cluster(frame(spark, rows), dim=2, blocks=1).collect()
    assert {r.cluster for r in got} == {0} and {r.distance for r in got} == {0} and sorted(map(tuple, got)) == brute(rows, 8, 10, 3, 2)
    none = C.cluster(frame(spark, [(1, None), (2, [1.0])]), dim=2, blocks=1)
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.sampled_from([1, 300, C.LARGEST]), st.integers(1, 8))
def test_screening_never_loses_the_nearest(seed, size, blocks):
    rng = np.random.default_rng(seed)
    x = rng.integers(-size, size + 1, (60, 8)).astype("<i4")
    cents = np.concatenate([x[:5], rng.integers(-size, size + 1, (4, 8))])
    number, best, _ = C.Screen(cents.tolist(), blocks).nearest(x, C.block_norms(x, blocks))
    d = ((x[:, None, :].astype(object) - cents[None].astype(object)) ** 2).sum(axis=2)
    assert number.tolist() == [int(np.argmin(r)) for r in d] and best.tolist() == d.min(axis=1).tolist()


def test_screening_saves_most_distances_where_blocks_differ():
    rng = np.random.default_rng(2)
    cents = np.zeros((8, 64), int)
    for j in range(8):
        cents[j, 8 * j : 8 * j + 8] = 1000
    x = (cents[rng.integers(0, 8, 5000)] + rng.integers(-60, 61, (5000, 64))).astype("<i4")
    _, _, measured = C.Screen(cents.tolist(), 8).nearest(x, C.block_norms(x, 8))
    assert measured < 1.05 * len(x)
