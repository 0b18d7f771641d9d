import os
import random
from collections import defaultdict

import numpy as np
import pytest

from strataframe.llm import jaccard_join as J
from strataframe.llm.components import components
from tests.llm import docs as D


def shingle_set(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows, threshold=0.8):
    sets = [(i, shingle_set(t)) for i, t in rows if i is not None]
    links, root = defaultdict(int), {}
    near = defaultdict(set)
    for a, (i, s) in enumerate(sets):
        for j, u in sets[:a]:
            if s and u and len(s & u) / len(s | u) >= threshold:
                links[i] += 1
                links[j] += 1
                near[i].add(j)
                near[j].add(i)
    for i, _ in sets:
        seen, todo = {i}, [i]
        while todo:
            for n in near[todo.pop()]:
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        root[i] = min(seen)
    return root, links


def edited(words, rng, n):
    w = list(words)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"z{rng.randrange(999)}"
    return " ".join(w)


def corpus(seed):
    rng = random.Random(seed)
    rows, i = [], 0
    for g in range(12):
        own = [f"w{rng.randrange(400)}" for _ in range(rng.choice([30, 80, 200]))]
        for _ in range(rng.choice([1, 2, 9])):
            rows.append((i, edited(own, rng, rng.choice([0, 0, 1, 2, 5]))))
            i += 1
    return rows + [(i, "a b c"), (i + 1, "A B c"), (i + 2, "a b d"), (i + 3, ""), (i + 4, None)]


@pytest.mark.parametrize("block,crowd,hot", [(256, 512, 100_000), (3, 2, 100_000), (256, 512, 2)])
def test_matches_brute_force(spark, monkeypatch, block, crowd, hot):
    monkeypatch.setattr(J, "BLOCK", block)
    monkeypatch.setattr(J, "CROWD", crowd)
    monkeypatch.setattr(J, "HOT", hot)
    rows = corpus(5)
    got = J.jaccard_classes(D.frame(spark, [D.row(i, t) for i, t in rows])).collect()
    root, links = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r.class_id, r.n_links) == (root[r.doc_id], links[r.doc_id])


def test_blocks_are_sized_by_shingles_too(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_SHINGLES", 150)
    rows = corpus(7)
    got = {r.doc_id: (r.class_id, r.n_links) for r in J.jaccard_classes(D.frame(spark, [D.row(i, t) for i, t in rows])).collect()}
    root, links = brute(rows)
    assert got == {i: (root[i], links[i]) for i, _ in rows}


def group_of(rng, sims, values=J.TREES * J.DEPTH):
    """Signatures of a centre and of members that agree with it in these shares."""
    centre = rng.integers(0, 1 << 16, values).astype(np.uint16)
    out = [centre]
    for s in sims:
        m = centre.copy()
        other = rng.random(values) >= s
        m[other] = rng.integers(0, 1 << 16, other.sum())
        out.append(m)
    return np.array(out)


def walked(sig, tree, start, **kw):
    label = sig[:, tree * J.DEPTH : (tree + 1) * J.DEPTH]
    group = np.flatnonzero((label[:, :start] == label[0, :start]).all(axis=1))
    order = group[np.lexsort(label[group][:, ::-1].T)]
    return order, J.Walk(order, label[order][:, start:], sig[order], start, J.TREES, 0.8, J.TARGET_RECALL, **kw).run()


def test_prefixes_are_shortened_where_candidates_are_few_or_weak():
    rng = np.random.default_rng(3)
    base = J.first_depth(0.8, J.TARGET_RECALL)
    sig = group_of(rng, [0.98] * 300)
    order, w = walked(sig, 0, base - 1)
    assert len(order) > 200 and (w.stopped == J.DEPTH).mean() > 0.7  # many strong candidates: the prefix stays long
    sig = group_of(rng, [0.99])
    sig[1, : J.DEPTH] = sig[0, : J.DEPTH]
    _, w = walked(sig, 0, base - 1)
    assert (w.stopped <= base).all()  # one candidate: one unseen link at the threshold weighs as much, up to the base depth
    sig = np.repeat(sig[:1], 3, axis=0)
    sig[1, -32:] += 1  # agree in 128 of 160 values with the first
    sig[2, -64:-32] += 1
    _, w = walked(sig, 0, base - 1)
    assert (w.stopped < base).all()  # weak candidates: below the base depth


def test_pairs_that_part_late_are_found_at_shorter_prefixes():
    rng = np.random.default_rng(4)
    base = J.first_depth(0.8, J.TARGET_RECALL)
    sig = group_of(rng, [0.95])
    sig[1, :base] = sig[0, :base]
    sig[1, base : J.DEPTH] = sig[0, base : J.DEPTH] + 1  # they part after the base depth
    order, w = walked(sig, 0, base - 1)
    assert [(a.tolist(), b.tolist()) for a, b in w.links if len(a)] == [([1], [0])]


@pytest.mark.parametrize("crowd", [512, 20])
def test_walk_joins_what_is_near(monkeypatch, crowd):
    monkeypatch.setattr(J, "CROWD", crowd)
    rng = np.random.default_rng(5)
    sig = np.concatenate([group_of(rng, [0.93] * 40), group_of(rng, [0.93] * 40)])
    edges = []
    for tree in range(J.TREES):
        sig[:, tree * J.DEPTH : tree * J.DEPTH + 4] = sig[0, :4]  # two unrelated groups in one node
        order, w = walked(sig, tree, 4)
        assert len(order) == 82
        edges += [(order[a], order[b]) for x, y in w.links for a, b in zip(x, y)]
    assert all((a < 41) == (b < 41) for a, b in edges)
    label = list(range(82))
    for _ in range(8):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert set(label) == {0, 41}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no driver tables")
def test_recall_on_the_driver_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sets = {r.doc_id: shingle_set(r.text) for r in docs.collect()}
    by = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            by[g].append(i)
    common = defaultdict(int)
    for ids in by.values():
        for a in ids:
            for b in ids:
                common[a, b] += a < b
    want = defaultdict(int)
    for (a, b), c in common.items():
        if a < b and c / (len(sets[a]) + len(sets[b]) - c) >= 0.8:
            want[a] += 1
            want[b] += 1
    got = {r.doc_id: r.n_links for r in J.jaccard_classes(docs).collect()}
    assert all(n <= want[i] for i, n in got.items())
    assert sum(got.values()) >= 0.999 * sum(want.values()) > 0


def test_awkward_rows_and_representatives(spark):
    df = D.awkward(spark)
    assert J.jaccard_classes(df).count() == df.count()
    assert J.jaccard_classes(D.empty(spark)).count() == 0
    kept = J.keep_one_per_class(df)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == df.columns and 13 not in ids and 14 not in ids and {8, 9, 10} <= set(ids)


def test_a_copy_does_not_take_other_texts_of_its_id_along(spark):
    one, two = D.prose(1), D.prose(4, 90)
    schema = "__gone_id string, row long, doc_id long, text string, gone int, c1 int"
    rows = [(1, one), (2, one + " more"), (2, two), (3, "words of its own here in this text"), (None, one), (None, one), (None, None)]
    df = spark.createDataFrame([("x", 0, i, t, 1, 2) for i, t in rows], schema)
    kept = J.keep_one_per_class(df)
    assert kept.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    assert got == sorted([(1, one), (2, two), (3, rows[3][1]), (None, None)], key=repr)


def test_depth_is_the_longest_that_reaches_the_recall():
    d = J.first_depth(0.8, J.TARGET_RECALL)
    assert J.recall_at(0.8, d) >= J.TARGET_RECALL and (d == J.DEPTH or J.recall_at(0.8, d + 1) < J.TARGET_RECALL)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    a, b = J._seeds(J.TREES * J.DEPTH)
    both, one, two = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (800, 100, 100))
    s = J.signature(np.concatenate([both, one]), a, b) == J.signature(np.concatenate([both, two]), a, b)
    assert abs(s.mean() - 0.8) < 0.12


def test_word_hashes_do_not_cross_texts():
    h, first = J.word_hashes(b"ab cdab  cd", np.array([0, 5, 11]))
    assert first.tolist() == [0, 2, 4] and h[0] == h[2] and h[1] == h[3]


def test_long_texts_are_hashed_in_parts(monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["ab", "cde", "f" * 30]) for _ in range(rng.randint(0, 60))).encode() for _ in range(20)]
    data, off = b"".join(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    h, first = J.word_hashes(data, off)
    assert first[-1] == len(h) == sum(len(t.split()) for t in texts)
    monkeypatch.setattr(J, "_PART", 7)
    h2, first2 = J.word_hashes(data, off)
    assert (h == h2).all() and (first == first2).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(40, 60)] + [(1, 9), (9, 5), (5, 5), (None, 3), (70, 71), (71, 70)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 40 for i in range(40, 61)} | {1: 1, 9: 1, 5: 1, 70: 70, 71: 70}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_repeated_rows_beside_near_copies(spark):
    one, two = D.prose(1, 80), D.prose(4, 90)
    near = one + " more"
    got = J.jaccard_classes(D.frame(spark, [D.row(i, t) for i, t in [(1, one), (1, one), (2, near)]])).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 2), (1, 1, 2), (2, 1, 2)]
    got = J.jaccard_classes(D.frame(spark, [D.row(i, t) for i, t in [(1, one), (3, one), (2, near)]])).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 2), (2, 1, 2), (3, 1, 2)]
    rows = [(1, one), (1, two), (2, one), (3, two + " more"), (4, near)]
    got = J.jaccard_classes(D.frame(spark, [D.row(i, t) for i, t in rows])).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 3), (1, 1, 3), (2, 1, 2), (3, 1, 1), (4, 1, 2)]


def test_many_repeats_of_one_row_stay_one_representative(spark):
    one = D.prose(1, 80)
    got = J.jaccard_classes(D.frame(spark, [D.row(9, one)] * 500 + [D.row(7, one + " x y")] * 3 + [D.row(8, None)] * 2)).collect()
    assert sorted(set(map(tuple, got))) == [(7, 7, 502), (8, 8, 0), (9, 7, 502)] and len(got) == 505


@pytest.mark.parametrize(("crowd", "hot"), [(512, 100_000), (64, 100_000), (512, 300), (64, 300)])
def test_large_groups_lose_no_link(spark, monkeypatch, crowd, hot):
    """A cluster of 700 near copies and a drifting chain, whole against brute force, in crowds and hot groups too."""
    monkeypatch.setattr(J, "CROWD", crowd)
    monkeypatch.setattr(J, "HOT", hot)
    rng, base = random.Random(8), [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(700):
        t = list(base)
        t[rng.randrange(120)] = f"v{rng.randrange(10**6)}"
        texts.append(" ".join(t))
    drift = [f"d{i}" for i in range(150)]
    for i in range(200):
        drift = [*drift[1:], f"d{150 + i}"]
        texts.append(" ".join(drift))
    sets = [shingle_set(t) for t in texts]
    m = np.zeros((len(texts), len({g for s in sets for g in s})), np.float32)
    at: dict = {}
    for i, s in enumerate(sets):
        for g in s:
            m[i, at.setdefault(g, len(at))] = 1
    common, n = m @ m.T, m.sum(axis=1)
    want = (common / (n[:, None] + n[None] - common) >= 0.8).sum(axis=1) - 1
    got = {r.doc_id: r.n_links for r in J.jaccard_classes(D.frame(spark, [D.row(i, t) for i, t in enumerate(texts)])).collect()}
    assert all(got[i] <= want[i] for i in got)
    assert sum(got.values()) >= 0.999 * want.sum() > 300_000


@pytest.mark.parametrize(("hot", "block"), [(20_000, 4096), (100, 4096), (100, 30)])
def test_crowds_and_hot_groups_find_partners_at_the_shortest_prefix(spark, monkeypatch, hot, block):
    """600 signatures share four values of one tree; each has one near partner, with which it shares five values nowhere."""
    for name, value in (("HOT", hot), ("HOT_BLOCK", block)):
        monkeypatch.setattr(J, name, value)
    rng = np.random.default_rng(5)
    sigs = rng.integers(0, 1 << 16, (600, J.TREES, J.DEPTH)).astype(np.uint16)
    sigs[:, 0, :4] = 7
    for i in range(0, 600, 2):
        differ = sigs[i + 1, :, 3].copy(), sigs[i + 1, 0, 4]
        sigs[i + 1] = sigs[i]
        sigs[i + 1, 1:, 3], sigs[i + 1, 0, 4] = differ[0][1:], differ[1]
    reps = spark.createDataFrame([(i, s.tobytes()) for i, s in enumerate(sigs)], "rep long, signature binary")
    got = {tuple(sorted(r)) for r in J.candidate_links(reps).collect()}
    assert got == {(i, i + 1) for i in range(0, 600, 2)}
