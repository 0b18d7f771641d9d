import hashlib
import random

from strataframe.llm import exact_dedup as E
from tests.llm import docs as D


def test_matches_brute_force(spark):
    df = D.awkward(spark)
    got = E.exact_dedup(df, keep="max").collect()
    rows = df.select("doc_id", "text").collect()
    fold = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "")
    groups = {}
    for r in rows:
        groups.setdefault(fold(r.text), []).append(r.doc_id)
    assert len(got) == len(rows)
    by_sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    for r in got:
        ids = by_sha[r.text_sha256]
        assert r.group_size == len(ids)
        best = max((i for i in ids if i is not None), default=None)
        assert r.keep_id == best and r.kept == (r.doc_id == best)


def test_smallest_is_the_default_and_empty_tables_pass(spark):
    got = {r.doc_id: r.keep_id for r in E.exact_dedup(D.frame(spark, [D.row(5, "a b"), D.row(3, "A b"), D.row(4, "c")])).collect()}
    assert got == {5: 3, 3: 3, 4: 4}
    assert E.exact_dedup(D.empty(spark)).count() == 0
    assert E.keep_one_per_text(D.empty(spark)).columns == D.empty(spark).columns


def test_one_row_of_each_text_stays_whatever_the_ids_and_names(spark):
    schema = "__gone string, doc_id long, key string, text string, __sha int, gone long, c0 int"
    rows = [(1, "unique text"), (1, "shared"), (2, "Shared"), (None, "shared"), (None, "alone"), (None, "alone"), (7, "twice"), (7, "twice"), (8, None), (9, "")]
    df = spark.createDataFrame([("g", i, "k", t, 1, 2, 3) for i, t in rows], schema).repartition(3)
    for keep, shared, blank in (("max", (2, "Shared"), (9, "")), ("min", (1, "shared"), (8, None))):
        kept = E.keep_one_per_text(df, keep)
        assert kept.columns == df.columns
        got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
        assert got == sorted([(1, "unique text"), shared, (None, "alone"), (7, "twice"), blank], key=repr)


def test_spilled_subtrees_and_the_rest_are_a_dict():
    rng = random.Random(1)
    keys = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(3000)] + [b"shared" * 50 + bytes([i % 7]) for i in range(200)]
    keys += [b"long" * 25_000 + bytes([i % 3]) for i in range(9)]
    merge = E._merger(False)
    want = {}
    for i, k in enumerate(keys):
        want[k] = merge(want[k], (i, 1, b"")) if k in want else (i, 1, b"")
    for budget in (1 << 30, 4000, 1):
        trie, out = E.PatriciaTrie(merge, budget), []
        for i, k in enumerate(keys):
            if not trie.insert(k, (i, 1, b"")):
                out.append((k, (i, 1, b"")))
            while trie.held > budget:
                part = trie.spill()
                if part is None:
                    break
                out += part
        inside = dict(trie.items())
        assert inside and bool(out) == (budget < 1 << 30)
        got = dict(inside)
        for k, v in out:
            assert k not in inside
            got[k] = merge(got[k], v) if k in got else v
        assert got == want


def test_texts_over_the_budget_take_further_rounds(spark):
    texts = [chr(97 + i % 3) * 100_000 + str(i % 4) for i in range(30)] + ["short", "SHORT", ""]
    df = D.frame(spark, [D.row(i, t) for i, t in enumerate(texts)])
    got = {r.doc_id: (r.keep_id, r.group_size) for r in E.exact_dedup(df, "max", budget=1000).collect()}
    fold = [t.lower() for t in texts]
    assert got == {i: (max(j for j, u in enumerate(fold) if u == t), fold.count(t)) for i, t in enumerate(fold)}
