import math
import os
import random
import re
from collections import Counter

import pytest

from strataframe.llm import quality_rules as Q
from tests.llm import docs as D


def brute(t):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def test_counts_match_brute_force(spark):
    rng = random.Random(4)
    texts = {i: "".join(rng.choice(["a", "b ", "c\n", " ", "é#", "a b c ", "|", "\t", " "]) for _ in range(rng.randint(0, 80))) for i in range(400)}
    df = D.frame(spark, [D.row(i, t) for i, t in texts.items()])
    for r in Q.judge(df).collect():
        want = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def test_fences_follow_their_own_group(spark):
    clean = [D.row(i, D.prose(i, 80), "en", "a") for i in range(40)]
    noisy = [D.row(100 + i, D.prose(i, 80).replace(" ", "## "), "en", "b") for i in range(40)]
    one = [D.row(999, D.prose(5, 80).replace(" ", "## "), "en", "a")]
    got = {r.doc_id: r.kept for r in Q.judge(D.frame(spark, clean + noisy + one)).collect()}
    assert not got[999]  # an outlier in its source
    assert sum(got[100 + i] for i in range(40)) >= 34  # usual in the other
    assert sum(got[i] for i in range(40)) >= 34


def test_repeat_fences_follow_their_group_and_shrink_with_length(spark):
    lines = lambda k, n: [" ".join(f"{w}{k}x{i}" for w in D.WORDS[:10]) for i in range(n)]
    text = lambda k, n, again: "\n".join(lines(k, n) + lines(k, again))  # noqa: E731  ``again`` lines twice
    rows = [D.row(i, text(i, 30, 0), "en", "clean") for i in range(100)]
    rows += [D.row(200 + i, text(i, 24, 1 + i % 6), "en", "choruses") for i in range(40)]
    rows += [D.row(900, text(900, 24, 6), "en", "clean"), D.row(901, text(901, 5, 1), "en", "clean"), D.row(902, text(902, 20, 3), "en", "clean")]
    got = {r.doc_id: (r.base_failed, r.kept) for r in Q.judge(D.frame(spark, rows)).collect()}
    assert got[900] == (False, False) and got[902] == (False, False)  # far outside their group's quantiles
    assert got[901] == (False, True)  # one repeated line in a short text
    assert all(got[i] == (False, True) for i in [*range(100), *range(200, 240)])


def sketched(values, p, accuracy=Q.ACCURACY):
    """The quantile of a list by the definition of the sketch."""
    gamma = (1 + accuracy) / (1 - accuracy)
    value = lambda x: 0.0 if x <= 0 else 2 * gamma ** math.ceil(math.log(x) / math.log(gamma)) / (gamma + 1)
    return value(sorted(values)[min(math.floor(p * (len(values) - 1)), len(values) - 1)])


def verdicts(rows):
    """kept of every row by brute force, from whole lists of values."""
    share = lambda a, b: a / b if b else 0.0
    facts, groups = {}, {}
    for i, t, lang, source in rows:
        n, chars, symbols, dups, repeats = brute(t)
        lines = sum(1 for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x))
        upper = sum("A" <= c <= "Z" for c in t or "")
        failed = n < 50 or 100 * repeats > 50 * n
        x = {"mean_word_chars": share(chars, n), "symbol_share": share(symbols, chars), "dup_line_share": share(dups, lines), "repeat_share": share(repeats, n), "upper_share": share(upper, chars)}
        slack = {"mean_word_chars": 1.0, "symbol_share": 0.02, "dup_line_share": share(1, lines), "repeat_share": min(0.4, share(Q.SPARE_WORDS, n)), "upper_share": 0.1}
        facts[i] = (failed, x, slack, (lang, source))
        if not failed:
            groups.setdefault((lang, source), []).append(x)
    out = {}
    for i, (failed, x, slack, group) in facts.items():
        ok = not failed
        for f, (_, side, _) in Q.FEATURES.items():
            if not ok:
                break
            lo, hi, tail = (sketched([v[f] for v in groups[group]], p) for p in (0.25, 0.75, 0.95))
            wide = max(3.0 * (tail - hi if side == "tail" else hi - lo), slack[f])
            ok = x[f] <= hi + wide and (side != "both" or x[f] >= lo - wide)
        out[i] = ok
    return out


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no driver tables")
def test_verdicts_match_brute_force_and_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    want = verdicts([tuple(r) for r in docs.collect()])
    assert 0 < sum(want.values()) < len(want)
    for parts in (1, 7):
        got = {r.doc_id: r.kept for r in Q.judge(docs.repartition(parts)).collect()}
        assert got == want


def test_sketched_quantiles_are_near_exact_ones(spark):
    rng = random.Random(6)
    values = [rng.lognormvariate(0, 2) if rng.random() < 0.9 else 0.0 for _ in range(4000)]
    gamma = (1 + Q.ACCURACY) / (1 - Q.ACCURACY)
    counts = Counter(None if v == 0 else math.ceil(math.log(v) / math.log(gamma)) for v in values)
    sketch = spark.createDataFrame([("en", "s", "f", b, n) for b, n in counts.items()], "t_lang string, t_source string, feature string, bucket int, n long")
    points = (0.02, 0.25, 0.5, 0.75, 0.95, 1.0)
    got = Q.quantiles(sketch, points).first()
    for i, p in enumerate(points):
        exact = sorted(values)[math.floor(p * (len(values) - 1))]
        assert abs(got[f"q{i}"] - exact) <= Q.ACCURACY * exact * 1.001


def test_awkward_rows(spark):
    df = D.awkward(spark)
    assert Q.judge(df).count() == df.count()
    assert Q.judge(D.empty(spark)).count() == 0
