import hashlib
import re

import pytest

from strataframe.llm import fill_in_middle as M
from tests.llm import docs as D


def want(doc_id, text, seed, fim, spm):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    sha = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(sha[i : i + 8], 16) for i in range(0, 32, 8)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= fim:
        return n, "plain", None, None, text
    out = f"<S>{suf}<P>{pre}<M>{mid}" if h[3] % 100 < spm else f"<P>{pre}<S>{suf}<M>{mid}"
    return n, "spm" if h[3] % 100 < spm else "psm", len(pre), len(mid), out


@pytest.mark.parametrize(("seed", "fim", "spm"), [(7, 100, 50), (1, 60, 0), (2, 0, 50)])
def test_matches_brute_force_and_restores(spark, seed, fim, spm):
    rows = [D.row(i, t) for i, t in enumerate(["", "\n", "\n\n", "a", "a\n", "\na", "one\ntwo\r\nthree x\x85y\n\nfour", "has <P> in it", "<<P\n>S>\nM>", "ü😀\n中文\n" * 30, None, "<\nP>\n<S", "x" * 200_000 + "\n", "\n" * 3000])]
    rows += [D.row(100 + i, "\n".join(D.prose(j, 5) for j in range(i))) for i in range(40)] + [D.row(None, "a\nb\nc"), D.row(None, None), D.row(3, "a"), D.row(3, "a")]
    found = M.fill_in_middle(D.frame(spark, rows), seed, fim, spm)
    got = sorted(map(tuple, found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", M.restored("output", "form").alias("r")).collect()), key=repr)
    assert got == sorted(((r[0], *want(r[0], r[1], seed, fim, spm), r[1] or "") for r in rows), key=repr)


def test_awkward_and_empty_tables(spark):
    assert M.digest(M.fill_in_middle(D.awkward(spark))).filter("n IS NULL OR form IS NULL").count() == 0
    assert M.digest(M.fill_in_middle(D.empty(spark))).count() == 0


def test_other_sentinels_must_be_certain(spark):
    df = D.frame(spark, [D.row(1, "a\nb (x\nc")])
    out = M.fill_in_middle(df, sentinels=("(pre)", "(suf)", "(mid)")).select(M.restored("output", "form", ("(pre)", "(suf)", "(mid)"))).first()[0]
    assert out == "a\nb (x\nc"
    for bad in (("aba", "x", "y"), ("ab", "bc", "z"), ("abc", "b", "z"), ("", "x", "y"), ("x", "x", "y")):
        with pytest.raises(ValueError):
            M.fill_in_middle(df, sentinels=bad)


def test_stays_in_the_jvm(spark):
    plan = M.digest(M.fill_in_middle(D.frame(spark, [D.row(1, "a")])))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange hashpartitioning" not in plan
