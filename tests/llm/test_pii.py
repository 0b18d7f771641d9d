import hashlib
import math
import random
import re
import time

from strataframe.llm import pii as P
from tests.llm import docs as D

RX = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    t = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (2 if i % 2 else 1)
        t += v - 9 if v > 9 else v
    return t % 10 == 0


def ok(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d)
    return kind == "email" or 9 <= len(d) <= 15


def base(t):
    return [(k, m.start(), m.end()) for k, r in RX.items() for m in re.finditer(r, t or "") if ok(k, m.group())]


def test_base_spans_match_the_patterns(spark):
    rng = random.Random(3)
    alphabet = "a.@-+ 0123456789()_%é😀\nZ"
    texts = {i: "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for i in range(1500)}
    for i, x in enumerate(["", None, "a" * 30000, "1" * 30000, "a@b." * 3000, "1.2.3.4." * 2000, "4111 1111 1111 1111 " * 200, "@" * 3000, "a@" + "b.c" * 9000, "+1 2 " * 4000]):
        texts[5000 + i] = x
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in P.digest(P.find_pii(df)).collect():
        b = base(texts[r.doc_id])
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in b)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and r.spans.startswith(joined)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[0] == k for x in b) for k in RX]


def redacted(t, spans):
    """Brute force: overlapping spans become one mark, named after the first."""
    out, at, merged = [], 0, []
    for s, e, k in sorted((s.start, s.end, s.kind) for s in spans):
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e, k])
    for s, e, k in merged:
        out += [t[at:s], f"[{k.upper()}]"]
        at = e
    return "".join(out) + t[at:]


def test_texts_with_very_many_matches(spark):
    lines = [f"v{i}, {i}, 10.0.{i % 300}.{i % 256} x{i}@é.example +1 (499) {i % 10000:04d}-55 4111 1111 1111 {1000 + i % 9000} 😀" for i in range(30_000)]
    texts = {1: "\n".join(lines), 2: ", ".join(str(i) for i in range(700_000)), 3: "\n".join(lines[:40]), 4: "a.b@c.example"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    began = time.perf_counter()
    found = {r.doc_id: r for r in P.find_pii(df).collect()}
    assert time.perf_counter() - began < 60
    for i, t in texts.items():
        assert [(s.kind, s.start, s.end) for s in found[i].base] == base(t)
    assert len(found[1].base) > 25_000 and len(found[2].spans) == 0
    for r in P.redact(df).collect():
        assert r.text == redacted(texts[r.doc_id], found[r.doc_id].spans)


def test_added_spans_are_what_the_labelers_and_weights_say(spark):
    """The votes are read from Spark; overlap, probability and order are worked out again."""
    odd = spark.createDataFrame([(i, t) for i, t in enumerate(["contact Dr. John Smith, born 12.03.1984", "ssn 123-45-6789 or call (555) 123-4567 or +1 (555) 123-4567", "host 300.1.2.3, card 4111 1111 1111 1112", "DE44 5001 0517 5407 3249 31 to joe (at) gmail (dot) com", "page 12.03.1984 of section 1.2.3.999"] * 4)], "doc_id long, text string")
    rows = P.candidates(odd).collect()
    w = P.weights(P.fit(P.candidates(odd)))
    got = {r.doc_id: r.spans[len(r.base) :] for r in P.find_pii(odd).collect()}
    some = 0
    for r in rows:
        want = []
        for k in P.ADDED:
            for c in r.cand:
                z = sum(w[k][j] for j, v in enumerate(c.votes) if v > 0) + sum(w[k][P.LABELERS + j] for j, v in enumerate(c.votes) if v < 0) + w[k][-1] if c.kind == k else -99.0
                if 1 / (1 + math.exp(-z)) >= P.CUT:
                    want.append((k, c.start, c.end))
        assert [(s.kind, s.start, s.end) for s in got[r.doc_id]] == want
        assert all(c.end <= b.start or b.end <= c.start for c in r.cand for b in r.base)
        some += len(want)
    assert some > 8


def test_context_decides_about_weak_spans(spark):
    df = spark.createDataFrame(
        [(1, "contact Dr. John Smith, born 12.03.1984, ssn 123-45-6789, mail joe (at) gmail (dot) com, call (555) 123-4567"), (2, "version 1.2.300.4 and figure 12.03.1984 of the release")], "doc_id long, text string"
    )
    got = {r.doc_id: [s.kind for s in r.spans] for r in P.find_pii(df).collect()}
    assert set(got[1]) == {"spoken_email", "ssn", "local_phone", "birth", "name"}
    assert "ip_weak" not in got[2]


def test_em_recovers_reliable_labelers(spark):
    """Labelers 0 and 1 tell the truth in 95 of 100 cases, labeler 2 in 60."""
    rng = random.Random(1)
    rows = []
    for _ in range(2000):
        truth = 1 if rng.random() < 0.6 else -1
        votes = [truth if rng.random() < p else -truth for p in (0.95, 0.95, 0.6)] + [0, 0, 0]
        rows.append(([("ssn", 0, 1, votes)],))
    df = spark.createDataFrame(rows, "cand array<struct<kind:string,start:long,end:long,votes:array<int>>>")
    m = P.fit(df).first()
    assert m.acc[0] > 0.9 and m.acc[1] > 0.9 and m.acc[2] < 0.72 and abs(m.pi - 0.6) < 0.05
    assert m.w[0] > m.w[2] and m.w[P.LABELERS] < m.w[P.LABELERS + 2]


def test_no_python_on_the_main_path(spark):
    plan = P.candidates(D.awkward(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan.replace("PythonRDD", "").split("Scan")[0])


def test_redaction_and_awkward_rows(spark):
    df = D.frame(spark, [D.row(1, "mail a.b@c.example now +1 (499) 555-6503 and 4111 1111 1111 1111."), D.row(2, "clean"), D.row(3, None)])
    got = {r.doc_id: r.text for r in P.redact(df).collect()}
    assert got == {1: "mail [EMAIL] now [PHONE] and [CARD].", 2: "clean", 3: None}
    odd = D.awkward(spark)
    out = P.redact(odd)
    assert out.columns == odd.columns and out.schema == odd.schema
    assert sorted(map(str, out.collect())) == sorted(map(str, odd.collect()))
    assert P.find_pii(odd).count() == odd.count()
    assert P.find_pii(D.empty(spark)).count() == 0
