"""Operators that SQL can't say, edge cases, plans, sources and streams."""

import json
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataframe.functions import extract as E
from strataframe.functions import text as X
from strataframe.functions import units as U
from strataframe.operators import chunking as C
from strataframe.operators import retrieval as R
from strataframe.operators import rules as D
from strataframe.operators import store as S
from strataframe.sources import files, html
from strataframe.streaming import state as ST


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], list(cols)) if cols else spark.range(1)
    return df.select(expr.alias("x")).first()["x"]


def test_text_edge_cases(spark):
    c = F.col("t")
    assert one(spark, X.clean_markdown(c), t="a b \r\n\n\n\n\n\nc​ &lt;d&gt;") == "a b\n\n\nc <d>"
    assert one(spark, X.clean_markdown(c), t=" \n ") is None
    assert one(spark, X.standard_number(c), t="see is 129 (part 2)") == "IS 129-2"
    assert one(spark, X.standard_number(c), t="  other   text ") == "other text"
    assert one(spark, X.clause_number(c), t="no number") is None
    assert one(spark, X.tokens(c), t=" Hello, (world)-wide! -- ") == ["hello", "world)-wide", "--"]  # hyphens stay
    assert one(spark, X.table_cells(c), t="| a  b | | c |") == ["a b", "", "c"]
    assert one(spark, X.without_repeats(F.split(c, ",")), t="a,A!,b,b,a") == ["a", "b", "a"]
    assert one(spark, X.decode_path(X.encode_path(F.split(c, "/"))), t="a/b") == ["a", "b"]
    assert one(spark, X.sigmoid(F.lit(None).cast("double"))) == 0.5
    assert str(one(spark, X.parse_date(c), t="31.12.2020")) == "2020-12-31" and one(spark, X.parse_date(c), t="99-99-2020") is None
    assert [one(spark, X.heading_level(c), t=t) for t in ("# a", "   ### b", "    # code", "#no", "####### x")] == [1, 3, None, None, None]


def test_units_and_comparison(spark):
    num = lambda v: F.lit(v).cast("double")
    def state(v, tol, unit, op, lo, hi, nom, req):
        return one(spark, U.compare(num(v), num(tol), F.lit(unit), F.lit(op), num(lo), num(hi), num(nom), F.lit(req)))

    assert state(5000, None, "ml", "GE", 5, None, None, "L") == "MATCH"
    assert state(10, 2, "bar", "LE", None, 11, None, "bar") == "PARTIAL_MATCH"
    assert state(200, None, "mm", "LE", None, 5, None, "bar") == "UNVERIFIABLE"
    assert state(55, None, "°C", "LE", None, 40, None, "°C") == "MISMATCH"
    assert state(None, None, "mm", "LE", None, 5, None, "mm") == "MISSING"
    assert state(273.15, None, "K", "EQ", None, None, 0, "°C") == "MATCH"
    assert state(36, 1, "mm", "RANGE", 30, 36.5, None, "mm") == "PARTIAL_MATCH"
    p = one(spark, U.parameter(F.col("t")), t="rated: 230 ± 10 V")
    assert (p.name, p.value, p.lower, p.upper, p.op, p.unit) == ("rated", 230, 220, 240, "EQ", "V")
    assert one(spark, U.parameter(F.col("t")), t="no quantity") is None


def merge_brute(sections, least, most):
    out, i = [], 0
    while i < len(sections):
        h, b = sections[i]
        if i + 1 < len(sections) and not b:
            out.append((sections[i + 1][0], h + "\n" + sections[i + 1][1]))
            i += 2
        elif i + 1 < len(sections) and len(b) < least and len(b) + len(sections[i + 1][1]) <= most:
            out.append((h, b + "\n" + sections[i + 1][1]))
            i += 2
        else:
            out.append((h, b))
            i += 1
    return out


def test_greedy_folds_match_brute_force(spark):
    rng = random.Random(3)
    docs = {d: [(f"h{i}", "x" * rng.choice([0, 3, 8, 20, 30])) for i in range(rng.randint(1, 9))] for d in range(40)}
    df = spark.createDataFrame([(d, i, h, b) for d, s in docs.items() for i, (h, b) in enumerate(s)], "doc long, section long, heading string, body string")
    got = {r.doc: [(s.heading, s.body) for s in r.sections] for r in C.merge_sections(df, "doc", 10, 25).collect()}
    assert got == {d: merge_brute(s, 10, 25) for d, s in docs.items()}
    text = "\n".join("y" * rng.randint(0, 30) for _ in range(50))
    packed = one(spark, C.pack_lines(F.col("t"), 40), t=text)
    assert [x for x in "\n".join(packed).split("\n") if x] == [x for x in text.split("\n") if x] and all(len(p) <= 40 for p in packed)
    assert all(len(a) + 1 + len(b.split("\n")[0]) >= 39 or not b for a, b in zip(packed, packed[1:]))


def test_tables_stay_whole_or_repeat_their_header(spark):
    table = ["| a | b |", "| - | - |", *(f"| {i} | x |" for i in range(8))]
    pack = lambda lines, most: one(spark, C.pack_lines(F.col("t"), most), t="\n".join(lines))
    assert pack(["short"], 40) == ["short"]
    whole = pack(["text " * 8, *table, "after"], 120)
    assert whole == [("text " * 8).strip(), "\n".join([*table, "after"])]  # kept in one piece, the text before goes first
    cut = pack(["before", *table, "after"], 50)
    assert cut[0] == "before" and cut[-1] == "after"
    assert all(p.split("\n")[:2] == table[:2] and len(p) <= 50 for p in cut[1:-1])
    assert [r for p in cut[1:-1] for r in p.split("\n")[2:]] == table[2:]
    assert pack(["| only a very wide header row without any others |" * 2, "x"], 40)[0].startswith("| only")
    df = spark.createDataFrame([(None,), ("",)], "t string")
    assert [r[0] for r in df.select(C.pack_lines(F.col("t"), 5)).collect()] == [None, [""]]


def test_packing_holds_few_texts_at_a_time(spark):
    """No Arrow batch: it would hold 10,000 rows, whatever the length of their texts."""
    text = "\n".join(["é€😀" * 20, "x" * 50, "| a |"])
    out = spark.range(250).select("id", C.pack_lines(F.when(F.col("id") % 2 == 0, text), 80).alias("p"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "Arrow" not in plan
    assert {(r.id % 2, tuple(r.p or ())) for r in out.collect()} == {(0, ("é€😀" * 20, "x" * 50 + "\n| a |")), (1, ())}


def test_sections_merge_without_python(spark):
    """Windows over the sections, not documents of nested sections in Arrow batches; pieces are numbered without gaps, a null key included."""
    rng = random.Random(7)
    docs = {d: [(rng.choice(["", "h", "é"]) + str(i), rng.choice(["", "é€😀"]) * (n % 2) + "x" * n) for i, n in enumerate(rng.choices([0, 1, 6, 7, 9, 10, 15, 40], k=rng.randint(1, 40)))] for d in [None, *range(60)]}
    df = spark.createDataFrame([(d, i, h, b) for d, s in docs.items() for i, (h, b) in enumerate(s)], "doc long, section long, heading string, body string").repartition(7)
    out = C.merged_sections(df, "doc", 10, 25)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in sorted(out.collect(), key=lambda r: r.piece):
        got.setdefault(r.doc, []).append((r.piece, r.heading, r.body))
    assert got == {d: [(i, *p) for i, p in enumerate(merge_brute(s, 10, 25))] for d, s in docs.items()}
    whole = C.merge_sections(df, "doc", 10, 25)
    assert "Python" not in whole._jdf.queryExecution().executedPlan().toString()
    assert {r.doc: [(s.heading, s.body) for s in r.sections] for r in whole.collect()} == {d: [p[1:] for p in ps] for d, ps in got.items()}


def test_folds_are_linear(spark):
    began = time.perf_counter()
    long = "\n".join(f"line {i}" for i in range(200_000))
    assert len(one(spark, C.pack_lines(F.col("t"), 40), t=long)) > 40_000
    df = spark.range(60_000).selectExpr("1 doc", "id section", "'h' heading", "repeat('x', 5) body")
    assert C.merge_sections(df, "doc", 10, 25).selectExpr("size(sections)").first()[0] == 30_000
    rows = spark.range(100_000).selectExpr("id k", "1L u", "timestamp_seconds(id) ts")
    assert ST.accepted(rows, "u", "ts", "k", 5, 100).filter("accepted").count() == 5_000
    assert time.perf_counter() - began < 60


def test_heading_paths_forget_deeper_levels(spark):
    lines = ["# a", "## b", "### c", "# d", "### e", "## f", "text"]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "doc long, pos int, line string")
    got = [X for X in (r.path for r in C.heading_paths(df, "doc").orderBy("pos").collect())]
    assert got == [["a"], ["a", "b"], ["a", "b", "c"], ["d"], ["d", "e"], ["d", "f"]]


def test_bm25_matches_the_formula(spark):
    docs = ["red pump pump", "blue pump", "red valve", "green valve steel", "", "blue steel red"]
    df = spark.createDataFrame(list(enumerate(docs)), "id long, text string")
    q = spark.createDataFrame([(0, "red pump"), (1, "steel steel"), (2, "nothing")], "q long, text string")
    toks = [d.split() for d in docs]
    n, avg = len(docs), np.mean([len(t) for t in toks])
    terms = {t for d in toks for t in d}
    raw = {t: np.log((n - sum(t in d for d in toks) + 0.5) / (sum(t in d for d in toks) + 0.5)) for t in terms}
    idf = {t: v if v >= 0 else 0.25 * np.mean(list(raw.values())) for t, v in raw.items()}
    got = {(r.q, r.id): r.score for r in R.bm25(df, "id", "text", q, "q", "text").collect()}
    for qi, words in ((0, ["red", "pump"]), (1, ["steel", "steel"])):
        for i, d in enumerate(toks):
            want = sum(idf[w] * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for w in words if w in d)
            assert abs(got.get((qi, i), 0.0) - want) < 1e-9
    assert not any(k[0] == 2 for k in got)


def test_knn_is_exact_and_handles_ties_and_nulls(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(60, 8)).round(1)
    v[10] = v[20]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(99, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(5)
    q = spark.createDataFrame([(0, v[20].tolist()), (1, v[3].tolist())], "q long, qv array<double>")
    got = {}
    for r in R.knn(df, "id", "v", q, "q", "qv", 7).collect():
        got.setdefault(r.q, {})[r.rank] = r.id
    for qi, x in ((0, v[20]), (1, v[3])):
        d = ((v - x) ** 2).sum(1)
        assert [got[qi][k] for k in range(1, 8)] == sorted(range(60), key=lambda i: (round(d[i], 9), i))[:7]
    assert R.knn(df, "id", "v", q.filter("false"), "q", "qv", 3).count() == 0


def test_knn_takes_any_number_of_queries(spark, monkeypatch):
    monkeypatch.setattr(R, "QUERY_BLOCK", 7)
    monkeypatch.setattr(R, "TILE", 3)
    monkeypatch.setattr(R, "ROWS", 5)
    rng = np.random.default_rng(6)
    v = rng.normal(size=(40, 4)).round(1)
    v[5:9] = v[4]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>").repartition(3)
    got = {}
    for r in R.knn(df, "id", "v", df.withColumnsRenamed({"id": "q", "v": "qv"}), "q", "qv", 4).collect():
        got.setdefault(r.q, {})[r.rank] = r.id
    for i, x in enumerate(v):
        d = ((v - x) ** 2).sum(1)
        assert [got[i][k] for k in range(1, 5)] == sorted(range(40), key=lambda j: (round(d[j], 9), j))[:4]


def test_models_of_the_caller(spark):
    df = spark.createDataFrame([("ab",), (None,), ("c",)], "t string")
    got = [r.embedding for r in R.embed(df, "t", lambda texts: [[len(t), 1.0] for t in texts], dim=2).collect()]
    assert got == [[2.0, 1.0], None, [1.0, 1.0]]
    assert [r.reranker for r in R.rescore(df.withColumn("q", F.lit("xy")), "q", "t", lambda pairs: [len(a) + len(b) for a, b in pairs]).collect()] == [4.0, 2.0, 3.0]

    def moody(p):
        if p == "c":
            raise RuntimeError("busy")
        return p.upper()

    assert [r.reply for r in R.rewritten(df, F.col("t"), moody, "reply", pause=0.0).collect()] == ["AB", None, None]


def test_retrieval_as_a_whole(spark):
    docs = spark.createDataFrame([(1, "IS 10 red pump"), (2, "red pump"), (3, "red pump"), (4, "IS 11 red pump valve"), (5, "blue")], "id long, text string")
    q = spark.createDataFrame([(0, "is-10   red pump"), (1, "nothing here")], "q long, ask string")
    dense = spark.createDataFrame([(0, 5, 1), (0, 3, 2), (1, 4, 1)], "q long, id long, rank long")
    got = R.retrieve(docs, "id", "text", q, "q", "ask", dense, k=3).orderBy("q", "rank").collect()
    mine = [r for r in got if r.q == 0]
    named = next(r for r in mine if r.id == 1)  # its standard was asked for
    assert named.methods == ["bm25", "identifier"] and abs(named.boosted - named.fusion - 0.2 * max(r.fusion for r in mine)) < 1e-7
    assert {r.id for r in mine} == {1, 3, 5} and [r.rank for r in mine] == [1, 2, 3]  # 2 has the content of 3
    assert [(r.q, r.id) for r in got if r.q == 1] == [(1, 4)]


def test_no_cross_products_in_fuzzy_joins(spark):
    a = spark.createDataFrame([(1, ["x", "y"])], "a long, w array<string>")
    b = spark.createDataFrame([(2, ["y", "z"])], "b long, u array<string>")
    from strataframe.operators.joins import either_end, match_catalogue

    texts = spark.createDataFrame([(1, "a pump")], "a long, t string")
    rows = b.selectExpr("b", "u", "'pumps' title", "'x' kind")
    for df in (match_catalogue(texts, "a", "t", rows, "b", "u", "title", "kind"), either_end(a, "a", spark.createDataFrame([(1, 2)], "s long, t long"), "s", "t")):
        plan = df._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    df = S.matching(spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet"), l_returnflag="R").select("l_orderkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(l_returnflag,R)" in plan and "l_comment" not in plan and "l_tax" not in plan


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k long, s string, v double")
    new = spark.createDataFrame([(2, "c", None), (3, "d", 3.0)], "k long, s string, v double")
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(S.upsert_replace(old, new, "k")) == [(1, "a", 1.0), (2, "c", None), (3, "d", 3.0)]
    assert rows(S.upsert_ignore(old, new, "k")) == [(1, "a", 1.0), (2, "b", 2.0), (3, "d", 3.0)]
    assert rows(S.upsert_merge(old, new, "k", take=("s",), fill=("v",))) == [(1, "a", 1.0), (2, "c", 2.0), (3, "d", 3.0)]
    twice = new.withColumn("at", F.lit(1)).unionByName(new.withColumn("s", F.lit("z")).withColumn("at", F.lit(2)))
    assert {r.s for r in S.last_per_key(twice, "k", "at").collect()} == {"z"}


def test_html_tables(spark):
    page = "<table><tr><th>No</th><th>Title</th></tr><tr><td>IS 1:2001</td><td>One <b>x</b></td><td><a href='/a.pdf'>p</a></td></tr><tr><td>IS 2</td><td>Two</td><td><a href=\"b.PDF\">p</a></td></tr></table><table><tr><td>z</td></tr></table>"
    df = spark.createDataFrame([(1, page), (2, "no table"), (3, None)], "id long, html string")
    got = [tuple(r)[2:] for r in html.table_rows(df, "id", "html", F.lit("https://h.example/d/x.html")).orderBy("row").collect()]
    assert got == [("IS 1:2001", "One x", "https://h.example/a.pdf", 2001), ("IS 2", "Two", "https://h.example/d/b.PDF", None)]
    assert html.term_filter(df, [], "html").count() == 3


def test_files(spark, tmp_path):
    chunks = spark.createDataFrame([("d", "f.md", 0, "c0", "x", {"a": "1"}), ("d", "f.md", 1, "c1", "y", {})], "doc string, src string, pos int, chunk_id string, content string, metadata map<string,string>")
    out = str(tmp_path / "env")
    files.to_envelopes(chunks, "doc", "src", "pos").coalesce(1).write.json(out)
    back = files.from_envelopes(spark.read.schema(files.ENVELOPE).json(out)).orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.content, r.metadata) for r in back] == [("c0", "x", {"a": "1"}), ("c1", "y", {})]
    live = str(tmp_path / "live")
    files.publish(chunks, live)
    files.publish(chunks.limit(1), live)
    assert spark.read.parquet(live).count() == 1 and spark.read.parquet(live + "__backup").count() == 2
    with pytest.raises(ValueError):
        files.publish(chunks.filter("false"), live)
    assert spark.read.parquet(live).count() == 1
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "a.bin").write_bytes(b"1")
    before = files.file_hashes(spark, str(tmp_path / "h")).collect()
    recorded = spark.createDataFrame(before)
    (tmp_path / "h" / "a.bin").write_bytes(b"2")
    (tmp_path / "h" / "b.bin").write_bytes(b"3")
    assert sorted(r.state for r in files.changed_files(recorded, files.file_hashes(spark, str(tmp_path / "h"))).collect()) == ["changed", "new"]
    (tmp_path / "r.json").write_text(json.dumps({"sources": [{"source_id": "a", "source_type": "odd", "crawl_frequency": "WEEKLY"}]}))
    rec = files.read_registry(spark, str(tmp_path / "r.json")).first()
    assert (rec.source_type, rec.crawl_frequency) == ("OFFICIAL_PORTAL", "WEEKLY")
    (tmp_path / "cases.json").write_text(json.dumps([{"id": "a", "query": "q"}, {"id": "b"}]))
    assert [tuple(r) for r in files.read_cases(spark, str(tmp_path / "cases.json"), "id string, query string").orderBy("id").collect()] == [("a", "q"), ("b", None)]
    files.append_log(chunks.select("doc"), str(tmp_path / "log"))
    files.append_log(chunks.select("doc"), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4
    assert "| doc |" in files.markdown_report("t", {"s": chunks.select("doc").distinct()})


def test_rate_limit_counts_accepted_requests_only(spark):
    rng = random.Random(8)
    rows = [(i, rng.randint(1, 3), float(rng.randint(0, 300))) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, u long, t double").withColumn("ts", F.timestamp_seconds("t"))
    got = {r.k: r.accepted for r in ST.accepted(df, "u", "ts", "k", 4, 30).collect()}
    live, want = {}, {}
    for k, u, t in sorted(rows, key=lambda r: (r[2], r[0])):
        own = [x for x in live.get(u, []) if x > t - 30]
        want[k] = len(own) < 4
        live[u] = own + [t] * want[k]
    assert got == want


def test_streams_equal_batches(spark, tmp_path):
    src, ck, out = (str(tmp_path / n) for n in ("src", "ck", "out"))
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(src)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = ST.job_states(stream).writeStream.outputMode("complete").format("memory").queryName("jobs").option("checkpointLocation", ck).start()
    q.processAllAvailable()
    q.stop()
    rows = lambda df: sorted((r.user_id, r.state, r.n, round(r.total, 6)) for r in df.collect())
    assert rows(spark.table("jobs")) == rows(ST.job_states(events))
    q = ST.upsert_batches(stream.select("event_id", "value"), out, "event_id", ck + "2").start()
    q.processAllAvailable()
    q.stop()
    table = spark.read.parquet(out)
    assert ST.newest_versions(table, "event_id").count() == events.count()
    docs = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "text string, t long").withColumn("at", F.timestamp_seconds("t"))
    docs.coalesce(1).write.parquet(str(tmp_path / "docs"))
    q = ST.new_content(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "docs")), "text", "at").writeStream.format("memory").queryName("fresh").option("checkpointLocation", ck + "3").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.text for r in spark.table("fresh").collect()) == ["a", "b"]


def test_extraction(spark):
    h = one(spark, E.header(F.col("t"), F.lit("x.pdf")), t="# Steel pipes\nIS 1239 (Part 1) : 2004\nSixth Edition\nIndian Standard, dated May 2004\n")
    assert (h.number, h.part, h.year, h.title, h.edition, h.document_type, h.published) == ("IS 1239-1", "1", 2004, "Steel pipes", "Sixth Edition", "indian_standard", "May 2004")
    none = one(spark, E.header(F.col("t"), F.lit("x.pdf")), t="# <!-- PAGE 3 -->\n## Small\ntext")
    assert (none.number, none.title, none.document_type) == (None, None, None)
    df = spark.createDataFrame([(1, "Hello there. - ok then! This is fine?\n\nSources: [EV1]")], "id long, t string")
    assert [r.claim for r in D.claims(df, "id", "t").orderBy("claim_id").collect()] == ["Hello there.", "ok then!", "This is fine?"]


def test_gate_and_index_states(spark):
    df = spark.createDataFrame([(1, "a", "6.0"), (2, "", "6.0")], "id long, t string, v string")
    checks = {"blank": F.col("t") != ""}
    assert [d.count() for d in C.write_gate(df, checks, False)] == [1, 1]
    assert [d.count() for d in C.write_gate(df, checks, True)] == [0, 1]
    assert C.write_gate(df.filter("id = 1"), checks, True)[0].count() == 1
    state = lambda d, v: C.index_state(d, v, "v", F.col("t") != "").first().state
    assert [state(df, "6.0"), state(df, "7"), state(df.filter("false"), "6.0"), state(df.filter("id = 1"), "6.0")] == ["INDEX_CORRUPT", "INDEX_SCHEMA_MISMATCH", "INDEX_EMPTY", "INDEX_READY"]


def test_semantics_of_blocks(spark):
    md = ["# Standard for pumps", "", "4.2 Marking", "", "plain words", "over two lines", "", "| a | b |", "", "ANNEX A of all", "", "words"]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(md)], "doc long, pos int, line string")
    b = C.blocks(df, "doc", fallback=False)
    own = C.with_semantics(b, "doc").orderBy("block").collect()
    assert [(r.kind, r.semantic_type, r.semantic_level, r.semantic_confidence, r.semantic_source) for r in own] == [
        ("heading", "heading", 1, 1.0, "rules"), ("paragraph", "heading", 2, 0.6, "rules"), ("paragraph", "content", None, 1.0, "rules"), ("table", "content", None, 1.0, "rules"), ("paragraph", "heading", 1, 0.6, "rules"), ("paragraph", "content", None, 1.0, "rules"),
    ]
    ids = [r.block for r in own]
    said = spark.createDataFrame([(1, ids[2], "heading", 3, 0.9), (1, ids[3], "heading", 2, 0.9), (1, ids[1], "content", None, 0.7)], "doc long, block long, semantic_type string, level int, confidence double")
    told = C.with_semantics(b, "doc", said)
    got = {r.block: (r.semantic_type, r.semantic_level) for r in told.collect()}
    assert got[ids[2]] == ("heading", 3) and got[ids[3]] == ("content", None) and got[ids[1]] == ("content", None)
    shown = C.render(told, "doc").first().markdown
    assert shown.startswith("# Standard for pumps\n\n4.2 Marking\n\n### plain words\nover two lines\n\n| a | b |")
    assert tuple(C.block_metadata(told, "doc").first()) == (1, None, "Standard for pumps")


def test_extractive_answers(spark):
    rows = [(1, 1, "Clause 4 Marking", "Mark it.\n\nClause 5 says more.\nthird"), (1, 2, None, "Mark it.\n\nClause 5 says more.\nthird"), (1, 3, "", "x" * 300), (2, 1, "T", None)]
    df = spark.createDataFrame(rows, "q long, rank long, head string, body string")
    own = {r.q: r for r in R.extractive_answer(df.withColumnRenamed("rank", "place"), "q", [F.col("place")], F.col("head"), "body", lines=2).collect()}
    assert own[1].answer == "#### 1. Clause 4 Marking [EV1]\n\nMark it.\nClause 5 says more.\n*(additional requirements in source document)*\n\n#### 2. Requirement Section 2 [EV2]\n\n" + "x" * 300 + "\n\nSources: [EV1], [EV2]"
    assert [(c.claim_id, len(c.text), c.citation) for c in own[1].claims] == [("C1", 8, "EV1"), ("C2", 200, "EV2")]
    assert own[2].claims[0].text == "T"
    plain = {r.q: r.answer for r in R.extractive_answer(df.withColumnRenamed("rank", "place"), "q", [F.col("place")], F.col("head"), "body", consumer=True).collect()}
    assert plain[1].startswith("- **Marking**: Mark it.\nsays more.") and "Clause" not in plain[1]


def test_counters_resume_without_counting_twice(spark):
    rows = [(i, i % 3, "ab"[i % 2]) for i in range(60)]
    events = spark.createDataFrame(rows, "at long, job long, outcome string")
    whole = {tuple(r) for r in ST.counters(events, "job", "outcome", ["a", "b"], "at").collect()}
    saved = ST.counters(events.filter("at < 25 AND job < 2"), "job", "outcome", ["a", "b"], "at")
    assert {tuple(r) for r in ST.resumed_counters(saved, events, "job", "outcome", ["a", "b"], "at").collect()} == whole
    assert {tuple(r) for r in ST.resumed_counters(saved.filter("false"), events, "job", "outcome", ["a", "b"], "at").collect()} == whole


def test_grounding_of_answers(spark):
    rows = [(1, "SUPPORTED", True, "a"), (1, "PARTIAL", False, "a"), (2, "SUPPORTED", False, "a"), (3, None, None, ""), (4, None, None, "says nothing"), (5, "UNSUPPORTED", True, "a"), (5, "PARTIAL", True, "a")]
    df = spark.createDataFrame(rows, "q long, s string, fact boolean, answer string")
    got = {r.q: (r.coverage, r.score, r.overall) for r in D.grounding(df, "q", "s", F.col("fact"), "answer").collect()}
    assert got == {1: (1.0, 0.75, "PARTIALLY_GROUNDED"), 2: (1.0, 1.0, "FULLY_GROUNDED"), 3: (1.0, 1.0, "UNVERIFIABLE"), 4: (1.0, 0.0, "UNVERIFIABLE"), 5: (0.0, 0.25, "UNSUPPORTED")}


def test_accepted_requests_of_a_stream(spark, tmp_path):
    rows = [(i, i % 2, float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "k long, u long, t double").withColumn("ts", F.timestamp_seconds("t"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = ST.accepted_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "u", "ts", "k", 2, 10).writeStream.format("memory").queryName("taken").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    want = {r.k: r.accepted for r in ST.accepted(df, "u", "ts", "k", 2, 10).collect()}
    assert {r.k: r.accepted for r in spark.table("taken").collect()} == want


def test_json_pages_as_a_source(spark, tmp_path):
    from strataframe.sources import api

    for i in (1, 2, 3):
        (tmp_path / f"p{i}.json").write_text(json.dumps({"data": {"rows": [{"id": f"{i}-{k}", "title": " é " if k else ""} for k in range(2)]}}, ensure_ascii=False))
    url = f"file://{tmp_path}/p{{page}}.json"
    df = api.read_api(spark, url, pages=3, items="data.rows")
    assert df.count() == 6 and df.rdd.getNumPartitions() == 3
    got = api.discovered(df, {"id": "$.id", "title": "$.title"}, "title").orderBy("page").collect()
    assert [tuple(r) for r in got] == [(i, 1, f"{i}-1", "é") for i in (1, 2, 3)]
    with pytest.raises(Exception, match="p9.json"):
        api.read_api(spark, url, first=9, tries=1).count()


def test_pages_of_binary_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"one\fTwo")
    (tmp_path / "b.bin").write_bytes(b" \f ")
    (tmp_path / "c.bin").write_bytes(b"bad")

    def extract(body):
        if body == b"bad":
            raise ValueError("no pages")
        return body.decode().split("\f")

    rows = files.read_pages(spark, str(tmp_path), extract, "*.bin")
    assert sorted((r.path[-5:], r.page, r.text, r.problem) for r in rows.fillna(0, ["page"]).fillna("", ["text", "problem"]).collect()) == [("a.bin", 1, "one", ""), ("a.bin", 2, "Two", ""), ("b.bin", 0, "", "empty"), ("c.bin", 0, "", "ValueError: no pages")]
    md = files.pages_to_markdown(rows.filter("problem IS NULL"), "path", "page", "text").first().markdown
    assert md == "<!-- PAGE 1 -->\none\n\n<!-- PAGE 2 -->\nTwo"


def test_standard_numbers_of_seven_digits_stay_whole(spark):
    c = F.lit("is: 1234567 (Part 3)")
    assert spark.range(1).select(X.standard_number(c)).first()[0] == "IS 1234567-3"


def test_contexts_and_translations_with_numbers_of_seven_digits(spark):
    wrong = E.context_contradictions(F.lit("From IS 1234567 clause 4 and IS-1234568"), F.lit("IS 1234567"), F.lit("4.2"))
    assert spark.range(1).select(wrong).first()[0] == ["standard IS 1234568"]
    source, translated = F.lit("IS 1234567 needs 20 bar"), F.lit("पंप के लिए दबाव आवश्यक है मानक IS 1234568 20 bar")
    assert spark.range(1).select(E.translation_check(source, translated, F.lit(False))["issues"]).first()[0] == ["missing_standard_numbers:IS 1234567"]


def test_coverage_of_a_long_text_is_linear(spark, tmp_path):
    import __spark_entry__ as entry

    spark.createDataFrame([(1, "abc defg " * 300_000), (2, ""), (3, "a" * 499 + "bc")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    start = time.time()
    assert {r[0]: r[1] for r in entry.queries()["a27_token_coverage"](spark, str(tmp_path)).collect()} == {1: 1.0, 2: 1.0, 3: 0.0}
    assert time.time() - start < 60
