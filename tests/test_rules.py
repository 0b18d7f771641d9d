"""Decisions, units, matching and intents on cases worked out by hand."""

import time

import pytest
from pyspark.sql import functions as F

from strataframe.functions import intent as I
from strataframe.functions import text as X
from strataframe.functions import units as U
from strataframe.functions.query import entities
from strataframe.operators import joins
from strataframe.operators import rules as D
from strataframe.operators import temporal as T


def values(spark, rows, schema, *cols):
    return [r for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_units(spark):
    cases = [(2.0, "inches", 50.8, "mm"), (3.0, "tonne", 3000.0, "kg"), (300.0, "Kelvin", 26.85, "°C"), (5.0, " WATT ", 5.0, "W"), (2.0, "mhz", 2e6, "Hz"), (1.5, "metre", 1500.0, "mm"), (2.0, "Cubic_Metre", 2000.0, "L"), (7.0, "furlong", 7.0, "furlong"), (7.0, None, 7.0, None)]
    got = values(spark, cases, "v double, u string, want double, unit string", F.round(U.canonical_value(F.col("v"), F.col("u")), 6), U.canonical_unit(F.col("u")), "want", "unit")
    assert all(a == c and b == d for a, b, c, d in got)
    assert len(U.UNITS) == len({u[0] for u in U.UNITS}) >= 64
    agree = values(spark, [("mm", "inch"), ("mm", "bar"), (None, None), ("", "mm"), ("furlong", "FURLONG"), ("furlong", "mm")], "a string, b string", U.units_agree(F.col("a"), F.col("b")))
    assert [r[0] for r in agree] == [True, False, True, False, True, False]


@pytest.mark.parametrize(
    "text,hint,want",
    [
        ("between 5 and 10 bar", None, ("parameter", None, 5.0, 10.0, None, "RANGE", "bar")),
        ("1) 20 V", None, ("parameter", 20.0, None, None, 20.0, "EQ", "V")),
        ("(2) voltage: 230 V", None, ("voltage", 230.0, None, None, 230.0, "EQ", "V")),
        ("length = 10 +/- 0.5 mm", None, ("length", 10.0, 9.5, 10.5, 10.0, "EQ", "mm")),
        ("capacity >= 500 L", "capacity", ("capacity", 500.0, 500.0, None, None, "GE", "L")),
        ("- temp: < 40 °C", None, ("temp", 40.0, None, 40.0, None, "LE", "°C")),
        ("10 to 40 °C", "range", ("range", None, 10.0, 40.0, None, "RANGE", "°C")),
        ("10.5 mm", None, ("parameter", 10.5, None, None, 10.5, "EQ", "mm")),
        ("stainless steel", "material", ("material", None, None, None, None, None, None)),
        ("stainless steel", None, None),
        ("", "material", None),
    ],
)
def test_parameters(spark, text, hint, want):
    p = values(spark, [(text, hint)], "t string, h string", U.parameter(F.col("t"), None if hint is None else F.col("h")))[0][0]
    assert (p if p is None else (p.name, p.value, p.lower, p.upper, p.nominal, p.op, p.unit)) == want
    assert p is None or p.text == (text if p.op is None else None)


def test_requirements(spark):
    text = "The thickness shall be between 2 and 4 mm; Length shall be 10 ± 0.5 m. Noise shall not exceed 60 dB\nwarranty: none\nFlow shall not be less than 3.5 l\nmass >= 2 kg"
    from strataframe.functions.extract import requirements

    rows = requirements(spark.createDataFrame([(1, text)], "k long, t string"), "k", "t").orderBy("pos").collect()
    assert [(r.name, r.p.op, r.p.lower, r.p.upper, r.p.unit) for r in rows] == [("The thickness", "RANGE", 2.0, 4.0, "mm"), ("Length", "EQ", 9.5, 10.5, "m"), ("Noise", "LE", None, 60.0, "dB"), ("Flow", "GE", 3.5, None, "l"), ("mass", "GE", 2.0, None, "kg")]


def test_stems_and_tokens(spark):
    words = ["stations", "cementation", "treatments", "testing", "actions", "supplies", "applied", "tested", "boxes", "pipes", "faster", "bed", "readings"]
    got = values(spark, [(w,) for w in words], "w string", X.stem(F.col("w")))
    assert [r[0] for r in got] == ["sta", "cement", "treat", "test", "action", "suppl", "appl", "test", "box", "pip", "faster", "bed", "reading"]
    assert values(spark, [("-x- (well-known) a_ «q» 4.2.",)], "t string", X.tokens(F.col("t")))[0][0] == ["-x-", "well-known", "a", "«q»", "4.2"]


def test_readiness(spark):
    score = lambda *a: round(values(spark, [a], "app double, m long, g long, s long, n long, c boolean, e boolean, u boolean", D.readiness(*[F.col(x) for x in "app m g s n c e u".split()]))[0][0], 6)
    assert score(None, None, None, None, None, False, False, False) == 0.185
    assert score(1.0, 3, 0, 4, 4, False, False, False) == 1.0
    assert score(0.5, 0, 0, 0, 0, False, False, False) == round(0.125 + 0.175 + 0.2, 6)
    assert score(1.0, 3, 1, 2, 4, True, True, True) == 0.0625 and score(0.0, 0, 1, 0, 1, True, True, True) == 0.0
    state = lambda *a: values(spark, [a], "c boolean, u boolean, g long, e boolean, m boolean, n long, f boolean", D.readiness_state(*[F.col(x) for x in "c u g e m n f".split()]))[0][0]
    got = [state(True, True, 1, True, True, 1, True), state(False, True, 1, True, True, 1, True), state(None, None, 1, True, True, 1, True), state(None, None, 0, True, True, 1, True), state(None, None, 0, False, True, 1, True), state(None, None, None, False, None, None, True), state(False, False, 0, False, False, 1, True), state(False, False, 0, False, False, 1, False)]
    assert got == ["VERIFICATION_REQUIRED", "TEMPORAL_UNCERTAINTY", "TECHNICAL_GAPS_FOUND", "DOCUMENT_GAPS_FOUND", "EVIDENCE_INCOMPLETE", "EVIDENCE_INCOMPLETE", "READY_FOR_HUMAN_REVIEW", "VERIFICATION_REQUIRED"]


def test_mapping_scores(spark):
    schema = "title double, terms double, clauses double, semantic double, technical double, provenance double, n long, low boolean"
    cases = [
        ((1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 3, False), (1.0, "STRONG_CANDIDATE")),
        ((1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 3, True), (1.0, "POSSIBLE_CANDIDATE")),
        ((0.0, 0.75, 1.0, 1.0, 1.0, 1.0, 3, False), (0.6875, "POSSIBLE_CANDIDATE")),
        ((0.9, 0.0, 0.0, 0.5, 0.0, 0.0, 1, False), (0.3, "POSSIBLE_CANDIDATE")),  # the title alone, without support
        ((0.9, 0.0, 0.0, 0.5, 0.0, 0.0, 2, False), (0.3, "WEAK_CANDIDATE")),
        ((0.0, 0.0, 0.0, 0.5, 0.0, 0.0, 0, False), (0.075, "INSUFFICIENT_EVIDENCE")),
        ((0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0, False), (0.2, "WEAK_CANDIDATE")),  # clauses weigh .20
        ((0.0, 0.0, 0.0, 0.0, 1.0, 1.0, 0, False), (0.15, "INSUFFICIENT_EVIDENCE")),  # technical facts weigh .10
    ]
    for row, want in cases:
        score, status = D.mapping_status(*[F.col(c.split()[0]) for c in schema.split(", ")])
        assert tuple(values(spark, [row], schema, score, status)[0]) == want
    titles = [("Water pump, part 2", "water pump", 1.0), ("The water pump", "Water Pump", 0.9), ("Pumps of brass for water", "water heater", 0.5), ("pump for clean water", "water pump", 0.85), ("Cement", "pump", 0.0), ("", "pump", 0.0), ("x", None, 0.0)]
    assert all(r[0] == r[1] for r in values(spark, titles, "t string, p string, want double", D.title_score(F.col("t"), F.col("p")), "want"))


def test_evidence(spark):
    schema = "req string, pos long, value double, verdict string, state string, expired boolean, named boolean, sure double"
    rows = [
        ("both", 1, None, "PASS", None, False, True, 0.9), ("both", 2, None, "FAIL", None, True, True, 0.9),
        ("apart", 1, 10.0, None, "MATCH", False, True, 0.9), ("apart", 2, 11.6, None, "MATCH", False, True, 0.9),
        ("near", 1, 10.0, None, "MATCH", False, True, 0.9), ("near", 2, 11.4, None, "MISMATCH", False, True, 0.9),
        ("old", 1, 10.0, None, "MATCH", True, True, 0.9),
        ("nobody", 1, 10.0, None, "MATCH", False, False, 0.4), ("surely", 1, 10.0, None, "MATCH", False, False, 0.5),
        ("differs", 1, 10.0, None, "MISMATCH", False, True, 0.9), ("edge", 1, 10.0, None, "PARTIAL_MATCH", False, True, 0.9),
        ("failed", 1, None, "FAIL", None, False, True, 0.9), ("said", 1, None, None, None, False, True, 0.9), ("units", 1, 5.0, None, "UNVERIFIABLE", False, True, 0.9),
        ("renewed", 1, 10.0, None, "MISMATCH", True, True, 0.9), ("renewed", 2, 10.0, None, "MATCH", False, True, 0.9),
    ]
    df = spark.createDataFrame(rows, schema)
    c = F.col
    got = {r.req: r.status for r in D.evidence_status(df, "req", c("pos"), c("value"), c("verdict"), c("state"), c("expired"), c("named"), c("sure")).collect()}
    assert got == {"both": "CONFLICTING", "apart": "CONFLICTING", "near": "SUPPORTED", "old": "EXPIRED", "nobody": "UNVERIFIED", "surely": "SUPPORTED", "differs": "PARTIAL", "edge": "PARTIAL", "failed": "SUPPORTED", "said": "SUPPORTED", "units": "SUPPORTED", "renewed": "SUPPORTED"}


def test_applicability(spark):
    schema = "temporal string, name string, cat string, env string, title string, scope string, score double"
    cases = [
        (("WITHDRAWN", "pump", None, None, "Pumps", "", 0.9), ("VERIFICATION_REQUIRED", 0.40)),
        ((None, None, "", None, "Pumps", "", 0.9), ("INSUFFICIENT_EVIDENCE", 0.20)),
        ((None, "pump", None, "industrial", "Pumps", "It does not apply to industrial plants.", 0.9), ("NOT_APPLICABLE", 0.90)),
        ((None, "oven", "commercial oven", None, "Ovens", "scope excludes: commercial ovens", 0.9), ("NOT_APPLICABLE", 0.90)),
        ((None, "water pumps", None, None, "Pump specification", "", 0.72), ("APPLICABLE", 0.75)),
        ((None, "kettles", None, None, "Goods", "This covers kettle and pot", 0.81234), ("APPLICABLE", 0.8123)),
        ((None, "stove", None, "commercial", "Household stove", "", 0.9), ("POTENTIALLY_APPLICABLE", 0.9)),
        ((None, "pump", None, None, "Pumps", "", 0.3), ("POTENTIALLY_APPLICABLE", 0.3)),
        ((None, "cement", None, None, "Pumps", "", 0.3), ("INSUFFICIENT_EVIDENCE", 0.3)),
        ((None, "domestic part", None, None, "domestic part", "", 0.3), ("INSUFFICIENT_EVIDENCE", 0.3)),  # words that say nothing
    ]
    for row, want in cases:
        a = values(spark, [row], schema, D.applicability(*[F.col(x) for x in "temporal name cat env title scope score".split()]))[0][0]
        assert tuple(a) == want, row
    orders = [("toy", "Toys order", None, "MATCH"), ("toy", None, "", "UNKNOWN"), ("", "Toys", "x", "UNKNOWN"), ("toy gun", "Toys", "It shall not apply to toy guns", "NO_MATCH"), ("need test", "need test", None, "UNKNOWN"), ("pipe", "Toys", "of steel pipes", "MATCH"), ("lamp", "Toys", None, "UNKNOWN")]
    assert all(r[0] == r[1] for r in values(spark, orders, "p string, t string, e string, want string", D.qco_applicability(F.col("p"), F.col("t"), F.col("e")), "want"))


def test_schemes(spark):
    schema = "std string, product string, title string, o string, must boolean, origin string, known boolean, want string"
    cases = [
        ("", "goods", None, None, True, None, False, "SCHEME-CLARIFICATION-REQUIRED"), ("IS 1417", "rings", None, None, False, None, True, "SCHEME-IV"), ("IS 9", "silver spoon", None, None, False, "foreign", True, "SCHEME-IV"),
        ("IS 13252", "adapter", None, None, True, "foreign", True, "SCHEME-II"), ("IS 9", "solar cable", None, None, True, None, True, "SCHEME-I"), ("IS 9", "power bank", None, None, False, None, True, "SCHEME-I-VOLUNTARY"),
        ("IS 9", "cement we import to India", None, None, True, "domestic", True, "SCHEME-X"), ("IS 9", "cement", None, None, True, "Overseas", True, "SCHEME-X"), ("IS 9", "cement", None, None, True, None, True, "SCHEME-I"), ("IS 9", "cement", None, None, None, "foreign", True, "SCHEME-I-VOLUNTARY"),
    ]
    assert all(r[0] == r[1] for r in values(spark, cases, schema, D.scheme(*[F.col(x) for x in "std product title o must origin known".split()]), "want"))
    lists = [("IS 15820", None, None, "SCHEME-IV"), (None, "x", "SCHEME-II", "SCHEME-II"), (None, "plug", "SCHEME-II", "SCHEME-I"), (None, "x", "SCHEME-X", "SCHEME-X"), (None, "laptop overseas", None, "SCHEME-II"), (None, "cement", "SCHEME-I", "SCHEME-I"), (None, None, None, "SCHEME-I")]
    none = F.lit(None).cast("string")
    assert all(r[0] == r[1] for r in values(spark, lists, "s string, p string, c string, want string", D.checklist_kind(F.col("s"), none, F.col("p"), F.col("c")), "want"))


def test_confidence(spark):
    def one(best=3.0, both=True, scope=0.35, full=1.0, known=True, n=3, kind="standard", **failures):
        fails = {k: F.lit(v) for k, v in failures.items()}
        return tuple(values(spark, [(1,)], "x long", D.confidence(F.lit(best).cast("double"), F.lit(both), F.lit(scope), F.lit(full), F.lit(known), F.lit(n), F.lit(kind), fails))[0][0])

    assert one()[1:] == ("HIGH", "ANSWER", "ANSWERABLE")
    assert one(scope=0.1, n=1, kind="blog")[1:] == ("MEDIUM", "QUALIFIED_ANSWER", "ANSWERABLE")
    assert one(missing_context=True, conflict=True) == (0.30, "LOW", "VERIFICATION_REQUIRED", "VERIFICATION_REQUIRED")
    assert one(conflict=True) == (0.28, "LOW", "VERIFICATION_REQUIRED", "CONFLICTING_EVIDENCE")
    assert one(standard_absent=True)[0] == 0.20 and one(clause_absent=True)[0] == 0.40
    assert one(ambiguous=True) == (0.35, "LOW", "VERIFICATION_REQUIRED", "AMBIGUOUS_QUERY")
    assert one(best=-5.0) == (0.30, "LOW", "VERIFICATION_REQUIRED", "INSUFFICIENT_EVIDENCE")
    assert one(amendment_absent=True)[:2] == (0.60, "MEDIUM") and one(year_differs=True)[0] == 0.65
    assert one(uncertain=True) == (0.40, "LOW", "VERIFICATION_REQUIRED", "INSUFFICIENT_EVIDENCE")


def test_currentness(spark):
    schema = "std long, ver long, d long, state string, y int, ask int, hist boolean, amd boolean, status string, tgt boolean, src long, conf boolean"
    rows = [
        (1, 10, 1, "unknown", 1990, 1990, False, False, "published", False, None, None), (1, 11, 2, "unknown", 2000, 1990, False, True, "published", False, None, None),
        (2, 20, 1, "superseded", 1990, 1990, True, False, "published", False, None, None), (2, 21, 2, "current_supported", 2000, 1990, True, False, "effective", False, None, None),
        (3, 30, 1, "unknown", 1990, 1980, True, False, "published", True, None, None), (3, 31, 2, "unknown", 2000, 1980, True, False, "published", False, None, None),
        (4, 40, 1, "unknown", 1990, None, True, False, "published", False, None, None), (4, 41, 2, "unknown", 2000, None, True, False, "published", False, None, None), (4, 42, 3, "unknown", 2010, None, True, False, "published", False, None, None),
        (5, 50, 1, "current_supported", 1990, None, False, False, "effective", False, 1, None), (5, 51, 2, "current_supported", 2000, None, False, False, "effective", False, None, None),
        (6, 60, 1, "superseded", 1990, None, False, False, "published", True, None, None), (6, 61, 2, "current_supported", 2000, None, False, False, "effective", False, 1, None),
        (7, 70, 1, "withdrawn", 1990, None, False, False, "withdrawn", False, None, None),
        (8, 80, 1, "current_supported", 1990, None, False, False, "effective", False, None, True), (9, 90, 1, "current_supported", 1990, None, False, False, "effective", False, None, False),
        (10, 100, 1, "uncertain", 1990, None, False, False, "published", False, None, None), (10, 101, 2, "uncertain", 2000, None, False, False, "published", False, None, None),
    ]
    c = F.col
    df = spark.createDataFrame(rows, schema)
    got = {r.std: (r.resolution, r.resolved) for r in T.currentness(df, "std", "ver", ["d"], "state", c("y"), c("ask"), c("hist"), c("amd"), c("status"), c("tgt"), c("src"), c("conf")).collect()}
    assert got == {
        1: ("AMENDED", 11), 2: ("SUPERSEDED", 20), 3: ("HISTORICAL", 30), 4: ("HISTORICAL", 41), 5: ("TEMPORALLY_UNCERTAIN", None), 6: ("CURRENT_SUPPORTED", 61), 7: ("WITHDRAWN", 70),
        8: ("CURRENT_SUPPORTED", 80), 9: ("TEMPORALLY_UNCERTAIN", 90), 10: ("TEMPORALLY_UNCERTAIN", None),
    }


def test_parameters_are_matched_by_tiers(spark):
    asked = spark.createDataFrame([(1, 7, "Pressure"), (2, 7, "wall thickness"), (3, 7, "storage"), (4, 7, "maximum speed"), (5, 8, "pressure"), (6, 7, "temp of water")], "k long, scope long, name string")
    given = spark.createDataFrame([(10, 7, "working pressure", 1), (11, 7, "pressure ", 2), (12, 7, "thickness", 3), (13, 7, "volume", 4), (14, 7, "maximum weight", 5), (15, 7, "temperature", 6)], "g long, gs long, gname string, pos long")
    got = {r.k: (r.g, r.tier) for r in joins.match_parameters(asked, "k", "scope", "name", given, "g", "gs", "gname", "pos").collect()}
    assert got == {1: (11, 1), 2: (12, 2), 3: (13, 3), 4: (None, None), 5: (None, None), 6: (15, 3)}


def test_tender_links_keep_all_matches(spark):
    left = spark.createDataFrame([(1, 7, "noise", "noise of the fan", ""), (2, 7, "colour", "colour red", "paint"), (3, 7, "bulk", "as is", ""), (4, 7, "height", "height", "")], "k long, s long, n string, t string, c string")
    right = spark.createDataFrame([(10, 7, "acoustic level", "level in db"), (11, 7, "fan noise", "x"), (12, 7, "surface", "paint of surface"), (13, 7, "size", "y")], "r long, rs long, rn string, rt string")
    got = sorted((r.k, r.r) for r in joins.tender_links(left, "k", "s", "n", "t", "c", right, "r", "rs", "rn", "rt").fillna(-1).collect())
    assert got == [(1, 10), (1, 11), (2, 12), (3, -1), (4, 13)]


def test_catalogue_scores(spark):
    rows = [(1, ["water pump"], "Pumps - specification", "machinery"), (2, ["lamp", "led lamp"], "Lamps for homes", "lighting"), (3, None, "General part", None), (4, ["tv"], "", "")]
    catalogue = spark.createDataFrame(rows, "c long, products array<string>, title string, kind string")
    asks = spark.createDataFrame([(1, "a Water pump for wells"), (2, "waterproof lamps and lighting"), (3, "nothing"), (4, "big TV"), (5, None), (6, "x" * 5000 + "pump")], "q long, t string")
    got = {r.q: (r.c, r.score) for r in joins.match_catalogue(asks, "q", "t", catalogue, "c", "products", "title", "kind").collect()}
    assert got == {1: (1, 10), 2: (2, 10 + 3 + 2 + 1), 4: (4, 10), 6: (1, 3)}
    known = F.array(F.lit("pump unit"))
    score = lambda text, p: values(spark, [(text,)], "t string", joins.catalogue_score(F.col("t"), F.array(F.lit(p)), F.lit(""), F.lit(""), known))[0][0]
    assert score("a unit with a pump", "the pump unit xl") == 8 and score("a pump", "the pump unit xl") == 3


def test_claims_contained_either_way_are_not_added(spark):
    got = values(spark, [(["The pump is red"], ["pump IS red", "The pump is red and big", "new fact", "a new fact here", "other"])], "a array<string>, b array<string>", joins.add_unseen_claims(F.col("a"), F.col("b")))[0][0]
    assert got == ["The pump is red", "new fact", "other"]
    assert values(spark, [(None, None)], "a array<string>, b array<string>", joins.add_unseen_claims(F.col("a"), F.col("b")))[0][0] == []


INTENTS = [
    ("", "AMBIGUOUS_QUERY", 0.10), ("   ", "AMBIGUOUS_QUERY", 0.10), ("lity", "AMBIGUOUS_QUERY", 0.30), ("tell me something nice", "AMBIGUOUS_QUERY", 0.40), ("IS1417", "STANDARD_LOOKUP", 0.96), ("1417", "AMBIGUOUS_QUERY", 0.40),
    ("find testing laboratories in Pune", "LABORATORY_SEARCH", 0.99), ("is a lab test mandatory", "AMBIGUOUS_QUERY", 0.40), ("does QCO 2020 apply to my toys", "QCO_APPLICABILITY", 0.98), ("where is this published", "SOURCE_LOOKUP", 0.95),
    ("show the latest notification", "REGULATORY_UPDATE", 0.95), ("is the product compliant", "PRODUCT_COMPLIANCE", 0.94), ("IS 10 versus IS 12", "COMPARISON_QUERY", 0.90), ("which scheme is for toys", "SCHEME_GUIDANCE", 0.96),
    ("how can I get BIS certification", "PROCESS_EXPLANATION", 0.96), ("what standard applies to kettles", "STANDARD_LOOKUP", 0.97), ("find standards for kettles", "STANDARD_DISCOVERY", 0.95), ("normative references of IS 5", "REFERENCE_LOOKUP", 0.92),
    ("what documents do I send", "DOCUMENT_REQUIREMENT_QUERY", 0.92), ("explain the marking", "EXPLANATION_QUERY", 0.88), ("IS 5 amendment 3", "AMENDMENT_LOOKUP", 0.98), ("amendment 3", "AMENDMENT_LOOKUP", 0.90), ("is IS 5 current", "CURRENTNESS_QUERY", 0.96),
    ("IS 5 : 1999", "VERSION_LOOKUP", 0.95), ("IS 5 : 1999 clause 4", "CLAUSE_LOOKUP", 0.98), ("section 7 please", "CLAUSE_LOOKUP", 0.88), ("is it applicable to toys", "APPLICABILITY_QUERY", 0.85), ("IS 5 applies to toys", "APPLICABILITY_QUERY", 0.95),
    ("permissible error of IS 5", "REQUIREMENT_DISCOVERY", 0.86), ("sampling plan", "REQUIREMENT_DISCOVERY", 0.65), ("the sampling plan of toys", "REQUIREMENT_DISCOVERY", 0.75), ("test procedure and protocol", "TESTING_REQUIREMENT", 0.95), ("overview of BIS please", "GENERAL_INFORMATION", 0.85),
    ("any requirement at all", "REQUIREMENT_DISCOVERY", 0.60), ("joke about cement", "UNSUPPORTED", 0.95), ("धारा 4 दिखाओ", "CLAUSE_LOOKUP", 0.88), ("यह क्या चीज है", "GENERAL_INFORMATION", 0.65), ("क्या लागू होगा", "APPLICABILITY_QUERY", 0.85),
]


def test_intents(spark):
    rows = values(spark, INTENTS, "t string, i string, c double", "t", I.intent(F.col("t")).alias("r"), "i", "c")
    wrong = [(r.t, r.r.intent, r.r.confidence, r.r.signals) for r in rows if (r.r.intent, r.r.confidence) != (r.i, r.c)]
    assert not wrong
    r = values(spark, [("compare the amendment 2 of IS 5 with clause 4",)], "t string", I.intent(F.col("t")))[0][0]
    assert r.intent == "COMPARISON_QUERY" and r.signals == ["comparison", "amendment", "clause", "standard_number"] and not r.ambiguous
    assert {(c.intent, c.score) for c in r.candidates} == {("AMENDMENT_LOOKUP", 0.98), ("CLAUSE_LOOKUP", 0.98), ("STANDARD_LOOKUP", 0.96)}
    assert values(spark, [(None,)], "t string", I.intent(F.col("t")))[0][0].signals == ["empty_query"]


def test_strategies_states_and_models(spark):
    rows = values(spark, [("show clause 4 of IS 5", "IDENTIFIER_HEAVY", "IDENTIFIER_SPECIFIC"), ("latest IS 5", "TEMPORAL_AWARE", "TEMPORAL"), ("does it apply to PVC pipes", "APPLICABILITY_EVALUATION", "NORMAL"), ("does it apply to us", "APPLICABILITY_EVALUATION", "MISSING_REQUIRED_CONTEXT"), ("find standards for toys", "STANDARD_DISCOVERY", "SEMANTIC"), ("hm", "BROAD_FALLBACK", "AMBIGUOUS")], "t string, s string, q string", I.query_context(F.col("t")).alias("c"), "s", "q")
    assert [(r.c.strategy, r.c.state) for r in rows] == [(r.s, r.q) for r in rows]
    model = F.struct(F.lit("OTHER").alias("intent"), F.lit(0.9).alias("confidence"))
    pick = lambda t, m: tuple(values(spark, [(t,)], "t string", I.final_intent(I.intent(F.col("t")), m))[0][0])
    assert pick("IS 5", model) == ("STANDARD_LOOKUP", 0.96, "deterministic") and pick("hm", model) == ("OTHER", 0.9, "model") and pick("hm", None)[2] == "deterministic"
    e = values(spark, [("IS 1950",), ("IS 5 of 1999",), ("in 1999",)], "t string", entities(F.col("t")))
    assert [(r[0].number, r[0].year) for r in e] == [("1950", None), ("5", 1999), (None, None)]


def test_discovery(spark):
    docs = spark.createDataFrame([(1, "red water pump of brass", "IS 1", "4"), (2, "water pump test", "IS 1", "5"), (3, "water pump marking", "IS 1", "6"), (4, "lamp", "IS 2", ""), (5, "pump", None, "1")], "id long, text string, std string, clause string")
    titles = spark.createDataFrame([("IS 1", "Water pump"), ("IS 9", "Kettles")], "std string, title string")
    products = spark.createDataFrame([(7, "water pump"), (8, "kettle")], "p long, name string")
    known = spark.createDataFrame([(7, "IS 1"), (7, "IS 9"), (8, "IS 2")], "p long, std string")
    got = [tuple(r) for r in D.discover(products, "p", "name", docs, "id", "text", "std", "clause", titles, "title", known).select("p", "std", "origin", "n_texts", "status", "rank").orderBy("p", "rank").collect()]
    assert got == [(7, "IS 1", "found", 3, "STRONG_CANDIDATE", 1), (7, "IS 9", "known", 0, "INSUFFICIENT_EVIDENCE", 2), (8, "IS 9", "known", 0, "POSSIBLE_CANDIDATE", 1), (8, "IS 2", "known", 0, "INSUFFICIENT_EVIDENCE", 2)]  # a title that fits is a candidate without a hit


def test_comparison_of_ranges_texts_and_one_sided_units(spark):
    def state(value=None, unit=None, op="LE", lower=None, upper=None, nominal=None, req_unit=None, low=None, high=None, text=None, req_text=None, req_tolerance=None, tolerance=None):
        return (value, tolerance, unit, op, lower, upper, nominal, req_unit, low, high, text, req_text, req_tolerance)

    cases = [
        (state(5.0, None, "LE", upper=10.0, req_unit="mm"), "MATCH"),  # a unit on one side only is no obstacle
        (state(5.0, "bar", "LE", upper=10.0, req_unit="mm"), "UNVERIFIABLE"),
        (state(op="LE", upper=10.0), "MISSING"),
        (state(low=5.0, high=8.0, op="RANGE", lower=4.0, upper=9.0), "MATCH"),
        (state(low=5.0, high=10.0, op="RANGE", lower=4.0, upper=9.0), "PARTIAL_MATCH"),
        (state(low=10.0, high=11.0, op="RANGE", lower=4.0, upper=9.0), "MISMATCH"),
        (state(low=0.5, high=0.8, unit="cm", op="RANGE", lower=4.0, upper=9.0, req_unit="mm"), "MATCH"),
        (state(low=5.0, high=8.0, op="LE", upper=9.0), "UNVERIFIABLE"),
        (state(low=5.0, op="RANGE", lower=4.0, upper=9.0), "UNVERIFIABLE"),
        (state(text="high", op="LE", upper=9.0), "UNVERIFIABLE"),
        (state(text=" Steel ", op="CONTAINS", req_text="of STEEL"), "MATCH"),
        (state(text="brass", op="EQ", req_text="of steel"), "MISMATCH"),
        (state(text="steel", op="EQ", nominal=3.0, req_text="of steel"), "UNVERIFIABLE"),
        (state(9.0, op="EQ", nominal=10.0, req_tolerance=1.0), "MATCH"),
        (state(8.0, op="EQ", nominal=10.0, req_tolerance=1.0), "MISMATCH"),
        (state(8.0, op="EQ", lower=7.0, upper=9.0), "MATCH"),
        (state(8.0, op="RANGE", lower=7.0), "UNVERIFIABLE"),
        (state(8.0, op="EQ"), "UNVERIFIABLE"),
        (state(8.0, op="NEAR", nominal=8.0), "UNVERIFIABLE"),
        (state(8.0, op="LE", nominal=9.0, upper=7.0), "MATCH"),  # the threshold stands before the upper bound
        (state(8.0, op="LT", nominal=8.0), "MATCH"),
    ]
    schema = "value double, tolerance double, unit string, op string, lower double, upper double, nominal double, req_unit string, low double, high double, text string, req_text string, req_tolerance double"
    names = [c.split()[0] for c in schema.split(", ")]
    got = values(spark, [c for c, _ in cases], schema, U.compare(*[F.col(n) for n in names]))
    assert [r[0] for r in got] == [want for _, want in cases]


def test_specification_reader(spark):
    from strataframe.functions import extract as E

    text = "Capacity: 12 L, thickness = 2.5 ± 0.1 mm\nheat resistance: high; calibrated range: between -20.0 and 10.0\nlength is 5 to 7 mm\nCapacity: 13 L\nnothing\nx > 4 kg, Material grade: 304, : 5"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, t string")
    got = {r.name: (r.p.value, r.p.lower, r.p.upper, r.p.text, r.p.unit) for r in E.specification(df, "id", "t").collect()}
    assert got == {
        "Capacity": (13, None, None, None, "L"), "thickness": (2.5, 2.4, 2.6, None, "mm"), "heat resistance": (None, None, None, "high", None), "calibrated range": (None, 20, 10, None, None),
        "length": (None, 5, 7, None, "mm"), "x": (4, 4, None, None, "kg"), "Material grade": (304, None, None, None, None),
    }
    p = E.specification_properties(df, "id", "t").filter("id = 1").first()
    assert (p.material, p.dimensions, p.capacity, p.rating) == ("304", None, "12 L", None)


def test_specifications_are_read_row_by_row(spark):
    """No row waits for another: nothing is dealt anew or sorted over rows, and a key that comes twice keeps both its texts."""
    from strataframe.functions import extract as E

    df = spark.createDataFrame([(1, "mass: 5 kg\nlength is 5 to 7 mm, mass: 6 kg"), (1, "mass: 7 kg"), (None, "length is 1 to 2 mm; length is 3 to 4 mm"), (2, ",".join(f"n{i % 4000}: {i} kg" for i in range(8000)))], "id long, t string")
    out = E.specification(df, "id", "t")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan and "Aggregate" not in plan
    rows = out.select("id", "name", "p.value", "p.lower", "p.upper").collect()
    assert sorted((r.id or 0, r.name, r.value or 0, r.lower or 0, r.upper or 0) for r in rows if r.id != 2) == [(0, "length", 0, 1, 2), (1, "length", 0, 5, 7), (1, "mass", 6, 0, 0), (1, "mass", 7, 0, 0)]
    assert {r.name: r.value for r in rows if r.id == 2} == {f"n{i}": 4000 + i for i in range(4000)} and len(rows) == 4004


def test_answers_are_validated_whole(spark):
    answers = spark.createDataFrame([(1, "Wall thickness is 10mm [EV1]. It was tested [EV9].\n\n**Status: Currently in force**"), (2, "Not a claim with evidence.")], "id long, answer string")
    evidence = spark.createDataFrame([(1, "EV1", "Wall thickness is 12mm")], "id_ long, eid string, content string").selectExpr(
        "id_ AS id", "eid", "content"
    ).selectExpr("id AS a", "eid AS id", "CAST(NULL AS STRING) AS hash", "content", "CAST(NULL AS STRING) AS number", "CAST(NULL AS STRING) AS clause", "CAST(NULL AS STRING) AS edition", "CAST(NULL AS STRING) AS amendment", "CAST(NULL AS STRING) AS year", "CAST(NULL AS BOOLEAN) AS is_current", "CAST(NULL AS ARRAY<STRING>) AS titles")
    got = {(r.a, r.claim_id): (r.status, r.issues) for r in D.validate(answers.withColumnRenamed("id", "a"), "a", "answer", evidence).collect()}
    assert got[1, "C1"] == ("UNSUPPORTED", ["unsupported_numerical_value:10mm"])
    assert got[1, "C2"] == ("UNSUPPORTED", ["fake_or_unknown_citation_id:EV9"]) and got[2, "C1"] == ("UNVERIFIABLE", ["missing_citation"]) and len(got) == 3


def test_evidence_is_gathered_by_names(spark):
    asked = spark.createDataFrame([(1, "s", "Wall thickness"), (2, "s", "certification"), (3, "s", "..."), (4, "other", "Wall thickness")], "r long, scope string, name string")
    parameters = spark.createDataFrame(
        [("s", "d1", 0, "maximum wall thickness", 1.0), ("s", "d1", 1, "wall-thickness", 2.0), ("s", "d2", 0, "Wall thickness", 3.0), ("s", "d2", 1, "WALL THICKNESS", 4.0), ("s", "d3", 0, "thickness", 5.0), ("s", "d4", 0, "outer wall thickness nominal", 6.0), ("t", "d5", 0, "Wall thickness", 7.0)],
        "scope string, doc string, pos int, name string, value double",
    )
    tests = spark.createDataFrame([("s", "d1", "Thickness", "9", "PASS"), ("s", "d3", "Mean wall thickness (mm)", "8", "FAIL"), ("s", "d3", "colour", "x", "PASS")], "scope string, doc string, name string, value string, verdict string")
    standards = spark.createDataFrame([("s", "d2", "IS 5"), ("t", "d5", "IS 6")], "scope string, doc string, number string")
    got = sorted(tuple(r) for r in D.gather_evidence(asked, "r", "scope", "name", parameters, tests, standards).select("req", "doc", "source", "matched", "value").collect())
    assert got == [
        (1, "d1", "parameter", "wall-thickness", "2.0"), (1, "d1", "test", "Thickness", "9"), (1, "d2", "parameter", "Wall thickness", "3.0"), (1, "d3", "test", "Mean wall thickness (mm)", "8"),
        (1, "d4", "parameter", "outer wall thickness nominal", "6.0"), (2, "d2", "standard", "standard_reference", "IS 5"),
    ]


def test_query_variants_by_intent(spark):
    from strataframe.functions import extract as E

    s = "q string, i string, n string, c string, p string"
    rows = [("Q ", "STANDARD_DISCOVERY", None, None, "pumps"), ("Q", "STANDARD_DISCOVERY", None, None, ""), ("Q", "APPLICABILITY_QUERY", "IS 5", None, "pumps"), ("is 5 clause 4", "CLAUSE_LOOKUP", "IS 5", "4", None), ("Q", "OTHER", "IS 5", "4", "pumps"), ("Q", None, None, None, None)]
    got = [r[0] for r in values(spark, rows, s, E.query_variants(F.col("q"), F.col("i"), F.col("n"), F.col("c"), F.col("p")))]
    assert got == [["Q ", "Indian Standard specification pumps", "Quality Control Order pumps"], ["Q"], ["Q", "IS 5 scope pumps", "IS 5 clause 1 scope"], ["is 5 clause 4", "IS 5 section 4"], ["Q"], ["Q"]]


def test_index_contract(spark):
    import json

    from strataframe.functions import contract as K

    good = {n: 1 if kind == "int" else "x" for n, kind in K.FIELDS.items()} | {"schema_version": "6.0", "standard_relation": "identity", "standard_id": "std_5", "version_id": "ver_std_5_1994", "page_start": 2, "page_end": 3}
    less = lambda *names: {k: v for k, v in good.items() if k not in names}
    cases = [
        (good, []),
        (good | {"page_start": -1, "page_end": -1}, []),
        (less("part", "authority"), ["missing fields: ['authority', 'part']"]),
        (good | {"b": 1, "a": 2}, ["unexpected fields: ['a', 'b']"]),
        (good | {"chunk_id": ""}, ["required field 'chunk_id' is empty"]),
        (good | {"chunk_id": None}, ["required field 'chunk_id' is empty", "field 'chunk_id' is None; the store has no null"]),
        (good | {"schema_version": "5.0"}, ["schema_version '5.0' != current '6.0'"]),
        (good | {"chunk_index": "1", "section": 4, "standard_year": True, "part": 1.5}, ["field 'chunk_index' must be int, got str", "field 'section' must be str, got int", "field 'standard_year' must be int, got bool", "field 'part' must be str, got float"]),
        (good | {"page_start": 0, "page_end": 0}, ["page_start 0 is not a valid page number", "page_end 0 is not a valid page number"]),
        (good | {"page_start": 5, "page_end": 4}, ["inverted page range: page_start=5 > page_end=4"]),
        (good | {"standard_id": "", "version_id": ""}, ["standard_relation='identity' but standard_id is empty", "standard_relation='identity' but version_id is empty"]),
        (good | {"standard_relation": "none"}, ["standard_relation='none' must not carry standard_id 'std_5'", "standard_relation='none' must not carry version_id 'ver_std_5_1994'"]),
        (good | {"standard_relation": "reference", "standard_id": "", "version_id": ""}, []),
        (good | {"standard_relation": "odd"}, ["unknown standard_relation 'odd'"]),
        (good | {"standard_relation": "reference", "standard_id": ""}, ["standard_relation='reference' must not carry version_id 'ver_std_5_1994'", "version_id present without standard_id"]),
        (good | {"version_id": "ver_std_6_1"}, ["version_id 'ver_std_6_1' does not belong to standard_id 'std_5'"]),
    ]
    df = spark.createDataFrame([(i, json.dumps(m)) for i, (m, _) in enumerate(cases)] + [(98, "bad"), (99, None)], "i int, m string")
    got = [r.p for r in df.select("i", K.contract_problems(F.col("m")).alias("p")).orderBy("i").collect()]
    assert got[:-2] == [want for _, want in cases]
    assert got[-1] == got[-2] and got[-1][0].startswith("missing fields: ['amendment'") and len(got[-1]) == 1


def test_schemes_are_selected_with_their_lookups(spark):
    catalogue = spark.createDataFrame(
        [(0, "IS 269:2015", "Cement specification", ["portland cement"], "building", True, "Cement Order 2003"), (1, "IS 1417:2016", "Gold alloys", ["gold jewellery"], "precious", True, None), (2, "IS 694:2010", "PVC cables", ["pvc cables"], "wire", False, None), (3, "IS 16694:2018", "Other things", ["odd goods"], "misc", None, None)],
        "pos int, number string, title string, products array<string>, category string, mandatory boolean, order_number string",
    )
    orders = spark.createDataFrame([(0, "S.O. 1", "Cement Order 2003", True), (1, "S.O. 694", "Wires of all kinds", True), (2, "S.O. 9", "IS 16694 goods", None)], "pos int, number string, title string, mandatory boolean")
    rows = [
        (1, None, "certify portland cement", None, None, None, "IS 269:2015", "S.O. 1", True, "SCHEME-I"),
        (2, None, "imported portland cement", None, None, None, "IS 269:2015", "S.O. 1", True, "SCHEME-X"),
        (3, "IS 269", "portland cement is 269", None, None, "overseas", "IS 269:2015", "S.O. 1", True, "SCHEME-X"),
        (4, "IS 16444", "gold jewellery", None, None, None, "IS 1417:2016", None, True, "SCHEME-IV"),  # the product counts, not a strange number
        (5, "is694", None, None, None, None, "IS 694:2010", "S.O. 694", False, "SCHEME-I-VOLUNTARY"),  # the catalogue's fact before the order's
        (6, "IS 694", None, True, None, None, "IS 694:2010", "S.O. 694", True, "SCHEME-I"),
        (7, "IS 16694", None, None, None, None, "IS 16694:2018", "S.O. 9", True, "SCHEME-I"),
        (8, None, None, None, None, "domestic", None, None, False, "SCHEME-CLARIFICATION-REQUIRED"),
        (9, "IS 99999", None, None, "Order 7", None, "IS 99999", "Order 7", False, "SCHEME-I-VOLUNTARY"),
    ]
    asks = spark.createDataFrame([r[:6] for r in rows], "id int, number string, product string, must boolean, ord string, origin string")
    got = {r.id: tuple(r)[1:] for r in D.select_scheme(asks, "id", "number", "product", "must", "ord", "origin", catalogue, orders).collect()}
    assert got == {r[0]: r[6:] for r in rows}


@pytest.mark.parametrize("module", ["more", "retrieval", "rules", "store", "temporal", "text"])
def test_names_of_plans_are_bound_once(module):
    """A query reads its module's names when it runs: a second list of the same name would be read by the first one's queries."""
    import ast
    import importlib

    tree = ast.parse(open(importlib.import_module(f"strataframe.plans.{module}").__file__).read())
    names = [n.id for s in tree.body if isinstance(s, ast.Assign) for t in s.targets for n in ast.walk(t) if isinstance(n, ast.Name)]
    names += [s.name for s in tree.body if isinstance(s, ast.FunctionDef) and s.name != "_"]
    assert sorted(names) == sorted(set(names))


def test_equal_descriptions_are_scored_once(spark):
    names = [f"{a} {b}" for a in ("large", "small", "blue", "cold", "iron", "brass", "steel", "round") for b in ("widget", "bolt", "ring", "valve", "pump", "wire", "panel", "meter")]
    asks = [(i, None if i % 1000 == 999 else f"{names[i % 64]} promo") for i in range(40_000)]
    rows = [(f"b{i:02}", names, "promo specification part", "promo") for i in range(25)]
    asks, rows = spark.createDataFrame(asks, "q long, text string"), spark.createDataFrame(rows, "b string, products array<string>, title string, category string")
    start = time.time()
    got = joins.match_catalogue(asks, "q", "text", rows, "b", "products", "title", "category").collect()
    assert time.time() - start < 60
    assert {r.q for r in got} == {i for i in range(40_000) if i % 1000 != 999}
    # the name itself, the seven others with its first word, the seven with its second, where the words have four letters
    first = {r.q: (r.b, r.score) for r in got}
    score = lambda n: 10 + 21 * sum(len(w) > 3 for w in n.split()) + 2 + 1
    assert all(first[i] == ("b00", score(names[i])) for i in range(64))


def test_rendered_texts_are_read_by_many_tasks(spark, tmp_path):
    """One small file of short columns is one task; what reads long texts rendered from it must not be."""
    import __spark_entry__ as entry

    spark.createDataFrame([(i, i % 50, f"p{i}", "b", "t") for i in range(400)], "p_partkey long, p_size int, p_name string, p_brand string, p_type string").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for name in ("x31_tender_requirements", "x29_requirements", "x45_structured_intent", "x38_claim_issues"):
        assert entry.queries()[name](spark, str(tmp_path)).rdd.getNumPartitions() >= 8, name


def test_evidence_of_a_name_is_found_once(spark):
    """Requirements that ask the same of one scope share the search: the comparison sees one row a scope and name."""
    asked = spark.createDataFrame([(i, "s", "Wall thickness") for i in range(50)], "r long, scope string, name string")
    parameters = spark.createDataFrame([("s", f"d{i}", n, "maximum wall thickness" if n else "Thick wall thickness", 1.0) for i in range(20) for n in (0, 1)], "scope string, doc string, pos int, name string, value double")
    tests = spark.createDataFrame([], "scope string, doc string, name string, value string, verdict string")
    got = D.gather_evidence(asked, "r", "scope", "name", parameters, tests, spark.createDataFrame([], "scope string, doc string, number string"))
    assert {(r.req, r.doc, r.matched) for r in got.collect()} == {(i, f"d{d}", "Thick wall thickness") for i in range(50) for d in range(20)}
    words = [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate explode(" in line and "req" in line]
    assert not words  # words are cut of names, not of requirements


def test_evidence_is_handed_out_by_many_tasks(spark):
    """The rows of a hot scope and name are made by many tasks, whether requirements or documents are many."""
    none = spark.createDataFrame([], "scope string, doc long, name string, value string, verdict string"), spark.createDataFrame([], "scope string, doc long, number string")
    for asks, docs in ((12_000, 20), (4, 90_000)):
        asked = spark.createDataFrame([(i, "s", "Wall thickness") for i in range(asks)], "r long, scope string, name string")
        parameters = spark.createDataFrame([("s", i, 0, "wall-thickness", 1.0) for i in range(docs)], "scope string, doc long, pos int, name string, value double")
        got = D.gather_evidence(asked, "r", "scope", "name", parameters, *none)
        made = got.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"), F.sum(F.col("req") * F.lit(docs) + F.col("doc")).alias("s")).collect()
        n = asks * docs
        assert sum(m.n for m in made) == n and sum(m.s for m in made) == n * (n - 1) // 2  # each pair is a number below n
        assert len(made) >= 4 and max(m.n for m in made) <= n / 2
