"""What is read from questions, tenders, reports and translations, on cases worked out by hand."""

import datetime

from pyspark.sql import functions as F

from strataframe.functions import context as K
from strataframe.functions import extract as E


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]


def test_products(spark):
    p = one(spark, K.product_context, "We make electric water heaters of SS for home use, 5 litre and 3 kW, resistance heating, IS 2082")
    assert (p.product, p.material, p.technology, p.principle, p.use, p.capacities, p.standards) == ("electric water heater", "stainless steel", "electric", "resistance heating", "domestic", ["5 litre", "3 kW"], ["IS 2082"])
    p = one(spark, K.product_context, "which standard covers the garden hoses in Pune")
    assert (p.product, p.material, p.use, p.capacities) == ("garden hoses", None, None, [])
    assert one(spark, K.product_context, "requirements for IS 5 under it").product is None
    assert one(spark, K.product_context, None).product is None


def test_businesses(spark):
    b = one(spark, K.business_context, "As a manufacturer and MSME startup we make PVC pipes, factory in Sonipat, sold to Dealers with ISI mark")
    assert (b.activity, b.type, b.size, b.location, b.category, b.customer, b.certifications) == ("manufacturing", "manufacturer", "MSME (Micro)", "Sonipat", "PVC pipes", "Dealers with", ["ISI Mark"])
    assert one(spark, K.business_context, "orders in January and in Force at Pune").location == "Pune"
    assert one(spark, K.business_context, "things in Sonipat").location is None  # no known place and no factory
    assert one(spark, K.business_context, "does it apply to the brass taps with threads").category == "brass taps"
    both = lambda t: F.struct(F.lit(None).cast("string").alias("size"), F.array(F.lit("a")).alias("marks"))
    profile = F.struct(F.lit("Startup").alias("size"), F.array(F.lit("b"), F.lit("a")).alias("marks"))
    assert tuple(one(spark, lambda t: K.merged(both(t), profile, ["size", "marks"], ("marks",)), "")) == ("Startup", ["b", "a"])


def test_structured_intents(spark):
    i = one(spark, K.structured_intent, "testing requirements for kettles with 230 V and 1.5 kW under IS 367 : 1993 clause 4 for export to India by S.O. 12(E)")
    assert (i.intent, i.product, i.characteristics, i.standards, i.jurisdiction, i.year, i.clause) == ("CLAUSE_LOOKUP", "kettles", ["230 V", "1.5 kW"], ["IS 367"], "Foreign Manufacturer", 1993, "4")
    assert i.orders == ["S.O. 12(E)"] and i.service is None
    assert one(spark, K.structured_intent, None).intent == "AMBIGUOUS_QUERY"


def test_tenders(spark):
    r = one(spark, E.tender_requirement, "2) Storage capacity shall be at least 500 L")
    assert (r.name, r.category, r.mandatory, r.op, r.value, r.unit, r.lower, r.upper) == ("Storage capacity", "capacity", "shall", "GE", "500.0", "L", 500.0, None)
    r = one(spark, E.tender_requirement, "Thickness must be 3 +/- 0.2 mm")
    assert (r.name, r.op, r.lower, r.upper) == ("Thickness", "RANGE", 2.8, 3.2)
    r = one(spark, E.tender_requirement, "Pressure shall not exceed 6 bar")
    assert (r.op, r.upper, r.category) == ("LE", 6.0, "performance")
    r = one(spark, E.tender_requirement, "Material: stainless steel")
    assert (r.name, r.category, r.value, r.mandatory) == ("Material", "material", "Material: stainless steel", None)
    assert one(spark, E.tender_requirement, "ab") is None and one(spark, E.tender_requirement, None) is None
    kinds = {"BIS licence": "certification", "calibration report": "documentation", "routine test": "test", "copper": "material", "rated capacity": "capacity", "outer diameter": "dimension", "efficiency": "performance", "colour": "general"}
    assert {t: one(spark, E.tender_category, t) for t in kinds} == kinds


def test_documents(spark):
    kind = lambda t, f="x.pdf": tuple(one(spark, lambda c: E.document_class(c, F.lit(f)), t))
    assert kind("TEST REPORT. Observed value 5, result: pass. Sample tested by NABL")[0] == "TEST_REPORT"
    assert kind("a calibration certificate; calibration due")[0] == "CALIBRATION_REPORT"
    assert kind("nothing of note") == ("OTHER", 0.2) and kind("nothing", "a/manual.pdf") == ("OTHER", 0.2)
    assert kind("user manual " * 9)[1] == 0.95 and kind(None)[0] == "OTHER"
    tie = kind("user manual and schematic")  # one word each
    assert tie == ("MANUAL", 0.95)


def test_evidence_fields(spark):
    text = "Acme Testing Services\nTest Report No: TR/12-9\nNABL Accredited TC-1. Rest\nDate of Issue: 05/03/2020\nValid Up To: 12 March 2022\nIS 9873 Part 2 : 2017 and is 9873 part 2 : 2017"
    today = F.lit("2021-01-01").cast("date")
    e = one(spark, lambda c: E.evidence_fields(c, today), text)
    assert (e.number, e.issuer, e.accreditation, e.standards, e.status) == ("TR/12-9", "Acme Testing Services", "NABL Accredited TC-1", ["IS 9873 PART 2 : 2017"], "ACTIVE")
    assert (e.issued, e.expires) == (datetime.date(2020, 3, 5), datetime.date(2022, 3, 12))
    later = one(spark, lambda c: E.evidence_fields(c, F.lit("2023-01-01").cast("date")), text)
    assert later.status == "EXPIRED"
    bare = one(spark, lambda c: E.evidence_fields(c, today), "ref QA/X-1/20201 of 2019-04-01")
    assert (bare.number, bare.issued, bare.expires, bare.issuer, bare.status) == ("QA/X-1/20201", datetime.date(2019, 4, 1), None, None, "ACTIVE")
    df = spark.createDataFrame([(1, "Length: 5 mm specified < 6 mm; Pass\nshort\nBody is fine and complies with all: it\nno verdict here at all"), (2, None)], "k long, t string")
    rows = [tuple(r) for r in E.verdict_rows(df, "k", "t").orderBy("pos").collect()]
    assert rows[0] == (1, 0, "Length", "5 mm specified", None, "PASS") or rows[0][:3] == (1, 0, "Length") and rows[0][5] == "PASS"
    assert rows[1][1] == 2 and len(rows) == 2


def test_translations(spark):
    source = "**Scheme**\nIS 1293 needs 16 A, see Clause 4.2 [EV1][EV2]"

    def check(text, consumer=False, tip=None):
        r = one(spark, lambda c: E.translation_check(F.lit(source), c, F.lit(consumer), tip), text)
        return r.valid, r.text, r.issues

    good = "**योजना**\nआईएस 1293 के लिए 16 A आवश्यक है, धारा 4.2 देखें [EV1][EV2]"
    assert check(good) == (True, good, [])
    assert check("") == (False, source, ["empty_hindi_translation"]) and check(None)[0] is False
    valid, text, issues = check(good.replace("[EV2]", ""))
    assert valid and text.endswith("\n\nSources: [EV1], [EV2]") and issues == []
    assert check(good.replace("EV2", "EV9"))[2] == ["hallucinated_citation_tokens:EV9"]
    assert check(good.replace("1293", "1294"))[2] == ["missing_standard_numbers:IS 1293"]
    assert check(good.replace("16", "१६"))[0] and not check(good.replace("16 A", "10 A"))[0]  # digits may change script, not value
    assert check("IS 1293 16 A 4.2 [EV1][EV2]")[2][0] == "insufficient_devanagari_script"
    _, text, _ = check(good + "\n\nSources: [EV1], [EV2]", True, "TIP")
    assert "धारा" not in text and text.endswith("TIP\n\nSources: [EV1], [EV2]")
    assert check(good.replace("**योजना**\n", ""))[1].startswith("**Scheme**\n\n")


def test_final_decisions(spark):
    def final(decision="ANSWER", state="ANSWERABLE", level="HIGH", grounding="GROUNDED", current=False, unsettled=False, scheme=False, needs=False, found=True):
        f = F.lit
        return tuple(one(spark, lambda c: E.final_decision(f(decision), f(state), f(level), f(grounding), f(current), f(unsettled), f(scheme), f(needs), f(found)), ""))

    bad = ("VERIFICATION_REQUIRED", True, "INSUFFICIENT_EVIDENCE")
    assert final() == ("ANSWER", False, "ANSWERABLE")
    assert final(grounding="UNSUPPORTED") == bad and final(current=True, unsettled=True) == bad and final(level="LOW") == bad and final(needs=True, found=False) == bad
    assert final(grounding="UNVERIFIABLE") == ("QUALIFIED_ANSWER", False, "ANSWERABLE")
    assert final(level="LOW", scheme=True) == ("ANSWER", False, "ANSWERABLE")
    assert final(state="CONFLICTING_EVIDENCE") == ("VERIFICATION_REQUIRED", True, "CONFLICTING_EVIDENCE")
    assert final(decision="QUALIFIED_ANSWER", state="AMBIGUOUS_QUERY") == ("QUALIFIED_ANSWER", True, "AMBIGUOUS_QUERY")
