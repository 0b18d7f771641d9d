"""Fields read from document headers, clauses, tenders and evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataframe.functions import text as X
from strataframe.functions import units as U
from strataframe.functions.grounding import quantities


def _get(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.trim(F.regexp_extract(c, pattern, group)), F.lit(""))


# How headers write numbers, amendments, editions and dates.
HEADER_NUMBER = r"(?i)\bIS(?:\s+No\.?)?\s+(\d+)(?:\s*(?:-|\(Part\s*)\s*(\d+)\)?)?(?:\s*:\s*(\d{4}))?"
HEADER_AMENDMENT = r"(?i)\b(?:Amendment|Amd\.?)(?:\s+No\.?)?\s*(\d+)"
HEADER_EDITION = r"(?i)\b(First|Second|Third|Fourth|Fifth|Sixth|\d+(?:st|nd|rd|th)?)\s+Edition"
HEADER_DATE = r"(?i)(?:published|effective|dated?)[:\s]+(\d{1,2}\s+\w+\s+\d{4}|\w+\s+\d{4}|\d{4}-\d{2}-\d{2})"


def header(text: Column, filename: Column) -> Column:
    """struct of number, year, part, amendment, edition, published, title and document type of a text's head; NULL where it says nothing.

    The title is the first of its 40 first lines that is a heading of the first
    level (no page mark) or begins with 'TITLE:'.
    """
    start, name = F.lower(F.substring(text, 1, 2000)), F.lower(filename)
    says = lambda w: F.contains(start, F.lit(w))
    kind = (
        F.when(says("amendment") | F.contains(name, F.lit("amd")), "amendment")
        .when(says("indian standard") | F.startswith(name, F.lit("is")), "indian_standard")
        .when(says("guideline"), "guideline")
        .when(says("draft"), "draft")
    )
    lines = F.transform(F.slice(F.split(text, r"\r\n|\n|\r"), 1, 40), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    titled = lambda x: F.startswith(F.upper(x), F.lit("TITLE:"))
    headed = lambda x: F.startswith(x, F.lit("# ")) & (F.length(x) > 3) & ~F.rlike(x, F.lit(r"(?i)<!--\s*PAGE\s+\d+"))
    title = X.let(F.get(F.filter(lines, lambda x: titled(x) | headed(x)), F.lit(0)), lambda x: F.nullif(F.trim(F.when(headed(x), F.substring(x, F.lit(3), F.length(x))).otherwise(F.substring(x, F.lit(7), F.length(x)))), F.lit("")))
    number, part = _get(text, HEADER_NUMBER), _get(text, HEADER_NUMBER, 2)
    return F.struct(
        F.when(part.isNotNull(), F.concat(F.lit("IS "), number, F.lit("-"), part)).otherwise(F.concat(F.lit("IS "), number)).alias("number"), _get(text, HEADER_NUMBER, 3).cast("int").alias("year"), part.alias("part"),
        _get(text, HEADER_AMENDMENT).alias("amendment"), _get(text, HEADER_EDITION, 0).alias("edition"), _get(text, HEADER_DATE).alias("published"), title.alias("title"), kind.alias("document_type"),
    )


def relation(number: Column, kind: Column) -> Column:
    """identity when the text is the standard, reference when it only names one, none otherwise."""
    return F.when(number.isNull(), "none").when(kind.isin("indian_standard", "amendment", "draft"), "identity").otherwise("reference")


def context_contradictions(context: Column, standard: Column, clause: Column, amendment: Column | None = None) -> Column:
    """What a generated context says against its chunk: other standards, clauses that are no ancestors, other amendments."""
    others = F.transform(F.array_distinct(F.filter(F.regexp_extract_all(context, F.lit(X.STANDARD), F.lit(1)), lambda n: F.concat(F.lit("IS "), n) != standard)), lambda n: F.concat(F.lit("standard IS "), n))
    clauses = F.regexp_extract_all(context, F.lit(r"(?i)\bclause\s+(\d+(?:\.\d+)*)"), F.lit(1))
    wrong = F.filter(F.array_distinct(clauses), lambda c: (c != clause) & ~F.startswith(clause, F.concat(c, F.lit("."))))
    out = F.concat(others, F.transform(wrong, lambda c: F.concat(F.lit("clause "), c)))
    if amendment is None:
        return out
    amended = F.filter(F.array_distinct(F.regexp_extract_all(context, F.lit(r"(?i)\bAmendment\s+(\d+)\b"), F.lit(1))), lambda a: a != amendment.cast("string"))
    return F.concat(out, F.transform(F.coalesce(amended, F.array().cast("array<string>")), lambda a: F.concat(F.lit("amendment "), a)))


def cache_key(*parts: Column) -> Column:
    return X.digest(F.to_json(F.struct(*[p.alias(f"k{i}") for i, p in enumerate(parts)])), 32)


# Plurals of product words.
SINGULAR = {
    "thermometers": "thermometer", "heaters": "heater", "cables": "cable", "batteries": "battery", "pipes": "pipe", "helmets": "helmet", "cookers": "cooker", "bars": "bar", "toys": "toy",
    "bottles": "bottle", "cylinders": "cylinder", "valves": "valve", "meters": "meter", "pumps": "pump", "transformers": "transformer", "appliances": "appliance", "switches": "switch",
    "connectors": "connector", "articles": "article", "artefacts": "artefact", "artifacts": "artifact", "wires": "wire", "tubes": "tube", "sheets": "sheet", "plates": "plate", "fittings": "fitting",
}


def product_text(c: Column) -> Column:
    """Words broken at a hyphen joined, quotes removed, plurals of known products made singular in their own case."""
    c = F.regexp_replace(F.regexp_replace(F.trim(c), r"(\b[a-zA-Z]{3,})-\s+([a-zA-Z]{3,}\b)", "$1$2"), "[\"'`_]", " ")
    table = F.create_map(*[F.lit(x) for kv in SINGULAR.items() for x in kv])
    cased = lambda w, one: F.when(w == F.upper(w), F.upper(one)).when(F.substring(w, 1, 1) == F.upper(F.substring(w, 1, 1)), F.initcap(one)).otherwise(one)
    words = F.filter(F.split(c, r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: X.let(F.try_element_at(table, F.lower(w)), lambda one: F.when(one.isNull(), w).otherwise(cased(w, one)))), " ")


def variants(*parts: Column, most: int = 6) -> Column:
    """Distinct filled candidate queries in order."""
    return F.slice(F.array_distinct(F.array_compact(F.array(*[X.blank_to_null(p) for p in parts]))), 1, most)


def _once(parts: Column) -> Column:
    """Filled texts once each, whatever their case, in order."""
    some = F.filter(parts, lambda x: F.coalesce(x != "", F.lit(False)))
    return X.let(some, lambda p: X.let(F.transform(p, F.lower), lambda low: F.filter(p, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)))


def product_queries(name: Column, category: Column, technology: Column, material: Column, use: Column, standards: Column, raw: Column, most: int = 6) -> Column:
    """array<string>: what to ask for a product, from stated facts alone.

    The product by itself, its requirements and its standard; its category
    with technology, material and use; the standards it names; else the text
    as it came.
    """
    full = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    primary, what = F.coalesce(full(name), full(category)), F.coalesce(full(category), full(name))
    join = lambda *parts: F.when(reduce(lambda a, b: a & b, [full(p).isNotNull() for p in parts]), F.concat_ws(" ", *parts))
    made = F.array(primary, F.concat(primary, F.lit(" requirements")), F.concat(primary, F.lit(" standard")), join(technology, what), join(material, what), join(use, what), join(technology, material, what))
    asked = F.concat(made, F.coalesce(standards, F.array().cast("array<string>")))
    return X.let(_once(F.transform(asked, lambda x: product_text(F.coalesce(x, F.lit(""))))), lambda q: F.when(F.size(q) > 0, F.slice(q, 1, most)).otherwise(_once(F.array(product_text(F.coalesce(raw, F.lit("")))))))


def query_variants(query: Column, intent: Column, number: Column, clause: Column, category: Column) -> Column:
    """array<string>: a query and the variants of its intent, by its standard, clause and product category."""
    given = lambda *parts: reduce(lambda a, b: a & b, [F.coalesce(p != "", F.lit(False)) for p in parts])
    none = F.array().cast("array<string>")
    extra = (
        F.when((intent == "STANDARD_DISCOVERY") & given(category), F.array(F.concat(F.lit("Indian Standard specification "), category), F.concat(F.lit("Quality Control Order "), category)))
        .when((intent == "APPLICABILITY_QUERY") & given(number, category), F.array(F.concat(number, F.lit(" scope "), category), F.concat(number, F.lit(" clause 1 scope"))))
        .when((intent == "CLAUSE_LOOKUP") & given(number, clause), F.array(F.concat(number, F.lit(" clause "), clause), F.concat(number, F.lit(" section "), clause)))
    )
    return X.let(F.trim(query), lambda q: F.concat(F.array(query), F.filter(_once(F.transform(F.coalesce(extra, none), lambda x: F.trim(x))), lambda x: F.lower(x) != F.lower(q))))


def requirements(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, name, p (a quantity): one row for each line or sentence that sets a limit."""
    parts = F.split(text, r"[\r\n;]+|(?<!\d)\.(?!\d)")
    own = df.select(key, F.posexplode(parts).alias("pos", "line")).withColumn("p", U.requirement(F.trim("line")))
    return own.filter("p IS NOT NULL").select(key, "pos", "p.name", "p")


# How a line states a parameter without a colon, in order; group 1 is its name.
STATED = (
    r"(?i)([a-zA-Z_][a-zA-Z0-9_\s]{1,30}?)\s*(?:[:=]|\bis\b)\s*\d+(?:\.\d+)?\s*(?:±|\+/-)\s*\d+(?:\.\d+)?",
    r"(?i)([a-zA-Z_][a-zA-Z0-9_\s]{1,30}?)\s*(?:[:=]|\bis\b)\s*(?:between\s+)?\d+(?:\.\d+)?\s*(?:to|-|and)\s*\d+(?:\.\d+)?",
    r"(?i)([a-zA-Z_][a-zA-Z0-9_\s]{1,30}?)\s*(?:[:=]|\bis\b)?\s*(?:<=|>=|<|>|=)\s*\d+(?:\.\d+)?",
    r"(?i)([a-zA-Z_][a-zA-Z0-9_\s]{1,30}?)\s*[:=]\s*(?:\d+(?:\.\d+)?|[a-zA-Z0-9_\s\-/]+)",
)


def specification(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, name, p: the parameters of a product's specification, one row a name.

    Lines end at breaks, semicolons and commas. 'name: value' or 'name = value'
    is a parameter, with a text for a value where there is no number, and the
    last line of a name counts; other lines are parameters where they state
    one, the first of a name that has no line of the first kind. Names meet
    inside their text, so no row of ``df`` waits for another.
    """

    def stated(line: Column, pos: Column) -> Column:
        return X.let(F.coalesce(*[_get(line, p) for p in STATED]), lambda name: F.when(name.isNotNull(), F.struct(name.alias("name"), pos.alias("rank"), U.parameter(line, name).alias("p"))))

    def read(line: Column, pos: Column) -> Column:
        pair = F.struct(_get(line, r"(?s)^([^:=]*)[:=]").alias("name"), _get(line, r"(?s)^[^:=]*[:=](.*)$").alias("value"))
        own = lambda x: F.struct(x["name"].alias("name"), (-1 - pos).alias("rank"), F.when(x["name"].isNotNull() & x["value"].isNotNull(), U.parameter(x["value"], x["name"])).alias("p"))
        return X.let(X.let(pair, own), lambda x: F.when(x["p"].isNotNull(), x).otherwise(stated(line, pos)))

    lines = F.transform(F.split(text, r"[\r\n;,]+"), lambda x: F.trim(x))
    found = F.filter(F.transform(lines, read), lambda x: x["p"].isNotNull())
    # by name and rank: first the last line of the first kind, else the first of the others
    firsts = X.let(F.sort_array(found), lambda a: F.filter(a, lambda x, i: (i == 0) | (x["name"] != F.get(a, i - 1)["name"])))
    return df.select(key, F.explode(firsts).alias("s")).select(key, "s.name", "s.p")


def specification_properties(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, material, dimensions, capacity, rating: the first 'name: value' line whose name has the word."""
    lines = F.transform(F.split(text, r"[\r\n;,]+"), lambda x: F.trim(x))
    value = lambda word: F.nullif(F.trim(F.regexp_extract(F.coalesce(F.get(F.filter(lines, lambda x: F.rlike(x, F.lit(rf"(?is)^[^:=]*{word}[^:=]*[:=]\s*\S"))), F.lit(0)), F.lit("")), r"(?s)^[^:=]*[:=](.*)$", 1)), F.lit(""))
    return df.select(key, *[value(w).alias(n) for w, n in (("material", "material"), ("dimension", "dimensions"), ("capacity", "capacity"), ("rating", "rating"))])


# Categories of a tender's clauses in their order, and words that make one binding.
TENDER_CATEGORIES = (
    ("certification", r"bis|isi\s+mark|certification|certified|license|licence|conformance"),
    ("documentation", r"test\s+report|certificate|calibration\s+report|manual|datasheet|drawing|warranty"),
    ("test", r"test|testing|inspection|sampled|routine\s+test|type\s+test|hydraulic\s+test|tensile"),
    ("material", r"material|grade|stainless\s+steel|polyethylene|copper|aluminum|mild\s+steel"),
    ("capacity", r"capacity|volume|storage|rated\s+capacity"),
    ("dimension", r"dimension|dimensions|diameter|thickness|height|width|length|size"),
    ("performance", r"temperature|pressure|efficiency|voltage|power|frequency|speed|rating"),
)
MANDATORY = r"shall|must|mandatory|strictly\s+required|compulsory|is\s+required\s+to\s+be"


def tender_category(c: Column) -> Column:
    (w0, p0), *rest = TENDER_CATEGORIES
    has = lambda p: F.rlike(c, F.lit(rf"(?i)\b(?:{p})\b"))
    return reduce(lambda a, x: a.when(has(x[1]), x[0]), rest, F.when(has(p0), w0)).otherwise("general")


def mandatory_word(c: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(c, rf"(?i)\b({MANDATORY})\b", 1)), F.lit(""))


def is_mandatory(c: Column) -> Column:
    return mandatory_word(c).isNotNull()


def _bare(clause: Column) -> Column:
    """A clause without its list marker."""
    return F.trim(F.regexp_replace(F.trim(clause), r"^(?:\(?\d+[.)](?!\d)|[a-zA-Z][.)]|[-*])\s*", ""))


def tender_requirement(clause: Column) -> Column:
    """struct<text, name, category, mandatory, op, value, unit, lower, upper> of a tender's clause; NULL under five characters.

    The name is what stands before the verb or sign. The operator comes from
    the quantity's bounds, else from the clause's words; a clause without a
    quantity names a standard, or is called by its first words.
    """
    def read(t: Column) -> Column:
        low = F.lower(t)
        says = lambda *w: reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in w])
        head = F.trim(F.get(F.split(t, r"(?i)\b(?:shall|must|is|should|is\s+required|has\s+to\s+be)\b|<=|>=|<|>|=|:", 2), 0))

        def with_quantity(subject: Column, p: Column) -> Column:
            words = F.when(says("shall not exceed", "maximum", "up to"), "LE").when(says("shall be at least", "shall not be less than", "minimum"), "GE").when(says("between"), "RANGE").otherwise("EQ")
            most, least = says("shall not exceed", "up to"), says("shall be at least", "shall not be less than", "minimum")
            op = F.when(p["lower"].isNotNull() & p["upper"].isNotNull(), "RANGE").when(p["lower"].isNotNull(), "GE").when(p["upper"].isNotNull(), "LE").when(most, "LE").when(least, "GE").otherwise("EQ")
            std = F.nullif(F.upper(F.regexp_extract(t, r"(?i)\bIS\s+\d+(?:-\d+)?\b", 0)), F.lit(""))
            first = F.nullif(F.array_join(F.transform(F.filter(F.slice(F.split(t, r"\s+"), 1, 4), lambda w: F.rlike(w, F.lit("^[a-zA-Z0-9]+$"))), lambda w: F.lower(w)), "_"), F.lit(""))
            there = p.isNotNull()
            name = F.when(there, F.coalesce(subject, p["name"])).when(std.isNotNull(), F.concat(F.lit("standard_conformance_"), std)).otherwise(F.coalesce(first, F.lit("tender_clause")))
            return F.struct(
                t.alias("text"), name.alias("name"), tender_category(t).alias("category"), mandatory_word(t).alias("mandatory"), F.when(there, op).otherwise(words).alias("op"),
                F.when(there, F.coalesce(p["value"].cast("string"), p["text"])).otherwise(std).alias("value"), p["unit"].alias("unit"),
                F.when(there & p["lower"].isNull() & p["upper"].isNull() & least & ~most, p["value"]).otherwise(p["lower"]).alias("lower"),
                F.when(there & p["lower"].isNull() & p["upper"].isNull() & most, p["value"]).otherwise(p["upper"]).alias("upper"),
            )

        named = lambda h: F.when(F.length(h) > 2, h)
        stated = X.let(head, lambda h: X.let(named(h), lambda n: F.struct(n.alias("subject"), U.parameter(t, n).alias("p"))))
        return X.let(stated, lambda x: with_quantity(x["subject"], x["p"]))

    return X.let(_bare(clause), lambda t: F.when(F.length(t) >= 5, read(t)))


def tender_requirements(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, r (a tender requirement): one row for each line, sentence or part between semicolons."""
    parts = F.split(text, r"[\r\n;]+|(?<!\d)\.(?!\d)")
    lines = df.select(key, F.posexplode(parts).alias("pos", "line")).filter(F.length(_bare(F.col("line"))) >= 5)  # not on the requirement, which would be read twice
    return lines.select(key, "pos", tender_requirement(F.col("line")).alias("r"))


# Kind -> (weight, words of the text, patterns of the file's name).
DOCUMENT_KINDS = {
    "CALIBRATION_REPORT": (1.2, ["calibration certificate", "calibration report", "calibrated on", "calibration due", "traceability", "standard used for calibration", "calibrated by", "uncertainty of measurement", "calibration equipment"], ["calib", "calibration"]),
    "DECLARATION": (1.2, ["declaration of conformity", "manufacturer declaration", "self-declaration", "supplier declaration", "we hereby declare", "declare under our sole responsibility", "eu declaration"], ["declaration", "conformity_dec", "self_dec"]),
    "CERTIFICATE": (1.0, ["certificate of conformity", "compliance certificate", "bis licence", "isi mark certificate", "iso 9001", "certification", "valid up to", "certified that", "certification mark", "license number"], ["certificate", "cert_", "licence", "license"]),
    "TEST_REPORT": (1.0, ["test report", "test certificate", "testing laboratory", "test laboratory", "sample description", "test results", "test result", "test method", "nabl accredited", "nabl", "sample tested", "date of testing", "specified requirement", "observed value", "test parameter", "pass/fail", "result: pass", "result: fail"], ["test_report", "test_cert", "test_result", "testing"]),
    "LAB_REPORT": (1.0, ["laboratory analysis report", "chemical analysis report", "test analysis", "analytical report", "spectroscopy", "metallurgical analysis", "chemical composition", "chromatography", "microstructure"], ["lab_report", "chemical_analysis", "spectro"]),
    "QUALITY_RECORD": (1.0, ["quality inspection report", "factory inspection", "quality plan", "qap", "incoming inspection", "batch inspection", "qc report", "inspection report", "pre-dispatch inspection", "quality assurance"], ["qap", "qc_report", "inspection", "quality_record"]),
    "DRAWING": (1.1, ["engineering drawing", "schematic diagram", "circuit diagram", "assembly drawing", "ga drawing", "scale:", "all dimensions in mm", "drawing no", "drawn by", "checked by", "projection:"], ["drawing", "schematic", "cad_", "diagram"]),
    "MANUAL": (1.0, ["user manual", "operating instructions", "instruction manual", "installation guide", "user guide", "maintenance instructions", "safety instructions", "troubleshooting", "how to operate"], ["manual", "user_guide", "instructions", "install_guide"]),
    "TECHNICAL_SPECIFICATION": (0.9, ["technical specification", "data sheet", "datasheet", "product specification", "spec sheet", "rated voltage", "rated power", "technical data", "operating temperature", "electrical characteristics"], ["datasheet", "tech_spec", "spec_sheet", "data_sheet"]),
}


def document_class(text: Column, filename: Column) -> Column:
    """struct<kind, confidence> of a business document.

    Each word counts up to three times, the file's name once; the confidence
    grows with the lead over the second kind. Under 2 it is OTHER.
    """

    def ranked(t: Column, f: Column) -> Column:
        rows = []
        for i, (kind, (weight, words, names)) in enumerate(DOCUMENT_KINDS.items()):
            found = F.aggregate(F.transform(F.array(*[F.lit(w) for w in words]), lambda w: F.least(((F.length(t) - F.length(F.replace(t, w, F.lit("")))) / F.length(w)).cast("int"), F.lit(3))), F.lit(0), lambda a, n: a + n)
            named = F.when(F.rlike(f, F.lit("|".join(names))), 1.5).otherwise(0.0)
            rows.append(F.struct(((found * 2.5 + named) * weight).cast("double").alias("s"), F.lit(-i).alias("at"), F.lit(kind).alias("kind")))
        return F.sort_array(F.array(*rows), asc=False)

    def judged(r: Column) -> Column:
        top, second = F.get(r, 0), F.get(r, 1)
        sure = F.greatest(F.lit(0.55), F.least(F.lit(0.98), 0.60 + 0.35 * (top["s"] - second["s"]) / F.greatest(top["s"], F.lit(1.0))))
        return F.when(top["s"] < 2.0, F.struct(F.lit("OTHER").alias("kind"), F.lit(0.20).alias("confidence"))).otherwise(F.struct(top["kind"].alias("kind"), sure.alias("confidence")))

    low = F.struct(F.lower(F.coalesce(text, F.lit(""))).alias("t"), F.lower(F.regexp_extract(F.coalesce(filename, F.lit("")), r"([^/\\]*)$", 1)).alias("f"))
    return X.let(low, lambda x: X.let(ranked(x["t"], x["f"]), judged))


# Where numbers, accreditation, dates and issuers stand.
NUMBERS = (r"(?i)(?:Report\s+No\.?|Certificate\s+No\.?|Cert\s+No\.?|Test\s+Report\s+No\.?|Doc\s+No\.?|Licence\s+No\.?|License\s+No\.?)[:\s]+([A-Z0-9\-_/.]+)", r"\b([A-Z]{2,4}/[A-Z0-9\-]+/\d{4,})\b")
ACCREDITATION = r"(?i)(NABL\s+(?:Accredited|Accreditation)?[^.\n]*|ISO[/\s]IEC\s+17025(?::\d{4})?[^.\n]*|BIS\s+Recognized[^.\n]*)"
REFERENCE = r"(?i)\b(IS\s+\d+(?:(?:-|\s+Part\s*)\d+)?(?:\s*:\s*\d{4})?)\b"
ISSUED = r"(?i)(?:Issue\s+Date|Date\s+of\s+Issue|Dated|Date\s+of\s+Testing|Test\s+Date|Date)[:\s]+"
EXPIRES = r"(?i)(?:Valid\s+(?:Up\s+To|Until|Upto|Thru)|Expiry\s+Date|Expiration\s+Date|Due\s+Date|Calibration\s+Due)[:\s]+"
DAY = r"\b(\d{4}-\d{1,2}-\d{1,2}|\d{1,2}[-/]\d{1,2}[-/]\d{4}|\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{4})\b"
ISSUERS = ("laboratory", "labs", "testing centre", "testing services", "inspections", "bureau of indian standards", "certifications", "technologies")
RESULT = r"(?i)([a-zA-Z\s()\-]{3,35})[:\t|]+(?:observed|measured|found)?[:\s]*([0-9.]+\s*[a-zA-Z/%°^]+)?(?:.*?specified[:\s]*([<>=a-zA-Z0-9.\s/%°^]+))?(?:.*?(pass|fail|complies|satisfactory|non-compliant))?"


def _day(line: Column) -> Column:
    found = F.regexp_extract(line, "(?i)" + DAY, 1)
    return X.parse_date(F.regexp_replace(found, r"([A-Za-z]{3})[a-z]*", "$1"))


def evidence_fields(text: Column, today: Column | None = None) -> Column:
    """struct<number, accreditation, issuer, standards, issued, expires, status> of a certificate or report.

    Dates stand in a line with their label; without one the first date of the
    first 15 lines is the issue. The issuer is the first of the first ten
    filled lines that names a laboratory or office.
    """

    def read(lines: Column) -> Column:
        on = lambda label: F.get(F.array_compact(F.transform(F.filter(lines, lambda x: F.rlike(x, F.lit(label))), _day)), F.lit(0))
        filled = F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "")
        office = F.get(F.filter(F.slice(filled, 1, 10), lambda x: reduce(lambda a, b: a | b, [F.contains(F.lower(x), F.lit(w)) for w in ISSUERS])), F.lit(0))
        refs = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(1)), lambda r: F.upper(F.regexp_replace(F.trim(r), r"\s+", " "))))
        expires = on(EXPIRES)
        return F.struct(
            F.coalesce(*[_get(text, p) for p in NUMBERS]).alias("number"), _get(text, ACCREDITATION).alias("accreditation"), office.alias("issuer"), refs.alias("standards"),
            F.coalesce(on(ISSUED), F.get(F.array_compact(F.transform(F.slice(lines, 1, 15), _day)), F.lit(0))).alias("issued"), expires.alias("expires"),
            F.when(expires < (F.current_date() if today is None else today), "EXPIRED").otherwise("ACTIVE").alias("status"),
        )

    return X.let(F.split(text, r"\r?\n"), read)


def verdict_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, parameter, observed, specified, verdict: one row for each line with a verdict."""
    own = df.select(key, F.posexplode(F.split(text, r"\r?\n")).alias("pos", "line")).withColumn("line", F.trim("line"))
    said = own.filter((F.length("line") >= 10) & F.rlike("line", F.lit(r"(?i)\b(?:pass|fail|complies|satisfactory)\b")) & F.rlike("line", F.lit(RESULT)))
    part = lambda i: _get(F.col("line"), RESULT, i)
    return said.select(key, "pos", part(1).alias("parameter"), part(2).alias("observed"), part(3).alias("specified"), F.coalesce(F.upper(part(4)), F.lit("PASS")).alias("verdict"))



def temporal_statements(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, relation, target, statement_id: every statement about other versions."""
    families = (("SUPERSEDES", r"(?i)supersedes\s+(?:the\s+)?(IS\s*\d+(?:\s*:\s*\d{4})?)"), ("AMENDED_BY", r"(?i)amended by\s+(amendment\s*(?:no\.?\s*)?\d+)"), ("WITHDRAWN", r"(?i)withdrawn\s+(?:with effect from|on|in)\s+(\d{4}(?:-\d\d-\d\d)?)"), ("EFFECTIVE", r"(?i)(?:effective|in force)\s+from\s+(\d{4}(?:-\d\d-\d\d)?)"))
    rows = F.concat(*[_labelled(F.regexp_extract_all(text, F.lit(p), F.lit(1)), name) for name, p in families])
    found = df.select(key, F.explode(rows).alias("r")).select(key, "r.relation", "r.target")
    return found.withColumn("statement_id", X.digest(F.concat_ws("::", F.col(key).cast("string"), "relation", F.lower("target")), 16))


def _labelled(found: Column, name: str) -> Column:
    return F.transform(found, lambda x: F.struct(F.lit(name).alias("relation"), x.alias("target")))


def citation(number: Column, year: Column, clause: Column, page: Column, identity: Column) -> Column:
    """'IS n : year, Clause c, Page p' for the standard itself, 'reference to ..' otherwise."""
    label = F.concat(F.when(identity, F.lit("")).otherwise("reference to "), number, F.coalesce(F.concat(F.lit(" : "), year.cast("string")), F.lit("")))
    return F.concat_ws(", ", label, F.concat(F.lit("Clause "), clause), F.concat(F.lit("Page "), page.cast("string")))


# Source lines, clause words and the consumers' tip of a translated answer.
SOURCES_LINE = r"(?is)\n*(?:\*\*Sources:\*\*|Sources:|References:|स्रोत:|संदर्भ:).*$"
CLAUSES = r"(?iU)\s*\b(?:Clause|खंड|धारा)\s*[0-9]+(?:\.[0-9]+)*\b"
CITED = r"(?i)\[(EV\d+|citation-\d+)\]"
CRITICAL = ("insufficient_devanagari_script", "missing_standard_numbers", "missing_numerical_values", "hallucinated_citation_tokens", "empty_hindi_translation")


def translation_check(source: Column, translated: Column, consumer: Column, tip: str | None = None) -> Column:
    """struct<valid, text, issues> of a translated answer, held against its source and mended where that is safe.

    Critical are a script that is hardly Devanagari, invented citations, and
    standards or numbers that are gone. Lost citations come back as a line of
    sources; for consumers clause numbers go and ``tip`` is put before that
    line where the text has no tip; a bold headline is taken over.
    """
    marks = lambda c: F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(CITED), F.lit(1)), lambda x: F.upper(x)))

    def checked(t: Column) -> Column:
        script = F.length(F.regexp_replace(t, r"[^ऀ-ॿ]", ""))
        ratio = script / F.greatest(F.length(F.regexp_replace(t, r"\s+", "")), F.lit(1))
        invented = F.array_except(marks(t), marks(source))
        numbers = F.array_distinct(F.regexp_extract_all(source, F.lit(r"(?i)\bIS\s*([1-9]\d+)\b"), F.lit(1)))
        gone = F.filter(numbers, lambda n: ~F.rlike(t, F.concat(F.lit(r"(?iU)(?:\bIS\s*|आईएस\s*|आई\.एस\.\s*)"), n, F.lit(r"(?![0-9])"))))
        ascii_digits = F.translate(t, "०१२३४५६७८९", "0123456789")
        first = lambda q: F.regexp_extract(F.replace(F.lower(q), F.lit(","), F.lit("")), r"^\S+", 0)
        lost = X.let(ascii_digits, lambda x: F.filter(quantities(source), lambda q: ~F.rlike(x, F.concat(F.lit(r"\b\Q"), first(q), F.lit(r"\E\b")))))
        some = lambda a: F.size(a) > 0
        return F.array_compact(
            F.array(
                F.when((ratio < 0.20) & (script < 15), F.lit("insufficient_devanagari_script")),
                F.when(some(invented), F.concat(F.lit("hallucinated_citation_tokens:"), F.array_join(invented, ","))),
                F.when(some(gone), F.concat(F.lit("missing_standard_numbers:"), F.array_join(F.transform(gone, lambda n: F.concat(F.lit("IS "), n)), ","))),
                F.when(some(lost), F.concat(F.lit("missing_numerical_values:"), F.array_join(lost, ","))),
            )
        )

    def mended(t: Column) -> Column:
        dropped = F.size(F.array_except(marks(source), marks(t))) > 0
        sourced = F.when(dropped, F.concat(F.trim(F.regexp_replace(t, SOURCES_LINE, "")), F.lit("\n\nSources: "), F.array_join(F.transform(marks(source), lambda m: F.concat(F.lit("["), m, F.lit("]"))), ", "))).otherwise(t)

        def for_consumers(x: Column) -> Column:
            bare = F.regexp_replace(x, CLAUSES, "")
            if tip is None:
                return bare
            at = r"(?is)^(.*?)((?:\n\n|\n)(?:Sources:|References:|स्रोत:|संदर्भ:).*)$"
            return X.let(bare, lambda b: F.when(F.contains(b, F.lit(tip)), b).when(F.rlike(b, F.lit(at)), F.concat(F.regexp_extract(b, at, 1), F.lit(f"\n\n{tip}"), F.regexp_extract(b, at, 2))).otherwise(F.concat(b, F.lit(f"\n\n{tip}"))))

        told = X.let(sourced, lambda x: F.when(F.coalesce(consumer, F.lit(False)), for_consumers(x)).otherwise(x))
        headline = _get(source, r"^\s*(\*\*[^*]+\*\*)\s*\n")
        return X.let(told, lambda x: F.when(~F.rlike(x, F.lit(r"^\s*\*\*[^*]+\*\*")) & headline.isNotNull(), F.concat(headline, F.lit("\n\n"), F.trim(x))).otherwise(x))

    def whole(t: Column) -> Column:
        done = F.when(t == "", source).otherwise(mended(t))
        issues = F.when(t == "", F.array(F.lit("empty_hindi_translation"))).otherwise(X.let(done, checked))
        return X.let(F.struct(done.alias("d"), issues.alias("i")), lambda x: F.struct((~F.exists(x["i"], lambda i: F.substring_index(i, ":", 1).isin(*CRITICAL))).alias("valid"), x["d"].alias("text"), x["i"].alias("issues")))

    return X.let(F.trim(F.coalesce(translated, F.lit(""))), whole)


def decisions_problems(ids: Column, expected: Column, levels: Column) -> Column:
    """Why a structuring reply is refused: ids must come exactly once, heading levels lie in 1 to 4."""
    return F.array_compact(
        F.array(
            F.when(F.size(F.array_except(expected, ids)) > 0, F.lit("missing")),
            F.when(F.size(F.array_except(ids, expected)) > 0, F.lit("unknown")),
            F.when(F.size(F.array_distinct(ids)) < F.size(ids), F.lit("repeated")),
            F.when(F.exists(levels, lambda x: ~x.between(1, 4)), F.lit("level")),
        )
    )


def final_decision(decision: Column, state: Column, level: Column, grounding: Column, asks_current: Column, unsettled: Column, settled_scheme: Column, needs_candidates: Column, candidates: Column) -> Column:
    """struct<decision, verify, state>: the evidence's decision after grounding, currentness, sufficiency and candidates were held against it.

    Verification is required by unsupported claims, by a question about the
    current state that the versions leave unsettled, by weak evidence without a
    settled scheme or checklist, and by a search that found no candidate.
    Partly grounded answers are qualified at most. State and decision agree in
    the end: nothing that needs verification is an answer.
    """
    no = lambda c: F.coalesce(c, F.lit(False))
    weak = ((state == "INSUFFICIENT_EVIDENCE") | (level == "LOW")) & ~no(settled_scheme)
    forced = (grounding == "UNSUPPORTED") | (no(asks_current) & no(unsettled)) | weak | (no(needs_candidates) & ~no(candidates))
    partly = grounding.isin("PARTIALLY_GROUNDED", "UNVERIFIABLE") & (decision == "ANSWER")
    bad = state.isin("INSUFFICIENT_EVIDENCE", "CONFLICTING_EVIDENCE", "AMBIGUOUS_QUERY", "VERIFICATION_REQUIRED")
    first = F.when(forced, "VERIFICATION_REQUIRED").when(partly, "QUALIFIED_ANSWER").otherwise(decision)
    verify = forced | (decision == "VERIFICATION_REQUIRED") | bad
    last = F.when(verify & (first == "ANSWER"), "VERIFICATION_REQUIRED").otherwise(first)
    shown = F.when(verify & (state == "ANSWERABLE"), "INSUFFICIENT_EVIDENCE").otherwise(state)
    return F.struct(last.alias("decision"), verify.alias("verify"), shown.alias("state"))
