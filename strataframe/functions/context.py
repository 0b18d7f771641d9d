"""What a text says about a product and a business: only what is stated, by the first phrase of each list that fits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataframe.functions import text as X

# Phrase -> value, in the order in which they are tried.
PRODUCTS = [
    (r"clinical\s+thermometers?|mercury\s+thermometers?|digital\s+thermometers?", "clinical thermometer"),
    (r"thermometers?", "thermometer"),
    (r"gold\s+jeweller?y|gold\s+artefacts?|gold\s+articles?", "gold jewellery"),
    (r"domestic\s+electric\s+water\s+heaters?|electric\s+water\s+heaters?|water\s+heaters?|geysers?", "electric water heater"),
    (r"domestic\s+pressure\s+cookers?|pressure\s+cookers?", "pressure cooker"),
    (r"safety\s+helmets?|protective\s+helmets?|industrial\s+helmets?", "safety helmet"),
    (r"pvc\s+pipes?|upvc\s+pipes?|cpvc\s+pipes?|polyethylene\s+pipes?", "PVC pipe"),
    (r"electric\s+cables?|power\s+cables?|pvc\s+cables?", "electric cable"),
    (r"electric\s+irons?", "electric iron"),
    (r"packaged\s+drinking\s+water|mineral\s+water|bottled\s+water", "packaged drinking water"),
    (r"lead\s+acid\s+batteries?|storage\s+batteries?", "lead acid battery"),
    (r"portland\s+cement|cement", "cement"),
    (r"steel\s+bars?|tmt\s+bars?|reinforcement\s+bars?", "steel bar"),
    (r"electric\s+toys?|non-electric\s+toys?|toys?", "toy"),
    (r"lpg\s+cylinders?|gas\s+cylinders?", "LPG cylinder"),
]
MATERIALS = [
    (r"stainless\s+steel|ss", "stainless steel"), (r"carbon\s+steel", "carbon steel"), (r"galvanized\s+steel|gi", "galvanized steel"), (r"structural\s+steel", "structural steel"), (r"mild\s+steel|ms", "mild steel"), (r"steel", "steel"),
    (r"pvc|upvc|cpvc", "PVC"), (r"polyethylene|pe|hdpe|ldpe", "polyethylene"), (r"polypropylene|pp", "polypropylene"), (r"mercury", "mercury"), (r"glass", "glass"), (r"copper", "copper"), (r"alumin(?:i)?um", "aluminum"),
    (r"gold", "gold"), (r"silver", "silver"), (r"lead\s+acid", "lead acid"), (r"lithium(?:\s+ion)?", "lithium"), (r"portland\s+cement", "portland cement"), (r"rubber", "rubber"),
]
TECHNOLOGIES = [
    (r"digital|electronic", "digital"), (r"electric|electrical", "electric"), (r"infrared|ir", "infrared"), (r"analog|mechanical", "mechanical/analog"), (r"hydraulic", "hydraulic"),
    (r"pneumatic", "pneumatic"), (r"solar|photovoltaic", "solar"), (r"wireless|bluetooth|rfid", "wireless"), (r"manual", "manual"),
]
PRINCIPLES = [(r"induction", "induction"), (r"convection", "convection"), (r"resistance\s+heating", "resistance heating"), (r"compression", "compression"), (r"thermal\s+expansion", "thermal expansion"), (r"pressuri[zs]ed", "pressurized")]
USES = [
    (r"clinical(?:\s+use)?|medical(?:\s+use)?|hospital(?:\s+use)?", "clinical"), (r"domestic(?:\s+use)?|household(?:\s+use)?|home(?:\s+use)?", "domestic"), (r"industrial(?:\s+use)?|factory(?:\s+use)?", "industrial"),
    (r"laboratory(?:\s+use)?|lab(?:\s+use)?", "laboratory"), (r"agricultural(?:\s+use)?|farming", "agricultural"), (r"commercial(?:\s+use)?", "commercial"),
]
CAPACITY = r"(?i)\b(\d+(?:\.\d+)?\s*(?:litre|liter|l|ml|kg|g|mm|cm|m|v|volt|kw|w|bar|kpa|mpa|sq\s*mm|mm2))\b"
TARGETS = [
    r"(?i)\b(?:standards?\s+(?:for|covering|governing|on)|which\s+standard\s+covers|is\s+there\s+a\s+standard\s+for|compliance\s+for|requirements\s+for)\s+([a-zA-Z0-9\s-]+?)(?:\s+(?:in|under|dated|\?|\.|$))",
    r"(?i)\b(?:we\s+manufacture|manufacture\s+of|producing|we\s+produce|we\s+make|makes?)\s+([a-zA-Z0-9\s-]+?)(?:\s+(?:for|in|at|under|with|\?|\.|$))",
    r"(?i)\b(?:applicable\s+to|applies\s+to|apply\s+to)\s+([a-zA-Z0-9\s-]+?)(?:\s+(?:in|under|dated|\?|\.|$))",
]
ACTIVITIES = [
    (r"we\s+manufacture|manufactures?|manufacturing(?:\s+of)?|we\s+make|makes?|we\s+produce|produces?|production(?:\s+of)?", "manufacturing"), (r"we\s+import|imports?|importing(?:\s+of)?|we\s+source\s+from\s+abroad", "importing"),
    (r"we\s+export|exports?|exporting(?:\s+to\s+india|\s+of)?", "exporting"), (r"we\s+distribute|distributes?|distribution(?:\s+of)?|we\s+trade|trades?", "distribution"), (r"we\s+assemble|assembles?|assembly(?:\s+of)?", "assembly"),
]
BUSINESS_TYPES = [
    (r"manufacturer\s+of|as\s+a\s+manufacturer|we\s+are\s+manufacturers?", "manufacturer"), (r"importer\s+of|as\s+an\s+importer|we\s+are\s+importers?", "importer"), (r"distributor\s+of|as\s+a\s+distributor|trader\s+of|we\s+are\s+distributors?", "distributor"),
    (r"assembler\s+of|as\s+an\s+assembler|we\s+are\s+assemblers?", "assembler"), (r"overseas\s+factory|foreign\s+factory|overseas\s+manufacturer|foreign\s+manufacturer", "foreign manufacturer"), (r"exporter\s+to\s+india|exporter\s+of", "exporter"),
]
SIZES = [
    (r"msme|micro\s+enterprise|micro\s+unit", "MSME (Micro)"), (r"small\s+scale|small\s+enterprise|ssi", "Small Scale Enterprise"), (r"medium\s+enterprise", "Medium Enterprise"),
    (r"large\s+scale|large\s+manufacturer|multinational|mnc", "Large Scale Enterprise"), (r"startup|start-up", "Startup"),
]
LOCATION = r"\b((?i:factory\s+in|plant\s+in|unit\s+in|facility\s+in|located\s+in|based\s+in|in|at))\s+([A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)?)\b"
PLACES = (
    "kolkata", "mumbai", "delhi", "new delhi", "bengaluru", "bangalore", "chennai", "hyderabad", "ahmedabad", "pune", "surat", "jaipur", "kanpur", "lucknow", "nagpur", "indore", "patna", "bhopal", "ludhiana", "vadodara",
    "faridabad", "gurugram", "gurgaon", "noida", "ghaziabad", "coimbatore", "west bengal", "maharashtra", "gujarat", "karnataka", "tamil nadu", "telangana", "uttar pradesh", "rajasthan", "punjab", "haryana", "kerala",
    "bihar", "odisha", "madhya pradesh", "assam", "jharkhand", "chhattisgarh", "uttarakhand", "himachal pradesh", "goa", "india",
)
NO_PLACES = (
    "is", "clause", "section", "part", "table", "annex", "amendment", "order", "standard", "standards", "compliance", "specification", "specifications", "bis", "qco", "isi", "india", "january", "february", "march", "april", "may",
    "june", "july", "august", "september", "october", "november", "december", "detail", "details", "brief", "summary", "english", "hindi", "terms", "force", "effect",
)
CATEGORIES = [
    r"clinical\s+thermometers?|mercury\s+thermometers?|digital\s+thermometers?|medical\s+thermometers?", r"gold\s+jewellery|gold\s+artefacts?|gold\s+articles?|hallmarked\s+gold", r"pvc\s+pipes?|upvc\s+pipes?|cpvc\s+pipes?|polyethylene\s+pipes?",
    r"pressure\s+cookers?|domestic\s+pressure\s+cookers?", r"(?:electric|power|pvc|insulated)?\s*cables?|wires?|cords?", r"safety\s+helmets?|protective\s+helmets?|industrial\s+helmets?", r"lead\s+acid\s+batteries?|lithium\s+batteries?|storage\s+batteries?",
    r"cement|portland\s+cement|pozzolana\s+cement", r"toys?|electric\s+toys?|non-electric\s+toys?", r"steel\s+bars?|tmt\s+bars?|reinforcement\s+bars?|structural\s+steel", r"bottled\s+water|packaged\s+drinking\s+water|mineral\s+water",
]
ABOUT = r"(?i)\b(?:applicable\s+to|applies\s+to|apply\s+to|for\s+our|for\s+the|covers?|manufacture\s+|producing\s+|importing\s+|exporting\s+|regarding\s+our|about\s+our)\s+([a-zA-Z0-9\s-]+?)(?:\s+(?:in|at|with|under|according|dated|\?|\.|$))"
CUSTOMERS = [
    r"(?i)\b(?:sell\s+(?:them\s+)?to|sold\s+to|supply\s+(?:them\s+)?to|supplied\s+to|distribute\s+(?:them\s+)?to|to\s+customers\s+in)\s+([a-zA-Z]+(?:\s+[a-zA-Z]+)?)\b",
    r"(?i)\bfor\s+(?:use\s+in\s+)?(hospitals?|clinics?|retailers?|consumers?|dealers?|laboratories|labs|distributors|governments?|schools?)\b",
]
FOREIGN = ("overseas", "foreign", "abroad", "export to india", "import into india")
SERVICES = {
    "testing_laboratory": ("LABORATORY_SEARCH",), "standard": ("STANDARD_LOOKUP", "STANDARD_DISCOVERY"), "qco": ("QCO_APPLICABILITY",),
    "certification": ("CERTIFICATION", "SCHEME_GUIDANCE", "PROCESS_EXPLANATION"), "testing_requirement": ("TESTING_REQUIREMENT", "REQUIREMENT_DISCOVERY"),
}
ORDERS = r"\bS\.O\.\s*\d+(?:\([A-Z]\))?|\b[A-Za-z\s]+(?:Quality Control Order|\(Quality Control\) Order)\b"


def first_value(text: Column, table: list[tuple[str, str]]) -> Column:
    """The value of the first phrase that is in the text as whole words."""
    (p, v), *rest = table
    says = lambda pattern: F.rlike(text, F.lit(rf"(?i)\b(?:{pattern})\b"))
    return reduce(lambda a, x: a.when(says(x[0]), x[1]), rest, F.when(says(p), v))


def _caught(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.trim(F.regexp_extract(text, pattern, group)), F.lit(""))


def _target(text: Column, pattern: str, barred: str) -> Column:
    """A product that a phrase leads to: without its article, of three to 59 characters, no identifier."""
    name = F.trim(F.regexp_replace(_caught(text, pattern), r"(?i)^(?:our|the|a|an)\s+", ""))
    return F.when(F.length(name).between(3, 59) & ~F.rlike(name, F.lit(barred)), name)


def standards(text: Column) -> Column:
    """array<string> of the standards named, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?i)\bIS\s+(\d+(?:-\d+)?)\b"), F.lit(1)), lambda n: F.concat(F.lit("IS "), F.upper(n))))


def product_context(text: Column) -> Column:
    """struct<product, material, technology, principle, use, capacities, standards> that a text states."""
    named = [_target(text, p, r"(?i)\bIS\s+\d+\b") for p in TARGETS]
    return F.struct(
        F.coalesce(first_value(text, PRODUCTS), *named).alias("product"),
        first_value(text, MATERIALS).alias("material"),
        first_value(text, TECHNOLOGIES).alias("technology"),
        first_value(text, PRINCIPLES).alias("principle"),
        first_value(text, USES).alias("use"),
        F.transform(F.regexp_extract_all(text, F.lit(CAPACITY), F.lit(1)), lambda c: F.trim(c)).alias("capacities"),
        standards(text).alias("standards"),
    )


def business_context(text: Column) -> Column:
    """struct<activity, type, size, location, category, customer, certifications> that a text states."""
    before, names = (F.regexp_extract_all(text, F.lit(LOCATION), F.lit(i)) for i in (1, 2))
    found = F.arrays_zip(before.alias("b"), names.alias("n"))
    known = lambda x: F.lower(x["n"]).isin(*PLACES) | F.rlike(x["b"], F.lit(r"(?i)(?:factory|plant) in"))
    place = F.get(F.filter(found, lambda x: ~F.lower(x["n"]).isin(*NO_PLACES) & known(x)), F.lit(0))["n"]
    customers = [F.when(~F.lower(c).isin(*NO_PLACES), c) for c in (_caught(text, p) for p in CUSTOMERS)]
    marks = F.array_compact(F.array(*[F.when(F.rlike(text, F.lit(p)), F.lit(v)) for p, v in ((r"(?i)\b(?:isi\s+mark|isi\s+certified)\b", "ISI Mark"), (r"(?i)\b(?:hallmark|hallmarked)\b", "Hallmark"))]))
    return F.struct(
        first_value(text, ACTIVITIES).alias("activity"),
        first_value(text, BUSINESS_TYPES).alias("type"),
        first_value(text, SIZES).alias("size"),
        place.alias("location"),
        F.coalesce(*[_caught(text, rf"(?i)\b(?:{p})\b", 0) for p in CATEGORIES], _target(text, ABOUT, r"(?i)\b(?:IS\s+\d+|clause|section|standard)\b")).alias("category"),
        F.coalesce(*customers).alias("customer"),
        marks.alias("certifications"),
    )


def merged(query: Column, profile: Column, fields: list[str], lists: tuple[str, ...] = ()) -> Column:
    """Fields of the query, else of the profile; ``lists`` are united."""
    one = lambda f: F.array_union(F.coalesce(profile[f], F.array().cast("array<string>")), F.coalesce(query[f], F.array().cast("array<string>"))) if f in lists else F.coalesce(query[f], profile[f])
    return F.struct(*[one(f).alias(f) for f in fields])


def structured_intent(q: Column) -> Column:
    """struct<intent, product, use, characteristics, standards, orders, jurisdiction, service, year, clause, amendment> of a query."""
    from strataframe.functions.intent import intent
    from strataframe.functions.query import entities

    about = r"(?i)\b(?:for|to|on|regarding|about|covering)\s+(?:our\s+|the\s+|a\s+|an\s+)?([a-zA-Z0-9\s-]+?)(?:\s+(?:under|with|using|in|dated|\?|\.|$))"

    def whole(text: Column, norm: Column, e: Column, found: Column) -> Column:
        name = _caught(norm, about)
        product = F.when(F.length(name).between(3, 59) & ~F.rlike(name, F.lit(r"(?i)\b(?:is\s+\d+|clause|section|standard|qco)\b")), name)
        measures = r"(\d+(?:\.\d+)?)\s*(V|A|W|kW|Hz|kV|mA|mm|cm|m|kg|g|MPa|bar)\b"
        pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(measures), F.lit(1)).alias("v"), F.regexp_extract_all(text, F.lit(measures), F.lit(2)).alias("u"))
        service = reduce(lambda a, x: a.when(found["intent"].isin(*x[1]), x[0]), list(SERVICES.items())[1:], F.when(found["intent"].isin(*SERVICES["testing_laboratory"]), "testing_laboratory"))
        abroad = reduce(lambda a, b: a | b, [F.contains(F.lower(norm), F.lit(w)) for w in FOREIGN])
        return F.struct(
            found["intent"].alias("intent"),
            product.alias("product"),
            _caught(norm, r"(?i)\b(?:intended\s+for|used\s+for|for\s+use\s+in)\s+([a-zA-Z\s]+)").alias("use"),
            F.transform(pairs, lambda x: F.concat_ws(" ", x["v"], x["u"])).alias("characteristics"),
            standards(norm).alias("standards"),
            F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(ORDERS), F.lit(0)), lambda x: F.trim(x))).alias("orders"),
            F.when(abroad, "Foreign Manufacturer").otherwise("India").alias("jurisdiction"),
            service.alias("service"),
            e["year"].alias("year"),
            e["clause"].alias("clause"),
            e["amendment"].alias("amendment"),
        )

    return X.let(F.coalesce(q, F.lit("")), lambda t: X.let(X.normalize_query(t), lambda n: X.let(F.struct(entities(n).alias("e"), intent(t).alias("i")), lambda x: whole(t, n, x["e"], x["i"]))))
