"""What a query wants: signals, candidate intents with scores, the primary intent, strategy and state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataframe.functions import text as X
from strataframe.functions.context import business_context
from strataframe.functions.query import entities

# The phrases of each signal.
PHRASES = {
    "comparison": [r"difference\s+between", r"differences\s+between", r"compare\b", r"comparison\b", r"versus\b", r"\bvs\b", r"distinction\s+between"],
    "laboratory_search": [
        r"(?:find|search|list|show|locate|where\s+are)\s+(?:a\s+)?(?:testing\s+)?(?:laborator(?:y|ies)|testing\s+facilit(?:y|ies)|labs?)",
        r"(?:testing\s+)?(?:laborator(?:y|ies)|labs?)\s+(?:for|available|near|list|search)", r"show\s+me\s+laboratories", r"testing\s+laborator(?:y|ies)", r"accredited\s+labs?",
    ],
    "qco_applicability": [r"(?:does|is|do)\s+(?:the\s+)?qco\b", r"does\s+qco\s+.*?\s+apply", r"qco\s+(?:applicable|apply|requirement|scope|mandat)", r"quality\s+control\s+order\s+(?:apply|applicable|mandatory)"],
    "source_lookup": [r"where\s+is\s+(?:this|it)\s+published", r"gazette\s+notification\s+(?:for|source)", r"source\s+(?:document|publication|link|reference|lookup)"],
    "regulatory_update": [r"regulatory\s+updates?", r"latest\s+(?:gazette|notification|orders?|updates?|changes)", r"recent\s+(?:changes|revisions|amendments)"],
    "product_compliance": [r"product\s+compliance", r"is\s+(?:the\s+)?product\s+compliant", r"compliance\s+(?:requirements?|status|mandate)\s+for"],
    "testing_requirement": [r"testing\s+requirements?", r"test\s+requirements?", r"what\s+tests?\s+(?:are\s+)?required", r"testing\s+(?:parameters?|methods?|protocol)", r"test\s+procedures?"],
    "unsupported_topic": [r"recipe\s+for", r"weather\s+(?:in|forecast)", r"movie", r"song", r"joke", r"sports\s+score", r"cryptocurrency", r"bitcoin"],
    "standard_lookup": [r"what\s+(?:is\s+the\s+)?standard\s+applies\s+to"],
    "standard_discovery": [
        r"which\s+(?:indian\s+)?(?:bis\s+)?standards?", r"what\s+(?:indian\s+)?(?:bis\s+)?standards?", r"find\s+(?:indian\s+)?(?:bis\s+)?standards?", r"standards?\s+for\b", r"standards?\s+governing",
        r"standards?\s+covering", r"which\s+is\s+covers?", r"what\s+standard\s+governs?", r"which\s+(?:is\s+)?standard\s+should\s+be\s+followed", r"standards?\s+applicable\s+to",
    ],
    "reference_lookup": [
        r"normative\s+references?", r"referred\s+standards?", r"cited\s+standards?", r"references?\s+in\b", r"reference\s+to\s+other\s+standards?", r"cross\s+references?",
        r"referenced\s+or\s+cited", r"standards?\s+are\s+referenced", r"standards?\s+are\s+cited", r"cited\s+by", r"referenced\s+by",
    ],
    "document_requirement": [
        r"documents?\s+required", r"documentation\s+required", r"forms?\s+required", r"checklist", r"application\s+documents?", r"test\s+reports?\s+required", r"filing\s+requirements?", r"documents?\s+needed",
        r"papers?\s+required", r"what\s+(?:technical\s+)?documents?", r"test\s+reports?\s+and\s+factory\s+layout", r"documentation\s+needed", r"(?:documents?|documentation|forms?|test\s+reports?)\s+.*?\s+(?:required|needed|to\s+apply)",
    ],
    "explanation": [r"what\s+does\s+.*mean", r"explain\b", r"definition\s+of", r"clarify\b", r"meaning\s+of", r"why\s+was\b", r"why\s+is\b", r"rationale\s+(?:behind|for|of)", r"purpose\s+of"],
    "amendment": [r"(?:amendment|amd\.?)\s+\d+", r"amendment order"],
    "currentness": [r"current\b", r"latest\b", r"active\b", r"in\s+force\b", r"present\s+edition", r"newest\b"],
    "version_signal": [r"previous\s+edition", r"earlier\s+edition", r"old\s+version", r"superseded"],
    "clause": [r"(?:clause|section|sub-clause|subclause)\s+\d+"],
    "applicability": [
        r"applicable\s+(?:to|for|under)", r"applies\s+(?:to|for)", r"apply\s+(?:to|for)", r"applicability", r"is\s+(?:bis\s+)?(?:certification\s+)?mandatory\s*(?:for|to|\?|$)",
        r"do\s+(?:we|i)\s+need\s+(?:bis|isi|standard|certification|a\s+license)", r"is\s+(?:bis\s+)?(?:certification\s+)?required\s+(?:for|to)", r"covered\s+under\s+bis", r"does\s+bis\s+apply", r"under\s+the\s+scope\s+of", r"does\s+qco\s+apply",
    ],
    "requirement_discovery": [
        r"requirements?\s+(?:for|of)", r"testing\s+requirements?", r"test\s+requirements?", r"permissible\s+error", r"tolerances?", r"sampling\s+plan", r"calibration\s+requirements?", r"inspection\s+requirements?", r"marking\s+requirements?",
        r"packaging\s+requirements?", r"performance\s+requirements?", r"technical\s+specifications?", r"specifications?\s+for", r"procedure\s+and\s+impact\s+limits", r"limits\s+specified",
    ],
    "scheme_guidance": [
        r"which\s+(?:certification\s+)?scheme", r"what\s+(?:certification\s+)?scheme", r"scheme\s+(?:applies|applicable|governs|required)", r"applicable\s+(?:certification\s+)?scheme", r"scheme\s+i\b", r"scheme\s+ii\b", r"scheme\s+iv\b", r"scheme\s+x\b",
        r"isi\s+or\s+crs", r"crs\s+or\s+isi", r"fmcs\s+route", r"hallmarking\s+scheme", r"certification\s+scheme\s+(?:for|under)",
    ],
    "process_explanation": [
        r"how\s+(?:do\s+i|can\s+i|to)\s+(?:get|obtain|apply\s+for)\s+(?:bis\s+)?(?:certification|license|licence|cml|isi\s+mark)", r"how\s+(?:do\s+i|can\s+i|to)\s+get\s+certified", r"certification\s+process", r"certification\s+procedure", r"certification\s+journey",
        r"steps\s+(?:to|for)\s+(?:certification|bis\s+license|get\s+certified)", r"procedure\s+(?:to|for)\s+(?:get|obtain)\s+certification", r"certification\s+checklist", r"how\s+to\s+get\s+isi", r"process\s+for\s+getting\s+isi",
        r"(?:step\s+by\s+step\s+)?process\s+(?:to|for)\s+(?:get\s+certified|obtain\s+certification|certification)",
    ],
    "general_information": [
        r"what\s+is\s+(?:the\s+)?(?:bis|bureau\s+of\s+indian\s+standards)", r"how\s+does\s+bis\s+(?:work|operate)", r"overview\s+of\s+bis", r"about\s+bis", r"role\s+and\s+organizational\s+function", r"functions?\s+of\s+(?:the\s+)?(?:bis|bureau)", r"bureau\s+of\s+indian\s+standards\s+and\s+its\s+functions?",
    ],
}
HINDI = {
    "clause": r"(?:खंड|धारा|अनुभाग)\s*(\d+(?:\.\d+)*)",
    "amendment": r"(?:संशोधन|संशोधन\s+आदेश)\s*(\d+)?",
    "applicability": r"(?:लागू\s+होता|लागू\s+है|क्या\s+लागू|अनिवार्य|आवश्यकता\s+है)",
    "standard_discovery": r"(?:कौन\s+सा\s+मानक|मानक\s+कौन|कौन\s+से\s+मानक)",
    "requirement_discovery": r"(?:आवश्यकताएं|ज़रूरतें|परीक्षण\s+प्रक्रिया|मापदंड)",
    "general_information": r"(?:भारतीय\s+मानक\s+ब्यूरो|बीआईएस|मानक\s+क्या\s+है|मानक\s+के\s+बारे\s+में)",
}
# Signal -> (intent, score with a standard number, score without).
INTENTS = {
    "comparison": ("COMPARISON_QUERY", 0.90, 0.90),
    "laboratory_search": ("LABORATORY_SEARCH", 0.99, 0.99),
    "qco_applicability": ("QCO_APPLICABILITY", 0.98, 0.98),
    "source_lookup": ("SOURCE_LOOKUP", 0.95, 0.95),
    "regulatory_update": ("REGULATORY_UPDATE", 0.95, 0.95),
    "product_compliance": ("PRODUCT_COMPLIANCE", 0.94, 0.94),
    "testing_requirement": ("TESTING_REQUIREMENT", 0.95, 0.95),
    "unsupported_topic": ("UNSUPPORTED", 0.95, 0.95),
    "standard_lookup": ("STANDARD_LOOKUP", 0.97, 0.97),
    "standard_discovery": ("STANDARD_DISCOVERY", 0.95, 0.95),
    "reference_lookup": ("REFERENCE_LOOKUP", 0.92, 0.92),
    "document_requirement": ("DOCUMENT_REQUIREMENT_QUERY", 0.92, 0.92),
    "explanation": ("EXPLANATION_QUERY", 0.88, 0.88),
    "amendment": ("AMENDMENT_LOOKUP", 0.98, 0.90),
    "currentness": ("CURRENTNESS_QUERY", 0.96, 0.85),
    "version_signal": ("VERSION_LOOKUP", 0.95, 0.85),
    "clause": ("CLAUSE_LOOKUP", 0.98, 0.88),
    "applicability": ("APPLICABILITY_QUERY", 0.95, 0.85),
    "standard_number": ("STANDARD_LOOKUP", 0.96, 0.96),
    "requirement_discovery": ("REQUIREMENT_DISCOVERY", 0.86, 0.75),
    "scheme_guidance": ("SCHEME_GUIDANCE", 0.96, 0.96),
    "process_explanation": ("PROCESS_EXPLANATION", 0.96, 0.96),
    "general_information": ("GENERAL_INFORMATION", 0.85, 0.85),
}
# The order in which signals decide.
PRECEDENCE = (
    "unsupported_topic", "laboratory_search", "qco_applicability", "source_lookup", "regulatory_update", "product_compliance", "comparison", "scheme_guidance", "process_explanation", "standard_lookup", "standard_discovery", "reference_lookup",
    "document_requirement", "explanation", "amendment", "currentness", "version_signal", "clause", "applicability", "standard_number", "testing_requirement", "requirement_discovery", "general_information",
)
STRATEGIES = {
    "IDENTIFIER_HEAVY": ("CLAUSE_LOOKUP",),
    "STANDARD_METADATA": ("STANDARD_LOOKUP", "SOURCE_LOOKUP", "CERTIFICATION", "SCHEME_GUIDANCE", "PROCESS_EXPLANATION"),
    "TEMPORAL_AWARE": ("CURRENTNESS_QUERY", "VERSION_LOOKUP", "AMENDMENT_LOOKUP", "REGULATORY_UPDATE"),
    "SEMANTIC_CONTEXTUAL": ("REQUIREMENT_DISCOVERY", "TESTING_REQUIREMENT"),
    "STANDARD_DISCOVERY": ("STANDARD_DISCOVERY",),
    "REFERENCE_GRAPH": ("REFERENCE_LOOKUP",),
    "APPLICABILITY_EVALUATION": ("APPLICABILITY_QUERY", "QCO_APPLICABILITY", "PRODUCT_COMPLIANCE"),
    "BROAD_FALLBACK": ("AMBIGUOUS_QUERY", "GENERAL_INFORMATION", "UNSUPPORTED", "UNKNOWN"),
}


def _signals(q: Column, e: Column) -> dict[str, Column]:
    """Whether each signal is in a normalised query."""
    out = {}
    for name, phrases in PHRASES.items():
        hit = F.rlike(q, F.lit(rf"(?i)\b(?:{'|'.join(phrases)})" + (r"\b" if name not in ("amendment", "applicability", "clause") else "")))
        out[name] = hit | F.rlike(q, F.lit(HINDI[name])) if name in HINDI else hit
    said = lambda word: F.coalesce(e["temporal"] == word, F.lit(False))
    out["amendment"] = out["amendment"] | e["amendment"].isNotNull()
    out["currentness"] = out["currentness"] | said("current")
    out["version_signal"] = out["version_signal"] | e["year"].isNotNull() | said("historical") | said("edition")
    out["clause"] = out["clause"] | e["clause"].isNotNull()
    out["standard_number"] = e["number"].isNotNull()
    return out


def _decide(text: Column, q: Column, e: Column, has: Column, words: Column) -> Column:
    """struct<intent, confidence, own>: the first rule that fits; ``own`` is the only signal where none of the table's is."""
    std = has["standard_number"]
    score = {s: F.when(std, w).otherwise(o) if w != o else F.lit(w) for s, (_, w, o) in INTENTS.items()}
    score["requirement_discovery"] = F.when(std, 0.86).when(words <= 3, 0.65).otherwise(0.75)
    holds = {s: has[s] for s in PRECEDENCE}
    holds["version_signal"] = has["version_signal"] & e["clause"].isNull()
    holds["standard_number"] = std & ~has["requirement_discovery"]
    out = lambda name, c, own=None: F.struct(F.lit(name).alias("intent"), (F.lit(c) if isinstance(c, float) else c).cast("double").alias("confidence"), F.lit(own).cast("string").alias("own"))
    branches = [
        (F.trim(text) == "", out("AMBIGUOUS_QUERY", 0.10, "empty_query")),
        ((words <= 1) & ~std & ~F.rlike(q, F.lit(r"\d")), out("AMBIGUOUS_QUERY", 0.30, "single_word_fragment")),
        *[(holds[s], out(INTENTS[s][0], score[s])) for s in PRECEDENCE],
        (F.contains(F.lower(q), F.lit("requirement")), out("REQUIREMENT_DISCOVERY", 0.60)),
        (F.rlike(q, F.lit(r"[ऀ-ॿ]")) & (words >= 2), out("GENERAL_INFORMATION", 0.65, "devanagari_query")),
    ]
    (c0, v0), *rest = branches
    return reduce(lambda a, b: a.when(*b), rest, F.when(c0, v0)).otherwise(out("AMBIGUOUS_QUERY", 0.40, "no_distinct_signal"))


def _report(has: Column, words: Column, chosen: Column) -> Column:
    """The decision with its signals, and the other intents that had one, with their scores."""
    std, discovering = has["standard_number"], has["standard_discovery"] | has["standard_lookup"]
    score = {s: F.when(std, w).otherwise(o) for s, (_, w, o) in INTENTS.items()}
    score["requirement_discovery"] = F.when(std, 0.86).when(words <= 3, 0.65).otherwise(0.75)
    score["version_signal"] = F.when(has["currentness"] | has["comparison"], 0.80).otherwise(score["version_signal"])
    score["applicability"] = F.when(discovering, 0.70).when(std, 0.95).otherwise(0.88)
    shown = {s: has[s] for s in INTENTS}
    shown["version_signal"] = has["version_signal"] & ~has["currentness"] & ~has["comparison"]
    shown["applicability"] = has["applicability"] & ~discovering
    signals = F.array_compact(F.array(*[F.when(shown[s], F.lit(s)) for s in INTENTS]))
    others = F.array_compact(F.array(*[F.when(has[s] & (chosen["intent"] != i), F.struct(F.lit(i).alias("intent"), score[s].cast("double").alias("score"))) for s, (i, _, _) in INTENTS.items()]))
    alone = chosen["own"].isNotNull()
    return F.struct(
        chosen["intent"].alias("intent"),
        chosen["confidence"].alias("confidence"),
        F.when(alone, F.array(chosen["own"])).otherwise(signals).alias("signals"),
        F.when(alone, F.filter(others, lambda x: F.lit(False))).otherwise(others).alias("candidates"),
        (chosen["intent"] == "AMBIGUOUS_QUERY").alias("ambiguous"),
    )


def _classified(text: Column, q: Column, e: Column) -> Column:
    words = F.size(F.array_remove(F.split(q, r"(?U)\W+"), ""))
    flags = F.struct(*[c.alias(s) for s, c in _signals(q, e).items()])
    return X.let(flags, lambda has: X.let(_decide(text, q, e, has, words), lambda chosen: _report(has, words, chosen)))


def intent(text: Column) -> Column:
    """struct<intent, confidence, signals, candidates, ambiguous> of a query.

    Signals are read independently; the first in ``PRECEDENCE`` decides, the
    others stay as scored candidates. Nothing is forced: an empty query, a lone
    word without a number, and a query without signals are ambiguous.
    """
    return X.let(F.coalesce(text, F.lit("")), lambda t: X.let(X.normalize_query(t), lambda q: X.let(entities(q), lambda e: _classified(t, q, e))))


def final_intent(found: Column, model: Column | None = None, least: float = 0.85) -> Column:
    """struct<intent, confidence, source>: the rules where they are sure, else a caller's model (struct<intent, confidence>), else the rules."""
    rules = F.struct(found["intent"].alias("intent"), found["confidence"].alias("confidence"), F.lit("deterministic").alias("source"))
    if model is None:
        return rules
    other = F.struct(model["intent"].cast("string").alias("intent"), model["confidence"].cast("double").alias("confidence"), F.lit("model").alias("source"))
    return F.when((found["confidence"] >= least) | model["intent"].isNull(), rules).otherwise(other)


def strategy(name: Column) -> Column:
    """How to retrieve for an intent."""
    (first, names), *rest = STRATEGIES.items()
    return reduce(lambda a, x: a.when(name.isin(*x[1]), x[0]), rest, F.when(name.isin(*names), first)).otherwise("SEMANTIC_CONTEXTUAL")


def query_state(found: Column, e: Column, has_product: Column) -> Column:
    """Where a query stands, from its intent, its entities and whether a product was named."""
    name = found["intent"]
    return (
        F.when(found["ambiguous"] | name.isin("AMBIGUOUS_QUERY", "UNSUPPORTED", "UNKNOWN"), "AMBIGUOUS")
        .when(name.isin(*STRATEGIES["APPLICABILITY_EVALUATION"]) & ~F.coalesce(has_product, F.lit(False)), "MISSING_REQUIRED_CONTEXT")
        .when(name.isin("CURRENTNESS_QUERY", "VERSION_LOOKUP", "REGULATORY_UPDATE") | e["temporal"].isin("historical", "current"), "TEMPORAL")
        .when(e["number"].isNotNull() | e["clause"].isNotNull() | e["amendment"].isNotNull(), "IDENTIFIER_SPECIFIC")
        .when(name.isin("REQUIREMENT_DISCOVERY", "TESTING_REQUIREMENT", "STANDARD_DISCOVERY"), "SEMANTIC")
        .otherwise("NORMAL")
    )


def query_context(q: Column) -> Column:
    """struct<query, entities, intent, strategy, state> of a raw query."""

    def whole(text: Column, norm: Column, e: Column) -> Column:
        named = business_context(text)["category"].isNotNull()
        return X.let(_classified(text, norm, e), lambda found: F.struct(norm.alias("query"), e.alias("entities"), found.alias("intent"), strategy(found["intent"]).alias("strategy"), query_state(found, e, named).alias("state")))

    return X.let(F.coalesce(q, F.lit("")), lambda t: X.let(X.normalize_query(t), lambda n: X.let(entities(n), lambda e: whole(t, n, e))))
