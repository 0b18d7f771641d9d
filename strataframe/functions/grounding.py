"""Claims of answers and what their evidence says: splitting, quantities, checks and verdicts.

All are column expressions. An answer's evidence is an array of structs with
the fields of ``EVIDENCE``; every check of a claim looks at the items that the
claim cites, each content once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataframe.functions import text as X

EVIDENCE = "id string, hash string, content string, number string, clause string, edition string, amendment string, year string, is_current boolean, titles array<string>"

# Words that carry no meaning of their own, in claims.
STOP_WORDS = (
    "a an the and or but if then else when at by for with about against between into through during before after above below to from up down "
    "in out on off over under again further once here there all any both each few more most other some such no nor not only own same so than "
    "too very can will just should now is are was were be been being have has had having do does did doing would could shall may must might "
    "this that these those it its as which who whom whose where why how since while also well either neither though although even they them "
    "their theirs itself themselves"
).split()

# Framing words of technical prose.
FRAMING_WORDS = (
    "requirement requirements standard standards include includes included including specification specifications provision provisions quality assurance "
    "overview various general compliance compliant applies applicable following details outlined accordance relevant stated provides provided providing "
    "guidelines procedure procedures ensuring ensure ensures conducted conduct per covered covers covering related relates relating clause clauses section "
    "sections table tables part parts proper properly mechanism mechanisms feature features manner used using uses use meet meets meeting met safe safety "
    "system systems types type method methods rules rule item items exist exists aspect aspects clear confirmed confirm confirms scope scopes construction "
    "testing tests test criteria criterion performance application applications material materials parameter parameters purpose purposes commercial industrial "
    "domestic household households equipment apparatus product products manufacture manufactured manufacturing manufacturer manufacturers indicating necessary "
    "documentation established context found regarding authorities competent obtain precise exact missing channels formally accidental contact design live "
    "prevent setting settings device devices compatibility essential focus intended electric lighting power protocols rating voltage january february march "
    "april may june july august september october november december jan feb mar apr jun jul aug sep sept oct nov dec source sources reference references "
    "status currently force active edition revision supersedes amendment amendments withdrawn effective published"
).split()

# Number words that stand before a counted unit.
NUMBER_WORDS = {"one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10", "twelve": "12", "twenty": "20"}

# What numbers are not (standards, clauses, parts and amendments, citations), in the order in which they are masked.
NOT_NUMBERS = (r"(?i)\bIS\s*\d+(?:\s*[:/ -]\s*\d{4})?\b", r"(?i)\bClause\s*\d+(?:\.\d+)*\b", r"(?i)\b(?:Part|Amd|Amendment|Edition)\s*\d+\b", r"(?i)\b\[(?:EV\d+|citation-\d+)\]")
MEASURE = r"(?i)\b(\d{1,3}(?:,\d{3})*(?:\.\d+)?|\d+(?:\.\d+)?)\s*(months?|years?|days?|hours?|weeks?|mm|cm|m|kg|g|v|kv|hz|%|percent|samples?|pieces?|units?|tests?|batches?|deg|°c)\b"
BARE = r"\b(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?\b"
COUNTED = r"(?i)\b(one|two|three|four|five|six|seven|eight|nine|ten|twelve|twenty)\s+(months?|years?|days?|hours?|weeks?|samples?|pieces?|units?|tests?)\b"

# Citation marks and the line of sources under an answer. A look at one character goes before each choice of words, most positions end there.
CITED = r"(?i)\[(EV\d+|citation-\d+)\]"
SOURCES = r"(?i)(?=[SsRrस])(?:Sources|References|स्रोत|संदर्भ)\s*:\s*((?:\[(?:EV\d+|citation-\d+)\][,\s]*)+)"
SOURCES_TAIL = r"(?is)(?=[*SsRrस])(?:\*\*Sources:\*\*|Sources:|References:|स्रोत:|संदर्भ:).*$"
SENTENCE_ENDS = r"(?=\s)(?:(?<=[.!?।॥])\s+|\n{2,}|\n(?=[-*•]|\d+\.))"

# Lines that are no claims, and phrases of uncertain and interpreting claims.
SOURCE_HEADS = ("sources", "source", "references", "reference", "स्रोत", "संदर्भ")
SOURCE_STARTS = ("sources:", "references:", "स्रोत:", "संदर्भ:")
CONSUMER_TIPS = ("bis care", "authenticity of the isi mark", "आधिकारिक बीआईएस केयर", "बीआईएस केयर", "आईएसआई मार्क", "isi मार्क")
STATUS_LINES = ("currently in force", "verification required", "स्थिति: वर्तमान में लागू", "सत्यापन आवश्यक")
UNCERTAIN = (
    "not found in the retrieved", "could not find", "not specified in the retrieved", "does not specify", "cannot be determined from the available",
    "unclear from the retrieved", "no information was retrieved", "verification required", "could not be established", "not been formally confirmed",
    "missing", "unconfirmed", "not definitively confirmed", "verification against the official", "precise details of clause", "exact text of clause",
)
INTERPRETING = ("suggests", "implies", "may indicate", "appears to", "it seems")
HEADLINES = ("currently in force", "verification required", "वर्तमान में लागू", "सत्यापन आवश्यक")

# Assertions that the evidence has to make itself.
NEGATIVE = (
    r"(?i)\b(?:does\s+not\s+exist|do\s+not\s+exist|no\s+such\s+standard\s+exists)\b",
    r"(?i)\b(?:no\s+requirement\s+exists|is\s+not\s+required\s+by\s+the\s+standard|the\s+standard\s+does\s+not\s+require)\b",
    r"(?i)\b(?:there\s+are\s+no\s+(?:testing|sampling|marking|calibration|certification)\s+requirements)\b",
)
LEGAL = (
    r"(?i)\b(?:must\s+obtain\s+certification\s+before\s+sale|prohibited\s+from\s+selling|illegal\s+to\s+sell)\b",
    r"(?i)\b(?:officially\s+compliant|ai\s+certified|approved\s+by\s+bis|legally\s+binding\s+certification)\b",
    r"(?i)\b(?:superseded\s+by\s+law|legally\s+invalid)\b",
)
CURRENT = (
    r"(?i)\b(?:is\s+the\s+current\s+(?:edition|standard|version|specification)|the\s+current\s+requirement\s+is|is\s+currently\s+(?:mandatory|in\s+force|effective|required|binding)|"
    r"current\s+edition\s+of\s+IS|latest\s+and\s+current\s+version|active\s+and\s+currently\s+enforced)\b"
)
SUPERSEDING = r"(?i)\b(?:supersedes\s+(?:the\s+)?(?:earlier\s+edition|IS\s+\d+|[0-9]{4}\s+edition)|this\s+edition\s+supersedes|in\s+supersession\s+of\s+IS)\b"
REPLACED_CLAUSE = r"(?i)\b(?:Amendment\s*(\d+)\s*(?:replaces|substitutes|modifies)\s*Clause\s*(\d+(?:\.\d+)*))\b"
CURRENT_PROOF = (
    "supersedes", "comes into force", "effective from", "stands current", "hereby notified", "fourth revision", "third revision", "second revision", "first revision",
    "latest revision", "latest edition", "current edition", "this standard supersedes", "in supersession",
)
YEAR_PROOF = ("revision", "edition", "published", "issued")
SUPERSEDING_PROOF = ("supersedes", "superseding", "in supersession of", "cancels and replaces")


def _strip(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def _all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def _any(c: Column, words) -> Column:
    """Whether the text holds any of the words. A plain search for each of a few words is many times faster than a pattern that tries all of them at every position."""
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])


def _array(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


# ---- quantities


def quantities(c: Column) -> Column:
    """array<string>: measures ('10 mm'), then other numbers, then counted number words ('six months' is '6 months'), each once.

    Standards, clauses, parts, amendments and citations are masked first, so a
    position of the text is read as one thing only. A number that a measure
    begins with is not repeated; Devanagari digits are read as ASCII.
    """
    digits = F.translate(F.coalesce(c, F.lit("")), "०१२३४५६७८९", "0123456789")
    masked = reduce(lambda x, p: F.regexp_replace(x, p, " "), NOT_NUMBERS, digits)

    def read(m: Column) -> Column:
        measures = F.transform(_all(m, MEASURE), lambda x: _strip(F.lower(x)))
        return X.let(measures, lambda u: F.array_distinct(F.concat(u, F.array_except(_all(m, BARE), F.transform(u, lambda x: F.regexp_extract(x, r"^\S+", 0))), _counted(m))))

    return X.let(masked, read)


def _counted(m: Column) -> Column:
    digit = F.create_map(*[F.lit(x) for kv in NUMBER_WORDS.items() for x in kv])
    return F.transform(_all(m, COUNTED), lambda x: F.concat(F.element_at(digit, F.regexp_extract(F.lower(x), r"^[a-z]+", 0)), F.lit(" "), F.regexp_extract(F.lower(x), r"[a-z]+$", 0)))


# ---- claims


def claims(answer: Column) -> Column:
    """array<struct<claim_id, claim, kind, citations, footer>>: the claims of an answer, in order.

    Sentences end at punctuation, blank lines and bullets. A claim without
    citations of its own takes those of the line of sources (``footer``).
    Headings of sources, tips for consumers and status lines are no claims.
    """
    upper = lambda a: F.transform(a, lambda x: F.upper(x))
    below = upper(_all(F.regexp_extract(answer, SOURCES, 1), CITED, 1))
    parts = F.split(_strip(F.regexp_replace(answer, SOURCES_TAIL, "")), SENTENCE_ENDS, -1)

    def one(part: Column, footer: Column) -> Column:
        def made(s: Column) -> Column:
            own, bare = upper(_all(s, CITED, 1)), _strip(F.regexp_replace(s, CITED, ""))
            return X.let(F.struct(own.alias("own"), bare.alias("bare")), lambda x: _claim(x["bare"], x["own"], footer))

        return X.let(_strip(F.regexp_replace(_strip(part), r"^[-*•\d.]+\s*", "")), made)

    found = X.let(below, lambda footer: F.filter(F.transform(parts, lambda p: one(p, footer)), lambda c: c["claim"].isNotNull()))
    numbered = F.transform(found, lambda c, i: F.struct(F.concat(F.lit("C"), (i + 1).cast("string")).alias("claim_id"), *[c[f].alias(f) for f in ("claim", "kind", "citations", "footer")]))
    return F.when(F.rlike(answer, F.lit(r"\S")), numbered).otherwise(F.array().cast("array<struct<claim_id:string,claim:string,kind:string,citations:array<string>,footer:boolean>>"))


def _line(low: Column) -> Column:
    return F.btrim(low, F.lit("*: \t\n,"))


def _claim(bare: Column, own: Column, footer: Column) -> Column:
    alone = F.size(own) == 0

    def made(low: Column) -> Column:
        starts = lambda line: reduce(lambda a, b: a | b, [F.startswith(line, F.lit(w)) for w in (*SOURCE_STARTS, "status:")])
        skipped = (bare == "") | X.let(_line(low), lambda line: line.isin(*SOURCE_HEADS, *STATUS_LINES) | starts(line) | _any(line, CONSUMER_TIPS))
        kind = F.when(_any(low, UNCERTAIN), "UNCERTAINTY").when(_any(low, INTERPRETING), "INTERPRETATION").otherwise("FACT")
        return F.struct(F.when(~skipped, bare).alias("claim"), kind.alias("kind"), F.when(alone, footer).otherwise(own).alias("citations"), (alone & (F.size(footer) > 0)).alias("footer"))

    return X.let(F.lower(bare), made)


def is_notice(claim: Column) -> Column:
    """Consumer guidance and status headlines: supported as they are, not facts."""
    line = _line(F.lower(claim))
    return _any(line, CONSUMER_TIPS) | F.startswith(line, F.lit("status:")) | F.startswith(line, F.lit("स्थिति:")) | _any(line, HEADLINES)


# ---- checks


def _cited_once(citations: Column, evidence: Column) -> Column:
    """The evidence of the citations that exist, in their order, each content once."""
    found = F.flatten(F.transform(citations, lambda c: F.slice(F.filter(evidence, lambda e: e["id"] == c), 1, 1)))
    hashes = lambda items: F.transform(items, lambda e: F.coalesce(e["hash"], e["content"], F.lit("")))
    once = lambda items, names: F.filter(items, lambda e, i: F.array_position(names, F.coalesce(e["hash"], e["content"], F.lit(""))) == i + 1)
    return X.let(found, lambda items: X.let(hashes(items), lambda names: once(items, names)))


def _says(items: Column, pattern: str) -> Column:
    return F.exists(items, lambda e: F.rlike(F.coalesce(e["content"], F.lit("")), F.lit(pattern)))


def _word(value: Column) -> Column:
    """A pattern of the value between word boundaries."""
    return F.concat(F.lit(r"\b\Q"), value, F.lit(r"\E\b"))


def _clause_agrees(e: Column, clause: Column) -> Column:
    own, text = e["clause"], F.coalesce(e["content"], F.lit(""))
    kin = (own == clause) | F.startswith(clause, F.concat(own, F.lit("."))) | F.startswith(own, F.concat(clause, F.lit("."))) | F.contains(clause, own)
    named = F.rlike(text, F.concat(F.lit(r"(?i)\b(?:Clause|Cl\.?|Section|Sec\.?)\s*\Q"), clause, F.lit(r"\E\b")))
    return (F.coalesce(own != "", F.lit(False)) & F.coalesce(kin, F.lit(False))) | named | F.contains(F.lower(text), F.concat(F.lit("clause "), clause))


def _stem(word: str) -> str:
    """``text.stem`` of a fixed word."""
    return next((word[: -len(x)] for x in X.SUFFIXES if word.endswith(x) and len(word) > len(x) + 2), word)


def terms(claim: Column) -> Column:
    """The distinct words of a claim, three letters or more, that are neither stop words nor framing words."""
    words = F.array_distinct(_all(F.lower(claim), r"\b[a-zA-Z]{3,}\b"))
    stems = sorted({_stem(w) for w in FRAMING_WORDS})
    return F.filter(F.array_except(words, _array(STOP_WORDS)), lambda w: ~X.stem(w).isin(*stems))


def validated(claim: Column, kind: Column, citations: Column, footer: Column, evidence: Column, relations: Column | None = None) -> Column:
    """struct<status, issues, cited>: what is wrong with a claim, and its verdict.

    ``relations``: texts of recorded supersessions (ids and contexts), which
    prove a supersession that the evidence does not state. Status is SUPPORTED,
    PARTIALLY_SUPPORTED, UNSUPPORTED or UNVERIFIABLE; ``cited`` is the number of
    distinct evidence items.
    """
    footer = F.coalesce(footer, F.lit(False))
    none = F.array().cast("array<string>")
    out = lambda status, issues, n: F.struct(F.lit(status).alias("status") if isinstance(status, str) else status.alias("status"), issues.alias("issues"), n.cast("int").alias("cited"))
    ids = F.transform(evidence, lambda e: e["id"])
    unknown = F.transform(F.filter(citations, lambda c: ~F.array_contains(ids, c)), lambda c: F.concat(F.lit("fake_or_unknown_citation_id:"), c))
    zero = F.lit(0)

    def judged(items: Column) -> Column:
        return X.let(_issues(claim, kind, footer, items, relations), lambda x: out(_status(x, kind, footer), F.concat(unknown, x["issues"]), F.size(items)))

    def checked(items: Column) -> Column:
        return F.when(F.size(items) == 0, out("UNSUPPORTED", unknown, zero)).otherwise(judged(items))

    def _status(x: Column, kind: Column, footer: Column) -> Column:
        every = F.concat(unknown, x["issues"])
        begins = lambda i, *words: reduce(lambda a, b: a | b, [F.startswith(i, F.lit(w)) for w in words])
        gap = (x["missing"] >= 4) & x["specific"] | (x["missing"] >= 3) & ~footer
        severe = F.exists(
            every,
            lambda i: begins(i, "fake_or_unknown_citation_id", "unsupported_numerical_value", "unsupported_negative_assertion", "unsupported_legal_conclusion", "unsupported_currentness_claim", "unsupported_supersession_claim", "unsupported_amendment_clause_modification")
            | F.contains(i, F.lit("mismatch"))
            | (begins(i, "unsupported_terms") & (kind == "FACT") & ~footer),
        )
        return F.when(F.size(every) == 0, "SUPPORTED").when(severe | gap, "UNSUPPORTED").otherwise("PARTIALLY_SUPPORTED")

    uncited = F.when(kind == "FACT", out("UNVERIFIABLE", _array(["missing_citation"]), zero)).when(kind == "UNCERTAINTY", out("SUPPORTED", none, zero)).otherwise(out("PARTIALLY_SUPPORTED", none, zero))
    return F.when(F.coalesce(F.size(citations), zero) < 1, uncited).otherwise(X.let(_cited_once(citations, evidence), checked))


def _issues(claim: Column, kind: Column, footer: Column, items: Column, relations: Column | None) -> Column:
    """struct<issues, missing (terms), specific (the claim names numbers, clauses or standards)>."""
    standards, clauses = _all(claim, r"\bIS\s*([1-9]\d{1,5})\b", 1), _all(claim, r"(?i)\bClause\s*(\d+(?:\.\d+)*)\b", 1)
    text_of = lambda e: F.coalesce(e["content"], F.lit(""))
    yes = lambda c: F.coalesce(c, F.lit(False))
    each = lambda values, agrees, label: F.transform(F.filter(values, lambda v: ~F.exists(items, lambda e: agrees(e, v))), lambda v: F.concat(F.lit(label), v))
    one = lambda holds, issue: F.when(yes(holds), _array([issue])).otherwise(F.array().cast("array<string>"))
    whole = F.lower(F.array_join(F.flatten(F.transform(items, lambda e: F.concat(F.array(text_of(e)), F.coalesce(e["titles"], F.array().cast("array<string>"))))), " "))
    foreign = F.length(F.regexp_replace(claim, r"[\x00-\x{80}]", "")) / F.greatest(F.length(_strip(claim)), F.lit(1)) > 0.30
    asserted = [one(F.rlike(claim, F.lit(p)) & ~_says(items, p), "unsupported_negative_assertion:absence_converted_to_negative_fact") for p in NEGATIVE]
    asserted += [one(F.rlike(claim, F.lit(p)) & ~_says(items, p), "unsupported_legal_conclusion") for p in LEGAL]
    identifiers = [
        each(standards, lambda e, n: yes(F.contains(e["number"], n)) | F.contains(text_of(e), F.concat(F.lit("IS "), n)), "standard_mismatch:claim=IS "),
        F.when(kind == "UNCERTAINTY", F.array().cast("array<string>")).otherwise(each(clauses, _clause_agrees, "clause_mismatch:claim=Clause ")),
        one(F.contains(F.lower(claim), F.lit("third edition")) & ~F.exists(items, lambda e: yes(F.contains(F.lower(e["edition"]), F.lit("third")))), "version_mismatch:claim=Third Edition"),
        each(_all(claim, r"(?i)\b(?:Amendment|Amd)(?:\s+No\.?)?\s*([1-9]\d?)\b", 1), lambda e, n: yes((e["amendment"] == n) & (e["amendment"] != "")), "amendment_mismatch:claim=Amendment "),
    ]

    def numeric(source: Column, found: Column) -> Column:
        masked = F.regexp_replace(F.regexp_replace(source, NOT_NUMBERS[0], " "), NOT_NUMBERS[1], " ")
        plain = X.let(F.struct(F.replace(source, F.lit(","), F.lit("")).alias("all"), F.replace(masked, F.lit(","), F.lit("")).alias("masked")), lambda s: _unproven(found, source, s, items, footer | foreign))
        return F.transform(plain, lambda q: F.concat(F.lit("unsupported_numerical_value:"), q))

    def wording(source: Column, own: Column) -> Column:
        """struct<issues, missing>"""
        there = lambda w: F.contains(source, X.stem(w)) | ((w == "pvc") & F.contains(source, F.lit("polyvinyl chloride")))

        def share(lost: Column) -> Column:
            n, k = F.size(own), F.size(lost)
            hard = ((n - k) / n < F.when(footer, 0.25).otherwise(0.50)) | (k / n >= F.when(footer, 0.60).otherwise(0.50))
            soft = (n - k) / n < F.when(footer, 0.45).otherwise(0.70)
            text = F.when(n == 0, None).when(hard, F.concat(F.lit("unsupported_terms:missing="), F.array_join(F.array_sort(lost), ","))).when(soft, F.concat(F.lit("partial_content_support:overlap="), F.format_string("%.2f", (n - k) / n)))
            return F.struct(F.array_compact(F.array(text)).alias("issues"), F.when(F.startswith(text, F.lit("unsupported_terms")), k).otherwise(0).alias("missing"))

        return X.let(F.filter(own, lambda w: ~there(w)), share)

    proven = lambda e: _any(F.lower(text_of(e)), CURRENT_PROOF) | yes(e["is_current"]) | yes((e["year"] != "") & F.contains(F.lower(text_of(e)), e["year"]) & _any(F.lower(text_of(e)), YEAR_PROOF))
    superseded = F.exists(items, lambda e: _any(F.lower(text_of(e)), SUPERSEDING_PROOF))
    if relations is not None:
        superseded = superseded | F.exists(standards, lambda n: F.exists(F.coalesce(relations, F.array().cast("array<string>")), lambda r: F.contains(r, n)))
    target = F.regexp_extract(claim, REPLACED_CLAUSE, 2)
    temporal = [
        one(F.rlike(claim, F.lit(CURRENT)) & ~footer & ~F.exists(items, proven), "unsupported_currentness_claim:publication_date_or_text_alone_does_not_establish_current_status"),
        one(F.rlike(claim, F.lit(SUPERSEDING)) & ~footer & ~superseded, "unsupported_supersession_claim:no_explicit_supersession_evidence"),
        F.when((target != "") & ~F.exists(items, lambda e: F.contains(text_of(e), target)), F.array(F.concat(F.lit("unsupported_amendment_clause_modification:Clause_"), target, F.lit("_not_explicitly_mentioned_in_amendment")))).otherwise(F.array().cast("array<string>")),
    ]
    own = F.when(foreign, F.array().cast("array<string>")).otherwise(terms(claim))
    facts = F.struct(whole.alias("source"), quantities(claim).alias("found"), own.alias("own"))

    def gathered(f: Column) -> Column:
        specific = (F.size(f["found"]) > 0) | (F.size(clauses) > 0) | (F.size(standards) > 0)
        return X.let(wording(f["source"], f["own"]), lambda w: F.struct(F.concat(*asserted, *identifiers, numeric(f["source"], f["found"]), w["issues"], *temporal).alias("issues"), w["missing"].alias("missing"), specific.alias("specific")))

    return X.let(facts, gathered)


def _unproven(found: Column, source: Column, plain: Column, items: Column, lenient: Column) -> Column:
    """The quantities that the evidence does not give; lenient: a bare number in it is enough for a measure."""

    def bad(q: Column) -> Column:
        low, bare = F.lower(q), F.replace(F.lower(q), F.lit(","), F.lit(""))
        stated = F.contains(source, low) | F.contains(plain["all"], bare)
        parts = F.split(bare, r"\s+")
        number, unit = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
        at = lambda where, value: F.rlike(where, _word(value))
        no_unit = ~F.contains(plain["all"], F.regexp_replace(unit, "s+$", "")) & ~F.contains(plain["all"], unit)
        measure = F.when(lenient, ~at(plain["masked"], number) & ~at(plain["all"], number)).otherwise(no_unit | ~at(plain["masked"], number))
        a_year = F.rlike(bare, F.lit(r"^\d{4}$")) & (F.contains(plain["all"], bare) | F.exists(items, lambda e: F.coalesce((e["year"] == bare) | F.contains(e["number"], bare), F.lit(False))))
        return ~stated & F.when(F.size(parts) == 2, measure).otherwise(~a_year & ~at(plain["masked"], bare) & ~at(plain["all"], bare))

    return F.filter(found, bad)
