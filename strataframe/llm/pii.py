"""Personal data by weak supervision, in DataFrame and SQL functions only.

Regular expressions propose candidate spans. Base kinds (email, ip, card,
phone) that pass their checks are always reported. Every other candidate gets
the votes (+1, -1, 0: abstains) of six labelers: strict shape, check digits or
ranges, gazetteer, words before it that speak for it, words around it that
speak against it, and its borders. Candidates are counted by kind and vote
pattern, a table of at most kinds x 3^6 rows whatever the input; expectation-
maximisation over that table estimates how reliable each labeler is, and its
posteriors train a logistic span classifier by gradient descent, both as one
``aggregate`` expression a kind. Candidates at probability ``CUT`` or more are
added. Texts are read once and never shuffled.

Positions come from ``split`` and ``regexp_extract_all`` with one pattern: the
gaps and the matches alternate, so their running lengths (in code points) are
the offsets. Running values, overlaps and cuts work by blocks or by binary
search, so a text with very many matches costs little more than its length.
Patterns use possessive repeats and look-behinds, and that of cards asks for
its 13 digits at once; they find the same leftmost spans that can pass, and
stay linear on very long runs.

Defined cases: null or empty text has no spans; a null doc_id passes through;
repeated rows are scanned each; an added span that meets a base span is
dropped; without candidates the model falls back to its priors; an empty table
gives an empty result; other columns are ignored (``redact`` keeps them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataframe.llm._common import by_position, stage_table

BASE = ("email", "ip", "card", "phone")
ADDED = ("ip_weak", "card_weak", "phone_weak", "spoken_email", "ssn", "local_phone", "birth", "iban", "name")
KINDS = BASE + ADDED
LABELERS = 6
CUT = 0.6
EM_ROUNDS, FIT_ROUNDS = 20, 40

# Fixed patterns of the base kinds: (pattern, text that any match needs).
_RE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # added kinds, one pattern for those made of digits and one for those made of words
    "digits": r"(?<![0-9+(.-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}|[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2})(?![0-9-])",
    "words": r"(?<![A-Za-z0-9])(?:[A-Za-z0-9._%+-]{1,64}\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,63}\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z]{2,24}|[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?|(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora)\.?\x20[A-ZÀ-Þ][a-zà-ÿ]{1,30}(?:\x20[A-ZÀ-Þ][a-zà-ÿ]{1,30})?)(?![A-Za-z0-9])",
}
_NEEDS = {"email": "@", "phone": "+"}
_OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})){3}$"

# Labelers by kind: strict shape, gazetteer (in the match or just before it), words for it, words against it.
_FOR = {
    "ip": "ip|host|server|address|adresse|dirección|client|login",
    "card": "card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta|pay",
    "phone": "phone|tel|call|mobile|cell|fax|contact|telefon|téléphone|teléfono|handy|ruf",
    "spoken_email": "mail|contact|write|reach|kontakt|correo|courriel",
    "ssn": "ssn|social|security|tax|identity|insurance",
    "birth": "born|birth|dob|geboren|geburt|né|née|naissance|nacido|nacimiento",
    "iban": "iban|account|konto|compte|cuenta|bank|transfer",
    "name": "name|contact|signed|author|patient|dear|employee|client|from",
}
_AGAINST = "version|isbn|issn|order|invoice|article|section|chapter|figure|page|serial|model|release|build|clause|standard"
_GAZETTEER = {
    "ip": r"^(?:10|127|172|192)\.",
    "card": r"^(?:4|5[1-5]|3[47]|6011|62)",
    "phone": r"^(?:\+(?:1|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58]))",
    "spoken_email": r"(?i)(?:gmail|yahoo|outlook|hotmail|proton|icloud|example|gmx)",
    "ssn": r"^(?!000|666|9)[0-9]{3}",
    "birth": r"(?:19[2-9][0-9]|200[0-9])$",
    "iban": r"^(?:AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)",
    "name": r"(?i)\b(?:james|john|robert|michael|william|mary|patricia|linda|anna|maria|hans|peter|klaus|jean|pierre|marie|jose|juan|carlos|carmen|luis|paul|thomas|julia|laura|david|daniel|sarah|emma)\b",
}
_SHAPE = {
    "ip": r"^[1-9][0-9]{0,2}(?:\.[0-9]{1,3}){3}$",
    "card": r"^(?:[0-9]{4}[\x20-]){3}[0-9]{1,7}$|^[0-9]{15,16}$|^[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5}$",
    "phone": r"^\+[0-9]{1,3}[\x20().-]",
    "spoken_email": r"[A-Za-z]{2,6}$",
    "ssn": r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$",
    "birth": r"^(?:[0-2]?[0-9]|3[01])[./-](?:0?[0-9]|1[0-2])[./-]|^(?:0?[0-9]|1[0-2])[./-](?:[0-2]?[0-9]|3[01])[./-]",
    "iban": r"^[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}",
    "name": r"\x20.+\x20",
}


def _family(kind: str) -> str:
    return {"ip_weak": "ip", "card_weak": "card", "phone_weak": "phone", "local_phone": "phone"}.get(kind, kind)


def _let(value: Column, body) -> Column:
    """body(value) with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _bound(body, *fixed):
    """A one-argument lambda; Spark would take defaults for arguments of its own."""
    return lambda s: body(*fixed, s)


_LONGS = "array<bigint>"


def _running(values: Column, op, zero: int) -> Column:
    """op over each value and all before it (a sum or a maximum), by blocks: n^1.5 copies at most."""

    def plain(a: Column) -> Column:
        return F.aggregate(a, F.array().cast(_LONGS), lambda acc, x: F.concat(acc, F.array(op(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(zero).cast("long")), x))))

    def blocked(a: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(a))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / size).cast("int")), lambda b: plain(F.slice(a, b * size + 1, size)))

        def joined(parts: Column) -> Column:
            before = plain(F.transform(parts, lambda x: F.element_at(x, -1)))
            return _let(before, lambda t: F.flatten(F.transform(parts, lambda x, i: F.when(i == 0, x).otherwise(F.transform(x, lambda v: op(F.get(t, i - 1), v))))))

        return _let(blocks, joined)

    return F.when(F.size(values) <= 32, plain(values)).otherwise(blocked(values))


def _sum(a: Column, b: Column) -> Column:
    return a + b


def _meets(spans: Column, c: Column) -> Column:
    """Does any of the spans (disjoint, by start) overlap c? Binary search for the first that ends after c starts."""
    n = F.size(spans)

    def step(at: Column, _: Column) -> Column:
        # at.lo: the first so many spans end before c; at.hi: those from here on end after it
        mid = F.floor((at["lo"] + at["hi"]) / 2).cast("int")
        early = F.get(spans, mid)["end"] <= c["start"]
        return F.when(at["lo"] >= at["hi"], at).otherwise(F.struct(F.when(early, mid + 1).otherwise(at["lo"]).alias("lo"), F.when(early, at["hi"]).otherwise(mid).alias("hi")))

    found = F.aggregate(F.sequence(F.lit(1), F.length(F.bin(n)) + 1), F.struct(F.lit(0).alias("lo"), n.alias("hi")), step, lambda at: at["lo"])
    return F.when(n == 0, F.lit(False)).when(n <= 16, F.exists(spans, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))).otherwise(F.coalesce(F.get(spans, found)["start"] < c["end"], F.lit(False)))


def _matches(text: Column, name: str) -> Column:
    """array<struct<start, end, match, before, after>> of a pattern's leftmost matches."""
    pattern = _RE[name]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def spans(m: Column) -> Column:
        def with_gaps(g: Column) -> Column:
            # gap, match, gap, match, .., gap: running lengths are the ends of the matches
            ends = _running(F.zip_with(F.slice(g, F.lit(1), F.size(m)), m, lambda a, b: (F.length(a) + F.length(b)).cast("long")), _sum, 0)
            return _let(
                ends,
                lambda e: F.transform(
                    m,
                    lambda x, i: F.struct(
                        (F.get(e, i) - F.length(x)).cast("long").alias("start"),
                        F.get(e, i).alias("end"),
                        x.alias("match"),
                        F.right(F.get(g, i), F.lit(48)).alias("before"),
                        F.left(F.get(g, i + 1), F.lit(24)).alias("after"),
                    ),
                ),
            )

        none = F.array().cast("array<struct<start:bigint,end:bigint,match:string,before:string,after:string>>")
        return F.when(F.size(m) > 0, _let(F.split(text, pattern, -1), with_gaps)).otherwise(none)

    out = _let(found, spans)
    if name in _NEEDS:
        none = F.array().cast("array<struct<start:bigint,end:bigint,match:string,before:string,after:string>>")
        out = F.when(F.contains(text, F.lit(_NEEDS[name])), out).otherwise(none)
    return out


def _n_digits(x: Column) -> Column:
    return F.length(F.regexp_replace(x, "[^0-9]", ""))


def _luhn(x: Column) -> Column:
    def total(d: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), F.length(d)),
            F.lit(0),
            lambda acc, i: acc + _let(F.substr(d, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1), lambda v: F.when(v > 9, v - 9).otherwise(v)),
        )

    return _let(F.reverse(F.regexp_replace(x, "[^0-9]", "")), lambda d: F.when(F.length(d).between(13, 19), total(d) % 10 == 0).otherwise(F.lit(False)))


def _valid(kind: str, x: Column) -> Column:
    return {"email": lambda: F.lit(True), "ip": lambda: F.rlike(x, F.lit(_OCTETS)), "card": lambda: _luhn(x), "phone": lambda: _n_digits(x).between(9, 15)}[kind]()


def _vote(yes: Column, no: Column | None = None) -> Column:
    v = F.when(yes, 1)
    return (v.when(no, -1) if no is not None else v).otherwise(0)


def _votes(kind: str, s: Column) -> Column:
    """The six labelers' votes on a candidate."""
    f = _family(kind)
    x = s["match"]
    checks = {
        "ip": _vote(F.rlike(x, F.lit(_OCTETS)), F.lit(True)),
        "card": _vote(_luhn(x), F.lit(True)),
        "phone": _vote(_n_digits(x).between(10, 15), _n_digits(x) < 8),
        "ssn": _vote(F.rlike(x, F.lit(r"^(?!000)[0-8][0-9]{2}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$")), F.lit(True)),
        "birth": _vote(F.rlike(x, F.lit(r"(?:19[0-9]{2}|20[0-2][0-9])$")), F.lit(True)),
        "iban": _vote(F.length(F.regexp_replace(x, " ", "")).between(15, 34), F.lit(True)),
    }
    border = F.rlike(s["before"], F.lit(r"[A-Za-z0-9_]$")) | F.rlike(s["after"], F.lit(r"^[A-Za-z0-9_]"))
    return F.array(
        _vote(F.rlike(x, F.lit(_SHAPE[f])), F.lit(True)),
        checks.get(f, F.lit(0)),
        _vote(F.rlike(x, F.lit(_GAZETTEER[f]))),
        _vote(F.rlike(s["before"], F.lit(f"(?i)(?<![a-zà-ÿ])(?:{_FOR[f]})"))),
        F.when(F.rlike(F.concat(s["before"], F.lit(" "), s["after"]), F.lit(f"(?i)(?<![a-z])(?:{_AGAINST})")), -1).otherwise(0),
        _vote(~border, border),
    )


def _added_kind(group: str, x: Column) -> Column:
    if group == "digits":
        return F.when(F.rlike(x, F.lit(r"^[0-9]{3}-[0-9]{2}-")), "ssn").when(F.rlike(x, F.lit(r"^[0-9]{1,2}[./-][0-9]{1,2}[./-]")), "birth").otherwise("local_phone")
    return F.when(F.rlike(x, F.lit(r"\(at\)|\[at\]")), "spoken_email").when(F.rlike(x, F.lit(r"^[A-Z]{2}[0-9]{2}")), "iban").otherwise("name")


_SPAN = "array<struct<kind:string,start:bigint,end:bigint>>"
_CAND = "array<struct<kind:string,start:bigint,end:bigint,votes:array<int>>>"


def candidates(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, base (spans by kind, then start) and cand (weak candidates with votes) of every row, and the columns to keep."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("__text"), *keep)
    t = F.col("__text")
    has_digits = F.rlike(t, F.lit("[0-9]"))
    empty = F.array().cast("array<struct<start:bigint,end:bigint,match:string,before:string,after:string>>")
    for k in (*BASE, "digits", "words"):
        df = df.withColumn(f"__{k}", F.when(has_digits, _matches(t, k)).otherwise(empty) if k in ("ip", "card", "phone", "digits") else _matches(t, k))
    plain = lambda k, s: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    for k in BASE:
        df = df.withColumn(f"__base_{k}", F.transform(F.filter(f"__{k}", _bound(lambda k, s: _valid(k, s["match"]), k)), _bound(plain, k)).cast(_SPAN))
    base = F.concat(*[f"__base_{k}" for k in BASE])
    weak_of = {"ip": "ip_weak", "card": "card_weak", "phone": "phone_weak"}

    def weak(k: str) -> Column:
        near = F.filter(f"__{k}", lambda s: ~_valid(k, s["match"]) & (_n_digits(s["match"]) >= (13 if k == "card" else 7 if k == "phone" else 0)) & (_n_digits(s["match"]) <= 19))
        return F.transform(near, lambda s: F.struct(F.lit(weak_of[k]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), _votes(weak_of[k], s).alias("votes")))

    def added(group: str, kinds: tuple[str, ...]) -> Column:
        parts = []
        for k in kinds:
            mine = F.filter(f"__{group}", _bound(lambda k, s: _added_kind(group, s["match"]) == k, k))
            parts.append(F.transform(mine, _bound(lambda k, s: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), _votes(k, s).alias("votes")), k)))
        return F.concat(*parts)

    cand = F.concat(weak("ip"), weak("card"), weak("phone"), added("words", ("spoken_email",)), added("digits", ("ssn", "local_phone", "birth")), added("words", ("iban", "name"))).cast(_CAND)
    df = df.withColumn("__all", cand)
    free = F.filter("__all", lambda c: ~(_meets(F.col("__base_email"), c) | _meets(F.col("__base_ip"), c) | _meets(F.col("__base_card"), c) | _meets(F.col("__base_phone"), c)))
    return df.select("doc_id", *keep, base.alias("base"), free.alias("cand"))


def _fit_sql(em_rounds: int, fit_rounds: int) -> str:
    """The classifier of one kind from ``pats`` (array of struct<v array<int>, n double>)."""
    add = "(x, y) -> x + y"
    e_step = f"""transform(pats, p -> named_struct('v', p.v, 'n', p.n, 'q',
        1D / (1D + exp(-(ln(s.pi / (1D - s.pi)) + aggregate(zip_with(p.v, s.acc, (v, a) -> v * ln(a / (1D - a))), 0D, {add})))))) """
    m_step = f"""named_struct(
        'pi', least(0.98D, greatest(0.02D, (aggregate(transform(e, p -> p.n * p.q), 0D, {add}) + 1D) / (aggregate(transform(e, p -> p.n), 0D, {add}) + 2D))),
        'acc', transform(sequence(0, {LABELERS - 1}), j -> least(0.97D, greatest(0.52D,
            (aggregate(transform(e, p -> p.n * CASE WHEN p.v[j] > 0 THEN p.q WHEN p.v[j] < 0 THEN 1D - p.q ELSE 0D END), 0D, {add}) + 8D)
            / (aggregate(transform(e, p -> p.n * abs(p.v[j])), 0D, {add}) + 10D)))))"""
    em = f"aggregate(sequence(1, {em_rounds}), named_struct('pi', 0.5D, 'acc', array_repeat(0.8D, {LABELERS})), (s, i) -> transform(array({e_step}), e -> {m_step})[0])"
    # a feature for each labeler's yes, one for each no, and a constant
    design = "transform(e, p -> named_struct('x', concat(transform(p.v, v -> CASE WHEN v > 0 THEN 1D ELSE 0D END), transform(p.v, v -> CASE WHEN v < 0 THEN 1D ELSE 0D END), array(1D)), 'n', p.n, 'q', p.q))"
    residual = f"transform(d, p -> named_struct('x', p.x, 'r', p.n * (1D / (1D + exp(-aggregate(zip_with(p.x, w, (a, b) -> a * b), 0D, {add}))) - p.q)))"
    step = f"transform(w, (wj, j) -> wj - 1.5D * (aggregate(transform(r, p -> p.r * p.x[j]), 0D, {add}) / total + 0.002D * wj))"
    # starts at the log odds that EM found, so that vote patterns never seen keep a sensible weight
    start = "concat(transform(s.acc, a -> ln(a / (1D - a))), transform(s.acc, a -> -ln(a / (1D - a))), array(ln(s.pi / (1D - s.pi))))"
    train = f"""aggregate(sequence(1, {fit_rounds}), {start}, (w, i) -> transform(array({residual}), r -> {step})[0])"""
    body = f"transform(array({design}), d -> transform(array(greatest(1D, aggregate(transform(d, p -> p.n), 0D, {add}))), total -> {train})[0])[0]"
    return f"transform(array({em}), s -> named_struct('pi', s.pi, 'acc', s.acc, 'w', transform(array({e_step}), e -> {body})[0]))[0]"


def fit(cands: DataFrame, em_rounds: int = EM_ROUNDS, fit_rounds: int = FIT_ROUNDS) -> DataFrame:
    """kind, n, pi, acc, w: labeler reliabilities and the classifier's weights, one row a kind."""
    counted = cands.select(F.explode("cand").alias("c")).groupBy("c.kind", "c.votes").agg(F.count("*").cast("double").alias("n"))
    pats = counted.groupBy("kind").agg(F.array_sort(F.collect_list(F.struct(F.col("votes").alias("v"), "n"))).alias("pats"), F.sum("n").alias("n"))
    return pats.withColumn("m", F.expr(_fit_sql(em_rounds, fit_rounds))).select("kind", "n", "m.pi", "m.acc", "m.w")


def weights(model: DataFrame) -> dict[str, list[float]]:
    """The classifier's weights of each kind: at most ``len(ADDED)`` short rows."""
    return {r["kind"]: list(r["w"]) for r in model.select("kind", "w").collect()}


def _probability(votes: Column, w: list[float]) -> Column:
    lit = F.array(*[F.lit(float(x)) for x in w])
    side = lambda first, yes: F.aggregate(
        F.zip_with(votes, F.slice(lit, first, LABELERS), lambda v, a: F.when(v > 0 if yes else v < 0, a).otherwise(0.0)), F.lit(0.0), lambda x, y: x + y
    )
    return 1 / (1 + F.exp(-(side(1, True) + side(LABELERS + 1, False) + F.element_at(lit, 2 * LABELERS + 1))))


def _accepted(w: dict[str, list[float]]) -> Column:
    """The added spans among ``cand``, by kind, then start."""
    parts = []
    for k in ADDED:
        if k not in w:
            continue
        mine = F.filter("cand", _bound(lambda k, c: (c["kind"] == k) & (_probability(c["votes"], w[k]) >= CUT), k))
        parts.append(F.transform(mine, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))))
    return F.concat(*parts).cast(_SPAN) if parts else F.array().cast(_SPAN)


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans (base, then added) of every row."""
    found = stage_table(candidates(docs), "pii-candidates")
    w = weights(fit(found))
    return found.select("doc_id", "base", F.concat("base", _accepted(w)).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """The counted and hashed columns of ``op1`` from ``find_pii``."""
    as_text = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(as_text("base"), 256).alias("base_sha256"), as_text("spans").alias("spans"))


#: Code points of the blocks that long texts are cut from.
_BLOCK = 1024


def _redacted(text: Column, spans: Column) -> Column:
    """``text`` with each run of overlapping spans replaced by the kind of its first one, in brackets."""

    def marks(s: Column) -> Column:
        reach = _running(F.transform(s, lambda x: x["end"]), F.greatest, -1)

        def heads(r: Column) -> Column:
            numbered = F.transform(s, lambda x, i: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), i.alias("i")))
            first = F.filter(numbered, lambda x: (x["i"] == 0) | (x["start"] >= F.get(r, x["i"] - 1)))
            return _let(first, lambda h: F.transform(h, lambda x, k: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), F.get(r, F.coalesce(F.get(h, k + 1)["i"], F.size(s)) - 1).alias("end"))))

        return _let(reach, heads)

    def pieces(m: Column) -> Column:
        def built(blocks: Column) -> Column:
            def cut(lo: Column, hi: Column) -> Column:
                first, last = F.floor(lo / _BLOCK).cast("int"), F.floor((hi - 1) / _BLOCK).cast("int")
                return F.when(hi > lo, F.substr(F.array_join(F.slice(blocks, first + 1, last - first + 1), ""), (lo - first * _BLOCK + 1).cast("int"), (hi - lo).cast("int"))).otherwise("")

            shown = F.transform(m, lambda s, i: F.concat(cut(F.when(i > 0, F.get(m, i - 1)["end"]).otherwise(F.lit(0).cast("long")), s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]")))
            return F.concat(F.array_join(shown, ""), cut(F.element_at(m, -1)["end"], F.length(text).cast("long")))

        return _let(F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % _BLOCK), F.lit(0)), built)

    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.when(F.size(spans) == 0, text).otherwise(_let(ordered, lambda o: _let(marks(o), pieces)))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; other columns unchanged.

    Overlapping spans become one mark, named after the first of them. Spans
    are found once and kept beside their texts in a stage table. Null and empty
    texts, null ids and repeated rows stay as they are, extra columns may have
    any name, and an empty table stays empty.
    """
    names, wide = docs.columns, by_position(docs)
    own, at = f"c{names.index('doc_id')}", f"c{names.index('text')}"
    rows = wide.withColumn("doc_id", F.col(own).cast("long")).withColumn("text", F.col(at))
    found = stage_table(candidates(rows, tuple(wide.columns)), "pii-texts")
    spans = F.concat("base", _accepted(weights(fit(found))))
    done = found.withColumn(at, _redacted(F.col(at), spans).cast(wide.schema[at].dataType))
    return done.select(*wide.columns).toDF(*names)
