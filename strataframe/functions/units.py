"""Units: a lookup table, parameters read from text, and comparison with requirements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.functions import text as X

# Unit, canonical unit, factor, offset, dimension.
UNITS = [
    ("l", "L", 1.0, 0.0, "volume"), ("litre", "L", 1.0, 0.0, "volume"), ("litres", "L", 1.0, 0.0, "volume"), ("liter", "L", 1.0, 0.0, "volume"), ("liters", "L", 1.0, 0.0, "volume"),
    ("ml", "L", 0.001, 0.0, "volume"), ("millilitre", "L", 0.001, 0.0, "volume"), ("millilitres", "L", 0.001, 0.0, "volume"), ("m3", "L", 1000.0, 0.0, "volume"), ("cubic metre", "L", 1000.0, 0.0, "volume"),
    ("mm", "mm", 1.0, 0.0, "length"), ("millimetre", "mm", 1.0, 0.0, "length"), ("millimeter", "mm", 1.0, 0.0, "length"), ("cm", "mm", 10.0, 0.0, "length"), ("centimetre", "mm", 10.0, 0.0, "length"),
    ("m", "mm", 1000.0, 0.0, "length"), ("metre", "mm", 1000.0, 0.0, "length"), ("meter", "mm", 1000.0, 0.0, "length"), ("in", "mm", 25.4, 0.0, "length"), ("inch", "mm", 25.4, 0.0, "length"), ("inches", "mm", 25.4, 0.0, "length"),
    ("g", "kg", 0.001, 0.0, "mass"), ("gram", "kg", 0.001, 0.0, "mass"), ("grams", "kg", 0.001, 0.0, "mass"), ("kg", "kg", 1.0, 0.0, "mass"), ("kilogram", "kg", 1.0, 0.0, "mass"), ("kilograms", "kg", 1.0, 0.0, "mass"),
    ("tonne", "kg", 1000.0, 0.0, "mass"), ("tonnes", "kg", 1000.0, 0.0, "mass"), ("t", "kg", 1000.0, 0.0, "mass"),
    ("°c", "°C", 1.0, 0.0, "temperature"), ("deg c", "°C", 1.0, 0.0, "temperature"), ("c", "°C", 1.0, 0.0, "temperature"), ("celsius", "°C", 1.0, 0.0, "temperature"), ("k", "°C", 1.0, -273.15, "temperature"), ("kelvin", "°C", 1.0, -273.15, "temperature"),
    ("bar", "bar", 1.0, 0.0, "pressure"), ("bars", "bar", 1.0, 0.0, "pressure"), ("kpa", "bar", 0.01, 0.0, "pressure"), ("mpa", "bar", 10.0, 0.0, "pressure"), ("pa", "bar", 0.00001, 0.0, "pressure"), ("psi", "bar", 0.0689476, 0.0, "pressure"),
    ("w", "W", 1.0, 0.0, "power"), ("watt", "W", 1.0, 0.0, "power"), ("watts", "W", 1.0, 0.0, "power"), ("kw", "W", 1000.0, 0.0, "power"), ("kilowatt", "W", 1000.0, 0.0, "power"), ("hp", "W", 745.7, 0.0, "power"),
    ("v", "V", 1.0, 0.0, "voltage"), ("volt", "V", 1.0, 0.0, "voltage"), ("volts", "V", 1.0, 0.0, "voltage"), ("kv", "V", 1000.0, 0.0, "voltage"), ("mv", "V", 0.001, 0.0, "voltage"),
    ("a", "A", 1.0, 0.0, "current"), ("amp", "A", 1.0, 0.0, "current"), ("ampere", "A", 1.0, 0.0, "current"), ("amps", "A", 1.0, 0.0, "current"), ("ma", "A", 0.001, 0.0, "current"),
    ("hz", "Hz", 1.0, 0.0, "frequency"), ("hertz", "Hz", 1.0, 0.0, "frequency"), ("khz", "Hz", 1000.0, 0.0, "frequency"), ("mhz", "Hz", 1000000.0, 0.0, "frequency"),
    ("%", "%", 1.0, 0.0, "percentage"), ("percent", "%", 1.0, 0.0, "percentage"),
]
EPS = 1e-6
_NUMBER = r"(\d+(?:\.\d+)?)"
_UNIT = r"\s*([°%a-zA-Z/]+)?"
_NAMED = r"(?:([a-zA-Z_\s]+)[:=]\s*)?"


def unit_table(spark: SparkSession) -> DataFrame:
    """The registry as rows: a few dozen, so joins with it broadcast."""
    return spark.createDataFrame(UNITS, "unit string, canonical string, factor double, offset double, dimension string")


def unit_details(unit: Column) -> Column:
    """struct<canonical, factor, offset, dimension> of a unit, NULL for an unknown one: one look-up for all four."""
    table = F.create_map(*[x for u in UNITS for x in (F.lit(u[0]), F.struct(F.lit(u[1]).alias("canonical"), F.lit(u[2]).alias("factor"), F.lit(u[3]).alias("offset"), F.lit(u[4]).alias("dimension")))])
    return F.try_element_at(table, plain_unit(unit))


def plain_unit(unit: Column) -> Column:
    """Lower case, single spaces, underscores read as spaces; NULL for a blank one."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(unit)), r"[\s_]+", " "), F.lit(""))


def canonical_unit(unit: Column) -> Column:
    return F.coalesce(unit_details(unit)["canonical"], unit)


def _scaled(value: Column, details: Column) -> Column:
    return value * F.coalesce(details["factor"], F.lit(1.0)) + F.coalesce(details["offset"], F.lit(0.0))


def canonical_value(value: Column, unit: Column) -> Column:
    """value * factor + offset; unknown units keep the value."""
    return X.let(unit_details(unit), lambda d: _scaled(value, d))


def units_agree(a: Column, b: Column) -> Column:
    """Same dimension; unknown units by text; a unit on one side only never agrees."""
    dim = lambda u: F.coalesce(unit_details(u)["dimension"], plain_unit(u), F.lit(""))
    return dim(a) == dim(b)


def quantity(name, value, text, lower, upper, nominal, tolerance, op, unit) -> Column:
    """The struct of a quantity; numbers that are None are NULL."""
    num = lambda c: (F.lit(None) if c is None else c).cast("double")
    word = lambda c: (F.lit(None) if c is None else F.lit(c) if isinstance(c, str) else c).cast("string")
    return F.struct(
        word(name).alias("name"), num(value).alias("value"), word(text).alias("text"), num(lower).alias("lower"), num(upper).alias("upper"),
        num(nominal).alias("nominal"), num(tolerance).alias("tolerance"), word(op).alias("op"), word(unit).alias("unit"),
    )


def _group(text: Column, pattern: str, i: int) -> Column:
    return F.nullif(F.trim(F.regexp_extract(text, pattern, i)), F.lit(""))


def _groups(text: Column, pattern: str, n: int) -> Column:
    """struct<g1, ..> of the first match, trimmed; NULL without one: a pattern that does not fit is tried once, whatever is read of it."""
    return F.when(F.rlike(text, F.lit(pattern)), F.struct(*[F.trim(F.regexp_extract(text, pattern, i)).alias(f"g{i}") for i in range(1, n + 1)]))


def _said(match: Column, i: int) -> Column:
    return F.nullif(match[f"g{i}"], F.lit(""))


def bound(sign: Column) -> Column:
    """LE, GE or EQ of a comparison sign; strict signs count as their weak ones."""
    return F.when(sign.isin("<=", "<", "≤"), "LE").when(sign.isin(">=", ">", "≥"), "GE").otherwise("EQ")


def parameter(text: Column, hint: Column | None = None) -> Column:
    """The quantity that a text states: with a tolerance, as a range, or one number with or without a sign.

    A list marker before it does not count. Bounds: the value less and plus
    its tolerance, both ends of a range, or the side that the sign names. Its
    name stands before ':' or '=', else it is the hint. Without a number the
    text itself is the value where there is a hint.
    """
    bare = F.trim(F.regexp_replace(F.trim(text), r"^(?:\(?\d+[.)](?!\d)|[a-zA-Z][.)]|[-*])\s*", ""))
    if hint is None:
        return X.let(bare, lambda line: _parameter(line, None))
    return X.let(F.struct(bare.alias("line"), hint.alias("hint")), lambda x: _parameter(x["line"], x["hint"]))


def _parameter(line: Column, hint: Column | None) -> Column:
    tol, rng = rf"(?i){_NAMED}{_NUMBER}\s*(?:±|\+/-)\s*{_NUMBER}{_UNIT}", rf"(?i){_NAMED}(?:between\s+)?{_NUMBER}\s*(?:to|-|and)\s*{_NUMBER}{_UNIT}"
    single = rf"(?i){_NAMED}(<=|>=|<|>|=)?\s*{_NUMBER}{_UNIT}"

    def read(m: Column) -> Column:
        tol, rng, single = m["tol"], m["rng"], m["single"]
        num = lambda p, i: _said(p, i).cast("double")
        name = lambda p: F.coalesce(_said(p, 1), F.lit("parameter") if hint is None else F.coalesce(hint, F.lit("parameter")))
        v, t, one, op = num(tol, 2), num(tol, 3), num(single, 3), bound(_said(single, 2))
        out = (
            F.when(t.isNotNull(), quantity(name(tol), v, None, v - t, v + t, v, t, "EQ", _said(tol, 4)))
            .when(num(rng, 3).isNotNull(), quantity(name(rng), None, None, num(rng, 2), num(rng, 3), None, None, "RANGE", _said(rng, 4)))
            .when(one.isNotNull(), quantity(name(single), one, None, F.when(op == "GE", one), F.when(op == "LE", one), F.when(op == "EQ", one), None, op, _said(single, 4)))
        )
        return out if hint is None else out.when(hint.isNotNull() & (line != ""), quantity(hint, None, line, None, None, None, None, None, None))

    return X.let(F.struct(_groups(line, tol, 4).alias("tol"), _groups(line, rng, 4).alias("rng"), _groups(line, single, 4).alias("single")), read)


def requirement(line: Column) -> Column:
    """The limit that a line sets, by the first kind of phrase that fits: a range, a tolerance, at most, at least, or a sign."""
    return X.let(line, _requirement)


def _requirement(line: Column) -> Column:
    name = r"([a-zA-Z_\s]{2,30}?)\s*"
    rng = rf"(?i){name}(?:shall\s+be\s+between|between|from)\s+{_NUMBER}\s*(?:and|to|-)\s*{_NUMBER}{_UNIT}"
    tol = rf"(?i){name}(?:shall\s+be|shall\s+equal|=)\s*{_NUMBER}\s*(?:±|\+/-)\s*{_NUMBER}{_UNIT}"
    most = rf"(?i){name}(?:shall\s+not\s+exceed|shall\s+be\s+(?:at\s+most|no\s+more\s+than)|maximum|max\.?)\s+{_NUMBER}{_UNIT}"
    least = rf"(?i){name}(?:shall\s+be\s+at\s+least|shall\s+not\s+be\s+less\s+than|minimum|min\.?)\s+{_NUMBER}{_UNIT}"
    sign = rf"(?i){name}(<=|>=|<|>|=)\s*{_NUMBER}{_UNIT}"

    def read(m: Column) -> Column:
        rng, tol, most, least, sign = (m[n] for n in ("rng", "tol", "most", "least", "sign"))
        num = lambda p, i: _said(p, i).cast("double")
        v, t, s, op = num(tol, 2), num(tol, 3), num(sign, 3), bound(_said(sign, 2))
        called = lambda p: _said(p, 1)
        return (
            F.when(num(rng, 3).isNotNull(), quantity(called(rng), None, None, num(rng, 2), num(rng, 3), None, None, "RANGE", _said(rng, 4)))
            .when(t.isNotNull(), quantity(called(tol), v, None, v - t, v + t, v, t, "EQ", _said(tol, 4)))
            .when(num(most, 2).isNotNull(), quantity(called(most), num(most, 2), None, None, num(most, 2), None, None, "LE", _said(most, 3)))
            .when(num(least, 2).isNotNull(), quantity(called(least), num(least, 2), None, num(least, 2), None, None, None, "GE", _said(least, 3)))
            .when(s.isNotNull(), quantity(called(sign), s, None, F.when(op == "GE", s), F.when(op == "LE", s), F.when(op == "EQ", s), None, op, _said(sign, 4)))
        )

    found = {"rng": (rng, 4), "tol": (tol, 4), "most": (most, 3), "least": (least, 3), "sign": (sign, 4)}
    return X.let(F.struct(*[_groups(line, p, n).alias(k) for k, (p, n) in found.items()]), read)


def compare(
    value: Column, tolerance: Column, unit: Column, op: Column, lower: Column, upper: Column, nominal: Column, req_unit: Column,
    low: Column | None = None, high: Column | None = None, text: Column | None = None, req_text: Column | None = None, req_tolerance: Column | None = None,
) -> Column:
    """State of a specified value against a requirement: MATCH, PARTIAL_MATCH, MISMATCH, UNVERIFIABLE or MISSING.

    A specification is a ``value`` with a tolerance, a range ``low`` to ``high``,
    or a ``text``, which only EQ and CONTAINS without a threshold compare (with
    ``req_text``). It is MISSING where it has none of them. Units are compared
    where both sides have one; strict signs count as weak ones.
    """
    null = F.lit(None)
    low, high, text, req_text, req_tolerance = (null.cast(t) if c is None else c for c, t in ((low, "double"), (high, "double"), (text, "string"), (req_text, "string"), (req_tolerance, "double")))
    facts = F.struct(
        unit_details(unit).alias("u"), unit_details(req_unit).alias("r"), value.cast("double").alias("v"), tolerance.cast("double").alias("t"), low.cast("double").alias("low"), high.cast("double").alias("high"),
        lower.cast("double").alias("lo"), upper.cast("double").alias("hi"), nominal.cast("double").alias("n"), req_tolerance.cast("double").alias("rt"), op.alias("op"),
    )

    def scaled(f: Column) -> Column:
        n, lo, hi = (_scaled(f[c], f["r"]) for c in ("n", "lo", "hi"))
        spread = F.when(f["lo"].isNull(), f["rt"] * F.coalesce(f["r"]["factor"], F.lit(1.0)))
        return F.struct(
            _scaled(f["v"], f["u"]).alias("v"), F.coalesce(f["t"] * F.coalesce(f["u"]["factor"], F.lit(1.0)), F.lit(0.0)).alias("t"), _scaled(f["low"], f["u"]).alias("low"), _scaled(f["high"], f["u"]).alias("high"),
            F.coalesce(n - spread, lo).alias("lo"), F.coalesce(n + spread, hi).alias("hi"), n.alias("n"), f["op"].alias("op"),
        )

    apart = plain_unit(unit).isNotNull() & plain_unit(req_unit).isNotNull() & ~units_agree(unit, req_unit)
    worded = F.when(F.coalesce(op.isin("EQ", "CONTAINS") & nominal.isNull(), F.lit(False)), F.when(F.contains(F.lower(F.coalesce(req_text, F.lit(""))), F.lower(F.trim(text))), "MATCH").otherwise("MISMATCH")).otherwise("UNVERIFIABLE")
    return (
        F.when(value.isNull() & low.isNull() & high.isNull() & text.isNull(), "MISSING")
        .when(apart, "UNVERIFIABLE")
        .when(value.isNull() & low.isNull() & high.isNull(), worded)
        .otherwise(X.let(facts, lambda f: X.let(scaled(f), _state)))
    )


def _state(f: Column) -> Column:
    """The decision over canonical numbers; a missing limit or value leaves it UNVERIFIABLE."""
    v, t, lo, hi, n = (f[c] for c in ("v", "t", "lo", "hi", "n"))
    state = lambda full, part: F.when(full, "MATCH").when(part, "PARTIAL_MATCH").otherwise("MISMATCH")
    inside = lambda a, b: state((a >= lo - EPS) & (b <= hi + EPS), (a <= hi) & (b >= lo))
    most, least = F.coalesce(n, hi), F.coalesce(n, lo)
    close = F.abs(v - n) <= F.greatest(F.lit(1e-4) * F.greatest(F.abs(v), F.abs(n)), F.lit(1e-4))
    bounded = lo.isNotNull() & hi.isNotNull()
    found = (
        F.when(f["op"].isin("LE", "LT"), F.when(most.isNotNull() & v.isNotNull(), state(v + t <= most + EPS, v <= most + EPS)))
        .when(f["op"].isin("GE", "GT"), F.when(least.isNotNull() & v.isNotNull(), state(v - t >= least - EPS, v >= least - EPS)))
        .when(f["op"] == "RANGE", F.when(bounded & v.isNotNull(), inside(v - t, v + t)).when(bounded & f["low"].isNotNull() & f["high"].isNotNull(), inside(f["low"], f["high"])))
        .when(f["op"] == "EQ", F.when(bounded, F.when(v.isNotNull(), F.when(v.between(lo - EPS, hi + EPS), "MATCH").otherwise("MISMATCH"))).when(n.isNotNull() & v.isNotNull(), F.when(close, "MATCH").otherwise("MISMATCH")))
    )
    return F.coalesce(found, F.lit("UNVERIFIABLE"))
