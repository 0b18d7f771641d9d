"""Text and identifier expressions. All stay inside whole-stage code generation."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that cleaning turns into a space or removes.
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
ZERO_WIDTH = "\u200b\u200c\u200d\ufeff"
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")]
PUNCTUATION = "\"'`.,;:!?()[]{}<>/\\|~@#$%^&*+=_"  # hyphens stay
SUFFIXES = ("ation", "ations", "ment", "ments", "ing", "tion", "tions", "ies", "ied", "ed", "ly", "es", "s")

STANDARD = r"(?i)\bIS[\s:\-]*(\d+)(?:\s*\(?\s*part\s*[\-:]?\s*(\d+)\s*\)?)?"


def let(value: Column, body) -> Column:
    """body(value) with ``value`` computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def first_filled(*cols: Column) -> Column:
    """The first value that is neither NULL nor ''."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def first_nonzero(*cols: Column) -> Column:
    """The first value that is neither NULL nor 0; 0 when there is none."""
    return F.coalesce(*[F.nullif(c, F.lit(0.0)) for c in cols], F.lit(0.0))


def clean_markdown(c: Column) -> Column:
    """Line ends, entities, odd spaces, trailing blanks and runs of blank lines; NULL when nothing is left."""
    c = F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    c = reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), ENTITIES, c)
    c = F.translate(c, SPACES + ZERO_WIDTH, " " * len(SPACES))
    c = F.regexp_replace(c, r"[ \t]+(\n|$)", "$1")
    c = F.regexp_replace(c, r"\n{4,}", "\n\n\n")
    return F.nullif(F.regexp_replace(c, r"^\s+|\s+$", ""), F.lit(""))


def normalize_markdown(c: Column) -> Column:
    """Undo escaped pipes and stars."""
    for old, new in ((r"\|", "|"), ("%5C|", "|"), ("%5C*", "*")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[ \t]+", " "))


def comparison_form(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\w\s]", ""), r"\s+", " "))


def same_text(a: Column, b: Column) -> Column:
    """Equal in comparison form; empty texts equal nothing."""
    return (comparison_form(a) == comparison_form(b)) & (comparison_form(a) != "")


def heading_level(line: Column) -> Column:
    """1 to 6 for a Markdown heading, else NULL."""
    marks = F.regexp_extract(line, r"^ {0,3}(#{1,6})\s+\S", 1)
    return F.when(marks != "", F.length(marks))


def heading_text(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, r"^ {0,3}#{1,6}\s+|\s+#+\s*$", ""))


def is_table_line(line: Column) -> Column:
    return F.rlike(line, F.lit(r"^\s*\|.*\|\s*$"))


def is_table_separator(line: Column) -> Column:
    return F.rlike(line, F.lit(r"^\s*\|?\s*:?-{2,}:?\s*(\|\s*:?-{2,}:?\s*)*\|?\s*$"))


def table_cells(line: Column) -> Column:
    """Cells of a table row, white space squeezed, empty edge cells removed."""
    return F.transform(F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"\|"), squeeze)


def without_repeats(cells: Column) -> Column:
    """Drop cells equal (in comparison form) to the cell kept before them."""
    return F.aggregate(cells, F.array().cast("array<string>"), lambda acc, x: F.when((F.size(acc) > 0) & same_text(F.try_element_at(acc, F.lit(-1)), x), acc).otherwise(F.concat(acc, F.array(x))))


def heading_candidate(line: Column) -> Column:
    """Unmarked lines that look like a heading."""
    t = F.trim(line)
    numbered = F.rlike(t, F.lit(r"^(?:(?i)annex|appendix|foreword|introduction|scope)\b|^\d+(\.\d+)*[.)]?\s+\S|^[A-Z]\.\s+\S|^[IVXL]+\.\s+\S"))
    capitals = (F.length(t) < 120) & F.rlike(t, F.lit(r"^[^a-z]*$")) & F.rlike(t, F.lit(r"(?:[^A-Z]*[A-Z]){4}"))
    return (t != "") & (F.length(t) <= 180) & (numbered | capitals)


def clause_number(c: Column) -> Column:
    """Dotted number at the start, after an optional 'Clause' or 'Section'; NULL without one."""
    return F.nullif(F.regexp_extract(c, r"(?i)^\s*(?:clause\s+|section\s+)?(\d+(?:\.\d+)*)", 1), F.lit(""))


def standard_number(c: Column) -> Column:
    """'IS n' or 'IS n-p'; other input with its white space squeezed."""
    number, part = F.regexp_extract(c, STANDARD, 1), F.regexp_extract(c, STANDARD, 2)
    return F.when(number != "", F.concat(F.lit("IS "), number, F.when(part != "", F.concat(F.lit("-"), part)).otherwise(""))).otherwise(F.trim(F.regexp_replace(c, r"\s+", " ")))


def digest(c: Column, n: int = 64) -> Column:
    return F.substring(F.sha2(c, 256), 1, n)


def document_id(content: Column) -> Column:
    return F.concat(F.lit("doc_"), digest(content, 16))


def content_hash(content: Column) -> Column:
    return digest(content, 32)


def standard_id(number: Column) -> Column:
    return F.concat(F.lit("std_"), digest(F.lower(F.trim(number)), 16))


def version_id(standard: Column, version_key: Column) -> Column:
    return F.concat(F.lit("ver_"), standard, F.lit("_"), digest(F.lower(version_key), 12))


def clause_id(version: Column, number_or_path: Column) -> Column:
    return F.concat(F.lit("cls_"), digest(F.concat(version, F.lit("::"), number_or_path), 16))


def chunk_id(doc: Column, section: Column, content: Column, occurrence: Column) -> Column:
    base = digest(F.concat_ws("::", F.trim(doc), F.trim(section), F.trim(content)), 16)
    return F.concat(base, F.when(occurrence > 0, F.concat(F.lit("_"), occurrence.cast("string"))).otherwise(""))


def clause_level(number: Column) -> Column:
    return F.size(F.split(number, r"\."))


def parent_clause(number: Column) -> Column:
    """The number without its last part; NULL for top-level clauses."""
    return F.when(F.contains(number, F.lit(".")), F.regexp_replace(number, r"\.[^.]+$", ""))


def version_key(edition: Column, year: Column) -> Column:
    return F.coalesce(F.nullif(edition, F.lit("")), year.cast("string"), F.lit("v1"))


def encode_int(c: Column) -> Column:
    return F.coalesce(c, F.lit(-1))


def decode_int(c: Column) -> Column:
    return F.nullif(c, F.lit(-1))


def encode_tristate(c: Column) -> Column:
    return F.when(c, "true").when(~c, "false").otherwise("")


def decode_tristate(c: Column) -> Column:
    return F.when(c == "true", True).when(c == "false", False)


def encode_path(c: Column) -> Column:
    return F.array_join(c, " > ")


def decode_path(c: Column) -> Column:
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, " > "))


def context_prefix(standard: Column, edition: Column, path: Column, clause: Column, page: Column, most: int = 400) -> Column:
    """'[Standard: .. | Edition .. | ..]', cut to ``most`` characters; NULL parts are left out."""
    label = lambda name, c: F.concat(F.lit(name), c.cast("string"))
    body = F.concat(F.lit("["), F.concat_ws(" | ", label("Standard: ", standard), label("Edition: ", edition), label("Hierarchy: ", path), label("Clause: ", clause), label("Page: ", page)), F.lit("]"))
    return F.when(F.length(body) > most, F.concat(F.substring(body, 1, most - 4), F.lit("...]"))).otherwise(body)


def tokens(c: Column) -> Column:
    """Lower-case words, punctuation trimmed at their ends only: from the first other character of a run to its last."""
    other = "[^\\s" + re.escape(PUNCTUATION) + "]"
    return F.regexp_extract_all(F.lower(c), F.lit(rf"{other}(?:\S*{other})?"), F.lit(0))


def normalize_query(c: Column) -> Column:
    """Spacing of standard numbers, years, clauses and amendments."""
    for pattern, new in (
        (r"(?i)\bIS[\s\-:]*(\d+)", "IS $1"),
        (r"(IS \d+)\s*:\s*(\d{4})", "$1 : $2"),
        (r"(?i)\bclause\s*(\d)", "Clause $1"),
        (r"(?i)\b(?:amd|amendment)\s*(?:no\.?\s*)?(\d)", "Amendment $1"),
        (r"\s+", " "),
    ):
        c = F.regexp_replace(c, pattern, new)
    return F.trim(c)


def stem(word: Column) -> Column:
    """Cut the first suffix, in their order, that leaves more than two letters."""
    out = word
    for s in reversed(SUFFIXES):
        out = F.when(F.endswith(word, F.lit(s)) & (F.length(word) > len(s) + 2), F.substring(word, F.lit(1), F.length(word) - len(s))).otherwise(out)
    return out


def sigmoid(c: Column) -> Column:
    """Logistic of the value held within +-10; 0.5 for NULL."""
    return F.when(c.isNull(), 0.5).otherwise(1 / (1 + F.exp(-F.greatest(F.lit(-10.0), F.least(F.lit(10.0), c)))))


def share_filled(*cols: Column) -> Column:
    """Provenance completeness: the share of columns that are filled."""
    return reduce(lambda a, b: a + b, [F.when(F.coalesce(c.cast("string"), F.lit("")) != "", 1.0 / len(cols)).otherwise(0.0) for c in cols])


def valid_huid(c: Column) -> Column:
    return F.rlike(F.upper(F.trim(c)), F.lit(r"^[A-Z0-9]{6}$"))


def parse_date(c: Column) -> Column:
    """Y-m-d, d-m-Y (else m-d-Y) or 'd Mon Y'; NULL otherwise."""
    d = F.replace(F.replace(F.trim(c), F.lit("/"), F.lit("-")), F.lit("."), F.lit("-"))
    return F.coalesce(F.try_to_date(d, "yyyy-MM-dd"), F.try_to_date(d, "dd-MM-yyyy"), F.try_to_date(d, "MM-dd-yyyy"), F.try_to_date(c, "d MMM yyyy"))
