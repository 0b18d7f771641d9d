"""What a query asks for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def entities(q: Column) -> Column:
    """struct<number, part, year, clause, amendment, temporal> of a normalised query.

    A year after the standard's number beats any other one; a loose year, which
    the number itself is not, counts only with a standard, and only from 1947
    to 2099.
    """
    get = lambda p, i=1: F.nullif(F.regexp_extract(q, p, i), F.lit(""))
    number = get(r"\bIS\s*(\d+)")
    tied, loose = get(r"\bIS\s*\d+\s*:\s*(\d{4})\b"), F.nullif(F.regexp_extract(F.regexp_replace(q, r"\bIS\s*\d+", " "), r"\b(19[4-9]\d|20\d\d)\b", 1), F.lit(""))
    year = F.coalesce(tied, F.when(number.isNotNull(), loose)).cast("int")
    amendment = get(r"(?i)\bamendment\s*(?:no\.?\s*)?(\d+)")
    word = F.lower(q)
    temporal = (
        F.when(F.rlike(word, F.lit(r"\b(?:historical|previous|old|superseded|withdrawn)\b")), "historical")
        .when(F.rlike(word, F.lit(r"\b(?:current|latest|valid|in force)\b")), "current")
        .when(year.isNotNull(), "year")
        .when(F.rlike(word, F.lit(r"\bedition\b")), "edition")
        .when(amendment.isNotNull(), "amendment")
    )
    return F.struct(
        number.alias("number"),
        get(r"(?i)\bpart\s*(\d+)").alias("part"),
        F.when(year.between(1947, 2099), year).alias("year"),
        get(r"(?i)\bclause\s*(\d+(?:\.\d+)*)").alias("clause"),
        amendment.alias("amendment"),
        temporal.alias("temporal"),
    )
