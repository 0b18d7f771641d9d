"""Fill-in-the-middle transformation in Spark SQL functions.

``regexp_extract_all`` makes the array of units (lines), ``conv`` of parts of
``sha2`` gives two cuts and two draws, ``slice`` and ``array_join`` build the
arrangement, and ``split`` at the sentinels restores the text from the output
and its form alone. No Python runs on the rows, nothing is shuffled.

Defined cases: a null text counts as empty; an empty text, or one that holds a
sentinel, is plain (null lengths); a null doc_id is hashed as if it were the
empty string; repeated rows give repeated rows; extra columns are ignored,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINES = "[^\\n]*\\n|[^\\n]+"
SENTINELS = ("<P>", "<S>", "<M>")


def _checked(sentinels: tuple[str, str, str]) -> tuple[str, str, str]:
    """Sentinels whose places in an output are certain: none holds another, and none begins as one (or itself) ends."""
    for a in sentinels:
        for b in sentinels:
            overlap = any(a.endswith(b[:n]) for n in range(1, min(len(a), len(b))))
            if not a or overlap or (a != b and a in b) or len(set(sentinels)) < 3:
                raise ValueError(f"sentinels {a!r} and {b!r} may overlap")
    return sentinels


def _draw(digest: Column, group: int) -> Column:
    """The given 8-digit group of a hexadecimal digest as an unsigned integer."""
    return F.conv(F.substring(digest, 8 * group + 1, 8), 16, 10).cast("long")


def _joined(units: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(units, start.cast("int"), length.cast("int")), "")


def fill_in_middle(docs: DataFrame, seed: int = 7, fim_percent: int = 100, spm_percent: int = 50, sentinels: tuple[str, str, str] = SENTINELS, units: str = LINES) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars and output of every row of ``docs``."""
    p, s, m = _checked(sentinels)
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("body"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    cut = body.withColumns({"units": F.regexp_extract_all("body", F.lit(units), F.lit(0)), "digest": digest}).withColumn("n", F.size("units").cast("long"))
    ends = [_draw(F.col("digest"), k) % (F.col("n") + 1) for k in (0, 1)]
    cut = cut.withColumns({"a": F.least(*ends), "b": F.greatest(*ends)})
    plain = (F.col("body") == "") | F.col("body").contains(p) | F.col("body").contains(s) | F.col("body").contains(m) | (_draw(F.col("digest"), 2) % 100 >= fim_percent)
    form = F.when(plain, "plain").when(_draw(F.col("digest"), 3) % 100 < spm_percent, "spm").otherwise("psm")
    parts = cut.withColumns(
        {
            "form": form,
            "prefix": _joined(F.col("units"), F.lit(1), F.col("a")),
            "middle": _joined(F.col("units"), F.col("a") + 1, F.col("b") - F.col("a")),
            "suffix": _joined(F.col("units"), F.col("b") + 1, F.col("n") - F.col("b")),
        }
    )
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit(p), "prefix", F.lit(s), "suffix", F.lit(m), "middle"))
        .when(F.col("form") == "spm", F.concat(F.lit(s), "suffix", F.lit(p), "prefix", F.lit(m), "middle"))
        .otherwise(F.col("body"))
    )
    length = lambda part: F.when(F.col("form") != "plain", F.length(part).cast("long"))
    return parts.select("doc_id", "n", "form", length("prefix").alias("prefix_chars"), length("middle").alias("middle_chars"), output.alias("output"))


def restored(output: Column | str, form: Column | str, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text from an output and its form."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    parts = F.split(output, "|".join(f"\\Q{x}\\E" for x in _checked(sentinels)), -1)
    in_order = lambda *places: F.concat(*[F.get(parts, F.lit(k)) for k in places])
    return F.when(form == "psm", in_order(1, 3, 2)).when(form == "spm", in_order(2, 3, 1)).otherwise(output)


def digest(found: DataFrame, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """Hashes of the outputs and of the texts restored from them."""
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored("output", "form", sentinels), 256).alias("restored_sha256"))
