"""Fixtures that every operator must get through."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, start int, digest string, score string, rep long"


def row(i, text, lang="en", source="s"):
    return (i, text, lang, source, None if text is None else len(text), "x", 0, "d", "s", None)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


WORDS = "the quick brown fox jumps over the lazy dog while seven small birds sing above an old stone bridge near the river bank".split()


def prose(k, n=60):
    return " ".join(f"{WORDS[(k * 7 + i * (1 + k % 5)) % len(WORDS)]}{(i * k) % 11 if i % 3 == 0 else ''}" for i in range(n))


def awkward(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties, clashing names."""
    rows = [row(i, prose(i)) for i in range(1, 8)]
    rows += [row(8, None), row(9, ""), row(10, "   \n\t "), row(11, "x" * 60_000), row(12, "word " * 20_000), row(13, prose(1)), row(14, prose(1).upper())]
    rows += [row(1, prose(1)), row(None, prose(2)), row(None, None), row(15, "Ünï çødé 😀 中文 text"), row(16, prose(3), None, None)]
    return frame(spark, rows)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
