"""Quality rules with adaptive thresholds.

Per document: words are runs without ASCII white space; counts of their code
points, of symbol characters, of repeated lines and of words inside three-word
windows that occur twice or more in the text. A document fails the base rules
with fewer than 50 words or when over half of its words lie in repeated
windows. The method replaces fixed cutoffs for the rest: mergeable quantile
sketches of each feature per (lang, source) give outer fences
(quartiles +- ``reach`` interquartile ranges), and documents outside the fences
of their own group are not kept. Shares of repeated lines and windows are zero
in most texts, quartiles included; their spread is that from the upper quartile
to the 0.95 quantile. A fence is never nearer to its quartile than ``slack``;
for repeats that is a count over the length of the text (one line,
``SPARE_WORDS`` words), so it protects short texts and vanishes with length,
and the quantiles set the cutoff.

A sketch is a histogram over logarithmic buckets: a value counts in the bucket
of its order of magnitude in steps of 2 x ``ACCURACY``, so a quantile is within
``ACCURACY`` of an exact one, and sketches merge by adding their counts. They
are the same whatever the order and number of tasks, so a run that is repeated
keeps the same rows. Counts combine on the map side: a source with a third of
all rows sends some hundred short rows a task. Texts are read and measured
once; the counts are staged.

Defined cases: null or empty text has no words and fails; null lang or source
form groups of their own; a group where no document passes the base rules has
no fences and keeps nothing; repeated rows are judged each; an empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataframe.llm._common import release_memory, slices, stage_table, text_buffer

#: Relative error of a sketch's quantiles.
ACCURACY = 0.005
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
#: Repeated words that say nothing against a text: two copies of a sentence of 15 words.
SPARE_WORDS = 30

#: feature -> (expression, which sides are fenced ("tail": high, by the upper tail), least distance of a fence from the quartile, per text).
FEATURES = {
    "mean_word_chars": ("try_divide(word_chars, n_words)", "both", "1.0"),
    "symbol_share": ("try_divide(n_symbols, word_chars)", "high", "0.02"),
    "dup_line_share": ("try_divide(n_dup_lines, n_lines)", "tail", "try_divide(1, n_lines)"),
    "repeat_share": ("try_divide(n_repeat_words, n_words)", "tail", f"least(0.40, try_divide({SPARE_WORDS}, n_words))"),
    "upper_share": ("try_divide(n_upper, word_chars)", "high", "0.10"),
}

_OUT = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("source", pa.string())] + [(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")])
_SYM_TABLE = np.isin(np.arange(256), list(SYMBOLS))


def repeat_words(words: list[bytes]) -> int:
    """Words covered by three-word windows that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, n)
    if len(ids) == n:
        return 0
    v = len(ids)
    key = w[:-2] * v + w[1:-1]
    if v >= 2_000_000:  # three ids would not fit in 63 bits
        key = np.unique(key, return_inverse=True)[1]
    key = key * v + w[2:]
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = s[1:] == s[:-1]
    hit = np.zeros(len(s), bool)
    hit[1:] |= same
    hit[:-1] |= same
    starts = order[hit]
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[starts + k] = True
    return int(covered.sum())


def _measure(batches):
    for b in (part for whole in batches for part in slices(whole, 3, 1024)):
        data, off = text_buffer(b.column(3))
        raw = np.frombuffer(data, np.uint8)
        starts = off[:-1]
        sums = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[off])
        space = (raw == 32) | ((raw >= 9) & (raw <= 13))
        chars = sums((raw & 0xC0) != 0x80) - sums(space)
        symbols, upper = sums(_SYM_TABLE[raw]), sums((raw >= 65) & (raw <= 90))
        words, repeats, dups, lines = [], [], [], []
        for i, j in zip(starts.tolist(), off[1:].tolist()):
            body = data[i:j]
            w = body.split()
            words.append(len(w))
            repeats.append(repeat_words(w))
            seen: set[bytes] = set()
            n = d = 0
            for line in body.split(b"\n"):
                if line and not line.isspace():
                    n += 1
                    d += line in seen
                    seen.add(line)
            dups.append(d)
            lines.append(n)
        yield pa.record_batch([b.column(0), b.column(1), b.column(2), *(pa.array(x, pa.int64()) for x in (words, chars, symbols, dups, repeats, lines, upper))], schema=_OUT)
    release_memory()


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counted features of every row."""
    picked = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("text").cast("string"))
    return picked.mapInArrow(_measure, "doc_id long, lang string, source string, " + ", ".join(f"{f.name} long" for f in _OUT if f.name not in ("doc_id", "lang", "source"))).withColumn(
        "base_failed", F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words")
    )


def sketches(measured: DataFrame, accuracy: float = ACCURACY) -> DataFrame:
    """t_lang, t_source, feature, bucket, n: the mergeable sketch of each group and feature, from rows that pass the base rules.

    Bucket b holds values in (g^(b-1), g^b], g = (1 + accuracy) / (1 - accuracy);
    a null bucket holds zeros.
    """
    gamma = (1 + accuracy) / (1 - accuracy)
    values = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.expr(f"CAST({e} AS DOUBLE)").alias("x")) for f, (e, _, _) in FEATURES.items()]))
    each = measured.filter(~F.col("base_failed")).select(F.col("lang").alias("t_lang"), F.col("source").alias("t_source"), values.alias("v")).select("t_lang", "t_source", "v.feature", F.coalesce("v.x", F.lit(0.0)).alias("x"))
    bucket = F.when(F.col("x") > 0, F.ceil(F.log("x") / F.lit(float(np.log(gamma)))).cast("int")).alias("bucket")
    return each.groupBy("t_lang", "t_source", "feature", bucket).agg(F.count("*").alias("n"))


def quantiles(sketch: DataFrame, points: tuple[float, ...], accuracy: float = ACCURACY) -> DataFrame:
    """t_lang, t_source, feature and a column q<i> for each point: the value of the bucket that holds the quantile."""
    gamma = (1 + accuracy) / (1 - accuracy)
    value = F.when(F.col("bucket").isNull(), 0.0).otherwise(2 * F.pow(F.lit(gamma), F.col("bucket")) / (gamma + 1))
    group = Window.partitionBy("t_lang", "t_source", "feature")
    upto = F.sum("n").over(group.orderBy(F.col("bucket").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    steps = sketch.select("t_lang", "t_source", "feature", value.alias("value"), upto.alias("upto"), F.sum("n").over(group).alias("total"))
    # least value whose rank reaches the point
    return steps.groupBy("t_lang", "t_source", "feature").agg(*[F.min(F.when(F.col("upto") > F.lit(p) * (F.col("total") - 1), F.col("value"))).alias(f"q{i}") for i, p in enumerate(points)])


def thresholds(measured: DataFrame, reach: float = 3.0, accuracy: float = ACCURACY) -> DataFrame:
    """One row per (lang, source): q1_, q3_ and wide_<feature> (quartiles, ``reach`` times the spread) from the sketches."""
    q = quantiles(sketches(measured, accuracy), (0.25, 0.75, 0.95), accuracy)
    cols = []
    for f, (_, side, _) in FEATURES.items():
        of = lambda c, f=f: F.max(F.when(F.col("feature") == f, F.col(c)))
        spread = of("q2") - of("q1") if side == "tail" else of("q1") - of("q0")
        cols += [of("q0").alias(f"q1_{f}"), of("q1").alias(f"q3_{f}"), (F.lit(reach) * spread).alias(f"wide_{f}")]
    return q.groupBy("t_lang", "t_source").agg(*cols)


def judge(docs: DataFrame, reach: float = 3.0, accuracy: float = ACCURACY) -> DataFrame:
    """Counts, base_failed and kept of every row of ``docs``."""
    m = stage_table(measure(docs), "quality-counts")
    t = thresholds(m, reach, accuracy)
    inside = F.lit(True)
    for f, (e, side, slack) in FEATURES.items():
        x, wide = F.expr(f"CAST({e} AS DOUBLE)"), F.greatest(F.col(f"wide_{f}"), F.expr(f"CAST({slack} AS DOUBLE)"))
        inside = inside & (x <= F.col(f"q3_{f}") + wide)
        if side == "both":
            inside = inside & (x >= F.col(f"q1_{f}") - wide)
    joined = m.join(t, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left")
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.when(F.col("base_failed"), False).otherwise(F.coalesce(inside, F.lit(False))).alias("kept"))
