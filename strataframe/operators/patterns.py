"""Many fixed strings searched in texts at once, by Aho-Corasick automata."""

from __future__ import annotations

from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of the strings of one automaton, which bounds a worker's memory, what is broadcast and what the driver holds at a time.
PART_CHARS = 400_000


def _search(key: str, held):
    def run(batches):
        automaton = ahocorasick.Automaton()
        for p in held.value:
            automaton.add_word(p, p)
        automaton.make_automaton()
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                rows, found = [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    if text:
                        hits = {p for _, p in automaton.iter(text)}
                        rows += [i] * len(hits)
                        found += hits
                yield pa.record_batch([part.column(0).take(pa.array(rows, pa.int64())), pa.array(found, pa.string())], names=[key, "pattern"])

    return run


def occurring(texts: DataFrame, key: str, text: str, patterns: DataFrame, pattern: str, part_chars: int = PART_CHARS) -> DataFrame:
    """key, pattern: the distinct strings of ``patterns`` that lie in each text, once a text.

    One linear pass over the texts for every part of ``part_chars`` characters
    of strings (a longer string is a part by itself); a part is an automaton
    that each task builds from a broadcast of that bounded size, so a text
    costs its length and its hits, whatever the number of strings. Null and
    empty strings occur nowhere; repeated ones count once.
    """
    spark = texts.sparkSession
    rows = patterns.select(F.col(pattern).cast("string").alias("p")).filter(F.length("p") > 0).distinct()
    asked = texts.select(key, F.col(text).cast("string").alias("__text"))
    schema = f"{key} {dict(asked.dtypes)[key]}, pattern string"
    part, size, passes = [], 0, []

    def one_pass() -> None:
        passes.append(asked.mapInArrow(_search(key, spark.sparkContext.broadcast(part)), schema))

    for (p,) in rows.toLocalIterator():
        if part and size + len(p) > part_chars:
            one_pass()
            part, size = [], 0
        part.append(p)
        size += len(p)
    if part:
        one_pass()
    return reduce(DataFrame.unionByName, passes) if passes else spark.createDataFrame([], schema)
