"""Markdown lines to sections and chunks, with pages, heading paths and stable ids."""

from __future__ import annotations

from itertools import groupby

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataframe.functions import text as X

MAX_CHARS, MIN_CHARS = 4000, 250
PAGE = r"^\s*<!-- PAGE (\d+) -->\s*$"


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, line: one row a line."""
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))


def carry_pages(df: DataFrame, key: str) -> DataFrame:
    """The page each line is on: the last page mark at or above it."""
    page = F.nullif(F.regexp_extract("line", PAGE, 1), F.lit("")).cast("int")
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("page", F.last(page, ignorenulls=True).over(w))


def sections(df: DataFrame, key: str) -> DataFrame:
    """Number the islands that begin at headings; text before the first is section 0."""
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("level", X.heading_level(F.col("line"))).withColumn("section", F.sum(F.when(F.col("level").isNotNull(), 1).otherwise(0)).over(w))


def heading_paths(df: DataFrame, key: str) -> DataFrame:
    """Per heading line its path: a level counts while no shallower heading came after it."""
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    heads = df.withColumn("level", X.heading_level(F.col("line"))).filter("level IS NOT NULL").withColumn("title", X.heading_text(F.col("line")))
    for k in range(1, 7):
        own = F.when(F.col("level") == k, F.struct("pos", "title"))
        heads = heads.withColumn(f"__h{k}", F.last(own, ignorenulls=True).over(w))
    parts = []
    for k in range(1, 7):
        above = [F.coalesce(F.col(f"__h{j}.pos"), F.lit(-1)) for j in range(1, k)]
        newest = F.greatest(*above, F.lit(-1)) if above else F.lit(-1)
        parts.append(F.when((F.col(f"__h{k}.pos") > newest) & (F.col("level") >= k), F.col(f"__h{k}.title")))
    return heads.withColumn("path", F.array_compact(F.array(*parts))).drop(*[f"__h{k}" for k in range(1, 7)])


def section_texts(df: DataFrame, key: str) -> DataFrame:
    """key, section, heading, body, page_start, page_end from lines with sections and pages."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("level").isNull() & ~F.rlike("line", F.lit(PAGE)), F.struct("pos", "line")))), lambda x: x["line"]), "\n")
    head = F.coalesce(F.min(F.when(F.col("level").isNotNull(), X.heading_text(F.col("line")))), F.lit("Preamble"))
    filled = F.trim("line") != ""
    return df.groupBy(key, "section").agg(head.alias("heading"), F.trim(body).alias("body"), F.min_by("page", "pos").alias("page_start"), F.max(F.when(filled, F.col("page"))).alias("page_end"))


def merged_sections(df: DataFrame, key: str, least: int = MIN_CHARS, most: int = MAX_CHARS) -> DataFrame:
    """key, piece, heading, body: one pass over a document's sections in order.

    A section of a heading alone joins the next one and takes its heading; one
    under ``least`` characters joins the next when both fit ``most`` and keeps
    its own heading. Both are used up by that.

    So a short section stays open unless the open one before it takes it in: in
    a run of short ones that fit, every other one is open, beginning with the
    last that can't be taken in. Windows tell that without a fold.
    """
    w = Window.partitionBy(key).orderBy("section", "heading", "body")
    rows = df.select(key, "section", "heading", F.coalesce("body", F.lit("")).alias("body")).withColumn("__n", F.length("body")).withColumn("__at", F.row_number().over(w))
    before = F.lag("__n").over(w)
    rows = rows.withColumn("__before", before).withColumn("__fits", F.coalesce((before == 0) | (before + F.col("__n") <= most), F.lit(False)))
    short = F.col("__n") < least
    first = F.last(F.when(~(short & F.col("__fits")), F.col("__at") + F.when(short, 0).otherwise(1)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("__open", (F.col("__at") - first) % 2 == 0)
    rows = rows.withColumn("__joins", F.coalesce(F.lag("__open").over(w), F.lit(False)) & F.col("__fits"))
    alone = F.col("__before") == 0
    heading = F.when(F.col("__joins") & ~alone, F.lag("heading").over(w)).otherwise(F.col("heading"))
    body = F.when(F.col("__joins"), F.concat_ws("\n", F.when(alone, F.lag("heading").over(w)).otherwise(F.lag("body").over(w)), "body")).otherwise(F.col("body"))
    piece = F.col("__at") - 1 - F.count_if("__joins").over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = rows.select(key, piece.cast("int").alias("piece"), heading.alias("heading"), body.alias("body"), F.coalesce(F.lead("__joins").over(w), F.lit(False)).alias("__gone"))
    return out.filter("NOT __gone").drop("__gone")


def merge_sections(df: DataFrame, key: str, least: int = MIN_CHARS, most: int = MAX_CHARS) -> DataFrame:
    """key, sections: ``merged_sections``, one row a document."""
    parts = F.array_sort(F.collect_list(F.struct("piece", "heading", "body")))
    return merged_sections(df, key, least, most).groupBy(key).agg(F.transform(parts, lambda s: F.struct(s["heading"].alias("heading"), s["body"].alias("body"))).alias("sections"))


def _is_table(line: str) -> bool:
    t = line.strip()
    return t.startswith("|") and t.endswith("|")


def _packed(text: str, most: int) -> list[str]:
    if len(text) <= most:
        return [text]
    out, held, size = [], [], 0

    def close() -> None:
        nonlocal held, size
        body = "\n".join(held).strip()
        if body:
            out.append(body)
        held, size = [], 0

    for table, run in groupby(text.splitlines(), _is_table):
        rows = list(run)
        if not table:
            for line in rows:
                if held and size + len(line) + 1 > most:
                    close()
                held.append(line)
                size += len(line) + 1
            continue
        whole = len("\n".join(rows))
        if size + whole > most:
            close()
        if whole <= most:
            held += rows
            size += whole
        elif len(rows) < 3:
            out.append("\n".join(rows))
        else:  # every piece begins with the header row and its separator
            head, piece = rows[:2], []
            base = used = len("\n".join(head))
            for row in rows[2:]:
                if piece and used + len(row) + 1 > most:
                    out.append("\n".join(head + piece))
                    piece, used = [], base
                piece.append(row)
                used += len(row) + 1
            out.append("\n".join(head + piece))
    close()
    return out


def pack_lines(text: Column, most: int = MAX_CHARS) -> Column:
    """array<string>: a text over ``most`` characters as pieces of whole lines, packed greedily.

    A run of table rows stays in one piece where it fits; a longer table is cut
    between rows and repeats its header and separator in every piece. A longer
    line stays whole. Sequential in a text, so it runs in Python, in time linear
    in the text; NULL stays NULL. Rows come 100 at a time: an Arrow batch holds
    10,000 of them however long their texts are, and their pieces beside them.
    """

    return F.udf(lambda t: None if t is None else _packed(t, most), "array<string>", useArrow=False)(text)


def with_chunk_ids(df: DataFrame, doc: str, section: str, content: str, pos: str) -> DataFrame:
    """Deterministic ids; the n-th repeat of a chunk gets the suffix _n."""
    raw = X.chunk_id(F.col(doc).cast("string"), F.col(section).cast("string"), F.col(content), F.lit(0))
    df = df.withColumn("__raw", raw)
    nth = F.row_number().over(Window.partitionBy("__raw").orderBy(pos)) - 1
    return df.withColumn("occurrence", nth).withColumn("chunk_id", F.concat("__raw", F.when(F.col("occurrence") > 0, F.concat(F.lit("_"), F.col("occurrence").cast("string"))).otherwise(""))).drop("__raw")


def token_coverage(original: Column, structured: Column) -> Column:
    """Share of the distinct original tokens that the structured text still has; 1 for none."""
    both = F.struct(F.array_distinct(X.tokens(original)).alias("a"), X.tokens(structured).alias("b"))
    return X.let(both, lambda x: F.when(F.size(x["a"]) == 0, 1.0).otherwise(F.bround(F.size(F.array_intersect(x["a"], x["b"])) / F.size(x["a"]), 6)))


def provenance_report(df: DataFrame, **fields: Column) -> DataFrame:
    """total, and for each named condition its count and percentage."""
    total = F.count("*")
    cols = []
    for name, cond in fields.items():
        n = F.count_if(cond)
        cols += [n.alias(name), F.when(total > 0, F.bround(n * 100.0 / total, 1)).otherwise(0.0).alias(f"{name}_pct")]
    return df.agg(total.alias("total"), *cols)


def problems(checks: dict[str, Column]) -> Column:
    """array<string> of the names of failed checks."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))


def write_gate(df: DataFrame, checks: dict[str, Column], strict: bool) -> tuple[DataFrame, DataFrame]:
    """Rows to write and rows refused; strict lets nothing through when any row is refused."""
    seen = df.withColumn("problems", problems(checks))
    bad = seen.filter(F.size("problems") > 0)
    good = seen.filter(F.size("problems") == 0).drop("problems")
    if strict:
        good = good.join(bad.agg(F.count("*").alias("__bad")).filter("__bad > 0"), how="left_anti")
    return good, bad


def index_state(df: DataFrame, version: str, version_col: str, valid: Column, readable: Column | None = None) -> DataFrame:
    """One row: rows, mismatches, violations and the state of an index.

    ``readable``: whether a row's metadata could be read. Rows of which none
    could are a corrupt index; violations count in rows of this version alone.
    """
    seen = F.lit(True) if readable is None else F.coalesce(readable, F.lit(False))
    same = F.col(version_col).eqNullSafe(F.lit(version))
    counts = df.agg(F.count("*").alias("n"), F.count_if(seen & ~same).alias("mismatches"), F.count_if(seen & same & ~F.coalesce(valid, F.lit(False))).alias("violations"), F.count_if(seen).alias("__seen"))
    state = (
        F.when(F.col("n") == 0, "INDEX_EMPTY")
        .when(F.col("__seen") == 0, "INDEX_CORRUPT")
        .when(F.col("mismatches") > 0, "INDEX_SCHEMA_MISMATCH")
        .when(F.col("violations") > 0, "INDEX_CORRUPT")
        .otherwise("INDEX_READY")
    )
    return counts.withColumn("state", state).drop("__seen")


def index_state_at(spark, path: str, version: str, version_col: str, valid: Column, readable: Column | None = None) -> DataFrame:
    """``index_state`` of a stored index; INDEX_UNAVAILABLE, with NULL counts, where it cannot be opened."""
    try:
        stored = spark.read.parquet(path)
    except AnalysisException:
        return spark.createDataFrame([(None, None, None, "INDEX_UNAVAILABLE")], "n long, mismatches long, violations long, state string")
    return index_state(stored, version, version_col, valid, readable)


def parents(df: DataFrame, key: str, pos: str, level: str, deepest: int) -> DataFrame:
    """The parent of each heading: the last earlier one of a shallower level. One window pass, no self-join."""
    w = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    last = [F.max(F.when(F.col(level) == k, F.col(pos))).over(w) for k in range(1, deepest)]
    parent = F.array_max(F.array_compact(F.array(*[F.when(F.col(level) > k + 1, c) for k, c in enumerate(last)])))
    return df.withColumn("parent", parent)


def blocks(df: DataFrame, key: str, fallback: bool = True) -> DataFrame:
    """key, block, kind (heading, table or paragraph), level, text of runs of like lines.

    Blank lines and changes of kind end a block, and every heading is one of
    its own; with ``fallback`` lines that look like headings count as such.
    """
    line = F.col("line")
    marked = X.heading_level(line)
    guessed = F.when(X.heading_candidate(line), F.coalesce(X.clause_level(X.clause_number(line)), F.lit(1))) if fallback else F.lit(None).cast("int")
    kind = F.when(F.trim(line) == "", "blank").when(marked.isNotNull(), "heading").when(X.is_table_line(line), "table").when(guessed.isNotNull(), "heading").otherwise("paragraph")
    w = Window.partitionBy(key).orderBy("pos")
    typed = df.withColumn("kind", kind).withColumn("level", F.when(F.col("kind") == "heading", F.coalesce(marked, guessed)))
    begins = (F.col("kind") == "heading") | ~F.col("kind").eqNullSafe(F.lag("kind").over(w))
    numbered = typed.withColumn("block", F.sum(F.when(begins, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("kind <> 'blank'")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    return numbered.groupBy(key, "block").agg(F.first("kind").alias("kind"), F.max("level").alias("level"), body.alias("text"))


def with_semantics(df: DataFrame, key: str, decisions: DataFrame | None = None) -> DataFrame:
    """Blocks with semantic_type (heading or content), semantic_level, semantic_confidence and semantic_source; texts stay as they are.

    ``decisions`` (key, block, semantic_type, level, confidence) come from a
    caller's model. Blocks without one fall back to the marks: headings are
    headings, paragraphs of one line that look like one are headings of
    confidence .60, all else is content. Tables are content whatever is said.
    """
    one_line = ~F.contains("text", F.lit("\n"))
    guess = (F.col("kind") == "paragraph") & one_line & X.heading_candidate(F.col("text"))
    own_type = F.when((F.col("kind") == "heading") | guess, "heading").otherwise("content")
    own_level = F.when(F.col("kind") == "heading", F.coalesce(F.col("level"), F.lit(1))).when(guess, F.coalesce(X.clause_level(X.clause_number(F.col("text"))), F.lit(1)))
    said = df
    if decisions is None:
        said = df.withColumn("__t", F.lit(None).cast("string")).withColumn("__l", F.lit(None).cast("int")).withColumn("__c", F.lit(None).cast("double"))
    else:
        d = decisions.select(F.col(key).alias("__k"), F.col("block").alias("__b"), F.col("semantic_type").alias("__t"), F.col("level").cast("int").alias("__l"), F.col("confidence").cast("double").alias("__c"))
        said = df.join(d, (F.col(key) == F.col("__k")) & (F.col("block") == F.col("__b")), "left").drop("__k", "__b")
    told = F.col("__t").isNotNull() & (F.col("kind") != "table")
    out = said.withColumn("semantic_type", F.when(F.col("kind") == "table", "content").when(told, F.col("__t")).otherwise(own_type))
    out = out.withColumn("semantic_level", F.when(F.col("semantic_type") == "heading", F.when(told, F.col("__l")).otherwise(own_level)))
    out = out.withColumn("semantic_confidence", F.when(F.col("__t").isNotNull(), F.col("__c")).when(guess, 0.60).otherwise(1.0))
    return out.withColumn("semantic_source", F.when(F.col("__t").isNotNull(), "model").otherwise("rules")).drop("__t", "__l", "__c")


def render(df: DataFrame, key: str) -> DataFrame:
    """Blocks back to Markdown, headings marked by their level, which semantics may have set."""
    decided = "semantic_type" in df.columns
    heading = (F.col("semantic_type") == "heading") | (F.col("kind") == "heading") if decided else F.col("kind") == "heading"
    level = F.greatest(F.lit(1), F.least(F.coalesce("semantic_level", "level", F.lit(1)) if decided else F.coalesce("level", F.lit(1)), F.lit(6)))
    plain = F.trim(F.regexp_replace(F.trim("text"), r"^#+\s*", "")) if decided else X.heading_text(F.col("text"))
    shown = F.when(heading, F.concat(F.repeat(F.lit("#"), level.cast("int")), F.lit(" "), plain)).otherwise(F.col("text"))
    parts = F.transform(F.array_sort(F.collect_list(F.when(F.trim(shown) != "", F.struct("block", shown.alias("s"))))), lambda x: x["s"])
    return df.groupBy(key).agg(F.array_join(parts, "\n\n").alias("markdown"))


def block_metadata(df: DataFrame, key: str) -> DataFrame:
    """key, standard_number, document_title: the first numbered standard outside tables, and the first heading of eight characters that opens no annex or table."""
    number = F.nullif(F.regexp_extract("text", r"(?i)\bIS\s+\d+(?:\s*\([^)]+\))?\s*:\s*\d{4}\b", 0), F.lit(""))
    title = F.trim(F.regexp_replace(F.regexp_replace("text", r"^\s*#+\s*", ""), r"\s+", " "))
    is_title = (F.col("semantic_type") == "heading") & (F.length(title) >= 8) & ~F.rlike(title, F.lit(r"(?i)^(?:ANNEX|APPENDIX|TABLE)\b"))
    return df.groupBy(key).agg(
        F.min_by(number, F.when((F.col("kind") != "table") & number.isNotNull(), F.col("block"))).alias("standard_number"),
        F.min_by(title, F.when(is_title, F.col("block"))).alias("document_title"),
    )


def preservation(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """issue, entity_id: blocks that are missing, new or repeated after structuring."""
    b, a = before.select(F.col(key).alias("entity_id")), after.select(F.col(key).alias("entity_id"))
    repeated = a.groupBy("entity_id").agg(F.count("*").alias("n")).filter("n > 1")
    return (
        b.join(a, "entity_id", "left_anti").withColumn("issue", F.lit("missing"))
        .unionByName(a.join(b, "entity_id", "left_anti").withColumn("issue", F.lit("extra")))
        .unionByName(repeated.select("entity_id").withColumn("issue", F.lit("repeated")))
    )
