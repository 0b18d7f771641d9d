"""Files: document texts, chunk envelopes, registries, audit logs, staged publishing and release manifests."""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = T.StructType([T.StructField("chunk_id", T.StringType()), T.StructField("content", T.StringType()), T.StructField("metadata", T.MapType(T.StringType(), T.StringType()))])
ENVELOPE = T.StructType([T.StructField("document_id", T.StringType()), T.StructField("source_file", T.StringType()), T.StructField("total_chunks", T.LongType()), T.StructField("chunks", T.ArrayType(CHUNK))])
RECORD = "source_id string, organization string, canonical_url string, source_type string, authority string, jurisdiction string, document_types array<string>, crawl_frequency string, enabled boolean"
# Enumerations of the registry; the first of each stands for unknown ones.
SOURCE_TYPES = ("OFFICIAL_PORTAL", "GAZETTE", "STANDARDS_BODY", "MINISTRY_PORTAL", "REGULATOR_PORTAL", "LABORATORY_REGISTRY")
FREQUENCIES = ("DAILY", "WEEKLY", "BIWEEKLY", "MONTHLY", "MANUAL")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text: one row a file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_pages(spark: SparkSession, path: str, extract, pattern: str = "*") -> DataFrame:
    """path, page, text, problem of binary files by a caller's function (bytes -> list of page texts).

    A file that the function refuses, or that has no text at all, is one row
    with a problem; nothing is dropped. One Arrow batch holds few files, so
    memory is bounded by the largest.
    """
    done = T.ArrayType(T.StructType([T.StructField("page", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("problem", T.StringType())]))

    @F.pandas_udf(done)
    def pages(col: pd.Series) -> pd.Series:
        out = []
        for body in col:
            try:
                texts = list(extract(bytes(body)))
                problem = None if any((t or "").strip() for t in texts) else "empty"
            except Exception as e:  # noqa: BLE001  the caller's function may raise anything
                texts, problem = [], f"{type(e).__name__}: {e}"
            out.append([{"page": None, "text": None, "problem": problem}] if problem else [{"page": i + 1, "text": t, "problem": None} for i, t in enumerate(texts)])
        return pd.Series(out)

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.explode(pages("content")).alias("p")).select("path", "p.*")


def pages_to_markdown(pages: DataFrame, key: str, page: str, text: str) -> DataFrame:
    """One Markdown text per document with a mark before each page."""
    marked = F.concat(F.lit("<!-- PAGE "), F.col(page).cast("string"), F.lit(" -->\n"), F.coalesce(F.col(text), F.lit("")))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), marked.alias("m"))))
    return pages.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["m"]), "\n\n").alias("markdown"))


def to_envelopes(chunks: DataFrame, doc: str, source: str, order: str) -> DataFrame:
    """document_id, source_file, total_chunks, chunks of each document; chunk_id, content and metadata are columns."""
    items = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "chunk_id", "content", F.map_entries("metadata").alias("m")))), lambda c: F.struct(c["chunk_id"].alias("chunk_id"), c["content"].alias("content"), F.map_from_entries(c["m"]).alias("metadata")))
    return chunks.groupBy(F.col(doc).cast("string").alias("document_id")).agg(F.min(source).alias("source_file"), F.count("*").alias("total_chunks"), items.alias("chunks"))


def from_envelopes(envelopes: DataFrame) -> DataFrame:
    """One row a chunk; an envelope without chunks gives none."""
    return envelopes.select("document_id", "source_file", F.explode("chunks").alias("c")).select("document_id", "source_file", "c.*")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return from_envelopes(spark.read.schema(ENVELOPE).json(path, multiLine=True))


def scan_corpus(df: DataFrame, content: str) -> DataFrame:
    return df.filter(F.trim(content) != "")


def read_cases(spark: SparkSession, path: str, schema) -> DataFrame:
    """A JSON array of evaluation cases."""
    return spark.read.schema(schema).json(path, multiLine=True)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Source records of a YAML or JSON list; unknown enumeration values become the first known one."""
    text = spark.read.text(path, wholetext=True).first()["value"]  # one small configuration file
    try:
        import yaml

        data = yaml.safe_load(text)
    except ImportError:
        data = json.loads(text)
    rows = data.get("sources", data) if isinstance(data, dict) else data
    names = [f.split()[0] for f in RECORD.split(", ")]
    df = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], RECORD)
    return with_known_enums(df)


def with_known_enums(df: DataFrame) -> DataFrame:
    known = lambda c, values: F.when(c.isin(*values), c).otherwise(F.lit(values[0]))
    return df.withColumn("source_type", known(F.col("source_type"), SOURCE_TYPES)).withColumn("crawl_frequency", known(F.col("crawl_frequency"), FREQUENCIES))


def append_log(entries: DataFrame, path: str) -> None:
    """Rows are only ever added."""
    entries.write.mode("append").parquet(path)


def download_outcome(status: Column, head: Column, host: Column, allowed: list[str]) -> Column:
    """State of a download: hosts off the list are never asked, 401 and 403 block, a body must begin like a PDF."""
    return (
        F.when(~host.isin(*allowed), "NOT_ALLOWED")
        .when(status.isin(401, 403), "BLOCKED")
        .when(status >= 500, "RETRY")
        .when(status != 200, "FAILED")
        .when(~F.startswith(head, F.lit("%PDF")), "NOT_A_PDF")
        .otherwise("DOWNLOADED")
    )


def retry_delay(attempt: Column) -> Column:
    return F.lit(1.5) * F.pow(F.lit(2.0), attempt)


def publish(df: DataFrame, path: str) -> None:
    """Build beside the live table, check, then swap by renames; the old table stays as a backup.

    Works on any file system Spark can write. Refuses an empty table; a failed
    swap puts the old table back.
    """
    spark = df.sparkSession
    staging, backup = f"{path}__staging", f"{path}__backup"
    df.write.mode("overwrite").parquet(staging)
    if spark.read.parquet(staging).isEmpty():
        raise ValueError("refusing to publish an empty table")
    hadoop = spark._jvm.org.apache.hadoop.fs
    of = lambda p: hadoop.Path(p)
    fs = of(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(of(backup)):
        fs.delete(of(backup), True)
    had = fs.exists(of(path))
    if had and not fs.rename(of(path), of(backup)):
        raise OSError("the live table can't be moved")
    if not fs.rename(of(staging), of(path)):
        if had:
            fs.rename(of(backup), of(path))
        raise OSError("the new table can't be moved in")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, length, sha256 of the files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def manifest(counts: DataFrame, rights: DataFrame, status: str) -> DataFrame:
    """One row of JSON: counts of all tables and of each rights status."""
    as_map = lambda df, k, v: df.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(k, v)))).alias("m"))
    a = as_map(counts, "table_name", "n").withColumnRenamed("m", "metrics")
    b = as_map(rights.groupBy(status).agg(F.count("*").alias("n")), status, "n").withColumnRenamed("m", "rights_summary")
    return a.join(b).select(F.to_json(F.struct("metrics", "rights_summary")).alias("manifest"))


def changed_files(recorded: DataFrame, now: DataFrame) -> DataFrame:
    """path and state of files that are missing, new or different from a manifest."""
    r = recorded.select(F.col("path").alias("r_path"), F.col("sha256").alias("r_sha"))
    both = r.join(now.select("path", "sha256"), F.col("r_path") == F.col("path"), "full")
    state = F.when(F.col("path").isNull(), "missing").when(F.col("r_path").isNull(), "new").when(F.col("r_sha") != F.col("sha256"), "changed")
    return both.select(F.coalesce("path", "r_path").alias("path"), state.alias("state")).filter("state IS NOT NULL")


#: Rows of a section that the driver takes.
MAX_REPORT_ROWS = 1000


def markdown_report(title: str, parts: dict[str, DataFrame]) -> str:
    """Small aggregate frames as Markdown tables; a larger one is an error, ``report_lines`` takes any size."""
    out = [f"# {title}"]
    for name, df in parts.items():
        rows = df.limit(MAX_REPORT_ROWS + 1).collect()
        if len(rows) > MAX_REPORT_ROWS:
            raise ValueError(f"section {name} has over {MAX_REPORT_ROWS} rows; use report_lines")
        out += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows]
    return "\n".join(out) + "\n"


def report_lines(parts: dict[str, DataFrame]) -> DataFrame:
    """section, line: the report's rows as text."""
    one = [df.select(F.lit(name).alias("section"), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]).alias("line")) for name, df in parts.items()]
    return reduce(DataFrame.unionAll, one)
