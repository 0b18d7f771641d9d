"""Named queries over the driver tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (t) as a query; ``t("table")`` reads a table."""

    def keep(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over all cores: a table of short columns is one small file, thus one task, however long the texts are that a query renders from it."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism))


def load() -> None:
    """Import the modules that register queries."""
    from strataframe.plans import more, retrieval, rules, store, temporal, text  # noqa: F401
