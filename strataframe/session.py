"""Session set-up: what Python workers need to find this package, and where stored tables go."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ready(spark: SparkSession) -> SparkSession:
    """Put the package's folder on the Python workers' path and return ``spark``.

    On a cluster the package is installed or shipped with ``--py-files``; then
    this changes nothing that matters.
    """
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where
    it is unset, a temporary folder of a local master, else one of the warehouse."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if set_dir:
        return set_dir.rstrip("/")
    local = spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master
    made = tempfile.mkdtemp(prefix="strataframe-") if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_stored"
    spark.sparkContext.setCheckpointDir(made)
    return made
