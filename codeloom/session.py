"""Session settings and shipping of this package to Python workers."""

from __future__ import annotations

from pyspark.sql import SparkSession


def reachable(spark: SparkSession, folder: str) -> None:
    """Puts the folder on the path of Python workers that are started from here on. On a cluster whose machines do not
    share it, submit the package with ``--py-files`` instead; the setting then has no effect."""
    environment = spark.sparkContext.environment
    path = environment.get("PYTHONPATH", "")
    if folder not in path.split(":"):
        environment["PYTHONPATH"] = f"{path}:{folder}".strip(":")
