"""The Spark session: settings that the queries rely on, and what Python workers need."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "tallyspark", **more: str) -> SparkSession:
    """A session with the library's settings; `more` has further ones, dots written as two underscores."""
    builder = SparkSession.builder.appName(name)
    for k, v in (SETTINGS | {k.replace("__", "."): v for k, v in more.items()}).items():
        builder = builder.config(k, v)
    return reachable(builder.getOrCreate())


def reachable(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver has it.

    That is enough on one machine and on clusters with a shared path; elsewhere the package is to be
    installed, or given by --py-files.
    """
    here, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    if here not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [here, env.get("PYTHONPATH", "")]))
    return spark
