"""Session helpers."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession


def importable(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package where it isn't installed (local runs; on a cluster ship it with --py-files)."""
    env, home = spark.sparkContext.environment, str(Path(__file__).resolve().parent.parent)
    if home not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = f"{home}:{env['PYTHONPATH']}" if env.get("PYTHONPATH") else home
    return spark
