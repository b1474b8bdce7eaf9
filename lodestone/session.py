"""What a session needs before Python workers can run this package's functions."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it: an installed copy needs nothing else, a checkout must be in a folder that workers see."""
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    return spark
