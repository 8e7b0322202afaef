"""Session for tests, bench and command-line runs. A cluster brings its own settings."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, app: str = "wanderlens", folder: str | None = None) -> SparkSession:
    """``folder`` keeps stored tables; by default one below the working directory's warehouse."""
    folder = folder or os.path.join(os.getcwd(), "spark-warehouse", "checkpoints")
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", f"file://{folder}")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
