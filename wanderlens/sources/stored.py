"""Intermediate tables written once and read back.

A stored table cuts the lineage, is computed once however many branches use it, survives the loss
of executors, and has a size in files that Spark can choose joins by. It lives under the folder
that the cluster names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_FOLDER = "spark.checkpoint.dir"
_made: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. A local session without one gets a folder in its warehouse."""
    context = spark.sparkContext
    named = context.getConf().get(_FOLDER) or context.getCheckpointDir()
    if not named and context.master.startswith("local["):
        context.setCheckpointDir(spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints")
        named = context.getCheckpointDir()
    if not named:
        raise ValueError(f"{_FOLDER} must name a folder that all executors share")
    return named.rstrip("/")


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written as Parquet under a fresh name, and read back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession, since: int = 0) -> int:
    """Delete the tables that this process has stored (after the first ``since``), by their exact paths."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    dropped = 0
    while len(_made) > since:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_made.pop())
        dropped += path.getFileSystem(hadoop).delete(path, True)
    return dropped


def stored_alone(spark: SparkSession, make: Callable[[], DataFrame], name: str, since: int | None = None) -> DataFrame:
    """``make()`` stored, and what was stored on the way to it (or after the first ``since`` tables) deleted.

    The result is read from its own files, so nothing needs the others once it is written.
    """
    mark = len(_made) if since is None else since
    found = stored(make(), name)
    own = _made.pop()
    drop_stored(spark, mark)
    _made.append(own)
    return found


def n_stored() -> int:
    """How many tables this process has stored and not deleted."""
    return len(_made)
