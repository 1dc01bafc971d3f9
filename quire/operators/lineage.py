"""Cutting the lineage of a DataFrame in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast up to this size; beyond it Spark shuffles.
BROADCAST_BYTES = 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """A new folder, not made yet, below the one that spark.checkpoint.dir names.

    Only on a single machine, as in tests, a temporary folder does where that is unset.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master.startswith("local") and not sc.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quire-checkpoint-"))
    return f"{sc.getCheckpointDir()}/quire-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Runs df and continues from its copy in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Like cut(), but as a Parquet table, whose size Spark knows: for tables that are joined round after round."""
    path = shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, row_bytes: int = 64) -> DataFrame:
    """df marked for broadcast if its rows of about so many bytes, counted here, are at most BROADCAST_BYTES."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df
