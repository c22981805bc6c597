"""Cutting a plan's lineage at a table in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a local master without that setting
    (tests) gets a temporary one."""
    sc, named = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def new_path(spark: SparkSession) -> str:
    """A path of its own in the shared folder, for files that are read again."""
    return f"{shared_folder(spark)}/files/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df, written as Parquet to the shared folder and read again. Unlike cut() it keeps no
    constraints of the plan, which double with each round of some loops."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


#: The most rows of a table that is broadcast; its rows are counted first.
BROADCAST_ROWS = 100_000


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if its rows are few; else as it is. Counts, so df should
    be cut or a scan."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df
