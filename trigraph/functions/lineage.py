"""Shared-folder checkpoints: lineage is cut only through storage every executor can read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from trigraph.functions.files import Files


def checkpoint_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a session on one machine (tests) may lack that setting and gets a folder of its own. What is below is
    temporary: it is removed when the application ends.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="trigraph-checkpoint-"))
    mine = sc._jsc.sc().getCheckpointDir().get()
    Files(spark).delete_at_end(mine)
    return mine


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and stored reliably; later plans start from the stored copy."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_round(df: DataFrame) -> DataFrame:
    """As ``cut``, for the rounds of a loop: the stored copy doesn't carry on the planner's estimate of its size.

    An estimate of joined rows is the product of both sides' estimates. From round to round its digits would double,
    until the number alone fills the driver's memory.
    """
    spark, stored = df.sparkSession, cut(df)
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(stored._jdf.queryExecution().toRdd(), stored._jdf.schema(), False), spark)


def stored_rows(df: DataFrame) -> int:
    """Rows of a DataFrame that ``cut`` returned, counted from its stored copy without planning a query."""
    return df._jdf.queryExecution().toRdd().count()


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for a written table."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
