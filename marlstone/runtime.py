"""Session helpers: the shared checkpoint folder, lineage cuts, table access."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the one the cluster names, else (only in local mode) an own one."""
    sc = spark.sparkContext
    now = sc._jsc.sc().getCheckpointDir()
    if now.isDefined():
        return now.get()
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="marlstone-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder and drop its lineage; survives the loss of executors.

    A checkpoint keeps the size and the constraints that were estimated for its
    plan. A join multiplies sizes, so in loops the number's digits double every
    round until planning takes longer than running; the rows are therefore
    taken up as a new relation, of unknown size.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    jdf = df.checkpoint(eager=True)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(jdf.queryExecution().toRdd(), jdf.schema(), False), spark)


def shuffled(df: DataFrame) -> DataFrame:
    """The side of a join that grows with the data: joined by shuffle and sort, whatever its size here, so that no round sends it to the driver."""
    return df.hint("merge")


def cores(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, os.cpu_count() or 1)
