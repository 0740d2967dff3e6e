"""What operators need from the session: where to cut lineage, and how wide to go."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the cluster names; make a local one only where none is set (tests)."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", "") or context.getConf().get("spark.checkpoint.dir", "")
    if not shared and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="finstrata-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder and start a new lineage from the files.

    Reliable: the files outlive the executors that wrote them.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """A table of the folder. spread: for work that is long per row, see spread_out()."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread_out(df) if spread else df


def spread_out(df: DataFrame) -> DataFrame:
    """A scan that would leave half of the cores idle, because its file is a single row group, dealt to all of them.

    Tables of many files or row groups, thus all large ones, stay as they are: no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df
