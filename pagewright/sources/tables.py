"""Table access and the shared folder for cut lineages."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder; timestamps without zone are read as they stand (they mean UTC)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder (``spark.checkpoint.dir``). Where it is unset, a local folder serves a session whose
    tasks all run on this machine; on a cluster that is an error, as executors could not read what others wrote."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not shared and not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="pagewright-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder once and go on from there; survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores where a table comes in fewer pieces than half of them, as small single files do; before
    costly work on each row. A table of more pieces is left as it is: nothing of any size is shuffled for this."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    pieces = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(cores) if 2 * pieces <= cores else df
