"""Session settings and lineage cutting shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def get_spark(app: str = "hitloom", master: str | None = None, shuffle_partitions: int = 8) -> SparkSession:
    """A session for local work. On a cluster, pass a session of your own to the operators instead."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    return (
        b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (tests, bench) is a local folder set; on a cluster a folder of
    one machine would be lost with it, so it is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + os.path.join(tempfile.gettempdir(), f"hitloom-checkpoints-{os.getuid()}")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the written copy.

    The copy survives the loss of any executor, unlike a local checkpoint.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Written:
    """``df`` written to the shared checkpoint folder and read back, with aggregates over its rows that were taken on the way.

    For loops that outgrow their inputs: a table that is no longer needed can be dropped, so that the disk in use doesn't
    grow with the number of rounds.
    """

    def __init__(self, df: DataFrame, **aggregates: Column):
        spark = df.sparkSession
        self.path = f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"
        seen = Observation() if aggregates else None
        out = df.observe(seen, *[c.alias(k) for k, c in aggregates.items()]) if seen else df
        out.write.parquet(self.path)
        self.metrics = seen.get if seen else {}
        self.df = spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        path = self.df.sparkSession._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, if its input has fewer than half as many partitions.

    For work in Python over small inputs; inputs of any size have more splits than there are cores and stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores // 2 else df
