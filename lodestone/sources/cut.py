"""Where checkpoints go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoints(spark: SparkSession) -> None:
    """Leaves the session's spark.checkpoint.dir alone; sets a temporary folder only where a local session has none, as in tests. A cluster must name one."""
    sc = spark.sparkContext
    if not (sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()):
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written as Parquet to the checkpoint folder and read back, for rows that many steps read a few columns of each. The write's shuffle files go when it ends."""
    spark, cleanup = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    ensure_checkpoints(spark)
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    path, before = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}", spark.conf.get(cleanup)
    spark.conf.set(cleanup, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(cleanup, before)
    return spark.read.schema(df.schema).parquet(path)
