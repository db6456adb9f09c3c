"""The session that the library, its tests and its bench use when the caller brings none, and steps that are written down."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, shuffle_partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """A local session; on a cluster, pass the cluster's own session to the operators instead."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("palaver")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def kept(df: DataFrame) -> DataFrame:
    """df, computed once and written to the folder that the session names in spark.checkpoint.dir: for small tables that several aggregates read.

    Where the session names none, a local folder if Spark runs on this machine alone, else an error.
    """
    sc = df.sparkSession.sparkContext
    if not df.sparkSession.conf.get("spark.checkpoint.dir", None) and sc.getCheckpointDir() is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="palaver-checkpoint-"))
    return df.checkpoint()
