"""Session defaults and the two things every iterative job needs: a checkpoint
folder that survives executor loss, and a shuffle width that fits the cluster."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str | int = "*", app: str = "cuespan", **conf) -> SparkSession:
    """A local session for tests and benches; a cluster brings its own."""
    width = "8" if cpus == "*" else str(cpus)
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", width)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder named by the cluster.

    ``spark.checkpoint.dir`` wins; only a local master without one falls back to
    a fresh temporary folder, because that folder is not shared on a cluster.
    """
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _shared_folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table beside the checkpoints and read it back: packed, by
    columns, where a checkpoint keeps whole rows as they are in memory."""
    path = f"{_shared_folder(df.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *columns) -> DataFrame:
    """Shuffle into the session's full width before Python work.

    Adaptive execution sizes partitions by bytes; a few megabytes of text pairs
    can be minutes of comparison, so this width is fixed and not coalesced.
    """
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(width, *columns)
