"""Run a streaming job to the end of the data that is there."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from cuespan.session import cut_lineage


def work_folder(spark: SparkSession) -> str:
    """A fresh folder below the cluster's shared checkpoint folder."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def drain(stream: DataFrame, folder: str, mode: str = "append") -> None:
    """Process what is there in one batch, added to ``folder/out``.

    ``availableNow`` would never end for jobs with processing-time time-outs: they
    always ask for one more batch.
    """
    def store(batch: DataFrame, batch_id: int) -> None:
        batch.selectExpr("*", f"{batch_id}L AS batch_id").write.mode("append").parquet(folder + "/out")

    query = (stream.writeStream.outputMode(mode).option("checkpointLocation", folder + "/state")
             .trigger(once=True).foreachBatch(store).start())
    query.awaitTermination()


def in_steps(spark: SparkSession, rows: DataFrame, parts: list[Column], job: Callable[[DataFrame], DataFrame],
             mode: str = "append") -> DataFrame:
    """Feed ``rows`` as a growing table, one part after the other, restarting the
    job from its checkpoint for each, and return all emitted rows."""
    folder = work_folder(spark)
    rows = cut_lineage(rows)
    for part in parts:
        rows.where(part).write.mode("append").parquet(folder + "/in")
        drain(job(spark.readStream.schema(rows.schema).parquet(folder + "/in")), folder, mode)
    return spark.read.parquet(folder + "/out")
