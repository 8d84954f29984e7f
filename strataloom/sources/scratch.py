"""Tables that cut lineage: written to the folder that all executors share, so that lost executors cost no more than a read."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a local run without one gets a folder, a cluster an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    if not (spark.conf.get("spark.master", "") + "[").startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    at = tempfile.mkdtemp(prefix="strataloom-")
    spark.conf.set("spark.checkpoint.dir", at)
    return at


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet and read back; the table goes when the session's JVM ends in good order."""
    spark = df.sparkSession
    at = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(at)


def released(spark: SparkSession) -> None:
    """Shuffle files of plans that nobody holds any more go; else they stay until the driver happens to collect garbage, and loops pile them up."""
    gc.collect()
    spark._jvm.System.gc()
