"""Result stores: Parquet tables with a kind and version beside them, and append-only JSON results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

VERSION = 1


def save(df: DataFrame, path: str, kind: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(f"{path}/data")
    df.sparkSession.createDataFrame([(kind, VERSION)], "kind string, version int").coalesce(1).write.mode(mode).json(f"{path}/about")


def load(spark: SparkSession, path: str, kind: str) -> DataFrame:
    about = spark.read.schema("kind string, version int").json(f"{path}/about").first()
    if about["kind"] != kind or about["version"] > VERSION:
        raise ValueError(f"{path} holds {about['kind']} version {about['version']}, not {kind}")
    return spark.read.parquet(f"{path}/data")


def append_results(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def results(spark: SparkSession, path: str, schema: str, configs: DataFrame) -> DataFrame:
    """Configurations with their results; lines that were torn by a crash are ignored, the later result of a hash wins."""
    got = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).withColumn("_f", F.col("_metadata.file_modification_time"))
    last = got.groupBy("hash").agg(F.max_by(F.struct(*[c for c in got.columns if c not in ("hash", "_f")]), "_f").alias("r")).select("hash", "r.*")
    return configs.join(last, "hash", "left")


def snapshots(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Snapshots that a running training appends, as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def save_population(members: DataFrame, weights: DataFrame, path: str) -> None:
    """A population: members (member_id, seed, trained, ...) and their weights (member_id, layer_idx, i, j, w), which are laid out by layer."""
    save(members, f"{path}/members", "population members")
    weights.write.partitionBy("layer_idx").parquet(f"{path}/weights/data")
    weights.sparkSession.createDataFrame([("population weights", VERSION)], "kind string, version int").coalesce(1).write.json(f"{path}/weights/about")


def load_population(spark: SparkSession, path: str, layers: list[int] | None = None, trained: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """(members, weights) of a stored population; only the folders of the layers wanted are read, and only trained or untrained members if asked for."""
    members, weights = load(spark, f"{path}/members", "population members"), load(spark, f"{path}/weights", "population weights")
    if layers is not None:
        weights = weights.filter(F.col("layer_idx").isin(layers))
    if trained is not None:
        members = members.filter(F.col("trained") == trained)
        weights = weights.join(members.select("member_id"), "member_id", "left_semi")
    return members, weights
