"""Run folders: claimed by one writer, with a manifest, configurations, results and a table for each configuration.

Everything goes through Hadoop's file system interface, so a folder may be on any store that
Spark writes to.
"""

from __future__ import annotations

import json
import time
import uuid

import pyspark
from pyspark.sql import DataFrame, SparkSession, functions as F

FORMAT = 1


class Files:
    """Paths of one store, over Spark's own connection to it."""

    def __init__(self, spark: SparkSession, root: str):
        jvm = spark._jvm
        self._path, self._conf = jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
        self._fs = self._path(root).getFileSystem(self._conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        kind = jvm.org.apache.hadoop.fs.Options.Rename
        one = lambda x: (a := spark.sparkContext._gateway.new_array(kind, 1), a.__setitem__(0, x))[0]
        self._never, self._always = one(kind.NONE), one(kind.OVERWRITE)
        self._read = jvm.org.apache.hadoop.io.IOUtils
        self._bytes = jvm.java.io.ByteArrayOutputStream

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def names(self, path: str) -> list[str]:
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self._path(path))) if self.exists(path) else []

    def write(self, path: str, text: str) -> None:
        """The file appears whole or not at all; an older one is replaced."""
        part = f"{path}.{uuid.uuid4().hex}"
        out = self._fs.create(self._path(part), False)
        try:
            out.write(text.encode())
        finally:
            out.close()
        self._context.rename(self._path(part), self._path(path), self._always)

    def read(self, path: str) -> str:
        source, sink = self._fs.open(self._path(path)), self._bytes()
        self._read.copyBytes(source, sink, 4096, True)
        return bytes(sink.toByteArray()).decode()

    def claim(self, path: str, owner: str) -> bool:
        """Make the folder, if it isn't there; of several writers at once one succeeds.

        A folder that already holds its owner's file is renamed, which no store does onto a folder that holds something.
        """
        parent = self._path(path).getParent()
        self._fs.mkdirs(parent)
        own = f"{parent.toString()}/.claim-{uuid.uuid4().hex}"
        self.write(f"{own}/owner", owner)
        try:
            if self.exists(path):
                return False
            self._context.rename(self._path(own), self._path(path), self._never)
            return self.read(f"{path}/owner") == owner
        except Exception:  # another writer was first, or else the store is at fault
            if not self.exists(path):
                raise
            return False
        finally:
            self.delete(own)


class RunStore:
    """A run's folder: owner, manifest.json, configs/, results/ and artifacts/.

    A new run claims path, or path-002, path-003 and so on where that is taken; resume opens
    one that is there.  Results are written in batches, each a folder named by the caller: a
    batch that is written again, by a retried job or after a crash, takes its own place, so
    there is one row for each configuration.  Unfinished batches aren't seen.
    """

    def __init__(self, spark: SparkSession, path: str, resume: bool = False):
        self.spark, self.files = spark, Files(spark, path)
        if resume:
            if not self.files.exists(f"{path}/owner"):
                raise FileNotFoundError(f"there is no run at {path} to resume")
            self.path = path
            return
        owner, n = uuid.uuid4().hex, 1
        while not self.files.claim(at := path if n == 1 else f"{path}-{n:03}", owner):
            n += 1
        self.path = at

    def write_manifest(self, **fields) -> None:
        about = {"format": FORMAT, "created": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "spark": self.spark.version, "pyspark": pyspark.__version__}
        self.files.write(f"{self.path}/manifest.json", json.dumps(about | fields, default=str, indent=1))

    def manifest(self) -> dict:
        return json.loads(self.files.read(f"{self.path}/manifest.json"))

    def record_configs(self, configs: dict[str, dict], batch: str = "all") -> None:
        """Configurations by hash; values that JSON can't hold are kept as their text."""
        rows = [(h, json.dumps(c, default=repr, sort_keys=True)) for h, c in configs.items()]
        self.spark.createDataFrame(rows, "hash string, config string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/configs/{batch}")

    def record(self, rows: DataFrame, batch: str) -> None:
        """Results (hash, status, error, and measures of any names); a later batch of a hash wins."""
        measures = F.to_json(F.struct(*[c for c in rows.columns if c not in ("hash", "status", "error")]))
        own = rows.select("hash", "status", (F.col("error") if "error" in rows.columns else F.lit(None)).cast("string").alias("error"), measures.alias("measures"))
        own.withColumn("at", F.lit(time.time())).write.mode("overwrite").parquet(f"{self.path}/results/{batch}")

    def _batches(self, kind: str, schema: str) -> DataFrame:
        whole = [f"{self.path}/{kind}/{b}" for b in self.files.names(f"{self.path}/{kind}") if self.files.exists(f"{self.path}/{kind}/{b}/_SUCCESS")]
        return self.spark.read.schema(schema).parquet(*whole) if whole else self.spark.createDataFrame([], schema)

    def results(self) -> DataFrame:
        """(hash, status, error, measures), the last of each hash."""
        got = self._batches("results", "hash string, status string, error string, measures string, at double")
        return got.groupBy("hash").agg(F.max_by(F.struct("status", "error", "measures"), "at").alias("r")).select("hash", "r.*")

    def completed(self) -> DataFrame:
        """Hashes of which there is an ok."""
        return self.results().filter("status = 'ok'").select("hash")

    def rows(self, columns: str, axes: str = "", status: str | None = "ok") -> DataFrame:
        """(hash, status, error, the axes of the configuration and the measures asked for, as schema strings)."""
        configs = self._batches("configs", "hash string, config string").dropDuplicates(["hash"])
        got = self.results().join(configs, "hash", "left")
        if status is not None:
            got = got.filter(F.col("status") == status)
        own = [F.from_json("config", axes).alias("_c")] if axes else []
        got = got.select("hash", "status", "error", *own, F.from_json("measures", columns).alias("_m"))
        return got.select("hash", "status", "error", *(["_c.*"] if axes else []), "_m.*")

    def artifact_path(self, config: str) -> str:
        return f"{self.path}/artifacts/{config}"

    def save_artifact(self, config: str, table: DataFrame) -> None:
        table.write.mode("overwrite").parquet(self.artifact_path(config))

    def artifact(self, config: str) -> DataFrame:
        if not self.files.exists(f"{self.artifact_path(config)}/_SUCCESS"):
            raise FileNotFoundError(f"no table of {config} was stored")
        return self.spark.read.parquet(self.artifact_path(config))
