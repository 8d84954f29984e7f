"""Studies: the results of a sweep over the clouds of a population, with what each came from."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import layers as ly, mapper as mp
from ..sources.runs import RunStore
from . import sweep as sw
from .grid import AXES, MapperGrid

#: Axes and measures of a study's rows.
AXIS_COLUMNS = "cloud string, lens string, n_intervals int, overlap double, clusterer string"
MEASURE_COLUMNS = "n_nodes long, n_edges long, node_median double, node_ratio double, b0 long, b1 long, b1_excess long"


class Study:
    """A stored study: rows of results, and from a row's hash its graph, its cloud, and the members behind it.

    members: (member_id, and whatever is known of them: seed, accuracy ...); weights: theirs
    (member_id, layer_idx, i, j, w).  A cloud is named layer/view; its points are numbered by
    member and neuron.
    """

    def __init__(self, store: RunStore, members: DataFrame, weights: DataFrame, normalise: str | None = None):
        self.store, self.members, self.weights, self.normalise = store, members, weights, normalise

    # Clouds of the population

    def _points(self, cloud: str) -> DataFrame:
        layer, _, view = cloud.partition("/")
        return ly.population_cloud(self.weights.filter(F.col("layer_idx") == int(layer)), view, self.normalise)

    def cloud(self, cloud: str) -> DataFrame:
        """(id, x) of a named cloud."""
        points = self._points(cloud)
        return points.join(ly.member_index(points).select("id", "member_id", "n"), ["member_id", "n"]).select("id", "x")

    def labels(self, cloud: str) -> DataFrame:
        """(id, n, and the columns of members) of a named cloud: the member behind each point."""
        return ly.member_index(self._points(cloud)).select("id", "member_id", "n").join(self.members, "member_id")

    # Running

    def run(self, clouds: list[str], axes: dict[str, object], batch: str = "all", save_graphs: bool = True) -> None:
        """Sweep the Mapper settings over the clouds; finished configurations of an earlier run are left alone.  Graphs are stored by hash."""
        spark = self.store.spark
        done = {r["hash"] for r in self.store.completed().collect()}  # a row a configuration
        grid = MapperGrid({c: self.cloud(c) for c in clouds}, axes)
        checked = grid.checked()
        self.store.record_configs({h: {k: v for k, v in c.items() if v is not None} for h, c, _ in checked}, batch)
        self.store.write_manifest(axes=grid.axes, clouds=clouds, configurations=len(checked))
        got = grid.run(spark, done).filter("status <> 'done'").drop("config", "ordinal")
        self.store.record(got, batch)
        if save_graphs:
            nodes, _, _ = grid.graphs(done)
            if nodes is not None:
                nodes.write.mode("overwrite").partitionBy("hash").parquet(f"{self.store.path}/graphs/{batch}")

    # Looking up

    def rows(self, status: str | None = "ok") -> DataFrame:
        """(hash, status, error, axes, measures), by default of what ran."""
        return self.store.rows(MEASURE_COLUMNS, AXIS_COLUMNS, status)

    def leading(self, measure: str = "b1_excess", top: int = 10, median: float = 5.0, most_ratio: float | None = None) -> DataFrame:
        return sw.leading(self.rows(), measure, top, median, most_ratio)

    def plateaus(self, measures: tuple[str, ...] = ("b0", "b1", "b1_excess"), least: int = 3) -> DataFrame:
        return sw.plateaus(self.rows(), list(measures), ["cloud", "lens", "n_intervals", "overlap", "clusterer"], least)

    def config(self, hash_: str) -> dict:
        """The stored configuration of a hash."""
        row = self.store._batches("configs", "hash string, config string").filter(F.col("hash") == hash_).first()
        if row is None:
            raise KeyError(f"no configuration has the hash {hash_}")
        return AXES | json.loads(row["config"])

    def graph(self, hash_: str) -> tuple[DataFrame, DataFrame]:
        """(memberships (cell, label, id), edges (u, v, w)) of a configuration; only its own folder is read."""
        for batch in reversed(self.store.files.names(f"{self.store.path}/graphs")):
            at = f"{self.store.path}/graphs/{batch}"
            if self.store.files.exists(f"{at}/hash={hash_}"):
                members = self.store.spark.read.parquet(f"{at}/hash={hash_}")
                return members, mp.node_graph(members)
        raise FileNotFoundError(f"no graph of {hash_} was stored; was the study run without graphs?")

    def cloud_of(self, hash_: str) -> DataFrame:
        return self.cloud(self.config(hash_)["cloud"])

    def labels_of(self, hash_: str) -> DataFrame:
        return self.labels(self.config(hash_)["cloud"])

    def members_of(self, hash_: str) -> DataFrame:
        """(cell, label, n_points, n_members, member_ids, and the mean of each number known of the members) of a configuration's nodes."""
        numbers = [f.name for f in self.members.schema.fields if f.dataType.typeName() in ("double", "float", "long", "integer") and f.name != "member_id"]
        own = self.graph(hash_)[0].filter("label >= 0").join(self.labels_of(hash_), "id")
        means = [F.avg(c).alias(f"mean_{c}") for c in numbers]
        return own.groupBy("cell", "label").agg(F.count(F.lit(1)).alias("n_points"), F.count_distinct("member_id").alias("n_members"), F.array_sort(F.collect_set("member_id")).alias("member_ids"), *means)


def open_study(spark: SparkSession, path: str, members: DataFrame, weights: DataFrame, normalise: str | None = None) -> Study:
    return Study(RunStore(spark, path, resume=True), members, weights, normalise)
