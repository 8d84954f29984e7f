"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ._util import materialize


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """(node, component) for every node of edges; a component's name is its smallest node.

    Each round takes the least name among the neighbours, then jumps to the name of that
    name; rounds are cut off from one another by written tables.
    """
    both = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u <> v")
    both = materialize(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    names = materialize(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("u")).alias("name")).select("node", "name"), "names")
    while True:
        near = both.join(names.select(F.col("node").alias("v"), "name"), "v").groupBy(F.col("u").alias("node")).agg(F.min("name").alias("near"))
        step = names.join(near, "node").select("node", F.col("name").alias("was"), F.least("name", "near").alias("name"))
        jump = names.select(F.col("node").alias("name"), F.col("name").alias("next"))
        new = materialize(step.join(jump, "name").select("node", F.least("name", "next").alias("name"), "was"), "names")
        if not new.filter("name <> was").limit(1).count():
            return new.select("node", F.col("name").alias("component"))
        names = new.select("node", "name")
