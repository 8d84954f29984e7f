"""Spanning forests and components of graphs of any size, as joins and least-edge aggregates.

Boruvka's rounds: every component takes its least edge, the components so joined become
one, edges inside a component go, and of parallel edges the least stays.  Before the rounds
a graph's edges are cut into a grid of blocks by their ends, and an edge that isn't in its
block's forest goes, as it can't be in the whole one.  As soon as what is left of a graph
fits a task, its forest is finished there.  Edges are ordered by weight and ends, so the
forest is the same however the work is cut.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.kernels import Union
from ..sources.scratch import written

#: Edges of one graph that a task takes.
TASK_EDGES = 1 << 19

_EDGE = ("o", "u", "v")


def _names(t: pa.Table) -> tuple[list, np.ndarray, np.ndarray]:
    """Distinct ends in order, and the places of the columns a and b among them."""
    both = pa.concat_arrays([t[c].combine_chunks() for c in ("a", "b")])
    coded = both.dictionary_encode()
    names = coded.dictionary.to_pylist()
    order = sorted(range(len(names)), key=names.__getitem__)
    rank = np.empty(len(names), int)
    rank[order] = np.arange(len(names))
    at = rank[coded.indices.to_numpy()]
    return [names[i] for i in order], at[: len(t)], at[len(t) :]


def _kruskal(t: pa.Table) -> tuple[pa.Table, list, list]:
    """The rows of t in its forest, its nodes, and the least node of each one's component."""
    t = t.sort_by([(c, "ascending") for c in _EDGE])
    names, a, b = _names(t)
    parts = Union(len(names))
    keep = [k for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())) if parts.join(x, y)]
    return t.take(pa.array(keep, pa.int64())), names, [names[parts.find(x)] for x in range(len(names))]


def _block_forests(live: DataFrame, task_edges: int) -> DataFrame:
    """live (bundle, a, b, o, u, v, n) without edges that the forest of their block leaves out; n: edges of the graph."""
    side = F.ceil(F.sqrt(F.col("n") / task_edges))
    x, y = (F.pmod(F.xxhash64(c), side) for c in ("a", "b"))
    columns, kinds = live.columns, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in live.schema.fields)
    return live.groupBy("bundle", F.least(x, y), F.greatest(x, y)).applyInArrow(lambda t: _kruskal(t)[0].select(columns), kinds)


def _parents(live: DataFrame) -> DataFrame:
    """(bundle, c, up, e): the least edge of each component and what it leads to; of two that chose one another the lesser stays."""
    ends = [live.select("bundle", F.col(x).alias("c"), F.struct(*_EDGE, F.col(y).alias("to")).alias("e")) for x, y in (("a", "b"), ("b", "a"))]
    least = ends[0].unionByName(ends[1]).groupBy("bundle", "c").agg(F.min("e").alias("e"))
    some = written(least.select("bundle", "c", F.col("e.to").alias("up"), "e"), "least")
    back = some.select("bundle", F.col("c").alias("up"), F.col("up").alias("_back"))
    top = (F.col("_back") == F.col("c")) & (F.col("c") < F.col("up"))
    return some.join(back, ["bundle", "up"]).select("bundle", "c", F.when(top, F.col("c")).otherwise(F.col("up")).alias("up"), "e")


def _tops(parents: DataFrame) -> DataFrame:
    """(bundle, c, up) with up followed to the end; each round doubles the steps."""
    now = written(parents.select("bundle", "c", "up"), "parents")
    while True:
        hop = now.select("bundle", F.col("c").alias("up"), F.col("up").alias("_next"))
        new = written(now.join(hop, ["bundle", "up"]).select("bundle", "c", F.col("_next").alias("up"), (F.col("_next") != F.col("up")).alias("_moved")), "parents")
        if not new.filter("_moved").limit(1).count():
            return new.drop("_moved")
        now = new.drop("_moved")


def _renamed(df: DataFrame, column: str, tops: DataFrame) -> DataFrame:
    """df with a column of components led on to their tops."""
    return df.join(tops.select("bundle", F.col("c").alias(column), F.col("up").alias("_up")), ["bundle", column]).withColumn(column, F.col("_up")).drop("_up")


def spanning_forest(edges: DataFrame, largest: bool = False, task_edges: int = TASK_EDGES) -> tuple[DataFrame, DataFrame]:
    """The minimum (or largest: maximum) spanning forests of undirected graphs (bundle, u, v, w), and their components.

    Returns (bundle, u, v, w), the forest's edges, and (bundle, node, name), for each node a
    node that names its component.  Ties go by (u, v).  Loops join nothing, edges of null or
    NaN weight don't count, but their ends are nodes; rows with a null end are left out.
    """
    own = edges.filter("u is not null and v is not null")
    o: Column = (-F.col("w") if largest else F.col("w")).cast("double")
    live = own.select("bundle", F.col("u").alias("a"), F.col("v").alias("b"), o.alias("o"), "u", "v").filter("a <> b and o is not null and not isnan(o)")
    live = written(live, "edges")
    parts = own.select("bundle", F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("name", F.col("node"))
    tree, first = None, True
    while True:
        size = live.groupBy("bundle").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > task_edges)
        large = written(size, "sizes")  # a row a graph that is too large for a task
        if not large.limit(1).count():
            break
        rest = live.join(large, "bundle", "left_anti")
        much = live.join(large, "bundle")
        if first:
            much, first = _block_forests(much, task_edges), False
        much = written(much.drop("n"), "edges")
        parents = written(_parents(much), "parents")
        taken = parents.select("bundle", F.col("e.u").alias("u"), F.col("e.v").alias("v"), F.col("e.o").alias("o")).distinct()
        tree = taken if tree is None else tree.unionByName(taken)
        tops = _tops(parents)
        much = _renamed(_renamed(much, "a", tops), "b", tops).filter("a <> b")
        much = much.groupBy("bundle", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min(F.struct(*_EDGE)).alias("e")).select("bundle", "a", "b", "e.*")
        live = written(rest.unionByName(much), "edges")
        held = parts.join(tops.select("bundle", F.col("c").alias("name"), F.col("up").alias("_up")), ["bundle", "name"], "left")
        parts = written(held.select("bundle", "node", F.coalesce("_up", "name").alias("name")), "parts")
    kind = {c: edges.schema[c].dataType.simpleString() for c in ("bundle", "u")}

    def finish(key, t):
        forest, names, tops = _kruskal(t)
        n = [len(forest), len(names)]
        pad = lambda x, k: x.combine_chunks().take(pa.array([*range(len(x)), *[None] * k], pa.int64()))
        node = t.schema.field("u").type
        return pa.table({
            "bundle": pa.array([key[0].as_py()] * sum(n), t.schema.field("bundle").type), **{c: pad(forest[c], n[1]) for c in _EDGE},
            "c": pa.array([None] * n[0] + names, node), "up": pa.array([None] * n[0] + tops, node),
        })

    done = written(live.groupBy("bundle").applyInArrow(finish, f"bundle {kind['bundle']}, o double, u {kind['u']}, v {kind['u']}, c {kind['u']}, up {kind['u']}"), "finished")
    last = done.filter("u is not null").select("bundle", "u", "v", "o")
    tree = last if tree is None else tree.unionByName(last)
    tops = done.filter("c is not null").select("bundle", F.col("c").alias("name"), F.col("up").alias("_up"))
    parts = parts.join(tops, ["bundle", "name"], "left").select("bundle", "node", F.coalesce("_up", "name").alias("name"))
    return tree.select("bundle", "u", "v", ((0.0 - F.col("o")) if largest else F.col("o")).alias("w")), parts


def components(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """(bundle, node, component) of graphs (bundle, u, v); a component's name is its least node."""
    parts = written(spanning_forest(edges.select("bundle", "u", "v", F.lit(0.0).alias("w")), task_edges=task_edges)[1], "parts")
    least = parts.groupBy("bundle", "name").agg(F.min("node").alias("component"))
    return parts.join(least, ["bundle", "name"]).select("bundle", "node", "component")
