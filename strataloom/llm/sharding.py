"""Shards of near-equal bytes for groups that must stay together.

Method: Karmarkar-Karp differencing.  Every item starts as a partial partition that holds
it in one part and nothing in the others; the two partial partitions of the largest spread
(largest part less smallest) are combined, the largest part of one with the smallest of
the other, until one is left.

Items are groups of equal texts.  A group of more than a BUNDLES-th of all bytes is an item
of its own (there are fewer than BUNDLES of these); all other groups are dealt by their hash
to BUNDLES bundles, whose sums are items.  So the differencing sees at most twice BUNDLES
items, at any size of the corpus, and a group is never split.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappushpop

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._util import lean, materialize
from .ranks import ranked

#: Bundles of small groups, and the bound on large ones.
BUNDLES = 1 << 15


def differencing(sizes: list[int], parts: int) -> list[int]:
    """Part (0 to parts - 1) of each size; ties go by place in the list."""
    n = len(sizes)
    if n < 2:
        return [0] * n
    every = range(parts)
    sums: dict[int, list[int]] = {}  # of partial partitions in the heap, largest part first
    heap = [(-s, i) for i, s in enumerate(sizes)]
    heapify(heap)
    merges = []
    low = [0] * (parts - 1)
    a = heappop(heap)[1]
    while heap:
        b = heappop(heap)[1]
        x, y = sums.pop(a, None) or [sizes[a], *low], sums.pop(b, None) or [sizes[b], *low]
        y.reverse()
        both = [p + q for p, q in zip(x, y)]
        order = sorted(every, key=both.__getitem__, reverse=True)
        node = n + len(merges)
        merges.append((a, b, order))
        sums[node] = both = [both[i] for i in order]
        a = heappushpop(heap, (both[-1] - both[0], node))[1] if heap else node
    at: dict[int, list[int]] = {a: list(every)}
    out = [0] * n
    for node in range(n + len(merges) - 1, n - 1, -1):
        a, b, order = merges[node - n]
        own = at.pop(node)
        left, right = [0] * parts, [0] * parts
        for place, i in zip(own, order):
            left[i] = right[parts - 1 - i] = place
        for child, places in ((a, left), (b, right)):
            if child < n:
                out[child] = places[0]
            else:
                at[child] = places
    return out


def _measured(docs: DataFrame) -> DataFrame:
    """docs with a column _item: h, size, crc of the text (null as empty)."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.withColumn("_item", F.struct(F.xxhash64(text).alias("h"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("crc")))


def _dealt(items: DataFrame, shards: int, bundles: int) -> tuple[DataFrame, DataFrame]:
    """Shards of large groups (h, size, crc, large) and of bundles (bundle, small), each of at most `bundles` rows; items: a row for each document."""
    most = int(items.agg(F.sum("size")).first()[0] or 0) // bundles
    groups = items.groupBy("h", "size", "crc").agg(F.sum("size").alias("bytes"))
    large = F.col("bytes") > most
    keys = [F.when(large, F.col(c)).alias(c) for c in ("h", "size", "crc")]
    few = groups.groupBy(*keys, F.when(~large, F.pmod("h", F.lit(bundles))).alias("bundle")).agg(F.sum("bytes").alias("bytes"))

    def divide(t: pa.Table) -> pa.Table:
        t = t.sort_by([("bytes", "descending"), *((c, "ascending") for c in ("bundle", "h", "size", "crc"))])
        return t.append_column("shard", pa.array(differencing(t["bytes"].to_pylist(), shards), pa.int32()))

    kinds = "h long, size long, crc long, bundle long, bytes long, shard int"
    done = materialize(few.groupBy().applyInArrow(lean(divide), kinds), "shards")
    return (
        done.filter("bundle is null").select(F.col("h").alias("_h"), F.col("size").alias("_size"), F.col("crc").alias("_crc"), F.col("shard").alias("_large")),
        done.filter("bundle is not null").select(F.col("bundle").alias("_bundle"), F.col("shard").alias("_small")),
    )


def _placed(df: DataFrame, h, size, crc, shards: tuple[DataFrame, DataFrame], bundles: int) -> DataFrame:
    """df with the shard of each row as _shard; both tables are bounded by `bundles` rows, so they are broadcast."""
    large, small = shards
    out = df.join(F.broadcast(large), (h == F.col("_h")) & (size == F.col("_size")) & (crc == F.col("_crc")), "left")
    out = out.join(F.broadcast(small), F.pmod(h, F.lit(bundles)) == F.col("_bundle"), "left")
    return out.withColumn("_shard", F.coalesce("_large", "_small")).drop("_h", "_size", "_crc", "_large", "_bundle", "_small")


def assign_shards(docs: DataFrame, shards: int = 8, bundles: int = BUNDLES) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, size, text_crc32, law, shard, slot, grown_shard.

    law: `bytes`.  size: UTF-8 bytes of the text and one more.  Rows of equal texts share a
    shard; null texts are empty ones, so null and empty texts are one group.  slot: place in
    the shard, without gaps from 0, by doc_id (null first) and text; rows equal in both are
    placed arbitrarily.  grown_shard: null, as a further shard would move rows under this law.
    A group of more than a shard's share leaves the shards as unequal as it must.  An empty
    table gives an empty result; extra columns are ignored.
    """
    items = materialize(_measured(docs.select("doc_id", "text")).select("doc_id", "_item.*"), "items")
    rows = _placed(items, F.col("h"), F.col("size"), F.col("crc"), _dealt(items, shards, bundles), bundles)
    rows = materialize(rows.select("doc_id", "size", "crc", "h", F.col("_shard").alias("shard")), "placed")
    return ranked(rows, ["shard"], ["doc_id", "h", "size", "crc"]).select(
        "doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", F.col("pos").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(docs: DataFrame, at: str, shards: int = 8, files: int = 8, name: str = "shard", bundles: int = BUNDLES) -> None:
    """Write docs, all columns, as Parquet in a folder for each shard, about `files` files each.

    name: the column that the folders stand for; it must not be one of docs.
    """
    if name in docs.columns:
        raise ValueError(f"docs has a column {name!r}; give another name")
    items = materialize(_measured(docs.select("text")).select("_item.*"), "items")
    item = F.col("_item")
    rows = _placed(_measured(docs), item["h"], item["size"], item["crc"], _dealt(items, shards, bundles), bundles)
    salt = F.floor(F.rand(7) * files)  # a group of copies may fill a shard
    rows.withColumnRenamed("_shard", name).repartition(shards * files, name, salt).drop("_item").write.partitionBy(name).parquet(at)


def spread(sizes: np.ndarray, parts: np.ndarray, n: int) -> int:
    """Largest less smallest sum of the parts."""
    sums = np.bincount(parts, weights=sizes, minlength=n)
    return int(sums.max() - sums.min())
