"""Parameter sweeps: grids, content hashes, resumable results, plateaus and leaders."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable
from itertools import product

from pyspark.sql import DataFrame, SparkSession, functions as F


def expand_grid(axes: dict[str, object]) -> list[dict]:
    """Cross product, the last axis fastest; a list sweeps, anything else is pinned."""
    values = [v if isinstance(v, list) else [v] for v in axes.values()]
    return [dict(zip(axes, c)) for c in product(*values)]


def config_hash(config: dict) -> str:
    return hashlib.sha256(json.dumps({k: repr(config[k]) for k in sorted(config)}, sort_keys=True).encode()).hexdigest()[:16]


def grid_table(spark: SparkSession, axes: dict[str, list]) -> DataFrame:
    """The grid as a table with its ordinal, by joins of axis tables that are as short as the axes."""
    out = spark.range(1).select(F.lit(0).alias("ordinal"))
    for name, values in axes.items():
        axis = spark.createDataFrame([(i, v) for i, v in enumerate(values)], ["_o", name])
        out = out.join(F.broadcast(axis)).withColumn("ordinal", (F.col("ordinal") * len(values) + F.col("_o")).cast("int")).drop("_o")
    return out


def todo(configs: DataFrame, results: DataFrame) -> DataFrame:
    """Configurations without a finished result."""
    return configs.join(results.filter("status = 'ok'").select("hash"), "hash", "left_anti")


def run_sweep(configs: Iterable[dict], evaluate: Callable[[dict], dict], validate: Callable[[dict], str | None] = lambda c: None, done: set[str] = frozenset()) -> list[dict]:
    """Rows (hash, status, error, config and measures): all configurations are checked first, finished ones skipped, errors recorded."""
    configs = list(configs)
    checked = [(config_hash(c), c, validate(c)) for c in configs]
    out = [{"hash": h, "status": "rejected", "error": why, **c} for h, c, why in checked if why]
    for h, c, why in checked:
        if why or h in done:
            continue
        try:
            out.append({"hash": h, "status": "ok", "error": None, **c, **evaluate(c)})
        except Exception as e:  # a failed configuration is a row, not the end of the sweep
            out.append({"hash": h, "status": "error", "error": f"{type(e).__name__}: {e}", **c})
    return out


def plateaus(results: DataFrame, measures: list[str], spans: list[str], least: int = 3) -> DataFrame:
    """Groups of results with the same rounded measures, at least so many, with the distinct settings they span."""
    keys = [F.round(m, 0).alias(m) for m in measures]
    spread = [F.array_join(F.array_sort(F.collect_set(F.col(s).cast("string"))), ",").alias(f"{s}_span") for s in spans]
    return results.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *spread).filter(F.col("n") >= least)


def pivot(results: DataFrame, x: str, y: str, value: str, order: str = "ordinal") -> DataFrame:
    """A row for each value of y, a column for each of x: the value of the last result there, by order."""
    last = results.groupBy(y, x).agg(F.max_by(value, order).alias("_v"))
    return last.groupBy(y).pivot(x).agg(F.first("_v"))


def leading(results: DataFrame, measure: str, top: int = 10, median: float = 5, most_ratio: float | None = None) -> DataFrame:
    """The best results by a measure whose nodes aren't tiny, nor more for each cell than most_ratio."""
    if most_ratio is not None:
        results = results.filter(F.col("node_ratio") <= most_ratio)
    return results.filter(F.col(measure).isNotNull() & (F.col("node_median") >= median)).orderBy(F.desc(measure), "hash").limit(top)
