"""Stages of a sweep, stored: an intermediate table that depends on the first axes only is made once and found again by later runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from ..sources.runs import Files
from .sweep import config_hash


class Stage(NamedTuple):
    """fn(previous, **axes): the table of a stage from that of the stage before (None for the first) and the values of its axes."""

    name: str
    axes: tuple[str, ...]
    fn: Callable[..., DataFrame]


def check_stages(stages: list[Stage], order: list[str]) -> None:
    """The axes of every stage must be the first ones of the order, and no fewer than those of the stage before."""
    least, names = 0, set()
    for s in stages:
        if unknown := [a for a in s.axes if a not in order]:
            raise ValueError(f"stage {s.name!r} depends on unknown axes {unknown}; known: {order}")
        if set(s.axes) != set(order[: len(s.axes)]):
            raise ValueError(f"stage {s.name!r} depends on {list(s.axes)}, which aren't the first axes of {order}: a stored table would be taken though an axis between has changed")
        if len(s.axes) < least:
            raise ValueError(f"stage {s.name!r} depends on fewer axes than the stage before it")
        if s.name in names:
            raise ValueError(f"two stages are named {s.name!r}")
        least = len(s.axes)
        names.add(s.name)


class StagedTables:
    """Tables of stages under a folder, by the hash of the stage's own and all earlier names and of its axes' values.

    A later run with one more value of an axis makes only what that value leads to.  made
    counts the tables that this object had to make, found those it read.  version: a word that
    changes when the code of the stages does.
    """

    def __init__(self, spark: SparkSession, folder: str, stages: list[Stage], order: list[str], version: str = ""):
        check_stages(stages, order)
        self.spark, self.folder, self.stages, self.order, self.version = spark, folder, stages, order, version
        self.files = Files(spark, folder)
        self.made, self.found = dict.fromkeys((s.name for s in stages), 0), dict.fromkeys((s.name for s in stages), 0)

    def path(self, k: int, config: dict) -> str:
        """Folder of stage k's table for a configuration."""
        names = ">".join(s.name for s in self.stages[: k + 1])
        key = config_hash({"stages": names, "version": self.version, **{f"axis {a}": config[a] for a in self.stages[k].axes}})
        return f"{self.folder}/{self.stages[k].name}/{key}"

    def table(self, config: dict, k: int | None = None) -> DataFrame:
        """The table of a stage (the last by default); what is stored is read, and nothing before it is touched."""
        k = len(self.stages) - 1 if k is None else k
        stage, at = self.stages[k], self.path(k, config)
        if self.files.exists(f"{at}/_SUCCESS"):
            self.found[stage.name] += 1
        else:
            before = self.table(config, k - 1) if k else None
            stage.fn(before, **{a: config[a] for a in stage.axes}).write.mode("overwrite").parquet(at)
            self.made[stage.name] += 1
        return self.spark.read.parquet(at)

    def tables(self, configs: list[dict], keep: bool = True) -> Iterator[tuple[dict, DataFrame]]:
        """(configuration, its last table) in turn.  Without keep, a table goes as soon as no later configuration needs it, and the one just given when the next is asked for."""
        need = [[self.path(k, c) for k in range(len(self.stages))] for c in configs]
        for n, c in enumerate(configs):
            yield c, self.table(c)
            if not keep:
                later = {p for ps in need[n + 1 :] for p in ps}
                for p in need[n]:
                    if p not in later:
                        self.files.delete(p)

    def drop_unneeded(self, configs: list[dict]) -> int:
        """Delete every stored table that none of the configurations leads to; how many went."""
        need, gone = {self.path(k, c) for c in configs for k in range(len(self.stages))}, 0
        for s in self.stages:
            for name in self.files.names(f"{self.folder}/{s.name}"):
                if f"{self.folder}/{s.name}/{name}" not in need:
                    self.files.delete(f"{self.folder}/{s.name}/{name}")
                    gone += 1
        return gone
