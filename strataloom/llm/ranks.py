"""Positions of rows in the order of their group, where a group may hold a third of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ._util import materialize

#: Rows of a range, about.
RANGE_ROWS = 1 << 17


def ranked(df: DataFrame, group: list[str], order: list[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """df with pos (from 0 in its group, by the columns of order, nulls first) and n_rows (of its group), both long.

    The rows are cut into ranges of the whole order, so that a large group takes several;
    a row's position is its place in its range plus the rows of the group in the ranges
    before, which are added up over a table of a row for each range and group in it.  A
    further salt splits rows that are equal in group and order; among these the order is
    arbitrary.  df is read twice, so it should be a written table.
    """
    n = max(1, -(-df.count() // range_rows))
    keys = [*group, *order, "_salt"]
    cut = df.withColumn("_salt", F.monotonically_increasing_id() % 1024).repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    at = F.monotonically_increasing_id()
    cut = materialize(cut.withColumn("_part", F.shiftright(at, 33)).withColumn("_row", at.bitwiseAND((1 << 33) - 1)).drop("_salt"), "ranges")
    names = [f"_g{i}" for i in range(len(group))]
    some = cut.groupBy("_part", *(F.col(g).alias(x) for g, x in zip(group, names))).agg(F.count(F.lit(1)).alias("_c"), F.min("_row").alias("_first"))
    own = Window.partitionBy(*names)  # without a group: a row for each range
    before = F.coalesce(F.sum("_c").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    some = some.select(F.col("_part").alias("_p"), *names, (before - F.col("_first")).alias("_shift"), F.sum("_c").over(own).alias("n_rows"))
    meet = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(x)) for g, x in zip(group, names)], F.col("_part") == F.col("_p"))
    return cut.join(some, meet).withColumn("pos", F.col("_row") + F.col("_shift")).drop("_part", "_row", "_p", "_shift", *names)
