"""Row numbers over a whole table without gathering it in one task."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import store


def ranked(d: DataFrame, order: list[str], out: str = "rank") -> tuple[DataFrame, int]:
    """``d`` with the row number in the order of the columns ``order`` (from 1), and the number of rows.

    Rows are dealt out by range and sorted there; a row's number is its place in its range and the sizes of the ranges
    before, of which there are as many as tasks. Rows that are equal in ``order`` are numbered in any order; nulls first.
    """
    parts = d.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    parts = store.written(parts, "ranked")  # ranges must not be cut anew
    sizes = sorted((r["_p"], r["count"]) for r in parts.groupBy("_p").count().collect())  # a row a task
    total = sum(n for _, n in sizes)
    before = dict(zip((p for p, _ in sizes), accumulate((n for _, n in sizes), initial=0), strict=False))
    base = parts.sparkSession.createDataFrame(sorted(before.items()), "_p int, _base long")
    own = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return parts.join(F.broadcast(base), "_p").withColumn(out, F.col("_base") + own).drop("_p", "_base"), total
