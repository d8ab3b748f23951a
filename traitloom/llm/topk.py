"""Exact top-k search of binary codes by incremental multi-index hashing.

Codes of 64 bits are cut into m segments, each with an index from its value to the codes. A query looks up all values
within radius r of its own in every segment, for r = 0, 1, 2, ...; after radius r every code within distance
m (r + 1) - 1 has been seen, so the query is done once its kth verified distance is no more than that.

Equal codes are one entry, with the ``k`` smallest ids (more can't be among the k nearest, as ties go to smaller ids),
and equal queries are one query. Each pair of codes is met once: at its least segment distance, in the first segment
that has it. Distances above the query's bound (kth distance so far, at first from a bounded sample of codes) are not
kept, so what a round keeps stays near k a query.

Defined cases: a null vector, or one that isn't of ``BITS`` numbers, isn't indexed, and as a query finds nothing; null
ids are not indexed either; repeated rows are neighbours of their own; fewer than k rows give all of them; a query
finds itself; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

BITS = 64
SAMPLE = 1024


def code(vector: Column) -> Column:
    """The signs of the coordinates, the first in the lowest bit; null for vectors of another length."""
    bit = lambda i: F.when(vector[i] >= 0, F.lit(1 << i if i < 63 else -(1 << 63))).otherwise(F.lit(0)).cast("bigint")
    out = bit(0)
    for i in range(1, BITS):
        out = out.bitwiseOR(bit(i))
    return F.when(F.size(vector) == BITS, out)


def cuts(n: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of the segments for n codes: a value should have a few codes."""
    m = math.ceil(BITS / max(8, int(math.log2(max(2, n))) - 2))
    ends = [round(i * BITS / m) for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:], strict=False)]


def part(c: Column, at: int, width: int) -> Column:
    return F.shiftrightunsigned(c, at).bitwiseAND(F.lit((1 << width) - 1))


def masks(width: int, r: int) -> Column:
    """All numbers of ``width`` bits with ``r`` ones, each made once: ones are added above the highest one."""
    out = F.array(F.lit(0).cast("bigint"))
    bits = F.array(*(F.lit(1 << i).cast("bigint") for i in range(width)))
    for _ in range(r):
        out = F.flatten(F.transform(out, lambda x: F.transform(F.filter(bits, lambda b: b > x), lambda b: x.bitwiseOR(b))))
    return out


def search(vectors: DataFrame, queries: Column, k: int = 10) -> DataFrame:
    """``query_id rank vec_id distance`` for the rows where ``queries`` holds; ``vectors`` has ``vec_id embedding``."""
    spark = vectors.sparkSession
    rows = common.materialize(vectors.select("vec_id", code(F.col("embedding")).alias("code"), F.coalesce(queries, F.lit(False)).alias("is_query")).filter("vec_id is not null and code is not null"), "codes")
    # only k rows of a code leave a task before they meet
    ids = rows.select("code", "vec_id", F.row_number().over(Window.partitionBy("code").orderBy("vec_id")).alias("_n")).filter(F.col("_n") <= k)
    ids = common.materialize(ids, "ids")
    codes = common.materialize(ids.groupBy("code").agg(F.count("*").alias("copies")), "distinct")
    n = codes.count()
    segments = cuts(n)
    m = len(segments)
    entry = F.explode(F.array(*(F.struct(F.lit(s).alias("seg"), part(F.col("code"), a, w).alias("value")) for s, (a, w) in enumerate(segments))))
    index = common.materialize(codes.select("code", "copies", entry.alias("e")).select("e.seg", "e.value", "code", "copies"), "index")

    sample = [r["code"] for r in codes.orderBy(F.xxhash64("code")).limit(SAMPLE).select("code").collect()]
    bound = F.lit(BITS)
    if len(sample) >= k:
        bound = F.element_at(F.array_sort(F.transform(F.array(*map(F.lit, sample)), lambda c: F.bit_count(c.bitwiseXOR(F.col("q"))))), k)
    active = common.materialize(rows.filter("is_query").select(F.col("code").alias("q")).distinct().select("q", bound.cast("int").alias("bound")), "active")
    found = None
    for r in range(max(w for _, w in segments) + 1):
        if active.isEmpty():
            break
        probes = []
        for s, (a, w) in enumerate(segments):
            if r <= w:
                probes.append(active.select("q", "bound", F.lit(s).alias("seg"), F.explode(masks(w, r)).alias("_x")).withColumn("value", part(F.col("q"), a, w).bitwiseXOR(F.col("_x"))).drop("_x"))
        probe = probes[0]
        for x in probes[1:]:
            probe = probe.unionByName(x)
        differ = F.col("q").bitwiseXOR(F.col("code"))
        ok = (probe["seg"] == index["seg"]) & (probe["value"] == index["value"]) & (F.bit_count(differ) <= F.col("bound"))
        for s, (a, w) in enumerate(segments):
            far = F.bit_count(part(differ, a, w))
            ok = ok & ((probe["seg"] <= s) | (far > r)) & ((probe["seg"] >= s) | (far >= r))
        # a probe's size is guessed from before its explosion, so it must not be broadcast on that guess
        new = probe.join(index.hint("merge"), ok).select("q", "code", "copies", F.bit_count(differ).alias("distance"))
        new = common.materialize(new, f"found{r}")
        found = new if found is None else found.unionByName(new)
        # kth distance so far, counting copies
        w = Window.partitionBy("q").orderBy("distance", "code").rowsBetween(Window.unboundedPreceding, 0)
        kth = found.join(active.select("q"), "q", "left_semi").select("q", "distance", F.sum("copies").over(w).alias("_c")).filter(F.col("_c") >= k).groupBy("q").agg(F.min("distance").alias("kth"))
        covered = m * (r + 1) - 1
        active = active.join(kth, "q", "left").select("q", F.least("bound", F.coalesce("kth", "bound")).alias("bound"))
        active = common.materialize(active.filter(F.col("bound") > covered), "active")
    if found is None:
        return rows.limit(0).select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).alias("distance"))
    best = Window.partitionBy("q").orderBy("distance", "vec_id")
    near = found.join(ids.select("code", "vec_id"), "code").select("q", "vec_id", "distance", F.row_number().over(best).alias("rank")).filter(F.col("rank") <= k)
    asked = rows.filter("is_query").select(F.col("vec_id").alias("query_id"), F.col("code").alias("q"))
    return asked.join(near, "q").select("query_id", "rank", "vec_id", "distance")
