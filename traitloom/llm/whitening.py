"""Whitening of embeddings, with each distinct vector counted as often as it occurs.

Entries become integers on a grid, and equal vectors become one row with their count before anything is computed, so a
vector that a third of all rows share costs one row a task. Sums and the covariance are partial sums a task (``dim``
numbers, a triangle of ``dim`` squared), added up by Spark; the driver holds the covariance and its eigenvectors. Each
distinct vector is whitened once and joined back to its rows by a digest of 128 bits.

Defined cases: rows with a null vector or with null or non-finite entries have no part; of vectors of several lengths the
most frequent length stays (ties: the longer); entries are cut off at +-2^40; null and repeated ids are rows like others;
components without spread (eigenvalue at most dim * 2^-52 of the largest) have no rows, so equal vectors alone or an
empty table give none; a deviation beyond 64 bits is null; other columns are ignored. The dimension is bounded by what
the driver holds squared.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
LIMIT = 1 << 40


def gridded(vector: Column, scale: int = SCALE, shift: int = SHIFT) -> Column:
    """Integers floor(scale * c) + shift; null where the vector or an entry is null or not finite."""
    good = F.forall(vector, lambda c: F.coalesce((F.abs(c) < float("inf")) & ~F.isnan(c), F.lit(False)))
    one = lambda c: F.floor(F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), scale * c.cast("double")))) + shift
    return F.when(good, F.transform(vector, one))


def distinct(rows: DataFrame, weights: str = "counts") -> DataFrame:
    """``key x w``: the distinct ``x`` of ``rows``, and how often each occurs (``counts``) or one (``one``)."""
    d = rows.groupBy("x").agg(F.count("*").alias("w"))
    return d.select(key_of("x").alias("key"), "x", F.lit(1).cast("long").alias("w") if weights == "one" else F.col("w"))


def key_of(x: str) -> Column:
    return F.substring(F.sha2(F.array_join(F.col(x).cast("array<string>"), ","), 256), 1, 32)


def matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def totals(d: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Number of vectors and sums of their entries, both exact; ``d`` has ``w`` and ``x``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = 0, [0] * dim
        for b in batches:
            w, x = b.column(0).to_numpy(zero_copy_only=False), matrix(b.column(1), dim)
            n += int(w.sum())
            for k in range(0, len(w), 1000):  # 2^10 rows of 2^41: weights go by halves, so that no sum leaves 64 bits
                for half, unit in ((w[k : k + 1000] & 0xFFF, 1), ((w[k : k + 1000] >> 12) & 0xFFF, 1 << 12), ((w[k : k + 1000] >> 24) & 0xFFF, 1 << 24), ((w[k : k + 1000] >> 36) & 0xFFF, 1 << 36)):
                    if half.any():
                        s = [a + int(v) * unit for a, v in zip(s, half @ x[k : k + 1000], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, dim), pa.int32()), pa.array([Decimal(v) for v in (n, *s)], pa.decimal128(38, 0))], names=["i", "v"])

    rows = d.select("w", "x").mapInArrow(run, "i int, v decimal(38,0)").groupBy("i").agg(F.sum("v").alias("v")).collect()
    found = {r["i"]: int(r["v"]) for r in rows}
    return found[-1], [found[i] for i in range(dim)]


def covariance(d: DataFrame, column: str, dim: int, n: int, centre) -> np.ndarray:
    """Sum of w * c c' / n over the rows of ``d``, c = ``centre(x)``; the upper triangle is added up by Spark."""
    i, j = np.triu_indices(dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = np.zeros((dim, dim))
        for b in batches:
            c = centre(matrix(b.column(1), dim))
            a += (c * b.column(0).to_numpy(zero_copy_only=False)[:, None]).T @ c
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(a[i, j])], names=["i", "j", "v"])

    out = np.zeros((dim, dim))
    for r in d.select("w", column).mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"] / n
    return out


def centred(n: int, sums: list[int]):
    """x - sums / n without loss: whole parts leave as integers."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n / n for s in sums])
    return lambda x: (x - whole) - rest


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum of (n * x - S)^2 of each row, exact; None beyond 64 bits."""
    most = max(max(abs(n * int(x[:, k].min()) - s), abs(n * int(x[:, k].max()) - s)) for k, s in enumerate(sums)) if len(x) else 0
    if most * most * len(sums) < 1 << 63 and n * int(np.abs(x).max(initial=0)) < 1 << 63:
        return ((n * x - np.array(sums)) ** 2).sum(1).tolist()
    found = [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in found]


def whiten(vectors: DataFrame, vector: str = "embedding", components: int = COMPONENTS, weights: str = "counts") -> DataFrame:
    """``vec_id component n deviation whitened explained identity_error``: a row for each vector and component.

    The fit list is all vectors (``weights="counts"``) or the distinct ones (``"one"``).
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", gridded(F.col(vector)).alias("x")).filter("size(x) > 0")
    dims = rows.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    schema = rows.select("vec_id").schema.add("component", "integer").add("n", "long").add("deviation", "long").add("whitened", "double").add("explained", "double").add("identity_error", "double")
    if not dims:
        return spark.createDataFrame([], schema)
    dim = dims["dim"]
    rows = rows.filter(F.size("x") == dim)
    d = common.materialize(distinct(rows, weights), "distinct")
    n, sums = totals(d, dim)
    centre = centred(n, sums)
    v = covariance(d, "x", dim, n, centre)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    k = int(min(components, (e > max(0.0, e[0]) * dim * 2.0**-52).sum()))
    if not k:
        return spark.createDataFrame([], schema)
    turn = u[:, :k] / np.sqrt(e[:k])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(2), dim)
            z = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * k), pa.array((centre(x) @ turn).ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(deviations(x, n, sums), pa.int64()), z], names=["key", "w", "deviation", "z"])

    z = common.materialize(d.select("key", "w", "x").mapInArrow(run, "key string, w long, deviation long, z array<double>"), "whitened")
    mean = z.select(*(F.sum(F.col("w") * F.col("z")[i]).alias(str(i)) for i in range(k))).first()
    mean = np.array(mean, float) / n
    error = float(np.abs(covariance(z, "z", k, n, lambda x: x - mean) - np.eye(k)).max())
    explained = F.array(*(F.lit(float(x)) for x in e[:k] / np.trace(v)))
    back = rows.select("vec_id", key_of("x").alias("key")).join(z.select("key", "deviation", "z"), "key")
    back = back.select("vec_id", "deviation", F.posexplode("z").alias("_i", "whitened"))
    return back.select("vec_id", (F.col("_i") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained[F.col("_i")].alias("explained"), F.lit(error).alias("identity_error"))
