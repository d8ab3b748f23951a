"""Interval joins as equi-joins on bins, so they shuffle by key and never compare all with all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import ranked


def bins(start: Column, end: Column, width: int) -> Column:
    return F.explode(F.sequence(F.floor(start / width), F.floor(end / width)))


def points_in(points: DataFrame, intervals: DataFrame, width: int, pos: str = "pos", chrom: str = "chrom") -> DataFrame:
    """Inner join of ``points`` (chrom, pos) with ``intervals`` (chrom, start, end), closed on both ends.

    An interval goes to each bin that it touches, a point to its own, so a match is found once. ``width`` should be
    about the length of an interval.
    """
    p = points.withColumn("_bin", F.floor(F.col(pos) / width))
    i = intervals.withColumn("_bin", bins(F.col("start"), F.col("end"), width)).withColumnRenamed(chrom, "_chrom")
    on = (p[chrom] == i["_chrom"]) & (p["_bin"] == i["_bin"]) & F.col(pos).between(F.col("start"), F.col("end"))
    return p.join(i, on).drop("_bin", "_chrom")


def in_any(points: DataFrame, intervals: DataFrame, width: int, pos: str = "pos", chrom: str = "chrom") -> DataFrame:
    """``points`` that lie in some interval, each once."""
    p = points.withColumn("_bin", F.floor(F.col(pos) / width))
    i = intervals.select(F.col(chrom).alias("_chrom"), "start", "end").withColumn("_b", bins(F.col("start"), F.col("end"), width))
    on = (p[chrom] == i["_chrom"]) & (p["_bin"] == i["_b"]) & F.col(pos).between(F.col("start"), F.col("end"))
    return p.join(i, on, "left_semi").drop("_bin")


#: Positions of a bin at most: with wider windows a bin of their width would be a whole chromosome, one key.
WIDEST = 5_000_000


def in_window(variants: DataFrame, features: DataFrame, half: int) -> DataFrame:
    """Variants within ``half`` of a feature's ``tss``, both ends included."""
    w = features.select("feature_ix", "chrom", "tss", (F.col("tss") - half).alias("start"), (F.col("tss") + half).alias("end"))
    return points_in(variants, w, max(1, min(2 * half, WIDEST))).drop("start", "end")


def outside_window(chrom: Column, pos: Column, own_chrom: Column, tss: Column, half: int) -> Column:
    """The test of a trans scan: another chromosome, or at or beyond the ends of the window."""
    return (chrom != own_chrom) | (pos <= tss - half) | (pos >= tss + half)


#: Features that meet variants in one key, which a join holds in memory: as many as a run of packed values in a Parquet page.
TOGETHER = 504


def outside(variants: DataFrame, features: DataFrame, half: int, parts: int | None = None) -> DataFrame:
    """Pairs of a trans scan: variants on another chromosome than a feature, or at or beyond the ends of its window.

    Nearly all pairs are, so all meet in cells of a group of ``TOGETHER`` features and a share of the variants, by key:
    variants go to each group once and stream past its features, features go to each share. There are about four cells for
    each of ``parts`` tasks (those of a shuffle without it), whatever is in the tables. Neither side is sent to the driver.

    Groups are of one size, by rank: each variant has the same run of features, of whole bytes when packed, so that a written
    file repeats it many times within a page and is compressed.
    """
    spark = features.sparkSession
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    f, n = ranked(features.select("feature_ix", F.col("chrom").alias("_chrom"), "tss"), ["feature_ix"], "_rank")
    groups = max(1, -(-n // TOGETHER))
    shares = max(1, -(-4 * parts // groups))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    f = f.select("feature_ix", "_chrom", "tss", F.floor((F.col("_rank") - 1) / TOGETHER).alias("_g"), each(shares).alias("_s"))
    v = variants.withColumn("_in", F.pmod(F.xxhash64("chrom", "pos"), F.lit(shares).cast("bigint"))).withColumn("_to", each(groups))
    v, f = v.repartition(parts, "_to", "_in"), f.repartition(parts, "_g", "_s").hint("merge")
    on = (v["_to"] == f["_g"]) & (v["_in"] == f["_s"]) & outside_window(v["chrom"], v["pos"], f["_chrom"], f["tss"], half)
    return v.join(f, on).drop("_in", "_to", "_chrom", "_g", "_s")
