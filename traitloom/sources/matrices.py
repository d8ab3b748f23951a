"""Count, offset and covariate tables as text or binary doubles; results as tables of text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import doubles, store


def read_table(spark: SparkSession, path: str, value: str = "y") -> DataFrame:
    """``feature_id sample_ix value`` from tab-separated rows: an id, then a number a sample."""
    f = F.split("value", "\t")
    d = spark.read.text(path).filter("value <> ''").select(f[0].alias("feature_id"), F.slice(f, F.lit(2), F.size(f) - 1).alias("v"))
    d = d.select("feature_id", F.posexplode("v").alias("sample_ix", value))
    return d.select("feature_id", F.col("sample_ix").cast("bigint").alias("sample_ix"), F.col(value).cast("double").alias(value))


def read_covariates(spark: SparkSession, path: str) -> DataFrame:
    """An array ``x`` a line, in the order of lines, of several files by their paths (a line a sample, so small files)."""
    files = spark.read.option("wholetext", True).text(path).select("value", "_metadata.file_path").orderBy("file_path").collect()
    rows = [[float(v) for v in line.split("\t")] for f in files for line in f["value"].splitlines() if line]
    return spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "sample_ix long, x array<double>")


def read_numbers(spark: SparkSession, path: str) -> DataFrame:
    """Numbers of a text with any of comma, tab, space or line ends between them."""
    return spark.read.text(path).select(F.explode(F.split("value", r"[,\t ]+")).alias("v")).filter("v <> ''").select(F.col("v").cast("double").alias("value"))


def dimensions(spark: SparkSession, path: str) -> DataFrame:
    """One row: ``n_rows``, least and most ``n_columns`` of a text table, and its ``separator``.

    The separator is the first of tab, comma and blank that any row holds; empty lines are no rows, an empty file has none.
    """
    d = spark.read.text(path).filter("value <> ''")
    kinds = {"\t": "t", ",": "c", " ": "b"}
    d = d.agg(F.count("*").alias("n_rows"), *(f(F.regexp_count("value", F.lit(s))).alias(f"{n}_{k}") for s, k in kinds.items() for f, n in ((F.min, "lo"), (F.max, "hi"))))
    pick = lambda of, other: F.when(F.col("hi_t") > 0, of("t")).when(F.col("hi_c") > 0, of("c")).when(F.col("hi_b") > 0, of("b")).otherwise(other)
    size = lambda n: F.when(F.col("n_rows") > 0, pick(lambda k: F.col(f"{n}_{k}"), F.lit(0)) + 1).otherwise(0)
    return d.select("n_rows", size("lo").alias("n_columns"), size("hi").alias("max_columns"), pick(lambda k: F.lit({v: s for s, v in kinds.items()}[k]), F.lit(None)).alias("separator"))


def read_binary(spark: SparkSession, path: str, n_samples: int, by_sample: bool = True, rows: list[int] | None = None) -> DataFrame:
    """``row sample_ix value`` of little-endian doubles: rows of ``n_samples``, or columns of them if not ``by_sample``."""
    d = doubles.long_form(doubles.read(spark, path, n_samples, rows))
    return d if by_sample else d.withColumnRenamed("row", "column")


def write_binary(matrix: DataFrame, path: str) -> int:
    """Doubles of ``row sample_ix value`` into one file, row by row, by way of parts beside it; returns their number."""
    spark = matrix.sparkSession
    rows = doubles.gathered(matrix)
    columns = rows.agg(F.max(F.size("values"))).first()[0]
    parts = store.scratch(spark, "doubles")
    if columns:
        doubles.write(rows, parts, columns)
        return doubles.join_parts(spark, parts, path) // 8
    open(path, "wb").close()
    return 0


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", "false").csv(path)


def write_by_sample(counts: DataFrame, path: str) -> None:
    """Allele-specific counts as text, compressed, a folder a sample: variant, reference and alternative reads."""
    d = counts.select("sample_ix", F.concat_ws("\t", "variant_ix", "as_ref", "as_alt").alias("value"))
    d.write.mode("overwrite").partitionBy("sample_ix").option("compression", "gzip").text(path)
