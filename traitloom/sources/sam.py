"""Alignments as SAM text, in the shape of ``operators.reads``."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse(text: DataFrame) -> DataFrame:
    """Rows of ``value`` to alignments; header lines (@) go. Lines have any number of fields of any length."""
    f = F.split("value", "\t")
    d = text.filter(~F.startswith("value", F.lit("@")) & (F.col("value") != "")).select(*(c for c in text.columns if c != "value"), f.alias("f"))
    keep = [c for c in d.columns if c != "f"]
    names = [("qname", 0, "string"), ("flag", 1, "int"), ("chrom", 2, "string"), ("pos", 3, "bigint"), ("mapq", 4, "int"), ("cigar", 5, "string"), ("rnext", 6, "string"), ("pnext", 7, "bigint"), ("tlen", 8, "bigint"), ("seq", 9, "string")]
    return d.select(*keep, *(F.get("f", F.lit(i)).try_cast(t).alias(n) for n, i, t in names), F.slice("f", F.lit(12), F.greatest(F.lit(0), F.size("f") - 11)).alias("tags"), F.when(F.get("f", F.lit(1)).try_cast("int").bitwiseAND(F.lit(128)) != 0, 2).otherwise(1).alias("mate"))


def scan(spark: SparkSession, samples: DataFrame) -> DataFrame:
    """Alignments of all files of ``samples`` (sample_ix, path): one read over all paths, the sample by its full path."""
    rows = samples.select("sample_ix", "path").collect()  # a row a file
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def full(path: str) -> str:
        p = jvm.org.apache.hadoop.fs.Path(path)
        return re.sub("^file:/+", "file:/", p.getFileSystem(conf).makeQualified(p).toUri().toString())

    known = spark.createDataFrame([(r["sample_ix"], full(r["path"])) for r in rows], "sample_ix long, _path string")
    d = spark.read.text([r["path"] for r in rows]).withColumn("_path", F.regexp_replace(F.input_file_name(), "^file:/+", "file:/"))
    return parse(d.join(F.broadcast(known), "_path").drop("_path"))


def sample_list(spark: SparkSession, path: str) -> DataFrame:
    """``sample_ix path sample_name`` of a list of alignment files, in its order; names lose their folder and ending."""
    lines = [r[0].strip() for r in spark.read.text(path).collect() if r[0].strip()]  # a line a sample
    d = spark.createDataFrame(list(enumerate(lines)), "sample_ix long, path string")
    return d.withColumn("sample_name", F.regexp_extract("path", r"([^/]+?)(\.bam|\.sam)?$", 1))
