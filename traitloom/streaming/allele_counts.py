"""Allele counts of alignments that arrive as files of SAM text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import reads as R
from ..sources import sam


def stream(spark: SparkSession, folder: str, markers: DataFrame, q: R.Quality | None = None, files_per_batch: int = 100) -> DataFrame:
    """A running count by marker: reads are single, so no state is kept but the sums, one row a marker."""
    text = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)
    frags = R.single(sam.parse(text), q or R.Quality(max_mismatch=100, max_gap=100)).withColumn("sample_ix", F.lit(0).cast("bigint"))
    short = markers.withColumn("chrom", F.regexp_replace("chrom", "^chr", ""))
    return R.allele_counts(R.covered(frags, short))


def start(counts: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    return counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()
