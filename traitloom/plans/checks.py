"""What is wrong with the inputs of a run, as rows: one pass over each input, nothing stops at the first fault.

A row has the ``check``, the ``subject`` (a sample, feature, variant or line) or null for the input as a whole, and the
number ``n`` of faults. An input without faults gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KIND = "check string, subject string, n long"


def faults(d: DataFrame, subject: Column, tests: dict[str, Column]) -> DataFrame:
    """A row for each check that some rows of ``d`` fail, by ``subject``; a null test is a failure."""
    bad = F.array(*(F.when(~F.coalesce(t, F.lit(False)), F.lit(k)) for k, t in tests.items()))
    return d.select(subject.cast("string").alias("subject"), F.explode(F.array_compact(bad)).alias("check")).groupBy("check", "subject").agg(F.count("*").alias("n")).select("check", "subject", "n")


def total(d: DataFrame, check: str, n: Column, bad: Column) -> DataFrame:
    """One row if the aggregate ``bad`` holds of ``d``."""
    return d.agg(n.cast("long").alias("n"), bad.alias("_bad")).filter("_bad").select(F.lit(check).alias("check"), F.lit(None).cast("string").alias("subject"), "n")


def counts(offsets: DataFrame, samples: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Of ``feature_ix sample_ix y k`` and of weights (w): ranges, unknown samples, repeated keys, samples that a feature lacks."""
    number = lambda c: ~F.isnan(c) & (F.abs(c) < float("inf"))
    known = samples.select("sample_ix", F.lit(True).alias("_known"))
    d = offsets.join(F.broadcast(known), "sample_ix", "left") if known.count() < 100_000 else offsets.join(known, "sample_ix", "left")
    out = [
        faults(d, F.col("feature_ix"), {"count_not_a_number": number(F.col("y").cast("double")), "count_negative": F.col("y") >= 0, "offset_not_positive": (F.col("k") > 0) & number(F.col("k").cast("double")), "sample_unknown": F.col("_known")}),
        faults(offsets.groupBy("feature_ix", "sample_ix").agg(F.count("*").alias("_n")), F.col("feature_ix"), {"sample_repeated": F.col("_n") == 1}),
    ]
    n = known.count()
    lacking = offsets.groupBy("feature_ix").agg(F.count_distinct("sample_ix").alias("_n")).filter(F.col("_n") < n)
    out.append(lacking.select(F.lit("sample_missing").alias("check"), F.col("feature_ix").cast("string").alias("subject"), (n - F.col("_n")).alias("n")))
    if weights is not None:
        out.append(faults(weights, F.col("feature_ix") if "feature_ix" in weights.columns else F.col("sample_ix"), {"weight_out_of_range": (F.col("w") >= 0) & number(F.col("w").cast("double"))}))
    return reduce(DataFrame.unionByName, out)


def variants(records: DataFrame, order: str | None = None) -> DataFrame:
    """Of ``chrom pos ref alt``: positions, alleles, repeated keys; with ``order``, a column that numbers the lines, lines
    that come before their place within their chromosome."""
    out = [
        faults(records, F.col("chrom"), {"position_not_positive": F.col("pos") > 0, "allele_empty": (F.length("ref") > 0) & (F.length("alt") > 0), "alleles_equal": F.col("ref") != F.col("alt")}),
        faults(records.groupBy("chrom", "pos", "ref", "alt").agg(F.count("*").alias("_n")), F.col("chrom"), {"variant_repeated": F.col("_n") == 1}),
    ]
    if order is not None:
        # positions within ranges of lines; a range's largest position goes on to the next ones
        span = 10_000
        d = records.select("chrom", "pos", F.col(order).alias("_i")).withColumn("_b", F.floor(F.col("_i") / span))
        top = d.groupBy("chrom", "_b").agg(F.max("pos").alias("_top"))
        top = top.select("chrom", "_b", F.max("_top").over(Window.partitionBy("chrom").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
        inner = Window.partitionBy("chrom", "_b").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
        d = d.join(top, ["chrom", "_b"]).withColumn("_last", F.greatest("_before", F.max("pos").over(inner)))
        out.append(faults(d, F.col("chrom"), {"position_falls": F.col("_last").isNull() | (F.col("pos") >= F.col("_last"))}))
    return reduce(DataFrame.unionByName, out)


def cells(d: DataFrame, n_samples: int) -> DataFrame:
    """Of ``variant_ix sample_ix h1 h2``: alleles beyond 0 and 1 (null is a missing call), and variants with other than ``n_samples`` samples."""
    allele = lambda c: F.col(c).isNull() | F.col(c).isin(0, 1)
    per = d.groupBy("variant_ix").agg(F.count_distinct("sample_ix").alias("_n"), F.count("*").alias("_all"))
    return faults(d, F.col("variant_ix"), {"allele_unknown": allele("h1") & allele("h2")}).unionByName(faults(per, F.col("variant_ix"), {"variant_incomplete": (F.col("_n") == n_samples) & (F.col("_all") == n_samples)}))


def table(spark: SparkSession, path: str) -> DataFrame:
    """Of a text of variant records: lines whose width isn't that of the #CHROM line, bad positions, empty fields, no header."""
    lines = spark.read.text(path)
    head = lines.filter(F.startswith("value", F.lit("#CHROM"))).select(F.size(F.split("value", "\t")).alias("n"))
    widths = [r["n"] for r in head.limit(2).collect()]
    body = lines.filter(~F.startswith("value", F.lit("#")) & (F.col("value") != "")).select(F.split("value", "\t").alias("f"), F.input_file_name().alias("_file"))
    own = F.regexp_extract("_file", "[^/]*$", 0)
    out = faults(body, own, {"width_differs": F.size("f") == F.lit(widths[0] if widths else -1), "position_not_a_number": F.get("f", F.lit(1)).try_cast("bigint").isNotNull(), "field_empty": ~F.array_contains("f", "")})
    if len(widths) == 1:
        return out
    return out.unionByName(spark.createDataFrame([("header_missing" if not widths else "header_repeated", None, 1)], KIND))


def study(offsets: DataFrame, samples: DataFrame, records: DataFrame, genotypes: DataFrame, features: DataFrame, exons: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """All checks of a study's tables, with those that span two of them: features without counts or exons, exons that end before they begin."""
    n = samples.count()
    none = lambda check, other: features.join(other.select("feature_ix").distinct(), "feature_ix", "left_anti").select(F.lit(check).alias("check"), F.col("feature_ix").cast("string").alias("subject"), F.lit(1).cast("long").alias("n"))
    out = [
        counts(offsets, samples, weights), variants(records), cells(genotypes, n), none("feature_without_counts", offsets), none("feature_without_exons", exons),
        faults(exons, F.col("feature_ix"), {"exon_ends_before_it_begins": F.col("start") <= F.col("end")}),
        total(samples, "no_samples", F.lit(1), F.count("*") == 0), total(features, "no_features", F.lit(1), F.count("*") == 0),
    ]
    return reduce(DataFrame.unionByName, out)
