"""Variant records as text: reading to long form, writing posterior genotypes and appended counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import genotype as G
from . import tabix

FIXED = ["chrom", "pos", "variant_id", "ref", "alt", "qual", "filter", "info", "format"]


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines, gzip or not; header lines are those that begin with #."""
    return spark.read.text(path)


def sample_names(spark: SparkSession, path: str) -> list[str]:
    """Names from the #CHROM line, in order; empty if there is none."""
    head = lines(spark, path).filter(F.startswith("value", F.lit("#CHROM"))).select(F.split("value", "\t").alias("f")).limit(1).collect()
    return list(head[0]["f"][9:]) if head else []


def records(spark: SparkSession, path: str, region: tuple[str, int, int] | None = None) -> DataFrame:
    """A row a variant: the fixed columns, parsed INFO, and ``cells`` as an array in sample order.

    With a region (sequence, first and last position), those that overlap it, read by the index beside each file.
    """
    f = F.split("value", "\t")
    d = lines(spark, path) if region is None else tabix.read(spark, path, region)
    d = d.filter(~F.startswith("value", F.lit("#")) & (F.col("value") != "")).select(f.alias("f"))
    fixed = [F.get("f", F.lit(i)).try_cast("bigint" if c == "pos" else "string").alias(c) for i, c in enumerate(FIXED)]
    d = d.select(*fixed, F.slice("f", F.lit(10), F.greatest(F.lit(0), F.size("f") - 9)).alias("cells"))
    return d.withColumn("parsed", G.parse_info(F.col("info")))


def scan(spark: SparkSession, path: str, region: tuple[str, int, int] | None = None) -> DataFrame:
    """A row a variant and sample: calls, likelihoods, allelic probabilities and read counts by the order of precedence."""
    d = records(spark, path, region).select("chrom", "pos", "variant_id", "ref", "alt", "format", F.col("parsed.rsq").alias("rsq"), F.col("parsed.af").alias("af"), F.posexplode("cells").alias("sample_ix", "cell"))
    f, c = F.col("format"), F.col("cell")
    gt, gl, gp, ds, ap, ct = (G.field(f, c, *k) for k in (("GT",), ("GL",), ("GP", "PP"), ("DS",), ("AP", "BF"), ("AS",)))
    d = d.select("*", G.hard_call(gt, 0).alias("h1"), G.hard_call(gt, 1).alias("h2"), F.coalesce(G.probabilities(gp), G.likelihoods(gl)).alias("gl"), ds.try_cast("double").alias("ds"), G.allelic(ap, 0).alias("p1"), G.allelic(ap, 1).alias("p2"), G.numbers(ct).alias("ct"), gt.isNotNull().alias("has_gt"))
    count = lambda i: F.coalesce(F.try_element_at("ct", F.lit(i)), F.lit(0.0)).cast("bigint")
    return G.resolved(d).select("chrom", "pos", "variant_id", "ref", "alt", "rsq", "af", F.col("sample_ix").cast("bigint").alias("sample_ix"), "h1", "h2", "gl", "ap1", "ap2", "dose", count(1).alias("as_ref"), count(2).alias("as_alt"))


def posterior_cell(z1: str = "z1", z2: str = "z2") -> "F.Column":
    """GT:GP:AP:AS of columns z1, z2, as_ref, as_alt."""
    call = lambda z: F.when(F.col(z) > 0.5, "1").otherwise("0")
    p = G.genotype_prior(F.col(z1), F.col(z2))
    logs = F.format_string("%.6f,%.6f", *(F.log10(F.greatest(F.col(z), F.lit(1e-5))) for z in (z1, z2)))
    return F.concat_ws(":", F.concat_ws("|", call(z1), call(z2)), F.format_string("%.6f,%.6f,%.6f", *(F.round(x, 6) for x in p)), logs, F.concat_ws(",", F.coalesce("as_ref", F.lit(0)), F.coalesce("as_alt", F.lit(0))))


def write_posterior(cells: DataFrame, path: str) -> None:
    """One gzip text record a variant from rows ``chrom pos variant_id ref alt sample_ix z1 z2 as_ref as_alt``.

    With columns ``filter`` and ``info`` a record for each of their values, else they are a dot.
    """
    more = [c for c in ("filter", "info") if c in cells.columns]
    by = ["chrom", "pos", "variant_id", "ref", "alt", *more]
    row = cells.withColumn("cell", posterior_cell()).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("sample_ix", "cell"))).alias("s"))
    text = F.concat_ws("\t", "chrom", F.col("pos").cast("string"), "variant_id", "ref", "alt", F.lit("."), *(F.col(c) if c in more else F.lit(".") for c in ("filter", "info")), F.lit("GT:GP:AP:AS"), F.array_join(F.transform("s", lambda r: r["cell"]), "\t"))
    row.repartitionByRange("chrom", "pos").sortWithinPartitions("chrom", "pos", *more).select(text.alias("value")).write.option("compression", "gzip").mode("append").text(path)


def append_counts(spark: SparkSession, path: str, counts: DataFrame, out: str) -> None:
    """The records with ``:AS`` in FORMAT and ``:ref,alt`` in every cell, by keys (chrom, pos, variant_id, sample_ix).

    Samples without counts get 0,0. The header goes first, with a line that describes the field before its last one.
    """
    by = ["chrom", "pos", "variant_id"]
    c = counts.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("sample_ix", F.concat_ws(",", "as_ref", "as_alt").alias("c")))).alias("m"))
    d = records(spark, path).drop("parsed").join(c, by, "left")
    cells = F.transform("cells", lambda x, i: F.concat(x, F.lit(":"), F.coalesce(F.try_element_at("m", i.cast("bigint")), F.lit("0,0"))))
    body = d.select("chrom", "pos", F.concat_ws("\t", *(F.col(k).cast("string") for k in FIXED[:8]), F.concat("format", F.lit(":AS")), F.array_join(cells, "\t")).alias("value"))
    note = '##FORMAT=<ID=AS,Number=2,Type=Integer,Description="Allele-specific read counts">'
    head = [r[0] for r in lines(spark, path).filter(F.startswith("value", F.lit("#"))).collect()]
    top = spark.createDataFrame([(i, v) for i, v in enumerate([*head[:-1], note, *head[-1:]])], "i int, value string")
    top.coalesce(1).sortWithinPartitions("i").select("value").write.mode("overwrite").text(f"{out}/header")
    body.repartitionByRange("chrom", "pos").sortWithinPartitions("chrom", "pos").select("value").write.mode("overwrite").text(f"{out}/body")
