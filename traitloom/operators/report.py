"""Ranks, false discovery rates, lead variants and report rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import scalars as S


def by_rank() -> WindowSpec:
    return Window.partitionBy("feature_ix").orderBy(F.desc(F.round("lr", 8)), "pos", "variant_id")


def association_lr(counts: DataFrame, genotypes: DataFrame, tested: DataFrame) -> DataFrame:
    """A likelihood ratio of each tested pair without iteration: n ln(1 / (1 - r^2)) of log expression and dosage."""
    y = counts.select("feature_ix", "sample_ix", F.ln((F.col("y") + 1) / F.col("k")).alias("v"))
    g = genotypes.select("variant_ix", "sample_ix", (F.col("h1") + F.col("h2")).cast("double").alias("d"))
    x = tested.join(y, "feature_ix").join(g, ["variant_ix", "sample_ix"])
    keys = tested.columns
    s = x.groupBy(*keys).agg(F.corr("v", "d").alias("r"), F.count("*").alias("n"))
    return s.select(*keys, F.coalesce(F.nanvl(-F.col("n") * F.ln(1 - F.col("r") * F.col("r")), F.lit(0.0)), F.lit(0.0)).alias("lr"))


def ranked(assoc: DataFrame) -> DataFrame:
    return assoc.withColumn("rank", F.row_number().over(by_rank()))


def with_q(assoc: DataFrame) -> DataFrame:
    """Adds ``log10_q``: Benjamini-Hochberg over the positive ratios of a feature, the running minimum from the worst rank."""
    n = F.count_if(F.col("lr") > 0).over(Window.partitionBy("feature_ix"))
    d = ranked(assoc).withColumn("_n", n)
    raw = S.log10_chisq_tail(F.col("lr")) - F.log10(F.col("rank").cast("double")) + F.log10(F.col("_n").cast("double"))
    d = d.withColumn("_q", F.when(F.col("lr") > 0, raw))
    worst_first = Window.partitionBy("feature_ix").orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("log10_q", F.when(F.col("lr") > 0, F.least(F.lit(0.0), F.min("_q").over(worst_first))).otherwise(0.0)).drop("_q", "_n")


def lead(assoc: DataFrame) -> DataFrame:
    """The variant of the largest ratio (to 1e-5), the nearest to the centre among ties, with the number of ties."""
    key = F.round(F.col("lr") * 100000)
    w = Window.partitionBy("feature_ix").orderBy(F.desc("_k"), F.abs(F.col("pos") - F.col("tss")), "pos", "variant_id")
    d = assoc.withColumn("_k", key).withColumn("_best", F.max("_k").over(Window.partitionBy("feature_ix")))
    d = d.withColumn("n_ties", F.count_if(F.col("_k") == F.col("_best")).over(Window.partitionBy("feature_ix")) - 1).withColumn("_rn", F.row_number().over(w))
    return d.filter("_rn = 1").drop("_k", "_best", "_rn")


def lead_row(full: DataFrame) -> DataFrame:
    """Of the rows of a run each feature's lead alone, with the least ``log10_q`` of the feature."""
    best = full.groupBy("feature_ix").agg(F.min("log10_q").alias("_q"))
    return lead(full).drop("n_ties").join(best, "feature_ix").withColumn("log10_q", F.col("_q")).select(*full.columns)


def passes(assoc: DataFrame, significant: float) -> DataFrame:
    """The rows whose ratio's tail is below ``significant`` over the feature's tested variants: those of the joint model."""
    n = F.count("*").over(Window.partitionBy("feature_ix"))
    d = assoc.withColumn("_p", significant / n)
    return d.filter((F.col("lr") > 0) & ((F.col("_p") >= 1) | (S.log10_chisq_tail(F.greatest(F.col("lr"), F.lit(0.0))) < F.log10("_p")))).drop("_p")


#: What a report row of a feature that isn't fitted says.
SKIPPED = {"variant_id": "SKIPPED", "pos": -1, "ref": "N", "alt": "N", "af": -1.0, "hwe": -1.0, "rsq": -1.0, "log10_q": 0.0, "lr": 0.0, "pi": -1.0, "delta": -1.0, "phi": -1.0, "theta": -1.0, "beta": -1.0, "snp_rank": -1, "itr": -1, "itr_null": -1, "log_bf": 0.0, "code": 0, "r2_fsnp": -1.0, "r2_rsnp": -1.0}
AI = {"variant_id": "AI", "pos": -1, "ref": "N", "alt": "N", "af": -1.0, "hwe": -1.0, "rsq": -1.0, "log10_q": 0.0, "snp_rank": -1, "r2_fsnp": -1.0, "r2_rsnp": -1.0}


def special(rows: DataFrame, values: dict, like: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``like``: its own, then ``values``, else null."""
    kinds = {f.name: f.dataType for f in like.schema}
    return rows.select(*((F.col(c) if c in rows.columns else F.lit(values.get(c))).cast(t).alias(c) for c, t in kinds.items()))


def lead_report(assoc: DataFrame, features: DataFrame) -> DataFrame:
    """A row a feature: its lead, or the row that says that nothing was tested or nothing had a positive ratio."""
    best = with_q(assoc).groupBy("feature_ix").agg(F.min("log10_q").alias("min_q"), F.count("*").alias("n_tested"))
    top = lead(assoc).filter("lr > 0").join(best, "feature_ix").select("feature_ix", "variant_id", "chrom", "pos", "lr", F.col("min_q").alias("log10_q"), "n_tested", "n_ties")
    none = features.join(top.select("feature_ix"), "feature_ix", "left_anti").join(best, "feature_ix", "left")
    n = F.coalesce("n_tested", F.lit(0))
    none = none.select("feature_ix", F.when(n > 0, "rs").otherwise("SKIPPED").alias("variant_id"), "chrom", F.lit(0).cast("bigint").alias("pos"), F.lit(-1.0).alias("lr"), F.lit(0.0).alias("log10_q"), n.alias("n_tested"), F.lit(0).cast("bigint").alias("n_ties"))
    return top.unionByName(none)
