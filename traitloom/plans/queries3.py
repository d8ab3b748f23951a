"""Queries that fit models, permute or smooth: rows that SQL can't express."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fit, matrix
from ..operators import genotype as G
from ..operators import offsets as O
from .queries import FEAT, PRIORS, QUERIES, Study, held, kept, normed, once, priors, quality, query, tested
from .oracle import r, sql
from .queries2 import ORACLE, B, assoc, rd

__all__ = ["ORACLE", "QUERIES"]


@query()
def nb_glm_fit(s):
    return fit.glm_fit(O.normalise(s.offsets()), s.covariates(), ["x1", "x2"])


def block(s: Study):
    s = held(s)
    return fit.blocks(normed(s), kept(s), priors(s), s.as_counts())


def blocked(s: Study):
    return once(s, "blocks", lambda: block(s))


def nulls(s: Study):
    return once(s, "nulls", lambda: fit.null_fit(blocked(s)))


def fitted(s: Study):
    s = held(s)
    return once(s, "fits", lambda: fit.alt_fit(tested(s), priors(s), blocked(s), nulls(s)))


@query()
def null_fit(s):
    return nulls(s)


@query()
def imprint_fit(s):
    return once(s, "imprints", lambda: fit.imprint_fit(blocked(s), nulls(s)))


@query()
def alt_fit(s):
    return fitted(s).drop("haplotypes")


@query()
def em_fit(s):
    return fitted(s).filter("joint").select("feature_ix", "variant_ix", "pi", "delta", "phi", "beta", "theta", "itr", "code")


@query()
def posterior_haps(s):
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("haplotypes") / 2).cast("int") - 1), lambda i: F.struct(i.cast("bigint").alias("sample_ix"), F.get("haplotypes", 2 * i).alias("z1"), F.get("haplotypes", 2 * i + 1).alias("z2")))
    return fitted(s).filter(F.size("haplotypes") > 1).select("feature_ix", "variant_ix", F.explode(pairs).alias("h")).select("feature_ix", "variant_ix", "h.*")


@query()
def posterior_feature_haps(s):
    """The other half: haplotypes of the feature variants at each feature's best joint fit."""
    from pyspark.sql import Window

    best = F.row_number().over(Window.partitionBy("feature_ix").orderBy(F.desc("lr"), "variant_ix"))
    lead = fitted(s).filter("joint").withColumn("_rn", best).filter("_rn = 1").drop("_rn")
    return fit.feature_haplotypes(lead, priors(held(s)), blocked(s))


@query()
def assoc_report(s):
    """The full report: 25 columns, a row a tested pair."""
    from ..operators import report

    s = held(s)
    v = s.variants().select("variant_ix", "ref", "alt").join(quality(s).select("variant_ix", "af", "hwe"), "variant_ix")
    rsq = s.variants().select("variant_ix", F.coalesce("rsq", F.lit(1.0)).alias("rsq"))
    d = tested(s).join(fitted(s), ["feature_ix", "variant_ix"]).join(v, "variant_ix").join(rsq, "variant_ix").join(s.features().select("feature_ix", "feature_id"), "feature_ix")
    n = d.groupBy("feature_ix").agg(F.count("*").alias("n_tested"))
    d = report.with_q(d).join(n, "feature_ix")
    return d.select("feature_id", "variant_id", "chrom", "pos", "ref", "alt", "af", "hwe", "rsq", "log10_q", "lr", "pi", "delta", "phi", "theta", "beta", F.col("rank").alias("snp_rank"), "n_feature", "n_tested", "itr", "itr_null", "log_bf", "code", "r2_fsnp", "r2_rsnp")


@query(sql(f"SELECT feature_ix, variant_id, {r('lr', 5)} AS lr FROM (SELECT *, row_number() OVER (PARTITION BY feature_ix ORDER BY round(lr * 100000) DESC, md5('7:' || variant_id), variant_id) AS rn FROM assoc) WHERE rn = 1", **B))
def lead_tie_random(s):
    """Of the variants that share a feature's best ratio one by a seeded hash."""
    from pyspark.sql import Window

    k = F.round(F.col("lr") * 100000)
    w = Window.partitionBy("feature_ix").orderBy(F.desc("k"), F.md5(F.concat(F.lit("7:"), "variant_id")), "variant_id")
    return assoc(s).withColumn("k", k).withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("feature_ix", "variant_id", rd(F.col("lr"), 5).alias("lr"))


def dealt(table: str, group: list[str], values: list[str], seed: int) -> str:
    """A permutation within groups in DuckDB: the row that is nth by hash gives its values to the nth sample."""
    g, key = ", ".join(group), " || ':' || ".join([f"'{seed}'", *group, "sample_ix"])
    return f"""SELECT a.* EXCLUDE ({', '.join(values)}, _f, _t), {', '.join(f'b.{v}' for v in values)} FROM
      (SELECT *, row_number() OVER (PARTITION BY {g} ORDER BY md5({key}), sample_ix) AS _f, row_number() OVER (PARTITION BY {g} ORDER BY sample_ix) AS _t FROM {table}) a
      JOIN (SELECT {g}, {', '.join(values)}, row_number() OVER (PARTITION BY {g} ORDER BY md5({key}), sample_ix) AS _t FROM {table}) b USING ({g}, _t)"""


@query(sql(f"SELECT feature_ix, sample_ix, y, {r('k')} AS k FROM ({dealt('norm', ['feature_ix'], ['y', 'k'], 11)})"))
def permute_counts(s):
    """The half of a permutation that moves a feature's counts and offsets."""
    return matrix.permute(O.normalise(s.offsets()), ["feature_ix"], "sample_ix", ["y", "k"], 11).select("feature_ix", "sample_ix", "y", rd(F.col("k")).alias("k"))


VALUES = ["z1", "z2", "as_ref", "as_alt", "kx"]
OWN = """SELECT k.feature_ix, k.variant_ix, n.sample_ix, p.z1, p.z2, coalesce(c.as_ref, 0) AS as_ref, coalesce(c.as_alt, 0) AS as_alt, n.k AS kx FROM kept k JOIN norm n USING (feature_ix)
  JOIN priors p ON p.variant_ix = k.variant_ix AND p.sample_ix = n.sample_ix LEFT JOIN as_counts c ON c.variant_ix = k.variant_ix AND c.sample_ix = n.sample_ix"""


@query(sql(f"SELECT feature_ix, variant_ix, sample_ix, {r('z1')} AS z1, {r('z2')} AS z2, as_ref, as_alt, {r('kx')} AS kx FROM ({dealt('own', ['feature_ix', 'variant_ix'], VALUES, 12)})", **FEAT, priors=PRIORS, own=OWN))
def permute_feature_variants(s):
    """The other half: priors, allele-specific counts and offset of each feature variant."""
    x = kept(s).select("feature_ix", "variant_ix").join(priors(s).select("variant_ix", "sample_ix", "z1", "z2"), "variant_ix").join(s.as_counts(), ["variant_ix", "sample_ix"], "left").na.fill(0)
    x = x.join(O.normalise(s.offsets()).select("feature_ix", "sample_ix", F.col("k").alias("kx")), ["feature_ix", "sample_ix"])
    return fit.shuffled(x, 12).select("feature_ix", "variant_ix", "sample_ix", rd(F.col("z1")).alias("z1"), rd(F.col("z2")).alias("z2"), "as_ref", "as_alt", rd(F.col("kx")).alias("kx"))


BATCHED = "SELECT feature_ix, sample_ix, y, n_regionkey AS batch FROM counts JOIN nation ON CAST(n_nationkey AS BIGINT) = sample_ix"


@query(sql(f"SELECT feature_ix, sample_ix, batch, y FROM ({dealt('batched', ['feature_ix', 'batch'], ['y'], 12)})", batched=BATCHED))
def permute_within_batch(s):
    d = s.counts().join(s.raw("nation").selectExpr("cast(n_nationkey as bigint) as sample_ix", "n_regionkey as batch"), "sample_ix")
    return matrix.permute(d, ["feature_ix", "batch"], "sample_ix", ["y"], 12)


@query()
def gc_correction(s):
    return matrix.gc_factor(s.counts(), s.gc())


@query()
def svd_covariates(s):
    return matrix.covariates(s.offsets())
