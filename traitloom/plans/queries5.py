"""Queries of a run's inputs by its options, checks of inputs, and fits held against their likelihood."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import fit, matrix
from ..operators import genotype as G
from ..operators import intervals as I
from ..operators import likelihood as L
from ..operators import offsets as O
from ..sources import store
from . import checks, pipeline, queries4
from .oracle import r, sql
from .queries import FEAT, HALF, HWE, MAF, ORACLE, QUAL, QUERIES, RSQ, Study, good, kept, normed, priors, quality, query, rd, tested
from .queries2 import DOSE, GLAP, PARSED, parsed, reads_of_features
from .queries3 import fitted, held, nulls

__all__ = ["ORACLE", "QUERIES", "queries4"]

# --- genotype modes ---------------------------------------------------------------------------------------------


def calls(s: Study) -> DataFrame:
    """``variant_ix sample_ix h1 h2 ap1 ap2 dose`` of the study's cells."""
    d = parsed(s).withColumnsRenamed({"ap1": "p1", "ap2": "p2"}).withColumn("af", F.lit(None).cast("double"))
    return G.resolved(d).select("variant_ix", "sample_ix", "h1", "h2", "ap1", "ap2", "dose")


CALLS = """SELECT p.variant_ix, p.sample_ix, p.h1, p.h2,
  CASE WHEN p.ap1 IS NOT NULL THEN p.ap1 WHEN p.gl IS NOT NULL THEN CASE WHEN p.h1 IS NULL THEN 0.5 WHEN p.h1 + p.h2 <> 1 THEN mid WHEN p.h1 = 0 THEN mid - w ELSE mid + w END WHEN p.ds IS NOT NULL THEN d.ap1 ELSE CASE WHEN p.h1 = 0 THEN 0.0 WHEN p.h1 IS NOT NULL THEN 1.0 END END AS ap1,
  CASE WHEN p.ap1 IS NOT NULL THEN p.ap2 WHEN p.gl IS NOT NULL THEN CASE WHEN p.h1 IS NULL THEN 0.5 WHEN p.h1 + p.h2 <> 1 THEN mid WHEN p.h1 = 0 THEN mid + w ELSE mid - w END WHEN p.ds IS NOT NULL THEN d.ap2 ELSE CASE WHEN p.h2 = 0 THEN 0.0 WHEN p.h2 IS NOT NULL THEN 1.0 END END AS ap2,
  CASE WHEN p.ap1 IS NOT NULL THEN p.ap1 + p.ap2 ELSE p.h1 + p.h2 END AS dose
  FROM parsed p LEFT JOIN (SELECT variant_ix, sample_ix, mid, w FROM g) g USING (variant_ix, sample_ix) LEFT JOIN d USING (variant_ix, sample_ix)"""
WEIGHTS = "SELECT CAST(n_nationkey AS BIGINT) AS sample_ix, 0.5 + n_regionkey / 4.0::DOUBLE AS w FROM nation"


def quality_sql(dip: str, weights: str) -> str:
    """The quality of each variant, from calls ``c`` and a weight for each sample."""
    return f"""SELECT variant_ix, dose / (2 * n) AS af, n0, n1, n2, CASE WHEN t <= 0 OR t >= 1 THEN 1.0 ELSE 1 - v / m / (2 * t * (1 - t)) END AS ia, n / every AS call_rate,
      power(n0 - (1 - p) * (1 - p) * h, 2) / nullif((1 - p) * (1 - p) * h, 0) + power(n1 - 2 * p * (1 - p) * h, 2) / nullif(2 * p * (1 - p) * h, 0) + power(n2 - p * p * h, 2) / nullif(p * p * h, 0) AS hwe
      FROM (SELECT *, n0 + n1 + n2 AS h, (n1 + 2 * n2) / nullif(2 * (n0 + n1 + n2), 0) AS p, ts / (2 * m) AS t FROM (
        SELECT variant_ix, sum(w) AS every, sum(w) FILTER (WHERE dose IS NOT NULL) AS n, sum(w * dose) AS dose, coalesce(sum(w) FILTER (WHERE x = 0), 0) AS n0, coalesce(sum(w) FILTER (WHERE x = 1), 0) AS n1, coalesce(sum(w) FILTER (WHERE x = 2), 0) AS n2,
          sum(w) FILTER (WHERE g2 IS NOT NULL) AS m, sum(w * (2 * g2 + g1)) AS ts, sum(w * (4 * g2 + g1 - power(2 * g2 + g1, 2))) AS v
        FROM (SELECT c.*, w, {dip} AS x, ap1 * ap2 AS g2, ap1 * (1 - ap2) + ap2 * (1 - ap1) AS g1 FROM c JOIN ({weights}) k USING (sample_ix)) GROUP BY variant_ix))"""


LIKELIER = "CAST(ap1 > 0.5 AS INT) + CAST(ap2 > 0.5 AS INT)"
ONE = "SELECT CAST(n_nationkey AS BIGINT) AS sample_ix, 1.0::DOUBLE AS w FROM nation"
CV = {"parsed": PARSED, "g": GLAP, "d": DOSE, "c": CALLS}


def sample_weights(s: Study) -> DataFrame:
    return s.raw("nation").selectExpr("cast(n_nationkey as bigint) as sample_ix", "0.5D + n_regionkey / 4D as w")


@query(sql(f"SELECT variant_ix, {r('af', 4)} AS af, {r('hwe', 3)} AS hwe, {r('ia', 3)} AS ia, {r('call_rate')} AS call_rate FROM wq", **CV, wq=quality_sql(LIKELIER, WEIGHTS)))
def weighted_variant_quality(s):
    """Frequency, Hardy-Weinberg, accuracy and call rate with samples counted by weight."""
    q = G.quality_of(calls(s), weights=sample_weights(s))
    return q.select("variant_ix", rd(F.col("af"), 4).alias("af"), rd(F.col("hwe"), 3).alias("hwe"), rd(F.col("ia"), 3).alias("ia"), rd(F.col("call_rate")).alias("call_rate"))


MODES = {"allelic": G.Mode(), "error": G.Mode(from_error=True), "nominal": G.Mode(nominal=True), "population": G.Mode(population=True), "fixed": G.Mode(fixed=True)}
ERROR = "af * (1 - af) * (1 - rsq)"


def mode_sql(i: int) -> dict[str, str]:
    call = lambda e: f"CASE WHEN h{i} = 0 THEN {e} WHEN h{i} IS NOT NULL THEN 1 - {e} ELSE af END"
    held = lambda x: f"least(greatest({x}, 0.001), 0.999)"
    own = f"coalesce(ap{i}, af)"
    return {"allelic": held(own), "error": held(call(f"({ERROR})")), "nominal": own, "population": "af", "fixed": held(call("0.0::DOUBLE"))}


def with_rsq(s: Study, q: DataFrame) -> DataFrame:
    return s.variants().select("variant_ix", "rsq").join(q, "variant_ix").withColumn("rsq", F.coalesce("rsq", "ia"))


# the allelic probabilities of the iteration and of its limit agree to four digits
@query(sql(" UNION ALL ".join(f"SELECT variant_ix, sample_ix, '{k}' AS mode, {r(mode_sql(1)[k], 3)} AS z1, {r(mode_sql(2)[k], 3)} AS z2 FROM cq" for k in MODES), **CV, q0=quality_sql(LIKELIER, ONE), cq="SELECT c.*, af, coalesce(rsq, ia) AS rsq FROM c JOIN q0 USING (variant_ix) JOIN (SELECT variant_ix, rsq FROM variants) USING (variant_ix)"))
def prior_modes(s):
    """Priors of every haplotype in each genotype mode of a run."""
    c = calls(s)
    q = with_rsq(s, G.quality_of(c))
    return G.priors_by_mode(c, q, MODES).select("variant_ix", "sample_ix", "mode", rd(F.col("z1"), 3).alias("z1"), rd(F.col("z2"), 3).alias("z2"))


def prepared(s: Study, o: pipeline.Options, weights: DataFrame | None = None) -> pipeline.Prepared:
    v = s.variants().select("variant_ix", "chrom", "pos", "variant_id", "ref", "alt", "rsq")
    return pipeline.prepare(v, calls(s), s.as_counts(), s.offsets(), s.features().select("feature_ix", "chrom", "tss"), s.exons(), o, weights)


SET = {**CV, "wq": quality_sql("h1 + h2", WEIGHTS), "vq": "SELECT v.variant_ix, v.chrom, v.pos, v.variant_id, af, hwe, coalesce(v.rsq, ia) AS rsq FROM variants v JOIN wq USING (variant_ix)"}


@query(sql(f"SELECT f.feature_ix, v.variant_id FROM vq v JOIN features f ON v.chrom = f.chrom AND v.pos BETWEEN f.tss - {HALF} AND f.tss + {HALF} WHERE af BETWEEN {MAF} AND {1 - MAF} AND rsq > {RSQ} AND hwe < {HWE!r}", **SET))
def weighted_tested_pairs(s):
    """Tested pairs of a run from calls with their errors, in which samples count by weight."""
    o = pipeline.Options(half_window=HALF, maf=MAF, rsq=RSQ, mode=G.Mode(from_error=True))
    p = prepared(s, o, sample_weights(s))
    return pipeline.tested_pairs(p.variants, s.features().select("feature_ix", "chrom", "tss"), o).select("feature_ix", "variant_id")


DEEP = {
    **CV, "fq": quality_sql(LIKELIER, ONE), "fv": "SELECT v.variant_ix, v.chrom, v.pos, af, coalesce(v.rsq, ia) AS rsq FROM variants v JOIN fq USING (variant_ix)",
    "ex": 'SELECT DISTINCT e.feature_ix, v.variant_ix FROM fv v JOIN exons e ON v.chrom = e.chrom AND v.pos BETWEEN e."start" AND e."end" WHERE af BETWEEN 0.1 AND 0.9 AND rsq > 0.6',
    "fc": """SELECT x.feature_ix, x.variant_ix, sum((as_ref + as_alt) / k) / (any_value(t.tot) * 100 / any_value(l.len)) AS km, sum(coalesce(dose, 0) * (as_ref + as_alt) / k) / nullif(2 * sum((as_ref + as_alt) / k), 0) AS share, sum(as_ref) / nullif(sum(as_ref + as_alt), 0)::DOUBLE AS allele
      FROM ex x JOIN as_counts a USING (variant_ix) JOIN c USING (variant_ix, sample_ix) JOIN norm n ON n.feature_ix = x.feature_ix AND n.sample_ix = a.sample_ix
      JOIN (SELECT feature_ix, sum(y / k) AS tot FROM norm GROUP BY 1) t ON t.feature_ix = x.feature_ix JOIN (SELECT feature_ix, sum("end" - "start") AS len FROM exons GROUP BY 1) l ON l.feature_ix = x.feature_ix GROUP BY 1, 2""",
}


@query(sql("SELECT feature_ix, variant_ix FROM fc WHERE km > 0.2 AND share > 0.005 AND share < 0.995 AND allele > 0 AND allele < 1", **DEEP))
def feature_variant_options(s):
    """Feature variants of a run with other thresholds of frequency, quality and depth, and reads of 100 bases."""
    return prepared(s, pipeline.Options(feature_maf=0.1, feature_rsq=0.6, min_depth=0.2, read_length=100)).fsnps


@query(sql(f"SELECT variant_ix, {r('ln(p / (1 - p))')} AS logit, {r('1 / (1 + exp(-(n1 - n2)))')} AS odds FROM (SELECT variant_ix, least(greatest(af, 1e-7), 1 - 1e-7) AS p, n1, n2 FROM quality)", **QUAL))
def frequency_logit(s):
    """The logit of the allele frequency, and the expit of the surplus of heterozygotes over homozygotes of the alternative allele."""
    q = quality(s)
    return q.select("variant_ix", rd(S.logit(F.least(F.greatest(F.col("af"), F.lit(1e-7)), F.lit(1 - 1e-7)))).alias("logit"), rd(S.expit((F.col("n1") - F.col("n2")).cast("double"))).alias("odds"))


# --- covariates of a feature, trans pairs -----------------------------------------------------------------------

OWN = 'SELECT l_suppkey AS feature_ix, sample_ix, sum(l_quantity)::DOUBLE AS value FROM joined GROUP BY ALL'


def own_values(s: Study) -> DataFrame:
    """Another measure of each feature and sample."""
    return s.counted().groupBy(F.col("l_suppkey").alias("feature_ix"), "sample_ix").agg(F.sum("l_quantity").cast("double").alias("value"))


@query(sql(f"SELECT feature_ix, sample_ix, {r('ln(value + 0.01) - avg(ln(value + 0.01)) OVER (PARTITION BY feature_ix)')} AS x FROM own", own=OWN))
def feature_covariate(s):
    return fit.own_covariate(own_values(s)).select("feature_ix", "sample_ix", rd(F.col("x")).alias("x"))


@query()
def nb_glm_fit_own(s):
    """Covariate fits with a column that differs by feature."""
    s = held(s)
    return fit.glm_fit(normed(s), s.covariates(), ["x1", "x2"], fit.own_covariate(own_values(s)))


@query(sql(f"SELECT f.feature_ix, g.variant_ix FROM good g JOIN features f ON g.chrom <> f.chrom OR g.pos <= f.tss - {HALF} OR g.pos >= f.tss + {HALF}", **QUAL))
def trans_pairs(s):
    """The pairs of a trans scan: every variant that passes quality with every feature whose window it is outside of."""
    return I.outside(good(s), s.features().select("feature_ix", "chrom", "tss"), HALF).select("feature_ix", "variant_ix")


# --- checks -----------------------------------------------------------------------------------------------------

GAPS = """SELECT 'sample_missing' AS "check", CAST(feature_ix AS VARCHAR) AS subject, 25 - count(*) AS n FROM counts GROUP BY feature_ix HAVING count(*) < 25
  UNION ALL SELECT 'alleles_equal', chrom, count(*) FROM variants WHERE ref = alt GROUP BY chrom
  UNION ALL SELECT 'feature_without_counts', CAST(feature_ix AS VARCHAR), 1 FROM features WHERE feature_ix NOT IN (SELECT feature_ix FROM counts)
  UNION ALL SELECT 'allele_unknown', CAST(variant_ix AS VARCHAR), count(*) FROM parsed WHERE h1 NOT IN (0, 1) OR h2 NOT IN (0, 1) GROUP BY variant_ix
  UNION ALL SELECT 'weight_out_of_range', CAST(sample_ix AS VARCHAR), 1 FROM covariates WHERE x1 < 4500
  UNION ALL SELECT 'variant_repeated', chrom, count(*) FROM (SELECT chrom, pos, ref, alt FROM variants GROUP BY ALL HAVING count(*) > 1) GROUP BY chrom"""


@query(sql(GAPS, parsed=PARSED))
def input_checks(s):
    """All faults of the study's inputs; as weights a measure that some samples have too little of."""
    w = s.covariates().select("sample_ix", (F.col("x1") - 4500.0).alias("w"))
    return checks.study(s.offsets(), s.samples(), s.variants(), parsed(s), s.features().select("feature_ix"), s.exons(), w)


# --- fits against their likelihood ------------------------------------------------------------------------------


def priors_term(d: DataFrame) -> F.Column:
    """The logarithm of the priors at a row's parameters, with ``beta0`` the mean of beta's."""
    h = L.Hyper()
    const = L.log_prior(0.5, 0.5, 0.5, F.col("theta"), F.col("beta"), F.col("beta0"), h)
    at_half = [(h.adelta - 1, h.bdelta - 1, "delta"), (h.abpi - 1, h.abpi - 1, "pi"), (h.abphi - 1, h.abphi - 1, "phi")]
    return const + sum((a * (F.ln(c) - F.ln(F.lit(0.5))) + b * (F.ln(1 - F.col(c)) - F.ln(F.lit(0.5))) for a, b, c in at_half), F.lit(0.0))


def marginal(s: Study, fits: DataFrame, z: DataFrame, null: bool) -> DataFrame:
    """``feature_ix variant_ix joint value``: the marginal log-likelihood at the parameters of ``fits``, in expressions.

    ``fits``: feature_ix variant_ix joint pi delta phi beta theta; ``z``: variant_ix sample_ix z1 z2, or null models'
    halves where ``null``. The expressions are those of the E-step, which SQL repeats.
    """
    s = held(s)
    n = normed(s)
    base = fits.join(n, "feature_ix")
    base = base.withColumns({"z1": F.lit(0.5), "z2": F.lit(0.5)}) if null else base.join(z, ["variant_ix", "sample_ix"])
    e = L.e_step(base, reads_of_features(s), F.col("pi"), F.col("delta"), F.col("phi"), "joint").groupBy("feature_ix", "variant_ix").agg(F.sum("loglik").alias("ll"))
    start = n.groupBy("feature_ix").agg(F.ln(F.avg(F.col("y") / F.col("k"))).alias("beta0"))
    d = fits.join(e, ["feature_ix", "variant_ix"]).join(start, "feature_ix")
    return d.select("feature_ix", "variant_ix", "joint", (F.col("ll") + priors_term(d)).alias("value"))


KEPT_FEATURES = "SELECT DISTINCT feature_ix FROM kept"


@query(sql("SELECT feature_ix, 'population' AS model, true AS agrees FROM counts GROUP BY feature_ix UNION ALL SELECT feature_ix, 'joint', true FROM kf", **FEAT, kf=KEPT_FEATURES))
def null_fit_check(s):
    """Whether the log-likelihood of each null model is that of the E-step's expressions at its parameters."""
    f = nulls(s).withColumn("joint", F.col("model") == "joint").withColumn("variant_ix", F.when(F.col("joint"), -2).otherwise(-1).cast("long"))
    m = marginal(s, f.select("feature_ix", "variant_ix", "joint", "pi", "delta", "phi", "beta", "theta"), priors(s), True)
    return f.select("feature_ix", "variant_ix", "model", "loglik").join(m, ["feature_ix", "variant_ix"]).select("feature_ix", "model", (F.abs(F.col("value") - F.col("loglik")) < 1e-5).alias("agrees"))


@query(sql("SELECT t.feature_ix, t.variant_ix, true AS agrees FROM tested t WHERE t.feature_ix IN (SELECT feature_ix FROM counts)", **QUAL))
def alt_fit_check(s):
    """Whether each tested pair's ratio is twice the gain of the E-step's expressions over the matching null model."""
    s = held(s)
    z = priors(s).select("variant_ix", "sample_ix", "z1", "z2")
    f = fitted(s).select("feature_ix", "variant_ix", "joint", "pi", "delta", "phi", "beta", "theta", "lr")
    m = marginal(s, f.drop("lr"), z, False).drop("joint")
    null = nulls(s).select("feature_ix", (F.col("model") == "joint").alias("joint"), "loglik")
    d = f.join(m, ["feature_ix", "variant_ix"]).join(null, ["feature_ix", "joint"])
    return d.select("feature_ix", "variant_ix", (F.abs(2 * (F.col("value") - F.col("loglik")) - F.col("lr")) < 1e-4).alias("agrees"))


@query(sql("SELECT feature_ix, i AS coefficient, true AS flat FROM (SELECT DISTINCT feature_ix FROM counts), range(3) t(i)"))
def nb_glm_check(s):
    """Whether the slope of the covariate model's log-likelihood is flat in each coefficient at the fit."""
    x, s = ["x1", "x2"], held(s)
    n = normed(s).join(F.broadcast(s.covariates()), "sample_ix")  # a row a sample
    f = fit.glm_fit(normed(s), s.covariates(), x).select("feature_ix", "coef", "theta")
    mean = n.groupBy("feature_ix").agg(*(F.avg(c).alias(f"m_{c}") for c in x), *(F.stddev_pop(c).alias(f"s_{c}") for c in x))
    d = n.join(f, "feature_ix").join(mean, "feature_ix")
    own = [F.lit(1.0), *((F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}") for c in x)]
    coef = [F.col("coef")[0], *(F.col("coef")[i + 1] * F.col(f"s_{c}") for i, c in enumerate(x))]
    mu = F.col("k") * F.exp(sum((a * b for a, b in zip(own, coef, strict=True)), F.lit(0.0)))
    slope = F.col("y") - mu * (F.col("y") + F.col("theta")) / (mu + F.col("theta"))
    g = d.groupBy("feature_ix").agg(*(F.sum(slope * v).alias(f"g{i}") for i, v in enumerate(own)), *(F.first(c).alias(f"c{i}") for i, c in enumerate(coef)))
    flat = F.array(*(F.abs(F.col(f"g{i}") - (F.col(f"c{i}") / 1e4 if i else F.lit(0.0))) < 1e-3 for i in range(3)))
    return g.select("feature_ix", F.posexplode(flat).alias("coefficient", "flat")).select("feature_ix", F.col("coefficient").cast("bigint").alias("coefficient"), "flat")


@query(sql("SELECT 0::BIGINT AS n_wrong"))
def svd_check(s):
    """How many of the kept components aren't eigenvectors of the samples' Gram matrix of z-scores, computed in SQL terms."""
    offsets = store.written(s.offsets(), "offsets")
    gram = O.gram(O.zscores(O.per_million(offsets)).filter("z is not null"))
    c = matrix.covariates(offsets).select("sample_ix", F.posexplode("x").alias("c", "v"))
    unit = c.groupBy("c").agg(F.sum(F.col("v") * F.col("v")).alias("norm"))  # the size factor isn't of unit length, nor an eigenvector
    c = c.join(unit.filter(F.abs(F.col("norm") - 1) < 1e-6), "c").select("c", "sample_ix", "v")
    gv = gram.join(c, F.col("j") == F.col("sample_ix")).groupBy("c", "i").agg(F.sum(F.col("g") * F.col("v")).alias("gv"))
    d = gv.join(c, (gv["c"] == c["c"]) & (F.col("i") == F.col("sample_ix"))).select(gv["c"], "v", "gv")
    ray = d.groupBy("c").agg(F.sum(F.col("v") * F.col("gv")).alias("d2"), F.sum(F.col("gv") * F.col("gv")).alias("n2"))
    return ray.agg(F.count_if(F.abs(F.col("n2") - F.col("d2") * F.col("d2")) > 1e-6 * F.col("n2")).alias("n_wrong"))


def reported(s: Study) -> DataFrame:
    """A whole run: covariates, imprinting tests, and rows of features that aren't fitted."""
    s = held(s)
    v = s.variants().select("variant_ix", "chrom", "pos", "variant_id", "ref", "alt", F.coalesce("rsq", F.lit(1.0)).alias("rsq")).join(quality(s).select("variant_ix", "af", "hwe"), "variant_ix")
    o = pipeline.Options(half_window=HALF, maf=MAF, rsq=RSQ, work_limit=300, imprint=True)
    return pipeline.full_report(s.offsets(), v, s.features().select("feature_ix", "chrom", "tss"), priors(s), s.as_counts(), kept(s).select("feature_ix", "variant_ix"), o, covariates=s.covariates())


REPORTED = {
    **FEAT, "nt": "SELECT feature_ix, count(*) AS n_tested FROM tested GROUP BY 1", "nf": "SELECT feature_ix, count(*) AS n_feature FROM kept GROUP BY 1", "yt": "SELECT feature_ix, sum(y) AS tot FROM counts GROUP BY 1",
    "sz": "SELECT feature_ix, chrom, coalesce(n_tested, 0) AS n_tested, coalesce(n_feature, 0) AS n_feature, coalesce(tot, 0) AS tot FROM features LEFT JOIN nt USING (feature_ix) LEFT JOIN nf USING (feature_ix) LEFT JOIN yt USING (feature_ix)",
    "sk": "SELECT * FROM sz WHERE (n_feature + 1) * n_tested > 300 OR tot <= 0 OR n_tested = 0",
}


@query(sql(f"""SELECT t.feature_ix, t.variant_id, t.chrom, t.pos, v.ref, v.alt, {r('q.af')} AS af, {r('q.hwe', 4)} AS hwe, {r('coalesce(v.rsq, 1.0)')} AS rsq, n_tested, n_feature FROM tested t JOIN variants v USING (variant_ix) JOIN quality q USING (variant_ix) JOIN sz ON sz.feature_ix = t.feature_ix WHERE t.feature_ix NOT IN (SELECT feature_ix FROM sk)
  UNION ALL SELECT feature_ix, 'SKIPPED', chrom, -1, 'N', 'N', -1.0, -1.0, -1.0, n_tested, n_feature FROM sk
  UNION ALL SELECT feature_ix, 'AI', chrom, -1, 'N', 'N', -1.0, -1.0, -1.0, n_tested, n_feature FROM sz WHERE n_feature > 0 AND tot > 0""", **REPORTED))
def run_report(s):
    """The rows of a whole run, in the columns that no fit decides."""
    d = reported(s)
    return d.select("feature_ix", "variant_id", "chrom", "pos", "ref", "alt", *(rd(F.col(c), n).alias(c) for c, n in (("af", 6), ("hwe", 4), ("rsq", 6))), "n_tested", F.col("n_feature").cast("bigint").alias("n_feature"))


SCALED = {
    "lr": "SELECT variant_ix, sample_ix, CASE WHEN as_ref > 0 AND as_alt > 0 THEN ln(as_ref / as_alt::DOUBLE) END AS x, w FROM as_counts JOIN wt USING (sample_ix)",
    "md": "SELECT *, x - sum(w * x) OVER f / nullif(sum(w) FILTER (WHERE x IS NOT NULL) OVER f, 0) AS d, sum(w) FILTER (WHERE x IS NOT NULL) OVER f AS n FROM lr WINDOW f AS (PARTITION BY variant_ix)",
    "sd": "SELECT *, sqrt(sum(w * d * d) OVER (PARTITION BY variant_ix) / nullif(n, 0)) AS s FROM md",
}


@query(sql(f"SELECT variant_ix, sample_ix, {r('CASE WHEN d IS NOT NULL AND s > 1e-9 * greatest(1.0, abs(x - d)) THEN d / s ELSE 0.0 END')} AS z FROM sd", wt=WEIGHTS, **SCALED))
def weighted_scale(s):
    """Log allelic ratios of each variant, scaled with samples counted by weight; without reads of both alleles there is none."""
    d = s.as_counts().join(F.broadcast(sample_weights(s)), "sample_ix")  # a row a sample
    d = d.withColumn("x", F.when((F.col("as_ref") > 0) & (F.col("as_alt") > 0), F.ln(F.col("as_ref") / F.col("as_alt"))))
    return O.weighted_scale(d, "variant_ix", "x", "w").select("variant_ix", "sample_ix", rd(F.col("z")).alias("z"))


@query()
def lead_fit_report(s):
    """The best variant of each feature by the fitted ratio, with the ties resolved by distance."""
    from ..operators import report

    d = tested(s).join(fitted(s), ["feature_ix", "variant_ix"])
    return report.lead_row(report.with_q(d.drop("haplotypes")))
