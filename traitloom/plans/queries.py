"""Operators as queries over the adapter's tables, each beside SQL that gives the same rows in another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import genotype as G
from ..operators import intervals as I
from ..operators import likelihood as L
from ..operators import offsets as O
from ..operators import reads as R
from ..operators import report as P
from ..sources import store
from ..sources.adapter import Study
from .oracle import VIEWS, lbeta, lgamma, r, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
HALF = 3000
MAF, HWE, RSQ = 0.3, S.chisq_quantile(1e-8), 0.7
PI, DELTA, PHI = 0.6, 0.01, 0.5
rd = S.rounded


def query(oracle: str | None = None):
    def add(f: Callable[[Study], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Study(spark, sf_dir))
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


#: Tables and fits that were written, by application, tables and kind.
_written: dict[tuple[str, str, str], DataFrame] = {}


def once(s: Study, kind: str, make):
    """What ``make`` gives, made once a session and study and read from then on: minutes of fits serve several queries."""
    key = (s.spark.sparkContext.applicationId, s.sf_dir, kind)
    if key not in _written:
        _written[key] = store.written(make(), kind)
    return _written[key]


class Held(Study):
    """A study whose tables are written once a session: each join of the fits' inputs is a job of its own.

    In one job the lines' join would run a dozen times side by side, with more sorts at once than tasks have memory for. The
    tables meet others by shuffles, as they grow with the input.
    """

    def held(self, kind: str, make):
        return once(self, f"study-{kind}", make).hint("merge")


def held(s: Study) -> Held:
    return s if isinstance(s, Held) else Held(s.spark, s.sf_dir)


# --- scans and lookups ------------------------------------------------------------------------------------------


@query(sql("SELECT variant_ix, variant_id, pos, ref, alt FROM variants WHERE chrom = 'chr1' AND pos BETWEEN 5000 AND 9000"))
def region_scan(s):
    return s.variants().filter("chrom = 'chr1' and pos between 5000 and 9000").select("variant_ix", "variant_id", "pos", "ref", "alt")


@query(sql("SELECT chrom, count(*) AS n_variants FROM variants GROUP BY chrom"))
def chrom_list(s):
    return s.variants().groupBy("chrom").agg(F.count("*").alias("n_variants"))


@query(sql("SELECT sample_ix, y FROM counts WHERE feature_ix = 3"))
def feature_row_lookup(s):
    return s.counts().filter("feature_ix = 3").select("sample_ix", "y")


@query(sql("SELECT variant_ix, chrom, pos FROM variants WHERE variant_id IN ('rs7', 'rs42', 'rs111')"))
def rsnp_lookup(s):
    return s.variants().filter(F.col("variant_id").isin("rs7", "rs42", "rs111")).select("variant_ix", "chrom", "pos")


@query(sql("SELECT sample_ix, regexp_extract('/data/bam/' || sample_id || '.bam', '([^/]+)\\.bam$', 1) AS sample_name FROM samples"))
def sample_name(s):
    path = F.concat(F.lit("/data/bam/"), F.col("sample_id"), F.lit(".bam"))
    return s.samples().select("sample_ix", F.regexp_extract(path, r"([^/]+)\.bam$", 1).alias("sample_name"))


@query(sql("SELECT variant_ix, CASE WHEN length(alt) > 1 OR alt = '-' OR length(ref) > 1 THEN '0' ELSE ref END AS a1, CASE WHEN length(alt) > 1 OR alt = '-' THEN '1' ELSE alt END AS a2 FROM variants"))
def marker_alleles(s):
    a, b = G.marker_alleles(F.col("ref"), F.col("alt"))
    return s.variants().select("variant_ix", a.alias("a1"), b.alias("a2"))


@query(sql("SELECT feature_ix, 1398 + 0 * feature_ix AS eff_len, 2 + 0 * feature_ix AS n_exons, 2000 * feature_ix + 100 AS first_start FROM features"))
def feature_exons(s):
    length = F.aggregate("exons", F.lit(0).cast("bigint"), lambda a, e: a + e["end"] - e["start"])
    return s.features().select("feature_ix", length.alias("eff_len"), F.size("exons").cast("bigint").alias("n_exons"), F.col("exons")[0]["start"].alias("first_start"))


@query(sql("""SELECT assay, min_insert, max_insert, count(*) AS n_fragments, count(*) FILTER (WHERE abs(tlen) BETWEEN min_insert AND max_insert) AS n_within
  FROM (VALUES ('atac', 37::BIGINT, 10000::BIGINT), ('rna', 37, 2473537), ('other', 1, 270000000)) t(assay, min_insert, max_insert), alignments WHERE mate = 1 GROUP BY ALL"""))
def assay_bounds(s):
    """Fragments within the insert sizes of each assay."""
    size = F.abs("tlen")
    d = s.alignments().filter("mate = 1").agg(F.count("*").alias("n"), *(F.count_if(size.between(*b)).alias(k) for k, b in R.INSERTS.items()))
    return d.select(F.explode(F.array(*(F.struct(F.lit(k).alias("assay"), F.lit(a).cast("long").alias("min_insert"), F.lit(b).cast("long").alias("max_insert"), F.col("n").alias("n_fragments"), F.col(k).alias("n_within")) for k, (a, b) in R.INSERTS.items()))).alias("x")).select("x.*")


# --- counts, offsets, covariates --------------------------------------------------------------------------------


@query(sql(f"SELECT sample_ix, {r('sf', 9)} AS sf FROM size_factor"))
def size_factor(s):
    return O.size_factor(s.counts()).select("sample_ix", rd(F.col("sf"), 9).alias("sf"))


@query(sql(f"SELECT feature_ix, sample_ix, {r('sf', 9)} AS k FROM counts JOIN size_factor USING (sample_ix)"))
def make_offset(s):
    return O.make_offset(s.counts()).select("feature_ix", "sample_ix", rd(F.col("k"), 9).alias("k"))


@query(sql(f"SELECT feature_ix, sample_ix, {r('k', 9)} AS k FROM norm"))
def offset_normalise(s):
    return O.normalise(s.offsets()).select("feature_ix", "sample_ix", rd(F.col("k"), 9).alias("k"))


@query(sql(f"SELECT sample_ix, {r('x1 - avg(x1) OVER ()')} AS x1, {r('x2 - avg(x2) OVER ()')} AS x2 FROM covariates"))
def covariate_center(s):
    return O.center(s.covariates(), "x1", "x2").select("sample_ix", rd(F.col("x1")).alias("x1"), rd(F.col("x2")).alias("x2"))


@query(sql(f"SELECT feature_ix, {r('sum(y / k)')} AS tot FROM norm GROUP BY feature_ix"))
def feature_totals(s):
    return O.totals(O.normalise(s.offsets())).select("feature_ix", rd(F.col("tot")).alias("tot"))


@query(sql(f"SELECT feature_ix, {r('avg(k)')} AS mean, {r('stddev_pop(k)')} AS sd, {r('avg(ln(k))')} AS lmean, {r('stddev_pop(ln(k))')} AS lsd, {r('sum(y * k) / sum(y)')} AS wmean, {r('sum(y * k * k) / sum(y) - (sum(y * k) / sum(y)) * (sum(y * k) / sum(y))')} AS wvar FROM norm GROUP BY feature_ix"))
def offset_stats(s):
    d = O.offset_stats(O.normalise(s.offsets()))
    return d.select("feature_ix", *(rd(F.col(c)).alias(c) for c in ("mean", "sd", "lmean", "lsd", "wmean", "wvar")))


MOMENTS = "SELECT feature_ix, ln(mu) AS beta, least(greatest(CASE WHEN mu * mu / nullif(va - mu, 0) < 0 THEN 34.0 ELSE mu * mu / nullif(va - mu, 0) END, 0.001), 1000.0) AS theta FROM (SELECT feature_ix, avg(y / k) AS mu, var_pop(y / k) AS va FROM norm GROUP BY feature_ix)"


@query(sql(f"SELECT feature_ix, {r('beta')} AS beta, {r('theta', 4)} AS theta FROM moments", moments=MOMENTS))
def nb_moment_init(s):
    return O.moment_init(O.normalise(s.offsets())).select("feature_ix", rd(F.col("beta")).alias("beta"), rd(F.col("theta"), 4).alias("theta"))


@query(sql(f"SELECT feature_ix, {r('regr_slope(z, x1)', 9)} AS slope, {r('regr_intercept(z, x1)')} AS intercept FROM (SELECT feature_ix, ln((y + 1) / k) AS z, x1 FROM norm JOIN covariates USING (sample_ix)) GROUP BY feature_ix"))
def olm_slope(s):
    d = O.log_linear(O.normalise(s.offsets()), s.covariates())
    return d.select("feature_ix", rd(F.col("slope"), 9).alias("slope"), rd(F.col("intercept")).alias("intercept"))


FPM = "SELECT feature_ix, sample_ix, (y / k + 1) / sum(y / k) OVER (PARTITION BY sample_ix) * 1e6 AS fpm FROM offsets"
Z = "SELECT feature_ix, sample_ix, (ln(fpm) - avg(ln(fpm)) OVER w) / nullif(stddev_samp(ln(fpm)) OVER w, 0) AS z FROM fpm WINDOW w AS (PARTITION BY feature_ix)"


@query(sql(f"SELECT feature_ix, sample_ix, {r('fpm', 4)} AS fpm FROM fpm", fpm=FPM))
def log_fpm(s):
    return O.per_million(s.offsets()).select("feature_ix", "sample_ix", rd(F.col("fpm"), 4).alias("fpm"))


@query(sql(f"SELECT feature_ix, sample_ix, {r('z')} AS z FROM z", fpm=FPM, z=Z))
def row_zscore(s):
    return O.zscores(O.per_million(s.offsets())).select("feature_ix", "sample_ix", rd(F.col("z")).alias("z"))


@query(sql(f"SELECT a.sample_ix AS i, b.sample_ix AS j, {r('sum(a.z * b.z)')} AS g FROM z a JOIN z b USING (feature_ix) GROUP BY 1, 2", fpm=FPM, z=Z))
def gram_matrix(s):
    return O.gram(O.zscores(O.per_million(s.offsets()))).select("i", "j", rd(F.col("g")).alias("g"))


BINNED = "SELECT feature_ix, gc, CAST(greatest(ceil((rank - 1) * 200 / greatest(n - 1, 1)), 1) AS BIGINT) - 1 AS bin FROM (SELECT feature_ix, gc, row_number() OVER (ORDER BY gc, feature_ix) AS rank, count(*) OVER () AS n FROM gc)"


@query(sql("SELECT feature_ix, bin FROM binned", binned=BINNED))
def gc_bins(s):
    return O.gc_bins(s.gc()).select("feature_ix", "bin")


@query(sql(f"SELECT bin, sample_ix, {r('ln(s / sum(s) OVER (PARTITION BY sample_ix) / sum(s) OVER (PARTITION BY bin) * sum(s) OVER ())')} AS rate FROM (SELECT bin, sample_ix, sum(y) AS s FROM counts JOIN binned USING (feature_ix) GROUP BY ALL)", binned=BINNED))
def gc_bin_rate(s):
    return O.bin_rates(s.counts(), O.gc_bins(s.gc())).select("bin", "sample_ix", rd(F.col("rate")).alias("rate"))


@query(sql(f"""SELECT x.feature_ix, {r('x.gc')} AS gc, {r('CASE WHEN m > 1 THEN a + (b - a) / (m + 1) * row_number() OVER (PARTITION BY x.gc ORDER BY x.feature_ix) ELSE x.gc END')} AS spread
  FROM gc x JOIN (SELECT gc, m, coalesce((lag(gc) OVER (ORDER BY gc) + gc) / 2, gc) AS a, coalesce((lead(gc) OVER (ORDER BY gc) + gc) / 2, gc) AS b FROM (SELECT gc, count(*) AS m FROM gc GROUP BY gc)) t ON x.gc = t.gc"""))
def spread_ties(s):
    d = O.spread_ties(s.gc(), "gc", "feature_ix")
    return d.select("feature_ix", rd(F.col("gc")).alias("gc"), rd(F.col("spread")).alias("spread"))


@query(sql(f"SELECT feature_ix, sample_ix, y, {r('k', 9)} AS k, 1.0 AS weight, {r('x1 - (SELECT avg(x1) FROM covariates)')} AS x1, {r('x2 - (SELECT avg(x2) FROM covariates)')} AS x2 FROM norm JOIN covariates USING (sample_ix)"))
def model_matrix(s):
    x = O.center(s.covariates(), "x1", "x2")
    d = O.normalise(s.offsets()).join(x, "sample_ix")
    return d.select("feature_ix", "sample_ix", "y", rd(F.col("k"), 9).alias("k"), F.lit(1.0).alias("weight"), rd(F.col("x1")).alias("x1"), rd(F.col("x2")).alias("x2"))


# --- variant quality --------------------------------------------------------------------------------------------

QUALITY = """SELECT variant_ix, dose / (2.0::DOUBLE * n) AS af, n0, n1, n2, n,
  power(n0 - (1 - p) * (1 - p) * n, 2) / nullif((1 - p) * (1 - p) * n, 0) + power(n1 - 2 * p * (1 - p) * n, 2) / nullif(2 * p * (1 - p) * n, 0) + power(n2 - p * p * n, 2) / nullif(p * p * n, 0) AS hwe
  FROM (SELECT variant_ix, CAST(sum(h1 + h2) AS BIGINT) AS dose, count(*) AS n, count(*) FILTER (WHERE h1 + h2 = 0) AS n0, count(*) FILTER (WHERE h1 + h2 = 1) AS n1, count(*) FILTER (WHERE h1 + h2 = 2) AS n2,
    sum(h1 + h2) / (2.0::DOUBLE * count(*)) AS p FROM genotypes GROUP BY variant_ix)"""
ROLES = f"""SELECT v.variant_ix, v.chrom, v.pos, v.variant_id, q.af, q.hwe, coalesce(v.rsq, 1.0) AS rsq FROM variants v JOIN quality q USING (variant_ix)"""
GOOD = f"SELECT * FROM roles WHERE af BETWEEN {MAF} AND {1 - MAF} AND rsq > {RSQ} AND hwe < {HWE!r}"
TESTED = f"SELECT f.feature_ix, g.variant_ix, g.variant_id, g.chrom, g.pos, f.tss FROM good g JOIN features f ON g.chrom = f.chrom AND g.pos BETWEEN f.tss - {HALF} AND f.tss + {HALF}"
QUAL = {"quality": QUALITY, "roles": ROLES, "good": GOOD, "tested": TESTED}


def quality(s: Study) -> DataFrame:
    return s.held("quality", lambda: G.variant_quality(s.genotypes()))


def roles(s: Study) -> DataFrame:
    return s.variants().join(quality(s), "variant_ix").select("variant_ix", "chrom", "pos", "variant_id", "af", "hwe", F.coalesce("rsq", "ia").alias("rsq"))


def good(s: Study) -> DataFrame:
    return roles(s).filter(F.col("af").between(MAF, 1 - MAF) & (F.col("rsq") > RSQ) & (F.col("hwe") < HWE))


def tested(s: Study, half: int = HALF) -> DataFrame:
    return s.held(f"tested-{half}", lambda: I.in_window(good(s), s.features(), half).select("feature_ix", "variant_ix", "variant_id", "chrom", "pos", "tss"))


def exonic(s: Study) -> DataFrame:
    """Feature variants: reads of either allele, in an exon of the feature."""
    has = s.as_counts().groupBy("variant_ix").agg(F.sum(F.col("as_ref") + F.col("as_alt")).alias("ase")).filter("ase > 0")
    v = I.points_in(roles(s), s.exons(), 1024)
    return v.join(has, "variant_ix").select("feature_ix", "variant_ix", "chrom", "pos", "af")


EXONIC = "SELECT e.feature_ix, v.variant_ix, v.chrom, v.pos, v.af FROM roles v JOIN exons e ON v.chrom = e.chrom AND v.pos BETWEEN e.\"start\" AND e.\"end\" WHERE v.variant_ix IN (SELECT variant_ix FROM as_counts GROUP BY 1 HAVING sum(as_ref + as_alt) > 0)"
COVER = """SELECT x.feature_ix, x.variant_ix, sum((as_ref + as_alt) / k) / (t.tot * 150 / 1398) AS km, sum((h1 + h2) * (as_ref + as_alt) / k) / nullif(sum(2 * (as_ref + as_alt) / k), 0) AS asgaf,
  sum(as_ref) / nullif(sum(as_ref + as_alt), 0)::DOUBLE AS asaf
  FROM exonic x JOIN as_counts a USING (variant_ix) JOIN genotypes g USING (variant_ix, sample_ix) JOIN norm n ON n.feature_ix = x.feature_ix AND n.sample_ix = a.sample_ix
  JOIN (SELECT feature_ix, sum(y / k) AS tot FROM norm GROUP BY 1) t ON t.feature_ix = x.feature_ix GROUP BY x.feature_ix, x.variant_ix, t.tot"""
KEPT = "SELECT * FROM cover WHERE km > 0.05 AND asgaf > 0.005 AND asgaf < 0.995 AND asaf > 0 AND asaf < 1"
FEAT = QUAL | {"exonic": EXONIC, "cover": COVER, "kept": KEPT}


def normed(s: Study) -> DataFrame:
    return s.held("normed", lambda: O.normalise(s.offsets()))


def coverage(s: Study, read_length: int = 150) -> DataFrame:
    """A feature variant's share of the feature's reads for its length, and its allele shares by reads."""
    n = normed(s)
    length = s.features().select("feature_ix", F.aggregate("exons", F.lit(0).cast("bigint"), lambda a, e: a + e["end"] - e["start"]).alias("eff_len"))
    x = exonic(s).select("feature_ix", "variant_ix").join(s.as_counts(), "variant_ix").join(s.genotypes(), ["variant_ix", "sample_ix"]).join(n, ["feature_ix", "sample_ix"])
    t = (F.col("as_ref") + F.col("as_alt")) / F.col("k")
    g = x.groupBy("feature_ix", "variant_ix").agg(F.sum(t).alias("t"), F.sum((F.col("h1") + F.col("h2")) * t).alias("gt"), F.sum("as_ref").alias("ref"), F.sum(F.col("as_ref") + F.col("as_alt")).alias("all"))
    g = g.join(O.totals(n), "feature_ix").join(length, "feature_ix")
    return g.select("feature_ix", "variant_ix", (F.col("t") / (F.col("tot") * read_length / F.col("eff_len"))).alias("km"), (F.col("gt") / F.nullif(2 * F.col("t"), F.lit(0.0))).alias("asgaf"), (F.col("ref") / F.nullif(F.col("all"), F.lit(0))).alias("asaf"))


def kept(s: Study) -> DataFrame:
    return s.held("kept", lambda: coverage(s).filter("km > 0.05 and asgaf > 0.005 and asgaf < 0.995 and asaf > 0 and asaf < 1"))


@query(sql(f"SELECT variant_ix, {r('af')} AS af FROM quality", **QUAL))
def allele_freq(s):
    return quality(s).select("variant_ix", rd(F.col("af")).alias("af"))


@query(sql(f"SELECT variant_ix, n0, n1, n2, {r('hwe')} AS hwe FROM quality", **QUAL))
def hwe_chisq(s):
    return quality(s).select("variant_ix", "n0", "n1", "n2", rd(F.col("hwe")).alias("hwe"))


@query(sql("SELECT variant_ix, 1.0::DOUBLE AS call_rate FROM quality", **QUAL))
def call_rate(s):
    return quality(s).select("variant_ix", "call_rate")


def priors(s: Study) -> DataFrame:
    """``variant_ix sample_ix z1 z2``: hard calls softened by the variant's imputation quality."""
    q = roles(s).select("variant_ix", "af", "rsq")
    z = lambda h: G.z_prior(F.lit(None), F.col(h), F.col("af"), F.col("rsq"))
    return s.held("priors", lambda: s.genotypes().join(q, "variant_ix").select("variant_ix", "sample_ix", "h1", "h2", z("h1").alias("z1"), z("h2").alias("z2")))


PRIORS = """SELECT variant_ix, sample_ix, h1, h2, least(greatest(CASE WHEN h1 = 0 THEN ep ELSE 1 - ep END, 0.001), 0.999) AS z1, least(greatest(CASE WHEN h2 = 0 THEN ep ELSE 1 - ep END, 0.001), 0.999) AS z2
  FROM (SELECT g.*, af * (1 - af) * (1 - rsq) AS ep FROM genotypes g JOIN roles USING (variant_ix))"""
PRI = FEAT | {"priors": PRIORS}


@query(sql(f"SELECT variant_ix, sample_ix, {r('z1')} AS z1, {r('z2')} AS z2 FROM priors", **PRI))
def z_prior(s):
    return priors(s).select("variant_ix", "sample_ix", rd(F.col("z1")).alias("z1"), rd(F.col("z2")).alias("z2"))


@query(sql(f"""SELECT variant_ix, {r('CASE WHEN t <= 0 OR t >= 1 THEN 1 ELSE 1 - v / (2 * t * (1 - t)) END')} AS ia FROM (SELECT variant_ix, avg(4 * g2 + g1 - (2 * g2 + g1) * (2 * g2 + g1)) AS v, avg(2 * g2 + g1) / 2 AS t
  FROM (SELECT variant_ix, z1 * z2 AS g2, z1 * (1 - z2) + z2 * (1 - z1) AS g1 FROM priors) GROUP BY variant_ix)""", **PRI))
def imputation_accuracy(s):
    return G.imputation_accuracy(priors(s)).select("variant_ix", rd(F.col("ia")).alias("ia"))


@query(sql(f"SELECT a.variant_ix AS a, b.variant_ix AS b, {r('corr((a.h1 + a.h2)::DOUBLE, (b.h1 + b.h2)::DOUBLE)')} AS r FROM genotypes a JOIN genotypes b ON b.variant_ix = a.variant_ix + 1 AND a.sample_ix = b.sample_ix GROUP BY ALL"))
def ld_r(s):
    v = s.variants()
    pairs = v.select(F.col("variant_ix").alias("a"), (F.col("variant_ix") + 1).alias("b"))
    return G.ld(s.genotypes(), pairs).select("a", "b", rd(F.col("r")).alias("r"))


@query(sql(f"SELECT variant_ix, {r('af')} AS af, {r('hwe')} AS hwe FROM good", **QUAL))
def rsnp_filter(s):
    return good(s).select("variant_ix", rd(F.col("af")).alias("af"), rd(F.col("hwe")).alias("hwe"))


@query(sql("SELECT feature_ix, variant_ix FROM exonic", **FEAT))
def fsnp_filter(s):
    return exonic(s).select("feature_ix", "variant_ix")


@query(sql(f"SELECT feature_ix, variant_ix, {r('km')} AS km, {r('asgaf')} AS asgaf, {r('asaf')} AS asaf FROM cover", **FEAT))
def fsnp_coverage(s):
    return coverage(s).select("feature_ix", "variant_ix", *(rd(F.col(c)).alias(c) for c in ("km", "asgaf", "asaf")))


@query(sql("SELECT feature_ix, variant_ix FROM kept", **FEAT))
def fsnp_coverage_filter(s):
    return kept(s).select("feature_ix", "variant_ix")


@query(sql("""SELECT coalesce(t.feature_ix, k.feature_ix) AS feature_ix, coalesce(t.variant_ix, k.variant_ix) AS variant_ix, t.variant_ix IS NOT NULL AS is_tested, k.variant_ix IS NOT NULL AS is_feature
  FROM tested t FULL JOIN kept k ON t.feature_ix = k.feature_ix AND t.variant_ix = k.variant_ix""", **FEAT))
def snp_roles(s):
    both = tested(s).select("feature_ix", "variant_ix", F.lit(1).alias("t"), F.lit(0).alias("f")).unionByName(kept(s).select("feature_ix", "variant_ix", F.lit(0).alias("t"), F.lit(1).alias("f")))
    return both.groupBy("feature_ix", "variant_ix").agg((F.max("t") == 1).alias("is_tested"), (F.max("f") == 1).alias("is_feature"))


SIZES = "SELECT f.feature_ix, coalesce(n, 0) AS n_tested, coalesce(m, 0) AS n_feature, coalesce(tot, 0) AS tot FROM features f LEFT JOIN (SELECT feature_ix, count(*) AS n FROM tested GROUP BY 1) USING (feature_ix) LEFT JOIN (SELECT feature_ix, count(*) AS m FROM kept GROUP BY 1) USING (feature_ix) LEFT JOIN (SELECT feature_ix, sum(y / k) AS tot FROM norm GROUP BY 1) USING (feature_ix)"


def work(s: Study) -> DataFrame:
    n = tested(s).groupBy("feature_ix").agg(F.count("*").alias("n_tested"))
    m = kept(s).groupBy("feature_ix").agg(F.count("*").alias("n_feature"))
    d = s.features().select("feature_ix").join(n, "feature_ix", "left").join(m, "feature_ix", "left").join(O.totals(O.normalise(s.offsets())), "feature_ix", "left")
    return d.na.fill(0)


@query(sql("SELECT feature_ix, n_tested, n_feature, (n_feature + 1) * n_tested > 400 OR tot <= 0 OR n_tested = 0 AS skipped FROM sizes", **FEAT, sizes=SIZES))
def skipped_features(s):
    d = work(s)
    return d.select("feature_ix", "n_tested", "n_feature", (((F.col("n_feature") + 1) * F.col("n_tested") > 400) | (F.col("tot") <= 0) | (F.col("n_tested") == 0)).alias("skipped"))


@query(sql(f"SELECT DISTINCT v.variant_ix, v.chrom, v.pos FROM variants v JOIN features f ON v.chrom = f.chrom AND v.pos BETWEEN f.tss - 500 AND f.tss + 500"))
def cis_window(s):
    w = s.features().select("chrom", (F.col("tss") - 500).alias("start"), (F.col("tss") + 500).alias("end"))
    return I.in_any(s.variants(), w, 1000).select("variant_ix", "chrom", "pos")


@query(sql("SELECT variant_ix, chrom, pos FROM variants WHERE chrom <> 'chr1' OR pos <= 9999 - 3000 OR pos >= 9999 + 3000"))
def trans_window(s):
    return s.variants().filter(I.outside_window(F.col("chrom"), F.col("pos"), F.lit("chr1"), F.lit(9999), 3000)).select("variant_ix", "chrom", "pos")


@query(sql("SELECT variant_ix, chrom, pos FROM variants v WHERE EXISTS (SELECT 1 FROM exons e WHERE e.chrom = v.chrom AND v.pos BETWEEN e.\"start\" AND e.\"end\")"))
def exon_semi_join(s):
    return I.in_any(s.variants(), s.exons(), 1024).select("variant_ix", "chrom", "pos")


@query(sql(f"SELECT feature_ix, variant_ix, pos - tss AS distance FROM variants v JOIN features f ON v.chrom = f.chrom AND v.pos BETWEEN f.tss - {HALF} AND f.tss + {HALF}"))
def cis_window_join(s):
    return I.in_window(s.variants(), s.features(), HALF).select("feature_ix", "variant_ix", (F.col("pos") - F.col("tss")).alias("distance"))


@query(sql("SELECT t.feature_ix, t.variant_ix AS tested_ix, k.variant_ix AS feature_variant, t.variant_ix = k.variant_ix AS same FROM tested t JOIN kept k USING (feature_ix)", **FEAT))
def rsnp_fsnp_pairs(s):
    k = kept(s).select("feature_ix", F.col("variant_ix").alias("feature_variant"))
    return tested(s).select("feature_ix", F.col("variant_ix").alias("tested_ix")).join(k, "feature_ix").withColumn("same", F.col("tested_ix") == F.col("feature_variant"))
