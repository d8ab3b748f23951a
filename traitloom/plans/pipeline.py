"""The association run over all features at once."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import fit, intervals, report
from ..operators import genotype as G
from ..operators import offsets as O
from ..operators.likelihood import Hyper
from ..operators.matrix import permute
from ..sources import store, vcf


@dataclass(frozen=True)
class Options:
    """Thresholds and switches of a run; defaults are those of the method.

    ``only`` fits the variant of that id alone, ``random_seed`` one tested variant of each feature by a seeded hash;
    ``n_tested``, the work limit and the joint gate still count all. More tested or feature variants of a feature than
    ``max_tested`` or ``max_feature`` are an error. ``mode``, ``feature_maf``, ``feature_hwe_p``, ``feature_rsq``,
    ``min_depth`` and ``read_length`` are for ``prepare``. ``trans`` tests the variants outside the window, which move
    counts but not allelic reads. ``lead`` reports the best variant of each feature alone.
    """

    half_window: int = 540_000_000
    maf: float = 0.05
    hwe_p: float = 1e-8
    rsq: float = 0.7
    work_limit: int = 30_000
    force: bool = False
    significant: float | None = None
    population_only: bool = False
    imprint: bool = False
    permute_seed: int | None = None
    chunk: int = 64
    hyper: Hyper = field(default_factory=Hyper)
    model: fit.Model = field(default_factory=fit.Model)
    only: str | None = None
    random_seed: int | None = None
    max_tested: int | None = None
    max_feature: int | None = None
    mode: G.Mode = field(default_factory=G.Mode)
    feature_maf: float = 0.0
    feature_hwe_p: float | None = None
    feature_rsq: float = 0.0
    min_depth: float = 0.05
    read_length: int = 150
    trans: bool = False
    lead: bool = False


@dataclass
class Prepared:
    """What a run takes of genotypes: variants with af, hwe, rsq; priors; feature variants of each feature."""

    variants: DataFrame
    priors: DataFrame
    fsnps: DataFrame


def prepare(variants: DataFrame, cells: DataFrame, as_counts: DataFrame, offsets: DataFrame, features: DataFrame, exons: DataFrame, o: Options | None = None, weights: DataFrame | None = None) -> Prepared:
    """Quality, priors and feature variants by the options' genotype mode and thresholds.

    ``variants``: variant_ix chrom pos variant_id ref alt rsq (null: the imputation accuracy of the cells); ``cells``:
    variant_ix sample_ix h1 h2 ap1 ap2 dose; ``features``: feature_ix chrom tss; ``exons``: feature_ix chrom start end;
    ``weights``: sample_ix w, by which samples count in frequency, call rate, Hardy-Weinberg and accuracy.
    """
    o = o or Options()
    q = G.quality_of(cells, o.mode, weights)
    v = variants.join(q, "variant_ix").withColumn("rsq", F.coalesce("rsq", "ia"))
    cut = None if o.feature_hwe_p is None or o.mode.population else S.chisq_quantile(o.feature_hwe_p)
    fits = F.col("af").between(o.feature_maf, 1 - o.feature_maf) & (F.col("rsq") > o.feature_rsq) & (F.lit(True) if cut is None else F.col("hwe") < cut)
    exonic = intervals.points_in(v.filter(fits).select("variant_ix", "chrom", "pos"), exons, 1024).select("feature_ix", "variant_ix").distinct()
    n = O.normalise(offsets)
    length = exons.groupBy("feature_ix").agg(F.sum(F.col("end") - F.col("start")).alias("_len"))
    x = exonic.join(as_counts, "variant_ix").join(cells.select("variant_ix", "sample_ix", "dose"), ["variant_ix", "sample_ix"]).join(n.select("feature_ix", "sample_ix", "k"), ["feature_ix", "sample_ix"])
    reads = F.col("as_ref") + F.col("as_alt")
    x = x.groupBy("feature_ix", "variant_ix").agg(F.sum(reads / F.col("k")).alias("t"), F.sum(F.coalesce("dose", F.lit(0.0)) * reads / F.col("k")).alias("d"), F.sum("as_ref").alias("ref"), F.sum(reads).alias("all"))
    x = x.join(O.totals(n), "feature_ix").join(length, "feature_ix")
    share, allele = F.col("d") / F.nullif(2 * F.col("t"), F.lit(0.0)), F.col("ref") / F.nullif(F.col("all"), F.lit(0))
    x = x.filter((F.col("t") / (F.col("tot") * o.read_length / F.col("_len")) > o.min_depth) & (share > 0.005) & (share < 0.995) & (allele > 0) & (allele < 1))
    return Prepared(v, G.mode_priors(cells, v, o.mode), x.select("feature_ix", "variant_ix"))


def run_study(variants: DataFrame, cells: DataFrame, as_counts: DataFrame, offsets: DataFrame, features: DataFrame, exons: DataFrame, o: Options | None = None, sample_weights: DataFrame | None = None, **more) -> DataFrame:
    """``prepare``, then ``full_report``; ``more`` goes to the latter (dk, weights, covariates, own)."""
    p = prepare(variants, cells, as_counts, offsets, features, exons, o, sample_weights)
    return full_report(offsets, p.variants, features.select("feature_ix", "chrom", "tss"), p.priors, as_counts, p.fsnps, o, **more)


def tested_pairs(variants: DataFrame, features: DataFrame, o: Options) -> DataFrame:
    """Variants (with af, hwe, rsq) that pass quality, in the window of each feature, or outside it in a trans scan."""
    good = variants.filter(F.col("af").between(o.maf, 1 - o.maf) & (F.col("rsq") > o.rsq) & (F.lit(True) if o.mode.population else F.col("hwe") < S.chisq_quantile(o.hwe_p)))
    return (intervals.outside if o.trans else intervals.in_window)(good, features, o.half_window)


def map_traits(offsets: DataFrame, variants: DataFrame, features: DataFrame, priors: DataFrame, as_counts: DataFrame, fsnps: DataFrame, o: Options | None = None, dk: DataFrame | None = None, weights: DataFrame | None = None, covariates: DataFrame | None = None, own: DataFrame | None = None) -> DataFrame:
    """A row a tested pair: ratio, q-value, parameters and fit state. Features that ``skipped`` names give no rows.

    ``offsets``: feature_ix sample_ix y k; ``priors``: variant_ix sample_ix z1 z2; ``fsnps``: feature_ix variant_ix;
    ``dk`` (or ``covariates``: sample_ix and numbers, and ``own``: feature_ix sample_ix x, from which it is fitted) and
    ``weights``: feature_ix sample_ix and dk or w. With ``permute_seed`` each feature variant's priors, reads and offset are dealt anew among its samples,
    and a feature's counts, offsets, factors and weights together; the tested variants stay.
    """
    return associations(offsets, variants, features, priors, as_counts, fsnps, o, dk, weights, covariates, own, False)


def full_report(offsets: DataFrame, variants: DataFrame, features: DataFrame, priors: DataFrame, as_counts: DataFrame, fsnps: DataFrame, o: Options | None = None, dk: DataFrame | None = None, weights: DataFrame | None = None, covariates: DataFrame | None = None, own: DataFrame | None = None) -> DataFrame:
    """The rows of ``map_traits``, those of features that aren't fitted (``SKIPPED``) and, where ``imprint`` asks for it,
    of the imprinting test (``AI``); the latter two have no ``variant_ix``."""
    return associations(offsets, variants, features, priors, as_counts, fsnps, o, dk, weights, covariates, own, True)


def associations(offsets: DataFrame, variants: DataFrame, features: DataFrame, priors: DataFrame, as_counts: DataFrame, fsnps: DataFrame, o: Options | None, dk: DataFrame | None, weights: DataFrame | None, covariates: DataFrame | None, own: DataFrame | None, special: bool) -> DataFrame:
    o = o or Options()
    if o.trans:
        o = replace(o, model=replace(o.model, trans=True))
    if covariates is not None and dk is None:
        dk = fit.factor(fit.glm_fit(O.normalise(offsets), covariates, [c for c in covariates.columns if c != "sample_ix"], own))
    plain, mixed = O.normalise(offsets), None
    if o.permute_seed is not None:
        offsets, dk, weights = permuted_together(offsets, dk, weights, o.permute_seed)
        mixed = o.permute_seed + 1
    pairs = store.written(tested_pairs(variants, features, o), "pairs")
    used = fsnps.limit(0) if o.population_only else fsnps
    n = store.written(sizes(features, pairs, fsnps, offsets), "sizes")
    validate(n, offsets, o)
    out = skipped(n, o)
    pairs = chosen(pairs.join(out.select("feature_ix"), "feature_ix", "left_anti"), o)
    block = store.written(fit.blocks(O.normalise(offsets), used, priors, as_counts, dk, weights, mixed, plain), "blocks")
    nulls = store.written(fit.null_fit(block, o.hyper, o.imprint, o.model), "nulls")
    rows = fit.alt_fit(pairs, priors, block, nulls, o.significant, o.chunk, o.hyper, o.force, o.model, n.select("feature_ix", F.col("n_tested").alias("_n")))
    rows = store.written(rows, "fits")
    full = pairs.select("feature_ix", "variant_ix", "variant_id", "chrom", "pos", "ref", "alt", "af", "hwe", "rsq", "tss").join(rows, ["feature_ix", "variant_ix"]).join(n.select("feature_ix", "n_tested"), "feature_ix")
    full = report.with_q(full)
    if o.lead:
        full = report.lead_row(full)
    if not special:
        return full
    # a row a feature that isn't fitted, and one an imprinting test
    more = features.select("feature_ix", "chrom", "tss").join(n, "feature_ix")
    full = full.unionByName(report.special(more.join(out.select("feature_ix"), "feature_ix", "left_semi"), report.SKIPPED | {"rank": -1}, full))
    if o.imprint:
        # twice the gain over the joint null model
        ratio = nulls.groupBy("feature_ix").agg(F.max(F.when(F.col("model") == "joint", F.col("loglik"))).alias("_ll"))
        ai = nulls.filter("model = 'imprint'").join(ratio, "feature_ix").withColumn("lr", 2 * (F.col("loglik") - F.col("_ll"))).withColumn("itr_null", F.col("itr")).join(more, "feature_ix")
        full = full.unionByName(report.special(ai, report.AI | {"rank": -1, "joint": True}, full))
    return full


def write_posteriors(rows: DataFrame, p: Prepared, offsets: DataFrame, as_counts: DataFrame, path: str, o: Options | None = None) -> None:
    """Posterior genotypes at the best joint fit of each feature, as records: its feature variants, and the best variant
    itself if it is none of them. ``rows``: those of ``map_traits``; features without a joint fit have no records.

    The best variant's record is marked, and each record names its feature.
    """
    o = o or Options()
    best = report.lead_row(rows.filter("joint"))
    block = fit.blocks(O.normalise(offsets), p.fsnps, p.priors, as_counts)
    theirs = fit.feature_haplotypes(best, p.priors, block, o.hyper, o.model).select("feature_ix", F.col("feature_variant").alias("variant_ix"), "sample_ix", "z1", "z2", (F.col("feature_variant") == F.col("variant_ix")).alias("lead"))
    theirs = theirs.join(as_counts, ["variant_ix", "sample_ix"], "left")
    ids = block.select("feature_ix", F.posexplode("sample_ix").alias("_i", "sample_ix"))
    mine = best.join(p.fsnps, ["feature_ix", "variant_ix"], "left_anti").select("feature_ix", "variant_ix", F.posexplode("haplotypes").alias("_h", "_z"))
    mine = mine.groupBy("feature_ix", "variant_ix", F.floor(F.col("_h") / 2).cast("int").alias("_i")).agg(F.max(F.when(F.col("_h") % 2 == 0, F.col("_z"))).alias("z1"), F.max(F.when(F.col("_h") % 2 == 1, F.col("_z"))).alias("z2"))
    mine = mine.join(ids, ["feature_ix", "_i"]).select("feature_ix", "variant_ix", "sample_ix", "z1", "z2", F.lit(True).alias("lead"), F.lit(0).cast("bigint").alias("as_ref"), F.lit(0).cast("bigint").alias("as_alt"))
    cells = theirs.select(*mine.columns).unionByName(mine).join(p.variants.select("variant_ix", "chrom", "pos", "variant_id", "ref", "alt"), "variant_ix")
    vcf.write_posterior(cells.withColumn("filter", F.when(F.col("lead"), "LEAD_QTL_SNP").otherwise(".")).withColumn("info", F.concat(F.lit("FID="), F.col("feature_ix").cast("string"), F.lit(";RSQ=1.0"))), path)


def permuted(offsets: DataFrame, dk: DataFrame | None, seed: int) -> tuple[DataFrame, DataFrame | None]:
    """Counts, offsets and ``dk`` of each feature dealt anew among its samples, together."""
    return permuted_together(offsets, dk, None, seed)[:2]


def permuted_together(offsets: DataFrame, dk: DataFrame | None, weights: DataFrame | None, seed: int) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Counts, offsets, ``dk`` and weights (where given) of each feature dealt anew among its samples, together."""
    keys, values, d = ["feature_ix", "sample_ix"], ["y", "k"], offsets
    for more, c in ((dk, "dk"), (weights, "w")):
        if more is not None:
            d, values = d.join(more.select(*keys, c), keys, "left").fillna(1.0, [c]), [*values, c]
    d = permute(d, ["feature_ix"], "sample_ix", values, seed)
    return d.select(*keys, "y", "k"), *(d.select(*keys, c) if c in values else None for c in ("dk", "w"))


def sizes(features: DataFrame, pairs: DataFrame, fsnps: DataFrame, offsets: DataFrame) -> DataFrame:
    """``feature_ix n_tested n_feature tot``: tested and feature variants and reads of every feature."""
    n = pairs.groupBy("feature_ix").agg(F.count("*").alias("n_tested"))
    m = fsnps.groupBy("feature_ix").agg(F.count("*").cast("int").alias("n_feature"))
    t = offsets.groupBy("feature_ix").agg(F.sum("y").cast("double").alias("tot"))
    return features.select("feature_ix").join(n, "feature_ix", "left").join(m, "feature_ix", "left").join(t, "feature_ix", "left").na.fill(0)


def skipped(n: DataFrame, o: Options) -> DataFrame:
    """Of ``sizes`` the features that aren't fitted: beyond the work limit unless forced, without reads, or without tests."""
    much = F.lit(False) if o.force else (F.col("n_feature") + 1) * F.col("n_tested") > o.work_limit
    return n.filter(much | (F.col("tot") <= 0) | (F.col("n_tested") == 0))


def validate(n: DataFrame, offsets: DataFrame, o: Options) -> None:
    """A ``ValueError`` for a run without samples or features, or with more variants of a feature than the options allow."""
    if offsets.isEmpty():
        raise ValueError("no samples")
    most = n.agg(F.count("*").alias("features"), F.max("n_tested").alias("n_tested"), F.max("n_feature").alias("n_feature")).first()
    if not most["features"]:
        raise ValueError("no features")
    for column, limit in (("n_tested", o.max_tested), ("n_feature", o.max_feature)):
        if limit is not None and most[column] > limit:
            raise ValueError(f"{column}: {most[column]} in a feature, more than {limit}")


def chosen(pairs: DataFrame, o: Options) -> DataFrame:
    """The tested pairs that are fitted: all, those of one variant, or one of each feature by a seeded hash."""
    if o.only is not None:
        pairs = pairs.filter(F.col("variant_id") == o.only)
    if o.random_seed is not None:
        key = F.struct(F.md5(F.concat_ws(":", F.lit(str(o.random_seed)), "feature_ix", "variant_ix")).alias("h"), *pairs.columns)
        pairs = pairs.groupBy("feature_ix").agg(F.min(key).alias("_k")).select("_k.*").select(*pairs.columns)
    return pairs
