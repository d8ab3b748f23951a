"""Genotype parsing, allelic probabilities, variant quality and priors as projections and aggregates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

#: Haplotypes of the tested and of the feature variant in each of the ten diplotype states.
STATES = [(0, "00", "00"), (1, "00", "01"), (2, "00", "11"), (3, "10", "00"), (4, "10", "01"), (5, "10", "10"), (6, "10", "11"), (7, "11", "00"), (8, "11", "01"), (9, "11", "11")]


def parse_info(info: Column) -> Column:
    """Struct (vt, rsq, af, cer) of an INFO string; of keys that set the same value the last wins, absent ones are null."""
    start = F.struct(F.lit(None).cast("string").alias("vt"), *(F.lit(None).cast("double").alias(c) for c in ("rsq", "af", "cer")))

    def step(a: Column, t: Column) -> Column:
        key, value = F.substring_index(t, "=", 1), F.regexp_extract(t, "=(.*)$", 1)
        imp = F.split(value, ",")
        number = lambda x: x.try_cast("double")
        is_imp = key == "IMP2"
        return F.struct(
            F.when(key == "VT", value).otherwise(a["vt"]).alias("vt"),
            F.when(key.isin("RSQ", "DR2"), number(value)).when(is_imp, number(F.try_element_at(imp, F.lit(2)))).otherwise(a["rsq"]).alias("rsq"),
            F.when(key == "AF", number(value)).when(is_imp, number(F.try_element_at(imp, F.lit(1)))).otherwise(a["af"]).alias("af"),
            F.when(is_imp, number(F.try_element_at(imp, F.lit(3)))).otherwise(a["cer"]).alias("cer"),
        )

    return F.aggregate(F.split(info, ";"), start, step)


def field(fmt: Column, cell: Column, *names: str) -> Column:
    """The subfield of a cell that FORMAT gives the first present of these names; null if absent or empty."""
    keys, values = F.split(fmt, ":"), F.split(cell, ":")
    found = [F.when(F.array_position(keys, n) > 0, F.try_element_at(values, F.array_position(keys, n).cast("int"))) for n in names]
    value = F.coalesce(*found)
    return F.when(value != "", value)


def numbers(x: Column) -> Column:
    return F.transform(F.split(x, ","), lambda v: v.try_cast("double"))


def hard_call(gt: Column, i: int) -> Column:
    """Allele ``i`` (0, 1) of a genotype such as 0|1; null if missing."""
    return F.try_element_at(F.split(gt, r"[|/]"), F.lit(i + 1)).try_cast("int")


def probabilities(gp: Column) -> Column:
    """Genotype probabilities held within [1e-5, 1] and scaled to one."""
    return S.to_one(F.transform(numbers(gp), lambda x: S.clamp(x, 1e-5, 1.0)))


def likelihoods(gl: Column) -> Column:
    """Genotype probabilities from their log10 likelihoods, scaled to one."""
    return S.to_one(F.transform(numbers(gl), lambda x: F.pow(F.lit(10.0), x)))


def allelic(ap: Column, i: int) -> Column:
    """Allele probability ``i`` from log10; -5 and below are zero."""
    x = F.try_element_at(numbers(ap), F.lit(i + 1))
    return F.when(x <= -5, 0.0).otherwise(F.pow(F.lit(10.0), x))


def gt2ap(h: Column) -> Column:
    return F.when(h == 0, 0.0).when(h.isNotNull(), 1.0)


def dose2ap(h1: Column, h2: Column, dose: Column) -> tuple[Column, Column]:
    """Allelic probabilities from a dosage: shared by a homozygous call, first to the alternative haplotype of a heterozygous one."""
    more, less = F.least(dose, F.lit(1.0)), F.greatest(dose - 1.0, F.lit(0.0))
    both = dose / 2.0
    known = h1.isNotNull() & h2.isNotNull()
    first = F.when(known & (h1 == h2), both).when(known & (h1 > h2), more).when(known, less).otherwise(0.5)
    second = F.when(known & (h1 == h2), both).when(known & (h1 > h2), less).when(known, more).otherwise(0.5)
    return first, second


def gl2ap(g: Column, h1: Column, h2: Column, steps: int | None = None) -> Column:
    """Struct (ap1, ap2): haplotype probabilities whose product and sum agree with the genotype's, phased by its call.

    The method's fixed point on the phase share comes to rest at the roots of x^2 - (2 g2 + g1) x + g2 (the double root
    if they aren't real), which are taken at once, so ``steps`` changes nothing. ``g`` is an array of three probabilities.
    """
    mean = g[2] + g[1] / 2.0
    wide = F.sqrt(F.greatest(mean * mean - g[2], F.lit(0.0)))
    het = (h1 + h2) == 1
    first = F.when(g[0] < 0, 0.5).when(het & (h1 == 0), mean - wide).when(het, mean + wide).otherwise(mean)
    second = F.when(g[0] < 0, 0.5).when(het & (h1 == 0), mean + wide).when(het, mean - wide).otherwise(mean)
    return F.struct(first.alias("ap1"), second.alias("ap2"))


def z_prior(ap: Column, h: Column, af: Column, rsq: Column, fix_genotype: bool = False, from_calls: bool = True) -> Column:
    """The prior that a haplotype carries the alternative allele; ``from_calls`` softens hard calls by the expected error."""
    error = F.lit(0.0) if fix_genotype else af * (1.0 - af) * (1.0 - rsq)
    z = F.when(h == 0, error).otherwise(1.0 - error) if from_calls or fix_genotype else ap
    return S.clamp(z, 0.001, 0.999)


def parse_conditional(listed: Column) -> Column:
    """An array of (variant_id, effect) from ``id:effect,...``; an effect that isn't a number, or none, is null."""
    parts = F.filter(F.split(listed, ","), lambda v: v != "")
    return F.transform(parts, lambda v: F.struct(F.substring_index(v, ":", 1).alias("variant_id"), F.try_element_at(F.split(v, ":"), F.lit(2)).try_cast("double").alias("effect")))


def weighted_quality(genotypes: DataFrame) -> DataFrame:
    """``variant_ix af call_rate`` from rows ``variant_ix h1 h2 w``: samples count by their weights, a missing call to neither dose."""
    d = F.col("h1") + F.col("h2")
    known = F.sum(F.when(d.isNotNull(), F.col("w")))
    return genotypes.groupBy("variant_ix").agg((F.sum(F.col("w") * d) / F.nullif(2.0 * known, F.lit(0.0))).alias("af"), (F.coalesce(known, F.lit(0.0)) / F.nullif(F.sum("w"), F.lit(0.0))).alias("call_rate"))


def variant_quality(genotypes: DataFrame) -> DataFrame:
    """A row a variant from rows ``variant_ix h1 h2``: frequency, Hardy-Weinberg chi-square, imputation accuracy, call rate."""
    d = F.col("h1") + F.col("h2")
    g = genotypes.groupBy("variant_ix").agg(
        F.count("*").alias("n_all"), F.count(d).alias("n"), F.sum(d).alias("dose"),
        *(F.count_if(d == i).alias(f"n{i}") for i in range(3)), F.sum((d * d).cast("double")).alias("dose2"),
    )
    n, theta = F.col("n").cast("double"), F.col("dose") / (2.0 * F.nullif(F.col("n"), F.lit(0)))
    p = (F.col("n1") + 2 * F.col("n2")) / (2.0 * F.nullif(F.col("n"), F.lit(0)))
    chi = F.lit(0.0)
    for i, e in enumerate(((1 - p) * (1 - p) * n, 2 * p * (1 - p) * n, p * p * n)):
        chi = chi + F.pow(F.col(f"n{i}") - e, 2) / F.nullif(e, F.lit(0.0))
    # with hard calls the variance within a sample is zero, so the accuracy is one whatever the frequency
    ia = F.when((theta <= 0) | (theta >= 1), 1.0).otherwise(1.0)
    return g.select("variant_ix", theta.alias("af"), chi.alias("hwe"), ia.alias("ia"), (n / F.col("n_all")).alias("call_rate"), "n0", "n1", "n2")


def imputation_accuracy(probs: DataFrame) -> DataFrame:
    """``variant_ix ia`` from rows ``variant_ix z1 z2``: one less the mean variance of a genotype over that of the frequency.

    The mean over samples of (E g^2 - (E g)^2) is one sum, so one pass does.
    """
    g2, g1 = F.col("z1") * F.col("z2"), F.col("z1") * (1 - F.col("z2")) + F.col("z2") * (1 - F.col("z1"))
    mean = 2 * g2 + g1
    g = probs.groupBy("variant_ix").agg(F.avg(4 * g2 + g1 - mean * mean).alias("v"), (F.avg(mean) / 2).alias("t"))
    return g.select("variant_ix", F.when((F.col("t") <= 0) | (F.col("t") >= 1), 1.0).otherwise(1 - F.col("v") / F.nullif(2 * F.col("t") * (1 - F.col("t")), F.lit(0.0))).alias("ia"))


def ld(genotypes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Correlation of dosages for ``pairs`` (a, b) of variants."""
    d = genotypes.select("variant_ix", "sample_ix", (F.col("h1") + F.col("h2")).cast("double").alias("d"))
    x = pairs.join(d.select(F.col("variant_ix").alias("a"), "sample_ix", F.col("d").alias("da")), "a")
    x = x.join(d.select(F.col("variant_ix").alias("b"), "sample_ix", F.col("d").alias("db")), ["b", "sample_ix"])
    return x.groupBy("a", "b").agg(F.corr("da", "db").alias("r"))


def genotype_prior(z1: Column, z2: Column) -> list[Column]:
    low, high = (1 - z1) * (1 - z2), z1 * z2
    return [low, 1 - low - high, high]


def diplotype_prior(z1: Column, z2: Column, x1: Column, x2: Column) -> list[Column]:
    """Ten states of tested (z) and feature (x) variant, haplotypes independent: both orders of each pair of haplotypes."""

    def hap(i: str, z: Column, x: Column) -> Column:
        return (z if i[0] == "1" else 1 - z) * (x if i[1] == "1" else 1 - x)

    out = []
    for _, c, f in STATES:
        a, b = c[0] + f[0], c[1] + f[1]
        v = hap(a, z1, x1) * hap(b, z2, x2)
        out.append(v if a == b else v + hap(b, z1, x1) * hap(a, z2, x2))
    return out


def diplotype_prior_self(z1: Column, z2: Column) -> list[Column]:
    """The same variant on both sides: only states in which it agrees with itself."""
    return [(1 - z1) * (1 - z2) if j == 0 else z1 * (1 - z2) + z2 * (1 - z1) if j == 5 else z1 * z2 if j == 9 else F.lit(0.0) for j in range(10)]


def diplotype_prior_null(x1: Column, x2: Column) -> list[Column]:
    return diplotype_prior(F.lit(0.5), F.lit(0.5), x1, x2)


def diplotype_prior_imprint(x1: Column, x2: Column) -> list[Column]:
    het = 0.5 * (x1 * (1 - x2) + x2 * (1 - x1))
    return [(1 - x1) * (1 - x2) if j == 3 else het if j in (4, 5) else x1 * x2 if j == 6 else F.lit(0.0) for j in range(10)]


def marker_alleles(ref: Column, alt: Column) -> tuple[Column, Column]:
    """One-letter codes for counting bases; indels get codes that no base has."""
    indel = (F.length(alt) > 1) | (alt == "-")
    return F.when(indel | (F.length(ref) > 1), "0").otherwise(ref), F.when(indel, "1").otherwise(alt)


def allelic_weights(pi: Column, delta: Column, phi: Column, state: int) -> tuple[Column, Column]:
    """Expected shares (A, B) of reference and alternative reads in a diplotype state."""
    _, c, x = STATES[state]
    a = b = F.lit(0.0)
    for i in (0, 1):
        dose = (pi if c[i] == "1" else 1 - pi) * 4.0
        error = delta if x[i] == "1" else 1 - delta
        a, b = a + dose * error * (1 - phi), b + dose * (1 - error) * phi
    return a, b


def conv_code(converged: Column, free: list[Column]) -> Column:
    """1,000,000 if the likelihood didn't converge, and a decimal digit for each parameter (pi first) whose gradient didn't."""
    code = F.when(converged, 0).otherwise(1_000_000)
    for i, bad in enumerate(free):
        code = code + F.when(bad, 10 ** (len(free) - 1 - i)).otherwise(0)
    return code.cast("bigint")


# --- from cells to priors and roles -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Mode:
    """Where the priors of the haplotypes come from.

    Without a switch they are the cells' allelic probabilities. ``from_error``: the calls, wrong with the probability
    that the imputation quality leaves. ``fixed``: the calls, never wrong. ``nominal``: no probability is moved off 0 and
    1. ``population``: the variant's allele frequency for all, and no Hardy-Weinberg filter.
    """

    from_error: bool = False
    fixed: bool = False
    nominal: bool = False
    population: bool = False

    @property
    def calls(self) -> bool:
        return self.from_error or self.fixed


def phased_pair(g: Column, h1: Column, h2: Column) -> tuple[Column, Column]:
    """Where ``gl2ap`` comes to rest: the roots of x^2 - (2 g2 + g1) x + g2, in the order of the call; the double root if they aren't real."""
    mid = g[2] + g[1] / 2.0
    wide = F.sqrt(F.greatest(mid * mid - g[2], F.lit(0.0)))
    side = F.when((h1 + h2) != 1, 0.0).when(h1 == 0, -1.0).otherwise(1.0)
    return mid + side * wide, mid - side * wide


def resolved(cells: DataFrame) -> DataFrame:
    """``cells`` with ``ap1 ap2 dose``: allelic probabilities by the order of precedence, and the dosage.

    Takes ``has_gt h1 h2 gl ds p1 p2 af``: given allelic probabilities first, then genotype probabilities, dosage, calls,
    and the frequency of the record.
    """
    h1, h2 = F.col("h1"), F.col("h2")
    known = h1.isNotNull() & h2.isNotNull()
    phased, dosed = phased_pair(F.col("gl"), h1, h2), dose2ap(h1, h2, F.col("ds"))

    def pick(i: int) -> Column:
        own, gt = F.col(f"p{i}"), F.col("has_gt")
        return F.when(own.isNotNull(), own).when(gt & F.col("gl").isNotNull(), F.when(known, phased[i - 1]).otherwise(0.5)).when(gt & F.col("ds").isNotNull(), dosed[i - 1]).when(gt, gt2ap(h1 if i == 1 else h2)).otherwise(F.col("af"))

    dose = F.when(F.col("p1").isNotNull(), F.col("p1") + F.col("p2")).when(F.col("has_gt"), (h1 + h2).cast("double")).otherwise(2 * F.col("af"))
    return cells.select("*", pick(1).alias("ap1"), pick(2).alias("ap2"), dose.alias("dose"))


def quality_of(cells: DataFrame, mode: Mode | None = None, weights: DataFrame | None = None) -> DataFrame:
    """``variant_ix af hwe ia call_rate`` from rows ``variant_ix sample_ix h1 h2 ap1 ap2 dose``.

    ``weights`` (sample_ix, w) let samples count by their weight; a sample that they don't name counts as one. The
    Hardy-Weinberg statistic is of the calls in the modes that use them, else of the likelier alleles; it is null without
    spread, so that such variants pass no filter.
    """
    mode = mode or Mode()
    d = cells.withColumn("w", F.lit(1.0)) if weights is None else cells.join(F.broadcast(weights.select("sample_ix", F.col("w").cast("double").alias("w"))), "sample_ix", "left").fillna(1.0, ["w"])
    g = F.col("h1") + F.col("h2") if mode.calls else (F.col("ap1") > 0.5).cast("int") + (F.col("ap2") > 0.5).cast("int")
    g1, g2 = F.col("ap1") * (1 - F.col("ap2")) + F.col("ap2") * (1 - F.col("ap1")), F.col("ap1") * F.col("ap2")
    w, mean = F.col("w"), 2 * g2 + g1
    there = lambda x, of: F.sum(F.when(of.isNotNull(), x))
    a = d.groupBy("variant_ix").agg(
        F.sum("w").alias("all"), there(w, F.col("dose")).alias("n"), F.sum(w * F.col("dose")).alias("dose"),
        *(F.coalesce(F.sum(F.when(g == i, w)), F.lit(0.0)).alias(f"n{i}") for i in range(3)),
        there(w, g2).alias("m"), F.sum(w * mean).alias("t"), F.sum(w * (4 * g2 + g1 - mean * mean)).alias("v"),
    )
    n = F.col("n0") + F.col("n1") + F.col("n2")
    p = (F.col("n1") + 2 * F.col("n2")) / (2 * F.nullif(n, F.lit(0.0)))
    chi = sum((F.pow(F.col(f"n{i}") - e, 2) / F.nullif(e, F.lit(0.0)) for i, e in enumerate(((1 - p) * (1 - p) * n, 2 * p * (1 - p) * n, p * p * n))), F.lit(0.0))
    t = F.col("t") / (2 * F.nullif(F.col("m"), F.lit(0.0)))
    ia = F.when((t <= 0) | (t >= 1), 1.0).otherwise(1 - F.col("v") / F.col("m") / (2 * t * (1 - t)))
    return a.select("variant_ix", (F.col("dose") / (2 * F.nullif(F.col("n"), F.lit(0.0)))).alias("af"), chi.alias("hwe"), ia.alias("ia"), (F.coalesce("n", F.lit(0.0)) / F.nullif(F.col("all"), F.lit(0.0))).alias("call_rate"))


#: Fixed value: how far a probability stays from 0 and 1.
RELAXED = 0.001


def mode_prior(mode: Mode, i: int, af: Column, rsq: Column) -> Column:
    """The prior that haplotype ``i`` (1, 2) of ``h1 h2 ap1 ap2`` has the alternative allele."""
    error = F.lit(0.0) if mode.fixed else af * (1.0 - af) * (1.0 - rsq)
    own = F.when(F.col(f"h{i}") == 0, error).when(F.col(f"h{i}").isNotNull(), 1.0 - error) if mode.calls else F.col(f"ap{i}")
    own = F.coalesce(own, af)
    return af if mode.population else own if mode.nominal else S.clamp(own, RELAXED, 1 - RELAXED)


def with_quality(cells: DataFrame, quality: DataFrame) -> DataFrame:
    return cells.join(quality.select("variant_ix", F.col("af").alias("_af"), F.col("rsq").alias("_rsq")), "variant_ix")


def mode_priors(cells: DataFrame, quality: DataFrame, mode: Mode | None = None) -> DataFrame:
    """``variant_ix sample_ix z1 z2``: the prior that each haplotype has the alternative allele; ``quality`` has af and rsq.

    Where a call or an allelic probability is missing the variant's frequency stands in.
    """
    z = lambda i: mode_prior(mode or Mode(), i, F.col("_af"), F.col("_rsq"))
    return with_quality(cells, quality).select("variant_ix", "sample_ix", z(1).alias("z1"), z(2).alias("z2"))


def priors_by_mode(cells: DataFrame, quality: DataFrame, modes: dict[str, Mode]) -> DataFrame:
    """``variant_ix sample_ix mode z1 z2``: the priors of all ``modes``, in one pass over the cells."""
    z = lambda mode, i: mode_prior(mode, i, F.col("_af"), F.col("_rsq")).alias(f"z{i}")
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("mode"), z(m, 1), z(m, 2)) for k, m in modes.items())))
    return with_quality(cells, quality).select("variant_ix", "sample_ix", each.alias("_m")).select("variant_ix", "sample_ix", "_m.*")
