"""Genotype modes, thresholds, covariates of a feature, trans scans, lead rows and posteriors of a run; checks of inputs."""

import gzip
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from traitloom.operators import fit, intervals
from traitloom.operators import genotype as G
from traitloom.plans import checks, pipeline

CELLS = "variant_ix long, sample_ix long, h1 int, h2 int, ap1 double, ap2 double, dose double"


def test_priors_in_each_mode(spark):
    d = spark.createDataFrame([(1, 0, 0, 1, 0.2, 1.0, 1.0), (1, 1, 1, 1, 0.0, 0.9, 2.0), (1, 2, None, None, None, None, None)], CELLS)
    q = spark.createDataFrame([(1, 0.25, 0.8)], "variant_ix long, af double, rsq double")
    z = lambda **m: [tuple(r)[2:] for r in G.mode_priors(d, q, G.Mode(**m)).orderBy("sample_ix").collect()]
    e = 0.25 * 0.75 * (1 - 0.8)
    flat = lambda rows: [v for r in rows for v in r]
    assert flat(z()) == pytest.approx([0.2, 0.999, 0.001, 0.9, 0.25, 0.25])
    assert flat(z(nominal=True)) == pytest.approx([0.2, 1, 0, 0.9, 0.25, 0.25])
    assert flat(z(from_error=True)) == pytest.approx([e, 1 - e, 1 - e, 1 - e, 0.25, 0.25])
    assert flat(z(fixed=True)) == pytest.approx([0.001, 0.999, 0.999, 0.999, 0.25, 0.25])
    assert flat(z(fixed=True, nominal=True)) == [0, 1, 1, 1, 0.25, 0.25]
    assert set(flat(z(population=True, fixed=True))) == {0.25}


def test_quality_by_weight_and_mode(spark):
    d = spark.createDataFrame([(1, 0, 0, 0, 0.1, 0.2, 0.3), (1, 1, 1, 0, 0.9, 0.6, 1.5), (1, 2, None, None, None, None, None)], CELLS)
    w = spark.createDataFrame([(0, 3.0), (2, 4.0)], "sample_ix long, w double")  # sample 1 counts as one
    a = G.quality_of(d, weights=w).first()
    assert a["af"] == pytest.approx((3 * 0.3 + 1.5) / 8) and a["call_rate"] == pytest.approx(4 / 8)
    # weights of 0, 1 and 2 likelier alleles: 3, 0, 1, and none of the missing one
    p = 2 / 8
    assert a["hwe"] == pytest.approx((3 - (1 - p) ** 2 * 4) ** 2 / ((1 - p) ** 2 * 4) + 2 * p * (1 - p) * 4 + (1 - p * p * 4) ** 2 / (p * p * 4))
    b = G.quality_of(d, G.Mode(from_error=True)).first()
    assert b["hwe"] == pytest.approx(sum((o - x) ** 2 / x for o, x in zip((1, 1, 0), (1.125, 0.75, 0.125), strict=True)))
    assert G.quality_of(d.limit(0)).collect() == []


def simulated(spark, n=40, effect=0.75, seed=3):
    """A feature on chromosome 1 with an effect of variant 1 (near) and a far variant 5 (chromosome 2); variant 2 is in its exon."""
    rnd = np.random.default_rng(seed)
    hap = rnd.integers(0, 2, (5, n, 2))
    k = rnd.uniform(0.7, 1.3, n)
    mean = 60 * k * np.where(hap[0], 2 * effect, 2 * (1 - effect)).mean(1)
    y = rnd.poisson(mean)
    variants = [(i + 1, "1" if i < 4 else "2", 100 + 10 * i, f"v{i + 1}", "A", "G", 0.95) for i in range(5)]
    cells = [(v + 1, i, int(hap[v, i, 0]), int(hap[v, i, 1]), float(hap[v, i, 0]), float(hap[v, i, 1]), float(hap[v, i].sum())) for v in range(5) for i in range(n)]
    reads = []
    for i in range(n):
        share = np.where(hap[0, i], effect, 1 - effect)
        alt = share[hap[1, i] == 1].sum() / share.sum()
        a = int(rnd.binomial(12, alt))
        reads.append((2, i, 12 - a, a))
    return {
        "variants": spark.createDataFrame(variants, "variant_ix long, chrom string, pos long, variant_id string, ref string, alt string, rsq double"), "cells": spark.createDataFrame(cells, CELLS),
        "as_counts": spark.createDataFrame(reads, "variant_ix long, sample_ix long, as_ref long, as_alt long"), "offsets": spark.createDataFrame([(0, i, int(y[i]), float(k[i])) for i in range(n)], "feature_ix long, sample_ix long, y long, k double"),
        "features": spark.createDataFrame([(0, "1", 120)], "feature_ix long, chrom string, tss long"), "exons": spark.createDataFrame([(0, "1", 105, 2105)], "feature_ix long, chrom string, start long, end long"),
    }


@pytest.mark.parametrize("mode", [G.Mode(), G.Mode(from_error=True), G.Mode(fixed=True), G.Mode(nominal=True)])
def test_a_run_from_cells_finds_the_effect_in_each_mode(spark, mode):
    s = simulated(spark)
    rows = {r["variant_ix"]: r for r in pipeline.run_study(**s, o=pipeline.Options(half_window=1000, mode=mode)).collect()}
    assert max(rows, key=lambda v: rows[v]["lr"]) == 1 and rows[1]["lr"] > 20 and rows[1]["pi"] > 0.65 and rows[1]["joint"] and rows[1]["n_feature"] == 1
    assert set(rows) == {1, 2, 3, 4}


def test_thresholds_of_feature_variants_lead_row_and_population_frequency(spark):
    s = simulated(spark)
    none = pipeline.run_study(**s, o=pipeline.Options(half_window=1000, min_depth=1e9)).collect()
    assert {r["n_feature"] for r in none} == {0}
    lead = pipeline.run_study(**s, o=pipeline.Options(half_window=1000, lead=True)).collect()
    assert [r["variant_ix"] for r in lead] == [1] and lead[0]["log10_q"] < -3
    p = pipeline.prepare(**s, o=pipeline.Options(mode=G.Mode(population=True)))
    z = p.priors.join(p.variants.select("variant_ix", "af"), "variant_ix")
    assert z.filter((F.col("z1") != F.col("af")) | (F.col("z2") != F.col("af"))).count() == 0


def test_trans_scan_takes_pairs_outside_the_window(spark):
    s = simulated(spark)
    rows = pipeline.run_study(**s, o=pipeline.Options(half_window=15, trans=True)).collect()
    assert {r["variant_ix"] for r in rows} == {1, 5} and all(np.isfinite(r["lr"]) for r in rows)  # 15 away or more, or elsewhere
    one = fit.Model(trans=True)
    assert pipeline.Options(trans=True).model != one  # the run sets the model's switch itself


def test_pairs_outside_windows_are_all_pairs_less_those_inside(spark, monkeypatch):
    monkeypatch.setattr(intervals, "TOGETHER", 7)
    v = [(i, f"c{i % 3}", 37 * i % 900 + 1) for i in range(300)]
    f = [(j, f"c{j % 4}", 90 * j % 900) for j in range(23)]
    for half, width in ((100, 50), (5, 1000), (2000, 100)):
        got = intervals.outside(spark.createDataFrame(v, "variant_ix long, chrom string, pos long"), spark.createDataFrame(f, "feature_ix long, chrom string, tss long"), half, width).select("feature_ix", "variant_ix").collect()
        want = sorted((j, i) for i, c, p in v for j, d, t in f if c != d or p <= t - half or p >= t + half)
        assert sorted(map(tuple, got)) == want


def test_a_planted_coefficient_of_the_features_own_covariate_is_found(spark):
    rnd = np.random.default_rng(8)
    n, rows, own = 200, [], []
    for f, slope in ((0, 0.8), (1, -0.5), (2, 0.0)):
        value = rnd.uniform(0.5, 20, n)
        x = np.log(value + 0.01) - np.log(value + 0.01).mean()
        y = rnd.poisson(np.exp(4 + slope * x))
        rows += [(f, i, int(y[i]), 1.0) for i in range(n)]
        own += [(f, i, float(value[i])) for i in range(n)]
    normed = spark.createDataFrame(rows, "feature_ix long, sample_ix long, y long, k double")
    cov = spark.createDataFrame([(i, float(rnd.normal())) for i in range(n)], "sample_ix long, x1 double")
    o = fit.own_covariate(spark.createDataFrame(own, "feature_ix long, sample_ix long, value double"))
    assert o.groupBy("feature_ix").agg(F.abs(F.avg("x")).alias("m")).agg(F.max("m")).first()[0] < 1e-12
    got = {r["feature_ix"]: r["coef"] for r in fit.glm_fit(normed, cov, ["x1"], o).collect()}
    for f, slope in ((0, 0.8), (1, -0.5), (2, 0.0)):
        assert len(got[f]) == 3 and got[f][2] == pytest.approx(slope, abs=0.05) and got[f][1] == pytest.approx(0, abs=0.05)


def test_posteriors_of_a_run_are_records(spark, tmp_path):
    s = simulated(spark)
    o = pipeline.Options(half_window=1000)
    p = pipeline.prepare(**s, o=o)
    rows = pipeline.map_traits(s["offsets"], p.variants, s["features"], p.priors, s["as_counts"], p.fsnps, o)
    pipeline.write_posteriors(rows, p, s["offsets"], s["as_counts"], f"{tmp_path}/post", o)
    text = [line.split("\t") for f in sorted((tmp_path / "post").glob("*.gz")) for line in gzip.open(f, "rt").read().splitlines()]
    assert [(t[2], t[6], t[7], t[8]) for t in text] == [("v1", "LEAD_QTL_SNP", "FID=0;RSQ=1.0", "GT:GP:AP:AS"), ("v2", ".", "FID=0;RSQ=1.0", "GT:GP:AP:AS")]
    assert all(len(t) == 9 + 40 for t in text) and text[0][9].endswith(":0,0") and sum(int(c.split(":")[3].split(",")[0]) + int(c.split(",")[-1]) for c in text[1][9:]) == 12 * 40


def found(d):
    return sorted((r["check"], r["subject"], r["n"]) for r in d.collect())


def test_every_check_finds_its_fault(spark, tmp_path):
    samples = spark.createDataFrame([(i,) for i in range(3)], "sample_ix long")
    nan = float("nan")
    counts = [(0, 0, 1.0, 1.0), (0, 1, -1.0, 1.0), (0, 2, nan, 0.0), (1, 0, 1.0, 1.0), (1, 0, 1.0, math.inf), (1, 9, 1.0, 1.0)]
    w = spark.createDataFrame([(0, 1.0), (1, -0.5), (2, nan)], "sample_ix long, w double")
    got = found(checks.counts(spark.createDataFrame(counts, "feature_ix long, sample_ix long, y double, k double"), samples, w))
    assert got == [("count_negative", "0", 1), ("count_not_a_number", "0", 1), ("offset_not_positive", "0", 1), ("offset_not_positive", "1", 1), ("sample_missing", "1", 1), ("sample_repeated", "1", 1), ("sample_unknown", "1", 1), ("weight_out_of_range", "1", 1), ("weight_out_of_range", "2", 1)]
    v = [("1", 5, "A", "G", 0), ("1", 4, "A", "G", 1), ("1", 9, "A", "A", 2), ("2", 0, "", "G", 3), ("2", 0, "", "G", 4), ("1", 8, "C", "G", 5)]
    got = found(checks.variants(spark.createDataFrame(v, "chrom string, pos long, ref string, alt string, line long"), "line"))
    assert got == [("allele_empty", "2", 2), ("alleles_equal", "1", 1), ("position_falls", "1", 2), ("position_not_positive", "2", 2), ("variant_repeated", "2", 1)]
    c = [(1, 0, 0, 1), (1, 1, None, None), (1, 2, 2, 0), (2, 0, 0, 0), (2, 0, 0, 0), (2, 1, 0, 0)]
    assert found(checks.cells(spark.createDataFrame(c, "variant_ix long, sample_ix long, h1 int, h2 int"), 3)) == [("allele_unknown", "1", 1), ("variant_incomplete", "2", 1)]
    (tmp_path / "a.vcf").write_text("##x\n#CHROM\tPOS\tID\n1\t5\ta\n1\tx\tb\n1\t6\n1\t7\t\n")
    assert found(checks.table(spark, f"{tmp_path}/a.vcf")) == [("field_empty", "a.vcf", 1), ("position_not_a_number", "a.vcf", 1), ("width_differs", "a.vcf", 1)]
    (tmp_path / "b.vcf").write_text("1\t5\ta\n")
    assert ("header_missing", None, 1) in found(checks.table(spark, f"{tmp_path}/b.vcf"))


def test_a_sound_study_has_no_faults(spark):
    s = simulated(spark)
    samples = s["offsets"].select("sample_ix").distinct()
    assert found(checks.study(s["offsets"], samples, s["variants"], s["cells"], s["features"], s["exons"])) == []
    assert ("no_features", None, 1) in found(checks.study(s["offsets"], samples, s["variants"], s["cells"], s["features"].limit(0), s["exons"]))
