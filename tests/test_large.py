"""What plans do where tables are large, told from estimates and from small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from traitloom.operators import fit, intervals, matrix
from traitloom.operators import genotype as G
from traitloom.plans import queries3
from traitloom.plans.queries5 import QUERIES
from traitloom.sources import bam
from traitloom.sources.adapter import Study

SF = "/root/testdata/sf0.001"


def estimate(d):
    return int(str(d._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def test_estimates_count_the_whole_panel(spark):
    s = Study(spark, SF)
    part = estimate(s.raw("part").select("p_partkey", "p_size"))
    assert estimate(s.genotypes()) >= 25 * part


def test_variants_are_never_sent_to_the_driver(spark):
    s = Study(spark, SF)
    d = s.as_counts().join(s.variants().select("variant_ix", "chrom"), "variant_ix").join(s.records().select("variant_ix", "format"), "variant_ix")
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin [variant_ix") == 2


def test_certain_genotypes_have_certain_alleles(spark):
    d = spark.createDataFrame([([1.0, 0.0, 0.0], 0, 0), ([0.0, 1.0, 0.0], 1, 0), ([0.0, 0.0, 1.0], 1, 1), ([0.2, 0.3, 0.5], None, None)], "g array<double>, h1 int, h2 int")
    got = [tuple(r["a"]) for r in d.select(G.gl2ap(F.col("g"), F.col("h1"), F.col("h2")).alias("a")).collect()]
    assert got == [(0, 0), (1, 0), (1, 1), pytest.approx((0.65, 0.65))]


def test_all_modes_take_one_pass(spark):
    plan = QUERIES["prior_modes"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lineitem") <= 2 and plan.count("l_partkey") and "Union" not in plan


def test_positions_beyond_the_index_are_kept(spark, tmp_path):
    far = (1 << 29) + 5000
    rows = [(f"r{i}", 99, "chr1", p, 30, "10M", "=", p, 10, "ACGTACGTAC", ["XM:i:1"]) for i, p in enumerate((100, far, far + 50))]
    d = spark.createDataFrame(rows, "qname string, flag int, chrom string, pos long, mapq int, cigar string, rnext string, pnext long, tlen long, seq string, tags array<string>")
    bam.write(d, str(tmp_path / "b"), [("chr1", far + 10**6), *((f"c{i}", 10) for i in range(3000))])
    assert sorted(r["pos"] for r in bam.read(spark, str(tmp_path / "b")).collect()) == [100, far, far + 50]
    assert [r["qname"] for r in bam.read(spark, str(tmp_path / "b"), ("chr1", far - 5, far + 20)).collect()] == ["r1"]


def test_references_are_joined_not_searched(spark, tmp_path, monkeypatch):
    d = spark.createDataFrame([("r", 99, "c7", 5, 30, "4M", "=", 5, 4, "ACGT", [])], "qname string, flag int, chrom string, pos long, mapq int, cigar string, rnext string, pnext long, tlen long, seq string, tags array<string>")
    monkeypatch.setattr(F, "create_map", None)
    bam.write(d, str(tmp_path / "b"), [(f"c{i}", 10) for i in range(20)])
    assert bam.read(spark, str(tmp_path / "b")).first()["chrom"] == "c7"


def test_covariates_compute_their_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def noted(y):
        seen.add(1)
        return y

    rows = [(f, s, (f * 7 + s * s * 3) % 11 + 1, 1.0 + s / 10) for f in range(20) for s in range(5)]
    d = spark.createDataFrame(rows, "feature_ix long, sample_ix long, y long, k double").withColumn("y", F.udf(noted, "long")("y"))
    matrix.covariates(d).collect()
    assert seen.value == len(rows)


def test_inputs_of_fits_are_written_before_they_meet(spark):
    plan = queries3.block(Study(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "p_partkey" not in plan


def test_customers_are_never_sent_to_the_driver(spark):
    plan = Study(spark, SF)._lines()._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [o_custkey" not in plan and "SortMergeJoin [o_custkey" in plan


def test_posterior_haplotypes_need_no_shuffle(spark):
    d = QUERIES["posterior_haps"](spark, SF)
    assert "Exchange" not in d._jdf.queryExecution().executedPlan().toString()
    r = queries3.fitted(Study(spark, SF)).orderBy("feature_ix", "variant_ix").first()
    got = d.filter((F.col("feature_ix") == r["feature_ix"]) & (F.col("variant_ix") == r["variant_ix"])).orderBy("sample_ix").collect()
    assert [x for g in got for x in (g["z1"], g["z2"])] == r["haplotypes"] and [g["sample_ix"] for g in got] == list(range(len(got)))


def test_few_reads_need_no_log_gamma(monkeypatch):
    x, n = np.random.default_rng(1).uniform(1e-3, 50, (3, 6, 10)), np.array([0, 1, 2, 5, 16, 40.0])
    want = [a - b for a, b in zip(fit.gammas(x + n[None, :, None], 2), fit.gammas(x, 2), strict=True)]
    for a, b in zip(fit.rises(x, n, 2), want, strict=True):
        np.testing.assert_allclose(a, b, rtol=1e-8, atol=1e-8)
    monkeypatch.setattr(fit, "gammas", None)
    fit.rises(x[:, :5], n[:5], 2)


def test_trans_pairs_of_one_bin_are_dealt_to_many_tasks(spark):
    v = spark.createDataFrame([(i, "c1", 10 * i) for i in range(2000)], "variant_ix long, chrom string, pos long")
    f = spark.createDataFrame([(j, "c2", 5) for j in range(20)], "feature_ix long, chrom string, tss long")
    n = [r["count"] for r in intervals.outside(v, f, 100).select("feature_ix", "variant_ix").groupBy(F.spark_partition_id()).count().collect()]
    assert sum(n) == 40_000 and len(n) >= 8 and max(n) < 20_000


@pytest.mark.parametrize("name", ["frag_overlap_semi", "frag_overlap_anti", "frag_tally", "as_dosage"])
def test_fragments_are_paired_once(spark, name):
    assert "Window" not in QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["nb_glm_fit_own", "nb_glm_check"])
def test_covariate_fits_read_lines_once(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan


def test_a_covariate_fit_takes_one_pass_a_step(monkeypatch):
    rnd, calls, plain = np.random.default_rng(2), [], fit.gammas
    x = np.column_stack([np.ones(40), rnd.normal(size=(40, 3))])
    y, k = rnd.negative_binomial(4, 0.2, 40).astype(float), rnd.uniform(0.7, 1.3, 40)
    monkeypatch.setattr(fit, "gammas", lambda *a: calls.append(1) or plain(*a))
    coef, theta, ll, itr = fit.glm(y, k, x)
    assert len(calls) < 4 * itr + 6  # without numerical derivatives
    mean = k * np.exp(x @ coef)
    slope = x.T @ (y - mean * (y + theta) / (mean + theta))
    slope[1:] -= coef[1:] / 1e4
    assert np.abs(slope).max() < 1e-5


def test_a_whole_run_reads_lines_once(spark, monkeypatch):
    from traitloom.plans import queries5

    calls, plain = [], Study._lines
    monkeypatch.setattr(Study, "_lines", lambda s: calls.append(1) or plain(s))
    assert queries5.reported(Study(spark, SF)).count() and len(calls) <= 1


def test_written_trans_pairs_are_compressed(spark, tmp_path):
    v = spark.range(600).selectExpr("id as variant_ix", "'c1' as chrom", "10 * id as pos")
    f = spark.range(4200).selectExpr("7 * id as feature_ix", "'c2' as chrom", "5L as tss")
    intervals.outside(v, f, 100, 4).select("feature_ix", "variant_ix").write.parquet(str(tmp_path / "p"))
    size = sum(p.stat().st_size for p in (tmp_path / "p").glob("*.parquet"))
    d = spark.read.parquet(str(tmp_path / "p"))
    assert d.count() == 600 * 4200 and d.distinct().count() == 600 * 4200
    assert size < 0.7 * 600 * 4200  # bytes a pair; 1.2 and more where runs differ


def test_components_without_variance_are_no_covariates(spark):
    rnd = np.random.default_rng(8)
    d = spark.createDataFrame([(f, i, int(rnd.integers(5, 200)), 1.0) for f in range(4) for i in range(15)], "feature_ix long, sample_ix long, y long, k double")
    assert {len(r["x"]) for r in matrix.covariates(d).collect()} <= set(range(1, 6))  # four features and the size factor
