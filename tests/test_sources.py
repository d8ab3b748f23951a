import gzip
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from traitloom.operators import fit, matrix
from traitloom.plans import pipeline
from traitloom.sources import matrices, sam, vcf
from traitloom.streaming import allele_counts

VCF = "\n".join(
    [
        "##fileformat=VCFv4.1", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\ts3\ts4\ts5",
        "1\t100\trs1\tA\tG\t.\t.\tRSQ=0.9\tGT:AS\t0|0:5,0\t0|1:1,10\t1|0:7,6\t1|1:0,9\t.:0,0",
        "1\t200\trs2\tA\tG\t.\t.\tAF=0.4\tAS\t1,2\t3,4\t5,6\t7,8\t9,0",
        "1\t300\trs3\tA\tG\t.\t.\t.\tAP:AS\t0.0,-5.0:1,10\t-5,-5:0,0\t-1,-1:0,0\t0,0:0,0\t0,-6:0,0",
        "1\t400\trs4\tA\tG\t.\t.\tDR2=0.7\tGT:DS:AS\t0|1:1.1:1,10\t0|0:0.2:1,1\t1|1:1.8:0,0\t1|0:0.7:0,0\t.:1:0,0",
    ]
)


@pytest.fixture
def vcf_path(tmp_path):
    p = tmp_path / "a.vcf.gz"
    p.write_bytes(gzip.compress(VCF.encode()))
    return str(p)


def test_vcf_scan(spark, vcf_path):
    assert vcf.sample_names(spark, vcf_path) == ["s1", "s2", "s3", "s4", "s5"]
    d = {(r["variant_id"], r["sample_ix"]): r for r in vcf.scan(spark, vcf_path).collect()}
    assert len(d) == 20
    assert [(d["rs1", i]["ap1"], d["rs1", i]["ap2"], d["rs1", i]["as_ref"], d["rs1", i]["as_alt"]) for i in range(5)] == [(0, 0, 5, 0), (0, 1, 1, 10), (1, 0, 7, 6), (1, 1, 0, 9), (None, None, 0, 0)]
    assert d["rs1", 4]["dose"] is None and d["rs1", 1]["dose"] == 1 and d["rs1", 0]["rsq"] == 0.9
    assert all(d["rs2", i]["ap1"] == 0.4 and d["rs2", i]["dose"] == 0.8 for i in range(5)) and d["rs2", 3]["as_alt"] == 8
    assert (d["rs3", 0]["ap1"], d["rs3", 0]["ap2"], d["rs3", 0]["dose"]) == (1, 0, 1) and d["rs3", 2]["ap1"] == pytest.approx(0.1)
    assert [d["rs4", i]["ap1"] for i in range(5)] == pytest.approx([0.1, 0.1, 0.9, 0.7, 0.5]) and d["rs4", 0]["rsq"] == 0.7


def test_posterior_and_appended_counts(spark, vcf_path, tmp_path):
    counts = spark.createDataFrame([("1", 100, "rs1", 1, 3, 4)], "chrom string, pos long, variant_id string, sample_ix long, as_ref long, as_alt long")
    out = str(tmp_path / "out")
    vcf.append_counts(spark, vcf_path, counts, out)
    body = [r[0].split("\t") for r in spark.read.text(f"{out}/body").collect()]
    first = next(b for b in body if b[2] == "rs1")
    assert first[8] == "GT:AS:AS" and first[10] == "0|1:1,10:3,4" and first[9] == "0|0:5,0:0,0"
    head = [r[0] for r in spark.read.text(f"{out}/header").collect()]
    assert head[-1].startswith("#CHROM") and head[-2].startswith("##FORMAT=<ID=AS")
    cells = spark.createDataFrame([("1", 5, "v", "A", "C", i, z, 0.2, 1, 2) for i, z in enumerate([0.9, 0.0])], "chrom string, pos long, variant_id string, ref string, alt string, sample_ix long, z1 double, z2 double, as_ref long, as_alt long")
    vcf.write_posterior(cells, str(tmp_path / "post"))
    line = spark.read.text(str(tmp_path / "post")).first()[0].split("\t")
    assert line[:5] == ["1", "5", "v", "A", "C"] and line[9].split(":")[0] == "1|0" and line[10].split(":")[2].startswith("-5.000000")


SAM = "@HD\tVN:1\nq1\t0\tchr1\t101\t30\t10M\t*\t0\t0\tACGTACGTAC\tIIIIIIIIII\tXM:i:1\tX0:i:1\nq2\t256\tchr1\t101\t30\t10M\t*\t0\t0\tACGTACGTAC\tII\n"


def test_sam_scan_and_list(spark, tmp_path):
    for n in ("s1.sam", "s2.sam"):
        (tmp_path / n).write_text(SAM)
    (tmp_path / "list").write_text(f"{tmp_path}/s1.sam\n{tmp_path}/s2.sam\n")
    samples = sam.sample_list(spark, str(tmp_path / "list"))
    assert [r["sample_name"] for r in samples.collect()] == ["s1", "s2"]
    got = sam.scan(spark, samples).collect()
    assert len(got) == 4 and {r["sample_ix"] for r in got} == {0, 1}
    q1 = next(r for r in got if r["qname"] == "q1")
    assert (q1["pos"], q1["cigar"], q1["tags"], q1["mapq"]) == (101, "10M", ["XM:i:1", "X0:i:1"], 30)


def test_stream_of_alignments(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.sam").write_text(SAM)
    markers = spark.createDataFrame([("chr1", 102, "m", "C", "T")], "chrom string, pos long, variant_id string, a1 string, a2 string")
    q = allele_counts.start(allele_counts.stream(spark, str(folder), markers), "as_counts", str(tmp_path / "cp"))
    try:
        q.processAllAvailable()
        assert [(r["variant_id"], r["n_ref"]) for r in spark.table("as_counts").collect()] == [("m", 1)]
        (folder / "b.sam").write_text(SAM.replace("ACGTACGTAC", "ATGTACGTAC"))
        q.processAllAvailable()
        assert [(r["n_ref"], r["n_alt"]) for r in spark.table("as_counts").collect()] == [(1, 1)]
    finally:
        q.stop()


def test_matrices(spark, tmp_path):
    (tmp_path / "y.txt").write_text("g1\t1\t2\t3\ng2\t4\t5\t6\n")
    y = matrices.read_table(spark, str(tmp_path / "y.txt"))
    assert [(r[0], r[1], r[2]) for r in y.orderBy("feature_id", "sample_ix").collect()] == [("g1", 0, 1), ("g1", 1, 2), ("g1", 2, 3), ("g2", 0, 4), ("g2", 1, 5), ("g2", 2, 6)]
    m = y.select(F.when(F.col("feature_id") == "g1", 0).otherwise(1).cast("long").alias("row"), "sample_ix", F.col("y").alias("value"))
    assert matrices.write_binary(m, str(tmp_path / "y.bin")) == 6
    assert (tmp_path / "y.bin").read_bytes() == struct.pack("<6d", 1, 2, 3, 4, 5, 6)
    back = matrices.read_binary(spark, str(tmp_path / "y.bin"), 3)
    assert sorted(map(tuple, back.collect())) == [(0, 0, 1), (0, 1, 2), (0, 2, 3), (1, 0, 4), (1, 1, 5), (1, 2, 6)]
    (tmp_path / "gc.txt").write_text("0.1,0.2\t0.3\n0.4\n")
    assert sorted(r[0] for r in matrices.read_numbers(spark, str(tmp_path / "gc.txt")).collect()) == [0.1, 0.2, 0.3, 0.4]


def test_permutation_is_seeded_and_keeps_values(spark):
    d = spark.createDataFrame([(g, i, 10 * g + i) for g in range(3) for i in range(8)], "feature_ix long, sample_ix long, y long")
    a, b, c = ({(r[0], r[1]): r[2] for r in matrix.permute(d, ["feature_ix"], "sample_ix", ["y"], s).select("feature_ix", "sample_ix", "y").collect()} for s in (1, 1, 2))
    assert a == b != c
    for g in range(3):
        assert sorted(a[g, i] for i in range(8)) == [10 * g + i for i in range(8)]


def test_smoothing_spline():
    x = np.linspace(0, 1, 50)
    noisy = 2 * x + np.sin(40 * x)
    out = matrix.smooth(x, noisy)
    assert np.abs(np.diff(out, 2)).max() < np.abs(np.diff(noisy, 2)).max() / 50
    assert matrix.smooth(x, 3 * x) == pytest.approx(3 * x, abs=1e-6)


def test_association_run_finds_the_planted_variant(spark):
    rnd = np.random.default_rng(1)
    n = 40
    hap = rnd.random((4, n, 2)) < 0.4
    dose = hap[1].sum(1)
    y = rnd.poisson(60 * (0.6 + 0.4 * dose))
    offsets = spark.createDataFrame([(0, i, int(y[i]), 1.0) for i in range(n)], "feature_ix long, sample_ix long, y long, k double")
    variants = spark.createDataFrame([(v, "1", 100 + v, f"v{v}", "A", "C", float(hap[v].mean()), 0.1, 1.0) for v in range(4)], "variant_ix long, chrom string, pos long, variant_id string, ref string, alt string, af double, hwe double, rsq double")
    features = spark.createDataFrame([(0, "1", 100)], "feature_ix long, chrom string, tss long")
    priors = spark.createDataFrame([(v, i, *(float(np.clip(h, 0.001, 0.999)) for h in hap[v, i])) for v in range(4) for i in range(n)], "variant_ix long, sample_ix long, z1 double, z2 double")
    reads = spark.createDataFrame([(3, i, 5, 5) for i in range(n)], "variant_ix long, sample_ix long, as_ref long, as_alt long")
    fsnps = spark.createDataFrame([(0, 3)], "feature_ix long, variant_ix long")
    run = lambda **k: {r["variant_ix"]: r for r in pipeline.map_traits(offsets, variants, features, priors, reads, fsnps, pipeline.Options(half_window=1000, **k)).collect()}
    got = run(population_only=True)
    assert len(got) == 4 and max(got, key=lambda v: got[v]["lr"]) == 1 and got[1]["lr"] > 20 and got[1]["log10_q"] < -3
    assert got[1]["pi"] > 0.55 and math.isfinite(got[1]["log_bf"])
    assert len(run()) == 4
    assert run(work_limit=3) == {}
    one = run(only="v1", model=fit.Model(fixed=("theta",)))
    assert set(one) == {1} and one[1]["n_tested"] == 4 and one[1]["theta"] == pytest.approx(1.02 / 0.2)
    assert len(run(random_seed=3)) == 1
    whole = lambda **k: pipeline.full_report(offsets, variants, features.union(spark.createDataFrame([(1, "2", 5)], features.schema)), priors, reads, fsnps, pipeline.Options(half_window=1000, **k)).collect()
    rows = whole(imprint=True, population_only=False)
    assert sorted(r["variant_id"] for r in rows) == ["AI", "SKIPPED", "v0", "v1", "v2", "v3"]
    skipped = next(r for r in rows if r["variant_id"] == "SKIPPED")
    assert (skipped["feature_ix"], skipped["pos"], skipped["n_tested"], skipped["lr"], skipped["pi"]) == (1, -1, 0, 0.0, -1.0)
    zero = offsets.selectExpr("feature_ix", "sample_ix", "0L as y", "k")
    assert pipeline.map_traits(zero, variants, features, priors, reads, fsnps, pipeline.Options(half_window=1000)).collect() == []


def test_covariates_and_weights_reach_the_fit(spark):
    rnd = np.random.default_rng(2)
    n = 60
    x = rnd.normal(size=n)
    y = rnd.poisson(80 * np.exp(0.8 * x))
    normed = spark.createDataFrame([(0, i, int(y[i]), 1.0) for i in range(n)], "feature_ix long, sample_ix long, y long, k double")
    none = spark.createDataFrame([], "feature_ix long, variant_ix long")
    priors = spark.createDataFrame([], "variant_ix long, sample_ix long, z1 double, z2 double")
    reads = spark.createDataFrame([], "variant_ix long, sample_ix long, as_ref long, as_alt long")
    rows = fit.glm_fit(normed, spark.createDataFrame([(i, float(x[i])) for i in range(n)], "sample_ix long, x1 double"), ["x1"])
    dk = fit.factor(rows)
    got = {r["sample_ix"]: r["dk"] for r in dk.collect()}
    slope = np.polyfit(x, np.log([got[i] for i in range(n)]), 1)[0]
    assert slope == pytest.approx(0.8, abs=0.1) and np.mean(list(got.values())) == pytest.approx(1)
    theta = lambda **k: fit.null_fit(fit.blocks(normed, none, priors, reads, **k)).first()
    assert theta(dk=dk)["theta"] > 3 * theta()["theta"]
    w = spark.createDataFrame([(0, i, 0.0 if i % 2 else 1.0) for i in range(n)], "feature_ix long, sample_ix long, w double")
    half = fit.null_fit(fit.blocks(normed.filter("sample_ix % 2 = 0"), none, priors, reads)).first()
    # samples of weight 0 say nothing, but for the centre of a flat prior
    assert theta(weights=w)["beta"] == pytest.approx(half["beta"], abs=0.02)


def test_permutation_moves_each_feature_variant_on_its_own(spark):
    rows = spark.createDataFrame([(0, v, i, i / 10, i / 20, i, 2 * i, float(i)) for v in (3, 4) for i in range(9)], "feature_ix long, variant_ix long, sample_ix long, z1 double, z2 double, as_ref long, as_alt long, kx double")
    got = fit.shuffled(rows, 5).collect()
    order = {v: [r["as_ref"] for r in sorted(got, key=lambda r: r["sample_ix"]) if r["variant_ix"] == v] for v in (3, 4)}
    assert order[3] != order[4] and all(sorted(o) == list(range(9)) for o in order.values())
    assert all(r["as_alt"] == 2 * r["as_ref"] and r["z1"] == r["as_ref"] / 10 and r["kx"] == r["as_ref"] for r in got)


def test_samples_are_told_apart_by_their_full_path(spark, tmp_path):
    for i, d in enumerate(("a b", "c")):
        (tmp_path / d).mkdir()
        (tmp_path / d / "x.sam").write_text(SAM if i == 0 else SAM + SAM)
    samples = spark.createDataFrame([(0, f"{tmp_path}/a b/x.sam"), (1, f"{tmp_path}/c/x.sam")], "sample_ix long, path string")
    n = {r["sample_ix"]: r["count"] for r in sam.scan(spark, samples).groupBy("sample_ix").count().collect()}
    assert n[1] == 2 * n[0] > 0
