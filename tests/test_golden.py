"""Values recomputed by hand from the definitions."""

import math

import pytest
from pyspark.sql import functions as F

from traitloom.functions import scalars as S
from traitloom.operators import genotype as G
from traitloom.operators import intervals as I
from traitloom.operators import likelihood as L
from traitloom.operators import offsets as O
from traitloom.operators import reads as R
from traitloom.operators import report as P


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_likelihood_terms(spark):
    nb = L.nb_log(F.lit(10.0), F.lit(12.0), F.lit(5.0))
    bb = L.bb_log(F.lit(1.0), F.lit(10.0), F.lit(2.06), F.lit(7.94))
    got = one(spark, nb, bb)
    assert got[0] == pytest.approx(-2.6931893215, abs=1e-9) and got[1] == pytest.approx(-1.4842146983, abs=1e-9)


def test_log_gamma_everywhere(spark):
    xs = [1e-5, 0.01, 0.5, 1.0, 3.7, 50.0, 1e4]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for r in df.select("x", S.log_gamma(F.col("x")).alias("g")).collect():
        assert r["g"] == pytest.approx(math.lgamma(r["x"]), abs=1e-9)


def test_allelic_weights(spark):
    want = [(0.792, 0.008), (0.4, 0.4), (0.008, 0.792), (1.98, 0.02), (1.588, 0.412), (0.412, 1.588), (0.02, 1.98), (3.168, 0.032), (1.6, 1.6), (0.032, 3.168)]
    for j, w in enumerate(want):
        a, b = G.allelic_weights(F.lit(0.8), F.lit(0.01), F.lit(0.5), j)
        assert tuple(one(spark, a, b)) == pytest.approx(w)


def test_quality_statistics(spark):
    rows = []
    for v, counts in enumerate([(6, 12, 6), (10, 8, 6), (20, 5, 0), (9, 0, 0)]):
        rows += [(v, i, g // 2 + g % 2, g // 2) for g, n in enumerate(counts) for i in range(n)]
    q = {r["variant_ix"]: r for r in G.variant_quality(spark.createDataFrame(rows, "variant_ix long, sample_ix long, h1 int, h2 int")).collect()}
    assert q[0]["hwe"] == pytest.approx(0) and q[1]["hwe"] == pytest.approx(2.3706122449) and q[2]["hwe"] == pytest.approx(0.3086419753)
    assert q[3]["hwe"] is None and q[3]["af"] == 0  # one allele only: no statistic, so no test either
    ap = spark.createDataFrame([(0, 0.0, 0.1), (0, 0.0, 0.9), (0, 0.9, 0.9), (0, 0.1, 0.1)], "variant_ix long, z1 double, z2 double")
    assert G.imputation_accuracy(ap).first()["ia"] == pytest.approx(0.712)


def test_missing_calls_are_left_out(spark):
    d = spark.createDataFrame([(0, 0, 1), (0, 1, 1), (0, None, None)], "variant_ix long, h1 int, h2 int")
    r = G.variant_quality(d).first()
    assert r["af"] == 0.75 and r["call_rate"] == pytest.approx(2 / 3)


def test_allelic_probabilities(spark):
    gl = G.gl2ap(G.likelihoods(F.lit("-4.0,-0.1,-0.6")), F.lit(0), F.lit(1), steps=2000)
    gp = G.gl2ap(G.probabilities(F.lit("0.01,0.99,0.0")), F.lit(0), F.lit(1), steps=2000)
    turned = G.gl2ap(G.probabilities(F.lit("0.01,0.99,0.0")), F.lit(1), F.lit(0), steps=2000)
    a, b, c = one(spark, gl, gp, turned)
    assert tuple(a) == pytest.approx((0.2402603406, 0.9998741182), abs=1e-8)
    assert tuple(b) == pytest.approx((1.01009e-5, 0.989999999), abs=1e-7) and tuple(c) == pytest.approx(tuple(b)[::-1])
    assert tuple(one(spark, *G.dose2ap(F.lit(0), F.lit(1), F.lit(1.1)))) == pytest.approx((0.1, 1.0))


@pytest.mark.parametrize(("info", "rsq", "af"), [("VT=SNP;RSQ=0.9", 0.9, None), ("IMP2=.2,.8,.01", 0.8, 0.2), ("DR2=.7", 0.7, None), ("none", None, None), ("RSQ=.9;DR2=.5", 0.5, None), ("DR2=.5;RSQ=.9", 0.9, None)])
def test_info_last_key_wins(spark, info, rsq, af):
    r = one(spark, G.parse_info(F.lit(info)).alias("i"))["i"]
    assert (r["rsq"], r["af"]) == (rsq, af)


def test_quantiles_and_tails(spark):
    assert S.chisq_quantile(1e-8) == pytest.approx(32.8412534, abs=1e-6) and S.chisq_quantile(0.05) == pytest.approx(3.8414588, abs=1e-6)
    for x in (0.2, 3.0, 12.0, 400.0):
        want = math.log10(math.erfc(math.sqrt(x / 2)))
        assert one(spark, S.log10_chisq_tail(F.lit(x)))[0] == pytest.approx(want, rel=1e-6)


def test_false_discovery_rates(spark):
    rows = [(1, i, f"v{i}", i, 0, lr) for i, lr in enumerate([12.0, 3.0, 0.0, 7.5, 0.2])]
    d = spark.createDataFrame(rows, "feature_ix long, variant_ix long, variant_id string, pos long, tss long, lr double")
    q = {r["variant_ix"]: r["log10_q"] for r in P.with_q(d).collect()}
    want = [-2.6720238823, -0.9546012980, 0.0, -1.9086919269, -0.1839438311]
    assert [q[i] for i in range(5)] == pytest.approx(want, abs=1e-6)


def test_lead_breaks_ties_by_distance(spark):
    rows = [(1, "a", 100, 50, 5.000001), (1, "b", 60, 50, 5.0000011), (1, "c", 40, 50, 5.000001), (1, "d", 50, 50, 4.9)]
    d = spark.createDataFrame(rows, "feature_ix long, variant_id string, pos long, tss long, lr double")
    r = P.lead(d).first()
    assert r["variant_id"] == "c" and r["n_ties"] == 2


def test_moment_start(spark):
    rows = [(0, i, y, k) for i, (y, k) in enumerate([(40, 0.8), (70, 1.1), (55, 1.0), (90, 1.3)])]
    r = O.moment_init(spark.createDataFrame(rows, "feature_ix long, sample_ix long, y long, k double")).first()
    v = [y / k for _, _, y, k in rows]
    mu = sum(v) / 4
    va = sum((x - mu) ** 2 for x in v) / 4
    theta = mu * mu / (va - mu)
    assert r["beta"] == pytest.approx(math.log(mu)) and r["theta"] == pytest.approx(min(max(34.0 if theta < 0 else theta, 0.001), 1000.0))


@pytest.mark.parametrize(("cigar", "length"), [("75M", 75), ("30M200N45M", 275), ("20M2I53M", 73), ("10S65M", 65), ("5H70M", 70), ("40M3D35M", 78), ("10=1X64=", 75)])
def test_cigar_lengths(spark, cigar, length):
    assert one(spark, R.ref_length(F.lit(cigar)))[0] == length


def test_blocks_and_counts(spark):
    seq = "ACGT" * 20
    frags = spark.createDataFrame([("q", 0, "1", 101, 180, "5H10M3D10M2I5M", seq)], "qname string, sample_ix long, chrom string, left long, right long, cigar string, seq string")
    got = [(r["start"], r["end"], r["read"]) for r in R.blocks(frags).collect()]
    assert got == [(101, 110, 5), (114, 123, 15), (124, 128, 27)]
    m = spark.createDataFrame([("1", 101, "a", "C", "G"), ("1", 111, "gap", "C", "G"), ("1", 114, "b", "A", "T"), ("1", 125, "c", "0", "1"), ("1", 128, "d", "T", "C")], "chrom string, pos long, variant_id string, a1 string, a2 string")
    cover = R.covered(frags, m, width=8)
    counts = {r["variant_id"]: (r["n_ref"], r["n_alt"], r["n_other"]) for r in R.allele_counts(cover).collect()}
    base = {"a": seq[5], "b": seq[15], "d": seq[31]}
    assert counts == {v: (int(base[v] == r), int(base[v] == a), int(base[v] not in (r, a))) for v, r, a in (("a", "C", "G"), ("b", "A", "T"), ("d", "T", "C"))}
    assert {r["variant_id"]: r["ds"] for r in R.expected_dosage(cover).collect()} == pytest.approx({"a": 1 / 3, "b": 1 / 3, "d": 1 / 3})


def pair(spark, pos1, pos2, cigar, mapq=(30, 30)):
    span = 75
    rows = [("q", 1, 99, "c1", pos1, mapq[0], cigar, "=", pos2, pos2 + span - pos1, "A" * 75, ["XM:i:0"], 0), ("q", 2, 147, "c1", pos2, mapq[1], "75M", "=", pos1, -(pos2 + span - pos1), "C" * 75, ["XM:i:0"], 0)]
    return spark.createDataFrame(rows, "qname string, mate int, flag int, chrom string, pos long, mapq int, cigar string, rnext string, pnext long, tlen long, seq string, tags array<string>, sample_ix long")


@pytest.mark.parametrize(("pos2", "cigar", "want", "bases"), [(276, "75M", "75M100N75M", 150), (176, "75M", "75M75M", 150), (131, "75M", "30M75M", 105), (201, "30M200N45M", "30M70N75M", 105), (131, "30M200N45M", "30M75M", 105)])
def test_mates_merge(spark, pos2, cigar, want, bases):
    r = R.pair(pair(spark, 101, pos2, cigar), R.Quality()).collect()
    assert len(r) == 1 and r[0]["cigar"] == want and len(r[0]["seq"]) == bases and r[0]["left"] == 101 and r[0]["right"] == pos2 + 74


def test_one_passing_mate_is_enough(spark):
    assert R.pair(pair(spark, 101, 276, "75M", (0, 30)), R.Quality()).count() == 1
    assert R.pair(pair(spark, 101, 276, "75M", (0, 0)), R.Quality()).count() == 0


def test_intervals_find_each_match_once(spark):
    points = spark.createDataFrame([(p, "1") for p in (1, 10, 19, 20, 21, 40)] + [(10, "2")], "pos long, chrom string")
    ivs = spark.createDataFrame([(1, "1", 10, 20), (2, "1", 20, 20), (3, "1", 0, 100)], "i long, chrom string, start long, end long")
    got = sorted((r["pos"], r["i"]) for r in I.points_in(points, ivs, 7).collect())
    assert got == sorted([(10, 1), (19, 1), (20, 1), (20, 2), *((p, 3) for p in (1, 10, 19, 20, 21, 40))])
    assert sorted(r["pos"] for r in I.in_any(points, ivs, 7).collect()) == [1, 10, 19, 20, 21, 40]


def test_ties_spread(spark):
    d = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 2.0), (3, 4.0)], "ix long, x double")
    got = {r["ix"]: r["spread"] for r in O.spread_ties(d).collect()}
    assert got == pytest.approx({0: 1.0, 1: 2.0, 2: 2.5, 3: 4.0})
