"""The E-step: a row a pair and feature variant, its states within the row."""

import math

import pytest
from pyspark.sql import functions as F

from traitloom.operators import genotype as G
from traitloom.operators import likelihood as L
from traitloom.plans.queries5 import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["em_estep_loglik", "em_estep_posterior", "map_genotype", "posterior_r2", "null_fit_check", "alt_fit_check"])
def test_states_are_no_rows_and_lines_are_read_once(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "l_orderkey" not in plan


def expected(r, pi, delta, phi):
    """Log-likelihood of one sample, state by state."""
    g = math.lgamma
    nb = lambda dose: (lambda m, s: g(s + r["y"]) - g(r["y"] + 1) - g(s) + r["y"] * math.log(m) + s * math.log(s) - (r["y"] + s) * math.log(m + s))(math.exp(r["beta"]) * r["k"] * dose, r["theta"] * r["k"] * dose)
    z1, z2 = r["z1"], r["z2"]
    own = [(1 - z1) * (1 - z2), z1 * (1 - z2) + z2 * (1 - z1), z1 * z2]
    total = []
    for x in range(3):
        if own[x] <= 0:
            continue
        v = math.log(own[x]) + nb((2 * (1 - pi), 1, 2 * pi)[x])
        for f in r["reads"]:
            parts = []
            for j, c, s in G.STATES:
                if c.count("1") != x:
                    continue
                hap = lambda p, q: (z1 if c[p] == "1" else 1 - z1) * (z2 if c[q] == "1" else 1 - z2) * (f["x1"] if s[p] == "1" else 1 - f["x1"]) * (f["x2"] if s[q] == "1" else 1 - f["x2"])  # noqa: B023, E731
                prior = hap(0, 1) + (hap(1, 0) if (c[0], s[0]) != (c[1], s[1]) else 0)
                if f["same"]:
                    prior = {0: own[0], 5: own[1], 9: own[2]}.get(j, 0)
                a = b = 0.0
                for i in range(2):
                    dose, error = 4 * (pi if c[i] == "1" else 1 - pi), delta if s[i] == "1" else 1 - delta
                    a, b = a + dose * error * (1 - phi) * r["theta"] * r["k"], b + dose * (1 - error) * phi * r["theta"] * r["k"]
                lb = lambda p, q: g(p) + g(q) - g(p + q)
                if prior > 0:
                    parts.append(math.log(prior / own[x]) - math.log(f["ref"] + f["alt"] + 1) - lb(f["ref"] + 1, f["alt"] + 1) + lb(f["ref"] + a, f["alt"] + b) - lb(a, b))
            top = max(parts)
            v += top + math.log(sum(math.exp(p - top) for p in parts))
        total.append(v)
    top = max(total)
    return top + math.log(sum(math.exp(v - top) for v in total))


@pytest.mark.parametrize("columns", [False, True])
def test_posteriors_of_few_many_and_no_reads(spark, columns):
    pi, delta, phi, theta = 0.62, 0.02, 0.45, 4.0
    at = [(0.1, 0.9), (0.999, 0.3), (0.5, 0.5), (1.0, 1.0), (0.0, 0.4), (0.2, 0.7)]
    reads = [[(7, 0.2, 0.8, 3, 1)], [(7, 0.0, 1.0, 5, 4), (8, 1.0, 1.0, 0, 900)], [(7, 0.4, 0.4, 0, 0)], [(7, 1.0, 0.0, 60, 2)], [], [(1, 0.2, 0.7, 2, 3), (9, 0.001, 0.999, 700, 650)]]
    base = [(1, 1, i, 5 + 3 * i, 0.8 + i / 10, *z, 2.0, theta) for i, z in enumerate(at)]
    d = spark.createDataFrame(base, "feature_ix long, variant_ix long, sample_ix long, y long, k double, z1 double, z2 double, beta double, theta double")
    x = spark.createDataFrame([(1, i, *r) for i, rs in enumerate(reads) for r in rs], "feature_ix long, sample_ix long, feature_variant long, x1 double, x2 double, as_ref long, as_alt long")
    if columns:
        d = d.withColumns({"pi": F.lit(pi), "delta": F.lit(delta), "phi": F.lit(phi)})
        got = L.e_step(d, x, F.col("pi"), F.col("delta"), F.col("phi"))
    else:
        got = L.e_step(d, x.join(d.select("feature_ix", "sample_ix", "k", "theta"), ["feature_ix", "sample_ix"]), pi, delta, phi)
    got = {r["sample_ix"]: r for r in got.collect()}
    for i, row in enumerate(base):
        r = dict(zip(d.columns, row, strict=False)) | {"reads": [{"same": v == 1, "x1": a, "x2": b, "ref": p, "alt": q} for v, a, b, p, q in reads[i]]}
        assert got[i]["loglik"] == pytest.approx(expected(r, pi, delta, phi), abs=1e-7)
        assert sum(got[i][f"p{g}"] or 0.0 for g in range(3)) == pytest.approx(1)


def test_log_gamma_is_accurate_enough_to_be_rounded(spark):
    from traitloom.functions import scalars as S

    x = [1e-3, 0.05, 0.3, 1.0, 2.5, 7.0]
    got = spark.createDataFrame([(v,) for v in x], "x double").select("x", S.log_gamma(F.col("x")).alias("v")).collect()
    assert all(abs(r["v"] - math.lgamma(r["x"])) < 2e-12 for r in got)
