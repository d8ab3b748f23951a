"""Queries that fit models see every pair that the tests of a feature see."""

import pytest

from traitloom.plans import pipeline, queries
from traitloom.plans.queries import Study
from traitloom.plans.queries5 import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["alt_fit", "posterior_haps"])
def test_fits_cover_all_tested_pairs(spark, name):
    pairs = {tuple(r) for r in queries.tested(Study(spark, SF)).select("feature_ix", "variant_ix").collect()}
    assert {tuple(r) for r in QUERIES[name](spark, SF).select("feature_ix", "variant_ix").collect()} == pairs


def test_report_counts_all_tested_pairs(spark):
    want = {r["feature_id"]: r["count"] for r in queries.tested(Study(spark, SF)).join(Study(spark, SF).features().select("feature_ix", "feature_id"), "feature_ix").groupBy("feature_id").count().collect()}
    rows = QUERIES["assoc_report"](spark, SF).select("feature_id", "n_tested", "snp_rank").collect()
    assert {r["feature_id"]: r["n_tested"] for r in rows} == want
    assert len(rows) == sum(want.values())


def test_permutation_moves_dk_with_counts(spark):
    offsets = spark.createDataFrame([(f, s, 10 * s, float(s)) for f in range(3) for s in range(9)], "feature_ix long, sample_ix long, y long, k double")
    dk = offsets.selectExpr("feature_ix", "sample_ix", "k + 0.5 as dk")
    a, b = pipeline.permuted(offsets, dk, 3)
    rows = a.join(b, ["feature_ix", "sample_ix"]).collect()
    assert len(rows) == 27 and all(r["y"] == 10 * r["k"] and r["dk"] == r["k"] + 0.5 for r in rows)
    assert any(r["k"] != r["sample_ix"] for r in rows)
