"""Switches of the fits, choices and checks of the run, and small sources and sinks."""

import gzip
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_fit import feature

from traitloom.operators import fit
from traitloom.operators import genotype as G
from traitloom.operators.likelihood import Hyper
from traitloom.plans import pipeline
from traitloom.sources import matrices


def with_model(f, model):
    f.model = model
    if "theta" in model.fixed:
        f.start[4] = np.log((f.h.kappa - 1) / f.h.omega)
    return f


def priors_of(z):
    h0 = np.stack([(1 - z[..., 0]) * (1 - z[..., 1]), 0 * z[..., 0], z[..., 0] * z[..., 1]], 2)
    h0[..., 1] = 1 - h0[..., 0] - h0[..., 2]
    return h0


@pytest.mark.parametrize("model", [fit.Model(as_only=True), fit.Model(trans=True), fit.Model(update=False), fit.Model(update=False, trans=True)])
def test_gradient_under_each_switch(model):
    f, z = feature()
    f = with_model(f, model)
    d = f.data(priors_of(z[:1]), fit.diplotypes(z[:1][:, :, None, :], f.x[None]))
    p = np.array([[0.4, -3.0, 0.2, 4.0, 1.2]])
    _, g = fit.evaluate(p, d, f.h, f.beta0)
    for i in range(5):
        e = np.zeros((1, 5))
        e[0, i] = 1e-5
        up, down = fit.evaluate(p + e, d, f.h, f.beta0)[0], fit.evaluate(p - e, d, f.h, f.beta0)[0]
        assert g[0, i] == pytest.approx((up - down)[0] / 2e-5, rel=1e-4, abs=1e-4)


def test_held_parameters_stay():
    f, z = feature(1, effect=0.7)
    f = with_model(f, fit.Model(fixed=("delta", "phi", "theta")))
    plain, joint = f.nulls()
    o = f.alternatives([0], z[:1], plain, joint, 0.0)
    assert fit.expit(o["p"][0, 1:3]) == pytest.approx([f.mode, 0.5]) and np.exp(o["p"][0, 4]) == pytest.approx(1.02 / 0.2)
    assert o["lr"][0] > 10
    with pytest.raises(ValueError, match="beta"):
        fit.Model(fixed=("beta",))


def test_allelic_reads_alone_and_counts_alone():
    f, z = feature(1, effect=0.7)
    f = with_model(f, fit.Model(as_only=True))
    o = f.alternatives([0], z[:1], *f.nulls(), 0.0)
    assert o["joint"][0] and o["lr"][0] > 10 and fit.expit(o["p"][0, 0]) > 0.6
    f.y = f.y[::-1].copy()  # counts don't matter
    again = f.alternatives([0], z[:1], *f.nulls(), 0.0)
    assert again["lr"][0] == pytest.approx(o["lr"][0], abs=1e-3)
    f, z = feature(1, effect=0.7)
    f = with_model(f, fit.Model(trans=True))
    o = f.alternatives([0], z[:1], *f.nulls(), 0.0)
    one = f.alternatives([0], z[:1], f.nulls()[0], None, 0.0)
    assert o["lr"][0] == pytest.approx(one["lr"][0], abs=2.0)  # reads add nothing on the effect


def test_without_update_priors_stay_posteriors():
    f, z = feature(1, effect=0.7)
    f = with_model(f, fit.Model(update=False))
    o = f.alternatives([0], z[:1], *f.nulls(), 0.0)
    assert o["post"][0] == pytest.approx(priors_of(z[:1])[0]) and o["lr"][0] > 10


def test_model_reaches_the_distributed_fit(spark):
    f, z = feature(1, effect=0.7)
    row = (5, f.y.tolist(), f.k.tolist(), f.dk.tolist(), f.w.tolist(), f.ids, f.x.transpose(1, 0, 2).ravel().tolist(), f.reads.transpose(1, 0, 2).ravel().tolist(), [])
    block = spark.createDataFrame([row], "feature_ix long, y array<double>, k array<double>, dk array<double>, w array<double>, fsnp array<bigint>, x array<double>, reads array<double>, kx array<double>")
    priors = spark.createDataFrame([(v, i, float(z[v, i, 0]), float(z[v, i, 1])) for v in range(2) for i in range(z.shape[1])], "variant_ix long, sample_ix long, z1 double, z2 double")
    tested = spark.createDataFrame([(5, 0), (5, 1)], "feature_ix long, variant_ix long")
    model = fit.Model(fixed=("phi",))
    got = fit.alt_fit(tested, priors, block, fit.null_fit(block, Hyper(), model=model), every=True, model=model).collect()
    assert len(got) == 2 and all(r["phi"] == pytest.approx(0.5) for r in got)


def test_choice_of_pairs(spark):
    pairs = spark.createDataFrame([(f, v, f"v{v}") for f in range(4) for v in range(9)], "feature_ix long, variant_ix long, variant_id string")
    O = pipeline.Options  # noqa: N806
    assert pipeline.chosen(pairs, O()).count() == 36
    assert {r["variant_ix"] for r in pipeline.chosen(pairs, O(only="v3")).collect()} == {3}
    one = sorted(map(tuple, pipeline.chosen(pairs, O(random_seed=1)).collect()))
    assert [r[0] for r in one] == [0, 1, 2, 3] and one == sorted(map(tuple, pipeline.chosen(pairs, O(random_seed=1)).collect()))
    assert len({tuple(sorted(map(tuple, pipeline.chosen(pairs, O(random_seed=s)).collect()))) for s in range(5)}) > 1


def test_checks_of_a_run(spark):
    n = spark.createDataFrame([(1, 5, 2, 9.0)], "feature_ix long, n_tested long, n_feature int, tot double")
    offsets = spark.createDataFrame([(1, 0, 3, 1.0)], "feature_ix long, sample_ix long, y long, k double")
    pipeline.validate(n, offsets, pipeline.Options(max_tested=5, max_feature=2))
    for a, b, o, said in ((n, offsets.limit(0), {}, "samples"), (n.limit(0), offsets, {}, "features"), (n, offsets, {"max_tested": 4}, "n_tested"), (n, offsets, {"max_feature": 1}, "n_feature")):
        with pytest.raises(ValueError, match=said):
            pipeline.validate(a, b, pipeline.Options(**o))


def test_conditional_list_and_weighted_quality(spark):
    d = spark.createDataFrame([("rs1:0.6,rs2:x,rs3,",), ("",), (None,)], "c string").select(G.parse_conditional(F.col("c")).alias("c"))
    got = [None if r["c"] is None else [tuple(x) for x in r["c"]] for r in d.collect()]
    assert got == [[("rs1", 0.6), ("rs2", None), ("rs3", None)], [], None]
    g = spark.createDataFrame([(1, 0, 1, 1.0), (1, 1, 1, 3.0), (1, None, None, 1.0), (2, None, None, 2.0)], "variant_ix long, h1 int, h2 int, w double")
    r = {x["variant_ix"]: (x["af"], x["call_rate"]) for x in G.weighted_quality(g).collect()}
    assert r[1] == pytest.approx((7 / 8, 0.8)) and r[2] == (None, 0.0)


def test_dimensions(spark, tmp_path):
    for name, text, want in (("t", "a\tb c\td\n\n1\t2\t3\n", (2, 3, 3, "\t")), ("c", "1,2\n3,4,5\n", (2, 2, 3, ",")), ("n", "1\n2\n", (2, 1, 1, None)), ("e", "", (0, 0, 0, None))):
        (tmp_path / name).write_text(text)
        assert tuple(matrices.dimensions(spark, str(tmp_path / name)).first()) == want


def test_counts_a_folder_a_sample(spark, tmp_path):
    d = spark.createDataFrame([(1, 0, 3, 4), (2, 0, 0, 1), (1, 7, 5, 6)], "variant_ix long, sample_ix long, as_ref long, as_alt long")
    matrices.write_by_sample(d, str(tmp_path / "o"))
    read = lambda i: sorted(x for p in Path(tmp_path / f"o/sample_ix={i}").glob("*.gz") for x in gzip.open(p, "rt").read().split("\n") if x)
    assert read(0) == ["1\t3\t4", "2\t0\t1"] and read(7) == ["1\t5\t6"]
