import math

import numpy as np
import pytest

from traitloom.operators import fit
from traitloom.operators.likelihood import Hyper


def feature(seed=0, n=40, m=3, effect=0.5):
    rnd = np.random.default_rng(seed)
    hap = rnd.random((m + 1, n, 2)) < 0.4
    z = np.clip(hap.astype(float), 0.01, 0.99)
    dose = np.where(hap[0], 2 * effect, 2 * (1 - effect)).sum(1) / 2
    k = rnd.uniform(0.7, 1.3, n)
    k /= k.mean()
    y = rnd.negative_binomial(8, 8 / (8 + 60 * k * dose))
    reads = np.zeros((m, n, 2))
    for l in range(m):
        for i in range(n):
            if hap[l + 1, i].sum() == 1:
                share = np.where(hap[0, i], effect, 1 - effect)
                alt = share[hap[l + 1, i]].sum() / share.sum()
                a = rnd.binomial(20, alt)
                reads[l, i] = 20 - a, a
            else:
                reads[l, i, int(hap[l + 1, i, 0])] = 20
    row = {"y": y, "k": k, "dk": np.ones(n), "fsnp": list(range(1, m + 1)), "x": z[1:].ravel(), "reads": reads.ravel()}
    return fit.Feature(row, Hyper()), z


def test_special_functions():
    x = np.array([1e-5, 0.1, 1.0, 2.5, 17.0, 1e4])
    assert fit.lgamma(x) == pytest.approx([math.lgamma(v) for v in x], abs=1e-9)
    e = 1e-5 * x
    assert fit.digamma(x) == pytest.approx([(math.lgamma(v + d) - math.lgamma(v - d)) / (2 * d) for v, d in zip(x, e, strict=True)], rel=1e-4)


def test_second_and_third_derivatives_of_log_gamma():
    x = np.array([1e-5, 0.1, 1.0, 2.5, 17.0, 1e4])
    e = 1e-4 * x
    assert fit.trigamma(x) == pytest.approx((fit.digamma(x + e) - fit.digamma(x - e)) / (2 * e), rel=1e-6)
    assert fit.psi2(x) == pytest.approx((fit.trigamma(x + e) - fit.trigamma(x - e)) / (2 * e), rel=1e-6)
    assert fit.trigamma(np.array([1.0]))[0] == pytest.approx(math.pi**2 / 6, rel=1e-10) and fit.psi2(np.array([1.0]))[0] == pytest.approx(-2 * 1.2020569031595942, rel=1e-10)


@pytest.mark.parametrize("model", [fit.Model(), fit.Model(as_only=True), fit.Model(trans=True), fit.Model(update=False), fit.Model(update=False, as_only=True)])
@pytest.mark.parametrize("reads", ["all", "some", "none"])
def test_hessian_is_that_of_the_gradient(model, reads):
    f, z = feature()
    f.model = model
    f.reads = f.reads * {"all": 1, "some": np.random.default_rng(3).random(f.reads.shape[:2])[..., None] < 0.4, "none": 0}[reads]
    h0, prior = fit.genotypes(z[:2]), f.diplotypes([0, 1], z[:2])  # the second is a feature variant itself
    w = np.random.default_rng(4).uniform(0.5, 2, len(f.y))
    for p0, q0 in ((h0, prior), (h0, None)):
        d = fit.Data(f.y, f.k, f.dk, w, p0, q0, *((f.reads, f.kx) if q0 is not None else ()), model=model)
        p = np.array([[0.4, -3.0, 0.2, 4.0, 1.2], [-1.0, -2.0, -0.5, 3.5, 0.3]])
        _, g, hess = fit.evaluate(p, d, f.h, f.beta0, second=True)
        for i in range(5):
            e = 1e-5 * np.eye(5)[i]
            up, down = fit.evaluate(p + e, d, f.h, f.beta0), fit.evaluate(p - e, d, f.h, f.beta0)
            assert g[:, i] == pytest.approx((up[0] - down[0]) / 2e-5, rel=1e-4, abs=1e-4)
            assert hess[:, i] == pytest.approx((up[1] - down[1]) / 2e-5, rel=1e-5, abs=1e-4)


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_em_reaches_the_likelihood_that_newton_steps_reach(seed):
    f, z = feature(seed, effect=0.65)
    h0, prior = fit.genotypes(z[:2]), f.diplotypes([0, 1], z[:2])
    d = f.data(h0, prior)
    start = np.tile(np.array([0.1, f.start[1], 0.1, f.beta0, 1.0]), (2, 1))
    for free in (f.model.free(*fit.NAMES), f.model.free("pi", "beta", "theta")):
        a, b = fit.climb(start, free, d, f.h, f.beta0), fit.em(start, free, d, f.h, f.beta0)
        assert (a["code"] == 0).all() and b["ll"] == pytest.approx(a["ll"], abs=1e-3)
        assert (b["ll"] <= a["ll"] + 1e-6).all()


def test_no_round_of_em_lowers_the_likelihood_and_q_is_its_bound():
    f, z = feature(5, effect=0.7)
    d = f.data(fit.genotypes(z[:2]), f.diplotypes([0, 1], z[:2]))
    p = np.array([[0.2, -2.0, 0.3, f.beta0 - 0.5, 0.0], [1.0, -1.0, -0.3, f.beta0 + 0.5, 3.0]])
    free = f.model.free(*fit.NAMES)
    values = [fit.evaluate(p, d, f.h, f.beta0)[0]]
    for _ in range(15):
        q = fit.expected(p, d, f.h, f.beta0)
        (was, slope), own = fit.evaluate(p, q, f.h, f.beta0), fit.evaluate(p, d, f.h, f.beta0)[1]
        assert slope == pytest.approx(own, abs=1e-6)  # Q touches the likelihood at the point of its posteriors
        new = fit.climb(p, free, q, f.h, f.beta0, fit.M_STEPS)["p"]
        now = fit.evaluate(new, q, f.h, f.beta0)[0]
        values.append(fit.evaluate(new, d, f.h, f.beta0)[0])
        assert (now >= was - 1e-9).all() and (values[-1] - values[-2] >= now - was - 1e-9).all()
        p = new
    assert (np.diff(values, axis=0) >= -1e-9).all()


def test_fits_that_stop_early_go_on_by_em(monkeypatch):
    f, z = feature(1, effect=0.7)
    d = f.data(fit.genotypes(z[:1]), f.diplotypes([0], z[:1]))
    start = np.array([[0.1, f.start[1], 0.1, f.beta0, 1.0]])
    best = fit.climb(start, f.model.free(*fit.NAMES), d, f.h, f.beta0)
    monkeypatch.setattr(fit, "STEPS", 2)
    monkeypatch.setattr(fit, "ROUNDS", 2000)
    went = fit.climb(start, f.model.free(*fit.NAMES), d, f.h, f.beta0, 2)
    assert went["code"][0] == 0 and went["itr"][0] > 2 and went["ll"][0] == pytest.approx(best["ll"][0], abs=1e-3)


def test_gradient_is_that_of_the_likelihood():
    f, z = feature()
    prior = fit.diplotypes(z[:1][:, :, None, :], f.x[None])
    h0 = np.stack([(1 - z[:1, :, 0]) * (1 - z[:1, :, 1]), z[:1, :, 0] * (1 - z[:1, :, 1]) + z[:1, :, 1] * (1 - z[:1, :, 0]), z[:1, :, 0] * z[:1, :, 1]], 2)
    d = f.data(h0, prior)
    p = np.array([[0.4, -3.0, 0.2, 4.0, 1.2]])
    _, g = fit.evaluate(p, d, f.h, f.beta0)
    for i in range(5):
        e = np.zeros((1, 5))
        e[0, i] = 1e-5
        up, down = fit.evaluate(p + e, d, f.h, f.beta0)[0], fit.evaluate(p - e, d, f.h, f.beta0)[0]
        assert g[0, i] == pytest.approx((up - down)[0] / 2e-5, rel=1e-4, abs=1e-4)


def test_simulated_effect_is_found_and_null_is_not():
    f, z = feature(1, effect=0.7)
    plain, joint = f.nulls()
    assert plain["code"][0] == 0 and joint["code"][0] == 0
    o = f.alternatives([0, 1], z[:2], plain, joint, 0.0)
    assert o["lr"][0] > 20 and fit.expit(o["p"][0, 0]) == pytest.approx(0.7, abs=0.08)
    assert o["joint"][0] and (o["lr"] >= -1e-6).all() and 0 <= o["r2_rsnp"][0] <= 1.0001
    f, z = feature(2, effect=0.5)
    o = f.alternatives([0], z[:1], *f.nulls(), 0.0)
    assert o["lr"][0] < 8


def test_allele_flip_mirrors_the_effect():
    f, z = feature(3, effect=0.65)
    plain, _ = f.nulls()
    a = f.alternatives([0], z[:1], plain, None, 0.0)
    b = f.alternatives([0], 1 - z[:1], plain, None, 0.0)
    assert a["lr"][0] == pytest.approx(b["lr"][0], abs=1e-3)
    assert a["p"][0, 0] == pytest.approx(-b["p"][0, 0], abs=1e-3)


def test_sample_order_does_not_matter():
    f, z = feature(4)
    plain, joint = f.nulls()
    o = np.random.default_rng(0).permutation(len(f.y))
    g, _ = feature(4)
    g.y, g.k, g.dk, g.x, g.reads = g.y[o], g.k[o], g.dk[o], g.x[o], g.reads[o]
    other, both = g.nulls()
    assert plain["ll"][0] == pytest.approx(other["ll"][0], abs=1e-6) and joint["ll"][0] == pytest.approx(both["ll"][0], abs=1e-3)


def test_imprinting_shows_in_allelic_counts():
    f, _ = feature(5)
    het = (f.reads[..., 0] > 0) & (f.reads[..., 1] > 0)
    f.reads[..., 0] = np.where(het, 19, f.reads[..., 0])
    f.reads[..., 1] = np.where(het, 1, f.reads[..., 1])
    side = np.random.default_rng(6).random(f.reads.shape[:2]) < 0.5
    f.reads = np.where((het & side)[..., None], f.reads[..., ::-1], f.reads)
    _, joint = f.nulls()
    assert f.imprint(joint)["lr"][0] > 10


def test_regression_recovers_coefficients():
    rnd = np.random.default_rng(7)
    n = 400
    x = np.column_stack([np.ones(n), rnd.normal(size=(n, 2))])
    k = rnd.uniform(0.5, 1.5, n)
    mean = k * np.exp(x @ [3.0, 0.4, -0.3])
    y = rnd.negative_binomial(6, 6 / (6 + mean))
    coef, theta, _, _ = fit.glm(y.astype(float), k, x)
    assert coef == pytest.approx([3.0, 0.4, -0.3], abs=0.1) and theta == pytest.approx(6, rel=0.3)


def test_posterior_haplotypes_keep_the_dosage():
    post = np.array([[0.1, 0.6, 0.3], [0.9, 0.1, 0.0], [0.25, 0.5, 0.25]])
    z = np.array([[0.9, 0.2], [0.1, 0.3], [0.5, 0.5]])
    h = fit.haplotypes(post, z)
    assert h.sum(1) == pytest.approx(2 * post[:, 2] + post[:, 1])
    assert h[0, 0] >= h[0, 1] and h[1, 0] <= h[1, 1]


def plain_phase(h, side):
    """One sample and feature variant, by enumerating the ordered haplotype pairs of each state."""
    c = x = 0.51
    last = -math.inf
    for _ in range(100):
        turned = {}
        for j, (cs, xs) in enumerate(zip(fit.C, fit.X)):
            for swap in (False, True) if cs[0] != cs[1] or xs[0] != xs[1] else (False,):
                a, b = (cs[::-1], xs[::-1]) if swap else (cs, xs)
                w = (1 if a[0] == a[1] else c if a[0] else 1 - c) * (1 if b[0] == b[1] else x if b[0] else 1 - x)
                turned[j, swap] = (w, a, b)
        tops = [0.0] * 4
        for (j, _), (w, a, b) in turned.items():
            share = h[j] * w / sum(v[0] for k, v in turned.items() if k[0] == j)
            if a[0] != a[1]:
                tops[a[0]] += share
            if b[0] != b[1]:
                tops[2 + b[0]] += share
        c, x = tops[1] / (tops[0] + tops[1]), tops[3] / (tops[2] + tops[3])
        same = c * x + (1 - c) * (1 - x)
        ll = h[4] * math.log(1 - same) + h[5] * math.log(same)
        if abs(ll - last) < 1e-8:
            break
        last = ll
    low, het = h[2] + h[6] + h[9], h[1] + h[4] + h[5] + h[8]
    out = [low + het * x, low + het * (1 - x)]
    return out[::-1] if (c - 0.5) * side < 0 else out


def test_feature_haplotypes_follow_the_phase():
    rng = np.random.default_rng(5)
    h = rng.dirichlet(np.full(10, 0.5), (40, 3)) + 1e-9
    h /= h.sum(2, keepdims=True)
    z = rng.random((40, 2))
    got = fit.phased(h, z)
    want = [[plain_phase(list(h[i, l]), z[i, 0] - z[i, 1]) for l in range(3)] for i in range(40)]
    assert np.allclose(got, want, atol=1e-6)
    dose = h[..., fit.X.sum(1) == 1].sum(2) + 2 * h[..., fit.X.sum(1) == 2].sum(2)
    assert np.allclose(got.sum(2), dose)


def test_sure_phase_and_homozygotes():
    h = np.zeros((4, 1, 10))
    h[0, 0, 5] = h[1, 0, 4] = h[2, 0, 9] = h[3, 0, 0] = 1
    z = np.array([[0.9, 0.1]] * 4)
    got = fit.phased(h, z)[:, 0]
    assert got[0, 0] > 0.99 and got[0, 1] < 0.01 and got[1].tolist() == [0.5, 0.5]
    assert np.allclose(fit.phased(h, z[:, ::-1])[0, 0], got[0, ::-1])
    assert got[2].tolist() == [1, 1] and got[3].tolist() == [0, 0]


def many(n=5):
    out = []
    for seed in range(n):
        f, z = feature(seed, n=20 + seed, m=2 + seed % 2, effect=0.5 + seed / 20)
        if seed == 1:
            f.reads[:] = 0  # feature variants without reads
        if seed == 2:
            f.reads[:2] *= 40  # more reads than a product is for
        if seed == 3:
            f.ids, f.x, f.reads = [], f.x[:, :0], f.reads[:, :0]
        out.append(f)
    return out


@pytest.mark.parametrize("model", [fit.Model(), fit.Model(as_only=True), fit.Model(fixed=("delta",))])
def test_null_models_climb_together_as_alone(model, monkeypatch):
    features, steps, plain = many(), [], fit.evaluate
    for f in features:
        f.model = model
    alone = [f.nulls() for f in features]
    tilted = [f.imprint(j) if j else None for f, (_, j) in zip(features, alone, strict=True)]
    monkeypatch.setattr(fit, "evaluate", lambda *a, **k: steps.append(1) or plain(*a, **k))
    together = fit.null_models(features)
    assert len(steps) < 120  # not a pass a feature
    some = [i for i, (_, j) in enumerate(together) if j]
    mixed = fit.imprint_models([features[i] for i in some], [alone[i][1] for i in some])
    assert [j is None for _, j in together] == [False, False, False, True, False]
    for (p, j), (a, b) in zip(together, alone, strict=True):
        assert p["ll"] == pytest.approx(a["ll"], abs=1e-8) and (j is None or j["ll"] == pytest.approx(b["ll"], abs=1e-8))
    for i, x in zip(some, mixed, strict=True):
        assert x["lr"] == pytest.approx(tilted[i]["lr"], abs=1e-7)


def test_null_models_are_those_of_all_states():
    """With ten states and three genotypes, as for tested variants, at pi one half: the same likelihood and slopes."""
    for f in [many()[i] for i in (0, 2, 4)]:
        f.w = np.random.default_rng(6).uniform(0.5, 2, len(f.y))
        half = np.full((1, len(f.y), len(f.ids), 2), 0.5)
        whole = f.data(np.tile(np.array([0.25, 0.5, 0.25]), (1, len(f.y), 1)), fit.diplotypes(half, f.x[None]))
        own = f.data(f.alike, fit.genotypes(f.x)[None], (3, 4, 6))
        p = np.array([[0.0, -2.0, 0.3, f.beta0 + 0.2, 1.0]])
        a, b, c = (fit.evaluate(p, d, f.h, f.beta0, second=True) for d in (whole, own, fit.Alike([own], np.array([f.beta0]))))
        for x in (b, c):
            assert x[0] == pytest.approx(a[0], abs=1e-8)
            assert x[1][:, 1:] == pytest.approx(a[1][:, 1:], abs=1e-7)
            assert x[2][:, 1:, 1:] == pytest.approx(a[2][:, 1:, 1:], abs=1e-6)
