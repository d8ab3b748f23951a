"""Maximum-likelihood fits, vectorised over the tested variants of a chunk, as Arrow-batched grouped maps.

Parameters of a fit: logit pi (effect), logit delta (genotyping error), logit phi (reference bias), beta (log mean),
log theta (dispersion). The marginal log-likelihood over genotypes and diplotypes, with its priors, is climbed by
Newton steps. The gradient is the posterior mean of the complete-data gradient (the E-step); the Hessian is the mean of
the complete-data one and the posterior covariance of the gradient. Steps that don't climb are halved. Each variant
converges on its own and then stands still.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .genotype import STATES
from .likelihood import Hyper
from .matrix import permute

STEPS, TOL, GRAD_TOL = 60, 1e-4, 1e-5
BOX = np.array([[-16.118, 16.118]] * 3 + [[-100.0, 100.0], [math.log(1e-5), math.log(1e4)]])
C = np.array([[int(h) for h in c] for _, c, _ in STATES])
X = np.array([[int(h) for h in x] for _, _, x in STATES])
GENO = C.sum(1)
#: Starting points (delta at its prior's mode or one half, phi) of the null model with allelic counts.
RESTARTS = [(None, 0.1), (None, 0.9), (0.5, 0.1), (0.5, 0.9), (0.5, 0.5)]
NAMES = ("pi", "delta", "phi", "beta", "theta")


def gammas(x: np.ndarray, order: int = 2) -> tuple[np.ndarray, ...]:
    """log-gamma and its first ``order`` derivatives (0 to 3) for positive x.

    x is moved up by 8; the product of the eight numbers between, with its derivatives, takes the place of as many
    logarithms and quotients.
    """
    y = x + 8.0
    p, p1 = np.array(x, float), np.ones_like(y)
    p2 = p3 = np.zeros_like(y)
    for i in range(1, 8):
        f = x + i
        if order > 2:
            p3 = p3 * f + 3 * p2
        if order > 1:
            p2 = p2 * f + 2 * p1
        if order > 0:
            p1 = p1 * f + p
        p = p * f
    log, v = np.log(y), 1 / y
    r = v * v
    out = [(y - 0.5) * log - y + 0.5 * math.log(2 * math.pi) + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) * v - np.log(p)]
    if order > 0:
        q = p1 / p
        out.append(log - 0.5 * v - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r / 240))) - q)
    if order > 1:
        q2 = p2 / p
        out.append(v + r / 2 + r * v * (1 / 6 - r * (1 / 30 - r * (1 / 42 - r / 30))) + q * q - q2)
    if order > 2:
        out.append(-r - r * v - r * r * (1 / 2 - r * (1 / 6 - r * (1 / 6 - 3 * r / 10))) - (2 * q**3 - 3 * q * q2 + p3 / p))
    return tuple(out)


#: Reads up to which a difference of log-gammas is a product.
FEW = 16


def rises(x: np.ndarray, n: np.ndarray, order: int) -> list[np.ndarray]:
    """log-gamma(x + n) - log-gamma(x) and its first ``order`` derivatives (0 to 2) for positive x [S, K, ...] and n [K].

    A few reads make it the logarithm of a product, without a log-gamma; no reads make it zero.
    """
    out = [np.zeros_like(x) for _ in range(order + 1)]
    for m in np.unique(n[n > 0]):
        at = np.flatnonzero(n == m)
        v = x[:, at]
        if m > FEW or m != int(m):
            parts = [a - b for a, b in zip(gammas(v + m, order), gammas(v, order), strict=True)]
        else:
            parts = [v.copy(), np.zeros_like(v), np.zeros_like(v)]
            for i in range(int(m)):
                if i:
                    parts[0] *= v + i
                if order > 0:
                    u = 1 / (v + i)
                    parts[1] += u
                if order > 1:
                    parts[2] -= u * u
            parts[0] = np.log(parts[0])
        for o, part in zip(out, parts, strict=False):
            o[:, at] = part
    return out


def lgamma(x: np.ndarray) -> np.ndarray:
    return gammas(x, 0)[0]


def digamma(x: np.ndarray) -> np.ndarray:
    return gammas(x, 1)[1]


def trigamma(x: np.ndarray) -> np.ndarray:
    return gammas(x, 2)[2]


def psi2(x: np.ndarray) -> np.ndarray:
    """The third derivative of log-gamma."""
    return gammas(x, 3)[3]


def expit(x):
    return 1 / (1 + np.exp(-x))


def logit(p):
    return np.log(p / (1 - p))


@dataclass(frozen=True)
class Model:
    """Switches of a fit.

    ``fixed``: of delta, phi and theta those held at the mode of their priors. ``as_only``: counts say nothing, allelic
    reads alone do. ``trans``: the tested variant is elsewhere, so it moves counts but not allelic reads. ``update``:
    without it genotypes keep their priors as posteriors, and the parameters climb the mean of the complete-data
    log-likelihood under them; the likelihood of the result is the marginal one as ever.
    """

    fixed: tuple[str, ...] = ()
    as_only: bool = False
    trans: bool = False
    update: bool = True

    def __post_init__(self) -> None:
        if wrong := set(self.fixed) - {"delta", "phi", "theta"}:
            raise ValueError(f"can't be held: {sorted(wrong)}")

    def free(self, *names: str) -> np.ndarray:
        return np.array([c in names and c not in self.fixed for c in NAMES])


class Entries:
    """The K samples and feature variants that have reads, ordered by sample, as the U distinct ones among them say the same
    of each state: ``bases`` are the distinct offsets, ``b r q`` the offset's place and the reads of each distinct entry.
    """

    def __init__(self, reads: np.ndarray, kx: np.ndarray):
        n, l = np.nonzero(reads.sum(2) > 0)
        self.bases, b = np.unique(kx[n, l], return_inverse=True)
        r, q = reads[n, l].T
        order = np.lexsort((q, r, b, n))
        self.n, self.l = n[order], l[order]
        self.some, self.first = np.unique(self.n, return_index=True)
        reads_, r = np.unique(np.concatenate([r, q])[np.concatenate([order, len(n) + order])], return_inverse=True)
        r, q = r[: len(n)], r[len(n) :]
        distinct, self.u = np.unique((b[order] * len(reads_) + r) * len(reads_) + q, return_inverse=True)
        self.b, self.r, self.q = distinct // max(1, len(reads_) ** 2), reads_[distinct // max(1, len(reads_)) % max(1, len(reads_))], reads_[distinct % max(1, len(reads_))]
        self.by_u = np.argsort(self.u, kind="stable")
        self.laid()

    def laid(self) -> None:
        """What follows from ``bases``, ``b r q``, ``u`` and ``by_u``."""
        self.sorted = bool((self.by_u[1:] > self.by_u[:-1]).all())
        self.first_u = np.searchsorted(self.u[self.by_u], np.arange(len(self.b)))
        t = self.r + self.q
        many = (t > FEW) | (self.r != np.floor(self.r)) | (self.q != np.floor(self.q))
        self.many = np.flatnonzero(many)
        self.many_k = np.flatnonzero(many[self.u])
        self.top = [int(c[~many].max(initial=0)) for c in (self.r, self.q, t)]
        self.at = [np.minimum(c, top).astype(int) * len(self.bases) + self.b for c, top in zip((self.r, self.q, t), self.top, strict=True)]
        self.always = -np.log(t + 1) - (lgamma(self.r + 1) + lgamma(self.q + 1) - lgamma(t + 2))  # of the reads' log-probability
        self.factor = np.exp(self.always)

    def terms(self, a: np.ndarray, b: np.ndarray, order: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Of expected reads [J, B, S] the reads' probability [J, U, S], of ``many`` its logarithm, with the derivatives of the
        logarithm by ``a`` and ``b`` and, for ``order`` 2, the second ones by a, b and both.

        A ratio of gamma functions over few reads is a product; the products of the distinct offsets are made read by read.
        """
        found = []
        for x, top, at in zip((a, b, a + b), self.top, self.at, strict=True):
            t = [np.empty((x.shape[0], top + 1, *x.shape[1:])) for _ in range(order + 1)]
            t[0][:, 0] = 1
            for o in range(1, order + 1):
                t[o][:, 0] = 0
            for i in range(top):
                v = x + i
                np.multiply(t[0][:, i], v, out=t[0][:, i + 1])
                np.divide(1, v, out=v)
                np.add(t[1][:, i], v, out=t[1][:, i + 1])
                if order > 1:
                    np.multiply(v, v, out=v)
                    np.subtract(t[2][:, i], v, out=t[2][:, i + 1])
            found.append([np.take(v.reshape(len(v), -1, *x.shape[2:]), at, axis=1) for v in t])
        ra, rb, rn = found
        value = ra[0]
        value *= rb[0]
        value /= rn[0]
        value *= self.factor.reshape(-1, *[1] * (a.ndim - 2))
        if len(self.many):
            m, at = self.many, self.b[self.many]
            for x, n, into in ((a, self.r, ra), (b, self.q, rb), (a + b, self.r + self.q, rn)):
                got = rises(x[:, at], n[m], order)
                if into is ra:
                    logs = got[0]
                else:
                    logs = logs + got[0] if into is rb else logs - got[0]
                for o in range(1, order + 1):
                    into[o][:, m] = got[o]
            value[:, m] = logs + self.always[m].reshape(-1, *[1] * (a.ndim - 2))
        ra[1] -= rn[1]
        rb[1] -= rn[1]
        if order < 2:
            return value, [ra[1], rb[1]]
        ra[2] -= rn[2]
        rb[2] -= rn[2]
        return value, [ra[1], rb[1], ra[2], rb[2], -rn[2]]

    def by_sample(self, x: np.ndarray, n: int) -> np.ndarray:
        """Sums [..., N, S] over the K entries [..., K, S] of each sample."""
        out = np.zeros((*x.shape[:-2], n, x.shape[-1]))
        if len(self.n):
            out[..., self.some, :] = np.add.reduceat(x, self.first, axis=-2)
        return out

    def by_distinct(self, x: np.ndarray) -> np.ndarray:
        """Sums [J, U, S] of [J, K, S] over the entries that are the same."""
        if not len(self.n):
            return x
        return np.add.reduceat(x if self.sorted else np.take(x, self.by_u, axis=1), self.first_u, axis=1)


class ByState:
    """States in whole blocks, one a genotype."""

    blocks: list[slice]

    def of_states(self, x: np.ndarray) -> np.ndarray:
        """Sums [G, ...] over the states [J, ...] of each genotype."""
        return np.stack([x[at].sum(0) for at in self.blocks])

    def times(self, x: np.ndarray, by: np.ndarray) -> np.ndarray:
        """States [J, ...] in place times their genotype's [G, ...]."""
        for at, v in zip(self.blocks, by, strict=True):
            x[at] *= v
        return x


@dataclass
class Data(ByState):
    """``y k dk w``: samples; ``h0``: [S, N, G] priors of genotypes, G three, or one where they are all alike; ``prior``:
    [S, N, L, J] priors of ``states``; ``reads``: [N, L, 2]; ``kx``: [N, L], the offset of the sample that a feature variant's
    reads come from (not the same as ``k`` once they are permuted).

    Of samples and feature variants those with reads have a likelihood that the parameters change; the others add to each
    genotype what their prior says, once for all. Within, fits are the last axis: states and genotypes are whole blocks.
    """

    y: np.ndarray
    k: np.ndarray
    dk: np.ndarray
    w: np.ndarray
    h0: np.ndarray
    prior: np.ndarray | None = None
    reads: np.ndarray | None = None
    kx: np.ndarray | None = None
    model: Model = field(default_factory=Model)
    states: tuple[int, ...] = tuple(range(10))
    entries: Entries | None = None
    known: tuple | None = None

    def __post_init__(self) -> None:
        one = self.h0.shape[2] == 1
        self.genos = (1,) if one else (0, 1, 2)
        self.blocks = [slice(0, len(self.states))] if one else [slice(0, 3), slice(3, 7), slice(7, 10)]
        if self.known is not None:
            return
        h0 = np.ascontiguousarray(self.h0.transpose(2, 1, 0))
        with np.errstate(divide="ignore"):
            self.known = (h0, np.log(h0))
        if self.prior is None:
            return
        if self.entries is None:
            self.entries = Entries(self.reads, np.repeat(self.k[:, None], self.reads.shape[1], 1) if self.kx is None else self.kx)
        e = self.entries
        geno = np.zeros(len(self.states), int) if one else GENO
        share = np.divide(self.prior, self.h0[:, :, None, geno], out=np.zeros_like(self.prior), where=self.prior > 0)
        total = np.stack([share[..., x].sum(-1) for x in self.blocks])  # [G, S, N, L]
        total[:, :, e.n, e.l] = 1
        rest = np.log(np.where(total > 0, total, 1)).sum(-1).transpose(0, 2, 1)
        self.known += (np.ascontiguousarray(share[:, e.n, e.l].transpose(2, 1, 0)), rest)

    def take(self, at: np.ndarray) -> Data:
        prior = None if self.prior is None else self.prior[at]
        return Data(self.y, self.k, self.dk, self.w, self.h0[at], prior, self.reads, self.kx, self.model, self.states, self.entries, tuple(x[..., at] for x in self.known))


@dataclass
class Allelic:
    """Expected reads of the states, 4 * theta * k times ``a`` and ``b`` [J, S], with derivatives by logit pi, logit
    delta, logit phi and log theta: ``ga gb`` [J, 4, S] and ``gga ggb`` [J, 4, 4, S]."""

    a: np.ndarray
    b: np.ndarray
    ga: np.ndarray
    gb: np.ndarray
    gga: np.ndarray
    ggb: np.ndarray


def allelic(pi: np.ndarray, delta: np.ndarray, phi: np.ndarray, trans: bool, states: tuple[int, ...]) -> Allelic:
    """``pi delta phi``: [S]."""
    share = np.full_like(pi, 0.5) if trans else pi
    move = 0 * pi if trans else pi * (1 - pi)
    c, x = C[list(states)][:, :, None], X[list(states)][:, :, None]  # [J, 2, 1]
    sign_c, sign_x = np.where(c == 1, 1, -1), np.where(x == 1, 1, -1)
    hap, err = np.where(c == 1, share, 1 - share), np.where(x == 1, delta, 1 - delta)
    d1 = delta * (1 - delta)
    h = [hap, sign_c * move, sign_c * (move * (1 - 2 * pi))]
    e = [err, sign_x * d1, sign_x * (d1 * (1 - 2 * delta))]
    lo, up = [1 - phi, -phi * (1 - phi), -phi * (1 - phi) * (1 - 2 * phi)], [phi, phi * (1 - phi), phi * (1 - phi) * (1 - 2 * phi)]
    right = [1 - err, -e[1], -e[2]]

    def table(last: list, factor: list):
        """Value, gradient and second derivatives: products of a derivative in each of pi, delta and phi."""
        f = {(i, j): 4 * (h[i] * last[j]).sum(1) for i in range(3) for j in range(3) if i + j <= 2}
        at = lambda i, j, k: f[i, j] * factor[k]
        v, g = at(0, 0, 0), [at(1, 0, 0), at(0, 1, 0), at(0, 0, 1)]
        hh = [[at(2, 0, 0), at(1, 1, 0), at(1, 0, 1)], [at(1, 1, 0), at(0, 2, 0), at(0, 1, 1)], [at(1, 0, 1), at(0, 1, 1), at(0, 0, 2)]]
        grad = np.stack([*g, v], 1)  # log theta scales all
        second = np.stack([np.stack([*hh[i], g[i]], 1) for i in range(3)] + [grad], 1)
        return v, grad, second

    a, ga, gga = table(e, lo)
    b, gb, ggb = table(right, up)
    return Allelic(a, b, ga, gb, gga, ggb)


#: Where the parameters of the allelic reads stand among all.
ALLELIC = np.array([0, 1, 2, 4])


def said(d: Data, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logs [G, K, S] of the probabilities of the reads given each genotype, and the states' shares of them [J, K, S].

    A genotype without states says nothing: 0. ``value`` is what ``Entries.terms`` gives.
    """
    e, share = d.entries, d.known[2]
    inner = np.take(value, e.u, axis=1)
    tops = None
    if len(at := e.many_k):
        with np.errstate(divide="ignore"):
            t = np.log(share[:, at]) + inner[:, at]
        tops = np.stack([t[x].max(0) for x in d.blocks])
        tops = np.where(np.isfinite(tops), tops, 0)
        for x, top in zip(d.blocks, tops, strict=True):
            t[x] = np.exp(t[x] - top)
        inner[:, at] = 1
    inner *= share
    if tops is not None:
        inner[:, at] = t
    total = d.of_states(inner)
    total[total <= 0] = 1
    ls = np.log(total)
    if tops is not None:
        ls[:, at] += tops
    return ls, d.times(inner, np.divide(1, total, out=total))


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers from each first one on."""
    return np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())


def sums(x: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sums [..., M] of runs of ``count`` along the last axis, none of which is a sum of 0."""
    out = np.zeros((*x.shape[:-1], len(count)))
    at = np.flatnonzero(count)
    if len(at):
        out[..., at] = np.add.reduceat(x, (np.cumsum(count) - count)[at], axis=-1)
    return out


class Alike(ByState):
    """Fits of many features at once where genotypes are all alike, M of them: their samples, entries and distinct entries
    lie one fit after the other, so a step of all fits is one pass over flat arrays.

    ``one``: the ``Data`` of each fit, with one start; ``beta0``: [M].
    """

    def __init__(self, one: list[Data], beta0: np.ndarray):
        self.one, self.beta0, self.model, self.states = one, beta0, one[0].model, one[0].states
        join = lambda xs, axis=0: np.concatenate(list(xs), axis)
        size = lambda xs: np.array([len(x) for x in xs])
        self.samples = size(d.y for d in one)
        self.y, self.k, self.w = (join(getattr(d, c) for d in one) for c in ("y", "k", "w"))
        self.mk = self.k * join(d.dk for d in one)
        self.always = lgamma(self.y + 1)
        self.entries = None
        if one[0].prior is None:
            return
        es = [d.entries for d in one]
        self.counts = {"k": size(e.u for e in es), "u": size(e.b for e in es), "b": size(e.bases for e in es)}
        self.lay(join(e.bases for e in es), join(e.b for e in es), join(e.r for e in es), join(e.q for e in es), join(e.u for e in es), join(e.by_u for e in es))
        self.wk = join(d.w[d.entries.n] for d in one)
        self.known = (None, None, join((d.known[2][..., 0] for d in one), 1))

    def lay(self, bases: np.ndarray, b: np.ndarray, r: np.ndarray, q: np.ndarray, u: np.ndarray, by_u: np.ndarray) -> None:
        """The entries of all fits as one, from numbers within each fit."""
        c = self.counts
        self.local = (b, u, by_u)
        start = {x: np.cumsum(n) - n for x, n in c.items()}
        e = Entries.__new__(Entries)
        e.bases, e.r, e.q = bases, r, q
        e.b, e.u, e.by_u = b + np.repeat(start["b"], c["u"]), u + np.repeat(start["u"], c["k"]), by_u + np.repeat(start["k"], c["k"])
        e.n = e.u  # there are entries
        e.laid()
        self.entries, self.blocks = e, [slice(0, len(self.states))]

    def take(self, at: np.ndarray) -> Alike:
        out = Alike.__new__(Alike)
        out.one, out.beta0, out.model, out.states = [self.one[i] for i in at], self.beta0[at], self.model, self.states
        part = lambda n: ranges((np.cumsum(n) - n)[at], n[at])
        rows = part(self.samples)
        out.samples, out.entries = self.samples[at], None
        out.y, out.k, out.w, out.mk, out.always = (x[rows] for x in (self.y, self.k, self.w, self.mk, self.always))
        if self.entries is not None:
            k, u, b = (part(self.counts[x]) for x in "kub")
            out.counts = {x: n[at] for x, n in self.counts.items()}
            e, (lb, lu, lo) = self.entries, self.local
            out.lay(e.bases[b], lb[u], e.r[u], e.q[u], lu[k], lo[k])
            out.wk, out.known = self.wk[k], (None, None, self.known[2][:, k])
        return out

    def evaluate(self, p: np.ndarray, h: Hyper, second: bool) -> tuple:
        """As ``evaluate``, a row of p [M, 5] a fit."""
        m = len(p)
        each = lambda x: np.repeat(x, self.samples, axis=-1)
        theta = np.exp(p[:, 4])
        size, mean, y, w = self.k * each(theta), self.mk * each(np.exp(p[:, 3])), self.y, self.w
        both = mean + size
        over, log_size, log_both = (y + size) / both, np.log(size), np.log(both)
        more, less = gammas(size + y, 1 + second), gammas(size, 1 + second)
        nb = more[0] - self.always - less[0] + y * np.log(mean) + size * log_size - (y + size) * log_both
        by_size = size * (more[1] - less[1] + log_size + 1 - log_both - over)
        by_mean = y - mean * over
        counted = 0.0 if self.model.as_only else 1.0
        out, hess = np.zeros((5, m)), np.zeros((5, 5, m))
        ll, out[3], out[4] = sums(np.stack([nb, by_mean, by_size]) * (counted * w), self.samples)
        if second:
            ss = by_size + size * size * (more[2] - less[2] + 1 / size - 1 / both - (mean - y) / (both * both))
            mm, sm = -mean * (y + size) * size / (both * both), -mean * size * (mean - y) / (both * both)
            hess[3, 3], hess[3, 4], hess[4, 4] = sums(np.stack([mm, sm, ss]) * (counted * w), self.samples)
            hess[4, 3] = hess[3, 4]
        if self.entries is not None:
            e, c = self.entries, self.counts
            v = allelic(*(expit(p[:, i]) for i in range(3)), self.model.trans, self.states)
            of = {x: np.repeat(np.arange(m), n) for x, n in c.items() if x != "k"}
            base = e.bases * theta[of["b"]]
            value, terms = e.terms(base * v.a[:, of["b"]], base * v.b[:, of["b"]], 1 + second)
            ls, inner = said(self, value)
            ll = ll + sums(ls[0] * self.wk, c["k"])
            ws, own = e.by_distinct(inner * self.wk), base[e.b]
            alpha, gamma = terms[0] * own, terms[1] * own
            la, lb = sums(ws * alpha, c["u"]), sums(ws * gamma, c["u"])  # [J, M]
            out[ALLELIC] += np.einsum("js,jis->is", la, v.ga) + np.einsum("js,jis->is", lb, v.gb)
            if second:
                own = own * own
                kaa, kbb, kab = (sums(ws * (x * own + z), c["u"])[:, None] for x, z in zip(terms[2:], (alpha * alpha, gamma * gamma, alpha * gamma), strict=True))
                add = np.einsum("jis,jms->ims", kaa * v.ga + kab * v.gb, v.ga) + np.einsum("jis,jms->ims", kbb * v.gb + kab * v.ga, v.gb)
                add += np.einsum("js,jims->ims", la, v.gga) + np.einsum("js,jims->ims", lb, v.ggb)
                means = []
                for i in range(4):
                    x = np.take(alpha * v.ga[:, i, of["u"]] + gamma * v.gb[:, i, of["u"]], e.u, axis=1)
                    x *= inner
                    means.append(x.sum(0))
                for i in range(4):
                    x = self.wk * means[i]
                    for j in range(i + 1):
                        part = sums(x * means[j], c["k"])
                        add[i, j] -= part
                        if i != j:
                            add[j, i] -= part
                hess[np.ix_(ALLELIC, ALLELIC)] += add
        return with_priors(p, ll, out, hess if second else None, h, self.beta0)


def with_priors(p: np.ndarray, ll: np.ndarray, out: np.ndarray, hess: np.ndarray | None, h: Hyper, beta0: float | np.ndarray) -> tuple:
    """Log-likelihood [S], gradient [S, 5] and Hessian [S, 5, 5] with those of the priors, from [S], [5, S] and [5, 5, S]."""
    pi, delta, phi = (expit(p[:, i]) for i in range(3))
    beta, theta = p[:, 3], np.exp(p[:, 4])
    const = h.kappa / 2 * math.log(h.omega / 2) - math.lgamma(h.kappa / 2) - 0.5 * math.log(2 * math.pi) - 0.5 * math.log(h.sigma2)
    ll = ll + const + (h.kappa / 2 - 1) * np.log(theta) - h.omega * theta / 2 + 0.5 * np.log(theta) - theta * (beta - beta0) ** 2 / (2 * h.sigma2)
    ll = ll + (h.adelta - 1) * np.log(delta) + (h.bdelta - 1) * np.log(1 - delta) + (h.abpi - 1) * np.log(pi * (1 - pi)) + (h.abphi - 1) * np.log(phi * (1 - phi))
    out[0] += (h.abpi - 1) * (1 - 2 * pi)
    out[1] += (h.adelta - 1) * (1 - delta) - (h.bdelta - 1) * delta
    out[2] += (h.abphi - 1) * (1 - 2 * phi)
    out[3] += -theta * (beta - beta0) / h.sigma2
    away = 0.5 * theta * (beta - beta0) ** 2 / h.sigma2
    out[4] += 0.5 - away + (h.kappa / 2 - 1) - h.omega / 2 * theta
    out = np.ascontiguousarray(out.T)
    if hess is None:
        return ll, out
    hess[0, 0] -= 2 * (h.abpi - 1) * pi * (1 - pi)
    hess[1, 1] -= (h.adelta + h.bdelta - 2) * delta * (1 - delta)
    hess[2, 2] -= 2 * (h.abphi - 1) * phi * (1 - phi)
    hess[3, 3] -= theta / h.sigma2
    hess[3, 4] -= theta * (beta - beta0) / h.sigma2
    hess[4, 3] -= theta * (beta - beta0) / h.sigma2
    hess[4, 4] -= away + h.omega / 2 * theta
    return ll, out, np.ascontiguousarray(hess.transpose(2, 0, 1))


def evaluate(p: np.ndarray, d: Data | Alike, h: Hyper, beta0: float, full: bool = False, second: bool = False):
    """Log-likelihood [S] and gradient [S, 5] at p [S, 5]; with ``second`` also the Hessian [S, 5, 5], with ``full`` the
    posteriors of genotypes and diplotypes."""
    if isinstance(d, Alike):
        return d.evaluate(p, h, second)
    pi, delta, phi = (expit(p[:, i]) for i in range(3))
    beta, theta = p[:, 3], np.exp(p[:, 4])
    s, n = len(p), len(d.y)
    known = {0: (2 * (1 - pi), -pi), 1: (np.ones(s), np.zeros(s)), 2: (2 * pi, 1 - pi)}
    dose, ratio = (np.stack([known[x][i] for x in d.genos])[:, None] for i in range(2))  # [G, 1, S], and of log dose by logit pi
    y = d.y[None, :, None]
    size = (d.k[:, None] * theta) * dose
    mean = ((d.k * d.dk)[:, None] * np.exp(beta)) * dose
    both = mean + size
    over, log_size, log_both = (y + size) / both, np.log(size), np.log(both)
    more, less = gammas(size + y, 1 + second), gammas(size, 1 + second)
    nb = more[0] - lgamma(y + 1) - less[0] + y * np.log(mean) + size * log_size - (y + size) * log_both
    by_size = size * (more[1] - less[1] + log_size + 1 - log_both - over)
    by_mean = y - mean * over
    if d.model.as_only:
        nb, by_size, by_mean = 0 * nb, 0 * by_size, 0 * by_mean
    h0, g = d.known[0], d.known[1] + nb
    inner = None
    if d.prior is not None:
        e = d.entries
        v = allelic(pi, delta, phi, d.model.trans, d.states)
        base = e.bases[:, None] * theta  # [B, S]
        value, terms = e.terms(base * v.a[:, None], base * v.b[:, None], 1 + second)
        ls, inner = said(d, value)
        g = g + d.known[3] + e.by_sample(ls, n)
    top = g.max(0)
    if d.model.update:
        post = np.exp(g - top)
        total = post.sum(0)
        ll_i = top + np.log(total)
        post /= total
    else:
        post = h0 + np.zeros(s)
        ll_i = (post * nb).sum(0)
        if inner is not None:
            held = d.times(d.known[2] + np.zeros(s), h0[:, e.n])
            few = np.setdiff1d(np.arange(len(e.b)), e.many)
            value[:, few] = np.log(value[:, few])
            ll_i = ll_i + e.by_sample((held * np.take(value, e.u, axis=1)).sum(0), n)
    wp = post * d.w[:, None]
    out, hess = np.zeros((5, s)), np.zeros((5, 5, s))
    moved = (by_size + by_mean) * ratio
    noise = d.model.update and len(d.genos) > 1  # of genotypes: it adds the gradient's spread
    if second:
        ss = by_size + (0 if d.model.as_only else size * size * (more[2] - less[2] + 1 / size - 1 / both - (mean - y) / (both * both)))
        mm, sm = -mean * (y + size) * size / (both * both), -mean * size * (mean - y) / (both * both)
        if d.model.as_only:
            mm, sm = 0 * mm, 0 * sm
        total = lambda x: (wp * x).sum((0, 1))
        curve = np.stack([np.zeros(s) if x == 1 else -pi * (1 - pi) for x in d.genos])[:, None]
        for i, j, x in ((0, 0, (by_size + by_mean) * curve + ratio * ratio * (ss + 2 * sm + mm)), (0, 3, ratio * (sm + mm)), (0, 4, ratio * (ss + sm)), (3, 3, mm), (3, 4, sm), (4, 4, ss)):
            hess[i, j] = hess[j, i] = total(x)
        if noise:
            moves = np.zeros((5, *g.shape))  # complete-data gradient of each genotype and sample
            moves[0], moves[3], moves[4] = moved, by_mean, by_size
    if inner is not None:
        if d.model.update:
            held = d.times(inner.copy(), wp[:, e.n])
        else:
            held = held * d.w[e.n][:, None]
        ws = e.by_distinct(held)
        spread_, own = d.model.update, base[e.b]  # [U, S]
        alpha, gamma = terms[0] * own, terms[1] * own
        la, lb = np.einsum("jus,jus->js", ws, alpha), np.einsum("jus,jus->js", ws, gamma)
        out[ALLELIC] += np.einsum("js,jis->is", la, v.ga) + np.einsum("js,jis->is", lb, v.gb)
        if second:
            own = own * own
            kaa, kbb, kab = (x * own for x in terms[2:])
            if spread_:
                kaa += alpha * alpha
                kbb += gamma * gamma
                kab += alpha * gamma
            kaa, kbb, kab = (np.einsum("jus,jus->js", ws, x)[:, None] for x in (kaa, kbb, kab))
            add = np.einsum("jis,jms->ims", kaa * v.ga + kab * v.gb, v.ga) + np.einsum("jis,jms->ims", kbb * v.gb + kab * v.ga, v.gb)
            add += np.einsum("js,jims->ims", la, v.gga) + np.einsum("js,jims->ims", lb, v.ggb)
            if spread_:
                weight = wp[:, e.n]
                means = []
                for i in range(4):
                    x = alpha * v.ga[:, i, None]
                    x += gamma * v.gb[:, i, None]
                    x = np.take(x, e.u, axis=1)
                    x *= inner
                    means.append(d.of_states(x))  # [G, K, S]
                    if noise:
                        moves[ALLELIC[i]] += e.by_sample(means[i], n)
                for i in range(4):
                    x = weight * means[i]
                    for j in range(i + 1):
                        part = np.einsum("gks,gks->s", x, means[j])
                        add[i, j] -= part
                        if i != j:
                            add[j, i] -= part
            hess[np.ix_(ALLELIC, ALLELIC)] += add
    out[0] += (wp * moved).sum((0, 1))
    out[3] += (wp * by_mean).sum((0, 1))
    out[4] += (wp * by_size).sum((0, 1))
    if second and noise:
        centre = (post * moves).sum(1)  # [5, N, S]
        for i in range(5):
            a, c = wp * moves[i], d.w[:, None] * centre[i]
            for j in range(i + 1):
                part = np.einsum("gns,gns->s", a, moves[j]) - np.einsum("ns,ns->s", c, centre[j])
                hess[i, j] += part
                if i != j:
                    hess[j, i] += part
    got = with_priors(p, (ll_i * d.w[:, None]).sum(0), out, hess if second else None, h, beta0)
    if second:
        return got
    ll, out = got
    if not full:
        return ll, out
    post = post.transpose(2, 1, 0)
    return ll, out, post, None if inner is None else states_of(d, inner.transpose(2, 1, 0), post)


def states_of(d: Data, inner: np.ndarray, post: np.ndarray) -> np.ndarray:
    """Posteriors of the diplotypes [S, N, L, J]: with reads ``inner``, else the prior's shares, of each genotype's posterior."""
    if not d.model.update:
        return d.prior
    share = np.empty_like(d.prior)
    for at in d.blocks:
        total = d.prior[..., at].sum(-1, keepdims=True)
        share[..., at] = d.prior[..., at] / np.where(total > 0, total, 1)
    share[:, d.entries.n, d.entries.l] = inner
    for x, at in enumerate(d.blocks):
        share[..., at] *= post[:, :, None, x, None]
    return share


def expected(p: np.ndarray, d: Data, h: Hyper, beta0: float) -> Data:
    """The E-step: data whose priors are the posteriors at p. ``evaluate`` on it, without their update, is the mean of the
    complete-data log-likelihood under them: the function Q of EM."""
    _, _, post, states = evaluate(p, d, h, beta0, True)
    return Data(d.y, d.k, d.dk, d.w, post, states, d.reads, d.kx, replace(d.model, update=False), d.states, d.entries)


#: Rounds of EM at most, and Newton steps on Q in each.
ROUNDS, M_STEPS = 231, 3


def em(start: np.ndarray, free: np.ndarray, d: Data, h: Hyper, beta0: float) -> dict[str, np.ndarray]:
    """The same as ``climb`` by expectation and maximisation: no round lowers the likelihood, whatever its curvature.

    Slower near the optimum than Newton steps on the likelihood itself, so ``climb`` asks for it where these stop early.
    """
    p = np.clip(start.astype(float), BOX[:, 0], BOX[:, 1])
    s = len(p)
    ll, g = evaluate(p, d, h, beta0)
    itr, last, done = np.zeros(s, int), np.full(s, np.inf), np.zeros(s, bool)
    for step in range(1, ROUNDS + 1):
        at = np.flatnonzero(~done)
        if not len(at):
            break
        sub = d.take(at)
        new = climb(p[at], free, expected(p[at], sub, h, beta0), h, beta0, M_STEPS)["p"]
        nl, ng = evaluate(new, sub, h, beta0)
        good = nl >= ll[at] - 1e-12
        up = at[good]
        last[at] = np.where(good, np.abs(nl - ll[at]), 0.0)
        p[up], ll[up], g[up] = new[good], nl[good], ng[good]
        itr[at] = step
        edge = (np.abs(p[at] - BOX[:, 0]) < 1e-9) | (np.abs(p[at] - BOX[:, 1]) < 1e-9)
        done[at] = ((last[at] < TOL) & ((np.abs(g[at]) < GRAD_TOL) | edge | ~free).all(1)) | ~good
    return ended(p, ll, g, evaluate(p, d, h, beta0, second=True)[2], itr, last, free, d, h, beta0)


def ended(p: np.ndarray, ll: np.ndarray, g: np.ndarray, hess: np.ndarray, itr: np.ndarray, last: np.ndarray, free: np.ndarray, d: Data, h: Hyper, beta0: float) -> dict[str, np.ndarray]:
    """What a fit returns of its last points: with the convergence code and the Laplace factor."""
    idx = np.flatnonzero(free)
    bad = (np.abs(g) >= GRAD_TOL) & free & (p > BOX[:, 0] + 1e-9) & (p < BOX[:, 1] - 1e-9)
    code = np.where(last < TOL, 0, 1_000_000) + bad @ np.array([10_000, 1_000, 100, 10, 1])
    if not d.model.update:
        ll = evaluate(p, replace(d, model=replace(d.model, update=True)), h, beta0)[0]
    _, logdet = np.linalg.slogdet(-hess[np.ix_(range(len(p)), idx, idx)])
    return {"p": p, "ll": ll, "itr": itr, "code": code, "log_bf": ll - 0.5 * logdet + 0.5 * math.log(2 * math.pi) * len(idx)}


def climb(start: np.ndarray, free: np.ndarray, d: Data, h: Hyper, beta0: float, steps: int = STEPS) -> dict[str, np.ndarray]:
    """The best point from each start [S, 5] over the ``free`` parameters, with log-likelihood, steps, code and Laplace factor.

    Fits that don't converge go on by EM from where they are, if that converges and ends no lower.
    """
    p = np.clip(start.astype(float), BOX[:, 0], BOX[:, 1])
    s = len(p)
    idx = np.flatnonzero(free)
    ll, g, curve = evaluate(p, d, h, beta0, second=True)
    itr, done, last = np.zeros(s, int), np.zeros(s, bool), np.full(s, np.inf)
    hess = np.tile(-np.eye(5), (s, 1, 1))
    for step in range(1, steps + 1):
        at = np.flatnonzero(~done)
        if not len(at):
            break
        sub = d if len(at) == s else d.take(at)
        hs = curve[at][:, idx[:, None], idx]  # the try that climbed gave it
        hess[np.ix_(at, idx, idx)] = hs
        val, vec = np.linalg.eigh(hs)
        val = -np.maximum(np.abs(val), 1e-3)
        move = -np.einsum("sij,sj->si", vec, np.einsum("sji,sj->si", vec, g[at][:, idx]) / val)
        move = np.clip(move, -3, 3)
        size, left = 1.0, np.arange(len(at))  # those that haven't climbed yet
        for _ in range(30):
            q = p[at[left]].copy()
            q[:, idx] += size * move[left]
            q = np.clip(q, BOX[:, 0], BOX[:, 1])
            nl, ng, nh = evaluate(q, sub if len(left) == len(at) else sub.take(left), h, beta0, second=True)
            good = (nl >= ll[at[left]] - 1e-12) & np.isfinite(nl)
            up = at[left[good]]
            last[up] = np.abs(nl[good] - ll[up])
            p[up], ll[up], g[up], curve[up] = q[good], nl[good], ng[good], nh[good]
            left = left[~good]
            if not len(left):
                break
            size /= 2
        itr[at] = step
        edge = (np.abs(p[at] - BOX[:, 0]) < 1e-9) | (np.abs(p[at] - BOX[:, 1]) < 1e-9)
        flat = (np.abs(g[at]) < GRAD_TOL) | edge | ~free
        stuck = np.isin(np.arange(len(at)), left)
        last[at[stuck]] = 0.0
        done[at] = ((last[at] < TOL) & flat.all(1)) | stuck
    out = ended(p, ll, g, hess, itr, last, free, d, h, beta0)
    left = np.flatnonzero(out["code"] != 0)
    if len(left) and d.model.update and steps == STEPS:
        if isinstance(d, Alike):
            each = [em(p[i : i + 1], free, d.one[i], h, d.beta0[i]) for i in left]
            more = {k: np.concatenate([x[k] for x in each]) for k in out}
        else:
            more = em(p[left], free, d.take(left), h, beta0)
        good = (more["code"] == 0) & (more["ll"] >= out["ll"][left] - 1e-9)
        more["itr"] = more["itr"] + itr[left]
        for k in out:
            out[k][left[good]] = more[k][good]
    return out


def diplotypes(z: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Prior [..., 10] of tested z [..., 2] and feature x [..., 2]."""
    out = np.zeros((*np.broadcast_shapes(z.shape, x.shape)[:-1], 10))
    hap = lambda i, c, f: (z[..., i] if c else 1 - z[..., i]) * (x[..., i] if f else 1 - x[..., i])
    for j in range(10):
        a, b = (C[j][0], X[j][0]), (C[j][1], X[j][1])
        out[..., j] = hap(0, *a) * hap(1, *b) + (0 if a == b else hap(0, *b) * hap(1, *a))
    return out


def own(z: np.ndarray) -> np.ndarray:
    out = np.zeros((*z.shape[:-1], 10))
    out[..., 0], out[..., 9] = (1 - z[..., 0]) * (1 - z[..., 1]), z[..., 0] * z[..., 1]
    out[..., 5] = z[..., 0] * (1 - z[..., 1]) + z[..., 1] * (1 - z[..., 0])
    return out


def genotypes(z: np.ndarray) -> np.ndarray:
    """Prior of 0, 1 and 2 alternative alleles [..., 3] given the haplotypes' probabilities [..., 2]."""
    none, two = (1 - z[..., 0]) * (1 - z[..., 1]), z[..., 0] * z[..., 1]
    return np.stack([none, 1 - none - two, two], -1)


def imprinted(x: np.ndarray) -> np.ndarray:
    """Prior [..., 4] of the states of a heterozygote: the feature variant's alleles are on either haplotype alike."""
    het = x[..., 0] * (1 - x[..., 1]) + x[..., 1] * (1 - x[..., 0])
    return np.stack([(1 - x[..., 0]) * (1 - x[..., 1]), het / 2, het / 2, x[..., 0] * x[..., 1]], -1)


class Feature:
    """One feature's samples and feature variants, from a row of ``blocks``."""

    def __init__(self, row, h: Hyper, model: Model | None = None):
        self.model = model or Model()
        self.y, self.k, self.dk = (np.array(row[c], float) for c in ("y", "k", "dk"))
        n = len(self.y)
        self.w = np.array(row["w"], float) if "w" in row else np.ones(n)
        self.ids = [int(v) for v in row["fsnp"]]
        self.x = np.array(row["x"], float).reshape(len(self.ids), n, 2).transpose(1, 0, 2)
        self.reads = np.array(row["reads"], float).reshape(len(self.ids), n, 2).transpose(1, 0, 2)
        kx = row["kx"] if "kx" in row else []
        self.kx = np.array(kx, float).reshape(len(self.ids), n).T if len(kx) else None
        self.h = h
        v = self.y / self.k
        mu, va = v.mean(), v.var()
        theta = mu * mu / (va - mu) if va != mu else 1000.0
        self.beta0 = math.log(mu)
        self.mode = (h.adelta - 1) / (h.adelta + h.bdelta - 2)
        held = (h.kappa - 1) / h.omega
        self.start = np.array([0.0, logit(self.mode), 0.0, self.beta0, math.log(held if "theta" in self.model.fixed else min(max(34.0 if theta < 0 else theta, 0.001), 1000.0))])
        self.alike = np.ones((1, n, 1))  # one genotype: a heterozygote, or any where all have one effect
        self.entries = None

    def data(self, h0, prior=None, states: tuple[int, ...] = tuple(range(10))) -> Data:
        if prior is None:
            return Data(self.y, self.k, self.dk, self.w, h0, model=self.model)
        d = Data(self.y, self.k, self.dk, self.w, h0, prior, self.reads, self.kx, self.model, states, self.entries)
        self.entries = d.entries  # the same for all models
        return d

    def nulls(self) -> tuple[dict, dict | None]:
        """Without and with allelic counts; the latter from several starts, the best converged one."""
        return null_models([self])[0]

    def alternatives(self, ids: list[int], z: np.ndarray, plain: dict, joint: dict | None, gate: float) -> dict:
        """Population fits of variants z [S, N, 2], then joint ones of those whose ratio passes the gate."""
        h0 = genotypes(z)
        free = self.model.free("pi", "beta", "theta")
        start = np.tile(np.concatenate([[0.0], plain["p"][0, 1:]]), (len(ids), 1))
        one = climb(start, free, self.data(h0), self.h, self.beta0)
        out = {"p": one["p"], "lr": 2 * (one["ll"] - plain["ll"][0]), "log_bf": one["log_bf"] - plain["log_bf"][0], "itr": one["itr"], "code": one["code"], "joint": np.zeros(len(ids), bool)}
        post = evaluate(one["p"], self.data(h0), self.h, self.beta0, True)[2]
        out["r2_fsnp"] = np.full(len(ids), np.nan)
        if self.model.as_only:
            gate = -math.inf  # the counts can't decide
        at = np.flatnonzero(out["lr"] > gate) if joint is not None else np.zeros(0, int)
        if len(at):
            prior = self.diplotypes([ids[a] for a in at], z[at])
            start = np.concatenate([one["p"][at, :1], np.tile(joint["p"][0, 1:], (len(at), 1))], 1)
            d = self.data(h0[at], prior)
            two = climb(start, self.model.free(*NAMES), d, self.h, self.beta0)
            out["p"][at], out["lr"][at], out["log_bf"][at] = two["p"], 2 * (two["ll"] - joint["ll"][0]), two["log_bf"] - joint["log_bf"][0]
            out["itr"][at], out["code"][at], out["joint"][at] = two["itr"], two["code"], True
            _, _, full, states = evaluate(two["p"], d, self.h, self.beta0, True)
            post[at] = full
            xg = np.stack([states[..., X.sum(1) == g].sum(3) for g in range(3)], 3)
            x0 = np.stack([prior[..., X.sum(1) == g].sum(3) for g in range(3)], 3)
            out["r2_fsnp"][at] = r2(x0.reshape(len(at), -1, 3), xg.reshape(len(at), -1, 3))
        out["r2_rsnp"], out["post"] = r2(h0, post), post
        return out

    def diplotypes(self, ids: list[int], z: np.ndarray) -> np.ndarray:
        """Priors [S, N, L, 10] of variants z [S, N, 2] with each feature variant, which may be the same one."""
        prior = diplotypes(z[:, :, None, :], self.x[None])
        for i, v in enumerate(ids):
            if v in self.ids:
                prior[i, :, self.ids.index(v)] = own(z[i])
        return prior

    def imprint(self, joint: dict) -> dict:
        return imprint_models([self], [joint])[0]


def climbed(start: np.ndarray, free: np.ndarray, one: list[Data], f: list[Feature]) -> dict[str, np.ndarray]:
    """``climb`` from one start [M, 5] for each of ``one``, of features ``f``."""
    if one[0].model.update:
        return climb(start, free, Alike(one, np.array([x.beta0 for x in f])), f[0].h, 0.0)
    each = [climb(start[i : i + 1], free, d, x.h, x.beta0) for i, (d, x) in enumerate(zip(one, f, strict=True))]
    return {k: np.concatenate([x[k] for x in each]) for k in each[0]}


def null_models(features: list[Feature]) -> list[tuple[dict, dict | None]]:
    """Of each feature the fits without and, where it has feature variants, with allelic counts; the latter from several
    starts, the best converged one. All features climb together."""
    model, pick = features[0].model, lambda x, i: {k: v[i : i + 1] for k, v in x.items()}
    plain = climbed(np.stack([f.start for f in features]), model.free("beta", "theta"), [f.data(f.alike) for f in features], features)
    plain = [pick(plain, i) for i in range(len(features))]
    joint: list[dict | None] = [None] * len(features)
    at = [i for i, f in enumerate(features) if f.ids]
    if at:
        wide = dict.fromkeys([(None, 0.5)] + [(None if "delta" in model.fixed else dl, 0.5 if "phi" in model.fixed else ph) for dl, ph in RESTARTS])
        mode = features[0].mode
        starts = [np.array([0, logit(mode if dl is None else dl), logit(ph), *plain[i]["p"][0, 3:]]) for i in at for dl, ph in wide]
        m = len(wide)
        # with pi one half the tested variant says nothing: the feature variant's genotype alone is a state
        data = [d for i in at for d in [features[i].data(features[i].alike, genotypes(features[i].x)[None], (3, 4, 6))] * m]
        fit = climbed(np.array(starts), model.free("delta", "phi", "beta", "theta"), data, [features[i] for i in at for _ in range(m)])
        for j, i in enumerate(at):
            mine = {k: v[j * m : j * m + m] for k, v in fit.items()}
            rank = np.where((mine["code"] == 0) | (np.arange(m) == 0), mine["ll"], -np.inf)
            joint[i] = pick(mine, int(np.argmax(rank)))
    return list(zip(plain, joint, strict=True))


def imprint_models(features: list[Feature], joint: list[dict]) -> list[dict]:
    """Of each feature the fit in which every sample expresses one haplotype more, started at its joint null model."""
    start = np.stack([[logit(0.9), *j["p"][0, 1:]] for j in joint])
    fit = climbed(start, features[0].model.free(*NAMES), [f.data(f.alike, imprinted(f.x)[None], (3, 4, 5, 6)) for f in features], features)
    return [{k: v[i : i + 1] for k, v in fit.items()} | {"lr": 2 * (fit["ll"][i : i + 1] - j["ll"])} for i, j in enumerate(joint)]


def r2(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Squared correlation of genotypes under q and p [S, M, 3], with their own second moments."""
    m0, m1 = (2 * q[..., 2] + q[..., 1]).mean(1), (2 * p[..., 2] + p[..., 1]).mean(1)
    v0, v1 = (4 * q[..., 2] + q[..., 1]).mean(1), (4 * p[..., 2] + p[..., 1]).mean(1)
    v = (4 * p[..., 2] * q[..., 2] + 2 * (p[..., 2] * q[..., 1] + p[..., 1] * q[..., 2]) + p[..., 1] * q[..., 1]).mean(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return (v - m0 * m1) ** 2 / (v0 - m0 * m0) / (v1 - m1 * m1)


# --- distributed ------------------------------------------------------------------------------------------------


def shuffled(rows: DataFrame, seed: int) -> DataFrame:
    """Priors, reads and offset of each feature variant dealt anew among its samples, together, each variant on its own."""
    return permute(rows, ["feature_ix", "variant_ix"], "sample_ix", ["z1", "z2", "as_ref", "as_alt", "kx"], seed)


def blocks(normed: DataFrame, fsnps: DataFrame, priors: DataFrame, as_counts: DataFrame, dk: DataFrame | None = None, weights: DataFrame | None = None, permute_seed: int | None = None, own: DataFrame | None = None) -> DataFrame:
    """A row a feature with reads: sample-ordered arrays of y, k, dk, w, and of priors, reads and k of its feature variants.

    Sample order is the order of ``sample_ix``; a missing count is no reads, a missing weight 1. A row holds samples x
    feature variants. ``dk`` and ``weights`` (w): by feature_ix and sample_ix. With a seed the feature variants' part is
    permuted, with the offsets of ``own`` (as ``normed`` was before its own permutation). Features whose counts are all zero have no mean to start from and give no row.
    """
    d = normed.withColumn("dk", F.lit(1.0)) if dk is None else normed.join(dk.select("feature_ix", "sample_ix", "dk"), ["feature_ix", "sample_ix"])
    d = d.withColumn("w", F.lit(1.0)) if weights is None else d.join(weights.select("feature_ix", "sample_ix", "w"), ["feature_ix", "sample_ix"], "left").fillna(1.0, ["w"])
    base = d.groupBy("feature_ix").agg(F.array_sort(F.collect_list(F.struct("sample_ix", F.col("y").cast("double").alias("y"), "k", "dk", "w"))).alias("s"), F.sum("y").alias("_t")).filter("_t > 0")
    base = base.select("feature_ix", *(F.transform("s", (lambda c: lambda r: r[c])(c)).alias(c) for c in ("sample_ix", "y", "k", "dk", "w")))
    x = fsnps.select("feature_ix", "variant_ix").join(priors.select("variant_ix", "sample_ix", "z1", "z2"), "variant_ix").join(as_counts, ["variant_ix", "sample_ix"], "left").na.fill(0)
    x = x.join((normed if own is None else own).select("feature_ix", "sample_ix", F.col("k").alias("kx")), ["feature_ix", "sample_ix"])
    if permute_seed is not None:
        x = shuffled(x, permute_seed)
    x = x.groupBy("feature_ix").agg(F.array_sort(F.collect_list(F.struct("variant_ix", "sample_ix", "z1", "z2", "as_ref", "as_alt", "kx"))).alias("r"))
    none = F.array().cast("array<double>")
    x = x.select(
        "feature_ix", F.array_distinct(F.transform("r", lambda r: r["variant_ix"])).alias("fsnp"),
        F.flatten(F.transform("r", lambda r: F.array(r["z1"], r["z2"]))).alias("x"), F.flatten(F.transform("r", lambda r: F.array(r["as_ref"].cast("double"), r["as_alt"].cast("double")))).alias("reads"),
        F.transform("r", lambda r: r["kx"]).alias("kx"),
    )
    out = base.join(x, "feature_ix", "left")
    return out.select(*base.columns, F.coalesce("fsnp", F.array().cast("array<bigint>")).alias("fsnp"), F.coalesce("x", none).alias("x"), F.coalesce("reads", none).alias("reads"), F.coalesce("kx", none).alias("kx"))


NULL_SCHEMA = "feature_ix long, model string, pi double, delta double, phi double, beta double, theta double, loglik double, log_bf double, itr int, code long"


def _params(p: np.ndarray) -> list[float]:
    return [*map(float, expit(p[:3])), float(p[3]), float(np.exp(p[4]))]


def _back(x) -> dict | None:
    """A null model from its row."""
    if x is None:
        return None
    return {"p": np.array([[logit(x["pi"]), logit(x["delta"]), logit(x["phi"]), x["beta"], math.log(x["theta"])]]), "ll": np.array([x["loglik"]]), "log_bf": np.array([x["log_bf"]]), "itr": x["itr"], "code": x["code"]}


#: Features whose null models climb together.
TOGETHER = 32


def null_fit(block: DataFrame, h: Hyper | None = None, imprint: bool = False, model: Model | None = None) -> DataFrame:
    """Null models of each feature: ``population``, and ``joint`` (and ``imprint``) where it has feature variants."""
    h = h or Hyper()

    def run(batches):
        for df in batches:
            for at in range(0, len(df), TOGETHER):
                some = [r for _, r in df.iloc[at : at + TOGETHER].iterrows()]
                features = [Feature(r, h, model) for r in some]
                found = [[("population", p)] + ([("joint", j)] if j else []) for p, j in null_models(features)]
                mixed = [i for i, x in enumerate(found) if len(x) > 1]
                if imprint and mixed:
                    for i, x in zip(mixed, imprint_models([features[i] for i in mixed], [found[i][1][1] for i in mixed]), strict=True):
                        found[i].append(("imprint", x))
                rows = [(int(r["feature_ix"]), m, *_params(x["p"][0]), float(x["ll"][0]), float(x["log_bf"][0]), int(x["itr"][0]), int(x["code"][0])) for r, fits in zip(some, found, strict=True) for m, x in fits]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in NULL_SCHEMA.split(", ")])

    return spread(block, "feature_ix").mapInPandas(run, NULL_SCHEMA)


def imprint_fit(block: DataFrame, nulls: DataFrame, h: Hyper | None = None, model: Model | None = None) -> DataFrame:
    """The imprinting models of features whose joint null model is in ``nulls`` (rows of ``null_fit``)."""
    h = h or Hyper()
    d = block.join(nulls.filter("model = 'joint'").select("feature_ix", F.struct("pi", "delta", "phi", "beta", "theta", "loglik", "log_bf", "itr", "code").alias("joint")), "feature_ix")

    def run(batches):
        for df in batches:
            for at in range(0, len(df), TOGETHER):
                some = [r for _, r in df.iloc[at : at + TOGETHER].iterrows()]
                fits = imprint_models([Feature(r, h, model) for r in some], [_back(r["joint"]) for r in some])
                rows = [(int(r["feature_ix"]), "imprint", *_params(x["p"][0]), float(x["ll"][0]), float(x["log_bf"][0]), int(x["itr"][0]), int(x["code"][0])) for r, x in zip(some, fits, strict=True)]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in NULL_SCHEMA.split(", ")])

    return spread(d, "feature_ix").mapInPandas(run, NULL_SCHEMA)


def spread(d: DataFrame, *keys: str) -> DataFrame:
    """Deal rows out by ``keys`` to a fixed number of tasks: a fit takes seconds a row, so few bytes are no reason for few tasks."""
    spark = d.sparkSession
    return d.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *keys)


ALT_SCHEMA = "feature_ix long, variant_ix long, lr double, pi double, delta double, phi double, beta double, theta double, log_bf double, itr int, itr_null int, code long, joint boolean, n_feature int, r2_fsnp double, r2_rsnp double, haplotypes array<double>"


def alt_fit(tested: DataFrame, priors: DataFrame, block: DataFrame, nulls: DataFrame, significant: float | None = None, chunk: int = 64, h: Hyper | None = None, every: bool = False, model: Model | None = None, totals: DataFrame | None = None) -> DataFrame:
    """A row a tested pair, fitted in chunks of a feature's variants; a feature's block goes once to each chunk.

    The joint model is for ratios whose tail is below ``significant`` over the feature's tested variants (all positive
    ratios without it), or for ``every`` pair. ``totals`` (feature_ix, _n) counts the tested variants where ``tested``
    has some of them only.
    """
    h = h or Hyper()
    z = priors.groupBy("variant_ix").agg(F.array_sort(F.collect_list(F.struct("sample_ix", "z1", "z2"))).alias("z"))
    z = z.select("variant_ix", F.flatten(F.transform("z", lambda r: F.array(r["z1"], r["z2"]))).alias("z"))
    key = F.pmod(F.xxhash64("variant_ix"), F.greatest(F.lit(1), F.ceil(F.col("_n") / chunk)))
    n = tested.groupBy("feature_ix").agg(F.count("*").alias("_n"))
    t = tested.select("feature_ix", "variant_ix").join(n, "feature_ix").withColumn("chunk", key)
    t = t if totals is None else t.drop("_n").join(totals, "feature_ix")
    t = t.join(z, "variant_ix").select("feature_ix", "chunk", "variant_ix", "z", "_n")
    m = nulls.groupBy("feature_ix").agg(*(F.max(F.when(F.col("model") == k, F.struct("pi", "delta", "phi", "beta", "theta", "loglik", "log_bf", "itr", "code"))).alias(k) for k in ("population", "joint")))
    chunks = t.select(F.col("feature_ix").alias("_f"), F.col("chunk").alias("_c")).distinct()
    b = block.join(m, "feature_ix").join(chunks, F.col("feature_ix") == F.col("_f"))
    names = [c.split()[0] for c in ALT_SCHEMA.split(", ")]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=names)
        r = right.iloc[0]
        f = Feature(r, h, model)
        plain, joint = _back(r["population"]), _back(r["joint"])
        left = left.sort_values("variant_ix")
        ids = [int(v) for v in left["variant_ix"]]
        zs = np.array(left["z"].tolist(), float).reshape(len(ids), len(f.y), 2)
        tail = 1.0 if significant is None else min(1.0, significant / int(left["_n"].iloc[0]))
        o = f.alternatives(ids, zs, plain, joint, -math.inf if every else 0.0 if tail == 1.0 else S.chisq_quantile(tail))
        n0 = (joint or plain)["itr"]
        return pd.DataFrame([(int(r["feature_ix"]), v, float(o["lr"][i]), *_params(o["p"][i]), float(o["log_bf"][i]), int(o["itr"][i]), int(n0), int(o["code"][i]), bool(o["joint"][i]), len(f.ids), float(o["r2_fsnp"][i]), float(o["r2_rsnp"][i]), haplotypes(o["post"][i], zs[i]).ravel().tolist()) for i, v in enumerate(ids)], columns=names)

    return spread(t, "feature_ix", "chunk").groupBy("feature_ix", "chunk").cogroup(spread(b, "_f", "_c").groupBy("_f", "_c")).applyInPandas(run, ALT_SCHEMA)


def haplotypes(post: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Allele probabilities [N, 2] that give the genotype's posterior [N, 3], ordered as the prior's haplotypes."""
    mid = post[:, 2] + post[:, 1] / 2
    wide = np.sqrt(np.maximum(mid * mid - post[:, 2], 0))
    low, high = mid - wide, mid + wide
    first = z[:, 0] >= z[:, 1]
    return np.stack([np.where(first, high, low), np.where(first, low, high)], 1)


#: Start, most steps and tolerance of the phase of feature variants.
PHASE, PHASE_STEPS, PHASE_TOL = 0.51, 100, 1e-8
FEATURE_HAPLOTYPES = "feature_ix long, variant_ix long, feature_variant long, sample_ix long, z1 double, z2 double"


def phased(states: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Allele probabilities [N, L, 2] of feature variants from diplotype posteriors [N, L, 10], in the order of z [N, 2].

    In a heterozygote the first haplotype has the alternative allele with probability c (tested) and x (feature variant).
    Double heterozygotes alone tell of them, and of c * x + (1 - c) * (1 - x) only: of the best pairs EM takes one. It starts both at ``PHASE``, so that where all
    double heterozygotes are in trans it stays at one half, without a phase.
    """
    h = states / states.sum(2, keepdims=True)
    trans, cis = h[..., 4], h[..., 5]
    hets_c, hets_x, both = h[..., 3:7].sum(2), h[..., [1, 4, 5, 8]].sum(2), h[..., [2, 6, 9]].sum(2)
    c, x = np.full_like(trans, PHASE), np.full_like(trans, PHASE)
    last, live = np.full_like(trans, -np.inf), np.ones(trans.shape, bool)
    over = lambda a, b: np.divide(a, b, out=np.zeros_like(a), where=b > 0)
    for _ in range(PHASE_STEPS):
        same = c * x + (1 - c) * (1 - x)
        t, s = over(trans, 1 - same), over(cis, same)
        c1 = np.where(live & (hets_c > 0), c * over(h[..., 3] + h[..., 6] + t * (1 - x) + s * x, hets_c), c)
        x1 = np.where(live & (hets_x > 0), x * over(h[..., 1] + h[..., 8] + t * (1 - c) + s * c, hets_x), x)
        c, x = c1, x1
        same = c * x + (1 - c) * (1 - x)
        ll = trans * np.log(np.where(same < 1, 1 - same, 1)) + cis * np.log(np.where(same > 0, same, 1))
        live &= ~(np.abs(ll - last) < PHASE_TOL)
        last = ll
        if not live.any():
            break
    first, second = both + hets_x * x, both + hets_x * (1 - x)
    side = (z[:, 0] - z[:, 1])[:, None]
    turn = (hets_c > 0) & ((c - 0.5) * side < 0)
    return np.stack([np.where(turn, second, first), np.where(turn, first, second)], 2)


def feature_haplotypes(fits: DataFrame, priors: DataFrame, block: DataFrame, h: Hyper | None = None, model: Model | None = None) -> DataFrame:
    """Posterior haplotypes of the feature variants at each joint fit of ``fits`` (rows of ``alt_fit``).

    Rows of ``fits`` without a joint model and features without feature variants give none. A row of the work holds one
    fit and its feature's block.
    """
    h = h or Hyper()
    z = priors.groupBy("variant_ix").agg(F.array_sort(F.collect_list(F.struct("sample_ix", "z1", "z2"))).alias("z"))
    z = z.select("variant_ix", F.flatten(F.transform("z", lambda r: F.array(r["z1"], r["z2"]))).alias("z"))
    d = fits.filter("joint").select("feature_ix", "variant_ix", "pi", "delta", "phi", "beta", "theta", "haplotypes")
    d = d.join(z, "variant_ix").join(block, "feature_ix")

    def run(batches):
        for df in batches:
            for _, r in df.iterrows():
                f = Feature(r, h, model)
                v, own_z = int(r["variant_ix"]), np.array(r["z"], float).reshape(1, -1, 2)
                p = np.array([[logit(r["pi"]), logit(r["delta"]), logit(r["phi"]), r["beta"], math.log(r["theta"])]])
                states = evaluate(p, f.data(genotypes(own_z), f.diplotypes([v], own_z)), h, f.beta0, True)[3][0]
                out = phased(states, np.array(r["haplotypes"], float).reshape(-1, 2))
                n, l = out.shape[:2]
                yield pd.DataFrame({"feature_ix": int(r["feature_ix"]), "variant_ix": v, "feature_variant": np.tile(f.ids, n).astype("int64"), "sample_ix": np.repeat(np.array(r["sample_ix"], "int64"), l), "z1": out[..., 0].ravel(), "z2": out[..., 1].ravel()})

    return spread(d, "feature_ix").mapInPandas(run, FEATURE_HAPLOTYPES)


GLM_SCHEMA = "feature_ix long, coef array<double>, theta double, loglik double, itr int, samples array<long>, dk array<double>"


def glm(y: np.ndarray, k: np.ndarray, x: np.ndarray, w: np.ndarray | None = None) -> tuple[np.ndarray, float, float, int]:
    """Negative binomial regression of y with offset k on columns x (the first an intercept): Newton over all at once.

    A weak normal prior holds the coefficients, a gamma prior the dispersion, as in the mixture model.
    """
    w = np.ones(len(y)) if w is None else w
    b = np.linalg.lstsq(x, np.log((y + 1) / k), rcond=None)[0]
    p = np.append(b, math.log(5.0))
    always = lgamma(y + 1)

    def all_of(p):
        theta, mean = math.exp(p[-1]), k * np.exp(np.clip(x @ p[:-1], -50, 50))
        more, less, sum_ = gammas(theta + y), gammas(np.array(theta)), mean + theta
        ll = more[0] - always - less[0] + y * np.log(mean) + theta * math.log(theta) - (y + theta) * np.log(sum_)
        g_mean = y - mean * (y + theta) / sum_
        g_theta = theta * (more[1] - less[1] + math.log(theta) + 1 - np.log(sum_) - (y + theta) / sum_)
        value = (w * ll).sum() - (p[1:-1] ** 2).sum() / 2e4 + 0.01 * p[-1] - 0.1 * theta
        grad = np.append(x.T @ (w * g_mean), (w * g_theta).sum() + 0.01 - 0.1 * theta)
        grad[1:-1] -= p[1:-1] / 1e4
        away = theta * (mean - y) / (sum_ * sum_)
        hess = np.empty((len(p), len(p)))
        hess[:-1, :-1] = -x.T @ ((w * mean * theta * (y + theta) / (sum_ * sum_))[:, None] * x)
        hess[-1, :-1] = hess[:-1, -1] = -x.T @ (w * mean * away)
        hess[-1, -1] = (w * (g_theta + theta * (theta * (more[2] - less[2]) + 1 - theta / sum_ - away))).sum() - 0.1 * theta
        hess[np.arange(1, len(p) - 1), np.arange(1, len(p) - 1)] -= 1e-4
        return value, grad, hess

    value, grad, hess = all_of(p)
    for itr in range(1, 200):
        val, vec = np.linalg.eigh(hess)
        move = np.clip(-vec @ ((vec.T @ grad) / -np.maximum(np.abs(val), 1e-6)), -3, 3)
        size = 1.0
        for _ in range(40):
            new, g, second = all_of(p + size * move)
            if new >= value - 1e-12:
                break
            size /= 2
        else:
            break
        change, p, value, grad, hess = new - value, p + size * move, new, g, second
        if abs(change) < 1e-9 and np.abs(grad).max() < 1e-5:
            break
    return p[:-1], math.exp(p[-1]), float(value), itr


def own_covariate(values: DataFrame) -> DataFrame:
    """``feature_ix sample_ix x``: log(value + 0.01), centred within the feature, of a value by feature and sample."""
    d = values.select("feature_ix", "sample_ix", F.ln(F.col("value") + 0.01).alias("x"))
    mean = d.groupBy("feature_ix").agg(F.avg("x").alias("_m"))
    return d.join(mean, "feature_ix").select("feature_ix", "sample_ix", (F.col("x") - F.col("_m")).alias("x"))


def glm_fit(normed: DataFrame, covariates: DataFrame, columns: list[str], own: DataFrame | None = None) -> DataFrame:
    """A row a feature: coefficients, dispersion, and the covariates' factor of each sample with mean one.

    ``own`` (feature_ix, sample_ix, x) adds a last column that differs by feature; where it has no row it is 0.
    """
    normed = normed.join(F.broadcast(covariates), "sample_ix")  # a row a sample
    if own is not None:
        normed = normed.join(own.select("feature_ix", "sample_ix", F.col("x").alias("_own")), ["feature_ix", "sample_ix"], "left").fillna(0.0, ["_own"])
        columns = [*columns, "_own"]
    d = normed.groupBy("feature_ix").agg(F.array_sort(F.collect_list(F.struct("sample_ix", F.col("y").cast("double").alias("y"), "k", F.array(*columns).alias("x")))).alias("s"))
    names = [c.split()[0] for c in GLM_SCHEMA.split(", ")]

    def run(batches):
        for df in batches:
            rows = []
            for i, s in zip(df["feature_ix"], df["s"], strict=True):
                y, k = np.array([r["y"] for r in s]), np.array([r["k"] for r in s])
                x = np.array([list(r["x"]) for r in s], float)
                x = x - x.mean(0)
                scale = np.where(x.std(0) > 0, x.std(0), 1)
                coef, theta, ll, itr = glm(y, k, np.column_stack([np.ones(len(y)), x / scale]))
                dk = np.exp((x / scale) @ coef[1:])
                rows.append((int(i), [float(coef[0]), *map(float, coef[1:] / scale)], theta, ll, itr, [int(r["sample_ix"]) for r in s], (dk / dk.mean()).tolist()))
            yield pd.DataFrame(rows, columns=names)

    return spread(d, "feature_ix").mapInPandas(run, GLM_SCHEMA)


def factor(glm_rows: DataFrame) -> DataFrame:
    """``feature_ix sample_ix dk``: the covariates' factor of ``glm_fit`` as rows, as ``blocks`` takes it."""
    return glm_rows.select("feature_ix", F.explode(F.arrays_zip("samples", "dk")).alias("x")).select("feature_ix", F.col("x.samples").alias("sample_ix"), "x.dk")
