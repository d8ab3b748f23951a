"""Permutations, hidden covariates and the GC correction."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import store
from . import offsets as O


def permute(df: DataFrame, group: list[str], item: str, values: list[str], seed: int) -> DataFrame:
    """``values`` dealt anew among the rows of a ``group``, by the MD5 of seed, group and ``item``; the same on every run."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in [*group, item])))
    w = Window.partitionBy(*group) if group else Window.partitionBy()
    d = df.withColumn("_from", F.row_number().over(w.orderBy(key, item))).withColumn("_to", F.row_number().over(w.orderBy(item)))
    src = d.select(*group, F.col("_from").alias("_to"), *(F.col(v).alias(f"_v_{v}") for v in values))
    return d.drop(*values, "_from").join(src, [*group, "_to"]).select(*(c for c in df.columns if c not in values), *(F.col(f"_v_{v}").alias(v) for v in values))


def eigen(gram: DataFrame) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Samples, singular values (largest first) and right vectors from a samples x samples matrix."""
    rows = gram.collect()  # samples squared
    ids = sorted({r["i"] for r in rows})
    at = {s: n for n, s in enumerate(ids)}
    m = np.zeros((len(ids), len(ids)))
    for r in rows:
        m[at[r["i"]], at[r["j"]]] = r["g"]
    val, vec = np.linalg.eigh(m)
    vec = vec[:, ::-1]
    sign = np.sign(vec[np.abs(vec).argmax(0), range(len(ids))])
    return ids, np.sqrt(np.maximum(val[::-1], 0)), vec * sign


#: Singular values below this share of the largest one are rounding: with fewer features than samples some are zero.
ROUNDING = 1e-6


def covariates(counts: DataFrame, seed: int = 1) -> DataFrame:
    """``sample_ix x``: components whose singular values exceed those of permuted rows, after the log size factor where
    the first component doesn't show it already."""
    counts = store.written(counts, "counts")  # read three times below, and dear where lines are joined for them
    z = store.written(O.zscores(O.per_million(counts)).filter("z is not null"), "zscores")
    ids, d, v = eigen(O.gram(z))
    _, null, _ = eigen(O.gram(permute(z, ["feature_ix"], "sample_ix", ["z"], seed)))
    keep = int(((d[:-1] > null[:-1]) & (d[:-1] > ROUNDING * d[0])).sum())
    total = {r["sample_ix"]: float(np.log(r["t"])) for r in counts.groupBy("sample_ix").agg(F.sum("y").alias("t")).collect()}
    sf = np.array([total[s] for s in ids])
    x = v[:, :keep]
    if not keep or np.corrcoef(sf, x[:, 0])[0, 1] ** 2 < 0.9:
        x = np.column_stack([sf, x])
    return counts.sparkSession.createDataFrame([(int(s), x[i].tolist()) for i, s in enumerate(ids)], "sample_ix long, x array<double>")


def smooth(x: np.ndarray, y: np.ndarray, spar: float = 1.0) -> np.ndarray:
    """A cubic smoothing spline at its knots, the penalty scaled by the ratio of the traces, x on [0, 1]."""
    n = len(x)
    if n < 4:
        return np.full(n, y.mean())
    t = (x - x[0]) / (x[-1] - x[0])
    h = np.diff(t)
    q, r = np.zeros((n, n - 2)), np.zeros((n - 2, n - 2))
    for j in range(n - 2):
        q[j, j], q[j + 1, j], q[j + 2, j] = 1 / h[j], -1 / h[j] - 1 / h[j + 1], 1 / h[j + 1]
        r[j, j] = (h[j] + h[j + 1]) / 3
        if j:
            r[j, j - 1] = r[j - 1, j] = h[j] / 6
    k = q @ np.linalg.solve(r, q.T)
    lam = n / np.trace(k) * 256 ** (3 * spar - 1)
    return np.linalg.solve(np.eye(n) + lam * k, y)


def gc_factor(counts: DataFrame, gc: DataFrame, n_bins: int = 200) -> DataFrame:
    """``feature_ix sample_ix factor``: the exponential of a sample's smoothed log rate in the feature's GC bin.

    Bins are few, so a sample's curve is fitted as a group of at most ``n_bins`` rows.
    """
    binned = O.gc_bins(gc, n_bins)
    mid = O.spread_ties(binned.groupBy("bin").agg(F.avg("gc").alias("x")), "x", "bin")
    rates = O.bin_rates(counts, binned).join(mid.select("bin", "spread"), "bin")

    def fit(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("bin")
        y = df["rate"].to_numpy()
        ok = np.isfinite(y)
        out = np.ones(len(df))
        out[ok] = np.exp(smooth(df["spread"].to_numpy()[ok], y[ok]))
        return pd.DataFrame({"sample_ix": df["sample_ix"], "bin": df["bin"], "factor": out})

    curve = rates.groupBy("sample_ix").applyInPandas(fit, "sample_ix long, bin long, factor double")
    return binned.join(curve, "bin").select("feature_ix", "sample_ix", "factor")
