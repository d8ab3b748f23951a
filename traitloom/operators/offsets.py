"""Counts, offsets and covariates: normalisation, moments, and matrices by aggregation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from .ranks import ranked


def by_feature() -> WindowSpec:
    return Window.partitionBy("feature_ix")


def normalise(offsets: DataFrame) -> DataFrame:
    """``k`` over its mean in the feature."""
    return offsets.withColumn("k", F.col("k") / F.avg("k").over(by_feature()))


def center(df: DataFrame, *cols: str) -> DataFrame:
    """Columns less their means; a row a sample, so one task holds them all."""
    return df.select(*(c for c in df.columns if c not in cols), *((F.col(c) - F.avg(c).over(Window.partitionBy())).alias(c) for c in cols))


def totals(normed: DataFrame) -> DataFrame:
    return normed.groupBy("feature_ix").agg(F.sum(F.col("y") / F.col("k")).alias("tot"))


def offset_stats(normed: DataFrame) -> DataFrame:
    """Plain, log and weighted means and deviations (of the population) of offsets."""
    k, y = F.col("k"), F.col("y").cast("double")
    g = normed.filter(~F.isnan("k")).groupBy("feature_ix").agg(F.avg("k").alias("mean"), F.stddev_pop("k").alias("sd"), F.avg(F.ln(k)).alias("lmean"), F.stddev_pop(F.ln(k)).alias("lsd"), F.sum(y * k).alias("yk"), F.sum(y * k * k).alias("ykk"), F.sum(y).alias("sy"))
    wmean = F.col("yk") / F.nullif(F.col("sy"), F.lit(0.0))
    return g.select("feature_ix", "mean", "sd", "lmean", "lsd", wmean.alias("wmean"), (F.col("ykk") / F.nullif(F.col("sy"), F.lit(0.0)) - wmean * wmean).alias("wvar"))


def moment_init(normed: DataFrame) -> DataFrame:
    """Starting values of the negative binomial: log mean and dispersion from the first two moments of y / k."""
    v = F.col("y") / F.col("k")
    g = normed.groupBy("feature_ix").agg(F.avg(v).alias("mu"), F.var_pop(v).alias("va"))
    theta = F.col("mu") * F.col("mu") / F.nullif(F.col("va") - F.col("mu"), F.lit(0.0))
    return g.select("feature_ix", F.ln("mu").alias("beta"), F.least(F.greatest(F.when(theta < 0, 34.0).otherwise(theta), F.lit(0.001)), F.lit(1000.0)).alias("theta"))


def log_linear(normed: DataFrame, covariates: DataFrame, x: str = "x1") -> DataFrame:
    """Least squares of log((y + 1) / k) on a covariate."""
    d = normed.join(covariates, "sample_ix").select("feature_ix", F.ln((F.col("y") + 1) / F.col("k")).alias("z"), x)
    return d.groupBy("feature_ix").agg(F.regr_slope("z", x).alias("slope"), F.regr_intercept("z", x).alias("intercept"))


def per_million(offsets: DataFrame) -> DataFrame:
    """(y / k + 1) over the sample's sum of y / k, in millions."""
    w = Window.partitionBy("sample_ix")
    return offsets.select("feature_ix", "sample_ix", ((F.col("y") / F.col("k") + 1) / F.sum(F.col("y") / F.col("k")).over(w) * 1e6).alias("fpm"))


def zscores(fpm: DataFrame) -> DataFrame:
    """Log values by feature, centred and scaled by the sample deviation."""
    v = F.ln("fpm")
    return fpm.select("feature_ix", "sample_ix", ((v - F.avg(v).over(by_feature())) / F.nullif(F.stddev_samp(v).over(by_feature()), F.lit(0.0))).alias("z"))


def weighted_scale(rows: DataFrame, group: str, x: str, w: str, out: str = "z") -> DataFrame:
    """Add ``out``: ``x`` by ``group``, less its weighted mean, over its weighted spread (divisor: the sum of weights).

    Null and NaN are no values: they take no part and become 0, as does all of a group that has no spread (below 1e-9
    of the mean's size) or no weight. A null weight is 0.
    """
    whole = Window.partitionBy("_g")
    v = F.nanvl(F.col(x).cast("double"), F.lit(None).cast("double"))
    d = rows.select(F.struct(*rows.columns).alias("_row"), F.col(group).alias("_g"), v.alias("_x"), F.when(v.isNotNull(), F.coalesce(F.col(w).cast("double"), F.lit(0.0))).alias("_w"))
    n = F.nullif(F.sum("_w").over(whole), F.lit(0.0))
    d = d.withColumn("_d", F.col("_x") - F.sum(F.col("_w") * F.col("_x")).over(whole) / n)
    d = d.withColumn("_s", F.sqrt(F.sum(F.col("_w") * F.col("_d") * F.col("_d")).over(whole) / n))
    some = F.col("_d").isNotNull() & (F.col("_s") > 1e-9 * F.greatest(F.lit(1.0), F.abs(F.col("_x") - F.col("_d"))))
    return d.select("_row.*", F.when(some, F.col("_d") / F.col("_s")).otherwise(0.0).alias(out))


def gram(z: DataFrame) -> DataFrame:
    """Sample by sample sums of products over features: each task adds up its features' part, then one sum of parts."""
    rows = z.filter("z is not null").groupBy("feature_ix").agg(F.collect_list("sample_ix").alias("s"), F.collect_list("z").alias("z"))

    def run(batches):
        at: dict[int, int] = {}
        total = np.zeros((0, 0))
        both = np.zeros((0, 0))  # features that have both samples: a pair that never meets has no row
        for df in batches:
            for s in df["s"]:
                for i in s:
                    at.setdefault(int(i), len(at))
            m = np.zeros((len(df), len(at)))
            there = np.zeros((len(df), len(at)))
            for n, (s, v) in enumerate(zip(df["s"], df["z"], strict=True)):
                cols = [at[int(i)] for i in s]
                m[n, cols], there[n, cols] = v, 1
            grown = len(at) - len(total)
            total, both = (np.pad(x, (0, grown)) for x in (total, both))
            total, both = total + m.T @ m, both + there.T @ there
        i, j = np.nonzero(both)
        ids = np.array(list(at), np.int64)
        yield pd.DataFrame({"i": ids[i] if len(ids) else i, "j": ids[j] if len(ids) else j, "g": total[i, j]})

    return rows.select("s", "z").mapInPandas(run, "i long, j long, g double").groupBy("i", "j").agg(F.sum("g").alias("g"))


def gc_bins(gc: DataFrame, n_bins: int = 200) -> DataFrame:
    """Bin of a feature by the quantiles (type 7) of its rank in GC, ties by feature."""
    rows, n = ranked(gc.select("feature_ix", "gc"), ["gc", "feature_ix"])
    # rank <= 1 + (n - 1) i / bins  for the largest number of i
    first = F.ceil((F.col("rank") - 1) * n_bins / F.lit(max(n - 1, 1)))
    return rows.select("feature_ix", "gc", (F.greatest(first, F.lit(1)).cast("bigint") - 1).alias("bin"))


def bin_rates(counts: DataFrame, binned: DataFrame) -> DataFrame:
    """Log of a bin's share of a sample's reads over its share of all reads."""
    s = counts.join(binned, "feature_ix").groupBy("bin", "sample_ix").agg(F.sum("y").alias("s"))
    col, row, all_ = (F.sum("s").over(Window.partitionBy(*p)) for p in (["sample_ix"], ["bin"], []))
    return s.select("bin", "sample_ix", F.ln(F.col("s") / col / row * all_).alias("rate"))


def spread_ties(xs: DataFrame, x: str = "x", order: str = "ix") -> DataFrame:
    """Sorted values with runs of equal ones spread evenly between the midpoints to their neighbours.

    The neighbours of a run are the values at the ranks before and after it.
    """
    rows, _ = ranked(xs.select(order, x), [x, order], "_rank")
    runs = rows.groupBy(x).agg(F.min("_rank").alias("_first"), F.count("*").alias("_m"))
    at = lambda name: rows.select(F.col("_rank").alias("_at"), F.col(x).alias(name))
    runs = runs.join(at("_low"), F.col("_first") - 1 == F.col("_at"), "left").drop("_at").join(at("_high"), F.col("_first") + F.col("_m") == F.col("_at"), "left").drop("_at")
    runs = runs.select(F.col(x).alias("_x"), "_first", "_m", F.coalesce((F.col("_low") + F.col(x)) / 2, F.col(x)).alias("_a"), F.coalesce((F.col("_high") + F.col(x)) / 2, F.col(x)).alias("_b"))
    spread = F.when(F.col("_m") > 1, F.col("_a") + (F.col("_b") - F.col("_a")) / (F.col("_m") + 1) * (F.col("_rank") - F.col("_first") + 1)).otherwise(F.col(x))
    return rows.join(runs, F.col(x).eqNullSafe(F.col("_x"))).select(order, x, spread.alias("spread"))


def size_factor(counts: DataFrame) -> DataFrame:
    t = counts.groupBy("sample_ix").agg(F.sum("y").alias("total"))
    return t.select("sample_ix", (F.col("total") / F.avg("total").over(Window.partitionBy())).alias("sf"))


def make_offset(counts: DataFrame, factor: Column | None = None) -> DataFrame:
    """The size factor for each feature and sample, times ``factor`` if there is one."""
    k = F.col("sf") if factor is None else F.col("sf") * factor
    return counts.join(size_factor(counts), "sample_ix").select("feature_ix", "sample_ix", k.alias("k"))
