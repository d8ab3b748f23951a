"""Scalars, scaling and small readers against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from traitloom.functions import scalars as S
from traitloom.operators import offsets as O
from traitloom.sources import matrices


def values(spark, xs, *cols):
    return [tuple(r) for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i long, x double").orderBy("i").select(*cols).collect()]


def test_clamp_sign_and_smaller(spark):
    xs = [-2.0, -0.0, 0.0, 1e-9, 0.5, 7.0]
    got = values(spark, xs, S.clamp(F.col("x"), 1e-5, 1.0), S.sign1(F.col("x")))
    assert got == [(min(max(x, 1e-5), 1.0), 1.0 if x >= 0 else -1.0) for x in xs]


def test_logit_and_expit_saturate(spark):
    xs = [0.0, 1e-300, 1e-14, 0.2, 0.5, 1 - 1e-14, 1.0]
    got = [r[0] for r in values(spark, xs, S.logit(F.col("x")))]
    assert got == pytest.approx([-30, -30, -30, math.log(0.25), 0, 30, 30])
    ys = [-800.0, -31.0, -1.0, 0.0, 31.0, 800.0]
    assert [r[0] for r in values(spark, ys, S.expit(F.col("x")))] == pytest.approx([0, 0, 1 / (1 + math.e), 0.5, 1, 1])


def test_to_one_and_log_sum(spark):
    a = F.array(F.col("x"), F.lit(1.0), F.lit(2.0))
    got = values(spark, [1.0, 5.0], S.to_one(a), S.log_sum_exp([F.col("x"), F.lit(-2000.0), F.lit(0.0)]))
    for x, (one, lse) in zip([1.0, 5.0], got, strict=True):
        assert one == pytest.approx([v / (x + 3) for v in (x, 1, 2)]) and lse == pytest.approx(math.log(math.exp(x) + 1))


def test_chi_square_tail_and_quantile_are_inverse(spark):
    for p in (0.5, 0.01, 1e-8):
        x = S.chisq_quantile(p)
        assert values(spark, [x], S.log10_chisq_tail(F.col("x")))[0][0] == pytest.approx(math.log10(p), abs=1e-6)


def test_weighted_scale(spark):
    rnd = random.Random(6)
    rows = [(g, rnd.choice([None, math.nan, rnd.gauss(5, 2), rnd.gauss(5, 2)]), rnd.choice([0.0, 1.0, 2.5])) for g in range(6) for _ in range(30)]
    rows += [(100, 3.3, 1.0)] * 3 + [(101, 4.0, 0.0), (101, 5.0, None), (102, None, 1.0), (None, 1.0, 1.0), (None, 3.0, 3.0)]

    def scaled(g):
        some = [(x, w or 0.0) for h, x, w in rows if h == g and x is not None and not math.isnan(x)]
        n = sum(w for _, w in some)
        if not n:
            return lambda x: 0.0
        m = sum(w * x for x, w in some) / n
        s = math.sqrt(sum(w * (x - m) ** 2 for x, w in some) / n)
        return lambda x: 0.0 if x is None or math.isnan(x) or s < 1e-9 else (x - m) / s

    df = spark.createDataFrame([(i, *r, "other") for i, r in enumerate(rows)], "i long, g long, x double, w double, _x string")
    got = {r["i"]: r["z"] for r in O.weighted_scale(df, "g", "x", "w").filter("_x = 'other'").collect()}
    assert [got[i] for i in range(len(rows))] == pytest.approx([scaled(g)(x) for g, x, _ in rows])
    assert O.weighted_scale(df.limit(0), "g", "x", "w").count() == 0


def test_covariates_keep_the_order_of_lines_and_files(spark, tmp_path):
    folder = tmp_path / "c"
    folder.mkdir()
    (folder / "a.txt").write_text("1\t2\n3\t4\n")
    (folder / "b.txt").write_text("".join(f"{i}\t0.5\n" for i in range(5, 900)))
    got = matrices.read_covariates(spark, str(folder)).orderBy("sample_ix").collect()
    assert [r["sample_ix"] for r in got] == list(range(897))
    assert [r["x"] for r in got] == [[1.0, 2.0], [3.0, 4.0], *([float(i), 0.5] for i in range(5, 900))]


def test_tables_are_read_as_written(spark, tmp_path):
    d = spark.createDataFrame([("g1", 1.5, 2.0), ("g2", 0.0, -3.25)], "feature_id string, a double, b double")
    matrices.write_table(d, str(tmp_path / "t"))
    got = matrices.read_table(spark, str(tmp_path / "t"), "k").orderBy("feature_id", "sample_ix").collect()
    assert [tuple(r) for r in got] == [("g1", 0, 1.5), ("g1", 1, 2.0), ("g2", 0, 0.0), ("g2", 1, -3.25)]
