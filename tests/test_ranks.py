"""Ranks over whole tables: the same as in one sorted list, without a window over one partition."""

import random

from traitloom.operators import offsets as O
from traitloom.operators.ranks import ranked


def test_ranks_are_places_in_the_sorted_table(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice([0.5, 0.25, rnd.random()]), i) for i in range(3000)]  # a third of the rows share each of two values
    d, n = ranked(spark.createDataFrame(rows, "x double, ix long").repartition(7), ["x", "ix"])
    assert n == 3000 and [(r["x"], r["ix"]) for r in sorted(d.collect(), key=lambda r: r["rank"])] == sorted(rows)
    assert "SinglePartition" not in d._jdf.queryExecution().executedPlan().toString()
    none, n = ranked(spark.createDataFrame([], "x double"), ["x"])
    assert n == 0 and none.collect() == []


def plain_spread(xs):
    s = sorted(xs)
    out = {}
    values = sorted({x for x, _ in s})
    for k, v in enumerate(values):
        tied = [i for x, i in s if x == v]
        a, b = (values[k - 1] + v) / 2 if k else v, (values[k + 1] + v) / 2 if k + 1 < len(values) else v
        for j, i in enumerate(tied):
            out[i] = a + (b - a) / (len(tied) + 1) * (j + 1) if len(tied) > 1 else v
    return out


def test_ties_are_spread_as_in_a_sorted_list(spark):
    rnd = random.Random(2)
    xs = [(rnd.choice([0.1, 0.2, 0.2, 0.9, round(rnd.random(), 2)]), i) for i in range(800)]
    d = O.spread_ties(spark.createDataFrame(xs, "x double, ix long").repartition(5))
    want = plain_spread(xs)
    got = {r["ix"]: r["spread"] for r in d.collect()}
    assert len(got) == 800 and max(abs(got[i] - want[i]) for i in want) < 1e-12
    assert "SinglePartition" not in d._jdf.queryExecution().executedPlan().toString()
    assert O.spread_ties(spark.createDataFrame([], "x double, ix long")).collect() == []
    assert [r["spread"] for r in O.spread_ties(spark.createDataFrame([(0.5, 1)], "x double, ix long")).collect()] == [0.5]
