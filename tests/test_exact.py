"""Sums that are the same to the last bit for every partitioning, and histograms with round breaks."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lakesurvey import functions as L
from lakesurvey.operators.aggregates import mean_of, round_histogram, sum_zero_empty


@pytest.fixture(scope="module")
def numbers():
    rnd = random.Random(1)
    out = [(g, rnd.choice([1, -1]) * rnd.random() * 2.0 ** rnd.choice([0, 3, 20, -20, 60, -50])) for g in range(150) for _ in range(rnd.randint(0, 60))]
    out += [(900, 1e16), (900, 1.0), (900, -1e16), (901, 0.1), (901, None), (902, None), (903, -0.1), (903, 0.1), (904, 5e-324), (905, -(2.0**53)), (905, -1.0), (905, -(2.0**-60))]
    # Halves between two doubles, decided by what lies far below.
    out += [(906, 2.0**53), (906, 1.0), (907, 2.0**53), (907, 1.0), (907, 2.0**-100), (908, 2.0**53 + 2), (908, 1.0)]
    return out


@pytest.mark.parametrize("parts", [1, 7, 200])
def test_exact_sums_are_the_nearest_doubles(spark, numbers, parts):
    df = spark.createDataFrame(numbers, "g int, x double").orderBy(F.rand(parts)).repartition(parts)
    got = {r.g: (r.s, r.m) for r in df.groupBy("g").agg(L.exact_sum0("x").alias("s"), L.exact_mean("x").alias("m")).collect()}
    groups = {}
    for g, x in numbers:
        groups.setdefault(g, []).extend([] if x is None else [x])
    groups[904] = []  # below the lowest bit that counts
    assert {g: s for g, (s, _) in got.items()} == {g: math.fsum(x) for g, x in groups.items()}
    assert all(got[g][1] == math.fsum(x) / len(x) for g, x in groups.items() if x) and got[902][1] is None


def test_odd_values_and_strict_means(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([("a", inf), ("a", 1.0), ("b", inf), ("b", -inf), ("c", nan), ("d", 1e30), ("d", 2.0), ("e", 1.0), ("e", None), ("f", 3.0)], "k string, x double")
    got = {r.k: (r.s, r.m) for r in df.groupBy("k").agg(L.exact_sum0("x").alias("s"), L.exact_mean_strict("x").alias("m")).collect()}
    assert got["a"][0] == inf and math.isnan(got["b"][0]) and math.isnan(got["c"][0]) and got["d"][0] == 1e30
    assert got["e"] == (1.0, None) and got["f"] == (3.0, 3.0)


def test_a_hot_group_combines_before_the_shuffle(spark):
    df = spark.range(0, 300_000, 1, 8).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 97).alias("k"), (F.col("id") / 7).alias("x"))
    out = sum_zero_empty(df, ["k"], ["x"], exact=True)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_sum" in plan
    assert {r.k: r.x for r in out.collect()}[0] == math.fsum(i / 7 for i in range(300_000) if i % 3 == 0 or i % 97 == 0)
    assert mean_of(df.limit(0), ["k"], ["x"], strict=True, exact=True).count() == 0


def histogram(spark, values, bins=None):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    return [(r.low, r.high, r.n) for r in round_histogram(df, "x", bins).orderBy("bin").collect()]


def test_round_breaks(spark):
    assert histogram(spark, [float(v) for v in range(11)], 5) == [(0.0, 2.0, 3), (2.0, 4.0, 2), (4.0, 6.0, 2), (6.0, 8.0, 2), (8.0, 10.0, 2)]
    # Ties on breaks that binary numbers miss, an empty bin, and values that are left out.
    assert histogram(spark, [0.1, 0.2, 0.30000000000000004, 0.3, 0.6, None, float("nan"), float("inf")], 5) == [
        (0.1, 0.2, 2), (0.2, 0.3, 2), (0.3, 0.4, 0), (0.4, 0.5, 0), (0.5, 0.6, 1)]
    assert histogram(spark, [-3.0, -1.0, 4.0], 3) == [(-4.0, -2.0, 1), (-2.0, 0.0, 1), (0.0, 2.0, 0), (2.0, 4.0, 1)]
    assert histogram(spark, [0.0, 1e9, 2.5e9], 3) == [(0.0, 1e9, 2), (1e9, 2e9, 0), (2e9, 3e9, 1)]


def test_round_breaks_of_one_value_and_of_none(spark):
    assert histogram(spark, [5.0, 5.0]) == [(0.0, 5.0, 2)]
    assert histogram(spark, [0.0]) == [(-1.0, 0.0, 1)]
    assert histogram(spark, [None]) == []


def test_steps_are_one_two_five_or_ten(spark):
    rnd = random.Random(4)
    for _ in range(8):
        values = [rnd.gauss(0, 10.0 ** rnd.randint(-3, 5)) for _ in range(200)]
        got = histogram(spark, values)
        assert sum(n for *_, n in got) == 200 and got[0][0] <= min(values) and got[-1][1] >= max(values)
        step = got[0][1] - got[0][0]
        digit = round(step / 10 ** math.floor(math.log10(step) + 1e-9), 6)
        assert digit in (1, 2, 5) and all(abs(a[1] - b[0]) < step * 1e-9 for a, b in zip(got, got[1:]))
