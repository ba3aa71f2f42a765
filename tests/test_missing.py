"""Missing-value and rounding rules, each with rows where the default would differ."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lakesurvey import functions as L


def one(spark, schema, data, expr):
    return [r[0] for r in spark.createDataFrame(data, schema).select(expr.alias("x")).collect()]


def test_unknown_condition_gives_null(spark):
    got = one(spark, "o string, s string", [("Cala", "Y"), (None, "Y"), (None, "O"), ("Cala", "O")],
              L.if_else((F.col("o") == "Cala") & (F.col("s") == "Y"), "pooled", "own"))
    assert got == ["pooled", None, "own", "own"]


def test_membership_and_patterns_keep_null_rows_when_negated(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    assert [r.x for r in df.filter(~L.is_member("x", ["a"])).collect()] == ["b", None]
    assert [r.x for r in df.filter(~L.matches("x", "^a", "zz")).collect()] == ["b", None]


def test_sum_of_nothing_is_zero_and_means(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", None), ("c", 2.0), ("c", 4.0), (None, 5.0)], "k string, v double")
    got = {r.k: (r.s, r.m, r.t) for r in df.groupBy("k").agg(
        L.sum0("v").alias("s"), L.mean_skip("v").alias("m"), L.mean_strict("v").alias("t")).collect()}
    assert got == {"a": (1.0, 1.0, None), "b": (0.0, None, None), "c": (6.0, 3.0, 3.0), None: (5.0, 5.0, 5.0)}


@pytest.mark.parametrize("x,want", [(0.5, 0.0), (1.5, 2.0), (2.5, 2.0), (-0.5, -0.0), (2.4999, 2.0), (None, None)])
def test_half_even(spark, x, want):
    assert one(spark, "x double", [(x,)], L.half_even("x")) == [want]


def test_half_even_digits(spark):
    assert one(spark, "x double", [(0.12345678905,), (7.08637512999999,)], L.half_even("x", 10)) == [0.123456789, 7.08637513]


def test_ratio_and_casts_never_raise(spark):
    assert one(spark, "a double, b double", [(1.0, 0.0), (0.0, 0.0), (1.0, 4.0), (None, 1.0)], L.ratio("a", "b")) == [None, None, 0.25, None]
    assert one(spark, "x string", [("1.5",), ("junk",), ("",), (None,)], L.to_number("x")) == [1.5, None, None, None]
    odd = ["12d", "12f", "NaN", "Infinity", "-inf", "1e999", "0x1A", "1_0", ".", "1e"]
    assert one(spark, "x string", [(t,) for t in odd], L.to_number("x")) == [None] * len(odd)
    fine = {" 7 ": 7.0, "-.5": -0.5, "+3.": 3.0, "1E-3": 0.001}
    assert one(spark, "x string", [(t,) for t in fine], L.to_number("x")) == list(fine.values())
    assert one(spark, "x string", [("20200604",), ("2020-06-04",), ("04/06/2020",)], L.parse_date("x")) == [
        dt.date(2020, 6, 4), dt.date(2020, 6, 4), None]


def test_paste_and_blanks(spark):
    assert one(spark, "a string, b int", [("x", 1), (None, 2), ("y", None)], L.paste("a", "b")) == ["x_1", "NA_2", "y_NA"]
    assert one(spark, "x string", [("",), ("NA",), ("NAB",), (" ",)], L.blank_to_null("x")) == [None, None, "NAB", " "]


@pytest.mark.parametrize("taxon,stage", [
    ("B_longirostris_eggs", "Egg"), ("B_longirostris_w_eggs", "Other"), ("B_longirostris_wo_eggs", "Other"),
    ("Calanoida_nauplii", "Nauplii"), ("Dreissena_veligers", "Veliger"), ("Keratella", "Other"), (None, "Other"),
])
def test_initial_stage(spark, taxon, stage):
    assert one(spark, "t string", [(taxon,)], L.initial_stage("t")) == [stage]


@pytest.mark.parametrize("taxon,stage,length,cutoff,want", [
    ("A", "Other", 36 * 0.0185, 0.666, "Younger"),  # 0.6659999999999999 as a product of doubles
    ("A", "Other", 0.666, 0.666, "Older"),
    ("A", "Other", 0.1, None, "Older"),
    ("A", "Nauplii", 0.1, None, "Nauplii"),
    ("A", "Nauplii", 0.1, 0.05, "Older"),
    ("X_immature", "Other", 9.0, 0.1, "Younger"),
    ("X_unclass", "Other", 9.0, None, "Younger"),
])
def test_stage_by_length(spark, taxon, stage, length, cutoff, want):
    got = one(spark, "t string, s string, l double, c double", [(taxon, stage, length, cutoff)], L.stage_by_length("t", "s", "l", "c"))
    assert got == [want]


def test_collapse_stage(spark):
    assert one(spark, "s string", [("Older",), ("Younger",), ("Egg",), (None,)], L.collapse_stage("s")) == ["YO", "YO", "Egg", None]


def test_round_nearest_takes_the_nearer_double(spark):
    """Values whose decimal text is halfway and whose double is not, true halves (0.45 is as far from the doubles 0.4 and 0.5), and numbers without such a digit."""
    from fractions import Fraction

    import numpy as np

    want = {0.15: 0.1, 0.25: 0.2, 0.35: 0.3, 0.45: 0.4, 0.65: 0.7, 2.5: 2.5, -0.25: -0.2, -0.15: -0.1, 1e15: 1e15, -1e300: -1e300, 0.0: 0.0}
    assert one(spark, "x double", [(x,) for x in want], L.round_nearest("x", 1)) == list(want.values())
    assert one(spark, "x double", [(0.5,), (1.5,), (2.5,), (None,), (float("inf"),)], L.round_nearest("x", 0)) == [0.0, 2.0, 2.0, None, float("inf")]
    rng = np.random.default_rng(2)
    values = [*(rng.random(200) * 10.0 ** rng.integers(-8, 6, 200)), *(rng.integers(0, 10**6, 100) / 1e10 + 0.5e-10), 131072.00000000003, 1e15 + 0.125]
    got = one(spark, "x double", [(float(x),) for x in values], L.round_nearest("x", 10))
    for x, y in zip(map(float, values), got):
        assert abs(Fraction(y) - Fraction(x)) <= Fraction(1, 2 * 10**10) + Fraction(abs(x)) * Fraction(1, 2**52)


def test_plain_and_lettered_numbers_are_read_alike(spark):
    texts = ["1", "-2.5", "+.5", "3.", " 4 ", "5 6", "1,5", "--1", "", "1e3", "1E-2", "9" * 400, "0" * 400 + "7", "٣", "12d", "é", "1_0", "0x10", "-", "\t8\n"]
    def by_pattern(t):
        import re
        if not re.fullmatch(r"\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*", t):
            return None
        v = float(t)
        return v if abs(v) < float("inf") else None
    assert one(spark, "x string", [(t,) for t in texts], L.to_number("x")) == [by_pattern(t) for t in texts]
