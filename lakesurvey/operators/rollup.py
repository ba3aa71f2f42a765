"""Partial sums that merge: a coarser level of a roll-up comes from a finer one, never from the facts again."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakesurvey.functions import as_col, ratio

#: What is kept of a measure: sum, number and sum of squares of the values present.
KEPT = ("sum", "n", "sq")


def partial_sums(df: DataFrame, keys: Sequence[str], measures: Sequence[str] | Mapping[str, Column]) -> DataFrame:
    """The finest level: rows per group, and for each measure the parts that merge."""
    named = measures if isinstance(measures, Mapping) else {m: F.col(m) for m in measures}
    aggs = [F.count(F.lit(1)).alias("rows")]
    for name, c in named.items():
        aggs += [F.coalesce(F.sum(c), F.lit(0.0)).alias(f"{name}_sum"), F.count(c).alias(f"{name}_n"), F.coalesce(F.sum(c * c), F.lit(0.0)).alias(f"{name}_sq")]
    return df.groupBy(*keys).agg(*aggs)


def measures_of(level: DataFrame) -> list[str]:
    return [c[:-3] for c in level.columns if c.endswith("_sq")]


def merged_sums(level: DataFrame, keys: Sequence[str | Column]) -> DataFrame:
    """A coarser level: the parts of all its groups added up."""
    parts = ["rows", *[f"{m}_{k}" for m in measures_of(level) for k in KEPT]]
    return level.groupBy(*keys).agg(*[F.sum(p).alias(p) for p in parts])


def total(measure: str) -> Column:
    """Sum that is 0 for a group without values."""
    return F.col(f"{measure}_sum")


def mean(measure: str) -> Column:
    """Mean of the values present; null without values."""
    return ratio(F.col(f"{measure}_sum"), F.col(f"{measure}_n"))


def standard_error(measure: str) -> Column:
    """Standard error of the mean; null for fewer than two values."""
    n = as_col(f"{measure}_n")
    spread = F.greatest(F.col(f"{measure}_sq") - F.col(f"{measure}_sum") * F.col(f"{measure}_sum") / n, F.lit(0.0))
    return F.when(n > 1, F.sqrt(spread / (n - 1) / n))


WORD_BITS = 64


def integer_codes(dim: DataFrame, column: str, *, into: str = "code") -> DataFrame:
    """Each present value of a dimension's column with a whole number from 0 on, in order of the values.

    One task numbers the distinct values of a dimension (taxa, sites), not of a fact table.
    """
    values = dim.select(column).dropna().distinct()
    return values.withColumn(into, F.row_number().over(Window.orderBy(column)) - 1)


def distinct_bits(coded: DataFrame, keys: Sequence[str], *, code: str = "code") -> DataFrame:
    """The finest level of an exact distinct count: per group, the codes that occur as bits of 64-bit words.

    A group has a row for each word with a bit in it. Words merge by "or", before the shuffle and from level to level, where a count could not.
    """
    word = F.floor(F.col(code) / WORD_BITS).cast("int").alias("word")
    bit = F.expr(f"shiftleft(1L, CAST(`{code}` % {WORD_BITS} AS INT))")
    return coded.filter(F.col(code).isNotNull()).groupBy(*keys, word).agg(F.bit_or(bit).alias("bits"))


def merged_bits(level: DataFrame, keys: Sequence[str | Column]) -> DataFrame:
    """A coarser level: the bits of all its groups together."""
    return level.groupBy(*keys, "word").agg(F.bit_or("bits").alias("bits"))


def bit_counts(level: DataFrame, keys: Sequence[str], *, into: str = "n") -> DataFrame:
    """Distinct values of each group of a level. Groups without any present value have no row."""
    return level.groupBy(*keys).agg(F.sum(F.bit_count("bits")).cast("long").alias(into))
