"""Duplicate flags, group totals on rows, sorted levels and first rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakesurvey.operators.joins import attach_summary
from lakesurvey.operators.reshape import key_difference

_SALT, _LOCAL, _FIRST = "__salt", "__local_rank", "__first"


def flag_duplicates(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], *, flag: str = "dups", parts: int = 256) -> DataFrame:
    """Mark every row of a key but the first in the stated order.

    A key may hold a large share of the rows, so ranking runs in two steps: within one of ``parts`` parts of the
    group, then among the first rows of those parts. Rows that lost the first step keep their part in the second, so
    no task ever receives a whole hot group. A row's part is a hash of its other columns and its input task: the columns
    split a group however the input is laid out, the task splits copies of one row, and both are the same when a task runs again.

    All other columns break ties: only rows alike in every column are interchangeable.
    """
    others = [c for c in df.columns if c not in keys]
    order = [*order, *others]
    local = Window.partitionBy(*keys, _SALT).orderBy(*order)
    salt = F.pmod(F.xxhash64(F.spark_partition_id(), *others), F.lit(parts))
    parted = df.withColumn(_SALT, salt).withColumn(_LOCAL, F.row_number().over(local))
    part = F.when(F.col(_LOCAL) == 1, F.lit(-1)).otherwise(F.col(_SALT))
    final = Window.partitionBy(*keys, part).orderBy(*order)
    ranked = parted.withColumn(flag, (F.col(_LOCAL) > 1) | (F.row_number().over(final) > 1))
    return ranked.drop(_SALT, _LOCAL)


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key by the named columns, then by all others: a minimum, which combines before its shuffle."""
    ordered = [c for c in dict.fromkeys([*order, *df.columns]) if c not in keys]
    if not ordered:
        return df.select(*keys).distinct()
    return df.groupBy(*keys).agg(F.min(F.struct(*ordered)).alias(_FIRST)).select(*keys, f"{_FIRST}.*").select(*df.columns)


def flag_repeats(df: DataFrame, keys: Sequence[str], order: Sequence[str], *, flag: str = "dups", seen: DataFrame | None = None) -> DataFrame:
    """Mark every row of a key but the first in the order of the named columns, without ranking.

    The first rows are minima; all other rows are what is left of the table when one copy of each of them is taken away, a count over whole rows.
    So the rows are moved once, by a hash of all their columns: a hot key is spread over all tasks, only copies of one whole row meet,
    and these are counted before they move. Rows alike in every column are interchangeable.

    With ``seen`` (the keys of a stored table) ``df`` is a new batch: a row whose key was there before is a repeat too. Only one row of each key
    meets the stored keys.
    """
    firsts = first_rows(df, keys, order)
    if seen is not None:
        firsts = key_difference(firsts, seen, keys)
    return firsts.withColumn(flag, F.lit(False)).unionByName(df.exceptAll(firsts).withColumn(flag, F.lit(True)))


def duplicate_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The repeats alone."""
    if all(isinstance(c, str) for c in order):
        return df.exceptAll(first_rows(df, keys, order))
    return flag_duplicates(df, keys, order, flag="dups").filter("dups").drop("dups")


def grouped_mutate(df: DataFrame, keys: Sequence[str], aggs: Mapping[str, Column], *, dedupe: bool = True) -> DataFrame:
    """Group totals written on every row, then distinct rows."""
    out = attach_summary(df, keys, aggs).select(*df.columns, *[c for c in aggs if c not in df.columns])
    return out.distinct() if dedupe else out


def sorted_levels(df: DataFrame, column: str) -> DataFrame:
    """Distinct present values in order (a range-partitioned sort)."""
    return df.select(column).dropna().distinct().orderBy(column)


def head_rows(df: DataFrame, k: int, *order: Column | str) -> DataFrame:
    """The first ``k`` rows in the stated order."""
    return df.orderBy(*order).limit(k)
