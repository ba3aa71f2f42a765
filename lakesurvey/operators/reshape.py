"""Long and wide forms, set operations and de-duplication."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, StructType

from lakesurvey.functions import parse_date, to_number
from lakesurvey.schemas import HEADER


def header_spread(
    pairs: DataFrame, key: str | Sequence[str], *, name: str = "Information", value: str = "Value",
    schema: StructType = HEADER,
) -> DataFrame:
    """Key/value pairs to one typed row per sheet, over a fixed list of keys.

    One aggregate with a column per key: a single shuffle, with partial results combined before it.
    Values are parsed inside the aggregate, so that a plan which needs numbers only can hash them
    (text results are aggregated by sorting).
    """
    keys = [key] if isinstance(key, str) else list(key)

    def typed(field):
        if isinstance(field.dataType, DateType):
            return parse_date(value)
        return to_number(value) if isinstance(field.dataType, DoubleType) else F.col(value)

    cells = [F.max(F.when(F.col(name) == f.name, typed(f))).alias(f.name) for f in schema if f.name not in keys]
    return pairs.dropna(subset=[name]).groupBy(*keys).agg(*cells)


def unpivot_measurements(
    df: DataFrame, ids: Sequence[str], cells: Sequence[str], *, name: str, value: str, keep_null: bool = False, parse: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """One row per cell; empty cells are dropped unless kept. ``parse`` is applied to a cell, once.

    The cells of a row are exploded in place as they stand: rows that lie by one of the ids still do, which an unpivot would hide from the planner.
    A cell is parsed as a row of its own, in compiled code, where a function over the array would be interpreted for each of its cells; it is exploded
    once more as parsed, so that leaving out what parsing made empty doesn't parse it again.
    """
    long = df.select(*ids, F.inline(F.array(*[F.struct(F.lit(c).alias("__name"), F.col(c).alias("__cell")) for c in cells])))
    if not keep_null:
        long = long.filter(F.col("__cell").isNotNull())
    if parse is not None:
        long = long.select(*ids, "__name", F.explode(F.array(parse(F.col("__cell")))).alias("__cell"))
        long = long if keep_null else long.filter(F.col("__cell").isNotNull())
    return long.select(*ids, F.col("__name").alias(name), F.col("__cell").alias(value))


def pivot_groups(df: DataFrame, ids: Sequence[str], group: str, value: str, groups: Sequence[str], agg=F.sum) -> DataFrame:
    """One column per listed group; a combination that never occurs stays null."""
    cells = [agg(F.when(F.col(group) == g, F.col(value))).alias(g) for g in groups]
    return df.groupBy(*ids).agg(*cells)


def pivot_open(df: DataFrame, ids: Sequence[str], group: str, value: str, agg=F.sum, *, into: str = "cells", hot_ids: bool = False) -> DataFrame:
    """One map per id from every group that occurs to its aggregate; the groups needn't be known.

    Rows are moved once, by id, and aggregated there twice. Where one id may hold much of the table, ``hot_ids`` combines by id and
    group first, which moves the small results a second time. Rows without a group leave their id with the other groups, or an empty map.
    """
    rows = df.select(*ids, group, value)
    cells = (rows if hot_ids else rows.repartition(*ids)).groupBy(*ids, group).agg(agg(value).alias("__value"))
    entry = F.when(F.col(group).isNotNull(), F.struct(F.col(group), F.col("__value")))
    return cells.groupBy(*ids).agg(F.map_from_entries(F.collect_list(entry)).alias(into))


def group_names(open_pivot: DataFrame, cells: str = "cells") -> list[str]:
    """All groups of an open pivot in order: the columns that an export of it will have."""
    names = open_pivot.select(F.explode(F.map_keys(cells)).alias("name")).distinct().orderBy("name")
    return [r.name for r in names.collect()]


def widened(open_pivot: DataFrame, groups: Sequence[str], cells: str = "cells") -> DataFrame:
    """One column per listed group of an open pivot; a group that an id lacks is null."""
    others = [c for c in open_pivot.columns if c != cells]
    return open_pivot.select(*others, *[F.try_element_at(cells, F.lit(g)).alias(g) for g in groups])


def stack_frames(*frames: DataFrame) -> DataFrame:
    """Stack by column name; a column one frame lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def distinct_rows(df: DataFrame, *columns: str) -> DataFrame:
    return (df.select(*columns) if columns else df).distinct()


def key_difference(left: DataFrame, right: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows of ``left`` whose key does not occur in ``right`` (a missing key matches a missing key)."""
    keys = [on] if isinstance(on, str) else list(on)
    other = right.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return left.join(other, cond, "left_anti")


def partition_by_membership(df: DataFrame, in_first: Column, in_second: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows in the first set, rows in the second, and rows in neither; sets may overlap."""
    yes = [F.coalesce(c, F.lit(False)) for c in (in_first, in_second)]
    return df.filter(yes[0]), df.filter(yes[1]), df.filter(~yes[0] & ~yes[1])
