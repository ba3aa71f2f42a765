"""Projection, filters and value repair."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesurvey.functions import DATE_PARTS, as_col, if_else, is_member, matches, null_when, to_number
from lakesurvey.operators.joins import left_join, rule_table


def columns_between(df: DataFrame, first: str, last: str) -> list[str]:
    """Column names from ``first`` to ``last`` inclusive, in frame order."""
    names = df.columns
    return names[names.index(first): names.index(last) + 1]


def select_rename(
    df: DataFrame, *keep: str | tuple[str, str], rename: Mapping[str, str] | None = None, drop: Sequence[str] = (),
) -> DataFrame:
    """Keep columns (a pair means an inclusive range; none means all), drop some, rename ``{old: new}``."""
    names: list[str] = []
    for item in keep or tuple(df.columns):
        names += columns_between(df, *item) if isinstance(item, tuple) else [item]
    names = [n for n in dict.fromkeys(names) if n not in set(drop)]
    return df.select(*names).withColumnsRenamed(dict(rename or {}))


def keep_members(df: DataFrame, column: str, values: Iterable) -> DataFrame:
    """Rows whose value is listed; null is not."""
    return df.filter(F.col(column).isin(list(values)))


def drop_members(df: DataFrame, column: str, values: Iterable) -> DataFrame:
    """Rows whose value is not listed; null stays."""
    return df.filter(~is_member(column, values))


def keep_members_of(df: DataFrame, column: str, members: DataFrame, member: str | None = None) -> DataFrame:
    """Rows whose value occurs in a frame, for lists that are data; columns keep their order."""
    other = members.select(F.col(member or column).alias("__member"))
    return df.join(other, F.col(column) == F.col("__member"), "left_semi")


def drop_members_of(df: DataFrame, column: str, members: DataFrame, member: str | None = None) -> DataFrame:
    """Rows whose value does not occur in a frame; null stays."""
    other = members.select(F.col(member or column).alias("__member"))
    return df.join(other, F.col(column) == F.col("__member"), "left_anti")


def date_range(
    df: DataFrame, column: str, *, after: date | None = None, before: date | None = None,
    first: date | None = None, last: date | None = None,
) -> DataFrame:
    """Strict (``after``/``before``) or inclusive (``first``/``last``) bounds, pushed to the scan."""
    c = F.col(column)
    for bound, test in ((after, c.__gt__), (before, c.__lt__), (first, c.__ge__), (last, c.__le__)):
        if bound is not None:
            df = df.filter(test(F.lit(bound)))
    return df


def within_years(df: DataFrame, *, after: date | None = None, before: date | None = None, first: date | None = None, column: str = "year") -> DataFrame:
    """Skip the year partitions outside a span of sample dates; a no-op for an unpartitioned table.

    The stored tables carry the sample year as partition column, so a bound on the date of the
    joined sample also bounds which folders of the facts are read.
    """
    if column not in df.columns:
        return df
    low = max((d.year for d in (after, first) if d is not None), default=None)
    if low is not None:
        df = df.filter(F.col(column) >= low)
    if before is not None:
        df = df.filter(F.col(column) <= before.year)
    return df


def equals_all(df: DataFrame, *, equal: Mapping[str, object] | None = None, differ: Mapping[str, Sequence] | None = None) -> DataFrame:
    """Equality and inequality filters; a row with a missing value fails both kinds."""
    for column, value in (equal or {}).items():
        df = df.filter(F.col(column) == F.lit(value))
    for column, values in (differ or {}).items():
        for value in values:
            df = df.filter(F.col(column) != F.lit(value))
    return df


def regex_exclude(df: DataFrame, column: str, *patterns: str) -> DataFrame:
    """Drop rows matching any pattern; a missing text matches none."""
    return df.filter(~matches(column, *patterns))


def drop_null_rows(df: DataFrame, *columns: str) -> DataFrame:
    return df.dropna(subset=list(columns))


def threshold_filter(df: DataFrame, measure: Column | str, *, above: float | None = None, below: float | None = None) -> DataFrame:
    """Strict numeric bounds on a column or expression."""
    c = as_col(measure)
    if above is not None:
        df = df.filter(c > F.lit(above))
    if below is not None:
        df = df.filter(c < F.lit(below))
    return df


def null_if_implausible(df: DataFrame, *, equal: Mapping[str, float] | None = None, below: Mapping[str, float] | None = None) -> DataFrame:
    """Blank readings equal to a stand-in value or under a lowest plausible one."""
    fixes = {c: null_when(c, F.col(c) == F.lit(v)) for c, v in (equal or {}).items()}
    fixes |= {c: null_when(c, F.col(c) < F.lit(v)) for c, v in (below or {}).items()}
    return df.withColumns(fixes)


def null_by_key(df: DataFrame, key: str, values: Iterable, *measures: str) -> DataFrame:
    """Blank measures of the listed keys."""
    hit = is_member(key, values)
    return df.withColumns({m: null_when(m, hit) for m in measures})


def recode_values(df: DataFrame, column: str, changes: Mapping[str, str], *, into: str | None = None) -> DataFrame:
    """Replace listed values, keep the rest: one flat choice, however many are listed."""
    if not changes:
        return df.withColumn(into or column, F.col(column))
    chain = F
    for old, new in changes.items():
        chain = chain.when(F.col(column) == F.lit(old), F.lit(new))
    return df.withColumn(into or column, chain.otherwise(F.col(column)))


def apply_overrides(df: DataFrame, key: str, overrides: Sequence[tuple[str, str, float | None]]) -> DataFrame:
    """Per-key corrections given as (key value, column, new value); a null new value blanks the cell.

    The rules are turned into one row per key, with a flag per column so that an intended null is
    told from no rule at all.
    """
    columns = list(dict.fromkeys(c for _, c, _ in overrides))
    by_key: dict[str, dict[str, float | None]] = {}
    for k, c, v in overrides:
        by_key.setdefault(k, {})[c] = None if v is None else float(v)
    rows = [(k, *[x for c in columns for x in (c in d, d.get(c))]) for k, d in by_key.items()]
    fields = ", ".join(f"`__has_{c}` boolean, `__new_{c}` double" for c in columns)
    rules = rule_table(df.sparkSession, rows, f"`{key}` string, {fields}")
    joined = left_join(df, rules, key, null_keys=False)
    fixed = {c: F.when(F.col(f"__has_{c}"), F.col(f"__new_{c}")).otherwise(F.col(c)) for c in columns}
    return joined.withColumns(fixed).drop(*[p + c for c in columns for p in ("__has_", "__new_")])


def choose_column_by_key(df: DataFrame, key: str, values: Iterable, *, listed: str, other: str, into: str) -> DataFrame:
    """Column ``listed`` for the listed keys, ``other`` for the rest."""
    return df.withColumn(into, F.when(is_member(key, values), F.col(listed)).otherwise(F.col(other)))


def cast_columns(df: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """Bulk cast; text that does not fit becomes null."""
    return df.withColumns({c: to_number(c) if k == "double" else F.col(c).try_cast(k) for c, k in kinds.items()})


def fill_null(df: DataFrame, value, *columns: str) -> DataFrame:
    return df.fillna(value, subset=list(columns))


def derive_date_parts(df: DataFrame, column: str, names: Mapping[str, str]) -> DataFrame:
    """Add date parts as ``{new column: part}``; parts are the keys of ``DATE_PARTS``."""
    return df.withColumns({new: DATE_PARTS[part](F.col(column)) for new, part in names.items()})


def reassign(df: DataFrame, column: str, rules: Sequence[tuple[Column, str]]) -> DataFrame:
    """Apply conditional replacements one after another; an unknown condition blanks the value."""
    out = F.col(column)
    for cond, new in rules:
        out = if_else(cond, new, out)
    return df.withColumn(column, out)
