"""Left joins of facts to samples, taxa and rules.

Nothing here is broadcast by hint. The planner knows the size of files and of rule tables written
in code, and measures the rest at run time: a side under the session threshold is broadcast, any
other join sorts and merges, with hot keys split. Joins by sheet, which has no hot keys, hash one side where it lies.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


# Stands for a missing value where keys must have one; a value that begins with it gets another one in front.
MISSING = "\0"


def rule_table(spark: SparkSession, rows: Sequence[tuple], schema: StructType | str) -> DataFrame:
    """Rows given in code as a frame of known size (a local relation, not a parallelized list)."""
    kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    columns = list(zip(*rows)) if rows else [()] * len(kind)
    table = pa.table([pa.array(list(c)) for c in columns], names=kind.names)
    return spark.createDataFrame(table).select(*[F.col(f.name).cast(f.dataType) for f in kind])


def left_join(
    facts: DataFrame, dim: DataFrame, on: str | Sequence[str], *, null_keys: bool | Sequence[str] = True,
    collisions: str = "left", suffix: str = "_right", how: str = "left", split_hot: bool = True,
) -> DataFrame:
    """Left join on equally named keys.

    ``null_keys`` lets a missing key match a missing key. Switch it off for a dimension whose key
    is never null: plain equality keeps the partitioning usable for a following aggregate. A list names the keys it holds for.
    Same-named other columns are taken from the left, or kept from the right under ``suffix``.

    A hot key is split at run time only where both inputs of the join come straight from a shuffle.
    A dimension that was itself joined or grouped by the key would be taken over as it lies, so
    with ``split_hot`` its key is wrapped and it is shuffled anew: one more exchange of the smaller
    side. Switch it off for tables bucketed by the key.
    """
    keys = [on] if isinstance(on, str) else list(on)
    clash = [c for c in dim.columns if c in facts.columns and c not in keys]
    if collisions == "left":
        dim = dim.drop(*clash)
    else:
        dim = dim.withColumnsRenamed({c: c + suffix for c in clash})
    hidden = {k: f"__key_{k}" for k in keys}
    wrapped = [(F.when(F.col(k).isNotNull(), F.col(k)) if split_hot else F.col(k)).alias(hidden[k]) for k in keys]
    dim = dim.select(*wrapped, *[c for c in dim.columns if c not in hidden])
    cond = None
    for k in keys:
        left, right = F.col(k), F.col(hidden[k])
        part = left.eqNullSafe(right) if null_keys is True or (null_keys and k in null_keys) else left == right
        cond = part if cond is None else cond & part
    return facts.join(dim, cond, how).drop(*hidden.values())


def inner_join(facts: DataFrame, dim: DataFrame, on: str | Sequence[str], *, split_hot: bool = True) -> DataFrame:
    """Facts with a match, on keys that are never null; hot keys as in :func:`left_join`."""
    return left_join(facts, dim, on, null_keys=False, how="inner", split_hot=split_hot)


def join_within(rows: DataFrame, dim: DataFrame, key: str, on: Sequence[str], *, null_keys: bool | Sequence[str] = True) -> DataFrame:
    """Left join on a key and columns within it, where missing matches missing, that leaves rows lying by the key where they are.

    Matching missing keys hides the layout by the key from the planner, so it is asked of the columns alone; rows without a key, if any, are joined apart.
    ``null_keys`` may name the only columns that hold missing values.
    """
    missing = list(on) if null_keys is True else list(null_keys or [])
    keyed = left_join(rows.filter(F.col(key).isNotNull()), dim, [key, *on], null_keys=missing, split_hot=False)
    loose = left_join(rows.filter(F.col(key).isNull()), dim.filter(F.col(key).isNull()), [key, *on], null_keys=[key, *missing], split_hot=False)
    return keyed.unionByName(loose)


def name_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text keys in which a missing value has a name of its own; :func:`unname_missing` undoes it, and no two values become one.

    Keys that are never missing match by plain equality, so rows that were joined by them are seen to lie by them and are grouped or
    joined again, by these and further keys, where they are.
    """
    return df.withColumns({c: F.coalesce(
        F.when(F.startswith(F.col(c), F.lit(MISSING)), F.concat(F.lit(MISSING), F.col(c))).otherwise(F.col(c)), F.lit(MISSING)) for c in columns})


def unname_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keys of :func:`name_missing` as they were."""
    return df.withColumns({c: F.when(F.startswith(F.col(c), F.lit(MISSING)), F.nullif(F.substring(F.col(c), 2, 1 << 30), F.lit(""))).otherwise(F.col(c))
                           for c in columns})


def in_use(dim: DataFrame, rows: DataFrame, on: str = "Genus_sp_lifestage") -> DataFrame:
    """Rows of a dimension whose key, missing or not, occurs in the given rows.

    A dimension may list far more taxa than the sheets have. Written and read back, what is in use is seen to be small by the planner, and is not
    met by a shuffle of the rows that would send all of a common taxon to one task.
    """
    used = rows.select(F.col(on).alias("__used")).distinct()
    return dim.join(used, F.col(on).eqNullSafe(F.col("__used")), "left_semi")


def enrich_taxa(
    facts: DataFrame, taxa: DataFrame, columns: Sequence[str], *, on: str | Sequence[str] = "Genus_sp_lifestage",
    allow_fanout: bool = False, null_keys: bool = True,
) -> DataFrame:
    """Attach taxonomy columns. The dimension holds a taxon once per life stage, so it is reduced
    to distinct (key, columns) rows; ``allow_fanout`` keeps the repeats, which multiply the facts."""
    keys = [on] if isinstance(on, str) else list(on)
    dim = taxa.select(*keys, *[c for c in columns if c not in keys])
    return left_join(facts, dim if allow_fanout else dim.distinct(), keys, null_keys=null_keys)


def repeated_keys(dim: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Keys occurring more than once in a dimension, with their row counts."""
    keys = [on] if isinstance(on, str) else list(on)
    return dim.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def conflicting_keys(dim: DataFrame, on: str | Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Keys for which a dimension holds different values of ``columns``: enriching by them multiplies facts.

    Word-for-word repeats, such as a taxon once per life stage, don't count.
    """
    keys = [on] if isinstance(on, str) else list(on)
    return repeated_keys(dim.select(*keys, *[c for c in columns if c not in keys]).distinct(), keys)


def star_join(facts: DataFrame, dims: Sequence[tuple[DataFrame, str | Sequence[str]]], *, null_keys: bool = True) -> DataFrame:
    """Several left joins in a row."""
    for dim, on in dims:
        facts = left_join(facts, dim, on, null_keys=null_keys)
    return facts


def attach_scalars(rows: DataFrame, headers: DataFrame, columns: Sequence[str], *, on: str | Sequence[str]) -> DataFrame:
    """Per-sheet header values on each row of the sheet.

    The sheet key is never null, and a sheet is a few hundred rows, so no key is hot. The headers are hashed, one narrow row a sheet: the
    wide rows aren't sorted by sheet to meet them.
    """
    keys = [on] if isinstance(on, str) else list(on)
    return left_join(rows, headers.select(*keys, *columns).hint("shuffle_hash"), keys, null_keys=False, split_hot=False)


def attach_cutoffs(rows: DataFrame, cutoffs: DataFrame, *, on: str = "Genus_sp_lifestage") -> DataFrame:
    """Optional per-taxon length threshold."""
    return left_join(rows, cutoffs.select(on, "Length_cutoff"), on)


def attach_summary(
    rows: DataFrame, keys: Sequence[str], aggs: Mapping[str, Column], *, null_keys: bool = True,
) -> DataFrame:
    """Group summary joined back to each row of its group.

    Aggregate plus join, not a window: partial aggregation runs before the shuffle and a hot group's
    rows can be split over join tasks, where a window would put the whole group in one.
    """
    summary = rows.groupBy(*keys).agg(*[expr.alias(name) for name, expr in aggs.items()])
    return left_join(rows.drop(*aggs), summary, keys, null_keys=null_keys)
