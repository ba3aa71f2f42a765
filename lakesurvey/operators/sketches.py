"""Sketches that are stored beside a table by year and merge: profiles of any years without passing over all their rows again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakesurvey.operators.aggregates import QUARTILES, as_number, order_statistics, quantiles_wide, top_levels

#: Buckets for each doubling of a value, and what keeps the buckets of all positive doubles above 0.
RESOLUTION, LEAST_POWER, MOST_POWER = 256, 1100, 1100


def value_bucket(x: Column, resolution: int = RESOLUTION) -> Column:
    """The bucket of a double: a whole number that never falls as the value grows, null for null.

    Buckets narrow with the value: ``resolution`` of them for each doubling. NaN comes last, as it sorts. Only the order is relied on, not the borders.
    """
    place = F.floor(F.log2(F.abs(x)) * resolution) + LEAST_POWER * resolution
    size = F.when(F.abs(x) == float("inf"), F.lit((LEAST_POWER + MOST_POWER) * resolution)).otherwise(place).cast("long")
    top = F.lit((LEAST_POWER + MOST_POWER) * resolution + 1).cast("long")
    return F.when(x.isNull(), F.lit(None)).when(F.isnan(x), top).when(x == 0, F.lit(0)).when(x > 0, size).otherwise(-size)


def _long(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return df.select(*keys, *[as_number(df, c).alias(c) for c in columns]).unpivot(list(keys), list(columns), "column", "x")


def number_sketch(df: DataFrame, keys: Sequence[str], columns: Sequence[str], *, resolution: int = RESOLUTION) -> DataFrame:
    """Per group, column and bucket: values ``n``, least ``lo``, greatest ``hi`` and their ``total``; missing ones in the null bucket.

    Rows grow with the groups and the buckets in use (some thousands a column), not with the rows of the table.
    """
    bucket = value_bucket(F.col("x"), resolution).alias("bucket")
    return _long(df, keys, columns).groupBy(*keys, "column", bucket).agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum("x").alias("total")
    )


def merged_number_sketch(sketch: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """A coarser sketch: the buckets of all groups together."""
    return sketch.groupBy(*keys, "column", "bucket").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("total").alias("total"))


def level_sketch(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Per group and text column: how often each level occurs, null among them."""
    texts = df.select(*keys, *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(list(keys), list(columns), "column", "level")
    return texts.groupBy(*keys, "column", "level").agg(F.count(F.lit(1)).alias("n"))


def levels_of_sketch(sketch: DataFrame, *, top: int = 100) -> DataFrame:
    """As ``profile_levels``, from stored level counts of any groups."""
    return top_levels(sketch.groupBy("column", "level").agg(F.sum("n").alias("n")), top)


def quantiles_of_sketch(sketch: DataFrame, df: DataFrame, columns: Sequence[str], probs: Sequence[float] = QUARTILES, *, resolution: int = RESOLUTION) -> DataFrame:
    """Exact interpolated quantiles, one row per column, from a merged sketch of just the rows of ``df``.

    The sketch ranks its buckets exactly. An order statistic at either end of a bucket, or in one of equal values, is known from it.
    For the others ``df`` is read once, and only rows in their buckets, one a column and probability at most, are shuffled. The buckets of
    a column are ranked in one task; their number is bounded by the resolution.
    """
    upto = Window.partitionBy("column").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ranked = sketch.filter(F.col("bucket").isNotNull() & F.col("column").isin(list(columns))).select(
        "*", F.sum("n").over(upto).alias("r"), F.sum("n").over(Window.partitionBy("column")).alias("all")
    ).withColumn("below", F.col("r") - F.col("n"))
    asked = ranked.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probs]))).withColumn("h", (F.col("all") - 1) * F.col("p") + 1)

    def known(rank: Column) -> Column:
        return F.when((rank == F.col("below") + 1) | (F.col("lo") == F.col("hi")), F.col("lo")).when(rank == F.col("r"), F.col("hi"))

    def inside(rank: Column) -> Column:
        return (F.col("below") < rank) & (rank <= F.col("r"))

    low, high = F.floor("h"), F.ceil("h")
    # Ranks that follow each other in two buckets are the end of one and the start of the next, so what stays open lies in one bucket.
    unknown = (inside(low) & known(low).isNull()) | (inside(high) & known(high).isNull())
    found = asked.filter(inside(low) | inside(high)).groupBy("column", "p", F.col("all").alias("n"), "h").agg(
        F.max(F.when(inside(low), known(low))).alias("u"), F.max(F.when(inside(high), known(high))).alias("v"),
        F.max(F.when(unknown, F.struct("bucket", "below"))).alias("open"),
    )
    keys = ["column", "p", "n", "h"]
    wanted = found.filter("open is not null").select(*keys, "open.*")
    rows = _long(df, [], columns).withColumn("bucket", value_bucket(F.col("x"), resolution))
    # One row per column and probability: bounded by the arguments, so the hint is safe.
    hit = rows.join(F.broadcast(wanted), ["column", "bucket"]).groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("m"))
    under = wanted.select(*keys, F.lit(None).cast("double").alias("x"), F.col("below").alias("m"))
    refined = order_statistics(hit.unionByName(under))
    return quantiles_wide(found.filter("open is null").select(*keys, "u", "v").unionByName(refined), probs)


def profile_of_sketch(sketch: DataFrame, df: DataFrame, columns: Sequence[str], *, resolution: int = RESOLUTION) -> DataFrame:
    """As ``profile_numeric``: everything but some quartiles comes from the stored sketch, those from one pass over ``df``.

    Both must hold the same groups, for example the same years. A column without rows has no row here.
    """
    merged = merged_number_sketch(sketch.filter(F.col("column").isin(list(columns))))
    present = F.col("bucket").isNotNull()
    stats = merged.groupBy("column").agg(
        F.coalesce(F.sum(F.when(~present, F.col("n"))), F.lit(0)).alias("n_missing"), F.min("lo").alias("min"),
        F.try_divide(F.sum("total"), F.sum(F.when(present, F.col("n")))).alias("mean"), F.max("hi").alias("max"),
    )
    return stats.join(quantiles_of_sketch(merged, df, columns, resolution=resolution), "column", "left")
