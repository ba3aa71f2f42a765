"""Grouped summaries. Everything here combines partially before its shuffle."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakesurvey.functions import as_col, exact_mean, exact_mean_strict, exact_sum0, mean_skip, mean_strict, ratio, sum0
from lakesurvey.operators.cleaning import derive_date_parts
from lakesurvey.operators.joins import enrich_taxa


def sum_zero_empty(df: DataFrame, keys: Sequence[str], sums: Sequence[str], means: Sequence[str] = (), *, exact: bool = False) -> DataFrame:
    """Null-skipping sums (0 for a group without values) and null-skipping means.

    ``exact`` ones are the same to the last bit however the rows are partitioned, at the cost of seven whole-number sums for each.
    """
    total, mean = (exact_sum0, exact_mean) if exact else (sum0, mean_skip)
    aggs = [total(c).alias(c) for c in sums] + [mean(c).alias(c) for c in means]
    return df.groupBy(*keys).agg(*aggs)


def across_agg(df: DataFrame, keys: Sequence[str], fn: Callable[[str], Column], columns: Sequence[str]) -> DataFrame:
    """One aggregate over a list of columns."""
    return df.groupBy(*keys).agg(*[fn(c).alias(c) for c in columns])


def mean_of(df: DataFrame, keys: Sequence[str], columns: Sequence[str], *, strict: bool = False, exact: bool = False) -> DataFrame:
    """Group means; ``strict`` gives null as soon as a value is missing, ``exact`` ones don't depend on the order of rows."""
    fns = (exact_mean, exact_mean_strict) if exact else (mean_skip, mean_strict)
    return across_agg(df, keys, fns[strict], columns)


def resolve_dups_by_mean(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per key, repeated keys replaced by their (strict) mean."""
    return mean_of(df, keys, columns, strict=True)


def count_min_max(df: DataFrame, keys: Sequence[str], column: str, *, names: tuple[str, str, str] = ("n", "FirstDate", "LastDate")) -> DataFrame:
    """Rows, first and last value per group."""
    n, lo, hi = names
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n), F.min(column).alias(lo), F.max(column).alias(hi))


def conditional_ratio(df: DataFrame, keys: Sequence[str], cond: Column, value: Column | str, *, names: tuple[str, str]) -> DataFrame:
    """Share of the rows with a value that meet the condition, and its complement."""
    value = as_col(value)
    share = ratio(F.count(F.when(cond & value.isNotNull(), 1)), F.count(value))
    return df.groupBy(*keys).agg(share.alias(names[0])).withColumn(names[1], F.lit(1.0) - F.col(names[0]))


def mean_se(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Mean and mean minus/plus its standard error over the values present; one value has none."""
    c = F.col(column)
    se = F.stddev_samp(c) / F.sqrt(F.count(c))
    return (
        df.groupBy(*keys).agg(F.avg(c).alias(column), se.alias("__se"))
        .withColumns({f"{column}_minSE": c - F.col("__se"), f"{column}_maxSE": c + F.col("__se")})
        .drop("__se")
    )


def two_level_mean(df: DataFrame, inner: Sequence[str], outer: Sequence[str], column: str) -> DataFrame:
    """Mean per inner group, then mean of those means per outer group (no outer keys: grand mean)."""
    return mean_of(mean_of(df, [*inner, *outer], [column]), outer, [column])


def grand_mean(df: DataFrame, *columns: str) -> DataFrame:
    return df.agg(*[mean_skip(c).alias(c) for c in columns])


def monthly_rollup(
    df: DataFrame, date: str, keys: Sequence[str], measures: Sequence[str], *, agg: str = "mean",
    year: str = "Y", month: str = "M",
) -> DataFrame:
    """Year by month by keys, by ``mean`` or ``sum`` of the measures, nulls skipped."""
    fn = {"mean": mean_skip, "sum": sum0}[agg]
    dated = derive_date_parts(df, date, {year: "year", month: "month_text"})
    return across_agg(dated, [year, month, *keys], fn, measures)


def regroup_chain(
    df: DataFrame, fine: Sequence[str], dim: DataFrame, labels: Sequence[str], coarse: Sequence[str],
    sums: Sequence[str], means: Sequence[str] = (), *, on: str = "Genus_sp_lifestage",
) -> DataFrame:
    """Sum to fine keys, attach labels, sum to coarser keys.

    The first sum shrinks the facts before the label join and the second shuffle.
    """
    first = sum_zero_empty(df, fine, sums, means)
    return sum_zero_empty(enrich_taxa(first, dim, labels, on=on), coarse, sums, means)


def count_distinct(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Distinct present values per column; planned as two-step aggregates, so no group is gathered."""
    return df.groupBy(*keys).agg(*[F.countDistinct(c).alias(f"n_{c}") for c in columns])


def row_nonnull_count(df: DataFrame, cells: Sequence[str], name: str) -> DataFrame:
    """Filled cells of each row."""
    return df.withColumn(name, reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in cells]))


def group_count(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def histogram(df: DataFrame, column: str, bins: int | None = None) -> DataFrame:
    """Equal-width bins over the range of a column with their counts; empty bins are left out.

    Without ``bins`` their number is ceil(log2 n) + 1. The one-row range is a scalar subquery.
    """
    c = F.col(column)
    values = df.select(column).dropna()
    number = F.lit(bins) if bins else (F.ceil(F.log2(F.count(c))) + 1).cast("int")
    stats = values.agg(F.min(c).alias("lo"), F.max(c).alias("hi"), number.alias("k"))
    lo, hi, k = (stats.select(n).scalar() for n in ("lo", "hi", "k"))
    framed = values.withColumns({"__lo": lo, "__width": (hi - lo) / k, "__k": k})
    slot = F.when(F.col("__width") == 0, 1).otherwise(
        F.least(F.floor(F.try_divide(c - F.col("__lo"), F.col("__width"))) + 1, F.col("__k"))
    )
    return (
        framed.withColumn("bin", slot.cast("int")).groupBy("bin", "__lo", "__width").agg(F.count(F.lit(1)).alias("n"))
        .select(
            "bin", (F.col("__lo") + (F.col("bin") - 1) * F.col("__width")).alias("low"),
            (F.col("__lo") + F.col("bin") * F.col("__width")).alias("high"), "n",
        )
    )


#: How readily a larger step is taken, the same before 5, and how far a value may pass a break and still lie under it.
STEP_BIAS, FIVE_BIAS, BREAK_SLACK = 1.5, 2.75, 1e-7


def round_breaks(values: DataFrame, column: str, bins: int | None = None) -> DataFrame:
    """One row ``first, last, digit, power``: breaks are the whole numbers from first to last, times digit * 10**power.

    The step is 1, 2, 5 or 10 times the power of ten under range / ``bins`` (by default ceil(log2 n + 1)): the next larger one is taken
    while it is nearer to that width, by a bias, than the last. One value alone is given a step of its own size. No row without values.
    """
    c = F.col(column)
    number = F.lit(bins) if bins else F.ceil(F.log2(F.count(c)) + 1)
    stats = values.agg(F.min(c).alias("lo"), F.max(c).alias("hi"), number.cast("double").alias("k")).filter("lo is not null")
    size = F.greatest(F.abs("lo"), F.abs("hi"))
    alike = (F.col("hi") - F.col("lo")) < size * (1 + 1 / (1 + STEP_BIAS)) * F.greatest("k", F.lit(1.0)) * (3 * 2.0**-52)
    own = F.when(size == 0, 1.0).when(size > 10, 9 + size / 10).otherwise(size) * 0.75
    cell = F.when((size == 0) | alike, own).otherwise((F.col("hi") - F.col("lo")) / F.greatest("k", F.lit(1.0)))
    stats = stats.withColumn("cell", cell).withColumn("power", F.floor(F.log10("cell")).cast("int"))
    base = F.pow(F.lit(10.0), F.col("power"))

    def larger(digit: int, than: Column, bias: float) -> Column:
        return digit * base - F.col("cell") < bias * (F.col("cell") - than * base)

    two = F.when(larger(2, F.lit(1), STEP_BIAS), 2).otherwise(1)
    stats = stats.withColumn("two", two)
    five = F.when(larger(5, F.col("two"), FIVE_BIAS), 5).otherwise(F.col("two"))
    stats = stats.withColumn("five", five)
    stats = stats.withColumn("digit", F.when(larger(10, F.col("five"), STEP_BIAS), 10).otherwise(F.col("five")))
    step = F.col("digit") * base
    stats = stats.withColumns({"first": F.floor(F.col("lo") / step + 1e-10), "last": F.ceil(F.col("hi") / step - 1e-10)})
    # At least one bin.
    none = F.col("first") >= F.col("last")
    stats = stats.withColumn("none", none)
    return stats.select(
        F.when(F.col("none") & (F.col("first") >= 0), F.col("last") - 1).otherwise(F.col("first")).alias("first"),
        F.when(F.col("none") & (F.col("first") < 0), F.col("first") + 1).otherwise(F.col("last")).alias("last"), "digit", "power",
    )


def round_histogram(df: DataFrame, column: str, bins: int | None = None) -> DataFrame:
    """Bins between round breaks with their counts, empty ones too: ``bin, low, high, n``.

    A bin holds its upper break, the first one its lower break as well. Values that aren't finite are left out. One
    aggregate finds the range, one counts; the breaks reach the rows as scalars.
    """
    c = F.col(column)
    values = df.select(c.cast("double").alias(column)).filter(F.abs(c) < float("inf"))
    breaks = round_breaks(values, column, bins)
    first, digit, power = (breaks.select(n).scalar() for n in ("first", "digit", "power"))
    framed = values.withColumns({"__first": first, "__step": digit * F.pow(F.lit(10.0), power)})
    slot = F.greatest(F.ceil(c / F.col("__step") - BREAK_SLACK) - F.col("__first"), F.lit(1)).cast("int")
    counts = framed.groupBy(slot.alias("bin")).agg(F.count(F.lit(1)).alias("n"))

    def at(place: Column) -> Column:
        # Below 1, dividing by a whole power gives the double nearest to the decimal break.
        return F.when(F.col("power") < 0, place * F.col("digit") / F.pow(F.lit(10.0), -F.col("power"))).otherwise(place * F.col("digit") * F.pow(F.lit(10.0), F.col("power")))

    all_bins = breaks.select("*", F.explode(F.sequence(F.lit(1), (F.col("last") - F.col("first")).cast("int"))).alias("bin"))
    all_bins = all_bins.select("bin", at(F.col("first") + F.col("bin") - 1).alias("low"), at(F.col("first") + F.col("bin")).alias("high"))
    return all_bins.join(counts, "bin", "left").select("bin", "low", "high", F.coalesce("n", F.lit(0)).alias("n"))


QUARTILES = (0.25, 0.5, 0.75)


CUTS = 256  # parts of a bracket that are ranked apart


def order_statistics(counted: DataFrame) -> DataFrame:
    """``column, p, n, h, u, v``: the values of rank floor(h) and ceil(h) among counted values.

    ``counted`` has ``column, p, n, h, x, m``: how often each value occurs in the bracket of a probability, and in a row of null ``x`` how
    many values lie under it. The bracket is cut into parts of about as many values each; part totals tell in which parts
    the two order statistics lie, and only those parts are ranked.
    """
    keys = ["column", "p", "n", "h"]
    # Both uses of the counted values ask for their number, so that one shuffle of them serves both.
    cuts = counted.filter("m > 0").groupBy("column", "p").agg(F.percentile_approx("x", [k / CUTS for k in range(1, CUTS)], 10_000).alias("cuts"))
    part = F.when(F.col("x").isNull(), -1).otherwise(F.size(F.filter("cuts", lambda c: c < F.col("x"))))
    parted = counted.join(F.broadcast(cuts), ["column", "p"]).withColumn("part", part).drop("cuts")
    before = Window.partitionBy("column", "p").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = parted.groupBy(*keys, "part").agg(F.sum("m").alias("total")).withColumn("below", F.coalesce(F.sum("total").over(before), F.lit(0)))
    low, high = F.floor("h"), F.ceil("h")
    within = lambda rank: (F.col("below") < rank) & (F.col("below") + F.col("total") >= rank)
    wanted = totals.filter(within(low) | within(high)).select("column", "p", "part", "below")
    upto = Window.partitionBy("column", "p", "part").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    ranked = parted.join(F.broadcast(wanted), ["column", "p", "part"]).withColumn("r", F.sum("m").over(upto) + F.col("below")).withColumn("before", F.col("r") - F.col("m"))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("before") < rank) & (F.col("r") >= rank), F.col("x")))

    return ranked.groupBy(*keys).agg(at(low).alias("u"), at(high).alias("v"))


def quantiles_wide(found: DataFrame, probs: Sequence[float]) -> DataFrame:
    """One row per column: between the two order statistics of each probability, linearly."""
    between = F.col("u") + (F.col("h") - F.floor("h")) * (F.col("v") - F.col("u"))
    found = found.withColumn("q", F.when(F.col("u") == F.col("v"), F.col("u")).otherwise(between))
    return found.groupBy("column").agg(*[F.max(F.when(F.col("p") == float(p), F.col("q"))).alias(f"q{round(p * 100):02d}") for p in probs])


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float] = QUARTILES, *, accuracy: int = 100_000) -> DataFrame:
    """Exact interpolated quantiles (linear between order statistics), one row per column.

    Sorting a whole column into one task, or one buffer of all its values, would not scale.
    Instead a sketch brackets each quantile between two values whose ranks surround it: about 3/accuracy of the rows to either
    side, or as many as hold the two order statistics of a short column. A second pass counts the values below the
    bracket and merges equal values in it; :func:`order_statistics` ranks what is left.
    """
    margins = [3.0 / accuracy]
    while margins[-1] < 1:
        margins.append(margins[-1] * 4)
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "column", "x").dropna()
    edges = [min(max(p + sign * m, 0.0), 1.0) for p in probs for m in margins for sign in (-1, 1)]
    sketch = long.groupBy("column").agg(
        F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"),
        F.percentile_approx("x", edges, accuracy).alias("e"),
    )
    # The narrowest margin that holds two rows at least.
    step = F.least(F.greatest(F.ceil(F.log(F.lit(2.0) / (F.lit(margins[0]) * F.col("n"))) / F.log(F.lit(4.0))), F.lit(0)), F.lit(len(margins) - 1)).cast("int")
    wide = F.col("step") == len(margins) - 1
    targets = sketch.withColumn("step", step).select(
        "column", "n",
        F.explode(F.array(*[
            F.struct(
                F.lit(float(p)).alias("p"),
                F.when(wide, F.col("lo")).otherwise(F.col("e")[2 * (len(margins) * i + F.col("step"))]).alias("a"),
                F.when(wide, F.col("hi")).otherwise(F.col("e")[2 * (len(margins) * i + F.col("step")) + 1]).alias("b"),
            )
            for i, p in enumerate(probs)
        ])).alias("t"),
    ).select("column", "n", "t.*").withColumn("h", (F.col("n") - 1) * F.col("p") + 1)
    # One row per column and probability: bounded by the arguments, so the hints are safe.
    hit = long.join(F.broadcast(targets), "column")
    keys = ["column", "p", "n", "h"]
    # Values under the bracket fall into one null row that only carries their number.
    counted = (
        hit.filter(F.col("x") <= F.col("b"))
        .groupBy(*keys, F.when(F.col("x") >= F.col("a"), F.col("x")).alias("x"))
        .agg(F.count(F.lit(1)).alias("m"))
    )
    return quantiles_wide(order_statistics(counted), probs)


def as_number(df: DataFrame, column: str) -> Column:
    """A column's values as doubles: days of a date, seconds of a time, 0 or 1 of a truth value."""
    kind = df.schema[column].dataType.typeName()
    c = F.col(column)
    if kind == "date":
        c = F.unix_date(c)
    elif kind.startswith("timestamp"):
        c = F.unix_micros(c.cast("timestamp")) / 1e6
    return c.cast("double")


def profile_numeric(df: DataFrame, columns: Sequence[str], *, accuracy: int = 100_000) -> DataFrame:
    """Per column: rows missing, minimum, quartiles, mean and maximum.

    Dates count as days since 1970, times as seconds, truth values as 0 and 1; :func:`profile_dates` gives dates back.
    """
    df = df.select(*[as_number(df, c).alias(c) for c in columns])
    stats = df.agg(*[
        F.struct(
            F.lit(c).alias("column"), F.count(F.when(F.col(c).isNull(), 1)).alias("n_missing"),
            F.min(c).alias("min"), F.avg(c).alias("mean"), F.max(c).alias("max"),
        ).alias(c)
        for c in columns
    ])
    rows = stats.select(F.inline(F.array(*[F.col(c) for c in columns])))
    return rows.join(exact_quantiles(df, columns, accuracy=accuracy), "column", "left")


def profile_dates(df: DataFrame, columns: Sequence[str], *, accuracy: int = 100_000) -> DataFrame:
    """As :func:`profile_numeric` for date columns, with dates as results (a mean or quartile between two days is the earlier)."""
    profile = profile_numeric(df, columns, accuracy=accuracy)
    return profile.withColumns({c: F.date_from_unix_date(F.floor(c).cast("int")) for c in profile.columns if c not in ("column", "n_missing")})


def profile_levels(df: DataFrame, columns: Sequence[str], *, top: int = 100) -> DataFrame:
    """Levels of text columns by frequency; beyond ``top`` of them, the first ``top - 1`` and the remainder as ``(Other)``.

    ``rest`` marks the remainder, which a level of that name is not. The rank filter is pushed before the
    shuffle, so a task sees at most ``top`` + 1 rows per mapper.
    """
    counts = (
        df.select(*[F.col(c).cast("string").alias(c) for c in columns])
        .unpivot([], list(columns), "column", "level").groupBy("column", "level").agg(F.count(F.lit(1)).alias("n"))
    )
    return top_levels(counts, top)


def top_levels(counts: DataFrame, top: int) -> DataFrame:
    """The report of :func:`profile_levels` from the counts ``column, level, n``."""
    order = Window.partitionBy("column").orderBy(F.col("n").desc(), F.col("level").asc_nulls_first())
    first = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top + 1)
    many = first.groupBy("column").agg((F.max("rank") > top).alias("many"))
    kept = first.join(many, "column").filter((F.col("rank") < top) | (~F.col("many") & (F.col("rank") <= top)))
    kept = kept.select("column", "level", "n", F.lit(False).alias("rest"))
    totals = counts.groupBy("column").agg(F.sum("n").alias("total"))
    shown = kept.groupBy("column").agg(F.sum("n").alias("shown"))
    other = (
        totals.join(shown, "column", "left").withColumn("n", F.col("total") - F.coalesce("shown", F.lit(0))).filter("n > 0")
        .select("column", F.lit("(Other)").alias("level"), "n", F.lit(True).alias("rest"))
    )
    return kept.unionByName(other)
