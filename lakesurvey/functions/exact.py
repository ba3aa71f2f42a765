"""Sums of doubles that don't depend on the order of rows.

Adding doubles rounds after every step, so partial sums of another partitioning differ in their last digits. Here a value is cut by its
binary exponent into whole numbers of ``BITS`` bits each; these add up exactly, in any order, as ordinary 64-bit sums that combine before a shuffle.
At the end the totals are carried over into each other and rounded once, to the double nearest to the true sum.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakesurvey.functions.missing import as_col

#: Bits of a part: 2**35 values of one group can be added before a total leaves 64 bits (which is an error, not a wrong result).
BITS = 28
#: Exponent of the lowest bit of each part. Values from 2**86 are added as doubles; bits under 2**-110 are cut off, whatever the order.
PARTS = tuple(range(-110, 86, BITS))
TOP = 2.0 ** (PARTS[-1] + BITS)
_BASE = 1 << BITS


def _parts(c: Column) -> list[Column]:
    """A value's bits from each exponent on, as whole numbers with its sign. Remainders and powers of two are exact in binary."""
    return [((c % F.lit(2.0 ** (k + BITS))) * F.lit(2.0**-k)).cast("long") for k in PARTS]


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _carried(totals: Column) -> Column:
    """The same number with parts between 0 and 2**BITS, but for the last one, which keeps the sign; two more parts take the carry."""
    start = F.struct(F.lit(0).cast("long").alias("carry"), F.array().cast("array<long>").alias("parts"))

    def step(acc: Column, total: Column) -> Column:
        own = total + acc["carry"]
        return F.struct(F.shiftright(own, BITS).alias("carry"), F.concat(acc["parts"], F.array(own.bitwiseAND(F.lit(_BASE - 1)))).alias("parts"))

    zero = F.lit(0).cast("long")
    return F.aggregate(F.concat(totals, F.array(zero)), start, step, lambda acc: F.concat(acc["parts"], F.array(acc["carry"])))


def _nearest(parts: Column) -> Column:
    """The double nearest to a number of carried parts that isn't negative.

    Four parts from the highest that isn't 0 have more bits than a double; whether anything is below them decides halves.
    """
    size = len(PARTS) + 2
    at = F.greatest(F.lit(4), F.lit(size) - F.array_position(F.transform(F.reverse(parts), lambda p: p > 0), F.lit(True)).cast("int") + 1)

    def rounded(at: Column) -> Column:
        part = lambda back: F.element_at(parts, at - back)
        below = F.exists(F.slice(parts, F.lit(1), at - 4), lambda p: p > 0)
        low = (part(2) * _BASE + part(3)) * 2 + below.cast("long")
        whole = (part(0) * _BASE + part(1)).cast("decimal(20,0)") * F.lit(Decimal(1 << (2 * BITS + 1))) + low.cast("decimal(20,0)")
        scale = F.element_at(F.array(*[F.lit(2.0 ** (PARTS[0] + BITS * j - 1)) for j in range(size - 3)]), at - 3)
        return whole.cast("double") * scale

    return _bound(F.when(F.exists(parts, lambda p: p > 0), at).otherwise(F.lit(4)), rounded)


def exact_sum0(c: Column | str) -> Column:
    """Sum that skips nulls, is 0 for a group without values, and is the same for every partitioning of the rows.

    Values that aren't numbers, infinite ones and those from 2**86 are added as usual, after the others.
    """
    c = as_col(c).cast("double")
    small = F.abs(c) < TOP
    totals = [F.coalesce(F.sum(F.when(small, p)), F.lit(0)) for p in _parts(c)]
    def signed(totals: Column) -> Column:
        return _bound(
            F.element_at(_carried(totals), -1) < 0,
            lambda negative: _bound(_carried(F.transform(totals, lambda t: F.when(negative, -t).otherwise(t))), _nearest) * F.when(negative, -1.0).otherwise(1.0),
        )

    return _bound(F.array(*totals), signed) + F.coalesce(F.sum(F.when(~small, c)), F.lit(0.0))


def exact_mean(c: Column | str) -> Column:
    """Mean of the values present, of their exact sum; null for a group without values."""
    c = as_col(c)
    return F.try_divide(exact_sum0(c), F.nullif(F.count(c), F.lit(0)).cast("double"))


def exact_mean_strict(c: Column | str) -> Column:
    """As :func:`exact_mean`, null as soon as one value of the group is missing."""
    c = as_col(c)
    return F.when(F.count(c) == F.count(F.lit(1)), exact_mean(c))
