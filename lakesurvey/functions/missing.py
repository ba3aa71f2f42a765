"""Column expressions that spell out what happens to missing values.

Spark's defaults differ from statistical-environment conventions in a handful of places (a null
condition falls to ``otherwise``, ``~isin`` drops nulls, ``sum`` of nothing is null, division by
zero raises). Each helper fixes one of these; all stay inside built-in, code-generated functions.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "any_of", "as_col", "blank_to_null", "half_even", "has_any", "if_else", "is_member", "matches", "mean_skip",
    "mean_strict", "null_below", "null_when", "paste", "ratio", "round_nearest", "sum0", "to_number",
]


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def if_else(cond: Column, yes, no) -> Column:
    """Three-valued choice: an unknown condition gives null, not ``no``."""
    lift = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.when(cond.isNull(), F.lit(None)).when(cond, lift(yes)).otherwise(lift(no))


def is_member(c: Column | str, values: Iterable) -> Column:
    """Membership that is never null, so its negation keeps rows with a missing value."""
    return F.coalesce(as_col(c).isin(list(values)), F.lit(False))


def matches(c: Column | str, *patterns: str) -> Column:
    """True where any pattern occurs; a missing text matches nothing (never null)."""
    return any_of(F.coalesce(as_col(c).rlike(p), F.lit(False)) for p in patterns)


def has_any(c: Column | str, *fragments: str) -> Column:
    """True where any plain fragment occurs in the text (never null); cheaper than a pattern."""
    return any_of(F.coalesce(as_col(c).contains(f), F.lit(False)) for f in fragments)


def any_of(conds: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds, F.lit(False))


def sum0(c: Column | str) -> Column:
    """Sum that skips nulls and is 0 for a group without values."""
    return F.coalesce(F.sum(as_col(c)), F.lit(0.0))


def mean_skip(c: Column | str) -> Column:
    """Mean of the values present; null for a group without values."""
    return F.avg(as_col(c))


def mean_strict(c: Column | str) -> Column:
    """Mean that is null as soon as one value of the group is missing."""
    c = as_col(c)
    return F.when(F.count(c) == F.count(F.lit(1)), F.avg(c))


def half_even(c: Column | str, digits: int = 0) -> Column:
    """Round half to even; ``rint`` for whole numbers, decimal rounding beyond."""
    return F.rint(as_col(c)) if digits == 0 else F.bround(as_col(c), digits)


def round_nearest(c: Column | str, digits: int) -> Column:
    """Of the two decimals around a number with so many digits behind the point, the double that lies nearer to it; halfway, the even one.

    Decided on doubles, as statistical software does today, and not on a number's shortest decimal text: 0.15 is less than a half
    above 0.1 and gives 0.1. Numbers that have no more than 15 digits left before that place are kept.
    """
    c = as_col(c)
    whole = 2.0 ** next(k for k in range(-1100, 1100) if digits + (k + 0.5) * math.log10(2) > 15)
    power, size = F.lit(10.0**digits), F.abs(c)
    low = F.floor(size * power).cast("double")
    below, above = low / power, F.ceil(size * power).cast("double") / power
    nearest = F.when((size - below < above - size) | ((size - below == above - size) & (low % 2 == 0)), below).otherwise(above)
    return F.when(size < whole, F.when(c < 0, -nearest).otherwise(nearest)).otherwise(c)


def ratio(num: Column | str, den: Column | str) -> Column:
    """Division whose result is null, never an error or infinity, for a zero denominator."""
    return F.try_divide(as_col(num), as_col(den))


#: Text that counts as a number: digits with an optional sign, point and exponent, and blanks around them.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

#: Letters of which a text that a cast takes for a number has at least one, if it has letters: suffixes, exponents, hexadecimal marks, words.
CAST_LETTERS = "dDfFeExXnN"


def to_number(c: Column | str) -> Column:
    """Text to double; anything but a finite number becomes null.

    A cast alone would take ``12d`` or ``NaN`` for numbers. Binary doubles, because cutoff tests depend on them. A text without the letters that a cast
    accepts, as nearly all are, can be none of these: it is only cast, and the pattern is kept for the rest.
    """
    text = as_col(c).cast("string")
    plain = ~any_of(text.contains(letter) for letter in CAST_LETTERS) & (F.octet_length(text) < 300)
    value = F.when(text.rlike(NUMBER), text.try_cast("double"))
    return F.when(plain, text.try_cast("double")).otherwise(F.when(F.abs(value) < float("inf"), value))


def blank_to_null(c: Column | str, tokens: Sequence[str] = ("", "NA")) -> Column:
    """Null for a cell that is exactly one of the missing-value tokens."""
    c = as_col(c)
    return F.when(~c.isin(list(tokens)), c)


def paste(*cols: Column | str, sep: str = "_") -> Column:
    """Joined key text in which a missing part reads ``NA`` instead of voiding the key."""
    return F.concat_ws(sep, *[F.coalesce(as_col(c).cast("string"), F.lit("NA")) for c in cols])


def null_when(c: Column | str, cond: Column) -> Column:
    """Blank a measure where the condition holds (a null condition leaves it alone)."""
    return F.when(cond, F.lit(None)).otherwise(as_col(c))


def null_below(c: Column | str, lowest: float) -> Column:
    """Blank readings under the lowest plausible value."""
    return null_when(c, as_col(c) < F.lit(lowest))
