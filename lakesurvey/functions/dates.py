"""Date parsing and date parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakesurvey.functions.missing import as_col

__all__ = ["DATE_PARTS", "parse_date"]

# Names of the parts derived from a date: calendar year, two-digit month text, month, day of year.
DATE_PARTS = {
    "year": lambda d: F.year(d),
    "month_text": lambda d: F.lpad(F.month(d).cast("string"), 2, "0"),
    "month": lambda d: F.month(d),
    "day_of_year": lambda d: F.dayofyear(d),
}


def parse_date(c: Column | str, *formats: str) -> Column:
    """First format that fits wins; text that fits none becomes null."""
    c = as_col(c)
    return F.coalesce(*[F.try_to_date(c, f) for f in formats or ("yyyyMMdd", "yyyy-MM-dd")])
