"""Life-stage expressions: labels read off taxon names and length-based rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakesurvey.functions.missing import as_col, has_any, is_member

__all__ = [
    "ALWAYS_YOUNGER", "ADULT_MARK", "collapse_stage", "initial_stage", "stage_by_length",
]

# Fragments of taxon names that decide a stage.
EGG_MARK = "_eggs"
CARRIER_MARK = "_w"  # also occurs in "_wo_eggs", so only names of eggs themselves are stage Egg
NAUPLIUS_MARK = "nauplii"
VELIGER_MARK = "veliger"
ADULT_MARK = "adult"
ALWAYS_YOUNGER = ("immature", "unclass")


def initial_stage(taxon: Column | str) -> Column:
    """Egg, Nauplii, Veliger or Other, from the taxon name alone."""
    t = F.coalesce(as_col(taxon), F.lit(""))
    return (
        F.when(t.contains(EGG_MARK) & ~t.contains(CARRIER_MARK), "Egg")
        .when(t.contains(NAUPLIUS_MARK), "Nauplii")
        .when(t.contains(VELIGER_MARK), "Veliger")
        .otherwise("Other")
    )


def stage_by_length(
    taxon: Column | str, stage: Column | str, length: Column | str, cutoff: Column | str,
    always_younger: Sequence[str] = ALWAYS_YOUNGER,
) -> Column:
    """Stage of one measured individual.

    Names that are young by definition come first; then the cutoff splits Younger from Older; an
    unstaged individual without a cutoff is Older; any other stage stays.
    """
    stage, length, cutoff = as_col(stage), as_col(length), as_col(cutoff)
    return (
        F.when(has_any(taxon, *always_younger), "Younger")
        .when(length >= cutoff, "Older")
        .when(length < cutoff, "Younger")
        .when(cutoff.isNull() & (stage == "Other"), "Older")
        .otherwise(stage)
    )


def collapse_stage(stage: Column | str, merged: Sequence[str] = ("Older", "Younger"), label: str = "YO") -> Column:
    """One label for the merged stages; every other stage, and null, stays."""
    return F.when(is_member(stage, merged), label).otherwise(as_col(stage))
